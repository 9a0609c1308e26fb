"""Steps of jobs that go on in rounds: what a round has found is written before the next one reads it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder that spark.checkpoint.dir names; a folder of one's own will do on a single machine only."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"{folder or tempfile.mkdtemp(prefix='checkpoint-')}/{uuid.uuid4().hex}")
    return df.checkpoint()


def scratch(spark) -> str:
    """A new path in the shared folder, for tables that a job writes and reads again."""
    written(spark.range(0))  # sees to it that the folder is set
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
