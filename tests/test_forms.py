"""Streaming forms over files of one batch each, models and batch scoring on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.operators import models
from gridloom.streaming import forms

DAY = dt.datetime(2024, 3, 1)


def stream(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, ts timestamp, value double, day string").coalesce(1).write.mode("append").parquet(f"{folder}/b{k}")
    return spark.readStream.schema("key string, ts timestamp, value double, day string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def row(key, hours, value):
    at = DAY + dt.timedelta(hours=hours)
    return key, at, value, str(at.date())


def finished(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_carried_values(spark, tmp_path):
    s = stream(spark, str(tmp_path / "in"), [[row("a", 0, None), row("a", 1, 5.0), row("a", 2, None)]])
    got = finished(forms.carried_values(s, "ts", "key", "value"), "carried", "append").orderBy("ts").collect()
    assert [(r.filled, r.age_s) for r in got] == [(None, -1.0), (5.0, 0.0), (5.0, 3600.0)]


def test_trailing_windows_equal_the_batch_form(spark, tmp_path):
    rows = [row("a", 0, 1.0), row("a", 30, 3.0), row("b", 5, None)]
    s = stream(spark, str(tmp_path / "in"), [rows])
    batch = spark.createDataFrame(rows, "key string, ts timestamp, value double, day string")
    got = finished(forms.trailing_windows(s, "ts", ["key"], "value"), "trailing", "complete")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, forms.trailing_windows(batch, "ts", ["key"], "value").collect()), key=str)
    assert got.where("key = 'a'").count() == 9


def test_sweep_writes_each_row_once(spark, tmp_path):
    s = stream(spark, str(tmp_path / "in"), [[row("a", 0, 1.0)], [row("a", 1, 2.0), row("b", 30, 3.0)]])
    for _ in range(2):  # a second start finds nothing new
        forms.sweep(s, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 2.0, 3.0]


def test_models_and_scores(spark):
    df = spark.range(60).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 * 2 + 1).cast("double").alias("y"), "id")
    line = models.fit_linear(df, ["x"], "y")
    assert abs(line.coefficients[0] - 2) < 1e-6 and abs(line.intercept - 1) < 1e-6
    forest = models.fit_forest(df, ["x"], "y", trees=5, depth=5)
    assert forest.getNumTrees == 5
    assert models.score_batches(df, lambda b: b["x"] / 10, ["id"], "id long").where("score between 0 and 0.9").count() == 60
    with pytest.raises(Exception, match="outside"):
        models.score_batches(df, lambda b: b["x"], ["id"], "id long").collect()


def test_the_entry_imports_before_there_is_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 170 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
