"""Sources as set-wise jobs: all cells and days at once, one row for each cell, day and band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.aggregates import first_valid


def fetch(readings: DataFrame, cells: DataFrame, days: DataFrame, bands: DataFrame, order: Sequence[Column], all_or_nothing: bool, position: Sequence[str] = ()) -> DataFrame:
    """(cell, day, band, *position, value) for every cell, day and band asked for; the first valid reading in `order`, else null.

    readings: calibrated (cell, day, band, *position, value). cells, days and bands are
    dimensions. With all_or_nothing, one band without a reading makes the whole stack
    of its cell and day null, as optical sources want it.
    """
    mosaic = first_valid(readings, ["cell", "day", "band", *position], order, "value")
    asked = cells.crossJoin(days).crossJoin(F.broadcast(bands))  # the result's own size; bands are a registry
    if position:
        asked = asked.join(mosaic.select("cell", *position).distinct(), "cell")
    found = asked.join(mosaic, ["cell", "day", "band", *position], "left")
    if all_or_nothing:
        whole = F.bool_and(F.col("value").isNotNull()).over(Window.partitionBy("cell", "day", *position))
        found = found.withColumn("value", F.when(whole, F.col("value")))
    return found.select("cell", "day", "band", *position, "value")
