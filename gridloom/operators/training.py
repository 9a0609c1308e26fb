"""Training rows of tabular models: from pixels of one tier to a vector of features and a label for each output pixel."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import series as W


def training_rows(pixels: DataFrame, labels: DataFrame, keys: Sequence[str], step: str, value: str, month: Column, block: int) -> DataFrame:
    """(*keys, by, bx, features, label) of every output pixel with a label.

    pixels: (*keys, step, y, x, value). They are averaged to blocks of output pixels, carried forward
    in time with the age of what is carried, and what is still missing is filled by the lower median over
    time, over space, and the mean of all. features holds, by step, the filled value, its age, whether
    the block had a missing pixel, and the month as a point of the circle. labels: (*keys, by, bx, label).
    """
    place = [*keys, "by", "bx"]
    blocks = A.block_down_sample(pixels, [*keys, step], value, block, block)
    carried = W.forward_fill(blocks, place, step, "mean").withColumn("_tier", F.lit(0))
    filled = W.median_fill(carried, place, [*keys, step], ["_tier"], "filled", "_v")
    turn = month * (2 * math.pi / 12)
    facts = F.struct(F.col(step).alias("step"), F.col("_v").alias("value"), "age", "mask", F.sin(turn).alias("month_sin"), F.cos(turn).alias("month_cos"))
    listed = filled.groupBy(*place).agg(F.array_sort(F.collect_list(facts)).alias("features"))  # as long as a series
    return listed.join(labels.where("label is not null").select(*place, "label"), place)


def feature_vector(features: Column) -> Column:
    """One array of numbers: of each step the value, age, mask and month."""
    return F.flatten(F.transform(features, lambda s: F.array(s["value"], s["age"].cast("double"), s["mask"].cast("double"), s["month_sin"], s["month_cos"])))
