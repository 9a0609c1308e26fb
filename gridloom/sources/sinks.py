"""Written forms: day-partitioned blocks, packed cubes, checked samples, mosaics and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_blocks(blocks: DataFrame, path: str) -> None:
    """Writes (cell, day, modality, ...) by day and modality; a partition that is put again replaces the old one."""
    blocks.repartition("day", "modality", F.pmod(F.xxhash64("cell"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "modality").parquet(path)


def blocks_between(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Blocks of a window of days; only its partitions are listed and read."""
    return spark.read.parquet(path).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def packed_bands(pixels: DataFrame, registry: DataFrame, keys: Sequence[str], fill: float = -9999.0) -> DataFrame:
    """One row for each band, its values in row-major order and the fill for missing ones; `position` is the registry's.

    A row is as large as one band of one cell; bands outside the registry are left out.
    """
    known = pixels.join(F.broadcast(registry.select("band", "position")), "band")
    cell = F.struct("y", "x", F.coalesce(F.col("value"), F.lit(fill)).alias("value"))
    packed = known.groupBy(*keys, "position", "band").agg(F.array_sort(F.collect_list(cell)).alias("p"))
    return packed.select(*keys, "position", "band", F.col("p.value").alias("values"))


def checked_samples(samples: DataFrame, sizes: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Samples whose arrays all have their size, and the rest with the names of the wrong ones, to be built anew."""
    wrong = F.array_compact(F.array(*[F.when(F.coalesce(F.size(c), F.lit(-1)) != n, F.lit(c)) for c, n in sizes.items()]))
    judged = samples.withColumn("wrong", wrong)
    return judged.where(F.size("wrong") == 0).drop("wrong"), judged.where(F.size("wrong") > 0)


def write_mosaic(pixels: DataFrame, path: str, stats_path: str, expected: int) -> None:
    """Daily mosaics by day, and each day's share of valid pixels among those expected."""
    pixels.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    coverage = pixels.groupBy("day").agg((F.count("value") / F.lit(expected)).alias("coverage"))
    coverage.write.mode("overwrite").parquet(stats_path)


def with_overall(results: DataFrame, name: str, overall: DataFrame) -> DataFrame:
    """Per-sample results followed by the pooled row, named OVERALL."""
    return results.unionByName(overall.withColumn(name, F.lit("OVERALL")), allowMissingColumns=True)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", "true").csv(path)
