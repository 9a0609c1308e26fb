"""Windows over time and space: carried values, fills, stencils, ranks, quotas, trailing stacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.columns import hash_rank_key
from gridloom.operators.aggregates import lower_median


def forward_fill(df: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """Adds `filled`, the last valid reading, and `age`, the steps since it (-1 before the first)."""
    past = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col(value).isNotNull(), F.col(step)), ignorenulls=True).over(past)
    return df.withColumn("filled", F.last(value, ignorenulls=True).over(past)).withColumn("age", F.coalesce((F.col(step) - seen).cast("int"), F.lit(-1)))


def median_fill(df: DataFrame, pixel: Sequence[str], space: Sequence[str], tier: Sequence[str], value: str, out: str = "value_filled") -> DataFrame:
    """Fills by the lower median over a pixel's time, then over space of what that filled, then by the tier's mean.

    Tiers hold most of all pixels, so their means are aggregated and joined back, not taken over a window.
    """
    over = lambda c, keys: lower_median(c).over(Window.partitionBy(*keys))
    timed = df.withColumn("_t", F.coalesce(F.col(value), over(value, pixel)))
    spaced = timed.withColumn("_s", F.coalesce(F.col("_t"), over("_t", space)))
    means = spaced.groupBy(*tier).agg(F.avg("_s").alias("_m"))
    return spaced.join(means, list(tier), "left").withColumn(out, F.coalesce("_s", "_m")).drop("_t", "_s", "_m")


def slope_aspect(df: DataFrame, keys: Sequence[str], height: str, size_x: Column | float, size_y: Column | float) -> DataFrame:
    """Slope and aspect in degrees by the third-order stencil on 3 x 3 pixels; edges repeat themselves.

    For pixels in rows and columns that windows can hold; see stencils.gradients for lattices of
    any extent. The sizes of a pixel may be columns: in degrees, that along a row depends on its latitude.
    """
    along_x, along_y = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    z = F.col(height)
    rows = df.withColumn("_w", F.coalesce(F.lag(z).over(along_x), z)).withColumn("_e", F.coalesce(F.lead(z).over(along_x), z)).withColumn("_r", F.struct("_w", z.alias("_c"), "_e"))
    rows = rows.withColumn("_n", F.coalesce(F.lag("_r").over(along_y), F.col("_r"))).withColumn("_s", F.coalesce(F.lead("_r").over(along_y), F.col("_r")))
    c = F.col
    dx = ((c("_n._e") + 2 * c("_e") + c("_s._e")) - (c("_n._w") + 2 * c("_w") + c("_s._w"))) / (8 * size_x)
    dy = ((c("_s._w") + 2 * c("_s._c") + c("_s._e")) - (c("_n._w") + 2 * c("_n._c") + c("_n._e"))) / (8 * size_y)
    aspect = F.when((dx == 0) & (dy == 0), 270.0).otherwise(F.pmod(450 - F.degrees(F.atan2(dy, -dx)), F.lit(360.0)))  # level ground, as from a signed zero
    rows = rows.withColumn("slope", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))).withColumn("aspect", aspect)
    return rows.drop("_w", "_e", "_r", "_n", "_s")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group; the order must be total."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def assert_no_seams(df: DataFrame, pixel: Sequence[str]) -> DataFrame:
    """How often each target pixel is written more than once: the rows of the offending pixels."""
    return df.groupBy(*pixel).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def quota(df: DataFrame, keys: Sequence[str], ids: Sequence[str], most: int, seed: str) -> DataFrame:
    """At most `most` rows of each group, by a seeded hash of their ids."""
    order = Window.partitionBy(*keys).orderBy(hash_rank_key(seed, *[F.col(i) for i in ids]), *ids)
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def sampled(df: DataFrame, ids: Sequence[str], rows: int, seed: str) -> DataFrame:
    """A sample of so many rows by a seeded hash of their ids, the same whatever the partitions."""
    return df.orderBy(hash_rank_key(seed, *[F.col(i) for i in ids]), *ids).limit(rows)


def best_and_worst(df: DataFrame, score: str, name: str, most: int) -> DataFrame:
    """The rows with the greatest and the least score: kind (best or worst), and the rows' columns. Equal scores go by name."""
    best, worst = df.orderBy(F.desc(score), name).limit(most), df.orderBy(score, name).limit(most)
    return best.select(F.lit("best").alias("kind"), "*").union(worst.select(F.lit("worst").alias("kind"), "*"))


def split_exact(df: DataFrame, groups: Sequence[str], share: float, seed: str, strata: Sequence[str] = ()) -> DataFrame:
    """Adds `part`: ceil(share * n) groups of each stratum are "test". Rows of one group stay together.

    Groups are ranked by their hash. Those that begin alike are counted first, so that a
    group's rank is the number before its beginning and its rank among the groups there.
    """
    names = df.select(*strata, *groups).distinct().withColumn("_h", hash_rank_key(seed, *[F.col(g) for g in groups])).withColumn("_b", F.substring("_h", 1, 4))
    counts = names.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_in"))  # 65,536 for each stratum at most
    stratum = Window.partitionBy(*(strata or [F.lit(0)]))
    before = F.sum("_in").over(stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")
    counts = counts.select(*strata, "_b", before.alias("_before"), F.sum("_in").over(stratum).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", *groups)) + F.col("_before")
    parts = names.join(counts, [*strata, "_b"]).select(*strata, *groups, F.when(rank <= F.ceil(F.col("_n") * share), "test").otherwise("train").alias("part"))
    return df.join(parts, [*strata, *groups])


def exact_ratio_mask(df: DataFrame, sample: Sequence[str], token: Sequence[str], valid: str, encode: float, decode: float, seed: str) -> DataFrame:
    """Adds `mask`: of a sample's N tokens floor(N * encode) get 0, floor(N * decode) get 2, the rest and invalid ones 1."""
    order = Window.partitionBy(*sample).orderBy(hash_rank_key(seed, *[F.col(t) for t in (*sample, *token)]), *token)
    n = F.count(F.lit(1)).over(Window.partitionBy(*sample))
    ranked = df.withColumn("_k", F.row_number().over(order)).withColumn("_n", n)
    encoded = F.floor(F.col("_n") * encode)
    kind = F.when(~F.col(valid), 1).when(F.col("_k") <= encoded, 0).when(F.col("_k") <= encoded + F.floor(F.col("_n") * decode), 2).otherwise(1)
    return ranked.withColumn("mask", kind).drop("_k", "_n")


def trailing_stack(df: DataFrame, keys: Sequence[str], day: str, band: str, value: str, days: int = 8) -> DataFrame:
    """For each window end an array of (t, band, value) in order; a day's readings go to the `days` windows that hold it."""
    spread = df.withColumn("window_end", F.explode(F.sequence(F.col(day), F.date_add(F.col(day), days - 1))))
    t = (days - 1 - F.datediff("window_end", F.col(day))).alias("t")
    return spread.groupBy(*keys, "window_end").agg(F.array_sort(F.collect_list(F.struct(t, F.col(band).alias("band"), F.col(value).alias("value")))).alias("stack"))
