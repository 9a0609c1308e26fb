"""Shards of near equal bytes by Karmarkar-Karp differencing over groups of rows that stay together.

The rows of one text are a group and go to one shard. Groups that hold at least
one part in UNITS of all bytes are units of their own; the others are bundled by a
hash of their texts. There are so at most twice UNITS units, however many rows there
are, and only their sums meet in one place. Differencing then combines, again and
again, the two partial partitions of the largest spread, oppositely ordered.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bundles of groups, and the part of all bytes from which a group is a unit of its own.
UNITS = 1 << 14


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit, by multi-way largest differencing. Ties go to earlier units, so the result is fixed."""
    heap = [(-size, i, (size, *[0] * (shards - 1)), (i, *[None] * (shards - 1))) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, sums, bins = heapq.heappop(heap)
        _, _, other_sums, other_bins = heapq.heappop(heap)
        joined = sorted(
            ((a + b, (x, y)) for a, b, x, y in zip(sums, reversed(other_sums), bins, reversed(other_bins))),
            key=lambda bin_: -bin_[0],
        )
        sums = tuple(size for size, _ in joined)
        heapq.heappush(heap, (sums[-1] - sums[0], first, sums, tuple(units for _, units in joined)))
    found = [0] * len(sizes)
    for shard, units in enumerate(heap[0][3] if heap else ()):
        left = [units]
        while left:
            unit = left.pop()
            if isinstance(unit, tuple):
                left += unit
            elif unit is not None:
                found[unit] = shard
    return found


@dataclass
class ShardPlan:
    """Where groups go: the large ones by their digest, the others by their bundle. Either table has at most UNITS rows, for few shards."""

    large: DataFrame
    bundles: DataFrame
    units: int


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _bundle(digest: str, units: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(units)).cast("int")


def plan_shards(sized: DataFrame, shards: int) -> ShardPlan:
    """Plan for a table of (digest, size): rows with one digest go together."""
    spark, units = sized.sparkSession, max(UNITS, 256 * shards)
    total = sized.agg(F.sum("size")).first()[0] or 0
    groups = sized.groupBy("digest").agg(F.sum("size").alias("size"))
    is_large = F.col("size") * units >= total
    sums = (
        groups.groupBy(F.when(is_large, F.col("digest")).alias("digest"), F.when(~is_large, _bundle("digest", units)).alias("bundle"))
        .agg(F.sum("size").alias("size"))
        .orderBy(F.desc("size"), "digest", "bundle")
        .collect()
    )
    found = differencing([row["size"] for row in sums], shards)
    large = [(bytes(row["digest"]), shard) for row, shard in zip(sums, found) if row["digest"] is not None]
    bundles = [(row["bundle"], shard) for row, shard in zip(sums, found) if row["digest"] is None]
    return ShardPlan(
        spark.createDataFrame(large, "digest binary, large_shard int"), spark.createDataFrame(bundles, "bundle int, bundle_shard int"), units
    )


def place(sized: DataFrame, plan: ShardPlan) -> DataFrame:
    """Adds `shard` to every row, by its digest. Nothing is shuffled: both tables of the plan have a bounded number of rows."""
    return (
        sized.withColumn("bundle", _bundle("digest", plan.units))
        .join(F.broadcast(plan.large), "digest", "left")
        .join(F.broadcast(plan.bundles), "bundle", "left")
        .withColumn("shard", F.coalesce("large_shard", "bundle_shard"))
        .drop("bundle", "large_shard", "bundle_shard")
    )


def numbered(placed: DataFrame, order: list[str]) -> DataFrame:
    """Adds `slot`, the place of each row in its shard by this order, from 0 without gaps.

    Rows are dealt out by ranges of (shard, order) and a running number, which parts
    even equal rows, so that neither a shard nor a key lies in one task. A range's rows are
    numbered where they are, less what begins the shard there, plus the rows of the ranges before.
    """
    keys = ["shard", *order, "_row"]
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    before = F.expr("sum(n) over (partition by shard order by _part rows between unbounded preceding and 1 preceding)")
    starts = (
        ranged.groupBy("_part", "shard")
        .agg(F.min("_at").alias("first"), F.count("*").alias("n"))
        .select("_part", "shard", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_less"))
    )
    return ranged.join(F.broadcast(starts), ["_part", "shard"]).withColumn("slot", F.col("_at") + F.col("_less")).drop("_at", "_part", "_less")


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row's shard and its slot there: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: the sums of sizes (UTF-8 bytes plus 1) are near equal, as far
    as groups of equal texts allow, which are never parted. A null text is one of no
    bytes and goes with the empty ones. Slots follow the keys (null first), then the check
    sums; repeated rows have slots of their own. Very long texts count whole, further
    columns are left out, and an empty table gives no rows.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = materialize(
        docs.select(
            F.col(key).cast("long").alias("doc_id"),
            (F.octet_length(content) + 1).cast("long").alias("size"),
            F.crc32(content).alias("text_crc32"),
            _digest(text).alias("digest"),
        )
    )
    placed = place(sized, plan_shards(sized, shards)).drop("digest")
    return numbered(placed, ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, text: str = "text") -> None:
    """Writes whole rows as Parquet, a folder for each shard (a column `shard` gives way to it). Texts stay in the tasks that read them."""
    size = (F.octet_length(F.coalesce(F.col(text), F.lit("")).cast("binary")) + 1).cast("long")
    sized = docs.select(F.struct(*(c for c in docs.columns if c != "shard")).alias("row"), size.alias("size"), _digest(text).alias("digest"))
    plan = plan_shards(sized.select("digest", "size"), shards)
    place(sized, plan).select("row.*", "shard").write.partitionBy("shard").parquet(path)
