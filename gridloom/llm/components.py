"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Links of one written partition: few links need no more files than this gives.
PART_ROWS = 50_000


def _stars(rows: DataFrame, parts: int) -> DataFrame:
    """rows (u, v) with the least of u and its v: (u, v, m). The minima are written first, so that the join can split a hub's rows."""
    least = materialize(rows.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).coalesce(parts))
    return rows.join(least, "u")


def _same(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that a link between two nodes names; the component is its least node.

    Nodes are integers. Null ends, loops and repeated links count for nothing. Each
    round is written before the next one reads it, so a lost executor costs one round.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    edges = materialize(edges.distinct())
    before = _same(edges)
    parts = 8 + before[0] // PART_ROWS
    edges = edges.coalesce(parts)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.selectExpr("a as u", "b as v").union(edges.selectExpr("b as u", "a as v"))
        large = _stars(both, parts).where("v > u").selectExpr("v as a", "m as b").distinct()
        large = materialize(large.coalesce(parts))
        small = _stars(large.selectExpr("a as u", "b as v"), parts)
        edges = materialize(small.selectExpr("v as a", "m as b").where("a <> b").union(small.selectExpr("u as a", "m as b")).distinct().coalesce(parts))
        now = _same(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return edges.selectExpr("a as node", "b as component").union(edges.selectExpr("b as node", "b as component").distinct())
