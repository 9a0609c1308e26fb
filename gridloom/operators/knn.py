"""Exact nearest neighbours by distances to pivots and the triangle inequality.

Every row of the base belongs to its nearest pivot's cell, and in it to a ring of like distances. A query's
distances to the pivots bound those to all rows of a ring from both sides: the rings that hold
enough rows by their upper bounds say how far its neighbours can be, and only rings whose lower
bound is not beyond that are looked into. Nothing is lost; how much is saved depends on the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.steps import written

#: Rings that the tasks of the queries know of; with more rows rings get larger, and are then dealt into blocks.
MOST_RINGS = 50_000
#: Share by which bounds are widened, so that rounding loses nothing.
SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and b, by one product."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _apart(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of a sample that are far from each other: each the farthest from those before it."""
    chosen, near = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


@dataclass
class KnnPlan:
    """Queries and rows of the base, dealt out by (ring, part, turn): only pairs of equal ones are compared."""

    asked: DataFrame
    dealt: DataFrame

    def compared(self) -> int:
        """How many pairs that are."""
        keys = ["ring", "part", "turn"]
        counts = self.asked.groupBy(*keys).agg(F.count("*").alias("n")).join(self.dealt.groupBy(*keys).agg(F.count("*").alias("m")), keys)
        return counts.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def plan(queries: DataFrame, base: DataFrame, most: int, block: int = 2048, pivots: int = 64) -> KnnPlan | None:
    """None where base is empty. queries: query_id, q; base: id, v, label. Vectors must be whole."""
    rows = base.count()
    if not rows:
        return None
    sample = base.orderBy(F.xxhash64("id"), "id").limit(8 * pivots).select("v").collect()
    middle = _apart(np.array([r.v for r in sample], float), pivots)

    def to_cells(batches):
        for part in batches:
            if len(part):
                d = _distances(np.vstack(part["v"].to_numpy()).astype(float), middle)
                yield part.assign(cell=d.argmin(axis=1).astype(np.int32), dist=d.min(axis=1))

    schema = base.select("id", "v", "label").schema.add("cell", "integer").add("dist", "double")
    placed = base.select("id", "v", "label").mapInPandas(to_cells, schema)
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("reach"))
    per_ring = max(block, math.ceil(rows / MOST_RINGS))
    many = {r.cell: (max(1, math.ceil(r.n / per_ring)), r.reach) for r in cells.collect()}  # one row a pivot
    known = placed.sparkSession.createDataFrame([(c, n, max(reach, 1e-300)) for c, (n, reach) in many.items()], "cell int, rings int, reach double")
    ringed = placed.join(F.broadcast(known), "cell").withColumn("k", F.least(F.floor(F.col("dist") / F.col("reach") * F.col("rings")), F.col("rings") - 1))
    rings = ringed.groupBy("cell", "k").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("cell", "k").collect()
    cell, n, low, high = (np.array([r[c] for r in rings]) for c in ("cell", "n", "low", "high"))
    parts = np.ceil(n / block).astype(int)

    def to_rings(batches):
        step = max(1, 4_000_000 // len(n))
        for whole in batches:
            for i in range(0, len(whole), step):
                part = whole.iloc[i : i + step]
                d = _distances(np.vstack(part["q"].to_numpy()).astype(float), middle)[:, cell]
                wide = SLACK * (1 + d + high)
                upper = d + high + wide
                order = upper.argsort(axis=1)
                enough = (np.cumsum(n[order], axis=1) > most).argmax(axis=1)  # one more than wanted, for a row of the query's own id
                enough = np.where(n.sum() > most, enough, len(n) - 1)
                reach = np.take_along_axis(upper, np.take_along_axis(order, enough[:, None], 1), 1)
                near = np.maximum(np.maximum(d - high, low - d), 0) - wide <= reach
                at, ring = np.nonzero(near)
                at, ring = np.repeat(at, parts[ring]), np.repeat(ring, parts[ring])
                which = np.arange(len(ring)) - np.maximum.accumulate(np.where(np.r_[True, (ring[1:] != ring[:-1]) | (at[1:] != at[:-1])], np.arange(len(ring)), 0)) if len(ring) else ring
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[at], "ring": ring.astype(np.int32), "part": which.astype(np.int32)})

    asks = queries.select("query_id", "q").mapInPandas(to_rings, queries.select("query_id").schema.add("ring", "integer").add("part", "integer"))
    asks = written(asks)
    turns = asks.groupBy("ring", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("turns"))
    slot = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    asked = asks.join(turns, ["ring", "part"]).withColumn("turn", slot("query_id", F.col("turns"))).drop("turns").join(queries.select("query_id", "q"), "query_id")
    numbers = placed.sparkSession.createDataFrame([(r.cell, r.k, i, int(parts[i])) for i, r in enumerate(rings)], "cell int, k long, ring int, parts int")  # MOST_RINGS at most
    dealt = ringed.join(F.broadcast(numbers), ["cell", "k"]).withColumn("part", slot("id", F.col("parts")))
    dealt = dealt.join(turns, ["ring", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    return KnnPlan(asked, dealt.select("ring", "part", "turn", "id", "v", "label"))


def nearest(queries: DataFrame, base: DataFrame, most: int, block: int = 2048, pivots: int = 64) -> DataFrame:
    """(query_id, rank, id, label, d): the `most` nearest rows of base to each query, by squared distance, then by id. A row of the query's own id is none."""
    id_type, label_type = base.schema["id"].dataType, base.schema["label"].dataType
    schema = queries.select("query_id").schema.add("id", id_type).add("label", label_type).add("d", "double")
    found = plan(queries, base, most, block, pivots)
    if found is None:
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0)).select("query_id", "rank", "id", "label", "d")

    def best(asked: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or dealt.empty:
            return pd.DataFrame({"query_id": [], "id": [], "label": [], "d": []})
        v, q = (np.vstack(x.to_numpy()).astype(float) for x in (dealt["v"], asked["q"]))
        ids, names = dealt["id"].to_numpy(), asked["query_id"].to_numpy()
        near = _distances(q, v)
        near[names[:, None] == ids[None, :]] = np.inf
        k = min(most, len(ids))
        bound = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
        at, row = np.nonzero((near <= bound + SLACK * (1 + bound)) & np.isfinite(near))
        d = ((v[row] - q[at]) ** 2).sum(axis=1)  # as they are, for the order of equals
        order = np.lexsort((ids[row], d, at))
        at, row, d = at[order], row[order], d[order]
        first = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]], np.arange(len(at)), 0)) if len(at) else at
        keep = np.arange(len(at)) - first < most
        return pd.DataFrame({"query_id": names[at[keep]], "id": ids[row[keep]], "label": dealt["label"].to_numpy()[row[keep]], "d": d[keep]})

    keys = ["ring", "part", "turn"]
    scored = found.asked.groupBy(*keys).cogroup(found.dealt.groupBy(*keys)).applyInPandas(best, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "id", "label", "d")


def predict(queries: DataFrame, base: DataFrame, most: Sequence[int], block: int = 2048, pivots: int = 64) -> DataFrame:
    """(query_id, k, mean_label, n): mean label of the k nearest rows of base, for each query and each k in `most`."""
    each = nearest(queries, base, max(most), block, pivots).withColumn("k", F.explode(F.array(*map(F.lit, most)))).where("rank <= k")
    return each.groupBy("query_id", "k").agg(F.avg("label").alias("mean_label"), F.count("*").alias("n"))
