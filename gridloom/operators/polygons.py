"""Joins of points and boxes with many polygons of any shape, over an index of tiles.

A polygon is a set of rings (arrays of x, y corners, not closed), whose inside is what an odd number of
its edges lies beside: holes and islands are rings among others. Its edges count as inside.

Tiles that an edge passes through are `crossed`, tiles wholly inside are `full`. A point in
a full tile is inside without a look at any edge; one in a crossed tile is held against the
edges of its row of tiles only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from gridloom.operators.joins import dealt_join

RINGS = "array<array<struct<x:double,y:double>>>"


def edges(polygons: DataFrame) -> DataFrame:
    """(polygon_id, x1, y1, x2, y2) of all rings."""
    ring = polygons.select("polygon_id", F.explode("rings").alias("r")).where(F.size("r") > 2)
    turned = F.concat(F.slice("r", F.lit(2), F.size("r") - 1), F.slice("r", 1, 1))
    sides = ring.select("polygon_id", F.explode(F.arrays_zip(F.col("r").alias("a"), turned.alias("b"))).alias("s"))
    return sides.select("polygon_id", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def _span(a: str, b: str, size: float) -> Column:
    return F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))


def meets_box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Whether the edge (x1, y1, x2, y2) has a point in a box, its border included: their spans overlap, and not all corners are on one side of the edge."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    side = lambda x, y: (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    sides = [side(x, y) for x in (min_x, max_x) for y in (min_y, max_y)]
    spans = (F.least(x1, x2) <= max_x) & (F.greatest(x1, x2) >= min_x) & (F.least(y1, y2) <= max_y) & (F.greatest(y1, y2) >= min_y)
    return spans & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _edge_tiles(sides: DataFrame, size: float) -> DataFrame:
    tiles = sides.withColumn("tx", F.explode(_span("x1", "x2", size))).withColumn("ty", F.explode(_span("y1", "y2", size)))
    low = [F.col(c) * F.lit(size) for c in ("tx", "ty")]
    return tiles.where(meets_box(low[0], low[1], low[0] + size, low[1] + size))


def tile_index(polygons: DataFrame, size: float) -> DataFrame:
    """(tx, ty, polygon_id, full) of every tile that a polygon crosses or fills.

    The middle line of each row of tiles is cut by the edges; between its odd and even cuts tiles
    have their middle inside, and those that no edge passes are full.
    """
    sides = edges(polygons)
    crossed = _edge_tiles(sides, size).select("polygon_id", "tx", "ty").distinct()
    rows = sides.withColumn("ty", F.explode(_span("y1", "y2", size)))
    middle = (F.col("ty") + 0.5) * size
    cuts = rows.where((F.col("y1") > middle) != (F.col("y2") > middle))
    at = F.col("x1") + (middle - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    lines = cuts.groupBy("polygon_id", "ty").agg(F.array_sort(F.collect_list(at)).alias("c"))  # the edges of one row of one polygon
    pair = F.explode(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2)))
    inner = lines.select("polygon_id", "ty", "c", pair.alias("k"))
    first, last = F.ceil(F.get("c", F.col("k")) / size - 0.5), F.floor(F.get("c", F.col("k") + 1) / size - 0.5)
    inside = inner.where(first <= last).select("polygon_id", F.explode(F.sequence(first, last)).alias("tx"), "ty")
    full = inside.join(crossed, ["polygon_id", "tx", "ty"], "left_anti")
    return full.withColumn("full", F.lit(True)).unionByName(crossed.withColumn("full", F.lit(False)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, ids: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """(*ids, polygon_id) of every point (*ids, x, y) in every polygon (polygon_id, rings), edges included.

    All joins are by tile or by polygon and row of tiles; points in crossed tiles meet the
    edges of one row of one polygon. Points without a position are in none; repeated points count each time.
    """
    kept = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(*ids, "x", "y")
    kept = kept.withColumns({c: F.floor(F.col(v) / size) for c, v in (("tx", "x"), ("ty", "y"))})
    rows = edges(polygons).withColumn("ty", F.explode(_span("y1", "y2", size)))
    arrays = rows.groupBy("polygon_id", "ty").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    index = tile_index(polygons, size)
    held = index.where("full").withColumn("edges", F.lit(None).cast(arrays.schema["edges"].dataType))
    index = index.where("not full").join(arrays, ["polygon_id", "ty"]).select(*held.columns).unionByName(held)
    met = dealt_join(kept, index, ["tx", "ty"])  # edges go with the index, so no pair is moved
    x, y = F.col("x"), F.col("y")

    def beside(e: Column) -> Column:
        """1 for an edge that a line to the left cuts; a great odd number if the point is on it."""
        across = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        on = (across == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        left = ((e["y1"] > y) != (e["y2"] > y)) & (x > (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
        return F.when(on, F.lit(None).cast("int")).otherwise(F.when(left, 1).otherwise(0))

    counted = F.aggregate("edges", F.lit(0), lambda n, e: n + beside(e))  # null once the point is on an edge
    return met.where(F.col("full") | F.coalesce(counted % 2 == 1, F.lit(True))).select(*ids, "polygon_id")


def boxes_meeting_polygons(boxes: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Distinct (box_id, polygon_id) of boxes (box_id, min_x, min_y, max_x, max_y) that share a point with a polygon: an edge meets the box, or the box lies inside."""
    spans = [F.sequence(F.floor(F.col(f"min_{c}") / size), F.floor(F.col(f"max_{c}") / size)) for c in ("x", "y")]
    tiled = boxes.withColumn("tx", F.explode(spans[0])).withColumn("ty", F.explode(spans[1]))
    touched = tiled.join(_edge_tiles(edges(polygons), size), ["tx", "ty"]).where(meets_box(*(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))))
    corners = boxes.select("box_id", F.col("min_x").alias("x"), F.col("min_y").alias("y"))
    inside = points_in_polygons(corners, polygons, size, ("box_id",))
    return touched.select("box_id", "polygon_id").unionByName(inside).distinct()


def region_split(boxes: DataFrame, regions: DataFrame, size: float) -> DataFrame:
    """Adds `part`: boxes that meet any region are "test", so that no ground is seen in both parts."""
    test = boxes_meeting_polygons(boxes, regions, size).select("box_id").distinct().withColumn("part", F.lit("test"))
    return boxes.join(test, "box_id", "left").withColumn("part", F.coalesce("part", F.lit("train")))


def _segments(rings) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of rings of (x, y), without level ones, which bound no trapezoid at its sides."""
    found = [np.zeros((0, 4))]
    for ring in rings or []:
        p = np.array([(c["x"], c["y"]) for c in ring], float).reshape(-1, 2)
        if len(p) > 2:
            found.append(np.hstack([p, np.roll(p, -1, axis=0)]))
    sides = np.concatenate(found)
    return sides[sides[:, 1] != sides[:, 3]]


def overlap_trapezoids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlap of two sets of edges as trapezoids (y1, left1, right1, y2, left2, right2).

    Cut at the heights of all corners and of all crossings of edges, no two edges cross
    within a strip, so its sides are in one order from bottom to top.
    """
    sides = np.concatenate([a, b])
    if not len(a) or not len(b):
        return np.zeros((0, 6))
    low, high = np.minimum(sides[:, 1], sides[:, 3]), np.maximum(sides[:, 1], sides[:, 3])
    slope = (sides[:, 2] - sides[:, 0]) / (sides[:, 3] - sides[:, 1])
    at = lambda k, y: sides[k, 0] + (y - sides[k, 1]) * slope[k]
    with np.errstate(divide="ignore", invalid="ignore"):
        start = sides[:, 0] - sides[:, 1] * slope
        y = (start[None, :] - start[:, None]) / (slope[:, None] - slope[None, :])
    crossing = np.isfinite(y) & (y > np.maximum(low[:, None], low[None, :])) & (y < np.minimum(high[:, None], high[None, :]))
    heights = np.unique(np.concatenate([low, high, y[crossing]]))
    of_a, out = np.arange(len(sides)) < len(a), []
    for y1, y2 in zip(heights, heights[1:]):
        k = np.flatnonzero((low <= y1) & (high >= y2))
        k = k[np.argsort(at(k, (y1 + y2) / 2), kind="stable")]
        both = (np.cumsum(of_a[k]) % 2 == 1) & (np.cumsum(~of_a[k]) % 2 == 1)
        i = np.flatnonzero(both[:-1])
        out.append(np.column_stack([np.full(len(i), y1), at(k[i], y1), at(k[i + 1], y1), np.full(len(i), y2), at(k[i], y2), at(k[i + 1], y2)]))
    return np.concatenate(out) if out else np.zeros((0, 6))


def overlaps(pairs: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """(*keys, parts) of the polygons in two columns (sets of rings): their overlap as trapezoids, rings of three or four corners, in any number.

    Concave polygons and holes are cut exactly. A null polygon or one of fewer than three corners has no
    overlap. Every row is worked on by itself.
    """
    schema = pairs.select(*keys).schema.add("parts", DataType.fromDDL(RINGS))
    corner = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def run(batches):
        for batch in batches:
            parts = []
            for a, b in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist()):
                rings = []
                for y1, l1, r1, y2, l2, r2 in overlap_trapezoids(_segments(a), _segments(b)).tolist():
                    ring = dict.fromkeys([(l1, y1), (r1, y1), (r2, y2), (l2, y2)])
                    rings.append([{"x": x, "y": y} for x, y in ring])
                parts.append(rings)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(parts, pa.list_(pa.list_(corner)))], names=[*keys, "parts"])

    return pairs.select(*keys, F.col(left).cast(RINGS).alias("_a"), F.col(right).cast(RINGS).alias("_b")).mapInArrow(run, schema)
