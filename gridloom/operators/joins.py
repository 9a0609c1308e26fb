"""Joins of observations, scenes, cells and labels, each turned into an equality join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.steps import written


def cells_by_days(cells: DataFrame, days: DataFrame) -> DataFrame:
    """Every cell on every day; both sides are dimensions, the result is what is asked for."""
    return cells.crossJoin(days)


def complete_calendar(dims: DataFrame, obs: DataFrame, keys: Sequence[str], value: str, fill: float = -9999.0) -> DataFrame:
    """Every row of dims with its reading, or the fill."""
    return dims.join(obs.select(*keys, value), list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def window_statistics(obs: DataFrame, keys: Sequence[str], day: str, value: str, days: int = 8) -> DataFrame:
    """Readings of the `days` days that end with each day. A day goes to the windows that hold it: an equality join, no range join.

    Days are summed up first, so what is dealt out to windows is one row for each day, and counting days needs no
    second look at them. Rows move by their keys alone; the windows of a key are put together where its days are.
    """
    daily = obs.groupBy(*keys, day).agg(F.count(value).alias("_n"), F.sum(value).alias("_sum")).repartition(*keys)
    spread = daily.withColumn("window_end", F.explode(F.sequence(F.col(day), F.date_add(F.col(day), days - 1))))
    total = F.sum("_n")
    return spread.groupBy(*keys, "window_end").agg(total.alias("n"), (F.sum("_sum") / F.nullif(total, F.lit(0).cast("long"))).alias("mean"), F.count(F.lit(1)).alias("n_days"))


#: Pairs of rows that one task of a dealt join forms, as far as its keys allow.
PAIRS_A_TASK = 4_000_000


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], pairs: int | None = None) -> DataFrame:
    """Inner join by equal keys that many rows of both sides share, dealt out by the pairs that it forms.

    The size of such a join's input says nothing of its output, so tasks that are made by input grow with the
    square of the tables. Here the rows of both sides are counted by key; a key of more than `pairs` pairs has its left rows
    dealt into blocks, each of which meets all right rows of the key, and there are as many tasks as the pairs ask for.
    """
    pairs = pairs or PAIRS_A_TASK
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")), list(keys))
    blocks = F.least(F.ceil(F.col("_nl").cast("double") * F.col("_nr") / pairs), F.col("_nl")).cast("int")
    sizes = written(sizes.select(*keys, blocks.alias("_blocks"), (F.col("_nl").cast("double") * F.col("_nr")).alias("_pairs")))
    total = sizes.agg(F.sum("_pairs")).first()[0]
    tasks = int(min(max(2 * (total or 0) / pairs, 1), MOST_TASKS))
    deal = F.pmod(F.xxhash64(*left.columns), F.col("_blocks")).cast("int")
    few = sizes.select(*keys, "_blocks")
    dealt = left.join(few, list(keys)).withColumn("_block", deal).drop("_blocks")
    every = right.join(few, list(keys)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    by = [*keys, "_block"]
    return dealt.repartition(tasks, *by).join(every.repartition(tasks, *by).hint("merge"), by).drop("_block")


#: Tasks of one dealt join at most; more pairs make them longer.
MOST_TASKS = 20_000


def box_join(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes (min_x, min_y, max_x, max_y; ids `left_id`, `right_id`) that overlap, via the tiles of a coarse grid.

    A pair is kept in the tile of its overlap's lower corner only, so nothing has to be
    de-duplicated. Tiles are joined by the number of their pairs, however many boxes lie in one.
    """

    def tiled(df: DataFrame, side: str) -> DataFrame:
        k = lambda c: F.floor(F.col(c) / size)
        named = df.select(f"{side}_id", *[F.col(c).alias(f"{side}_{c}") for c in ("min_x", "min_y", "max_x", "max_y")], F.explode(F.sequence(k("min_x"), k("max_x"))).alias("tx"), F.sequence(k("min_y"), k("max_y")).alias("tys"))
        return named.withColumn("ty", F.explode("tys")).drop("tys")

    joined = dealt_join(tiled(left, "left"), tiled(right, "right"), ["tx", "ty"])
    low_x, low_y = F.greatest("left_min_x", "right_min_x"), F.greatest("left_min_y", "right_min_y")
    overlap = (low_x <= F.least("left_max_x", "right_max_x")) & (low_y <= F.least("left_max_y", "right_max_y"))
    home = (F.col("tx") == F.floor(low_x / size)) & (F.col("ty") == F.floor(low_y / size))
    return joined.where(overlap & home).select("left_id", "right_id")


def prefer(df: DataFrame, keys: Sequence[str], priority: str) -> DataFrame:
    """All rows of the source that comes first on each day (a whole day falls back, not single rows)."""
    first = df.groupBy(*keys).agg(F.min(priority).alias("_first"))
    return df.join(first, list(keys)).where(F.col(priority) == F.col("_first")).drop("_first")


def bilinear(target: DataFrame, pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Readings at fractional (y, x) of target from the four pixels around, weights shared among the valid ones."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1)]))
    spread = target.withColumn("c", corner).withColumn("py", (F.floor("y") + F.col("c.dy")).cast("long")).withColumn("px", (F.floor("x") + F.col("c.dx")).cast("long"))
    weight = (1 - F.abs(F.col("y") - F.col("py"))) * (1 - F.abs(F.col("x") - F.col("px")))
    joined = spread.withColumn("w", weight).join(pixels.select(*keys, F.col("y").cast("long").alias("py"), F.col("x").cast("long").alias("px"), F.col(value).alias("v")), [*keys, "py", "px"], "left")
    valid = F.when(F.col("v").isNotNull(), F.col("w"))
    return joined.groupBy("target_id").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum(valid), F.lit(0.0))).alias(value))


#: Buckets of a level that are sent to all tasks; more are joined by key. Levels between two that are written. Points of a bucket, as a point sees them, and halvings to get there.
FEW_BUCKETS, LEVELS_AT_ONCE, POINTS_OF_BUCKET, MOST_HALVINGS = 10_000, 4, 32, 40


def _fine(points: DataFrame, keys: Sequence[str], size: float) -> float:
    """The size of buckets, halved until few points share one."""
    done = 0
    while done < MOST_HALVINGS:
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: E731, B023
        n = F.col("n").cast("double")
        crowd = points.groupBy(*keys, cell("px"), cell("py")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * n) / F.sum(n)).first()[0]
        steps = min(math.ceil(math.log(crowd / POINTS_OF_BUCKET, 4)) if crowd > POINTS_OF_BUCKET else 0, MOST_HALVINGS - done)
        if not steps:
            break
        done, size = done + steps, size / 2**steps
    return size


def _pyramid(points: DataFrame, keys: Sequence[str], size: float, reach: float) -> list[DataFrame]:
    """Buckets of points (*keys, bx, by, box, one point of it) by levels, from the finest to one that a swath fits in twice over."""
    cell = lambda c: F.floor(F.col(c) / size)
    box = [F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2")]
    levels = [written(points.groupBy(*keys, cell("px").alias("bx"), cell("py").alias("by")).agg(*box, F.min(F.struct("point_id", "px", "py")).alias("one")))]
    up = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.min("one").alias("one")]
    while size <= 2 * reach:
        size *= 2
        half = [F.floor(F.col(c) / 2).alias(c) for c in ("bx", "by")]
        levels.append(written(levels[-1].groupBy(*keys, *half).agg(*up)))
    return levels


def _square(x: Column, y: Column) -> Column:
    return (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2


def nearest_buckets(grid: DataFrame, levels: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """(*keys, grid_id, x, y, cx, cy): the buckets of the finest level that can hold each position's nearest point.

    A position goes down the pyramid and keeps the buckets whose box is not farther than the
    nearest single point it knows of, from this level or from those above.
    """
    ids = [*keys, "grid_id"]
    nearest = lambda c, a, b: F.greatest(F.least(F.col(c), F.col(b)), F.col(a))
    left = grid.where("x is not null and y is not null").select(*ids, "x", "y", F.lit(float("inf")).alias("_known"))
    for depth, level in enumerate(reversed(levels)):
        parent = level.withColumns({"cx": F.floor(F.col("bx") / 2), "cy": F.floor(F.col("by") / 2)}) if depth else level
        few = F.broadcast(parent) if level.count() <= FEW_BUCKETS else parent
        if depth or keys:
            met = left.join(few, [*keys, "cx", "cy"] if depth else list(keys))
        else:
            met = left.crossJoin(few)  # four buckets at most
        low, high = _square(nearest("x", "x1", "x2"), nearest("y", "y1", "y2")), _square(F.col("one.px"), F.col("one.py"))
        at = [*ids, "x", "y", F.col("bx").alias("cx"), F.col("by").alias("cy")]
        near = met.select(*at, low.alias("_low"), F.least(high, "_known").alias("_high")).where(F.col("_low") <= F.col("_high") * (1 + 1e-12))
        bound = F.min("_high").over(Window.partitionBy(*ids))
        kept = near.withColumn("_known", bound).where(F.col("_low") <= F.col("_known") * (1 + 1e-12))
        left = kept.select(*ids, "x", "y", "cx", "cy", "_known")
        if depth % LEVELS_AT_ONCE == LEVELS_AT_ONCE - 1:
            left = written(left)
    return left.drop("_known")


def nearest_point(grid: DataFrame, swath: DataFrame, size: float, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Reading of the nearest swath point to each grid position (grid_id, x, y) among those of equal keys: (*keys, grid_id, value).

    grid and swath have the keys. Of points equally near the one with the lesser
    point_id counts; null only where no point has the position's keys. Buckets of points, at most of
    `size` and finer where points are many, are laid over each other in a pyramid, each with the box
    that its points span and one of the points, so that a position meets the points of a few buckets of the finest
    level only, however far it lies from the swath. Of points in one place the least alone is kept, and what is asked at one
    place is searched once.
    """
    ids = [*keys, "grid_id"]
    swath = swath.where("x is not null and y is not null").select(*keys, "point_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col(value).alias("v"))
    points = written(swath.groupBy(*keys, "px", "py").agg(F.min_by(F.struct("point_id", "v"), "point_id").alias("_p")).select(*keys, "px", "py", "_p.point_id", "_p.v"))
    ends = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if ends[0] is None:
        return grid.select(*ids, F.lit(None).cast(points.schema["v"].dataType).alias(value))
    size = _fine(points, keys, size)
    spots = grid.where("x is not null and y is not null").select(*keys, "x", "y").distinct()
    spots = spots.withColumn("grid_id", F.struct("x", "y"))
    left = nearest_buckets(spots, _pyramid(points, keys, size, max(ends[1] - ends[0], ends[3] - ends[2])), keys)
    cell = lambda c: F.floor(F.col(c) / size)
    seen = left.join(points.withColumns({"cx": cell("px"), "cy": cell("py")}), [*keys, "cx", "cy"])
    found = seen.groupBy(*keys, "x", "y").agg(F.min_by("v", F.struct(_square(F.col("px"), F.col("py")).alias("d"), "point_id")).alias(value))
    return grid.select(*ids, "x", "y").join(found, [*keys, "x", "y"], "left").select(*ids, value)


def nearest_in_time(requests: DataFrame, images: DataFrame, keys: Sequence[str], asked: str, taken: str, image: str) -> DataFrame:
    """The image whose date is closest to the one asked for; of equal ones the earlier, then the lesser id.

    The distinct dates of both sides are lined up in time, each once for its keys, and the last image before and the
    first one after are looked at; no pairs are formed. Requests meet their date's image by an equality join.
    """
    dates = requests.select(*keys, F.col(asked).alias("at")).distinct().withColumn("img", F.lit(None).cast(images.schema[image].dataType)).withColumn("kind", F.lit(1))
    dates = dates.unionByName(images.groupBy(*keys, F.col(taken).alias("at")).agg(F.min(image).alias("img")).withColumn("kind", F.lit(0)))
    found = F.when(F.col("kind") == 0, F.struct(F.col("at").alias("at"), F.col("img").alias("img")))
    # Both windows grow row by row; one that reaches from each row to the end would be read anew for every row.
    last = lambda *order: F.last(found, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = dates.withColumn("before", last("at", "kind")).withColumn("after", last(F.desc("at"), "kind")).where("kind = 1")
    gap = lambda c: F.abs(F.datediff(F.col("at"), F.col(f"{c}.at")))
    chosen = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
    best = both.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("at").alias("_at"), chosen.alias("_best"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = requests.select(*keys, "request_id", F.col(asked).alias("at")).join(best, [*same, F.col("at").eqNullSafe(F.col("_at"))], "left")
    return met.select("request_id", F.col("_best.img").alias(image), F.col("_best.at").alias(taken))


def not_yet_done(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def needed_minus_present(needed: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that are needed and not there."""
    return needed.select(*keys).subtract(present.select(*keys))


def nearest_pixels(target: DataFrame, pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The reading of the pixel that each fractional (y, x) of target lies in, null if there is none: target's columns and the reading."""
    named = pixels.select(*keys, F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), value)
    return target.withColumns({"_y": F.floor("y"), "_x": F.floor("x")}).join(named, [*keys, "_y", "_x"], "left").drop("_y", "_x")


def paired_in_time(predictions: DataFrame, labels: DataFrame, keys: Sequence[str], step: str, value: str, lead: int = 1) -> DataFrame:
    """Predictions beside the labels of `lead` steps later: keys, step, prediction, label."""
    later = labels.select(*keys, (F.col(step) - lead).cast(labels.schema[step].dataType).alias(step), F.col(value).alias("label"))
    return predictions.select(*keys, step, F.col(value).alias("prediction")).join(later, [*keys, step])


def region_split(boxes: DataFrame, region: dict[str, float], box: dict[str, Column]) -> DataFrame:
    """Adds `part`: scenes whose box meets the region are "test", so that no ground is seen in both parts."""
    meets = (box["min_x"] <= region["max_x"]) & (box["max_x"] >= region["min_x"]) & (box["min_y"] <= region["max_y"]) & (box["max_y"] >= region["min_y"])
    return boxes.withColumn("part", F.when(meets, "test").otherwise("train"))


def upsample(coarse: DataFrame, fine: DataFrame, keys: Sequence[str], factor: int, value: str) -> DataFrame:
    """Every fine pixel with the reading of the coarse pixel that it lies in."""
    block = [F.floor(F.col("y") / factor).alias("cy"), F.floor(F.col("x") / factor).alias("cx")]
    named = coarse.select(*keys, F.col("y").cast("long").alias("cy"), F.col("x").cast("long").alias("cx"), F.col(value).alias(f"coarse_{value}"))
    return fine.select("*", *block).join(named, [*keys, "cy", "cx"], "left").drop("cy", "cx")


def point_in_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a point is in a polygon (its ring of corners), edges included: an odd number of crossings, or on an edge."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on_edge = on_edge | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            crossings = crossings + F.when(((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return on_edge | (crossings % 2 == 1)
