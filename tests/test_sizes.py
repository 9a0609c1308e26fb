"""Cases that larger tables brought up: places on edges, skewed keys, work that grows with the input."""

import bisect

import duckdb
from pyspark.sql import functions as F

from gridloom.operators import grids, joins
from gridloom.plans import composed
from gridloom.sources import names


def test_cell_that_touches_the_area_from_within_is_inside(spark):
    hull = ((-60.0, -40.0), (70.0, -50.0), (120.0, 10.0), (40.0, 45.0))
    corners = {(5.0, -45.0): True, (90.0, -20.0): True, (0.0, 0.0): True, (0.0, -50.0): False, (115.0, 10.0): False}
    samples = spark.createDataFrame([(i, x + 1, y + 1) for i, (x, y) in enumerate(corners)], "id long, x double, y double")
    kept = {(c.min_x, c.min_y) for c in grids.build_grid("A", hull, 5.0, samples, fully_inside=True).collect()}
    assert kept == {place for place, inside in corners.items() if inside}
    square = spark.createDataFrame([(1, 1.0, 1.0)], "id long, x double, y double")
    assert grids.build_grid("A", ((0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)), 5.0, square, fully_inside=True).count() == 1


def test_tiles_lie_where_their_sql_puts_them_in_every_strip(spark):
    for lattice in (composed.GLOBE, composed.SINUSOIDAL, composed.UTM):
        named = spark.range(2000).select(F.col("id").alias("strip"), (F.col("id") % 7).alias("tile"))
        found = named.select("strip", lattice.left[0]().alias("left"), lattice.top[0]().alias("top")).orderBy("strip").collect()
        asked = duckdb.sql(f"SELECT strip, CAST({lattice.left[1]} AS DOUBLE), CAST({lattice.top[1]} AS DOUBLE) FROM (SELECT range AS strip, range % 7 AS tile FROM range(2000)) ORDER BY strip").fetchall()
        assert [tuple(f) for f in found] == asked  # binary numbers put strips 1325 and 1950 of the globe a pixel too far south


def test_nearest_images_of_one_tile_take_time_in_proportion(spark):
    """One tile with many requests and images; a frame that reaches to the end of the tile reads all of it for every row."""
    rows = spark.range(240_000).select((F.col("id") % 2 == 0).alias("image"), F.col("id"), F.lit(1).alias("tile"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") * 7919 % 50_021).cast("int")).alias("day"))
    images, asked = rows.where("image and id % 3 = 0").withColumnRenamed("id", "scene"), rows.where("not image").withColumnRenamed("id", "request_id")
    found = joins.nearest_in_time(asked, images, ["tile"], "day", "day", "scene")
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan.replace("$", "")
    got = {r.request_id: (r.scene, r.day) for r in found.collect()}
    first = {}
    for r in images.orderBy(F.desc("scene")).collect():
        first[r.day] = r.scene
    days = sorted(first)
    sample = asked.where("request_id % 997 = 0").collect()
    assert len(got) == 120_000 and len(sample) > 50
    for q in sample:
        i = bisect.bisect_left(days, q.day)
        near = min(days[max(i - 1, 0) : i + 1], key=lambda d: (abs((d - q.day).days), d))
        assert got[q.request_id] == (first[near], near)


def test_footprints_read_their_text_once(spark):
    found = names.mtl_footprint(F.col("text"))
    plan = spark.createDataFrame([("{}",)], "text string").select(found.alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") == 1 and "get_json_object" not in plan


def test_windows_are_put_together_where_the_days_of_a_key_are(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int"))
    obs = spark.range(40).select((F.col("id") % 2).alias("k"), day.alias("day"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v"))
    found = joins.window_statistics(obs, ["k"], "day", "v", 3)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan  # no count of distinct days over the rows of all windows
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # rows of windows are not moved
    rows = obs.collect()
    for w in found.collect():
        mine = [r for r in rows if r.k == w.k and 0 <= (w.window_end - r.day).days < 3]
        values = [r.v for r in mine if r.v is not None]
        assert (w.n, w.n_days) == (len(values), len({r.day for r in mine})) and abs(w.mean - sum(values) / len(values)) < 1e-9


def test_a_crowded_key_is_dealt_out_by_its_pairs(spark):
    left, right = (spark.range(n).select(F.floor(F.col("id") / 1000).alias("k"), F.col("id").alias(c)) for c, n in (("a", 300), ("b", 200)))
    met = joins.dealt_join(left, right, ["k"], pairs=5000)
    sizes = met.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 60_000 and max(sizes) < 30_000 and met.distinct().count() == 60_000
    boxes = lambda side, n: spark.range(n).select(F.col("id").alias(f"{side}_id"), *[F.lit(v).alias(c) for c, v in (("min_x", 0.0), ("min_y", 0.0), ("max_x", 0.5), ("max_y", 0.5))])
    assert joins.box_join(boxes("left", 30), boxes("right", 20), 5.0).distinct().count() == 600


def test_crowded_swath_is_met_by_few_points_a_position(spark):
    points = spark.range(4000).select(F.col("id").alias("point_id"), (F.col("id") * 7 % 100 / 10).alias("x"), (F.floor(F.col("id") / 100) / 4).alias("y"), F.col("id").alias("v"))
    swath = points.unionByName(points.withColumn("point_id", F.col("point_id") + 4000).withColumn("v", F.lit(-1).cast("long")))
    grid = spark.createDataFrame([(1, 3.3, 4.1), (2, 3.3, 4.1), (3, -50.0, 200.0), (4, 9.9, 0.0), (5, None, 1.0)], "grid_id long, x double, y double")
    assert joins._fine(points.withColumnsRenamed({"x": "px", "y": "py"}), [], 20.0) < 2
    found = {r.grid_id: r.v for r in joins.nearest_point(grid, swath, 20.0, "v").collect()}
    rows = points.collect()
    asked = {g.grid_id: g.x is not None and min(rows, key=lambda p: ((p.x - g.x) ** 2 + (p.y - g.y) ** 2, p.point_id)).v or None for g in grid.collect()}
    assert found == asked
