"""Golden values and brute force for names, registries, grids, nearest points, percentiles, splits and models."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import bands, columns, geometry
from gridloom.operators import aggregates, grids, joins, models, series
from gridloom.plans import stored
from gridloom.sources import catalogue, names

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.mark.parametrize("lat, along_lat, along_lon", [(0, 110574.3, 111319.5), (45, 111131.8, 78846.8), (60, 111412.3, 55800.0)])
def test_length_of_a_degree(spark, lat, along_lat, along_lon):
    got = [one(spark, c) for c in columns.metres_per_degree(F.lit(float(lat)))]
    assert abs(got[0] - along_lat) < 1 and abs(got[1] - along_lon) < 1


def test_degree_spacing_narrows_with_latitude(spark):
    x, y = (one(spark, c) for c in columns.degree_spacing(F.lit(60.0), 1.0, 1.0))
    assert abs(y - 111319.49) < 0.01 and abs(x - y / 2) < 0.01


@pytest.mark.parametrize(
    "name, acq, uid",
    [
        ("s1_grd_S1A_IW_GRDH_1SDV_20250403T013722_20250403T013747_058587_07406B_D2E4", "2025-04-03", "D2E4"),
        ("S1C_IW_GRDH_1SDV_20250403T013722_20250403T013747_058587_07406B_00AF.SAFE", "2025-04-03", "00AF"),
        ("s1_grd_S1A_IW_SLC__1SDV_20250403T013722_20250403T013747_058587_07406B_D2E4", None, None),
        ("other", None, None),
    ],
)
def test_radar_names(spark, name, acq, uid):
    got = one(spark, names.sentinel1_name(F.lit(name)))
    assert (str(got.acq) if got.acq else None, got.uid) == (acq, uid)


def test_names_of_other_levels_are_none(spark):
    assert one(spark, names.sentinel2_name(F.lit("S2A_MSIL2A_20240105T184731_N0510_R070_T11UPS_20240105T202515.SAFE"))).acq is None
    got = one(spark, names.sentinel2_name(F.lit("S2C_MSIL1C_20240105T184731_N0511_R070_T11UPS_20240106T202515.SAFE.zip")))
    assert (got.baseline, got.tile, got.proc) == (5.11, "T11UPS", datetime.date(2024, 1, 6))
    assert one(spark, names.landsat_name(F.lit("LC09_L2SP_042024_20240105_20240113_02_T1"))).acq is None


def test_registry_of_bands(spark):
    rows = bands.registry(spark).orderBy("position").collect()
    assert len(rows) == 54 and len({r.band for r in rows}) == 54
    least = {r.band: r.least for r in rows}
    assert [least[b] for b in ("VV", "angle", "B8", "B5_landsat", "Oa17_radiance", "NDSI", "elevation", "slope", "M5", "temperature_2m", "u_wind", "z")] == [-50, 0, -1, 1e-7, -1, -1, 1e-7, 0, -0.01, 184, -53, -1]
    cases = [(5.0, 0.0, True), (0.0, 0.0, True), (-0.1, 0.0, False), (-9999.0, -10000.0, False), (None, 0.0, False), (math.nan, 0.0, False)]
    df = spark.createDataFrame(cases, "v double, low double, want boolean")
    assert df.where(bands.is_valid(F.col("v"), F.col("low")) != F.col("want")).count() == 0


def test_bands_of_fixed_range_are_not_moved(spark):
    rows = [("VV", 3.0, True, 1.0, 0.5, 1.5), ("NDSI", 0.4, True, 0.1, 0.0, 0.4), ("VV", 3.0, False, 1.0, 0.5, -9999.0), ("x", -0.5, True, 0.0, 0.0, -0.5)]
    df = spark.createDataFrame(rows, "band string, v double, valid boolean, mean double, std double, want double")
    got = df.select(bands.normalized(F.col("v"), F.col("valid"), F.col("band"), F.col("mean"), F.col("std")).alias("n"), "want").collect()
    assert all(math.isclose(r.n, r.want) for r in got)
    with pytest.raises(Exception, match="spread is zero"):
        df.select(bands.normalized(F.lit(1.0), F.lit(True), F.lit("VV"), F.lit(1.0), F.lit(0.0))).collect()


def test_lattice_golden(spark):
    square = [(500.0, 500.0), (2500.0, 500.0), (2500.0, 2500.0), (500.0, 2500.0)]
    cells = grids.lattice(spark, square, 1000.0).orderBy("cell_id").collect()
    assert [(c.cell_id, c.min_x, c.min_y) for c in cells] == [(k, 1000.0 * (k % 3), 1000.0 * (k // 3)) for k in range(9)]
    assert [c.cell_id for c in grids.lattice(spark, square, 1000.0, inset=600.0).orderBy("cell_id").collect()] == [0]
    triangle = grids.lattice(spark, [(0.5, 0.5), (3.5, 0.5), (0.5, 3.5)], 1.0).collect()
    assert {(c.min_x, c.min_y) for c in triangle} == {(x, y) for x in range(4) for y in range(4) if max(x, 0.5) + max(y, 0.5) <= 4}
    with pytest.raises(ValueError, match="nothing"):
        grids.lattice(spark, square, 1000.0, inset=1500.0)
    with pytest.raises(ValueError, match="negative"):
        grids.lattice(spark, square, 1000.0, inset=-1.0)
    with pytest.raises(ValueError, match="mode"):
        grids.build_grid("C", square, 1000.0, spark=spark)
    assert grids.build_grid("B", square, 1000.0, spark=spark).count() == 9


def test_zones_combine_first_valid(spark):
    rows = [(0, 0, 0, 1, None), (0, 0, 1, 2, 5.0), (0, 1, 0, 3, 7.0), (0, 1, 1, 4, 8.0), (1, 1, 1, 9, 1.0), (1, 1, 1, 8, 2.0)]
    got = grids.combined_zones(spark.createDataFrame(rows, "row int, col int, zone int, scene int, v double"), ["row", "col"], "zone", ["scene"], "v").collect()
    assert {(r.row, r.col): r.v for r in got} == {(0, 0): 5.0, (0, 1): 7.0, (1, 1): 2.0}


def test_nearest_points_equal_brute_force(spark):
    rng = random.Random(2)
    swath = [(k, k % 3, rng.gauss(0, 20), rng.gauss(0, 20), float(k)) for k in range(120)] + [(500, 0, 300.0, 300.0, 1.0), (501, 0, 300.0, 300.0, 2.0)]
    grid = [(k, k % 4, rng.uniform(-80, 400), rng.uniform(-80, 400)) for k in range(60)] + [(99, 0, 300.0, 300.0)]
    got = joins.nearest_point(spark.createDataFrame(grid, "grid_id int, pass int, x double, y double"), spark.createDataFrame(swath, "point_id int, pass int, x double, y double, v double"), 4.0, "v", ["pass"])
    want = {}
    for g, p, x, y in grid:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, i, v) for i, q, a, b, v in swath if q == p)
        want[g] = near[0][2] if near else None
    assert {r.grid_id: r.v for r in got.collect()} == want


def test_a_grid_far_from_the_swath_meets_few_points(spark):
    rng = random.Random(4)
    swath = [(k, rng.uniform(0, 100), rng.uniform(0, 100), float(k)) for k in range(3000)]
    grid = [(k, 5000.0 + 10 * k, rng.uniform(-3000, 3000)) for k in range(40)]
    points = spark.createDataFrame(swath, "point_id int, px double, py double, v double")
    places = spark.createDataFrame(grid, "grid_id int, x double, y double")
    found = joins.nearest_buckets(places, joins._pyramid(points, [], 4.0, 100.0), [])
    met = found.join(points.withColumns({"cx": F.floor(F.col("px") / 4), "cy": F.floor(F.col("py") / 4)}), ["cx", "cy"]).count()
    assert met < 40 * 3000 / 50
    got = joins.nearest_point(places, points.selectExpr("point_id", "px as x", "py as y", "v"), 4.0, "v").collect()
    assert {r.grid_id: r.v for r in got} == {g: min(((x - a) ** 2 + (y - b) ** 2, i, v) for i, a, b, v in swath)[2] for g, x, y in grid}


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_percentiles_equal_brute_force(spark, bins):
    rng = random.Random(3)
    values = {"a": [rng.expovariate(1) ** 4 for _ in range(501)], "b": [5.0] * 40, "c": [1.0], "d": [float(rng.randrange(4)) for _ in range(200)], None: [2.0, 1.0, 4.0]}
    rows = [(k, v) for k, some in values.items() for v in some] + [("a", None), ("e", None)]
    got = aggregates.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", (0.0, 0.02, 0.5, 0.95, 1.0), bins).collect()
    assert {r.k for r in got} == values.keys()
    for r in got:
        assert np.allclose([r.p0, r.p1, r.p2, r.p3, r.p4], np.quantile(values[r.k], (0.0, 0.02, 0.5, 0.95, 1.0)))


def test_split_takes_the_least_hashes(spark):
    rows = [(g, s) for s in "xy" for g in range(37)]
    got = series.split_exact(spark.createDataFrame(rows, "g int, s string"), ["g"], 0.2, "seed", ["s"]).collect()
    order = {r.g: r.h for r in spark.range(37).select(F.col("id").alias("g"), columns.hash_rank_key("seed", F.col("id")).alias("h")).collect()}
    test = set(sorted(order, key=order.get)[: math.ceil(37 * 0.2)])
    assert len(got) == 74 and all((r.part == "test") == (r.g in test) for r in got)


def test_items_are_documents(spark):
    box = F.struct(F.lit(1.0).alias("min_lon"), F.lit(2.0).alias("min_lat"), F.lit(3.0).alias("max_lon"), F.lit(4.0).alias("max_lat"))
    items = catalogue.catalogue_items(spark.range(1), F.lit("l8"), F.lit("i1"), box, F.lit("2024-01-05").cast("date"), F.lit("a.tar"))
    got = json.loads(catalogue.item_documents(items).first().document)
    assert got["bbox"] == [1, 2, 3, 4] and got["geometry"]["coordinates"][0][2] == [3, 4] and got["properties"]["datetime"] == "2024-01-05T00:00:00Z" and got["assets"]["data"]["href"] == "a.tar"


def test_windows_stay_in_their_season(spark):
    got = spark.range(500).select(geometry.random_window(F.col("id"), (2021, 2022), "11-15", "02-10", 8).alias("w")).select("w.*").collect()
    for r in got:
        first, last = datetime.date(r.year, 11, 15), datetime.date(r.year + 1, 2, 10)
        assert first <= r.first_day and r.last_day <= last and (r.last_day - r.first_day).days == 7
    assert {r.year for r in got} == {2021, 2022} and any(r.last_day == datetime.date(r.year + 1, 2, 10) for r in got)


def test_the_forest_learns_a_known_function(spark):
    rows = spark.range(2000).select((F.col("id") % 40 / 1.0).alias("a"), (F.col("id") % 7 / 1.0).alias("b")).withColumn("y", 3 * F.col("a") - 5 * F.col("b"))
    scored = models.predicted(models.fit_forest(rows, ["a", "b"], "y", trees=20, depth=8), rows, ["a", "b"], ["y"])
    facts = scored.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)), F.stddev_pop("y")).first()
    assert facts[0] < 0.2 * facts[1]


def test_trees_on_sums_of_cells_are_as_good_as_trees_on_rows(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0
    rows = spark.range(6000).select((F.col("id") % 40 / 1.0).alias("a"), (F.col("id") % 7 / 1.0).alias("b"), "id").withColumn("y", 3 * F.col("a") - 5 * F.col("b") + noise)
    odd = rows.where("id < 3").withColumns({"a": F.when(F.col("id") == 0, F.lit(float("nan"))), "id": -1 - F.col("id")})  # one NaN, two nulls
    few = models.fit_forest(rows.unionByName(odd), ["a", "b"], "y", trees=20, depth=8)
    assert few.getNumTrees == 20 and few.predictions.count() == few.bins.cells == 32 * 7  # the rows are not kept and passed over level by level
    scored = models.predicted(few, rows.unionByName(odd), ["a", "b"], ["id", "y"])
    plain = models.predicted(models.RandomForestRegressor(labelCol="y", numTrees=20, maxDepth=8, minInstancesPerNode=2, featureSubsetStrategy="onethird", seed=0).fit(models.assembled(rows, ["a", "b"], ["y"])), rows, ["a", "b"], ["id", "y"])
    rmse = lambda df: df.agg(F.count("*"), F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()
    (n, by_cells), (m, by_rows), spread = rmse(scored), rmse(plain), rows.agg(F.stddev_pop("y")).first()[0]
    assert n == m == 6000 and by_cells < 0.2 * spread and abs(by_cells - by_rows) < 0.05 * spread


def test_trees_draw_rows_as_often_as_poisson_says_and_leave_small_leaves_out(spark):
    rows = spark.range(4000).select((F.col("id") % 2 / 1.0).alias("a"), F.when(F.col("id") == 1, 1e6).otherwise(0.0).alias("y"))
    got = dict(map(tuple, models.predicted(models.fit_forest(rows, ["a"], "y", trees=40, depth=3), rows.distinct(), ["a"], ["a"]).groupBy("a").agg(F.first("prediction")).collect()))
    assert set(got) == {0.0, 1.0} and got[0.0] == 0 and abs(got[1.0] - 500) < 300  # the one row is drawn once on average among some 2000 of its cell
    rare = spark.range(4000).select(F.when(F.col("id") == 1, 1.0).otherwise(0.0).alias("a")).withColumn("y", F.col("a") * 1e6)
    alone = models.predicted(models.fit_forest(rare, ["a"], "y", trees=10, depth=3, leaf=40), rare.where("a = 1"), ["a"], ["a"]).first()
    assert alone.prediction < 1000  # a leaf of fewer than 40 draws is none, so the row shares the mean of all


def parts(rows, group):
    return series.split_exact(rows, [group], 0.2, "split")


def test_the_forest_query_scores_suppliers_it_was_not_fitted_on(spark):
    rows = parts(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_suppkey")
    want = {r.l_suppkey: r["count"] for r in rows.where("part = 'test'").groupBy("l_suppkey").count().collect()}
    got = stored.m01_forest(spark, SF).collect()
    assert {r.l_suppkey: r.n for r in got} == {**want, None: sum(want.values())} and 0 < len(want) < 10
    # the given prices do not depend on the features, so on unseen suppliers a forest is about as good as the mean, and never much worse
    mean = rows.where("part = 'train'").agg(F.avg("l_extendedprice")).first()[0]
    spread = rows.where("part = 'test'").agg(F.sqrt(F.avg((F.col("l_extendedprice") - mean) ** 2))).first()[0]
    assert 0.9 * spread < next(r.rmse for r in got if r.l_suppkey is None) < 1.1 * spread


def test_the_logistic_query_equals_a_plain_solver(spark):
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = parts(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_suppkey").select("part", (F.col("l_returnflag") == "R").cast("double").alias("y"), *features).toPandas()
    train, test = rows[rows.part == "train"], rows[rows.part == "test"]
    scale = lambda x: np.column_stack([np.ones(len(x)), (x[features] - train[features].mean()) / train[features].std()])
    x, w = scale(train), np.zeros(4)
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (train.y - p))
    foretold = (scale(test) @ w > 0).astype(float)
    got = {(r.label, r.prediction): r.n for r in stored.m02_logistic(spark, SF).collect()}
    assert got == {(a, b): n for a in (0.0, 1.0) for b in (0.0, 1.0) if (n := int(((test.y == a) & (foretold == b)).sum()))}
