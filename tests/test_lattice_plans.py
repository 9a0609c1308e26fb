"""How the steps of sources on lattices are planned: what is read once, what is dealt out, what is held in memory."""

import datetime
import math
from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.operators import lattices as L
from gridloom.plans import composed

SF = "/root/testdata/sf0.001"
NAME = "LC08_L1TP_042024_20240105_20240113_02_T1"


def _plan(df, step="executedPlan"):
    return getattr(df._jdf.queryExecution(), step)().toString()


def _tables(spark):
    read = lambda text: F.concat(F.lit(text), F.substring(F.col("id").cast("string"), 9, 1))  # noqa: E731 - the text, but not as a literal
    asset = dict(zone=F.lit(11), size=F.lit(30.0), left=F.lit(600000.0), top=F.lit(5700000.0), rows=F.lit(2), cols=F.lit(2), mult=F.lit(1.0), add=F.lit(0.0), sun_elevation=F.lit(90.0))
    assets = spark.range(1).select(read(NAME).alias("name"), read("b").alias("band"), *[v.alias(k) for k, v in asset.items()])
    readings = spark.range(4).select(read(NAME).alias("name"), read("b").alias("band"), F.floor(F.col("id") / 2).cast("int").alias("row"), (F.col("id") % 2).cast("int").alias("col"), (F.col("id") + 0.5).alias("dn"))
    cells = spark.range(1).select("id", *[asset[k].alias(k) for k in ("zone", "size", "left", "top", "rows", "cols")]).withColumnRenamed("id", "cell")
    return assets, readings, cells, spark.sql("SELECT DATE '2024-01-05' AS day")


def test_readings_are_found_once_and_told_apart_by_numbers(spark):
    found = L.fetch(L.SOURCES["landsat_qa"], *_tables(spark)[:3], ["b"], _tables(spark)[3])
    assert _plan(found, "optimizedPlan").count("Range (0, 4") == 1  # whole bands are looked for in what was found, which is not found twice
    assert "SortAggregate" not in _plan(found)
    assert sorted(r.value for r in found.collect()) == [0.5, 1.5, 2.5, 3.5]


def test_pixels_ask_for_tasks_and_move_once(spark, monkeypatch):
    monkeypatch.setattr(L, "PIXELS_A_TASK", 0.5)
    source, (assets, readings, _, _) = L.SOURCES["landsat"], _tables(spark)
    chosen = L.in_turn(source, L.selected(source, assets))
    native = L.native_pixels(source, chosen, readings)
    plan = _plan(native)
    assert native.rdd.getNumPartitions() == 8 and plan.count("Exchange") == 3 and "ShuffledHashJoin" in plan
    assert len(native.collect()) == 4


def test_names_are_read_once_for_each_product_and_readings_dealt_before_they_are_grouped(spark):
    source = L.SOURCES["sentinel2"]
    products = composed.products(spark, SF, composed.UTM, composed.sentinel2_names())
    chosen = L.selected(source, products)
    assert "parquet" not in _plan(chosen)  # names are not read while line items are
    readings = composed.readings(spark, SF, composed.sentinel2_names())
    native = L.native_pixels(source, L.in_turn(source, chosen), readings)
    tests = [line for line in _plan(native, "optimizedPlan").splitlines() if "Filter" in line]
    assert not any("date_format" in line for line in tests)
    grouped = [line.split("(")[0].strip(" +-:*") for line in _plan(readings).splitlines()]
    assert grouped.index("HashAggregate") < len(grouped) - 1 - grouped[::-1].index("HashAggregate") < min(i for i, n in enumerate(grouped) if n.startswith("Exchange"))


def test_days_of_names_are_formatted_once_in_the_plan(spark):
    scenes = spark.range(-9, 60).withColumnRenamed("id", "scene").withColumns({"d": (F.col("scene") % 6).cast("int"), "tile": F.floor(F.col("scene") / 6) % 7})
    named = scenes.select("scene", "d", composed.landsat_names().alias("name"), composed.julian_names().alias("julian"))
    plan = _plan(named, "optimizedPlan")
    assert "[20240301,20240302,20240303," in plan and "[2024061,2024062,2024063," in plan
    for r in named.collect():
        day = datetime.date(2024, 3, 1) + datetime.timedelta(r.d)
        done = day + datetime.timedelta(1 + int(math.fmod(r.scene, 5)))
        assert r.name.split("_")[3:5] == [f"{day:%Y%m%d}", f"{done:%Y%m%d}"] and r.julian.startswith(f"MOD09GA.A{day:%Y%j}.")


def test_native_pixels_are_held_by_a_task_and_not_sorted_for_the_pixels_asked_for(spark):
    for bilinear in (False, True):
        found = L.fetch(replace(L.SOURCES["landsat"], bilinear=bilinear), *_tables(spark)[:3], ["b"], _tables(spark)[3])
        joins = [line for line in _plan(found).splitlines() if "Join" in line and "gy#" in line]
        assert joins and all("ShuffledHashJoin" in line and "BuildRight" in line for line in joins)


def test_readings_meet_their_products_where_they_were_dealt_out_without_names(spark):
    source = L.SOURCES["sentinel1"]
    chosen = L.in_turn(source, L.selected(source, composed.products(spark, SF, composed.UTM, composed.sentinel1_names())))
    readings = composed.readings(spark, SF, composed.sentinel1_names())
    wide = L.native_bands(source, chosen, readings, composed.BANDS, by="scene", dealt=True)
    plan = _plan(wide)
    assert plan.count("Exchange") == 3 and "S1A_IW" not in plan  # line items, assets and pixels move once each
    flat = {(r.lattice, r.day, r.band, r.gy, r.gx): r.value for r in L.native_pixels(source, chosen, readings).collect()}  # by names
    found = {}
    for r in wide.collect():
        for n, band in enumerate(composed.BANDS):
            assert r[f"v{n}"] is None or r.there & 1 << n
            if r.there & 1 << n:
                found[r.lattice, r.day, band, r.gy, r.gx] = r[f"v{n}"]
    assert found == flat and None in found.values()


def test_a_pixel_is_grouped_and_met_once_for_all_its_bands(spark):
    assets, readings, cells, days = _tables(spark)
    for bilinear in (False, True):
        found = L.fetch(replace(L.SOURCES["landsat"], bilinear=bilinear), assets, readings, cells, ["b"], days)
        keys = [line.split("keys=")[1].split("]")[0] for line in _plan(found).splitlines() if "Aggregate(keys=" in line and "gy#" in line or "nth#" in line and "Aggregate(keys=" in line]
        assert keys and not any("band#" in k for k in keys)
