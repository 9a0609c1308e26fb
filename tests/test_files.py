"""Readers, writers and clipping on small files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.geometry import polygon_area_km2
from gridloom.operators import clipping
from gridloom.operators.joins import point_in_polygon
from gridloom.sources import files, names, sinks


def test_products_are_listed_and_decoded(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1, 2], [3, 4]]))
    np.save(tmp_path / "b.npy", np.array([[9.5]]))
    (tmp_path / "c.txt").write_text("other")
    assert {r["name"] for r in files.products(spark, str(tmp_path), "*.npy").collect()} == {"a.npy", "b.npy"}
    rows = files.decode_products(spark, str(tmp_path), "*.npy", files.npy_pixels, files.NPY_SCHEMA)
    assert sorted((r["y"], r["x"], r["value"]) for r in rows.collect()) == [(0, 0, 1.0), (0, 0, 9.5), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]


def test_products_of_all_modalities(spark, tmp_path):
    for folder, name in (("l8", "LC08_L1TP_042024_20240105_20240113_02_T1.tar"), ("s2", "S2A_MSIL1C_20240105T184731_N0510_R070_T11UPS_20240105T202515.SAFE.zip"), ("s2", "notes.txt")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(b"x")
    rows = files.product_catalogue(spark, {"landsat": (f"{tmp_path}/l8", "*.tar"), "s2": (f"{tmp_path}/s2", "*.zip")})
    parsed = rows.select("modality", F.coalesce(names.landsat_name(F.col("name"))["acq"], names.sentinel2_name(F.col("name"))["acq"]).alias("acq"), "length").collect()
    assert sorted((r.modality, str(r.acq), r.length) for r in parsed) == [("landsat", "2024-01-05", 1), ("s2", "2024-01-05", 1)]


def test_area_of_interest_is_one_polygon(spark, tmp_path):
    shape = lambda kind, ring: {"type": "Feature", "properties": {}, "geometry": {"type": kind, "coordinates": [ring]}}
    ring = [[0, 0], [4, 0], [4, 3], [0, 0]]
    for name, features in (("one", [shape("Polygon", ring)]), ("two", [shape("Polygon", ring)] * 2), ("line", [shape("MultiPolygon", [ring])]), ("none", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    assert files.area_of_interest(spark, str(tmp_path / "one.json")) == [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]
    for name in ("two", "line", "none"):
        with pytest.raises(ValueError, match="one polygon"):
            files.area_of_interest(spark, str(tmp_path / f"{name}.json"))


def test_manifest_requests_and_statistics_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "s2", "CLIP", 3.5, 7), ("p, 2", None, "SKIP_NO_OVERLAP", None, None)], files.MANIFEST_SCHEMA)
    files.write_manifest(rows, str(tmp_path / "m"))
    assert sorted(files.read_manifest(spark, str(tmp_path / "m")).collect(), key=str) == sorted(rows.collect(), key=str)
    (tmp_path / "r.csv").write_text("name,lat,lon,day\nhut,46.5,8.1,2024-02-03\n")
    assert files.point_requests(spark, str(tmp_path / "r.csv")).first()["day"].isoformat() == "2024-02-03"
    stats = spark.createDataFrame([("high", "b02", 5, 1.5, 0.25)], "tier string, band string, n long, mean double, std double")
    files.write_statistics(stats, str(tmp_path / "s"))
    assert files.read_statistics(spark, str(tmp_path / "s")).collect() == stats.collect()


def test_blocks_are_replaced_and_pruned(spark, tmp_path):
    path = str(tmp_path / "blocks")
    block = lambda rows: spark.createDataFrame(rows, "cell long, day string, modality string, value double").withColumn("day", F.to_date("day"))
    sinks.put_blocks(block([(1, "2024-01-01", "a", 1.0), (1, "2024-01-02", "a", 2.0)]), path)
    sinks.put_blocks(block([(1, "2024-01-02", "a", 5.0)]), path)
    assert [r["value"] for r in sinks.blocks_between(spark, path, "2024-01-01", "2024-01-05").orderBy("day").collect()] == [1.0, 5.0]
    window = sinks.blocks_between(spark, path, "2024-01-02", "2024-01-05")
    assert [r["value"] for r in window.collect()] == [5.0]
    assert "PartitionFilters: [isnotnull(day" in window._jdf.queryExecution().toString()


def test_samples_mosaics_and_results(spark, tmp_path):
    samples = spark.createDataFrame([(1, [1, 2], [3]), (2, [1], [3]), (3, None, [])], "id int, a array<int>, b array<int>")
    good, wrong = sinks.checked_samples(samples, {"a": 2, "b": 1})
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["wrong"] for r in wrong.collect()} == {2: ["a"], 3: ["a", "b"]}
    pixels = spark.createDataFrame([("d1", 0, 0, 0.5), ("d1", 0, 1, None), ("d2", 0, 0, 1.0)], "day string, row int, col int, value double")
    sinks.write_mosaic(pixels, str(tmp_path / "mosaic"), str(tmp_path / "coverage"), 2)
    assert {r["day"]: r["coverage"] for r in spark.read.parquet(str(tmp_path / "coverage")).collect()} == {"d1": 0.5, "d2": 0.5}
    total = sinks.with_overall(spark.createDataFrame([("s", 1.0)], "name string, rmse double"), "name", spark.createDataFrame([(2.0,)], "rmse double"))
    sinks.write_results(total, str(tmp_path / "results"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "results")).count() == 2


def test_metadata_without_its_parts_gives_nulls(spark):
    text = '{"LANDSAT_METADATA_FILE": {"LEVEL1_RADIOMETRIC_RESCALING": {"REFLECTANCE_MULT_BAND_3": "2.0E-5", "REFLECTANCE_ADD_BAND_3": "-0.1"}, "IMAGE_ATTRIBUTES": {"SUN_ELEVATION": "31.5"}}}'
    row = spark.range(1).select(names.mtl_radiometry(F.lit(text), 3).alias("r"), names.mtl_radiometry(F.lit("{}"), 3).alias("e"), names.mtl_footprint(F.lit(text)).alias("f")).first()
    assert tuple(row["r"]) == (2e-5, -0.1, 31.5) and tuple(row["e"]) == (None, None, None) and row["f"] is None


def test_clipped_area_equals_counted_points(spark):
    """Areas near the equator against the share of a fine grid's points in both polygons; either direction of the area."""
    area = [(0.0, 0.0), (6.0, 1.0), (5.0, 5.0), (1.0, 4.0)]
    rng = random.Random(4)
    rings = [[(rng.uniform(-2, 3), rng.uniform(-2, 2)), (rng.uniform(3, 8), rng.uniform(-2, 3)), (rng.uniform(0, 7), rng.uniform(3, 7))] for _ in range(4)]
    df = spark.createDataFrame([(i, ring) for i, ring in enumerate(rings)] + [(9, None), (10, [])], "id int, ring array<struct<lon: double, lat: double>>")
    for direction in (area, area[::-1]):
        got = {r["id"]: r["km2"] for r in clipping.clip_to_convex(df, "ring", direction).select("id", polygon_area_km2(F.col("ring")).alias("km2")).collect()}
        assert got[9] is None and got[10] == 0
        grid = spark.range(400 * 400).select((F.floor(F.col("id") / 400) / 40 - 2 + 0.0125).alias("x"), (F.col("id") % 400 / 40 - 2 + 0.0125).alias("y"))
        for i, ring in enumerate(rings):
            both = point_in_polygon(F.col("x"), F.col("y"), area) & point_in_polygon(F.col("x"), F.col("y"), ring)
            counted = grid.where(both).agg(F.coalesce(F.sum(F.cos(F.radians("y"))), F.lit(0.0)).alias("s")).first()["s"] * (0.025 * 111.195) ** 2
            assert abs(got[i] - counted) <= 0.01 * counted + 60
