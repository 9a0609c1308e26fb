"""Polygons of any shape against plain tests of every point and sums over thin strips."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import polygons as P


def star(rng, x, y, size, n):
    angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return [(x + size * (0.2 + rng.random()) * math.cos(a), y + size * (0.2 + rng.random()) * math.sin(a)) for a in angles]


def inside(px, py, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
                return True
            odd ^= (y1 > py) != (y2 > py) and px > (x2 - x1) * (py - y1) / (y2 - y1) + x1
    return odd


def frame(spark, shapes):
    rows = [(k, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in shapes.items()]
    return spark.createDataFrame(rows, f"polygon_id long, rings {P.RINGS}")


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(4)
    made = {k: [star(rng, rng.uniform(-8, 8), rng.uniform(-8, 8), rng.uniform(0.3, 4), rng.randint(3, 14))] for k in range(40)}
    made[40] = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]  # edges on the borders of tiles, a hole
    made[41] = [[(-20, -20), (20, -20), (20, 20), (-20, 20)]]  # many full tiles
    made[42] = [[(5, 5), (7, 5), (7, 5.5), (6, 5.25), (5, 5.5)], [(5.5, 7), (6.5, 7), (6, 8)]]  # two islands
    made[43] = [[(0, 0), (1, 1)]]  # no area
    return made


@pytest.mark.parametrize("size", [0.5, 2.0, 50.0])
def test_points_in_polygons(spark, shapes, size):
    rng = random.Random(5)
    places = [(rng.uniform(-10, 10), rng.uniform(-10, 10)) for _ in range(300)] + [(float(x), float(y)) for x in range(-1, 8) for y in range(-1, 8)] + [(20.0, 20.0), (6.0, 5.25), (2.0, 1.0)]
    rows = [(i, x, y) for i, (x, y) in enumerate(places)] + [(900, None, 1.0), (901, float("nan"), 1.0), (0, *places[0])]
    got = sorted(map(tuple, P.points_in_polygons(spark.createDataFrame(rows, "point_id long, x double, y double"), frame(spark, shapes), size).collect()))
    expected = sorted((i, k) for i, x, y in rows if x is not None and x == x for k, rings in shapes.items() if len(rings[0]) > 2 and inside(x, y, rings))
    assert got == expected


def test_only_crossed_tiles_are_looked_at(spark, shapes):
    index = P.tile_index(frame(spark, {41: shapes[41]}), 1.0)
    assert index.where("full").count() == 39 * 39 and index.where("not full").count() == 41 * 41 - 39 * 39


def test_boxes_meeting_polygons_and_split(spark, shapes):
    rng = random.Random(6)
    boxes = [(i, x := rng.uniform(-10, 10), y := rng.uniform(-10, 10), x + rng.uniform(0, 3), y + rng.uniform(0, 3)) for i in range(200)] + [(900, 1.2, 1.2, 2.8, 2.8), (901, -0.5, -0.5, 0.0, 0.0)]
    few = {k: v for k, v in shapes.items() if k in (*range(6), 40, 42)}
    df = spark.createDataFrame(boxes, "box_id long, min_x double, min_y double, max_x double, max_y double")

    def crosses(a, b, box):  # by cutting the edge down to the box
        low, high = 0.0, 1.0
        for i in (0, 1):
            d, lo, hi = b[i] - a[i], box[i] - a[i], box[i + 2] - a[i]
            if d == 0:
                if lo > 0 or hi < 0:
                    return False
            else:
                low, high = max(low, min(lo / d, hi / d)), min(high, max(lo / d, hi / d))
        return low <= high

    expected = sorted((i, k) for i, *box in boxes for k, rings in few.items() if inside(box[0], box[1], rings) or any(crosses(a, b, box) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]])))
    assert sorted(map(tuple, P.boxes_meeting_polygons(df, frame(spark, few), 1.0).collect())) == expected
    assert (900, 40) not in expected and (901, 40) in expected
    split = {r.box_id: r.part for r in P.region_split(df, frame(spark, few), 1.0).collect()}
    assert len(split) == len(boxes) and {i for i, p in split.items() if p == "test"} == {i for i, _ in expected}


def strips(a, b, n=200_000):
    """The overlap's area by the widths of thin strips."""
    ys = [y for rings in (a, b) for ring in rings for _, y in ring]
    y = np.linspace(min(ys), max(ys), n + 1)
    y = (y[1:] + y[:-1]) / 2

    def cuts(rings):
        found = []
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
                if y1 != y2:
                    found.append(np.where((y1 > y) != (y2 > y), x1 + (y - y1) * (x2 - x1) / (y2 - y1), np.inf))
        return np.sort(np.array(found), axis=0)

    ca, cb, width = cuts(a), cuts(b), np.zeros(n)
    for i in range(0, len(ca) - 1, 2):
        for j in range(0, len(cb) - 1, 2):
            low, high = np.maximum(ca[i], cb[j]), np.minimum(ca[i + 1], cb[j + 1])
            there = np.isfinite(low) & np.isfinite(high)
            width[there] += np.maximum(high[there] - low[there], 0)
    return float(width.sum() * (max(ys) - min(ys)) / n)


def test_overlaps_of_concave_polygons_with_holes(spark, shapes):
    pairs = [(40, 42), (40, 0), (40, 1), (0, 1), (2, 3), (4, 5), (41, 40), (6, 7), (8, 9), (41, 10), (40, 43), (42, 42)]
    rows = [(i, [[(float(x), float(y)) for x, y in r] for r in shapes[a]], [[(float(x), float(y)) for x, y in r] for r in shapes[b]]) for i, (a, b) in enumerate(pairs)] + [(99, None, None)]
    found = P.overlaps(spark.createDataFrame(rows, f"k long, a {P.RINGS}, b {P.RINGS}"), "a", "b", ["k"])
    plane = lambda ring: F.abs(G._around(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2
    got = {r.k: r.area for r in found.select("k", F.aggregate(F.transform("parts", plane), F.lit(0.0), lambda t, v: t + v).alias("area")).collect()}
    for i, (a, b) in enumerate(pairs):
        if a != b:  # strips are off by one where an edge is level
            assert abs(got[i] - strips(shapes[a], shapes[b])) < 1e-6 * (1 + got[i]), pairs[i]
    assert got[99] == 0 and got[6] == pytest.approx(12) and got[10] == 0 and got[11] == pytest.approx(1.25, rel=1e-12)


def test_areas_on_the_ellipsoid(spark):
    whole = spark.range(1).select(G.ellipsoid_box_km2(F.lit(-180.0), F.lit(-90.0), F.lit(180.0), F.lit(90.0))).first()[0]
    assert abs(whole - 510_065_621.724) < 1  # the surface of WGS84, km2
    for south, north, west, east in ((50.9, 51.1, -116.0, -115.5), (0.0, 1.0, 10.0, 11.0), (-60.0, -58.0, 0.0, 3.0)):
        n = 500
        ring = [(west + (east - west) * i / n, south) for i in range(n + 1)] + [(east - (east - west) * i / n, north) for i in range(n + 1)]
        df = spark.createDataFrame([([(x, y) for x, y in ring], [(west, south), (east, south), (east, north), (west, north)])], "r array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>")
        closed, geodesic, mapped, coarse = df.select(G.ellipsoid_box_km2(F.lit(west), F.lit(south), F.lit(east), F.lit(north)), G.geodesic_area_km2(F.col("r")), G.ellipsoid_area_km2(F.col("q")), G.geodesic_area_km2(F.col("q"))).first()
        assert abs(geodesic / closed - 1) < 1e-7 and abs(mapped / closed - 1) < 1e-10
        assert abs(coarse / closed - 1) < 1e-3  # great circles leave the parallels by little
    over = spark.createDataFrame([([(179.5, 0.0), (-179.5, 0.0), (-179.5, 1.0), (179.5, 1.0)],)], "r array<struct<x:double,y:double>>")
    assert abs(over.select(G.geodesic_area_km2(F.col("r"))).first()[0] / 12308.8 - 1) < 1e-3
