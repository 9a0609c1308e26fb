"""Sources on lattices: the golden cases of products, two zones without holes, terrain over the edges of tiles."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import lattices as L
from gridloom.operators import stencils

DAY = datetime.date(2024, 1, 5)
L9, L8 = "LC09_L1TP_042024_20240105_20240113_02_T1.tar", "LC08_L1TP_042024_20240105_20240113_02_T1.tar"
ASSET = "name string, band string, zone int, size double, left double, top double, rows int, cols int, mult double, add double, sun_elevation double, baseline double"
READING = "name string, band string, row int, col int, dn double, opaque int, cirrus int"
CELL = "cell long, zone int, size double, left double, top double, rows int, cols int"


def asset(name, band="b", zone=11, size=30.0, left=600000.0, top=5700000.0, rows=2, cols=2, baseline=None):
    return (name, band, zone, size, left, top, rows, cols, 1.0, 0.0, 90.0, baseline)


def run(spark, source, assets, readings, bands=("b",), days=(DAY,), cells=((1, 11, 30.0, 600000.0, 5700000.0, 2, 2),)):
    """Readings are (name, band, [[dn, ...], ...]) or with dn as (dn, opaque, cirrus); gives {(cell, day, band): rows of values}."""
    rows = []
    for name, band, grid in readings:
        for i, line in enumerate(grid):
            rows += [(name, band, i, j, *((float(v[0]), *v[1:]) if isinstance(v, tuple) else (float(v), 0, 0))) for j, v in enumerate(line)]
    source = L.SOURCES[source] if isinstance(source, str) else source
    tables = spark.createDataFrame(assets, ASSET), spark.createDataFrame(rows, READING), spark.createDataFrame(list(cells), CELL)
    found = L.fetch(source, *tables, list(bands), spark.createDataFrame([(d,) for d in days], "day date"))
    out = {}
    for r in found.collect():
        out.setdefault((r.cell, getattr(r, "day", None), r.band), {})[r.y, r.x] = r.value
    return {k: [[v[y, x] for x in range(1 + max(c for _, c in v))] for y in range(1 + max(a for a, _ in v))] for k, v in out.items()}


def test_the_newer_sensor_takes_the_whole_day(spark):
    both = run(spark, "landsat", [asset(L9), asset(L8)], [(L9, "b", [[0.0, 0.5], [0.5, 0.5]]), (L8, "b", [[0.7, 0.7], [0.7, 0.7]])])
    assert both[1, DAY, "b"] == [[None, 0.5], [0.5, 0.5]]
    assert run(spark, "landsat", [asset(L8)], [(L8, "b", [[0.7] * 2] * 2)])[1, DAY, "b"] == [[0.7] * 2] * 2


def test_products_of_one_tile_fill_each_other_and_the_newer_wins(spark):
    old, new = L8, L8.replace("20240113", "20240120")
    got = run(spark, "landsat", [asset(old), asset(new)], [(old, "b", [[0.1, 0.2], [0.3, 0.0]]), (new, "b", [[0.0, 0.6], [0.7, 0.0]])])
    assert got[1, DAY, "b"] == [[0.1, 0.6], [0.7, None]]
    flags = run(spark, "landsat_qa", [asset(old), asset(new)], [(old, "b", [[1, 2], [3, 4]]), (new, "b", [[5, 0], [6, 7]])])
    assert flags[1, DAY, "b"] == [[5, 0], [6, 7]]  # of flags the newer product counts as a whole


def test_one_band_without_products_leaves_no_band(spark):
    got = run(spark, "landsat", [asset(L8)], [(L8, "b", [[0.5] * 2] * 2)], bands=("b", "c"))
    assert got[1, DAY, "b"] == got[1, DAY, "c"] == [[None] * 2] * 2
    name = "field_20240105_1"
    assert run(spark, "era5", [asset(name)], [(name, "b", [[0.5] * 2] * 2)], bands=("b", "c"))[1, DAY, "b"] == [[0.5] * 2] * 2


def test_baselines(spark):
    late, early = (f"S2A_MSIL1C_20240105T184731_N{n}_R070_T11UPS_20240105T202515.SAFE" for n in ("0511", "0301"))
    assert run(spark, "sentinel2", [asset(late)], [(late, "b", [[5000.0, 0.0]])])[1, DAY, "b"][0] == [4000, None]
    assert run(spark, "sentinel2", [asset(early)], [(early, "b", [[5000.0, 0.0]])])[1, DAY, "b"][0] == [5000, None]
    assert run(spark, "sentinel2", [asset(late, baseline=3.01)], [(late, "b", [[5000.0]])])[1, DAY, "b"][0][0] == 5000  # the manifest's goes first
    flags = run(spark, "sentinel2_qa", [asset(late)], [(late, "b", [[(0, 1, 1), (0, 0, 1)], [(0, 0, 0), (0, 2, 0)]])])
    assert flags[1, DAY, "b"] == [[1024, 2048], [0, 1024]]


def test_backscatter_and_granules_of_unlike_footprints(spark):
    a, b = (f"S1A_IW_GRDH_1SDV_20240105T013722_20240105T013747_058587_07406B_{u}.SAFE" for u in ("0A00", "0B00"))
    got = run(spark, "sentinel1", [asset(a)], [(a, "b", [[10**-3.001, 10**-2.999], [1.0, 1.0]])])[1, DAY, "b"]
    assert got[0][0] is None and abs(got[0][1] + 29.99) < 1e-9
    wide = [asset(a, cols=4), asset(b)]
    got = run(spark, "sentinel1", wide, [(a, "b", [[1.0] * 4] * 2), (b, "b", [[10.0, 10.0], [0.0, 0.0]])], cells=[(1, 11, 30.0, 600000.0, 5700000.0, 2, 4)])
    assert got[1, DAY, "b"] == [[10.0, 10.0, 0.0, 0.0], [0.0] * 4]  # the greater number goes first, the other fills


def test_backscatter_between_pixels_goes_by_the_valid_ones(spark):
    a = "S1A_IW_GRDH_1SDV_20240105T013722_20240105T013747_058587_07406B_0A00.SAFE"
    cell = [(1, 11, 30.0, 600015.0, 5699985.0, 1, 1)]  # its centre is the corner of four pixels
    assert run(spark, "sentinel1", [asset(a, "angle")], [(a, "angle", [[30.0, 40.0], [50.0, 60.0]])], bands=("angle",), cells=cell)[1, DAY, "angle"] == [[45.0]]
    got = run(spark, "sentinel1", [asset(a)], [(a, "b", [[1.0, 100.0], [0.0, 0.0]])], cells=cell)
    assert got[1, DAY, "b"] == [[10.0]]


def test_sums_are_stamped_with_the_next_day(spark):
    last, name = datetime.date(2024, 1, 31), "field_20240201_1"
    got = run(spark, "era5", [asset(name, "total_precipitation_sum"), asset(name, "t")], [(name, "total_precipitation_sum", [[2.0]]), (name, "t", [[9.0]])], bands=("total_precipitation_sum", "t"), days=(last, datetime.date(2024, 2, 1)))
    assert got[1, last, "total_precipitation_sum"][0][0] == 2.0 and got[1, last, "t"][0][0] is None
    assert got[1, datetime.date(2024, 2, 1), "t"][0][0] == 9.0


def test_fills_stay_where_products_are(spark):
    name = "MOD09GA.A2024005.h10v03"
    got = run(spark, "modis", [asset(name)], [(name, "b", [[-28672.0, 5.0]])], days=(DAY, datetime.date(2024, 1, 6)))
    assert got[1, DAY, "b"] == [[-28672.0, 5.0], [None, None]] and got[1, datetime.date(2024, 1, 6), "b"] == [[None] * 2] * 2
    assert run(spark, "viirs", [asset(name)], [(name, "b", [[-28672.0, 5000.0]])])[1, DAY, "b"][0] == [-28672.0, 0.5]


def test_no_product_and_cells_elsewhere(spark):
    assert run(spark, "landsat", [asset("else")], [])[1, DAY, "b"] == [[None] * 2] * 2
    far = [(1, 11, 30.0, 600000.0, 5700000.0, 2, 2), (2, 11, 30.0, 400000.0, 5200000.0, 2, 2), (3, 11, 30.0, 600030.0, 5699970.0, 2, 2)]
    got = run(spark, "landsat", [asset(L8)], [(L8, "b", [[0.1, 0.2], [0.3, 0.4]])], cells=far)
    assert got[2, DAY, "b"] == [[None] * 2] * 2 and got[3, DAY, "b"] == [[0.4, None], [None, None]]


def utm(lon, lat, zone):
    """Plain transverse Mercator by the same series, in floats."""
    n, e = G._N, 2 * G._N**0.5 / (1 + G._N)
    s, d = math.sin(math.radians(lat)), math.radians(lon - (zone * 6 - 183))
    t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
    xi, eta = math.atan2(t, math.cos(d)), math.atanh(math.sin(d) / math.hypot(1, t))
    x = eta + sum(a * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, a in enumerate(G._FORWARD, 1))
    y = xi + sum(a * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, a in enumerate(G._FORWARD, 1))
    return 500000 + G._RADIUS * x, G._RADIUS * y


def test_two_zones_leave_no_holes(spark):
    east, north = utm(-114.0, 51.0, 11)
    left, top = math.floor(east / 30) * 30.0, math.ceil(north / 30) * 30.0
    other = utm(-114.0, 51.0, 12)
    far_left, far_top = math.floor(other[0] / 30) * 30.0 - 900, math.ceil(other[1] / 30) * 30.0 + 900
    a, b = L8, L8.replace("042024", "041024")
    assets = [asset(a, left=left, top=top, rows=4, cols=4), asset(b, zone=12, left=far_left, top=far_top, rows=80, cols=80)]
    grid = [[i * 100.0 + j + 1 for j in range(80)] for i in range(80)]
    cell = [(1, 11, 10.0, left - 20, top + 20, 16, 16)]
    got = run(spark, "landsat", assets, [(a, "b", [[0.25] * 4] * 4), (b, "b", grid)], cells=cell)[1, DAY, "b"]
    for y in range(16):
        for x in range(16):
            e, n = left - 20 + (x + 0.5) * 10, top + 20 - (y + 0.5) * 10
            if left < e < left + 120 and top - 120 < n < top:
                assert got[y][x] == 0.25
            else:
                lon, lat = _inverse(e, n)
                e2, n2 = utm(lon, lat, 12)
                assert got[y][x] == grid[math.floor((far_top - n2) / 30)][math.floor((e2 - far_left) / 30)]


def _inverse(e, n):
    """The place in zone 11 whose projection is (e, n), by steps of the forward series."""
    lon, lat = -114.0, 51.0
    for _ in range(50):
        x, y = utm(lon, lat, 11)
        lat += (n - y) / 111_000
        lon += (e - x) / (111_000 * math.cos(math.radians(lat)))
    return lon, lat


@pytest.mark.parametrize("block", [3, 4, 256])
def test_gradients_over_blocks_equal_those_of_the_whole(spark, block):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(11, 9)) * 100
    rows = [("k", i - 5, j - 4, float(z[i, j])) for i in range(11) for j in range(9)]
    df = spark.createDataFrame(rows, "k string, gy long, gx long, z double").repartition(5)
    got = {(r.gy + 5, r.gx + 4): (r.east, r.south, r.z) for r in stencils.gradients(df, ["k"], "z", block).collect()}
    p = np.pad(z, 1, mode="edge")
    part = lambda a, b: p[1 + a : 12 + a, 1 + b : 10 + b]
    east = sum((2 - abs(a)) * (part(a, 1) - part(a, -1)) for a in (-1, 0, 1)) / 8
    south = sum((2 - abs(b)) * (part(1, b) - part(-1, b)) for b in (-1, 0, 1)) / 8
    assert len(got) == 99
    for (i, j), (e, s, v) in got.items():
        assert abs(e - east[i, j]) < 1e-9 and abs(s - south[i, j]) < 1e-9 and v == z[i, j]


def test_level_ground_faces_west(spark):
    slope, aspect = stencils.slope_and_aspect(F.lit(0.0), F.lit(0.0), 30.0, 30.0)
    assert tuple(spark.range(1).select(slope, aspect).first()) == (0.0, 270.0)


def test_terrain_knows_the_next_tile(spark):
    size = 0.01
    assets = [asset("a", "z", 0, size, -114.0, 51.0, 4, 4), asset("b", "z", 0, size, -113.96, 51.0, 4, 4)]
    height = lambda i, j: 100.0 + 7 * i + 3 * j * j
    rows = [(n, "z", i, j, height(i, j + k), 0, 0) for n, k in (("a", 0), ("b", 4)) for i in range(4) for j in range(4)]
    cell = [(1, 0, size, -114.0, 51.0, 4, 8)]
    found = L.fetch_terrain(spark.createDataFrame(assets, ASSET), spark.createDataFrame(rows, READING), spark.createDataFrame(cell, CELL), 1.0)
    got = {(r.band, r.y, r.x): r.value for r in found.collect()}
    metre = 2 * math.pi * 6378137 / 360
    for x in (3, 4):  # on either side of the tiles' edge
        dx = 3 * ((x + 1) ** 2 - (x - 1) ** 2) / 2 / (size * metre * math.cos(math.radians(51 - 1.5 * size)))
        dy = 7 / (size * metre)
        assert abs(got["slope", 1, x] - math.degrees(math.atan(math.hypot(dx, dy)))) < 1e-9
        assert abs(got["aspect", 1, x] - (450 - math.degrees(math.atan2(dy, -dx))) % 360) < 1e-6
    assert got["DEM", 1, 4] == height(1, 4) and len(got) == 96
    void = L.fetch_terrain(spark.createDataFrame(assets, ASSET), spark.createDataFrame(rows, READING), spark.createDataFrame(cell, CELL), 110.0)
    assert {r.value for r in void.where("y = 0 and x < 2").collect()} == {None}
