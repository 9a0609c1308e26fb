"""Every registered raster query against its SQL at the smallest scale, and golden cases."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.operators import series
from gridloom.operators.aggregates import lower_median
from gridloom.plans import adapters, archive, facts, stored  # noqa: F401
from gridloom.plans.queries import ORACLE_SQL, QUERIES
from gridloom.sources import names

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "none" if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "is_finite") or isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6g}"
    return "none" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    assert rows == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


def test_forward_fill_golden(spark):
    rows = [(0, 0, 3.0), (0, 1, None), (1, 0, 8.0), (1, 1, 10.0), (2, 0, None), (2, 1, None), (3, 0, 7.0), (3, 1, None)]
    got = series.forward_fill(spark.createDataFrame(rows, "p int, t int, v double"), ["p"], "t", "v").orderBy("p", "t").collect()
    assert [(r.filled, r.age) for r in got] == [(3, 0), (3, 1), (8, 0), (10, 0), (None, -1), (None, -1), (7, 0), (7, 1)]


def test_lower_median_golden(spark):
    assert spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double").agg(lower_median("v")).first()[0] == 1.0


def test_aspect_of_a_plane(spark):
    df = spark.createDataFrame([(y, x, 10.0 * x) for y in range(3) for x in range(3)], "y int, x int, z double")
    centre = series.slope_aspect(df, [], "z", 10.0, 10.0).where("y = 1 and x = 1").first()
    assert round(centre.slope, 6) == 45.0 and round(centre.aspect, 6) == 270.0


def test_names(spark):
    df = spark.createDataFrame([("LC08_L1TP_042024_20240105_20240113_02_T1", "S2A_MSIL1C_20240105T184731_N0510_R070_T11UPS_20240105T202515.SAFE", "50,-116 51,-116 51,-115 50,-116", "odd")], "l string, s string, g string, o string")
    row = df.select(names.landsat_name(F.col("l")).alias("l"), names.sentinel2_name(F.col("s")).alias("s"), names.gml_footprint(F.col("g")).alias("g"), names.gml_footprint(F.col("o")).alias("n"), names.landsat_name(F.col("o")).alias("x")).first()
    assert (row.l.path, row.l.row, str(row.l.acq)) == ("042", "024", "2024-01-05")
    assert (row.s.baseline, row.s.tile) == (5.1, "T11UPS") and len(row.g) == 4 and row.g[0].lon == -116 and row.n is None and row.x.acq is None


def test_zero_spread_is_an_error(spark):
    with pytest.raises(Exception, match="spread is zero"):
        spark.range(1).select(C.two_sigma(F.lit(1.0), F.lit(1.0), F.lit(0.0))).collect()
