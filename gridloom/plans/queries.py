"""Registered queries of the raster operators over the given tables, with their SQL.

Roles: events are observations (cell, band, day, value), lineitem a pixel grid (cell, t, y,
x, value; a cell for each supplier, so it grows with the table), orders scenes with dates and priorities, accounts positions on the globe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import bands as B
from gridloom.functions import columns as C
from gridloom.operators import aggregates as A
from gridloom.operators import joins as J
from gridloom.operators import knn
from gridloom.operators import series as W
from gridloom.sources import names as N
from gridloom.streaming import forms
from gridloom.sources.catalogue import catalogue_extents, catalogue_items

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OBS = """obs AS (SELECT cell, band, day, t, CASE WHEN v >= 5 THEN v END AS value FROM (
  SELECT user_id AS cell, event_type AS band, CAST(ts AS DATE) AS day, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, arg_max(value, event_id) AS v
  FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)))"""
PX = """px AS (SELECT l_suppkey AS cell, l_linenumber AS t, l_partkey % 10 AS y, l_orderkey % 10 AS x, max(CASE WHEN l_tax < 0.07 THEN l_extendedprice END) AS value FROM lineitem GROUP BY ALL)"""
SCENES = """scenes AS (SELECT o_orderkey AS scene, o_custkey % 50 AS tile, CAST(o_orderdate AS DATE) AS day, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value FROM orders)"""
POINTS = """points AS (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal / 100 - 45 AS lat, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon FROM customer)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("band"), day.alias("day")).agg(F.max_by("value", "event_id").alias("v"))
    return last.select("cell", "band", "day", F.datediff("day", F.lit("2024-01-01")).alias("t"), F.when(F.col("v") >= 5, F.col("v")).alias("value"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("t"), (F.col("l_partkey") % 10).alias("y"), (F.col("l_orderkey") % 10).alias("x")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max(F.when(F.col("l_tax") < 0.07, F.col("l_extendedprice"))).alias("value"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("scene"), (F.col("o_custkey") % 50).alias("tile"), F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") / 100 - 45).alias("lat"), ((F.col("c_custkey") * 37 % 3600) / F.lit(10.0) - 180).alias("lon"))


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r(column: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


@query(f"""WITH {OBS}, stats AS (SELECT band, avg(value) AS mean, stddev_samp(value) AS std FROM obs GROUP BY band),
normal AS (SELECT cell, o.band, t, (value - (mean - 2 * std)) / (4 * std) AS v FROM obs o JOIN stats s ON o.band = s.band),
carried AS (SELECT cell, band, v, last_value(v IGNORE NULLS) OVER w AS filled, coalesce(t - last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER w, -1) AS age
  FROM normal WINDOW w AS (PARTITION BY cell, band ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT cell, band, round(avg(filled), 4) AS mean_value, round(avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS share_valid, round(avg(age), 4) AS mean_age FROM carried GROUP BY cell, band""")
def minimum_slice(spark, sf_dir):
    obs = observations(spark, sf_dir)
    stats = A.band_statistics(obs, ["band"], "value")
    normal = obs.join(F.broadcast(stats), "band").withColumn("v", C.two_sigma(F.col("value"), F.col("mean"), F.col("std")))
    carried = W.forward_fill(normal, ["cell", "band"], "t", "v")
    return carried.groupBy("cell", "band").agg(r(F.avg("filled")).alias("mean_value"), r(F.avg(F.col("v").isNotNull().cast("double"))).alias("share_valid"), r(F.avg("age")).alias("mean_age"))


@query(f"""WITH {SCENES} SELECT scene, CASE WHEN priority < 5 THEN 'LC0' || (8 + scene % 2) END AS sensor, CASE WHEN priority < 5 THEN printf('%03d', tile) END AS path, CASE WHEN priority < 5 THEN '024' END AS "row",
CASE WHEN priority < 5 THEN day END AS acq, CASE WHEN priority < 5 THEN day + 8 END AS proc FROM scenes""")
def s02_scene_names(spark, sf_dir):
    """Names of another tier are no scenes."""
    tier = F.when(F.col("priority") < 5, "_02_T1.tar").otherwise("_02_T2.tar")
    name = F.concat(F.lit("LC0"), (8 + F.col("scene") % 2).cast("string"), F.lit("_L1TP_"), F.lpad(F.col("tile").cast("string"), 3, "0"), F.lit("024_"), F.date_format("day", "yyyyMMdd"), F.lit("_"), F.date_format(F.date_add("day", 8), "yyyyMMdd"), tier)
    return scenes(spark, sf_dir).select("scene", N.landsat_name(name).alias("n")).select("scene", "n.*")


@query(f"""WITH {SCENES} SELECT scene, strftime(day, 'A%Y%j') AS name, day AS parsed FROM scenes""")
def s05_julian_names(spark, sf_dir):
    s = scenes(spark, sf_dir).withColumn("name", F.concat(F.lit("A"), F.date_format("day", "yyyyDDD")))
    return s.select("scene", "name", N.julian_date(F.col("name")).alias("parsed"))


@query(f"""WITH {POINTS} SELECT id, printf('PR_20240105_%.4f_%.4f_SC%02d.tif', lat, lon, nation) AS name, DATE '2024-01-05' AS day, round(lat, 4) AS lat, nation AS cell FROM points""")
def s06_cube_names(spark, sf_dir):
    p = points(spark, sf_dir).select("id", N.cube_name(F.lit("2024-01-05").cast("date"), F.col("lat"), F.col("lon"), F.col("nation")).alias("name"))
    return p.select("id", "name", N.parse_cube_name(F.col("name")).alias("n")).select("id", "name", "n.day", r("n.lat").alias("lat"), "n.cell")


@query(f"""WITH {POINTS} SELECT id, printf('min_lat=%.4f_min_lon=%.4f_max_lat=%.4f_max_lon=%.4f_dates=2024-03', lat - 1, lon - 1, lat + 1, lon + 1) AS name, round(lat, 4) AS lat, round(lon, 4) AS lon, 2 AS month,
printf('min_lat=%.4f_min_lon=%.4f_max_lat=%.4f_max_lon=%.4f', lat - 1, lon - 1, lat + 1, lon + 1) AS place FROM points""")
def s07_box_identifiers(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    named = points(spark, sf_dir).select("id", F.concat(N.box_identifier(lat - 1, lon - 1, lat + 1, lon + 1), F.lit("_dates=2024-03")).alias("name"))
    a, o = N.identifier_centre(F.col("name"))
    return named.select("id", "name", r(a).alias("lat"), r(o).alias("lon"), N.month_index(F.col("name")).alias("month"), N.location_season(F.col("name")).alias("place"))


@query("""SELECT p_partkey, CASE WHEN p_size <> 7 THEN CAST(printf('%.5f', p_size / 100000.0) AS DOUBLE) END AS mult, CAST(printf('%.3f', -p_size / 1000.0) AS DOUBLE) AS add, CAST(printf('%.2f', (10 + p_partkey % 70)::DOUBLE) AS DOUBLE) AS sun_elevation FROM part""")
def s12_scene_metadata(spark, sf_dir):
    size = F.col("p_size")
    factor = F.when(size != 7, F.format_string('"REFLECTANCE_MULT_BAND_3": "%.5f", ', size / F.lit(100000.0))).otherwise("")
    text = F.format_string('{"LANDSAT_METADATA_FILE": {"LEVEL1_RADIOMETRIC_RESCALING": {%s"REFLECTANCE_ADD_BAND_3": "%.3f"}, "IMAGE_ATTRIBUTES": {"SUN_ELEVATION": "%.2f"}}}', factor, -size / F.lit(1000.0), (10 + F.col("p_partkey") % 70).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", N.mtl_radiometry(text, 3).alias("m")).select("p_partkey", "m.*")


@query(f"""WITH {SCENES}, {POINTS}, i AS (SELECT 'L' || priority AS collection, scene, day, lon, lat FROM scenes JOIN points ON id = tile + 1) SELECT collection, min(lon) AS min_lon, min(lat) AS min_lat, max(lon + 2) AS max_lon, max(lat + 1) AS max_lat, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM i GROUP BY collection""")
def s14_catalogue_extents(spark, sf_dir):
    placed = scenes(spark, sf_dir).join(points(spark, sf_dir).select((F.col("id") - 1).alias("tile"), "lon", "lat"), "tile")
    box = F.struct(F.col("lon").alias("min_lon"), F.col("lat").alias("min_lat"), (F.col("lon") + 2).alias("max_lon"), (F.col("lat") + 1).alias("max_lat"))
    items = catalogue_items(placed, F.concat(F.lit("L"), F.col("priority").cast("string")), F.col("scene").cast("string"), box, F.col("day"), F.concat(F.col("scene").cast("string"), F.lit(".tar")))
    return catalogue_extents(items)


@query("""SELECT p_partkey, CASE WHEN p_size <> 7 THEN p_size * 0.01 + 0.5 END AS decoded, CASE WHEN p_size = 7 THEN p_size ELSE p_size * 0.25 END AS kept FROM part""")
def s24_decode_and_scale(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", C.decode_scaled(size, 7, 0.01, 0.5).alias("decoded"), C.scaled_keeping_fill(size.cast("double"), 0.25, 7).alias("kept"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_quantity <> 0 AND (l_quantity * 0.00002 - 0.0001) / sin(radians(10 + l_linenumber * 10)) >= 1e-7 THEN (l_quantity * 0.00002 - 0.0001) / sin(radians(10 + l_linenumber * 10)) END, 8) AS toa,
CASE WHEN l_quantity <> 0 AND (CASE WHEN l_linenumber >= 4 THEN l_extendedprice - 1000 ELSE l_extendedprice END) >= -1 THEN CASE WHEN l_linenumber >= 4 THEN l_extendedprice - 1000 ELSE l_extendedprice END END AS dn,
round(CASE WHEN l_discount > 0 AND 10 * log10(l_discount) >= -15 THEN 10 * log10(l_discount) END, 6) AS db FROM lineitem""")
def p01_calibration(spark, sf_dir):
    q, price, line = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber")
    dn = F.when(q != 0, C.harmonized_dn(price, line))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(C.toa_reflectance(q, F.lit(0.00002), F.lit(-0.0001), 10 + line * 10), 8).alias("toa"), dn.alias("dn"), r(C.decibels(F.col("l_discount"), -15), 6).alias("db"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 1024 WHEN p_size > 30 THEN 2048 ELSE 0 END AS packed, (p_partkey >> 2) & 3 AS two_bits, (p_partkey >> 4) & 1 AS bit FROM part""")
def p05_bits(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", C.pack_cloud_bits(size > 40, size > 30).alias("packed"), C.bits(key, 2, 2).alias("two_bits"), C.bits(key, 4).alias("bit"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN l_discount + l_tax > 0 THEN (l_discount - l_tax) / (l_discount + l_tax) END, 6) AS ndi,
round(CASE WHEN l_quantity <= 25 AND l_discount + l_tax > 0 THEN (l_discount - l_tax) / (l_discount + l_tax) END, 6) AS clear_ndi FROM lineitem""")
def p07_normalized_difference(spark, sf_dir):
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r(C.normalized_difference(a, b), 6).alias("ndi"), r(C.normalized_difference(a, b, F.col("l_quantity") - 25), 6).alias("clear_ndi"))


@query("""SELECT code, n, [CAST(code = 10 AS INTEGER), CAST(code = 20 AS INTEGER), CAST(code = 30 AS INTEGER), CAST(code = 40 AS INTEGER), CAST(code = 50 AS INTEGER)] AS channels
FROM (SELECT p_size AS code, count(*) AS n FROM part WHERE p_size IN (10, 20, 30, 40, 50) GROUP BY 1)
UNION ALL SELECT NULL, count(*), NULL FROM part WHERE p_size NOT IN (10, 20, 30, 40, 50)""")
def p09_one_hot(spark, sf_dir):
    hot = C.one_hot(F.col("p_size"), (10, 20, 30, 40, 50))
    rows = table(spark, sf_dir, "part").select(F.when(hot.isNotNull(), F.col("p_size")).alias("code"), hot.alias("channels"))
    return rows.groupBy("code", "channels").agg(F.count(F.lit(1)).alias("n"))


_BANDED = """banded AS (SELECT l_partkey % 54 AS position, CASE WHEN l_tax < 0.07 THEN l_extendedprice / 100 - 400 ELSE -9999 END AS value FROM lineitem),
judged AS (SELECT position, value, coalesce(value <> -9999 AND value >= CASE WHEN position < 2 THEN -50 WHEN position = 2 THEN 0 WHEN position < 9 THEN -1 WHEN position < 15 THEN 0.0000001 WHEN position < 17 THEN -1 WHEN position < 24 THEN -100
  WHEN position < 26 THEN -0.01 WHEN position < 28 THEN -1 WHEN position = 28 THEN 0.0000001 WHEN position < 42 THEN 0 WHEN position < 46 THEN -0.01 WHEN position < 48 THEN 184 WHEN position = 48 THEN -1 WHEN position < 51 THEN -53 ELSE -1 END, false) AS valid FROM banded)"""


def _banded(spark, sf_dir) -> DataFrame:
    """Line items as readings of the registry's bands: (position, band, value, valid)."""
    value = F.when(F.col("l_tax") < 0.07, F.col("l_extendedprice") / 100 - 400).otherwise(B.NODATA)
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 54).cast("int").alias("position"), value.alias("value"))
    return rows.join(F.broadcast(B.registry(spark)), "position").withColumn("valid", B.is_valid(F.col("value"), F.col("least")))


@query(f"""WITH {_BANDED} SELECT position::INTEGER AS position, count(*) AS n, count_if(valid) AS n_valid FROM judged GROUP BY position""")
def p10_validity_mask(spark, sf_dir):
    return _banded(spark, sf_dir).groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"))


@query(f"""WITH {_BANDED}, stats AS (SELECT position, avg(value) AS mean, stddev_samp(value) AS std FROM judged WHERE valid GROUP BY position),
n AS (SELECT position, CASE WHEN NOT valid THEN -9999 WHEN position IN (26, 27) OR position BETWEEN 31 AND 41 OR position >= 51 THEN value ELSE (value - (mean - 2 * std)) / (4 * std) END AS v FROM judged JOIN stats USING (position))
SELECT position::INTEGER AS position, round(min(CASE WHEN v <> -9999 THEN v END), 4) AS low, round(max(v), 4) AS high, count_if(v = -9999) AS n_fill FROM n GROUP BY position""")
def p12_normalization(spark, sf_dir):
    rows = _banded(spark, sf_dir)
    stats = A.band_statistics(rows.where("valid"), ["position"], "value").drop("n")
    value = B.normalized(F.col("value"), F.col("valid"), F.col("band"), F.col("mean"), F.col("std"))
    kept = rows.join(stats, "position").select("position", value.alias("v"))
    return kept.groupBy("position").agg(r(F.min(F.when(F.col("v") != B.NODATA, F.col("v")))).alias("low"), r(F.max("v")).alias("high"), F.count_if(F.col("v") == B.NODATA).alias("n_fill"))


@query(f"""WITH {POINTS} SELECT id, round(cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) AS y, round(sin(radians(lat)), 6) AS z FROM points""")
def p11_unit_sphere(spark, sf_dir):
    return points(spark, sf_dir).select("id", C.unit_sphere(F.col("lat"), F.col("lon")).alias("s")).select("id", r("s.x", 6).alias("x"), r("s.y", 6).alias("y"), r("s.z", 6).alias("z"))


_LAT = "(111132.954 - 559.822 * cos(2 * radians(lat)) + 1.175 * cos(4 * radians(lat)) - 0.0023 * cos(6 * radians(lat)))"
_LON = "(111412.84 * cos(radians(lat)) - 93.5 * cos(3 * radians(lat)) + 0.118 * cos(5 * radians(lat)))"


@query(f"""WITH {POINTS} SELECT id, round(lat - 5000 / {_LAT}, 6) AS min_lat, round(lat + 5000 / {_LAT}, 6) AS max_lat, round(lon - 5000 / {_LON}, 6) AS min_lon, round(lon + 5000 / {_LON}, 6) AS max_lon FROM points""")
def p13_box_around(spark, sf_dir):
    box = points(spark, sf_dir).select("id", C.box_around(F.col("lat"), F.col("lon"), 5000).alias("b"))
    return box.select("id", *[r(f"b.{c}", 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query(f"""WITH {POINTS} SELECT id, CAST(floor((60 - lat) / 0.5) AS BIGINT) AS row, CAST(floor((lon + 180) / 0.5) AS BIGINT) AS col, round(-180 + (floor((lon + 180) / 0.5) + 0.5) * 0.5, 6) AS x,
CASE WHEN greatest(floor((lon + 170) / 0.5) - 4, 0) < least(ceil((lon + 1 + 170) / 0.5) + 4, 10000) THEN CAST(greatest(floor((lon + 170) / 0.5) - 4, 0) AS BIGINT) END AS first, lat BETWEEN -10 AND 30 AND lon BETWEEN 0 AND 90 AS inside FROM points""")
def p17_pixels_and_windows(spark, sf_dir):
    half = F.lit(0.5)
    rows = points(spark, sf_dir).withColumn("p", C.pixel_of(F.col("lon"), F.col("lat"), F.lit(-180), F.lit(60), half))
    window = C.read_window(F.col("lon"), F.col("lon") + 1, F.lit(-170), half, F.lit(10_000))
    box = F.struct(F.lit(0).alias("min_lon"), F.lit(-10).alias("min_lat"), F.lit(90).alias("max_lon"), F.lit(30).alias("max_lat"))
    return rows.select("id", "p.row", "p.col", r(C.world_of(F.col("p.row"), F.col("p.col"), F.lit(-180), F.lit(60), half)["x"], 6).alias("x"), window["first"].alias("first"), C.in_box(F.col("lon"), F.col("lat"), box).alias("inside"))


@query(f"""WITH {SCENES} SELECT season, count(*) AS n, min(scene) AS first_scene FROM (SELECT scene, CASE WHEN strftime(day, '%m-%d') >= '11-15' OR strftime(day, '%m-%d') <= '02-10' THEN 'winter' WHEN strftime(day, '%m-%d') BETWEEN '02-11' AND '05-31' THEN 'spring' ELSE 'summer' END AS season FROM scenes) GROUP BY season""")
def p19_seasons(spark, sf_dir):
    season = C.season_of(F.col("day"), [("winter", "11-15", "02-10"), ("spring", "02-11", "05-31")])
    return scenes(spark, sf_dir).groupBy(season.alias("season")).agg(F.count(F.lit(1)).alias("n"), F.min("scene").alias("first_scene"))


@query(f"""WITH {SCENES}, d AS (SELECT tile, day + 1 AS day, sum(priority)::BIGINT AS total FROM scenes GROUP BY ALL) SELECT a.tile, a.day, b.total AS accumulated FROM (SELECT DISTINCT tile, day FROM scenes) a LEFT JOIN d b ON a.tile = b.tile AND a.day = b.day""")
def p22_day_shift(spark, sf_dir):
    s = scenes(spark, sf_dir)
    return A.day_shifted(s.groupBy("tile", "day").agg(F.sum("priority").alias("accumulated")), ["tile"], "day", "accumulated")


@query(f"""WITH {PX} SELECT cell, t, y, x, CASE (cell % 8) WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 9 - y WHEN 3 THEN 9 - x WHEN 4 THEN y WHEN 5 THEN 9 - y WHEN 6 THEN x ELSE 9 - x END AS new_y,
CASE (cell % 8) WHEN 0 THEN x WHEN 1 THEN 9 - y WHEN 2 THEN 9 - x WHEN 3 THEN y WHEN 4 THEN 9 - x WHEN 5 THEN x WHEN 6 THEN y ELSE 9 - y END AS new_x FROM px""")
def p23_augmentation(spark, sf_dir):
    a, b = C.turned(F.col("y"), F.col("x"), 10, F.col("cell") % 8)
    return pixels(spark, sf_dir).select("cell", "t", "y", "x", a.alias("new_y"), b.alias("new_x"))


@query("""SELECT l_linenumber, (SELECT count(*) FROM (VALUES (0.1), (0.2125), (0.325), (0.4375), (0.55), (0.6625), (0.775), (0.8875), (1.0)) e(v) WHERE CAST(v AS DOUBLE) <= l_quantity / 50)::INTEGER AS class, CASE WHEN l_quantity = 0 THEN 0 WHEN l_quantity = 100 THEN 11 WHEN l_quantity > 90 AND l_quantity < 100 THEN 10 ELSE CAST(ceil(l_quantity / 10) AS INTEGER) END AS bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def p27_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", C.fraction_class(F.col("l_quantity") / 50).alias("class"), C.percent_bin(F.col("l_quantity")).alias("bin"))
    return rows.groupBy("l_linenumber", "class", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCENES} SELECT month(day) AS m, round(sin(month(day) * (2 * pi() / 12)), 6) AS s, round(cos(month(day) * (2 * pi() / 12)), 6) AS c, count(*) AS n FROM scenes GROUP BY ALL""")
def p29_month_cycle(spark, sf_dir):
    m = F.month("day")
    s, c = C.month_cycle(m)
    return scenes(spark, sf_dir).groupBy(m.cast("long").alias("m"), (r(s, 6) + 0.0).alias("s"), (r(c, 6) + 0.0).alias("c")).agg(F.count(F.lit(1)).alias("n"))


_RING = ((0.0, -20.0), (60.0, -30.0), (90.0, 20.0), (30.0, 10.0), (10.0, 40.0))


def _ring_sql(x: str, y: str) -> str:
    edges = list(zip(_RING, [*_RING[1:], _RING[0]]))
    return " + ".join(f"CASE WHEN ({a[1]} > {y}) <> ({b[1]} > {y}) AND {x} < ({b[0]} - {a[0]}) * ({y} - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in edges)


@query(f"""WITH {POINTS} SELECT id, ({_ring_sql('lon', 'lat')}) % 2 = 1 AS inside, CASE WHEN ({_ring_sql('lon', 'lat')}) % 2 = 1 THEN 'KEEP' ELSE 'DROP' END AS action FROM points""")
def f01_point_in_polygon(spark, sf_dir):
    inside = J.point_in_polygon(F.col("lon"), F.col("lat"), _RING)
    return points(spark, sf_dir).select("id", inside.alias("inside"), F.when(inside, "KEEP").otherwise("DROP").alias("action"))


@query(f"""WITH {PX} SELECT cell, t, CASE WHEN count(value) = 0 THEN 'SKIP_EMPTY' WHEN count(value) < 45 THEN 'SKIP_PARTIAL' ELSE 'CLIP' END AS action, count(value) AS valid_pixel_count FROM px GROUP BY ALL""")
def f06_clip_gate(spark, sf_dir):
    return A.clip_actions(pixels(spark, sf_dir), ["cell", "t"], "value", 45)


@query("""SELECT CASE WHEN value >= 5 AND value < 100 THEN 'real' ELSE 'missing' END AS kind, count(*) AS n FROM events GROUP BY 1""")
def f11_fill_test(spark, sf_dir):
    v = F.when(F.col("value") < 5, F.lit(-9999.0)).when(F.col("value") >= 100, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").groupBy(F.when(C.drop_sentinels(v).isNotNull(), "real").otherwise("missing").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PX} SELECT cell, t, count(*) AS n FROM px GROUP BY cell, t HAVING NOT bool_and(value IS NULL)""")
def f13_drop_masked_samples(spark, sf_dir):
    return A.unmasked_samples(pixels(spark, sf_dir), ["cell", "t"], "value")


@query(f"""WITH {SCENES} SELECT c.tile, c.day, coalesce(s.n, -9999.0) AS n FROM (SELECT tile, day FROM (SELECT DISTINCT tile FROM scenes), (SELECT DISTINCT day FROM scenes)) c LEFT JOIN (SELECT tile, day, count(*)::DOUBLE AS n FROM scenes GROUP BY ALL) s ON c.tile = s.tile AND c.day = s.day""")
def j03_calendar(spark, sf_dir):
    s = scenes(spark, sf_dir)
    dims = J.cells_by_days(s.select("tile").distinct(), s.select("day").distinct())
    return J.complete_calendar(dims, s.groupBy("tile", "day").agg(F.count(F.lit(1)).cast("double").alias("n")), ["tile", "day"], "n")


@query(f"""WITH {OBS} SELECT cell, band, day + CAST(k AS INTEGER) AS window_end, count(value) AS n, round(avg(value), 6) AS mean, count(DISTINCT day) AS n_days FROM obs, range(8) r(k) GROUP BY ALL""")
def j04_window_statistics(spark, sf_dir):
    return J.window_statistics(observations(spark, sf_dir), ["cell", "band"], "day", "value").withColumn("mean", r("mean", 6))


@query(f"""WITH {POINTS}, a AS (SELECT id, lon AS x1, lat AS y1, lon + 3 AS x2, lat + 2 AS y2 FROM points), b AS (SELECT s_suppkey AS id, (s_suppkey * 53 % 360) - 180.0 AS x1, s_acctbal / 100 - 45 AS y1, (s_suppkey * 53 % 360) - 175.0 AS x2, s_acctbal / 100 - 40 AS y2 FROM supplier)
SELECT a.id AS left_id, b.id AS right_id FROM a JOIN b ON a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2""")
def j05_scene_cell_boxes(spark, sf_dir):
    left = points(spark, sf_dir).select(F.col("id").alias("left_id"), F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), (F.col("lon") + 3).alias("max_x"), (F.col("lat") + 2).alias("max_y"))
    x, y = (F.col("s_suppkey") * 53 % 360) - F.lit(180.0), F.col("s_acctbal") / 100 - 45
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("right_id"), x.alias("min_x"), y.alias("min_y"), (x + 5).alias("max_x"), (F.col("s_acctbal") / 100 - 40).alias("max_y"))
    return J.box_join(left, right, 5.0)


@query(f"""WITH {SCENES}, f AS (SELECT tile, day, min(priority) AS p FROM scenes GROUP BY ALL) SELECT s.tile, s.day, s.scene, s.priority FROM scenes s JOIN f ON s.tile = f.tile AND s.day = f.day AND s.priority = f.p""")
def j06_source_fallback(spark, sf_dir):
    return J.prefer(scenes(spark, sf_dir), ["tile", "day"], "priority").select("tile", "day", "scene", "priority")


@query(f"""WITH {PX}, t AS (SELECT c_custkey AS target_id, c_custkey // 15 + 1 AS cell, c_custkey % 7 + 1 AS t, (c_custkey % 80) / 10.0 AS y, (c_custkey % 70) / 8.0 AS x FROM customer),
n AS (SELECT target_id, t.cell, t.t, floor(y) + dy AS py, floor(x) + dx AS px_, (1 - abs(y - (floor(y) + dy))) * (1 - abs(x - (floor(x) + dx))) AS w FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx))
SELECT target_id, round(sum(w * value) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0), 4) AS value FROM n LEFT JOIN px ON px.cell = n.cell AND px.t = n.t AND px.y = py AND px.x = px_ GROUP BY target_id""")
def j08_bilinear(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id"), (F.floor(F.col("c_custkey") / 15) + 1).alias("cell"), (F.col("c_custkey") % 7 + 1).cast("int").alias("t"), ((F.col("c_custkey") % 80) / F.lit(10.0)).alias("y"), ((F.col("c_custkey") % 70) / F.lit(8.0)).alias("x"))
    return J.bilinear(target, pixels(spark, sf_dir), ["cell", "t"], "value").withColumn("value", r("value"))


@query(f"""WITH {POINTS}, g AS (SELECT s_suppkey AS id, (s_suppkey * 53 % 360) - 180.0 AS x, s_acctbal / 100 - 45 AS y FROM supplier),
d AS (SELECT g.id AS grid_id, p.id AS pid, p.lat AS v, (g.x - p.lon) ^ 2 + (g.y - p.lat) ^ 2 AS d FROM g, points p)
SELECT grid_id, round(v, 6) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY d, pid) AS k FROM d) WHERE k = 1""")
def j09_swath_nearest(spark, sf_dir):
    grid = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("grid_id"), ((F.col("s_suppkey") * 53 % 360) - F.lit(180.0)).alias("x"), (F.col("s_acctbal") / 100 - 45).alias("y"))
    swath = points(spark, sf_dir).select(F.col("id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), "lat")
    return J.nearest_point(grid, swath, 4.0, "lat").withColumn("lat", r("lat", 6))


@query("""WITH d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, b.label, list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings b WHERE b.vec_id <> q.vec_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM d) SELECT query_id, k, round(avg(label), 4) AS mean_label, count(*) AS n FROM o, (VALUES (5), (20), (100)) v(k) WHERE r <= k GROUP BY ALL""")
def j10_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("double").alias("label"))
    asked = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return knn.predict(asked, e, (5, 20, 100)).withColumn("mean_label", r("mean_label"))


@query(f"""WITH {SCENES}, i AS (SELECT tile, day, min(scene) AS scene FROM scenes WHERE priority = 1 GROUP BY ALL), q AS (SELECT scene AS request_id, tile, day FROM scenes WHERE priority = 5)
SELECT request_id, scene, taken FROM (SELECT request_id, i.scene, i.day AS taken, row_number() OVER (PARTITION BY request_id ORDER BY abs(i.day - q.day), i.day) AS k FROM q LEFT JOIN i ON i.tile = q.tile) WHERE k = 1""")
def j11_nearest_in_time(spark, sf_dir):
    s = scenes(spark, sf_dir)
    asked = s.where("priority = 5").select("tile", F.col("scene").alias("request_id"), "day")
    found = J.nearest_in_time(asked, s.where("priority = 1"), ["tile"], "day", "day", "scene")
    return found.withColumnRenamed("day", "taken")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def j13_not_yet_done(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.not_yet_done(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query(f"""WITH {PX}, c AS (SELECT cell, t, y // 5 AS cy, x // 5 AS cx, max(value) AS v FROM px GROUP BY ALL) SELECT px.cell, px.t, px.y, px.x, px.value, c.v AS coarse_value FROM px LEFT JOIN c ON c.cell = px.cell AND c.t = px.t AND c.cy = px.y // 5 AND c.cx = px.x // 5""")
def j17_upsample(spark, sf_dir):
    px = pixels(spark, sf_dir)
    coarse = px.groupBy("cell", "t", F.floor(F.col("y") / 5).alias("y"), F.floor(F.col("x") / 5).alias("x")).agg(F.max("value").alias("value"))
    return J.upsample(coarse, px, ["cell", "t"], 5, "value")


@query(f"""WITH {OBS} SELECT band, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std FROM obs GROUP BY band HAVING count(value) >= 2""")
def a01_band_statistics(spark, sf_dir):
    return A.band_statistics(observations(spark, sf_dir), ["band"], "value").select("band", "n", r("mean").alias("mean"), r("std").alias("std"))


@query(f"""WITH {OBS}, s AS (SELECT * FROM obs ORDER BY md5('stats|' || cell || '|' || band || '|' || t), cell, band, t LIMIT 2000) SELECT band, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM s GROUP BY band HAVING count(value) >= 2""")
def a02_population_statistics(spark, sf_dir):
    """Of a sample of 2000 readings, which is what is asked for here."""
    sample = W.sampled(observations(spark, sf_dir), ["cell", "band", "t"], 2000, "stats")
    return A.band_statistics(sample, ["band"], "value", population=True).select("band", "n", r("mean").alias("mean"), r("std").alias("std"))


@query(f"""WITH {PX} SELECT cell, t, y // 5 AS by, x // 2 AS bx, round(avg(value), 6) AS mean, round(avg(coalesce(value, -9999)), 6) AS mean_with_nodata, bool_and(value IS NOT NULL) AS valid, max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS mask FROM px GROUP BY ALL""")
def a03_block_down_sample(spark, sf_dir):
    px = pixels(spark, sf_dir)
    skip, with_nodata = A.block_down_sample(px, ["cell", "t"], "value", 5, 2), A.block_down_sample(px, ["cell", "t"], "value", 5, 2, -9999.0)
    keys = ["cell", "t", "by", "bx"]
    return skip.join(with_nodata.select(*keys, r("mean", 6).alias("mean_with_nodata")), keys).withColumn("mean", r("mean", 6))


@query(f"""WITH {PX}, g(t, "group") AS (VALUES (1, 'a'), (2, 'a'), (3, 'b'), (4, 'b'), (5, 'b'), (6, 'c'), (7, 'c')) SELECT cell, y, "group", bool_or(value IS NULL) AS masked FROM px JOIN g USING (t) GROUP BY ALL""")
def a07_group_mask(spark, sf_dir):
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, "c"), (7, "c")], "t int, group string")
    return A.group_mask(pixels(spark, sf_dir), groups, ["cell", "y"], "t", "value")


@query(f"""WITH {OBS} SELECT cell, band, round(avg(m), 6) AS fill FROM (SELECT cell, band, day, coalesce(avg(value), 0) AS m FROM obs GROUP BY ALL) GROUP BY ALL""")
def a08_fill_by_step_means(spark, sf_dir):
    return A.fill_by_step_means(observations(spark, sf_dir), ["cell", "band"], "day", "value").withColumn("fill", r("fill", 6))


@query(f"""WITH {SCENES} SELECT tile, day, arg_min(value, (priority, scene)) AS value FROM scenes WHERE value IS NOT NULL GROUP BY ALL""")
def a10_first_valid_mosaic(spark, sf_dir):
    return A.first_valid(scenes(spark, sf_dir), ["tile", "day"], [F.col("priority"), F.col("scene")], "value")


@query(f"""WITH {SCENES} SELECT tile, day, scene, value FROM (SELECT *, row_number() OVER (PARTITION BY tile, day ORDER BY priority DESC, scene DESC) AS k FROM scenes) WHERE k = 1""")
def a12_latest_only(spark, sf_dir):
    return W.latest(scenes(spark, sf_dir), ["tile", "day"], [F.desc("priority"), F.desc("scene")]).select("tile", "day", "scene", "value")


@query(f"""WITH {PX}, c AS (SELECT cell, t, count(value) AS n FROM px GROUP BY ALL) SELECT cell, arg_min(t, (-n, t)) AS t, max(n) AS n_valid FROM c GROUP BY cell""")
def a13_best_overpass(spark, sf_dir):
    return A.best_overpass(pixels(spark, sf_dir), ["cell"], "t", "value")


_METRICS = "count(*) AS n, round(sqrt(avg((y - p) ^ 2)), 6) AS rmse, round(1 - sum((y - p) ^ 2) / nullif(var_pop(y) * count(*), 0), 4) AS r2, round(avg(abs(y - p)), 6) AS mae, round(quantile_cont(abs(y - p), 0.5), 6) AS median_ae"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", r("rmse", 6).alias("rmse"), r("r2").alias("r2"), r("mae", 6).alias("mae"), r("median_ae", 6).alias("median_ae"))


def _labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("y"), (F.col("l_discount") * 10).alias("p"))


@query(f"""SELECT l_returnflag, {_METRICS} FROM (SELECT l_returnflag, l_quantity / 50 AS y, l_discount * 10 AS p FROM lineitem) GROUP BY l_returnflag""")
def a14_regression_metrics(spark, sf_dir):
    return _rounded(A.regression_metrics(_labelled(spark, sf_dir), "y", "p", ["l_returnflag"], few_groups=True), "l_returnflag")


@query("""WITH m AS (SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY ALL), c AS (SELECT label AS class FROM m UNION SELECT prediction FROM m),
s AS (SELECT class, coalesce((SELECT sum(n) FROM m WHERE label = class), 0) AS support, coalesce((SELECT sum(n) FROM m WHERE prediction = class), 0) AS predicted, coalesce((SELECT sum(n) FROM m WHERE label = class AND prediction = class), 0) AS hits FROM c)
SELECT class, support::BIGINT AS support, round(coalesce(hits / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hits / nullif(support + predicted, 0), 0), 6) AS f1, round(hits / (support + predicted - hits + 1e-8), 6) AS iou FROM s""")
def a16_class_scores(spark, sf_dir):
    scores = A.class_scores(A.confusion(table(spark, sf_dir, "labels"), "quality", "toxic"))
    return scores.select("class", "support", *[r(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query("""WITH m AS (SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY ALL), c AS (SELECT label AS class FROM m UNION SELECT prediction FROM m),
s AS (SELECT class, coalesce((SELECT sum(n) FROM m WHERE label = class), 0) AS support, coalesce((SELECT sum(n) FROM m WHERE prediction = class), 0) AS predicted, coalesce((SELECT sum(n) FROM m WHERE label = class AND prediction = class), 0) AS hits FROM c)
SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(hits / nullif(support, 0)), 6) AS balanced_accuracy, round(sum(coalesce(2 * hits / nullif(support + predicted, 0), 0) * support) / sum(support), 6) AS f1, round(avg(hits / (support + predicted - hits + 1e-8)), 6) AS mean_iou FROM s""")
def a15_classification_metrics(spark, sf_dir):
    m = A.classification_metrics(A.class_scores(A.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")))
    return m.select(*[r(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "f1", "mean_iou")])


@query(f"""WITH b AS (SELECT l_quantity / 50 AS y, l_discount * 10 AS p FROM lineitem), v AS (SELECT 'model' AS variant, y, p FROM b UNION ALL SELECT 'zero', y, 0 FROM b UNION ALL SELECT 'inner', y, p FROM b WHERE y > 0 AND y < 1) SELECT variant, {_METRICS} FROM v GROUP BY variant""")
def a18_metric_report(spark, sf_dir):
    return _rounded(A.metric_report(_labelled(spark, sf_dir), "y", "p"), "variant")


@query("""SELECT l_suppkey, count(*) AS n, round(sqrt(avg((l_quantity / 50 - l_discount * 10) ^ 2)), 6) AS rmse FROM lineitem GROUP BY ROLLUP (l_suppkey)""")
def a19_pooled_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") / 50).alias("y"), (F.col("l_discount") * 10).alias("p"))
    return A.with_pooled(rows, "l_suppkey", "y", "p").withColumn("rmse", r("rmse", 6))


@query("""SELECT p_brand, round(avg(CASE WHEN p_size = 10 THEN 1.0 ELSE 0.0 END), 6) AS cover FROM part GROUP BY p_brand""")
def a20_fractional_cover(spark, sf_dir):
    return A.fractional_cover(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 10).withColumn("cover", r("cover", 6))


@query("""SELECT round(avg(d * d), 6) AS mse, round(avg(CASE WHEN d < 1 THEN 0.5 * d * d ELSE d - 0.5 END), 6) AS smooth_l1, count(*) AS n FROM (SELECT abs(l_quantity / 10 - l_discount * 10) AS d FROM lineitem WHERE l_linenumber % 3 = 2)""")
def a21_masked_losses(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("mask"), (F.col("l_quantity") / 10).alias("y"), (F.col("l_discount") * 10).alias("p"))
    return A.masked_losses(rows, "mask", "y", "p").select(r("mse", 6).alias("mse"), r("smooth_l1", 6).alias("smooth_l1"), "n")


@query("""SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(embedding[pos]::DOUBLE), 5) AS mean FROM embeddings, range(1, 65) r(pos) GROUP BY ALL""")
def a22_mean_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return A.mean_vector(rows, ["label"], "v").withColumn("mean", r("mean", 5))


@query(f"""WITH {PX}, c AS (SELECT t, CASE WHEN count(value) = 0 THEN 'SKIP_EMPTY' WHEN count(value) < 45 THEN 'SKIP_PARTIAL' ELSE 'CLIP' END AS action, count(value) AS valid FROM px GROUP BY cell, t) SELECT t, action, count(*) AS n, sum(valid)::BIGINT AS valid_pixels FROM c GROUP BY ROLLUP (t, action)""")
def a23_action_tally(spark, sf_dir):
    return A.action_tally(A.clip_actions(pixels(spark, sf_dir), ["cell", "t"], "value", 45), "t", "action", "valid_pixel_count")


@query(f"""WITH {OBS}, e AS (SELECT count(DISTINCT cell) * count(DISTINCT band) AS n FROM obs) SELECT day, round(count(value) / any_value(n), 6) AS coverage FROM obs, e GROUP BY day""")
def a24_daily_coverage(spark, sf_dir):
    return A.coverage(observations(spark, sf_dir), "day", ["cell", "band"], "value").withColumn("coverage", r("coverage", 6))


@query(f"""WITH {OBS} SELECT band, t, bool_or(value IS NOT NULL) AS available, count(DISTINCT cell) AS n_cells FROM obs GROUP BY ALL""")
def a25_band_availability(spark, sf_dir):
    return A.band_availability(observations(spark, sf_dir), ["band", "t"], "value", "cell")


@query("""SELECT l_suppkey, count(*) AS n, CASE WHEN count(*) >= 4 THEN round(quantile_cont(abs(l_discount - l_tax), 0.5), 6) END AS median_diff, CASE WHEN count(*) >= 4 THEN round(corr(l_discount, l_tax), 4) END AS corr FROM lineitem GROUP BY l_suppkey""")
def a26_parity(spark, sf_dir):
    p = A.parity(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", ["l_suppkey"])
    return p.withColumn("median_diff", r("median_diff", 6)).withColumn("corr", r("corr"))


@query(f"""WITH {SCENES} SELECT year(day)::INTEGER AS y, month(day)::INTEGER AS m, count(*) AS n FROM scenes GROUP BY ALL""")
def a27_scene_calendar(spark, sf_dir):
    return A.calendar_histogram(scenes(spark, sf_dir), "day")


@query(f"""WITH {OBS}, e AS (SELECT band, min(value) AS low, max(value) AS high FROM obs GROUP BY band) SELECT o.band, CAST(coalesce(least(floor((value - low) / nullif(high - low, 0) * 20), 19), 0) AS INTEGER) AS bin, count(*) AS n FROM obs o JOIN e ON o.band = e.band WHERE value IS NOT NULL GROUP BY ALL""")
def a30_histogram(spark, sf_dir):
    return A.histogram(observations(spark, sf_dir), "band", "value")


@query(f"""WITH {PX} SELECT cell, t, quantile_disc(value, 0.5) AS median FROM px GROUP BY ALL""")
def a33_lower_median(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("cell", "t").agg(A.lower_median("value").alias("median"))


@query(f"""WITH {OBS} SELECT cell, band, day, last_value(value IGNORE NULLS) OVER w AS filled, coalesce(t - last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w, -1) AS age FROM obs WINDOW w AS (PARTITION BY cell, band ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w01_forward_fill(spark, sf_dir):
    return W.forward_fill(observations(spark, sf_dir), ["cell", "band"], "t", "value").select("cell", "band", "day", "filled", "age")


@query(f"""WITH {PX}, a AS (SELECT *, coalesce(value, quantile_disc(value, 0.5) OVER (PARTITION BY cell, y, x)) AS v1 FROM px), b AS (SELECT *, coalesce(v1, quantile_disc(v1, 0.5) OVER (PARTITION BY cell, t)) AS v2 FROM a) SELECT cell, t, y, x, round(coalesce(v2, avg(v2) OVER ()), 4) AS value_filled FROM b""")
def w03_median_fill(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("tier", F.lit("h"))
    return W.median_fill(px, ["cell", "y", "x"], ["cell", "t"], ["tier"], "value").select("cell", "t", "y", "x", r("value_filled").alias("value_filled"))


@query("""WITH z AS (SELECT cell, y, x, q + 0.37 * y AS z FROM (SELECT l_suppkey AS cell, l_partkey % 10 AS y, l_orderkey % 10 AS x, max(l_quantity) AS q FROM lineitem GROUP BY ALL)),
g AS (SELECT *, coalesce(lag(z) OVER h, z) AS w, coalesce(lead(z) OVER h, z) AS e FROM z WINDOW h AS (PARTITION BY cell, y ORDER BY x)),
s AS (SELECT *, coalesce(lag(w) OVER v, w) AS nw, coalesce(lag(z) OVER v, z) AS n, coalesce(lag(e) OVER v, e) AS ne, coalesce(lead(w) OVER v, w) AS sw, coalesce(lead(z) OVER v, z) AS s, coalesce(lead(e) OVER v, e) AS se FROM g WINDOW v AS (PARTITION BY cell, x ORDER BY y)),
m AS (SELECT *, 0.0001 * 2 * pi() * 6378137 / 360 AS my FROM s), k AS (SELECT *, my * cos(radians(50 - y * 4)) AS mx FROM m),
d AS (SELECT cell, y, x, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * mx) AS dx, ((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8 * my) AS dy FROM k)
SELECT cell, y, x, round(degrees(atan(sqrt(dx * dx + dy * dy))), 4) AS slope FROM d""")
def w04_slope(spark, sf_dir):
    return _terrain(spark, sf_dir).select("cell", "y", "x", r("slope").alias("slope"))


def _terrain(spark, sf_dir) -> DataFrame:
    """Slope and aspect of heights made of line items, on rows four degrees apart."""
    keys = [F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 10).alias("y"), (F.col("l_orderkey") % 10).alias("x")]
    z = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max("l_quantity").alias("q")).withColumn("z", F.col("q") + 0.37 * F.col("y"))
    return W.slope_aspect(z, ["cell"], "z", *C.degree_spacing(50 - F.col("y") * 4, 0.0001, 0.0001))


@query(f"""WITH {SCENES} SELECT tile, day, count(*) AS n FROM scenes GROUP BY ALL HAVING count(*) > 1""")
def w07_seam_guard(spark, sf_dir):
    return W.assert_no_seams(scenes(spark, sf_dir), ["tile", "day"])


@query(f"""WITH {SCENES} SELECT tile, priority, scene FROM (SELECT *, row_number() OVER (PARTITION BY tile, priority ORDER BY md5('quota|' || scene), scene) AS k FROM scenes) WHERE k <= 3""")
def w08_quota_sampling(spark, sf_dir):
    return W.quota(scenes(spark, sf_dir), ["tile", "priority"], ["scene"], 3, "quota").select("tile", "priority", "scene")


@query(f"""WITH {PX}, k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY md5('mask|' || cell || '|' || t || '|' || y || '|' || x), t, y, x) AS k, count(*) OVER (PARTITION BY cell) AS n FROM px) SELECT cell, t, y, x, CASE WHEN value IS NULL THEN 1 WHEN k <= floor(n * 0.25) THEN 0 WHEN k <= floor(n * 0.25) + floor(n * 0.5) THEN 2 ELSE 1 END AS mask FROM k""")
def w10_exact_ratio_mask(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("valid", F.col("value").isNotNull())
    return W.exact_ratio_mask(px, ["cell"], ["t", "y", "x"], "valid", 0.25, 0.5, "mask").select("cell", "t", "y", "x", "mask")


@query(f"""WITH {OBS} SELECT cell, day + CAST(k AS INTEGER) AS window_end, md5(string_agg((7 - k)::VARCHAR || ':' || band || ':' || coalesce(value::DECIMAL(18, 2)::VARCHAR, 'none'), ',' ORDER BY 7 - k, band)) AS stack FROM obs, range(8) r(k) GROUP BY ALL""")
def w11_trailing_stack(spark, sf_dir):
    stack = W.trailing_stack(observations(spark, sf_dir), ["cell"], "day", "band", "value")
    text = F.transform("stack", lambda s: F.concat(s["t"].cast("string"), F.lit(":"), s["band"], F.lit(":"), F.coalesce(s["value"].cast("decimal(18,2)").cast("string"), F.lit("none"))))
    return stack.select("cell", "window_end", F.md5(F.concat_ws(",", text)).alias("stack"))


@query(f"""WITH {SCENES} (SELECT 'best' AS kind, scene, value FROM scenes WHERE value IS NOT NULL ORDER BY value DESC, scene LIMIT 10) UNION ALL (SELECT 'worst', scene, value FROM scenes WHERE value IS NOT NULL ORDER BY value, scene LIMIT 10)""")
def k01_best_and_worst(spark, sf_dir):
    s = scenes(spark, sf_dir).where("value is not null").select("scene", "value")
    return W.best_and_worst(s, "value", "scene", 10)


@query("""SELECT DISTINCT o_custkey % 50 AS tile, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey % 50, o_orderdate::DATE FROM orders WHERE o_orderstatus = 'O'""")
def g04_needed_minus_present(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("tile"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return J.needed_minus_present(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["tile", "day"])


@query(f"""WITH {SCENES} SELECT scene, tile, CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM scenes JOIN (SELECT tile, row_number() OVER (ORDER BY md5('split|' || tile), tile) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT tile FROM scenes)) USING (tile)""")
def x04_split_exact(spark, sf_dir):
    return W.split_exact(scenes(spark, sf_dir), ["tile"], 0.2, "split").select("scene", "tile", "part")


@query("""SELECT time_bucket(INTERVAL '1 day', ts)::DATE AS day, event_type, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY ALL""")
def t02_daily_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return forms.daily_blocks(e, "ts", ["event_type"], "value").select(F.to_date("start").alias("day"), "event_type", "n", r("mean", 8).alias("mean"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def t05_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return forms.sessions(e, "ts", ["user_id"], "6 hours").select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n")
