"""Registered queries of per-row facts, small gates, orders and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import bands as B
from gridloom.functions import columns as C
from gridloom.functions import geometry as G
from gridloom.operators import aggregates as A
from gridloom.operators import joins as J
from gridloom.operators import series as W
from gridloom.plans.queries import OBS, POINTS, PX, SCENES, observations, pixels, points, query, r, scenes, table
from gridloom.sources import names as N


@query("""SELECT p_partkey, CASE WHEN p_size > 0 THEN round(10 * log10(p_size / 100.0), 4) END AS db FROM part WHERE p_size >= 1""")
def p03_decibels(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size >= 1").select("p_partkey", r(C.decibels(F.col("p_size") / 100)).alias("db"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_linenumber % 3 = 0 AND l_discount + l_tax > 0 THEN (l_discount - l_tax) / (l_discount + l_tax) END, 4) AS ratio FROM lineitem""")
def p08_masked_difference(spark, sf_dir):
    ratio = C.normalized_difference(F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber") % 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(ratio).alias("ratio"))


@query(f"""WITH {POINTS} SELECT id, lon BETWEEN 0 AND 40 AND lat BETWEEN 10 AND 45 AS inside, round((least(lon, 0) + greatest(lon, 40)) / 2, 4) AS centre FROM points""")
def p15_box_predicates(spark, sf_dir):
    box = F.struct(F.lit(0.0).alias("min_lon"), F.lit(10.0).alias("min_lat"), F.lit(40.0).alias("max_lon"), F.lit(45.0).alias("max_lat"))
    union = F.struct(F.least("lon", F.lit(0.0)).alias("a"), F.greatest("lon", F.lit(40.0)).alias("b"))
    return points(spark, sf_dir).select("id", C.in_box(F.col("lon"), F.col("lat"), box).alias("inside"), r((union["a"] + union["b"]) / 2).alias("centre"))


@query(f"""WITH {POINTS} SELECT id, season, CAST(CASE WHEN lat < 0 THEN (CASE season WHEN 'snow' THEN 7 ELSE 1 END) ELSE (CASE season WHEN 'snow' THEN 1 ELSE 7 END) END AS INTEGER) AS month FROM points, (VALUES ('snow'), ('melt')) s(season)""")
def p20_hemisphere_seasons(spark, sf_dir):
    north = F.create_map(F.lit("snow"), F.lit(1), F.lit("melt"), F.lit(7))
    south = F.create_map(F.lit("snow"), F.lit(7), F.lit("melt"), F.lit(1))
    return points(spark, sf_dir).select("id", F.explode(C.hemisphere_month(F.col("lat"), north, south)).alias("season", "month"))


@query(f"""WITH {SCENES} SELECT scene, day - CAST(k AS INTEGER) AS day FROM scenes, range(8) t(k)""")
def p21_windows_of_days(spark, sf_dir):
    return scenes(spark, sf_dir).select("scene", F.explode(C.trailing_days(F.col("day"))).alias("day"))


@query(f"""WITH {POINTS}, q AS (SELECT id, CAST(floor((60 - lat) / 0.5) AS BIGINT) AS "row", CAST(floor((lon + 180) / 0.5) AS BIGINT) AS col FROM points) SELECT id, "row" // 50 AS patch_row, col // 50 AS patch_col, "row" BETWEEN 0 AND 199 AND col BETWEEN 0 AND 599 AS inside FROM q""")
def p25_patch_of_point(spark, sf_dir):
    position = points(spark, sf_dir).select("id", F.floor((60 - F.col("lat")) / 0.5).alias("row"), F.floor((F.col("lon") + 180) / 0.5).alias("col"))
    return position.select("id", C.patch_of(F.col("row"), F.col("col"), 50, 200, 600).alias("p")).select("id", F.col("p.row").alias("patch_row"), F.col("p.col").alias("patch_col"), "p.inside")


@query("""SELECT p_partkey, CASE p_size WHEN 10 THEN 0 WHEN 11 THEN 1 END AS label FROM part""")
def p26_label_classes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.reclassified(F.col("p_size"), {10: 0, 11: 1}).alias("label"))


@query(f"""WITH {OBS}, e AS (SELECT max(t) AS last FROM obs) SELECT band, count_if(value IS NULL OR (t = last AND band IN ('view', 'click'))) AS masked, count(*) AS n FROM obs, e GROUP BY band""")
def p32_last_day_masks(spark, sf_dir):
    obs = observations(spark, sf_dir)
    last = obs.agg(F.max("t").alias("last"))
    masked = C.ablated(F.col("value"), F.col("band"), F.col("t"), only=("error", "signup", "purchase"), last=F.col("last"))
    return obs.crossJoin(F.broadcast(last)).groupBy("band").agg(F.count_if(masked).alias("masked"), F.count(F.lit(1)).alias("n"))  # one row beside all


@query(f"""WITH {OBS} SELECT DISTINCT band || '_' || (t % 8) AS label, band || '_cell' AS stem FROM obs""")
def p34_band_labels(spark, sf_dir):
    name = F.concat(F.col("band"), F.lit("_cell_EPSG:32611.tif"))
    return observations(spark, sf_dir).select(N.band_label(F.col("band"), F.col("t") % 8).alias("label"), N.strip_epsg(name).alias("stem")).distinct()


@query("""SELECT event_type, count_if(value IS NULL OR isnan(value) OR isinf(value)) AS bad, count(*) AS n FROM events GROUP BY event_type""")
def f12_unreal_values(spark, sf_dir):
    return A.unreal_values(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""SELECT l_suppkey, count(*) AS n, round(avg(l_discount * 10), 6) AS mean FROM lineitem WHERE l_discount * 10 > 0 AND l_discount * 10 < 1 GROUP BY l_suppkey""")
def f15_inner_labels(spark, sf_dir):
    label = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").where((label > 0) & (label < 1)).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r(F.avg(label), 6).alias("mean"))


@query(f"""WITH {SCENES} SELECT c.tile, d.day FROM (SELECT DISTINCT tile FROM scenes) c CROSS JOIN (SELECT DISTINCT day FROM scenes) d""")
def j02_cells_by_days(spark, sf_dir):
    s = scenes(spark, sf_dir)
    return J.cells_by_days(s.select("tile").distinct(), s.select("day").distinct())


@query(f"""WITH {PX} SELECT cell, t, round(avg(value), 4) AS mean, round(avg(coalesce(value, -9999)), 4) AS mean_with_fill FROM px GROUP BY cell, t""")
def a04_spatial_means(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("cell", "t").agg(r(F.avg("value")).alias("mean"), r(F.avg(F.coalesce("value", F.lit(-9999.0)))).alias("mean_with_fill"))


@query(f"""WITH {SCENES} SELECT tile, day, arg_min(value, (-priority, scene)) AS value FROM scenes WHERE value IS NOT NULL GROUP BY tile, day""")
def a09_first_valid_by_processing(spark, sf_dir):
    return A.first_valid(scenes(spark, sf_dir), ["tile", "day"], [(-F.col("priority")).alias("p"), F.col("scene")], "value")


@query(f"""WITH {SCENES} SELECT tile, day, scene FROM (SELECT *, row_number() OVER (PARTITION BY tile, day ORDER BY priority DESC, scene) AS k FROM scenes) WHERE k = 1""")
def w05_latest_products(spark, sf_dir):
    return W.latest(scenes(spark, sf_dir), ["tile", "day"], [F.desc("priority"), F.col("scene")]).select("tile", "day", "scene")


@query(f"""WITH {POINTS}, g AS (SELECT DISTINCT CAST(floor(lat / 5) AS BIGINT) AS iy, CAST(floor(lon / 5) AS BIGINT) AS ix FROM points) SELECT iy, ix, (iy + 20) * 100 + ix + 40 AS cell_id FROM g""")
def w06_computed_cell_ids(spark, sf_dir):
    iy, ix = F.floor(F.col("lat") / 5), F.floor(F.col("lon") / 5)
    return points(spark, sf_dir).select(iy.alias("iy"), ix.alias("ix")).distinct().withColumn("cell_id", C.row_major_id(F.col("iy"), F.col("ix"), -20, -40, 100))


@query(f"""WITH {SCENES} SELECT tile, arg_min(scene, (day, scene)) AS first_scene, min(day) AS first_day FROM scenes GROUP BY tile""")
def k03_first_images(spark, sf_dir):
    return scenes(spark, sf_dir).groupBy("tile").agg(F.min_by("scene", F.struct("day", "scene")).alias("first_scene"), F.min("day").alias("first_day"))


@query(f"""WITH {POINTS} SELECT id, DATE '2024-01-10' + CAST(('0x' || substr(md5('window|' || id), 1, 8))::BIGINT % 35 AS INTEGER) AS first_day, DATE '2024-01-10' + CAST(('0x' || substr(md5('window|' || id), 1, 8))::BIGINT % 35 AS INTEGER) + 7 AS last_day FROM points""")
def x01_random_windows(spark, sf_dir):
    first = F.date_add(F.lit("2024-01-10").cast("date"), F.pmod(G.hash_number("window", F.col("id")), F.lit(35)).cast("int"))
    return points(spark, sf_dir).select("id", first.alias("first_day"), F.date_add(first, 7).alias("last_day"))


@query("""WITH q AS (SELECT p_partkey, p_partkey * 7654321 % 2147483648 AS q, p_size FROM part) SELECT p_partkey, (q & 8) = 0 AND (q & 16) = 0 AS landsat, (q & 3) = 0 AS modis, ((q >> 2) & 3) = 0 AS viirs, (q & 134217728) = 0 AS s3, (q & 1024) = 0 AND (q & 2048) = 0 AS s2, p_size < 5 AS s2_probability FROM q""")
def p06_clear_sky(spark, sf_dir):
    word = F.col("p_partkey") * 7654321 % 2147483648
    return table(spark, sf_dir, "part").select("p_partkey", *[B.is_clear(s, word).alias(s) for s in B.CLEAR_BITS], B.is_clear("s2_probability", F.col("p_size")).alias("s2_probability"))
