"""Registered queries of the source adapters, metadata, clipping, packed forms and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import geometry as G
from gridloom.operators import aggregates as A
from gridloom.operators import clipping as K
from gridloom.operators import joins as J
from gridloom.operators import series as W
from gridloom.operators import training as T
from gridloom.operators.adapters import fetch
from gridloom.plans.queries import _RING, OBS, ORACLE_SQL, POINTS, PX, SCENES, _ring_sql, _terrain, observations, pixels, points, query, r, scenes, table
from gridloom.sources import names as N
from gridloom.sources import sinks as S


def _readings(spark, sf_dir, value):
    keys = [F.col("l_suppkey").alias("cell"), (F.col("l_orderkey") % 40).alias("day"), F.col("l_returnflag").alias("band")]
    order = [F.col("l_linenumber").alias("proc"), F.col("l_orderkey").alias("scene"), F.col("l_partkey").alias("tie")]
    return table(spark, sf_dir, "lineitem").select(*keys, *order, value.cast("double").alias("value"))


def _adapter(name: str, sql: str, value, newest: str, whole: bool) -> None:
    """Registers an adapter over line items as readings: `sql` and `value` are its calibration, the newest `newest` goes first."""
    other = "scene" if newest == "proc" else "proc"
    kept = "CASE WHEN count(value) OVER (PARTITION BY cell, day) = count(*) OVER (PARTITION BY cell, day) THEN value END" if whole else "value"

    sql = f"""WITH p AS (SELECT l_suppkey AS cell, l_orderkey % 40 AS day, l_returnflag AS band, l_linenumber AS proc, l_orderkey AS scene, l_partkey AS tie, CAST({sql} AS DOUBLE) AS value FROM lineitem),
f AS (SELECT cell, day, band, arg_min(value, (-{newest}, {other}, tie)) AS value FROM p WHERE value IS NOT NULL GROUP BY ALL),
k AS (SELECT c.cell, d.day, b.band FROM (SELECT DISTINCT cell FROM p) c, (SELECT DISTINCT day FROM p) d, (SELECT DISTINCT band FROM p) b),
j AS (SELECT k.*, f.value FROM k LEFT JOIN f USING (cell, day, band)) SELECT cell, day, band, round({kept}, 4) AS value FROM j"""

    def run(spark, sf_dir):
        rows = _readings(spark, sf_dir, value())
        dims = [rows.select(c).distinct() for c in ("cell", "day", "band")]
        return fetch(rows, *dims, [(-F.col(newest)).alias("p"), F.col(other), F.col("tie")], whole).withColumn("value", r("value"))

    run.__name__ = name
    query(sql)(run)


_adapter("d02_optical_reflectance", "(SELECT CASE WHEN dn <> 0 AND dn - CASE WHEN l_linenumber > 4 THEN 1000 ELSE 0 END >= -1 THEN dn - CASE WHEN l_linenumber > 4 THEN 1000 ELSE 0 END END FROM (SELECT l_quantity * 60 AS dn))", lambda: C.harmonized_dn(F.col("l_quantity") * 60, F.when(F.col("l_linenumber") > 4, 5.09).otherwise(3.01)), "proc", True)
_adapter("d03_optical_cloud_bits", "CASE WHEN l_tax > 0.06 THEN 1024 WHEN l_discount > 0.05 THEN 2048 ELSE 0 END", lambda: C.pack_cloud_bits(F.col("l_tax") > 0.06, F.col("l_discount") > 0.05), "proc", False)
_adapter("d04_radar_backscatter", "CASE WHEN l_discount > 0 THEN 10 * log10(l_discount) END", lambda: C.decibels(F.col("l_discount")), "scene", True)
_adapter("d06_daily_bands_keep_fill", "CASE WHEN l_tax > 0.07 THEN -28672 WHEN l_quantity <> 7 THEN l_quantity END", lambda: F.when(F.col("l_tax") > 0.07, -28672).when(F.col("l_quantity") != 7, F.col("l_quantity")), "proc", True)
_adapter("d07_scaled_bands_keep_fill", "CASE WHEN l_quantity = 7 THEN 7 ELSE l_quantity * 0.5 END", lambda: C.scaled_keeping_fill(F.col("l_quantity"), 0.5, 7.0), "proc", True)
_adapter("d10_land_cover", "CASE WHEN l_linenumber < 7 THEN l_linenumber * 10 END", lambda: F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") * 10), "scene", False)


@query(f"""WITH {POINTS}, s AS (SELECT id, id % 2 AS pass, lon, lat, CASE WHEN nation <> 7 THEN nation * 0.5 + 1 END AS v FROM points), g AS (SELECT s_suppkey AS grid_id, s_suppkey // 7 AS cell, (s_suppkey * 53 % 360) - 180.0 AS x, s_acctbal / 100 - 45 AS y FROM supplier),
d AS (SELECT g.grid_id, cell, p.pass, s.v, row_number() OVER (PARTITION BY g.grid_id, p.pass ORDER BY (g.x - s.lon) ^ 2 + (g.y - s.lat) ^ 2, s.id) AS k FROM g CROSS JOIN (SELECT DISTINCT id % 2 AS pass FROM points) p LEFT JOIN s ON s.pass = p.pass),
n AS (SELECT * FROM d WHERE k = 1), c AS (SELECT cell, pass, count(v) AS c FROM n GROUP BY ALL), b AS (SELECT cell, arg_min(pass, (-c, pass)) AS pass FROM c GROUP BY cell)
SELECT n.cell, n.grid_id, n.pass, n.v AS value FROM n JOIN b ON n.cell = b.cell AND n.pass = b.pass""")
def d05_swath_radiance(spark, sf_dir):
    swath = points(spark, sf_dir).select(F.col("id").alias("point_id"), (F.col("id") % 2).alias("pass"), F.col("lon").alias("x"), F.col("lat").alias("y"), C.decode_scaled(F.col("nation"), 7, 0.5, 1.0).alias("value"))
    grid = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("grid_id"), F.floor(F.col("s_suppkey") / 7).alias("cell"), ((F.col("s_suppkey") * 53 % 360) - F.lit(180.0)).alias("x"), (F.col("s_acctbal") / 100 - 45).alias("y"))
    every = grid.crossJoin(swath.select("pass").distinct())  # a day's passes are few
    found = J.nearest_point(every, swath, 20.0, "value", ["pass"]).join(grid.select("grid_id", "cell"), "grid_id")
    best = A.best_overpass(found, ["cell"], "pass", "value").select("cell", "pass")
    return found.join(best, ["cell", "pass"]).select("cell", "grid_id", "pass", "value")


@query(f"""WITH s AS ({ORACLE_SQL["w04_slope"]}), t AS (SELECT c_custkey AS target_id, c_custkey // 15 + 1 AS cell, CAST(floor(c_custkey % 97 / 10.0) AS BIGINT) AS y, CAST(floor(c_nationkey % 10 + 0.5) AS BIGINT) AS x, c_nationkey % 9 = 0 AS void FROM customer)
SELECT target_id, CASE WHEN NOT void THEN slope END AS slope FROM t LEFT JOIN s ON t.cell = s.cell AND t.y = s.y AND t.x = s.x""")
def d09_terrain(spark, sf_dir):
    native = _terrain(spark, sf_dir).select("cell", "y", "x", "slope")
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id"), (F.floor(F.col("c_custkey") / 15) + 1).alias("cell"), (F.col("c_custkey") % 97 / 10).alias("y"), (F.col("c_nationkey") % 10 + F.lit(0.5)).alias("x"), (F.col("c_nationkey") % 9 == 0).alias("void"))
    return J.nearest_pixels(target, native, ["cell"], "slope").select("target_id", r(F.when(~F.col("void"), F.col("slope"))).alias("slope"))


@query(f"""WITH {POINTS} SELECT id, CASE WHEN nation > 0 THEN CAST(printf('%.4f', lon) AS DOUBLE) END AS first_lon, CASE WHEN nation > 0 THEN CAST(printf('%.4f', lat + 2) AS DOUBLE) END AS top FROM points""")
def s10_metadata_footprints(spark, sf_dir):
    corner = lambda name: f'"CORNER_{name}_LON_PRODUCT": "%.4f", "CORNER_{name}_LAT_PRODUCT": "%.4f"'
    text = '{"LANDSAT_METADATA_FILE": {"PROJECTION_ATTRIBUTES": {' + ", ".join(corner(c) for c in ("UL", "UR", "LR", "LL")) + "}}}"
    right, top = F.col("lon") + 3, F.col("lat") + 2
    mtl = F.when(F.col("nation") > 0, F.format_string(text, "lon", top, right, top, right, "lat", "lon", "lat")).otherwise('{"LANDSAT_METADATA_FILE": {}}')
    rows = points(spark, sf_dir).select("id", N.mtl_footprint(mtl).alias("f"))
    return rows.select("id", F.get("f", F.lit(0))["lon"].alias("first_lon"), F.array_max(F.transform("f", lambda p: p["lat"])).alias("top"))


@query(f"""WITH {PX}, e AS (SELECT max(n) AS size FROM (SELECT count(*) AS n FROM px GROUP BY cell, t)) SELECT cell, t, count(*) AS n, count(*) = any_value(size) AS whole FROM px, e GROUP BY cell, t""")
def s18_checked_samples(spark, sf_dir):
    """Samples with as many pixels as the fullest one are whole, the others go back to the builder."""
    samples = pixels(spark, sf_dir).groupBy("cell", "t").agg(F.collect_list(F.struct("y", "x", "value")).alias("pixels"))
    size = pixels(spark, sf_dir).groupBy("cell", "t").count().agg(F.max("count")).first()[0]
    good, wrong = S.checked_samples(samples, {"pixels": size or 0})
    return good.withColumn("whole", F.lit(True)).unionByName(wrong.drop("wrong").withColumn("whole", F.lit(False))).select("cell", "t", F.size("pixels").cast("long").alias("n"), "whole")


@query(f"""WITH {PX}, b(t, band, "position") AS (VALUES (1, 'step1', 3), (2, 'step2', 6), (3, 'step3', 2), (4, 'step4', 5), (5, 'step5', 1), (6, 'step6', 4), (7, 'step7', 0)) SELECT cell, "position", band, count(*) AS n, md5(string_agg(CAST(round(coalesce(value, -9999) * 100) AS BIGINT), ',' ORDER BY y, x)) AS digest FROM px JOIN b ON px.t = b.t GROUP BY ALL""")
def s20_packed_cubes(spark, sf_dir):
    registry = spark.createDataFrame([(t, f"step{t}", t * 3 % 7) for t in range(1, 8)], "t int, band string, position int")
    packed = S.packed_bands(pixels(spark, sf_dir).join(F.broadcast(registry.select("t", "band")), "t"), registry, ["cell"])
    return packed.select("cell", "position", "band", F.size("values").cast("long").alias("n"), F.md5(F.concat_ws(",", F.transform("values", lambda v: F.round(v * 100).cast("long").cast("string")))).alias("digest"))


@query("""WITH m AS (SELECT source AS name, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY source) SELECT * FROM m UNION ALL SELECT 'OVERALL', count(*), round(avg(n_chars), 4) FROM documents""")
def s22_results_with_overall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    facts = [F.count(F.lit(1)).alias("n"), r(F.avg("n_chars")).alias("mean")]
    return S.with_overall(docs.groupBy(F.col("source").alias("name")).agg(*facts), "name", docs.agg(*facts))


_BOX = ((0.0, 10.0), (40.0, 10.0), (40.0, 45.0), (0.0, 45.0))


@query(f"""WITH {POINTS}, o AS (SELECT id, greatest(lon, 0) AS x1, greatest(lat, 10) AS y1, least(lon + 50, 40) AS x2, least(lat + 30, 45) AS y2 FROM points)
SELECT id, round(greatest(radians(x2 - x1), 0) * greatest(sin(radians(y2)) - sin(radians(y1)), 0) * 6371.007181 ^ 2, 2) AS km2, x2 > x1 AND y2 > y1 AS overlaps FROM o""")
def f05_clipped_areas(spark, sf_dir):
    x, y = F.col("lon"), F.col("lat")
    ring = F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in ((x, y), (x + 50, y), (x + 50, y + 30), (x, y + 30))])
    clipped = K.clip_to_convex(points(spark, sf_dir).select("id", ring.alias("ring")), "ring", _BOX)
    return clipped.select("id", G.polygon_area_km2(F.col("ring")).alias("km2")).select("id", r("km2", 2).alias("km2"), (F.col("km2") > 0).alias("overlaps"))


@query(f"""WITH {POINTS} SELECT id, round(lon, 4) AS lon, round(lat, 4) AS lat FROM points WHERE ({_ring_sql('lon', 'lat')}) % 2 = 1""")
def f07_clip_by_centres(spark, sf_dir):
    return K.pixels_inside(points(spark, sf_dir), "lon", "lat", _RING).select("id", r("lon").alias("lon"), r("lat").alias("lat"))


@query(f"""WITH {POINTS} SELECT id FROM points WHERE lon + 2 >= 0 AND lon - 2 <= 40 AND lat + 2 >= 10 AND lat - 2 <= 45""")
def f08_clip_all_touched(spark, sf_dir):
    return K.pixels_touching(points(spark, sf_dir), "lon", "lat", 2.0, _BOX).select("id")


@query(f"""WITH {POINTS} SELECT id FROM points WHERE lon BETWEEN -0.15 AND 40.15 AND lat BETWEEN 9.85 AND 45.15""")
def f09_clip_slab(spark, sf_dir):
    return K.slab(points(spark, sf_dir), "lon", "lat", _BOX).select("id")


@query(f"""WITH {POINTS}, g AS (SELECT nation, CAST(floor(lat) AS BIGINT) AS "row", CAST(floor(lon) AS BIGINT) AS col, id, lon > 0 AND lon < 40 AS inside FROM points),
w AS (SELECT nation, min("row") AS r1, max("row") AS r2, min(col) AS c1, max(col) AS c2 FROM g WHERE inside GROUP BY nation) SELECT g.id, g.nation FROM g JOIN w ON g.nation = w.nation AND "row" BETWEEN r1 - 10 AND r2 + 10 AND col BETWEEN c1 - 10 AND c2 + 10""")
def f10_swath_members(spark, sf_dir):
    rows = points(spark, sf_dir).select("id", "nation", F.floor("lat").alias("row"), F.floor("lon").alias("col"), "lon")
    return K.window_members(rows, ["nation"], "row", "col", (F.col("lon") > 0) & (F.col("lon") < 40)).select("id", "nation")


@query(f"""WITH {POINTS}, b AS (SELECT s_suppkey AS id, (s_suppkey * 53 % 360) - 180.0 AS x1, s_acctbal / 100 - 45 AS y1, (s_suppkey * 53 % 360) - 175.0 AS x2, s_acctbal / 100 - 40 AS y2 FROM supplier)
SELECT id FROM points p WHERE NOT EXISTS (SELECT 1 FROM b WHERE p.lon BETWEEN b.x1 AND b.x2 AND p.lat BETWEEN b.y1 AND b.y2)""")
def j12_excluded_regions(spark, sf_dir):
    p = points(spark, sf_dir)
    left = p.select(F.col("id").alias("left_id"), F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), F.col("lon").alias("max_x"), F.col("lat").alias("max_y"))
    x, y = (F.col("s_suppkey") * 53 % 360) - F.lit(180.0), F.col("s_acctbal") / 100 - 45
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("right_id"), x.alias("min_x"), y.alias("min_y"), (x + 5).alias("max_x"), (F.col("s_acctbal") / 100 - 40).alias("max_y"))
    return p.join(J.box_join(left, right, 5.0).select(F.col("left_id").alias("id")), "id", "left_anti").select("id")


@query(f"""WITH {SCENES} SELECT DISTINCT tile, day FROM scenes WHERE (tile, day) NOT IN (SELECT (tile, day) FROM scenes WHERE priority <= 3)""")
def j15_needed_but_missing(spark, sf_dir):
    s = scenes(spark, sf_dir)
    return J.not_yet_done(s.select("tile", "day").distinct(), s.where("priority <= 3"), ["tile", "day"]).select("tile", "day")


@query("""SELECT coalesce(CAST(l.quality AS VARCHAR), 'none') AS kind, d.lang, count(*) AS n, round(avg(d.n_chars), 4) AS mean FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def j16_results_enriched(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "lang", "n_chars").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("kind"), "lang").agg(F.count(F.lit(1)).alias("n"), r(F.avg("n_chars")).alias("mean"))


@query(f"""WITH {PX} SELECT cell, t, y // 5 AS by, x // 5 AS bx, round(avg(value), 4) AS mean, max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS masked FROM px GROUP BY ALL""")
def a05_block_mean_and_mask(spark, sf_dir):
    return A.block_down_sample(pixels(spark, sf_dir), ["cell", "t"], "value", 5, 5).select("cell", "t", "by", "bx", r("mean").alias("mean"), F.col("mask").alias("masked"))


@query(f"""WITH {PX} SELECT cell, t, count(value) AS n_valid, max(CASE WHEN value IS NOT NULL THEN y END) AS reach FROM px GROUP BY cell, t HAVING count(value) < 45 OR coalesce(max(CASE WHEN value IS NOT NULL THEN y END), -1) < 9""")
def a31_zero_signal_audit(spark, sf_dir):
    return A.zero_signal(pixels(spark, sf_dir), ["cell", "t"], "value", "y", 45, 9)


@query(f"""WITH {OBS} SELECT day, string_agg(DISTINCT band, ',' ORDER BY band) AS bands FROM obs WHERE value IS NOT NULL GROUP BY day""")
def a34_label_sets(spark, sf_dir):
    return observations(spark, sf_dir).where("value is not null").transform(A.label_sets, "day", "band")


@query("""SELECT 'document' AS kind, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'event', event_type, count(*) FROM events WHERE event_type <> 'error' GROUP BY event_type""")
def g03_manifest_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), "source").where("source is not null")
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_type").alias("source"))
    return docs.unionByName(events.where("source <> 'error'")).groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OBS}, b(band) AS (VALUES ('view'), ('purchase'), ('never'), ('nowhere')) SELECT band FROM b WHERE band NOT IN (SELECT band FROM obs)""")
def g07_placeholder_bands(spark, sf_dir):
    registry = spark.createDataFrame([("view",), ("purchase",), ("never",), ("nowhere",)], "band string")
    return J.not_yet_done(registry, observations(spark, sf_dir).select("band").distinct(), ["band"]).select("band")


@query(f"""WITH {SCENES}, c AS (SELECT l_orderkey AS scene, 100.0 * count_if(l_tax > 0.05) / count(*) AS share FROM lineitem GROUP BY 1),
s AS (SELECT scene, tile, share, share < CASE WHEN scene % 2 = 0 THEN 10 ELSE 20 END AS clear FROM scenes JOIN c USING (scene))
SELECT tile, count(*) AS n, count_if(share > 50) AS cloudy, count_if(clear) AS clear FROM s WHERE share > 50 OR clear GROUP BY tile""")
def f17_cloud_cover_scenes(spark, sf_dir):
    """Cloudy and clear scenes of each tile, by the share of their pixels that is cloudy."""
    share = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scene")).agg((100 * F.avg((F.col("l_tax") > 0.05).cast("double"))).alias("share"))
    sensor = F.when(F.col("scene") % 2 == 0, "sentinel2").otherwise("landsat")
    kinds = K.cloud_kinds(scenes(spark, sf_dir).join(share, "scene").withColumn("sensor", sensor), "share", "sensor")
    return kinds.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "cloudy").alias("cloudy"), F.count_if(F.col("kind") == "clear").alias("clear"))


@query(f"""WITH {PX} SELECT cell, t, y * 2 + a AS "row", x * 2 + b AS col, round(value, 2) AS value FROM px, range(2) u(a), range(2) v(b)""")
def m06_patches_on_mosaic(spark, sf_dir):
    from gridloom.operators.models import placed

    return placed(pixels(spark, sf_dir), 2).select("cell", "t", "row", "col", r("value", 2).alias("value"))


@query(f"""WITH {PX}, b AS (SELECT cell, t, y // 2 AS "by", x // 2 AS bx, avg(value) AS m, max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS mask FROM px GROUP BY ALL), i AS (SELECT * FROM b WHERE t < 7),
f AS (SELECT *, last_value(m IGNORE NULLS) OVER w AS filled, coalesce(t - last_value(CASE WHEN m IS NOT NULL THEN t END IGNORE NULLS) OVER w, -1) AS age FROM i WINDOW w AS (PARTITION BY cell, "by", bx ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a1 AS (SELECT *, coalesce(filled, quantile_disc(filled, 0.5) OVER (PARTITION BY cell, "by", bx)) AS v1 FROM f), a2 AS (SELECT *, coalesce(v1, quantile_disc(v1, 0.5) OVER (PARTITION BY cell, t)) AS v2 FROM a1), a3 AS (SELECT *, coalesce(v2, avg(v2) OVER ()) AS v FROM a2)
SELECT a3.cell, a3."by", a3.bx, count(*) AS n, round(sum(v), 5) AS total, sum(age) AS ages, sum(a3.mask) AS masked, round(sum(v * sin(2 * pi() * a3.t / 12)), 6) AS by_month, round(any_value(l.m), 5) AS label
FROM a3 JOIN b l ON l.t = 7 AND l.cell = a3.cell AND l."by" = a3."by" AND l.bx = a3.bx AND l.m IS NOT NULL GROUP BY ALL""")
def m03_training_rows(spark, sf_dir):
    """Blocks of six steps as features, carried, aged and filled; the seventh step is the label."""
    px = pixels(spark, sf_dir)
    labels = A.block_down_sample(px.where("t = 7"), ["cell"], "value", 2, 2).withColumnRenamed("mean", "label")
    rows = T.training_rows(px.where("t < 7"), labels, ["cell"], "t", "value", F.col("t"), 2)
    total = lambda f: F.aggregate(F.transform("features", f), F.lit(0.0), lambda a, v: a + v)
    whole = lambda c: F.aggregate(F.transform("features", lambda s: s[c].cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    sums = [r(total(lambda s: s["value"]), 5).alias("total"), whole("age").alias("ages"), whole("mask").alias("masked"), r(total(lambda s: s["value"] * s["month_sin"]), 6).alias("by_month")]
    return rows.select("cell", "by", "bx", F.size("features").cast("long").alias("n"), *sums, r("label", 5).alias("label"))
