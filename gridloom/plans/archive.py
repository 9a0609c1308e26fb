"""More registered queries: product names, projections, gates, resampling, requests, grids, models, adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import geometry as G
from gridloom.operators import aggregates as A
from gridloom.operators import clipping as K
from gridloom.operators import grids
from gridloom.operators import joins as J
from gridloom.operators import series as W
from gridloom.plans.queries import _LAT, _LON, _RING, OBS, POINTS, PX, SCENES, _ring_sql, observations, pixels, points, query, r, scenes, table
from gridloom.sources import names as N


@query(f"""WITH {SCENES} SELECT scene, day AS acq, (500 + priority) / 100 AS baseline, 'T11UPS' AS tile, day + 3 AS proc FROM scenes""")
def s03_granule_names(spark, sf_dir):
    number = (F.col("priority") + 500).cast("string")
    name = F.concat(F.lit("S2A_MSIL1C_"), F.date_format("day", "yyyyMMdd"), F.lit("T184731_N0"), number, F.lit("_R070_T11UPS_"), F.date_format(F.date_add("day", 3), "yyyyMMdd"), F.lit("T202515.SAFE"))
    return scenes(spark, sf_dir).select("scene", N.sentinel2_name(name).alias("n")).select("scene", "n.acq", "n.baseline", "n.tile", "n.proc")


@query(f"""WITH {SCENES} SELECT scene, day AS acq, printf('%04X', scene % 65536) AS uid FROM scenes""")
def s04_radar_names(spark, sf_dir):
    day = F.date_format("day", "yyyyMMdd")
    name = F.concat(F.lit("s1_grd_S1A_IW_GRDH_1SDV_"), day, F.lit("T013000_"), day, F.lit("T013025_048912_05E1AB_"), F.lpad(F.hex(F.col("scene") % 65536), 4, "0"), F.lit(".tif"))
    return scenes(spark, sf_dir).select("scene", N.sentinel1_name(name).alias("n")).select("scene", "n.acq", "n.uid")


@query(f"""WITH {POINTS}, t AS (SELECT id, nation, CAST(printf('%.4f', lat) AS DOUBLE) AS lat, CAST(printf('%.4f', lon) AS DOUBLE) AS lon, CAST(printf('%.4f', lat + 1) AS DOUBLE) AS top FROM points)
SELECT id, CASE WHEN nation % 5 > 0 THEN lon END AS first_lon, CASE WHEN nation % 5 > 0 THEN top END AS max_lat, CASE WHEN nation % 5 > 0 THEN 3 END AS n FROM t""")
def s11_gml_footprints(spark, sf_dir):
    text = F.format_string("%.4f,%.4f %.4f,%.4f %.4f", "lat", "lon", F.col("lat") + 1, "lon", "lat")
    text = F.when(F.col("nation") % 5 > 0, F.concat(text, F.format_string(",%.4f", F.col("lon") + 1))).otherwise(text)
    g = F.col("g")
    rows = points(spark, sf_dir).select("id", N.gml_footprint(text).alias("g"))
    return rows.select("id", F.get(g, F.lit(0))["lon"].alias("first_lon"), F.array_max(F.transform(g, lambda c: c["lat"])).alias("max_lat"), F.when(g.isNotNull(), F.size(g)).alias("n"))


@query(f"""WITH {SCENES} SELECT scene, CASE WHEN priority < 4 THEN CAST('4.0' || priority AS DOUBLE) ELSE (500 + priority) / 100 END AS baseline FROM scenes""")
def s13_manifest_baseline(spark, sf_dir):
    xml = F.when(F.col("priority") < 4, F.concat(F.lit("<m><b>4.0"), F.col("priority").cast("string"), F.lit("</b></m>"))).otherwise("<m/>")
    name = F.concat(F.lit("S2B_MSIL1C_20240105T184731_N0"), (F.col("priority") + 500).cast("string"), F.lit("_R070_T11UPS_20240105T202515.SAFE"))
    return scenes(spark, sf_dir).select("scene", N.manifest_baseline(xml, "/m/b", name).alias("baseline"))


@query(f"""WITH {SCENES}, q AS (SELECT DISTINCT tile, day FROM scenes WHERE priority = 5), i AS (SELECT tile, day, arg_min(scene, (priority, scene)) AS scene FROM scenes WHERE priority < 5 GROUP BY ALL)
SELECT q.tile, q.day, coalesce(i.scene, -9999) AS scene FROM q LEFT JOIN i ON q.tile = i.tile AND q.day = i.day""")
def s25_collection_request(spark, sf_dir):
    s = scenes(spark, sf_dir)
    first = A.first_valid(s.where("priority < 5"), ["tile", "day"], [F.col("priority"), F.col("scene")], "scene")
    return J.complete_calendar(s.where("priority = 5").select("tile", "day").distinct(), first, ["tile", "day"], "scene", -9999)


_SENSORS = [(0, "L", 100000.0), (1, "S", 10000.0), (2, "V", 1000.0)]


@query(f"""WITH {POINTS}, s(k, sensor, metres) AS (VALUES (0, 'L', 100000.0::DOUBLE), (1, 'S', 10000.0), (2, 'V', 1000.0)) SELECT id, sensor, kind, round(lat - metres / {_LAT}, 6) AS min_lat, round(lon + metres / {_LON}, 6) AS max_lon, CAST(metres / 1000 AS INTEGER) AS scale FROM points JOIN s ON nation % 3 = k, (VALUES ('cloudy'), ('clear')) v(kind)""")
def s26_pair_requests(spark, sf_dir):
    sensors = spark.createDataFrame(_SENSORS, "k int, sensor string, metres double")
    rows = points(spark, sf_dir).withColumn("k", F.col("nation") % 3).join(F.broadcast(sensors), "k")
    boxes = rows.withColumn("box", C.box_around(F.col("lat"), F.col("lon"), F.col("metres"))).withColumn("kind", F.explode(F.array(F.lit("cloudy"), F.lit("clear"))))
    return boxes.select("id", "sensor", "kind", r("box.min_lat", 6).alias("min_lat"), r("box.max_lon", 6).alias("max_lon"), (F.col("metres") / 1000).cast("int").alias("scale"))


@query(f"""WITH {POINTS} SELECT id, i AS "row", j AS col FROM points, range(5) a(i), range(5) b(j) WHERE i < greatest(floor((1 + id % 7) / 1.5), 1) AND j < greatest(floor((id % 5) / 1.5), 1)""")
def p14_split_boxes(spark, sf_dir):
    parts = G.split_box(F.col("id") % 5, 1 + F.col("id") % 7, 1.5)
    return points(spark, sf_dir).select("id", F.explode(parts).alias("p")).select("id", F.col("p.row").cast("long").alias("row"), F.col("p.col").cast("long").alias("col"))


_E = 2 * G._N**0.5 / (1 + G._N)
_SUM_X = " + ".join(f"{a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(G._FORWARD, 1))
_SUM_Y = " + ".join(f"{a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(G._FORWARD, 1))


@query(f"""WITH {POINTS}, z AS (SELECT id, lat, lon, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS zone FROM points), a AS (SELECT *, radians(lon - (zone * 6 - 183)) AS d, sinh(atanh(sin(radians(lat))) - {_E!r} * atanh({_E!r} * sin(radians(lat)))) AS t FROM z),
b AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM a)
SELECT id, zone, round(500000 + {G._RADIUS!r} * (eta + {_SUM_X}), 3) AS easting, round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + {G._RADIUS!r} * (xi + {_SUM_Y}), 3) AS northing, round(lat, 5) AS lat, round(lon, 5) AS lon FROM b""")
def p16_utm_round_trip(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("zone", G.utm_zone(F.col("lon"))).withColumn("u", G.to_utm(F.col("lat"), F.col("lon"), F.col("zone")))
    back = G.from_utm(F.col("u.easting"), F.col("u.northing"), F.col("zone"), F.col("lat") < 0)
    return rows.withColumn("b", back).select("id", "zone", r("u.easting", 3).alias("easting"), r("u.northing", 3).alias("northing"), (r("b.lat", 5) + 0.0).alias("lat"), (r("b.lon", 5) + 0.0).alias("lon"))


@query(f"""WITH {PX} SELECT cell, t, y - oy AS y, x - ox AS x, value FROM (SELECT *, ('0x' || substr(md5('crop|' || cell || '|y'), 1, 8))::BIGINT % 5 AS oy, ('0x' || substr(md5('crop|' || cell || '|x'), 1, 8))::BIGINT % 5 AS ox FROM px) WHERE y >= oy AND y < oy + 6 AND x >= ox AND x < ox + 6""")
def p24_random_subset(spark, sf_dir):
    start = lambda axis: G.hash_number("crop", F.col("cell"), F.lit(axis)) % 5
    rows = pixels(spark, sf_dir).select("cell", "t", (F.col("y") - start("y")).alias("y"), (F.col("x") - start("x")).alias("x"), "value")
    return rows.where("y between 0 and 5 and x between 0 and 5")


@query(f"""WITH {PX}, e AS (SELECT cell, t, quantile_cont(value, 0.02) AS low, quantile_cont(value, 0.98) AS high FROM px GROUP BY ALL) SELECT cell, t, y, x, round(CASE WHEN value IS NULL OR high = low THEN 0 ELSE greatest(0, least(1, (value - low) / (high - low))) * 255 END, 3) AS shade FROM px JOIN e USING (cell, t)""")
def p30_percentile_stretch(spark, sf_dir):
    px = pixels(spark, sf_dir)
    ends = px.groupBy("cell", "t").agg(F.percentile("value", 0.02).alias("low"), F.percentile("value", 0.98).alias("high"))
    share = (F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    shade = F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255)
    return px.join(ends, ["cell", "t"]).select("cell", "t", "y", "x", r(F.coalesce(shade, F.lit(0.0)), 3).alias("shade"))


@query(f"""WITH {OBS} SELECT band, t, count_if(value IS NULL OR band IN ('view', 'error') OR t < m) AS masked, count_if(value IS NULL OR (t = m AND band <> 'click')) AS masked_on_day FROM obs, (SELECT max(t) AS m FROM obs) GROUP BY ALL""")
def p31_ablation_masks(spark, sf_dir):
    obs = observations(spark, sf_dir)
    last = F.broadcast(obs.agg(F.max("t").alias("m")))  # one row
    but_last = C.ablated(F.col("value"), F.col("band"), F.col("t"), hidden=("view", "error"), first=F.col("m"))
    on_last = C.ablated(F.col("value"), F.col("band"), F.col("t"), only=("click",), last=F.col("m"))
    return obs.join(last).groupBy("band", "t").agg(F.count_if(but_last).alias("masked"), F.count_if(on_last).alias("masked_on_day"))


def _meet_sql() -> str:
    out = []
    for (x1, y1), (x2, y2) in zip(_RING, [*_RING[1:], _RING[0]]):
        ends = [f"(({e} - ({s})) / ({d}))" for e, s, d in (("x1", x1, x2 - x1), ("x2", x1, x2 - x1), ("y1", y1, y2 - y1), ("y2", y1, y2 - y1))]
        out.append(f"greatest(0, least({ends[0]}, {ends[1]}), least({ends[2]}, {ends[3]})) <= least(1, greatest({ends[0]}, {ends[1]}), greatest({ends[2]}, {ends[3]}))")
    return " OR ".join(f"({c})" for c in out)


@query(f"""WITH {POINTS}, b AS (SELECT id, lon AS x1, lat AS y1, lon + 4 AS x2, lat + 3 AS y2 FROM points), m AS (SELECT id, ({_ring_sql('x1', 'y1')}) % 2 = 1 AS corner, {_meet_sql()} AS met FROM b) SELECT id, corner AND NOT met AS inside, corner OR met AS touched FROM m""")
def f02_boxes_in_polygon(spark, sf_dir):
    lon, lat = F.col("lon"), F.col("lat")
    inside, touched = G.box_in_polygon(lon, lat, lon + 4, lat + 3, _RING)
    return points(spark, sf_dir).select("id", inside.alias("inside"), touched.alias("touched"))


@query(f"""WITH {POINTS}, o AS (SELECT id, greatest(lon, 0) AS x1, greatest(lat, 10) AS y1, least(lon + 5, 40) AS x2, least(lat + 5, 40.01) AS y2 FROM points), a AS (SELECT id, greatest(radians(x2 - x1), 0) * greatest(sin(radians(y2)) - sin(radians(y1)), 0) * (6371.007181e0 * 6371.007181e0) AS km2 FROM o)
SELECT id, round(km2, 3) AS km2, CASE WHEN km2 <= 0 THEN 'SKIP_NO_OVERLAP' WHEN km2 < 1000 THEN 'SKIP_DEGENERATE_OVERLAP' ELSE 'CLIP' END AS action FROM a""")
def f04_overlap_gate(spark, sf_dir):
    lon, lat, lit = F.col("lon"), F.col("lat"), F.lit
    km2 = G.box_area_km2(F.greatest(lon, lit(0.0)), F.greatest(lat, lit(10.0)), F.least(lon + 5, lit(40.0)), F.least(lat + 5, lit(40.01)))
    return points(spark, sf_dir).select("id", r(km2, 3).alias("km2"), G.overlap_action(km2, 1000.0).alias("action"))


@query(f"""WITH {PX}, w AS (SELECT cell, min(y) - 2 AS y1, max(y) + 2 AS y2, min(x) - 2 AS x1, max(x) + 2 AS x2 FROM px WHERE value > 90000 GROUP BY cell) SELECT px.cell, t, y, x, value FROM px JOIN w ON px.cell = w.cell AND y BETWEEN y1 AND y2 AND x BETWEEN x1 AND x2""")
def f10_swath_window(spark, sf_dir):
    rows = pixels(spark, sf_dir).select("cell", "t", F.col("y").alias("row"), F.col("x").alias("col"), "value")
    kept = K.window_members(rows, ["cell"], "row", "col", F.coalesce(F.col("value") > 90000, F.lit(False)), 2)
    return kept.select("cell", "t", F.col("row").alias("y"), F.col("col").alias("x"), "value")


@query(f"""WITH {PX} SELECT kind, count(*) AS n FROM (SELECT cell, t, CASE WHEN count(value) = 0 THEN 'missing' WHEN count(value) / 100 >= 0.25 THEN 'present' ELSE 'truncated' END AS kind FROM px GROUP BY ALL) GROUP BY kind""")
def f14_extent_plausibility(spark, sf_dir):
    return A.extent_kinds(pixels(spark, sf_dir), ["cell", "t"], "value", 100).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def j01_pairing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(f"""WITH {PX}, t AS (SELECT c_custkey AS target_id, c_custkey // 15 + 1 AS cell, c_custkey % 7 + 1 AS t, (c_custkey % 90) / 9.0 AS y, (c_custkey % 70) / 8.0 AS x FROM customer) SELECT target_id, value FROM t LEFT JOIN px ON px.cell = t.cell AND px.t = t.t AND px.y = floor(t.y) AND px.x = floor(t.x)""")
def j07_nearest_resample(spark, sf_dir):
    k = F.col("c_custkey")
    target = table(spark, sf_dir, "customer").select(k.alias("target_id"), (F.floor(k / 15) + 1).alias("cell"), (k % 7 + 1).cast("int").alias("t"), ((k % 90) / F.lit(9.0)).alias("y"), ((k % 70) / F.lit(8.0)).alias("x"))
    return J.nearest_pixels(target, pixels(spark, sf_dir), ["cell", "t"], "value").select("target_id", "value")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def j14_copy_matching(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query(f"""WITH {PX} SELECT a.cell, count(*) AS n, round(sqrt(avg((a.value - b.value) ^ 2)), 4) AS rmse FROM px a JOIN px b ON a.cell = b.cell AND a.y = b.y AND a.x = b.x AND a.t + 1 = b.t WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.cell""")
def j18_prediction_and_label(spark, sf_dir):
    px = pixels(spark, sf_dir)
    both = J.paired_in_time(px, px, ["cell", "y", "x"], "t", "value")
    return A.regression_metrics(both, "label", "prediction", ["cell"]).select("cell", "n", r("rmse").alias("rmse"))


@query(f"""WITH {POINTS} SELECT id, CASE WHEN lon <= 30 AND lon + 3 >= 0 AND lat <= 20 AND lat + 2 >= 0 THEN 'test' ELSE 'train' END AS part FROM points""")
def j20_region_split(spark, sf_dir):
    lon, lat = F.col("lon"), F.col("lat")
    region = {"min_x": 0.0, "max_x": 30.0, "min_y": 0.0, "max_y": 20.0}
    return J.region_split(points(spark, sf_dir), region, {"min_x": lon, "max_x": lon + 3, "min_y": lat, "max_y": lat + 2}).select("id", "part")


@query(f"""WITH {PX}, s AS (SELECT cell, t, ky, kx, value, (least(ky * 10 + 10, y * 3 + 3) - greatest(ky * 10, y * 3)) * (least(kx * 10 + 10, x * 3 + 3) - greatest(kx * 10, x * 3)) AS w FROM px, range(3) a(ky), range(3) b(kx) WHERE ky BETWEEN y * 3 // 10 AND (y * 3 + 2) // 10 AND kx BETWEEN x * 3 // 10 AND (x * 3 + 2) // 10)
SELECT cell, t, ky, kx, round(sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END), 4) AS value FROM s GROUP BY ALL""")
def a06_area_weighted_resample(spark, sf_dir):
    spans = lambda c: F.explode(F.sequence(F.floor(F.col(c) * 3 / 10), F.floor((F.col(c) * 3 + 2) / 10)))
    share = lambda c, k: F.least(F.col(k) * 10 + 10, F.col(c) * 3 + 3) - F.greatest(F.col(k) * 10, F.col(c) * 3)
    rows = pixels(spark, sf_dir).withColumn("ky", spans("y")).withColumn("kx", spans("x")).withColumn("w", share("y", "ky") * share("x", "kx"))
    return rows.groupBy("cell", "t", "ky", "kx").agg(r(F.sum(F.col("w") * F.col("value")) / F.sum(F.when(F.col("value").isNotNull(), F.col("w")))).alias("value"))


@query("""SELECT l_returnflag, round(quantile_cont(CASE WHEN l_tax > 0.04 THEN l_extendedprice END, 0.95) / quantile_cont(CASE WHEN l_tax <= 0.04 THEN l_extendedprice END, 0.95), 6) AS high, round(quantile_cont(CASE WHEN l_tax > 0.04 THEN l_extendedprice END, 0.5) / quantile_cont(CASE WHEN l_tax <= 0.04 THEN l_extendedprice END, 0.5), 6) AS mid FROM lineitem GROUP BY 1""")
def a28_band_magnitude(spark, sf_dir):
    found = A.band_magnitude(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", F.col("l_tax") > 0.04, (0.95, 0.5))
    return found.select("l_returnflag", r("r0", 6).alias("high"), r("r1", 6).alias("mid"))


@query(f"""WITH {OBS} SELECT band, round(avg(value), 6) AS mean, count(value) AS weight FROM obs GROUP BY band""")
def a29_running_mean(spark, sf_dir):
    daily = observations(spark, sf_dir).groupBy("band", "day").agg(F.avg("value").alias("mean"), F.count("value").alias("weight"))
    return A.merge_means(daily, ["band"], "mean", "weight").withColumn("mean", r("mean", 6))


@query(f"""WITH {POINTS} SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, count(DISTINCT nation) AS kinds FROM points""")
def a32_extent_union(spark, sf_dir):
    return A.extent_union(points(spark, sf_dir), "lon", "lat", "nation")


@query(f"""WITH {SCENES} SELECT tile, m, scene FROM (SELECT tile, date_trunc('month', day)::DATE AS m, scene, row_number() OVER (PARTITION BY tile, date_trunc('month', day) ORDER BY md5('month|' || scene), scene) AS k FROM scenes) WHERE k = 1""")
def w09_one_scene_a_month(spark, sf_dir):
    s = scenes(spark, sf_dir).withColumn("m", F.trunc("day", "month"))
    return W.quota(s, ["tile", "m"], ["scene"], 1, "month").select("tile", "m", "scene")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_custkey LIMIT 30""")
def k04_cap_on_started(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.not_yet_done(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"]).orderBy("c_custkey").limit(30)


@query(f"""WITH {POINTS}, k AS (SELECT id, CAST(floor(lat / 5) AS BIGINT) AS iy, CAST(floor(lon / 5) AS BIGINT) AS ix FROM points) SELECT (iy + 18) * 72 + ix + 36 AS cell_id, min(id) AS first_id, count(*) AS n FROM k GROUP BY iy, ix""")
def g01_distinct_cells(spark, sf_dir):
    """Ids follow from a cell's row and column (south to north, west to east), so no global order is needed."""
    cells = grids.distinct_cells(points(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), 5)
    return cells.select(((F.col("row") + 18) * 72 + F.col("col") + 36).alias("cell_id"), "first_id", "n")


@query(f"""WITH {PX}, f AS (SELECT cell, t, y, x, last_value(value IGNORE NULLS) OVER w AS v, coalesce(t - last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w, -1) AS age FROM px WINDOW w AS (PARTITION BY cell, y, x ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT cell, y, x, md5(string_agg(t || ':' || coalesce(v::DECIMAL(18, 2)::VARCHAR, 'none') || ':' || age, ',' ORDER BY t)) AS features FROM f GROUP BY ALL""")
def g02_feature_vectors(spark, sf_dir):
    carried = W.forward_fill(pixels(spark, sf_dir), ["cell", "y", "x"], "t", "value")
    listed = carried.groupBy("cell", "y", "x").agg(F.array_sort(F.collect_list(F.struct("t", "filled", "age"))).alias("f"))
    text = F.transform("f", lambda s: F.concat_ws(":", s["t"].cast("string"), F.coalesce(s["filled"].cast("decimal(18,2)").cast("string"), F.lit("none")), s["age"].cast("string")))
    return listed.select("cell", "y", "x", F.md5(F.concat_ws(",", text)).alias("features"))


_HULL = ((-60.0, -40.0), (70.0, -50.0), (120.0, 10.0), (40.0, 45.0))


def _hull_sql(x: str, y: str) -> str:
    """Whether a place is inside of the convex area, on its left all around."""
    sides = zip(_HULL, [*_HULL[1:], _HULL[0]])
    return " AND ".join(f"({b[0] - a[0]}) * ({y} - ({a[1]})) - ({b[1] - a[1]}) * ({x} - ({a[0]})) >= 0" for a, b in sides)


def _apart_sql() -> str:
    """Whether a box lies beyond one side of the convex area: all its corners on the right of it, or the area beyond one of the box's sides."""
    x, y = [a[0] for a in _HULL], [a[1] for a in _HULL]
    sides = [" AND ".join(f"({b[0] - a[0]}) * ({cy} - ({a[1]})) - ({b[1] - a[1]}) * ({cx} - ({a[0]})) < 0" for cx in ("x1", "x2") for cy in ("y1", "y2")) for a, b in zip(_HULL, [*_HULL[1:], _HULL[0]])]
    return " OR ".join([*(f"({s})" for s in sides), f"x2 < {min(x)}", f"x1 > {max(x)}", f"y2 < {min(y)}", f"y1 > {max(y)}"])


@query(f"""WITH {POINTS}, g AS (SELECT (i + 5) * 18 + j + 6 AS cell_id, j * 10.0 AS x1, j * 10.0 + 10 AS x2, i * 10.0 AS y1, i * 10.0 + 10 AS y2 FROM range(-5, 5) a(i), range(-6, 12) b(j)), l AS (SELECT * FROM g WHERE NOT ({_apart_sql()}))
SELECT cell_id, x1 AS min_x, y1 AS min_y, count(id) AS n FROM l LEFT JOIN points ON lon >= x1 AND lon < x2 AND lat >= y1 AND lat < y2 GROUP BY ALL""")
def g05_lattice(spark, sf_dir):
    """The cells of the lattice that touch the area, and how many points lie in each."""
    cells = grids.lattice(spark, _HULL, 10.0)
    held = points(spark, sf_dir).groupBy((F.floor(F.col("lon") / 10) * 10.0).alias("min_x"), (F.floor(F.col("lat") / 10) * 10.0).alias("min_y")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(held, ["min_x", "min_y"], "left").select("cell_id", "min_x", "min_y", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {POINTS}, k AS (SELECT DISTINCT floor(lon / 5) * 5 AS x1, floor(lat / 5) * 5 AS y1 FROM points), c AS (SELECT * FROM k WHERE {_hull_sql('(x1 + 2.5)', '(y1 + 2.5)')}),
i AS (SELECT * FROM k WHERE ({_hull_sql('x1', 'y1')}) AND ({_hull_sql('(x1 + 5)', 'y1')}) AND ({_hull_sql('x1', '(y1 + 5)')}) AND ({_hull_sql('(x1 + 5)', '(y1 + 5)')}))
SELECT 'centre' AS rule, x1 AS min_x, y1 AS min_y FROM c UNION ALL SELECT 'inside', x1, y1 FROM i""")
def g06_sampled_grids(spark, sf_dir):
    samples = points(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    rules = [grids.build_grid("A", _HULL, 5.0, samples, fully_inside=inside).select(F.lit(name).alias("rule"), "min_x", "min_y") for name, inside in (("centre", False), ("inside", True))]
    return rules[0].unionByName(rules[1])


@query(f"""WITH {POINTS} SELECT id, nation, round(lat, 4) AS lat FROM points ORDER BY nation, lat, id""")
def k02_ordered_outputs(spark, sf_dir):
    return grids.in_order(points(spark, sf_dir), "nation", "lat", "id").select("id", "nation", r("lat").alias("lat"))


@query(f"""WITH {POINTS} SELECT CAST(floor(round(lat, 4)) AS BIGINT) AS "row", CAST(floor(round(lon, 4)) AS BIGINT) AS col, arg_min(nation, (CAST(floor((lon + 180) / 6) + 1 AS INTEGER) % 2, id)) AS value FROM points WHERE nation <> 7 GROUP BY ALL""")
def a11_combined_zones(spark, sf_dir):
    """Readings in two kinds of zones, each placed on the common grid from its own easting and northing."""
    zoned = points(spark, sf_dir).withColumn("zone", G.utm_zone(F.col("lon"))).withColumn("u", G.to_utm(F.col("lat"), F.col("lon"), F.col("zone")))
    back = G.from_utm(F.col("u.easting"), F.col("u.northing"), F.col("zone"), F.col("lat") < 0)
    on_grid = zoned.withColumn("b", back).select("id", (F.col("zone") % 2).alias("kind"), F.floor(F.round("b.lat", 4)).alias("row"), F.floor(F.round("b.lon", 4)).alias("col"), F.when(F.col("nation") != 7, F.col("nation")).alias("value"))
    return grids.combined_zones(on_grid, ["row", "col"], "kind", ["id"], "value")


@query(f"""WITH {POINTS}, s(name, first, last) AS (VALUES ('early', DATE '2024-01-10', DATE '2024-02-20'), ('late', DATE '2024-05-01', DATE '2024-06-15')) SELECT id, name AS season, first + CAST(('0x' || substr(md5('window|' || id || '|' || name), 1, 8))::BIGINT % (last - first - 6) AS INTEGER) AS first_day, round(lat - 5000 / {_LAT}, 6) AS min_lat FROM points, s""")
def x03_season_requests(spark, sf_dir):
    seasons = spark.createDataFrame([("early", "2024-01-10", "2024-02-20"), ("late", "2024-05-01", "2024-06-15")], "season string, first string, last string")
    rows = points(spark, sf_dir).crossJoin(F.broadcast(seasons.select("season", F.to_date("first").alias("first"), F.to_date("last").alias("last"))))  # a registry of two rows
    late = (G.hash_number("window", F.col("id"), F.col("season")) % (F.datediff("last", "first") - 6)).cast("int")
    return rows.select("id", "season", F.date_add("first", late).alias("first_day"), r(C.box_around(F.col("lat"), F.col("lon"), 5000)["min_lat"], 6).alias("min_lat"))


@query("""SELECT doc_id FROM documents ORDER BY md5('subset|' || doc_id), doc_id LIMIT 50""")
def x05_fixed_subset(spark, sf_dir):
    return W.sampled(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 50, "subset")


@query("""SELECT user_id, ts::DATE - CAST(7 - k AS INTEGER) AS first_day, count(*) AS n, round(avg(value), 6) AS mean FROM events, range(8) r(k) GROUP BY ALL""")
def t01_trailing_windows(spark, sf_dir):
    from gridloom.streaming.forms import trailing_windows

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return trailing_windows(e, "ts", ["user_id"], "value").select("user_id", F.to_date("start").alias("first_day"), "n", r("mean", 6).alias("mean"))


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*) AS n FROM lineitem""")
def m02_linear_regression(spark, sf_dir):
    from gridloom.operators.models import fit_linear

    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    model = fit_linear(rows, ["l_quantity"], "l_extendedprice")
    return rows.agg(F.lit(round(float(model.coefficients[0]), 3)).alias("slope"), F.lit(round(model.intercept, 2)).alias("intercept"), F.count(F.lit(1)).alias("n"))


_FETCHED = f"""WITH {SCENES}, p AS (SELECT l_suppkey AS cell, l_orderkey % 40 AS day, l_returnflag AS band, l_linenumber AS proc, l_orderkey AS scene, l_partkey AS tie, CASE WHEN l_quantity <> 0 AND l_tax < 0.07 THEN l_quantity * 0.01 + 0.5 END AS value FROM lineitem),
f AS (SELECT cell, day, band, arg_min(value, (-proc, scene, tie)) AS value FROM p WHERE value IS NOT NULL GROUP BY ALL), k AS (SELECT c.cell, d.day, b.band FROM (SELECT DISTINCT cell FROM p) c, (SELECT DISTINCT day FROM p) d, (SELECT DISTINCT band FROM p) b),
j AS (SELECT k.*, f.value FROM k LEFT JOIN f USING (cell, day, band)) """


def _fetched(spark, sf_dir, all_or_nothing):
    from gridloom.operators.adapters import fetch

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), (F.col("l_orderkey") % 40).alias("day"), F.col("l_returnflag").alias("band"), F.col("l_linenumber").alias("proc"), F.col("l_orderkey").alias("scene"), F.col("l_partkey").alias("tie"), F.when((F.col("l_quantity") != 0) & (F.col("l_tax") < 0.07), F.col("l_quantity") * 0.01 + 0.5).alias("value"))
    return fetch(rows, rows.select("cell").distinct(), rows.select("day").distinct(), rows.select("band").distinct(), [(-F.col("proc")).alias("p"), F.col("scene"), F.col("tie")], all_or_nothing).withColumn("value", r("value"))


@query(_FETCHED + "SELECT cell, day, band, round(CASE WHEN count(value) OVER (PARTITION BY cell, day) = count(*) OVER (PARTITION BY cell, day) THEN value END, 4) AS value FROM j")
def d01_whole_stacks(spark, sf_dir):
    return _fetched(spark, sf_dir, True)


@query(_FETCHED + "SELECT cell, day, band, round(value, 4) AS value FROM j")
def d08_bands_by_themselves(spark, sf_dir):
    return _fetched(spark, sf_dir, False)


@query("""WITH s AS (SELECT l_suppkey, row_number() OVER (ORDER BY md5('split|' || l_suppkey), l_suppkey) <= ceil(count(*) OVER () * 0.2) AS test FROM (SELECT DISTINCT l_suppkey FROM lineitem)), l AS (SELECT * FROM lineitem JOIN s USING (l_suppkey)), m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM l WHERE NOT test), p AS (SELECT l_suppkey, l_extendedprice AS y, a * l_quantity + b AS p FROM l, m WHERE test)
SELECT l_suppkey, count(*) AS n, round(sqrt(avg((y - p) ^ 2)), 2) AS rmse FROM p GROUP BY ROLLUP (l_suppkey)""")
def m04_predictions_by_sample(spark, sf_dir):
    from gridloom.operators.models import fit_linear, predicted

    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    parts = W.split_exact(rows, ["l_suppkey"], 0.2, "split")
    model = fit_linear(parts.where("part = 'train'"), ["l_quantity"], "l_extendedprice")
    scored = predicted(model, parts.where("part = 'test'"), ["l_quantity"], ["l_suppkey", "l_extendedprice"])
    return A.with_pooled(scored, "l_suppkey", "l_extendedprice", "prediction").withColumn("rmse", r("rmse", 2))


@query(f"""WITH {POINTS} SELECT id, CAST(2021 + ('0x' || substr(md5('year|' || id), 1, 8))::BIGINT % 3 AS INTEGER) AS y, make_date(2021 + ('0x' || substr(md5('year|' || id), 1, 8))::BIGINT % 3, 11, 15) + CAST(('0x' || substr(md5('day|' || id), 1, 8))::BIGINT % 81 AS INTEGER) AS first_day FROM points""")
def x01_winter_windows(spark, sf_dir):
    """Windows of eight days in a season that goes over the new year, 15 November to 10 February, of a random year."""
    window = G.random_window(F.col("id"), (2021, 2022, 2023), "11-15", "02-10", 8)
    return points(spark, sf_dir).select("id", window.alias("w")).select("id", F.col("w.year").alias("y"), "w.first_day")
