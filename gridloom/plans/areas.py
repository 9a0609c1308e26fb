"""Queries of points, boxes and areas against many polygons, concave and with holes.

Roles: suppliers are glaciers, notched stars with a hole; nations are countries, stars of twelve
corners; customers are points; customers' boxes are footprints.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import polygons as P
from gridloom.plans.queries import POINTS, points, query, r, table

#: Corners of a star of radius 1 (every second one nearer the middle), of a notched plate and its hole: shares of a radius.
_STAR = [(1.0, 0.0), (0.35, 0.2), (0.5, 0.87), (0.0, 0.4), (-0.5, 0.87), (-0.35, 0.2), (-1.0, 0.0), (-0.35, -0.2), (-0.5, -0.87), (0.0, -0.4), (0.5, -0.87), (0.35, -0.2)]
_PLATE = [(-1.0, -0.75), (1.0, -0.75), (1.0, 0.75), (0.25, 0.75), (0.0, -0.25), (-0.25, 0.75), (-1.0, 0.75)]
_HOLE = [(-0.75, -0.5), (-0.25, -0.5), (-0.5, 0.125)]
_GLACIER = (("s_suppkey * 53 % 360 - 180.0", "s_acctbal / 100 - 45", "(2.0 + s_suppkey % 5)", "s_suppkey"), (_PLATE, _HOLE), "supplier")
_COUNTRY = (("n_nationkey % 6 * 60 - 150.0", "n_nationkey // 6 * 25 - 40.0", "(12.0 + n_nationkey % 9)", "n_nationkey"), (_STAR,), "nation")


def _edges_sql(name: str, role) -> str:
    (x, y, size, key), rings, source = role
    sides = [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]])]
    values = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in sides)
    return f"""{name} AS (SELECT {key} AS polygon_id, {x} + a * {size} AS x1, {y} + b * {size} AS y1, {x} + c * {size} AS x2, {y} + d * {size} AS y2 FROM {source}, (VALUES {values}) v(a, b, c, d))"""


def _inside_sql(edges: str, points: str, x: str, y: str, key: str = "id") -> str:
    cut = f"((y1 > {y}) <> (y2 > {y}) AND {x} > (x2 - x1) * ({y} - y1) / (y2 - y1) + x1)"
    on = f"((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1) = 0 AND {x} BETWEEN least(x1, x2) AND greatest(x1, x2) AND {y} BETWEEN least(y1, y2) AND greatest(y1, y2))"
    return f"SELECT {key}, polygon_id FROM {points}, {edges} GROUP BY {key}, polygon_id HAVING count_if({cut}) % 2 = 1 OR bool_or({on})"


def polygons(spark, sf_dir, role):
    (x, y, size, key), rings, source = role
    # DuckDB's // of whole numbers is `div` in Spark.
    x, y, size, key = (F.expr(e.replace("n_nationkey // 6", "(n_nationkey div 6)")) for e in (x, y, size, key))
    corner = lambda c: F.struct((x + c[0] * size).cast("double").alias("x"), (y + c[1] * size).cast("double").alias("y"))
    return table(spark, sf_dir, source).select(key.alias("polygon_id"), F.array(*[F.array(*map(corner, ring)) for ring in rings]).alias("rings"))


def _places(spark, sf_dir):
    return points(spark, sf_dir).select(F.col("id").alias("point_id"), F.col("lon").cast("double").alias("x"), F.col("lat").alias("y"))


@query(f"WITH {POINTS}, {_edges_sql('e', _GLACIER)} SELECT id AS point_id, polygon_id FROM ({_inside_sql('e', 'points', 'lon', 'lat')})")
def j12_points_in_glaciers(spark, sf_dir):
    """Every point with every glacier that it lies in, not in the holes."""
    return P.points_in_polygons(_places(spark, sf_dir), polygons(spark, sf_dir, _GLACIER), 2.0)


@query(f"""WITH {POINTS}, {_edges_sql('e', _COUNTRY)}, {_edges_sql('g', _GLACIER)}, c AS ({_inside_sql('e', 'points', 'lon', 'lat')}), x AS ({_inside_sql('g', 'points', 'lon', 'lat')})
SELECT id AS point_id, min(polygon_id) AS country FROM c WHERE id NOT IN (SELECT id FROM x) GROUP BY id""")
def j12_country_without_glaciers(spark, sf_dir):
    """Points within a country and off its glaciers, where labels may be drawn."""
    places = _places(spark, sf_dir)
    land = P.points_in_polygons(places, polygons(spark, sf_dir, _COUNTRY), 5.0).groupBy("point_id").agg(F.min("polygon_id").alias("country"))
    return land.join(P.points_in_polygons(places, polygons(spark, sf_dir, _GLACIER), 2.0), "point_id", "left_anti")


_SIDES = ", ".join(f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)" for x in ("lon", "lon + 1.5") for y in ("lat", "lat + 1.0"))


@query(f"""WITH {POINTS}, {_edges_sql('e', _COUNTRY)}, c AS ({_inside_sql('e', 'points', 'lon', 'lat')}),
m AS (SELECT id FROM points, e WHERE least(x1, x2) <= lon + 1.5 AND greatest(x1, x2) >= lon AND least(y1, y2) <= lat + 1.0 AND greatest(y1, y2) >= lat AND least({_SIDES}) <= 0 AND greatest({_SIDES}) >= 0)
SELECT id AS box_id, CASE WHEN id IN (SELECT id FROM c UNION SELECT id FROM m) THEN 'test' ELSE 'train' END AS part FROM points""")
def j20_split_by_regions(spark, sf_dir):
    """Footprints that share ground with any region are kept for testing."""
    x, y = F.col("lon").cast("double"), F.col("lat")
    boxes = points(spark, sf_dir).select(F.col("id").alias("box_id"), x.alias("min_x"), y.alias("min_y"), (x + 1.5).alias("max_x"), (y + 1.0).alias("max_y"))
    return P.region_split(boxes, polygons(spark, sf_dir, _COUNTRY), 5.0).select("box_id", "part")


_A, _E2 = G.SEMI_MAJOR, G._E2
#: What is left of a plate right of -0.5, without hole and notch: y1, left1, right1, y2, left2, right2, read off its drawing.
_LEFT_OVER = [
    (-0.75, -0.5, 1.0, -0.5, -0.5, 1.0),
    (-0.5, -0.25, 1.0, -0.25, -0.35, 1.0),
    (-0.25, -0.35, 0.0, 0.125, -0.5, -0.09375),
    (-0.25, 0.0, 1.0, 0.125, 0.09375, 1.0),
    (0.125, -0.5, -0.09375, 0.75, -0.5, -0.25),
    (0.125, 0.09375, 1.0, 0.75, 0.25, 1.0),
]


def _q(lat: str) -> str:
    return f"({_A**2 * (1 - _E2) / 2!r} * (sin(radians({lat})) / (1 - {_E2!r} * sin(radians({lat})) ^ 2) + atanh({_E2**0.5!r} * sin(radians({lat}))) / {_E2**0.5!r}))"


def _overlap_sql() -> str:
    _, y, size, key = _GLACIER[0]
    values = ", ".join(map(str, _LEFT_OVER))
    area = f"radians({size}) * ((r1 - l1) + (r2 - l2)) / 2 * ({_q(f'({y} + y2 * {size})')} - {_q(f'({y} + y1 * {size})')})"
    return f"SELECT {key} AS polygon_id, round(sum({area}) / 1e6, 3) AS km2 FROM supplier, (VALUES {values}) v(y1, l1, r1, y2, l2, r2) GROUP BY s_suppkey"


@query(_overlap_sql())
def f05_concave_overlaps(spark, sf_dir):
    """Area on the ellipsoid of each glacier's part within a box, less its hole and its notch."""
    glaciers = polygons(spark, sf_dir, _GLACIER)
    x, y, size, _ = (F.expr(e) for e in _GLACIER[0][0:4])
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("polygon_id"), x.cast("double").alias("x"), y.alias("y"), size.cast("double").alias("size"))
    corner = lambda a, b: F.struct((F.col("x") + a * F.col("size")).alias("x"), (F.col("y") + b * F.col("size")).alias("y"))
    box = F.array(F.array(*[corner(a, b) for a, b in ((-0.5, -2.0), (2.0, -2.0), (2.0, 2.0), (-0.5, 2.0))]))
    parts = P.overlaps(glaciers.join(places, "polygon_id").select("polygon_id", "rings", box.alias("box")), "rings", "box", ["polygon_id"])
    area = F.aggregate(F.transform("parts", G.ellipsoid_area_km2), F.lit(0.0), lambda total, a: total + a)
    return parts.select("polygon_id", r(area, 3).alias("km2"))
