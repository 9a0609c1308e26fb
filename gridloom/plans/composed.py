"""Queries of the sources from products to the pixels of cells, with SQL that starts from products and readings too.

Roles: 80 orders are a product, their line items its readings (the greatest of those of one
pixel counts). Products lie in seven tiles on either side of the border between two UTM zones, 84
products in each strip from south to north; the cells of a strip lie across the border. So
strips, products and cells grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import lattices as L
from gridloom.operators.steps import written
from gridloom.plans.queries import query, r, table

#: Where the strips begin: the same place in zones 11 and 12 (metres), in the sinusoidal grid, and in degrees.
EAST, EAST_12, NORTH, NORTH_12 = 709800.0, 289590.0, 5654100.0, 5654070.0
DAY = "2024-03-01"

_PRODUCTS = """s AS (SELECT DISTINCT l_orderkey // 80 AS scene FROM lineitem), p0 AS (SELECT scene, scene // 84 % 2000 AS strip, CAST(scene % 6 AS INTEGER) AS d, scene // 6 % 7 AS tile FROM s),
p AS (SELECT *, DATE '2024-03-01' + d AS day, 5 - scene % 5 AS newest, d % 2 = 0 AND scene % 3 = 0 AS better FROM p0)"""
_READINGS = """rd AS (SELECT l_orderkey // 80 AS scene, l_returnflag AS band, l_partkey % 10 AS "row", (l_orderkey + l_linenumber) % 10 AS col, max(CASE WHEN l_tax > 0.07 THEN 0 ELSE l_quantity * 100 END) AS dn FROM lineitem GROUP BY ALL)"""
_CELLS = f"""c AS (SELECT DISTINCT strip * 5 + i AS cell, {EAST} + 30 + i * 160 AS l, {NORTH} + strip * 400 + 330 AS t FROM p, range(5) k(i)),
cp AS (SELECT cell, y, x, l + (x + 0.5) * 25 AS e, t - (y + 0.5) * 25 AS n FROM c, range(6) a(y), range(6) b(x))"""


def _sum(terms, sign: str, f: str, g: str, at: tuple[str, str]) -> str:
    return "".join(f" {sign} {v!r} * {f}({2 * k} * {at[0]}) * {g}({2 * k} * {at[1]})" for k, v in enumerate(terms, 1))


def _geographic() -> str:
    """Longitude and latitude of the cells' pixels, from zone 11."""
    lat = "".join(f" + {v!r} * sin({2 * k} * chi)" for k, v in enumerate(G._LATITUDE, 1))
    return f"""g1 AS (SELECT *, n / {G._RADIUS!r} AS xi, (e - 500000) / {G._RADIUS!r} AS eta FROM cp),
g2 AS (SELECT *, xi{_sum(G._BACK, '-', 'sin', 'cosh', ('xi', 'eta'))} AS fx, eta{_sum(G._BACK, '-', 'cos', 'sinh', ('xi', 'eta'))} AS fh FROM g1),
g3 AS (SELECT *, asin(sin(fx) / cosh(fh)) AS chi FROM g2),
g AS (SELECT cell, y, x, e, n, degrees(chi{lat}) AS lat, -117 + degrees(atan2(sinh(fh), cos(fx))) AS lon FROM g3)"""


def _zone_12() -> str:
    s = 2 * G._N**0.5 / (1 + G._N)
    return f"""h1 AS (SELECT *, sin(radians(lat)) AS sn, radians(lon + 111) AS dl FROM g), h2 AS (SELECT *, sinh(atanh(sn) - {s!r} * atanh({s!r} * sn)) AS tt FROM h1),
h3 AS (SELECT *, atan2(tt, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + tt * tt)) AS eta FROM h2),
h AS (SELECT cell, y, x, 500000 + {G._RADIUS!r} * (eta{_sum(G._FORWARD, '+', 'cos', 'sinh', ('xi', 'eta'))}) AS px, {G._RADIUS!r} * (xi{_sum(G._FORWARD, '+', 'sin', 'cosh', ('xi', 'eta'))}) AS py FROM h3)"""


@dataclass(frozen=True)
class Lattice:
    """Where the products of a role lie: the pixel size, and in Spark (when a session is there) and SQL their zone, left and top, from tile and strip."""

    size: float
    zone: tuple[Callable[[], Column], str]
    left: tuple[Callable[[], Column], str]
    top: tuple[Callable[[], Column], str]
    positions: str  # SQL: (cell, y, x, zone, u, v)


def _tile() -> Column:
    return F.col("tile")


def _strip() -> Column:
    return F.col("strip")


def _even(a: float, b: float) -> Column:
    return F.when(_tile() % 2 == 0, a).otherwise(b)


def _utm(size: float) -> Lattice:
    """Tiles of ten pixels, each two over the next; the odd ones are in zone 12."""
    step = lambda edge, of: f"(floor({edge} / {size}) * {size} + {of})"
    left = f"CASE WHEN tile % 2 = 0 THEN {step(EAST, f'tile // 2 * {8 * size}')} ELSE {step(EAST_12, f'tile // 2 * {8 * size}')} END"
    top = f"floor((CASE WHEN tile % 2 = 0 THEN {NORTH} ELSE {NORTH_12} END + strip * 400) / {size}) * {size} + {12 * size}"
    down = lambda x: F.floor(x / size) * F.lit(size)
    return Lattice(
        size,
        (lambda: _even(11, 12), "11 + tile % 2"),
        (lambda: down(_even(EAST, EAST_12)) + F.floor(_tile() / 2) * F.lit(8 * size), left),
        (lambda: down(_even(NORTH, NORTH_12) + _strip() * 400) + F.lit(12 * size), top),
        f"{_geographic()}, {_zone_12()}, pos AS (SELECT cell, y, x, 11 AS zone, e / {size} AS u, -n / {size} AS v FROM cp UNION ALL SELECT cell, y, x, 12, px / {size}, -py / {size} FROM h)",
    )


def _flat(size: float, zone: int, x0: float, y0: float, step: float, x: str, y: str) -> Lattice:
    """Tiles of ten pixels in a projection of the whole globe. Their places are decimal numbers until they are counted in pixels, as in SQL: binary ones fall short of some pixels' edges."""
    exact = lambda v: F.lit(Decimal(repr(v)))
    down = lambda start, n, by: F.floor((exact(start) + n * exact(by)).cast("double") / size) * F.lit(size)
    return Lattice(
        size,
        (lambda: F.lit(zone), str(zone)),
        (lambda: down(x0, _tile(), 8 * size), f"floor(({x0} + tile * {8 * size}) / {size}) * {size}"),
        (lambda: down(y0, _strip(), step) + F.lit(5 * size), f"floor(({y0} + strip * {step}) / {size}) * {size} + {5 * size}"),
        f"{_geographic()}, pos AS (SELECT cell, y, x, {zone} AS zone, ({x}) / {size} AS u, -({y}) / {size} AS v FROM g)",
    )


_R = G.SINUSOIDAL_RADIUS
UTM = _utm(30.0)
SINUSOIDAL = _flat(463.3127, L.SINUSOIDAL, -7989000.0, 5670000.0, 400.0, f"{_R} * radians(lon) * cos(radians(lat))", f"{_R} * radians(lat)")
GLOBE = _flat(0.01, L.DEGREES, -114.05, 51.0, 0.0036, "lon", "lat")


def products(spark, sf_dir, lattice: Lattice, name: Column):
    """(name, band, zone, size, left, top, rows, cols, d, ...): the products of the role, one asset for each band."""
    items = table(spark, sf_dir, "lineitem")
    scene = F.floor(F.col("l_orderkey") / 80)
    found = written(items.select(scene.alias("scene"), F.col("l_returnflag").alias("band")).distinct())  # else what is asked of names is asked of every line item
    named = found.withColumns({"strip": F.floor(F.col("scene") / 84) % 2000, "d": (F.col("scene") % 6).cast("int"), "tile": F.floor(F.col("scene") / 6) % 7})
    return named.select(
        name.alias("name"),
        "band",
        lattice.zone[0]().alias("zone"),
        F.lit(lattice.size).alias("size"),
        lattice.left[0]().alias("left"),
        lattice.top[0]().alias("top"),
        F.lit(10).alias("rows"),
        F.lit(10).alias("cols"),
        "scene",
        F.lit(2e-4).alias("mult"),
        F.lit(-0.1).alias("add"),
        (F.lit(30.0) + F.col("d")).alias("sun_elevation"),
        F.lit(None).cast("double").alias("baseline"),
    )


def readings(spark, sf_dir, name: Column):
    keys = [F.floor(F.col("l_orderkey") / 80).alias("scene"), F.col("l_returnflag").alias("band"), (F.col("l_partkey") % 10).alias("row"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 10).alias("col")]
    dn = F.when(F.col("l_tax") > 0.07, 0.0).otherwise(F.col("l_quantity") * 100).alias("dn")
    facts = {"d": (F.col("scene") % 6).cast("int"), "tile": F.floor(F.col("scene") / 6) % 7}
    items = table(spark, sf_dir, "lineitem")
    # Nearly every line item is a reading of its own, so they are dealt out before they are grouped: a task holds the readings of its products, not those of a piece of the file.
    # They meet their products there as well, by scene and band: names, which are as long as all else of a reading, are not built for it then.
    dealt = items.select(*keys, dn).repartition(L.tasks_of(items, items.count()), "scene", "band")
    found = dealt.groupBy("scene", "band", "row", "col").agg(F.max("dn").alias("dn")).withColumns(facts)
    clouds = [(F.col("dn") % 700 == 0).cast("int").alias("opaque"), (F.col("dn") % 300 == 0).cast("int").alias("cirrus")]
    # A name is never null, so no test for nulls, with the whole name written out in it, is pushed down to every line item.
    return found.select(F.coalesce(name, F.lit("")).alias("name"), "scene", "band", "row", "col", "dn", *clouds)


def targets(spark, sf_dir):
    """Five cells of 6 by 6 pixels of 25 m in each strip, in zone 11."""
    strips = table(spark, sf_dir, "lineitem").select((F.floor(F.floor(F.col("l_orderkey") / 80) / 84) % 2000).alias("strip")).distinct()
    cells = strips.select("strip", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    left, top = F.lit(EAST + 30) + F.col("i") * 160, F.lit(NORTH) + F.col("strip") * 400 + 330
    return cells.select((F.col("strip") * 5 + F.col("i")).alias("cell"), F.lit(11).alias("zone"), F.lit(25.0).alias("size"), left.alias("left"), top.alias("top"), F.lit(6).alias("rows"), F.lit(6).alias("cols"))


def _written(after: Column, pattern: str) -> Column:
    """The day so many days after the first, as text. The days of the role are formatted once, in the plan, and looked up: names are built for every reading."""
    day = lambda n: F.date_format(F.date_add(F.to_date(F.lit(DAY)), n), pattern)
    return F.coalesce(F.get(F.array(*[day(n) for n in range(11)]), after), day(after))


def _day(pattern: str) -> Column:
    return _written(F.col("d"), pattern)


def _processed() -> Column:
    return _written(F.col("d") + (1 + F.col("scene") % 5).cast("int"), "yyyyMMdd")


def _number(digits: int = 0) -> Column:
    text = F.col("scene").cast("string")
    return F.lpad(text, digits, "0") if digits else text


def landsat_names() -> Column:
    sensor = F.when((F.col("d") % 2 == 0) & (F.col("scene") % 3 == 0), "LC09").otherwise("LC08")
    return F.concat(sensor, F.lit("_L1TP_"), F.lpad(_tile().cast("string"), 3, "0"), F.lit("024_"), _day("yyyyMMdd"), F.lit("_"), _processed(), F.lit("_02_T1."), _number())


def sentinel2_names() -> Column:
    baseline = F.when(F.col("scene") % 2 == 0, "0511").otherwise("0301")
    return F.concat(F.lit("S2A_MSIL1C_"), _day("yyyyMMdd"), F.lit("T184731_N"), baseline, F.lit("_R070_T11UP"), _tile().cast("string"), F.lit("_"), _processed(), F.lit("T202515."), _number())


def sentinel1_names() -> Column:
    day = _day("yyyyMMdd")
    return F.concat(F.lit("S1A_IW_GRDH_1SDV_"), day, F.lit("T013722_"), day, F.lit("T013747_058587_07406B_"), F.lpad(F.hex(F.col("scene") % 50000), 4, "0"), F.lit("."), _number())


def julian_names() -> Column:
    return F.concat(F.lit("MOD09GA.A"), _day("yyyyDDD"), F.lit("."), _number(9))


def stamped_names() -> Column:
    return F.concat(F.lit("field_"), _day("yyyyMMdd"), F.lit("_"), _number(9))


#: Parts of the SQL that several sources share.
_CHOSEN_BETTER = "ch AS (SELECT p.* FROM p JOIN (SELECT day, bool_or(better) AS has_better FROM p GROUP BY day) USING (day) WHERE better = has_better)"
_CHOSEN_ALL = "ch AS (SELECT * FROM p)"


def _sql(lattice: Lattice, value: str, order: str, chosen: str = _CHOSEN_ALL, bilinear: bool = False, latest: bool = False, whole: bool = True, fill: str | None = None, day: str = "ch.day", static: bool = False) -> str:
    dated, also = ("", "") if static else ("day, ", ", day")
    valid = "" if latest else "FILTER (WHERE value IS NOT NULL)"
    if bilinear:
        read = f"""b4 AS (SELECT pos.*, CAST(floor(v - 0.5) AS BIGINT) + a AS gy, CAST(floor(u - 0.5) AS BIGINT) + b AS gx FROM pos, range(2) ra(a), range(2) rb(b)),
m AS (SELECT b4.*, {dated}band, value, (1 - abs(v - 0.5 - gy)) * (1 - abs(u - 0.5 - gx)) AS w FROM b4 JOIN nat USING (zone, gy, gx)),
rdz AS (SELECT cell, {dated}band, y, x, zone, sum(w * value) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0) AS value FROM m GROUP BY ALL)"""
    else:
        read = f"rdz AS (SELECT cell, {dated}band, y, x, zone, value FROM (SELECT *, CAST(floor(v) AS BIGINT) AS gy, CAST(floor(u) AS BIGINT) AS gx FROM pos) JOIN nat USING (zone, gy, gx))"
    keep = "HAVING count(DISTINCT band) = 3" if whole else ""
    days = "" if static else ", (SELECT DISTINCT day FROM p)"
    size = lattice.size
    return f"""WITH {_PRODUCTS}, {chosen}, {_READINGS}, {_CELLS}, {lattice.positions},
placed AS (SELECT *, {lattice.zone[1]} AS zone, {lattice.left[1]} AS l, {lattice.top[1]} AS t FROM ch),
px AS (SELECT ch.scene, tile, d, {day} AS day, zone, band, dn, CAST(floor(-(t - ("row" + 0.5) * {size}) / {size}) AS BIGINT) AS gy, CAST(floor((l + (col + 0.5) * {size}) / {size}) AS BIGINT) AS gx FROM placed ch JOIN rd ON ch.scene = rd.scene),
vl AS (SELECT *, CAST({value} AS DOUBLE) AS value FROM px),
nat AS (SELECT zone, {dated}band, gy, gx, arg_min(value, ({order})) {valid} AS value FROM vl GROUP BY ALL), {read},
f AS (SELECT cell, {dated}band, y, x, arg_min(value, zone) FILTER (WHERE value IS NOT NULL) AS value FROM rdz GROUP BY ALL),
ok AS (SELECT cell{also} FROM f GROUP BY ALL {keep}),
k AS (SELECT cell, {dated}band, y, x, {f'coalesce(value, {fill})' if fill else 'value'} AS value FROM f JOIN ok USING (cell{also}))
SELECT cell, {dated}band, y, x, round(k.value, 4) AS value FROM (SELECT cell, y, x, {dated}band FROM cp, (SELECT DISTINCT l_returnflag AS band FROM lineitem){days}) q LEFT JOIN k USING (cell, {dated}band, y, x)"""


BANDS = ("A", "N", "R")


def _composed(query_name: str, source: L.Source, lattice: Lattice, name: Callable[[], Column], sql: str) -> None:
    def run(spark, sf_dir):
        assets = products(spark, sf_dir, lattice, name())
        days = None if source.static else assets.select(F.date_add(F.to_date(F.lit(DAY)), (F.col("scene") % 6).cast("int")).alias("day")).distinct()
        found = L.fetch(source, assets, readings(spark, sf_dir, name()), targets(spark, sf_dir), BANDS, days, by="scene", dealt=True)
        return found.withColumn("value", r("value"))

    run.__name__ = query_name
    run.__doc__ = "From products and readings to the pixels of cells over two zones."
    query(sql)(run)


_REFLECTANCE = "CASE WHEN dn <> 0 AND (dn * 2e-4 - 0.1) / sin(radians(30.0 + d)) >= 1e-7 THEN (dn * 2e-4 - 0.1) / sin(radians(30.0 + d)) END"
_HARMONIZED = "(CASE WHEN dn <> 0 AND dn - CASE WHEN scene % 2 = 0 THEN 1000 ELSE 0 END >= -1 THEN dn - CASE WHEN scene % 2 = 0 THEN 1000 ELSE 0 END END)"
_composed("d01_landsat_cells", L.SOURCES["landsat"], UTM, landsat_names, _sql(UTM, _REFLECTANCE, "tile, -(1 + scene % 5), CAST(scene AS VARCHAR)", _CHOSEN_BETTER))
_composed("d01_landsat_flags", L.SOURCES["landsat_qa"], UTM, landsat_names, _sql(UTM, "dn", "tile, -(1 + scene % 5), CAST(scene AS VARCHAR)", _CHOSEN_BETTER, latest=True))
_composed("d02_sentinel2_cells", L.SOURCES["sentinel2"], UTM, sentinel2_names, _sql(UTM, _HARMONIZED, "tile, -(1 + scene % 5), CAST(scene % 2 = 0 AS INTEGER), CAST(scene AS VARCHAR)"))
_composed("d03_sentinel2_flags", L.SOURCES["sentinel2_qa"], UTM, sentinel2_names, _sql(UTM, "CASE WHEN dn % 700 = 0 THEN 1024 WHEN dn % 300 = 0 THEN 2048 ELSE 0 END", "tile, -(1 + scene % 5), CAST(scene % 2 = 0 AS INTEGER), CAST(scene AS VARCHAR)"))
_composed("d04_sentinel1_cells", L.SOURCES["sentinel1"], UTM, sentinel1_names, _sql(UTM, "CASE WHEN dn > 0 THEN 10 * log10(dn) END", "-(scene % 50000)", bilinear=True))
_composed("d06_modis_cells", L.SOURCES["modis"], SINUSOIDAL, julian_names, _sql(SINUSOIDAL, "nullif(dn, -28672)", "scene", fill="-28672"))
_composed("d07_viirs_cells", L.SOURCES["viirs"], SINUSOIDAL, julian_names, _sql(SINUSOIDAL, "nullif(dn, -28672) * 0.0001", "scene", fill="-28672"))
_composed("d08_era5_cells", replace(L.SOURCES["era5"], next_day=("R",)), GLOBE, stamped_names, _sql(GLOBE, "dn", "scene", whole=False, day="CASE WHEN band = 'R' THEN day - 1 ELSE day END"))
_composed("d10_land_cover_cells", L.SOURCES["worldcover"], GLOBE, stamped_names, _sql(GLOBE, "dn", "d, scene", whole=False, static=True))


def _terrain_sql() -> str:
    """The tiles laid together, the eight neighbours by joins, the nearest pixel of each target."""
    joins, names = [], {}
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            k = f"n{dy + 1}{dx + 1}"
            joins.append(f"LEFT JOIN nat {k} ON {k}.gy = c.gy + ({dy}) AND {k}.gx = c.gx + ({dx})")
            names[dy, dx] = f"coalesce({k}.value, n1{dx + 1}.value, n{dy + 1}1.value, c.value)"
    east = " + ".join(f"{2 if a == 0 else 1} * ({names[a, 1]} - {names[a, -1]})" for a in (-1, 0, 1))
    south = " + ".join(f"{2 if b == 0 else 1} * ({names[1, b]} - {names[-1, b]})" for b in (-1, 0, 1))
    metres = "2 * pi() * 6378137 / 360"
    return f"""WITH {_PRODUCTS}, {_READINGS}, {_CELLS}, {GLOBE.positions},
placed AS (SELECT *, {GLOBE.left[1]} AS l, {GLOBE.top[1]} AS t FROM p),
px AS (SELECT p.scene, d, dn, CAST(floor(-(t - ("row" + 0.5) * {GLOBE.size}) / {GLOBE.size}) AS BIGINT) AS gy, CAST(floor((l + (col + 0.5) * {GLOBE.size}) / {GLOBE.size}) AS BIGINT) AS gx FROM placed p JOIN rd ON p.scene = rd.scene WHERE band = 'N'),
nat AS (SELECT gy, gx, CAST(arg_min(dn, (d, scene)) AS DOUBLE) AS value FROM px GROUP BY ALL),
g9 AS (SELECT c.gy, c.gx, c.value, ({east}) / 8 / ({GLOBE.size} * {metres} * cos(radians(-(c.gy + 0.5) * {GLOBE.size}))) AS dx, ({south}) / 8 / ({GLOBE.size} * {metres}) AS dy FROM nat c {' '.join(joins)}),
st AS (SELECT gy, gx, value, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, CASE WHEN dx = 0 AND dy = 0 THEN 270 ELSE (450 - degrees(atan2(dy, -dx))) % 360 END AS aspect FROM g9 WHERE value >= 1),
f AS (SELECT pos.cell, pos.y, pos.x, st.* FROM pos LEFT JOIN st ON st.gy = floor(v) AND st.gx = floor(u))
SELECT cell, 'DEM' AS band, y, x, round(value, 4) AS value FROM f UNION ALL SELECT cell, 'slope', y, x, round(slope, 4) FROM f UNION ALL SELECT cell, 'aspect', y, x, round(aspect, 4) FROM f"""


@query(_terrain_sql())
def d09_dem_cells(spark, sf_dir):
    """Heights, slopes and aspects over the edges of tiles."""
    assets = products(spark, sf_dir, GLOBE, stamped_names()).where("band = 'N'")
    return L.fetch_terrain(assets, readings(spark, sf_dir, stamped_names()), targets(spark, sf_dir), 1.0, by="scene", dealt=True).withColumn("value", r("value"))
