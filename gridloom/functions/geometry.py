"""Boxes, polygons and map projections as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.operators.joins import point_in_polygon

#: The WGS84 ellipsoid, the scale and origin of UTM, the spheres of equal area and of the sinusoidal grid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500_000.0, 10_000_000.0
AUTHALIC_RADIUS, SINUSOIDAL_RADIUS = 6371007.181, 6371007.181
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = UTM_SCALE * SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def conformal(lat: Column) -> Column:
    """The sine-like measure of latitude that a transverse projection starts from."""
    e = 2 * _N**0.5 / (1 + _N)
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - e * F.atanh(e * s))


def transverse(t: Column, d: Column) -> tuple[Column, Column]:
    """On the sphere: angles along and across the meridian at `d` radians."""
    return F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))


def _series(terms: Sequence[float], xi: Column, eta: Column, f, g) -> Column:
    return sum((a * f(2 * k * xi) * g(2 * k * eta) for k, a in enumerate(terms, 1)), F.lit(0.0))


def rolled_out(xi: Column, eta: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing of the ellipsoid from the angles of the sphere."""
    x, y = eta + _series(_FORWARD, xi, eta, F.cos, F.sinh), xi + _series(_FORWARD, xi, eta, F.sin, F.cosh)
    return FALSE_EASTING + _RADIUS * x, F.when(south, FALSE_NORTHING).otherwise(0.0) + _RADIUS * y


def rolled_up(easting: Column, northing: Column, south: Column) -> tuple[Column, Column]:
    return (northing - F.when(south, FALSE_NORTHING).otherwise(0.0)) / _RADIUS, (easting - FALSE_EASTING) / _RADIUS


def on_sphere(xi: Column, eta: Column) -> tuple[Column, Column]:
    return xi - _series(_BACK, xi, eta, F.sin, F.cosh), eta - _series(_BACK, xi, eta, F.cos, F.sinh)


def from_transverse(x: Column, h: Column) -> tuple[Column, Column]:
    """Conformal latitude and the distance to the middle meridian, in radians."""
    return F.asin(F.sin(x) / F.cosh(h)), F.atan2(F.sinh(h), F.cos(x))


def geodetic(chi: Column) -> Column:
    return F.degrees(chi + sum((d * F.sin(2 * k * chi) for k, d in enumerate(_LATITUDE, 1)), F.lit(0.0)))


def middle_meridian(zone: Column) -> Column:
    return zone * 6 - 183


def to_utm(lat: Column, lon: Column, zone: Column) -> Column:
    """Easting and northing in a zone, by the transverse Mercator series to third order (well under a millimetre inside a zone)."""
    easting, northing = rolled_out(*transverse(conformal(lat), F.radians(lon - middle_meridian(zone))), lat < 0)
    return F.struct(easting.alias("easting"), northing.alias("northing"))


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> Column:
    chi, d = from_transverse(*on_sphere(*rolled_up(easting, northing, south)))
    return F.struct(geodetic(chi).alias("lat"), (middle_meridian(zone) + F.degrees(d)).alias("lon"))


def from_sinusoidal(x: Column, y: Column) -> Column:
    lat = y / SINUSOIDAL_RADIUS
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(x / (SINUSOIDAL_RADIUS * F.cos(lat))).alias("lon"))


def to_sinusoidal(lat: Column, lon: Column) -> Column:
    return F.struct((SINUSOIDAL_RADIUS * F.radians(lon) * F.cos(F.radians(lat))).alias("x"), (SINUSOIDAL_RADIUS * F.radians(lat)).alias("y"))


def box_area_km2(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Area of a longitude-latitude box on the sphere of equal area; zero if it is empty."""
    height = F.sin(F.radians(max_lat)) - F.sin(F.radians(min_lat))
    return F.greatest(F.radians(max_lon - min_lon), F.lit(0.0)) * F.greatest(height, F.lit(0.0)) * (AUTHALIC_RADIUS / 1000) ** 2


def polygon_area_km2(ring: Column) -> Column:
    """Area of a ring of (lon, lat) on the sphere of equal area; its edges are straight in the cylindrical equal-area map.

    Zero below three corners, null for a null ring.
    """
    east = lambda p: F.radians(p["lon"])
    north = lambda p: F.sin(F.radians(p["lat"]))
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    turns = F.zip_with(ring, following, lambda p, q: east(p) * north(q) - east(q) * north(p))
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda total, t: total + t)) / 2 * (AUTHALIC_RADIUS / 1000) ** 2


_E2 = FLATTENING * (2 - FLATTENING)


def authalic(lat: Column) -> Column:
    """The height of a latitude in the equal-area map of the WGS84 ellipsoid, in square metres for one radian of longitude."""
    e = _E2**0.5
    s = F.sin(F.radians(lat))
    return SEMI_MAJOR**2 * (1 - _E2) / 2 * (s / (1 - _E2 * s * s) + F.atanh(e * s) / e)


def ellipsoid_box_km2(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Area of a longitude-latitude box on the ellipsoid, in closed form; zero if it is empty."""
    return F.greatest(F.radians(max_lon - min_lon), F.lit(0.0)) * F.greatest(authalic(max_lat) - authalic(min_lat), F.lit(0.0)) / 1e6


def _around(ring: Column, turn) -> Column:
    """Sum of turn(corner, next corner) over a ring."""
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    return F.aggregate(F.zip_with(ring, following, turn), F.lit(0.0), lambda total, t: total + t)


def ellipsoid_area_km2(ring: Column) -> Column:
    """Area of a ring of (x longitude, y latitude) on the ellipsoid; its edges are straight in the equal-area map. Zero below three corners, null for a null ring."""
    mapped = F.transform(ring, lambda p: F.struct(F.radians(p["x"]).alias("x"), authalic(p["y"]).alias("y")))
    return F.abs(_around(mapped, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2 / 1e6


def geodesic_area_km2(ring: Column) -> Column:
    """Area of a ring of (x longitude, y latitude) on the ellipsoid, its edges being great circles of the sphere of equal area.

    On the sphere an edge and the equator enclose an area in closed form; the authalic latitude carries the ellipsoid
    over, so a ring that follows parallels closely has the area of the ellipsoid's box. Edges take the shorter way round.
    """
    pole = SEMI_MAJOR**2 * (1 - _E2) / 2 * (1 / (1 - _E2) + math.atanh(_E2**0.5) / _E2**0.5)
    half = F.transform(ring, lambda p: F.struct(F.radians(p["x"]).alias("x"), F.tan(F.asin(F.greatest(F.least(authalic(p["y"]) / pole, F.lit(1.0)), F.lit(-1.0))) / 2).alias("t")))

    def below(p: Column, q: Column) -> Column:
        step = F.pmod(q["x"] - p["x"] + math.pi, F.lit(2 * math.pi)) - math.pi
        return 2 * F.atan2(F.tan(step / 2) * (p["t"] + q["t"]), 1 + p["t"] * q["t"])

    return F.abs(_around(half, below)) * pole / 1e6


def overlap_action(area_km2: Column, least: float = 1.0) -> Column:
    return F.when(area_km2 <= 0, "SKIP_NO_OVERLAP").when(area_km2 < least, "SKIP_DEGENERATE_OVERLAP").otherwise("CLIP")


def edge_meets_box(a: tuple[float, float], b: tuple[float, float], min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Whether the line from a to b has a point in a box: the stretches within its width and its height have to overlap."""
    low, high, within = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for start, end, least, most in ((a[0], b[0], min_x, max_x), (a[1], b[1], min_y, max_y)):
        if start == end:
            within = within & (least <= start) & (most >= start)
        else:
            one, two = (least - start) / (end - start), (most - start) / (end - start)
            low.append(F.least(one, two))
            high.append(F.greatest(one, two))
    return within & (F.greatest(*low) <= F.least(*high)) if len(low) > 1 else within


def edge_enters_box(a: tuple[float, float], b: tuple[float, float], min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Whether the line from a to b has a point within a box, its border left out: their spans overlap, and the box has corners on both sides of the line."""
    sides = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for x in (min_x, max_x) for y in (min_y, max_y)]
    spans = (max_x > min(a[0], b[0])) & (min_x < max(a[0], b[0])) & (max_y > min(a[1], b[1])) & (min_y < max(a[1], b[1]))
    return spans & (F.least(*sides) < 0) & (F.greatest(*sides) > 0)


def box_in_polygon(min_x: Column, min_y: Column, max_x: Column, max_y: Column, ring: Sequence[tuple[float, float]]) -> tuple[Column, Column]:
    """Whether a box is wholly inside a polygon without touching its edges, and whether it touches the polygon at all."""
    crossed = F.lit(False)
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        crossed = crossed | edge_meets_box(a, b, min_x, min_y, max_x, max_y)
    corner = point_in_polygon(min_x, min_y, ring)
    return corner & ~crossed, corner | crossed


def box_covered(min_x: Column, min_y: Column, max_x: Column, max_y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a polygon holds all of a box; the box may touch the polygon's edges from within."""
    entered = F.lit(False)
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        entered = entered | edge_enters_box(a, b, min_x, min_y, max_x, max_y)
    return point_in_polygon((min_x + max_x) / 2, (min_y + max_y) / 2, ring) & ~entered


def split_box(width: Column, height: Column, patch: float) -> Column:
    """Row and column numbers of the parts of a box, at least one by one."""
    parts = lambda size: F.greatest(F.floor(size / patch).cast("int"), F.lit(1))
    rows, cols = F.sequence(F.lit(0), parts(height) - 1), F.sequence(F.lit(0), parts(width) - 1)
    return F.flatten(F.transform(rows, lambda i: F.transform(cols, lambda j: F.struct(i.alias("row"), j.alias("col")))))


def hash_number(seed: str, *keys: Column) -> Column:
    """A number below 2^32 from a seed and keys, the same on every run."""
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def random_window(key: Column, years: Sequence[int], first: str, last: str, days: int) -> Column:
    """A window of `days` days within a season (first and last MM-dd) of one of the years, by hashes of a key: year, first_day, last_day.

    A season that goes over the new year belongs to the year that it begins in. The last
    day of a window is at most the season's last.
    """
    year = F.element_at(F.array(*[F.lit(y) for y in years]), (hash_number("year", key) % len(years) + 1).cast("int"))
    at = lambda y, day: F.to_date(F.concat_ws("-", y.cast("string"), F.lit(day)))
    start, stop = at(year, first), at(year + 1 if first > last else year, last)
    day = F.date_add(start, (hash_number("day", key) % (F.datediff(stop, start) - days + 2)).cast("int"))
    return F.struct(year.alias("year"), day.alias("first_day"), F.date_add(day, days - 1).alias("last_day"))
