"""Clipping of polygons and of pixels to an area of interest, a ring of (lon, lat) corners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import box_in_polygon
from gridloom.operators.joins import point_in_polygon


def _following(ring: Column) -> Column:
    """The ring turned by one corner, so that each corner meets the next one."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))


def clip_to_convex(df: DataFrame, ring: str, area: Sequence[tuple[float, float]]) -> DataFrame:
    """Rings (arrays of lon, lat) cut to a convex area, one half-plane after the other; empty where nothing is left.

    A null ring stays null. The area may run in either direction.
    """
    turn = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(area, [*area[1:], area[0]]))
    corners = list(area) if turn > 0 else list(reversed(area))
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
        side = lambda p: (bx - ax) * (p["lat"] - ay) - (by - ay) * (p["lon"] - ax)  # noqa: B023, E731

        def kept(p: Column, q: Column) -> Column:
            share = side(p) / (side(p) - side(q))  # noqa: B023
            cut = F.struct((p["lon"] + (q["lon"] - p["lon"]) * share).alias("lon"), (p["lat"] + (q["lat"] - p["lat"]) * share).alias("lat"))
            crosses = (side(p) >= 0) != (side(q) >= 0)  # noqa: B023
            return F.array_compact(F.array(F.when(crosses, cut), F.when(side(q) >= 0, q)))  # noqa: B023

        df = df.withColumn(ring, F.flatten(F.zip_with(F.col(ring), _following(F.col(ring)), kept)))
    return df


def pixels_inside(df: DataFrame, x: str, y: str, area: Sequence[tuple[float, float]]) -> DataFrame:
    """Pixels whose centre is in the area; the box of the area goes first, where a scan can use it."""
    return _in_reach(df, x, y, area, 0.0).where(point_in_polygon(F.col(x), F.col(y), area))


def pixels_touching(df: DataFrame, x: str, y: str, half: float, area: Sequence[tuple[float, float]]) -> DataFrame:
    """Pixels of which any part is in the area, as coarse grids want it."""
    cx, cy = F.col(x), F.col(y)
    _, touches = box_in_polygon(cx - half, cy - half, cx + half, cy + half, area)
    return _in_reach(df, x, y, area, half).where(touches)


def slab(df: DataFrame, x: str, y: str, area: Sequence[tuple[float, float]], pad: float = 0.15) -> DataFrame:
    """Rows in the padded box of the area."""
    return _in_reach(df, x, y, area, pad)


def _in_reach(df: DataFrame, x: str, y: str, area: Sequence[tuple[float, float]], pad: float) -> DataFrame:
    xs, ys = [p[0] for p in area], [p[1] for p in area]
    return df.where(F.col(x).between(min(xs) - pad, max(xs) + pad) & F.col(y).between(min(ys) - pad, max(ys) + pad))


def window_members(df: DataFrame, keys: Sequence[str], row: str, col: str, inside: Column, pad: int = 10) -> DataFrame:
    """Pixels in the rows and columns, padded, that the pixels inside an area span in each swath."""
    spans = df.where(inside).groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in (row, col) for f, n in ((F.min, "low"), (F.max, "high"))])
    near = [F.col(c).between(F.col(f"_low_{c}") - pad, F.col(f"_high_{c}") + pad) for c in (row, col)]
    return df.join(spans, list(keys)).where(near[0] & near[1]).select(df.columns)


#: Percents of cloud over which a scene is cloudy, and under which one of each sensor is clear.
CLOUDY, CLEAR = 50, {"sentinel2": 10, "landsat": 20}


def cloud_kinds(scenes: DataFrame, share: str, sensor: str) -> DataFrame:
    """Scenes whose share of cloud, in percent, makes them cloudy or clear for their sensor, with that as `kind`; those between are left out."""
    least = F.element_at(F.create_map(*[F.lit(x) for pair in CLEAR.items() for x in pair]), F.col(sensor))
    kind = F.when(F.col(share) > CLOUDY, "cloudy").when(F.col(share) < least, "clear")
    return scenes.withColumn("kind", kind).where("kind is not null")
