"""Per-row column functions: calibration, indices, flags, positions, dates, bins. Missing readings are nulls."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Readings that stand for "none", edges of the fraction classes, metres of a degree on the sphere, land-cover codes.
SENTINELS = (-9999.0, -28672.0)
FRACTION_EDGES = (0.1, 0.2125, 0.325, 0.4375, 0.55, 0.6625, 0.775, 0.8875, 1.0)
METRES_PER_DEGREE = 2 * math.pi * 6_378_137 / 360
LAND_COVER = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)


def drop_sentinels(value: Column, extra: Sequence[float] = ()) -> Column:
    """Null for NaN, infinities and every number that stands for a missing reading."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")) & ~value.isin(*SENTINELS, *extra), value)


def decode_scaled(raw: Column, fill: float, scale: float, offset: float = 0.0) -> Column:
    """The fill becomes null before scale and offset are applied."""
    return F.when(raw != fill, raw * scale + offset)


def toa_reflectance(dn: Column, mult: Column, add: Column, sun_elevation: Column) -> Column:
    reflectance = (dn * mult + add) / F.sin(F.radians(sun_elevation))
    return F.when((dn != 0) & (reflectance >= 1e-7), reflectance)


def harmonized_dn(dn: Column, baseline: Column) -> Column:
    """Numbers of baselines from 4.00 on are 1000 higher."""
    moved = F.when(baseline >= 4.0, dn - 1000).otherwise(dn)
    return F.when((dn != 0) & (moved >= -1), moved)


def decibels(power: Column, floor: float = -30.0) -> Column:
    db = 10 * F.log10(F.when(power > 0, power))
    return F.when(db >= floor, db)


def scaled_keeping_fill(value: Column, scale: float, fill: float) -> Column:
    return F.when(value == fill, value).otherwise(value * scale)


def pack_cloud_bits(opaque: Column, cirrus: Column) -> Column:
    """Bit 10 for opaque clouds, which win, else bit 11 for cirrus."""
    return F.when(opaque, 1 << 10).when(cirrus, 1 << 11).otherwise(0)


def bits(value: Column, low: int, width: int = 1) -> Column:
    """The number in `width` bits from bit `low` on."""
    return F.shiftright(value, low).bitwiseAND((1 << width) - 1)


def normalized_difference(a: Column, b: Column, cloudy: Column | None = None) -> Column:
    """(a - b) / (a + b); null if either is missing, the sum is not positive, the ratio leaves [-1, 1] or a cloud mask is set."""
    ratio = F.when(a + b > 0, (a - b) / F.when(a + b > 0, a + b))
    ratio = F.when((ratio >= -1) & (ratio <= 1), ratio)
    return ratio if cloudy is None else F.when(F.coalesce(cloudy, F.lit(0)) <= 0, ratio)


def one_hot(code: Column, codes: Sequence[int] = LAND_COVER) -> Column:
    """A channel for each code; all null for a code that is not listed."""
    return F.when(code.isin(*codes), F.array(*[(code == c).cast("int") for c in codes]))


def unit_sphere(lat: Column, lon: Column) -> Column:
    """x, y, z on the unit sphere; null out of range."""
    inside = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    a, o = F.radians(lat), F.radians(lon)
    return F.when(inside, F.struct((F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z")))


def two_sigma(value: Column, mean: Column, std: Column) -> Column:
    """(value - (mean - 2 std)) / (4 std); a spread of zero is an error."""
    return F.when(F.assert_true(std != 0, "the spread is zero").isNull(), (value - (mean - 2 * std)) / (4 * std))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres of one degree of latitude and of longitude at a latitude."""
    a = F.radians(lat)
    return 111132.954 - 559.822 * F.cos(2 * a) + 1.175 * F.cos(4 * a) - 0.0023 * F.cos(6 * a), 111412.84 * F.cos(a) - 93.5 * F.cos(3 * a) + 0.118 * F.cos(5 * a)


def degree_spacing(lat: Column, step_x: Column | float, step_y: Column | float) -> tuple[Column, Column]:
    """Metres of steps in degrees along a row at a latitude, and along a column, on the sphere."""
    return step_x * METRES_PER_DEGREE * F.cos(F.radians(lat)), F.lit(step_y) * METRES_PER_DEGREE


def box_around(lat: Column, lon: Column, half_metres: float) -> Column:
    per_lat, per_lon = metres_per_degree(lat)
    dy, dx = half_metres / per_lat, half_metres / per_lon
    return F.struct((lon - dx).alias("min_lon"), (lat - dy).alias("min_lat"), (lon + dx).alias("max_lon"), (lat + dy).alias("max_lat"))


def in_box(x: Column, y: Column, box: Column) -> Column:
    return x.between(box["min_lon"], box["max_lon"]) & y.between(box["min_lat"], box["max_lat"])


def pixel_of(x: Column, y: Column, left: Column, top: Column, size: Column) -> Column:
    """Row and column of a world position on a north-up grid."""
    return F.struct(F.floor((top - y) / size).alias("row"), F.floor((x - left) / size).alias("col"))


def world_of(row: Column, col: Column, left: Column, top: Column, size: Column) -> Column:
    """The centre of a pixel."""
    return F.struct((left + (col + 0.5) * size).alias("x"), (top - (row + 0.5) * size).alias("y"))


def read_window(low: Column, high: Column, origin: Column, size: Column, count: Column, pad: int = 4) -> Column:
    """First and one-past-last index of the pixels that [low, high] needs, padded and clamped; null if none is left."""
    first = F.greatest(F.floor((low - origin) / size) - pad, F.lit(0))
    stop = F.least(F.ceil((high - origin) / size) + pad, count)
    return F.when(first < stop, F.struct(first.alias("first"), stop.alias("stop")))


def season_of(day: Column, seasons: Sequence[tuple[str, str, str]], default: str = "summer") -> Column:
    """The season (name, first MM-dd, last MM-dd) that a date is in; a season may run over the new year."""
    md = F.date_format(day, "MM-dd")
    found = F.lit(None).cast("string")
    for name, first, last in reversed(list(seasons)):
        inside = md.between(first, last) if first <= last else (md >= first) | (md <= last)
        found = F.when(inside, name).otherwise(found)
    return F.coalesce(found, F.when(day.isNotNull(), default))


def trailing_days(day: Column, days: int = 8) -> Column:
    """The window of days that ends with a day."""
    return F.sequence(F.date_sub(day, days - 1), day)


def fraction_class(value: Column, edges: Sequence[float] = FRACTION_EDGES) -> Column:
    """How many edges a value reaches; an edge belongs to the class above it."""
    return F.when(value.isNotNull(), sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)))


def percent_bin(percent: Column) -> Column:
    """{0}, 1-10, 11-20, .., 91-99, {100}; values in the gaps have no bin."""
    out = F.when(percent == 0, 0)
    for k in range(10):
        out = out.when(percent.between(1 + 10 * k, 10 * (k + 1) if k < 9 else 99), k + 1)
    return out.when(percent == 100, 11)


def month_cycle(month: Column) -> tuple[Column, Column]:
    angle = month * (2 * 3.141592653589793 / 12)
    return F.sin(angle), F.cos(angle)


def turned(y: Column, x: Column, size: int, choice: Column) -> tuple[Column, Column]:
    """Position after one of the eight flips and rotations of a square."""
    last = size - 1
    ways = [(y, x), (x, last - y), (last - y, last - x), (last - x, y), (y, last - x), (last - y, x), (x, y), (last - x, last - y)]
    new_y, new_x = F.lit(None), F.lit(None)
    for k, (a, b) in enumerate(ways):
        new_y, new_x = F.when(choice == k, a).otherwise(new_y), F.when(choice == k, b).otherwise(new_x)
    return new_y, new_x


def ablated(value: Column, band: Column, step: Column, hidden: Sequence[str] = (), only: Sequence[str] | None = None, first: Column | None = None, last: Column | None = None) -> Column:
    """Whether a reading is masked: it is missing, its band is hidden, it is before `first`, or it is at `last` and not of the bands kept there."""
    masked = value.isNull()
    if hidden:
        masked = masked | band.isin(*hidden)
    if first is not None:
        masked = masked | (step < first)
    if last is not None:
        masked = masked | ((step == last) & (~band.isin(*only) if only else F.lit(True)))
    return masked


def hemisphere_month(lat: Column, north: Column, south: Column) -> Column:
    """The season of the place's own half of the globe."""
    return F.when(lat < 0, south).otherwise(north)


def patch_of(row: Column, col: Column, size: int, rows: int, cols: int) -> Column:
    """The patch that a pixel is in, and whether the pixel is on the raster."""
    return F.struct(F.floor(row / size).alias("row"), F.floor(col / size).alias("col"), (row.between(0, rows - 1) & col.between(0, cols - 1)).alias("inside"))


def reclassified(label: Column, classes: dict[int, int]) -> Column:
    """Labels by a mapping; null for all others."""
    found = F.lit(None).cast("int")
    for old, new in classes.items():
        found = F.when(label == old, new).otherwise(found)
    return found


def row_major_id(row: Column, col: Column, first_row: int, first_col: int, width: int) -> Column:
    """The number of a cell, counted row by row from the south and west."""
    return (row - first_row) * width + col - first_col


def hash_rank_key(seed: str, *keys: Column) -> Column:
    """A number-free random order that is the same whatever the partitions."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))
