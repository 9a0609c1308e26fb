"""Sources on pixel lattices, from products and their readings to the pixels of target cells, all cells and days at once.

A lattice is a projection (its zone) and a pixel size; its pixels are counted from the
projection's origin, so a number names the same ground in all products of the lattice.
A source states how its names are read, which products go first, how readings are
calibrated and how they are resampled; `fetch` chains the steps from that.

Tables: assets (name, band, zone, size, left, top, rows, cols, and what calibration needs);
readings (name, band, row, col, dn); cells (cell, zone, size, left, top, rows, cols).
Zones: 1 to 60 UTM north, -1 to -60 UTM south, 0 degrees, 100 sinusoidal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import columns as C
from gridloom.functions import geometry as G
from gridloom.operators import stencils
from gridloom.operators.joins import MOST_TASKS, box_join
from gridloom.operators.steps import written
from gridloom.sources import names as N

DEGREES, SINUSOIDAL = 0, 100
#: Pixels of products that one task takes.
PIXELS_A_TASK = 250_000


@dataclass(frozen=True)
class Source:
    """What tells one source from another.

    facts: from a product's name, its `day` (none for static sources), `tile`, and what the
    other columns use. order: of the readings of one pixel and day, within a tile and then among
    tiles. rank: products of a day stay out if others of the day have a lesser one.
    value: the calibrated reading, null where it is not valid. fill: what stands where
    products have no valid reading (null elsewhere). latest: the first product
    counts, valid or not. whole: one band without products leaves no band of its cell and
    day. next_day: bands that are stamped with the following day.
    """

    facts: Callable[[Column], Mapping[str, Column]]
    value: Callable[[], Column]
    order: Sequence[str]
    rank: str | None = None
    bilinear: bool = False
    latest: bool = False
    whole: bool = False
    static: bool = False
    fill: float | None = None
    next_day: Sequence[str] = field(default_factory=tuple)


def _landsat(name: Column) -> dict[str, Column]:
    n = N.landsat_name(name)
    return {"day": n["acq"], "tile": F.concat(n["path"], n["row"]), "newest": -F.unix_date(n["proc"]), "rank": F.when(n["sensor"] == "LC09", 0).otherwise(1)}


def _sentinel2(name: Column) -> dict[str, Column]:
    n = N.sentinel2_name(name)
    return {"day": n["acq"], "tile": n["tile"], "newest": -F.unix_date(n["proc"]), "named_baseline": n["baseline"]}


def _sentinel1(name: Column) -> dict[str, Column]:
    n = N.sentinel1_name(name)
    return {"day": n["acq"], "newest": -F.conv(n["uid"], 16, 10).cast("long")}


def _julian(name: Column) -> dict[str, Column]:
    return {"day": N.julian_date(name)}


def _stamped(name: Column) -> dict[str, Column]:
    return {"day": F.try_to_timestamp(F.regexp_extract(name, r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")}


#: The sources on lattices; swaths are joined by their nearest points instead (operators/joins.py). Fills and scales.
SOURCES = {
    "landsat": Source(_landsat, lambda: C.toa_reflectance(F.col("dn"), F.col("mult"), F.col("add"), F.col("sun_elevation")), ("tile", "newest", "name"), rank="rank", whole=True),
    "landsat_qa": Source(_landsat, lambda: F.col("dn"), ("tile", "newest", "name"), rank="rank", latest=True, whole=True),
    "sentinel2": Source(_sentinel2, lambda: C.harmonized_dn(F.col("dn"), F.coalesce("baseline", "named_baseline")), ("tile", "newest", "name"), whole=True),
    "sentinel2_qa": Source(_sentinel2, lambda: C.pack_cloud_bits(F.col("opaque") > 0, F.col("cirrus") > 0), ("tile", "newest", "name"), whole=True),
    "sentinel1": Source(_sentinel1, lambda: F.when(F.col("band") == "angle", F.col("dn")).otherwise(C.decibels(F.col("dn"))), ("newest", "name"), bilinear=True, whole=True),
    "modis": Source(_julian, lambda: F.nullif(F.col("dn"), F.lit(-28672.0)), ("name",), whole=True, fill=-28672.0),
    "modis_state": Source(_julian, lambda: F.col("dn"), ("name",), whole=True),
    "viirs": Source(_julian, lambda: F.nullif(F.col("dn"), F.lit(-28672.0)) * 0.0001, ("name",), whole=True, fill=-28672.0),
    "era5": Source(_stamped, lambda: F.col("dn"), ("name",), next_day=("total_precipitation_sum",)),
    "dem": Source(lambda name: {}, lambda: F.col("dn"), ("name",), static=True),
    "worldcover": Source(lambda name: {}, lambda: F.col("dn"), ("name",), static=True),
}


def _stages(df: DataFrame, *stages: Callable[[], Mapping[str, Column]]) -> DataFrame:
    """Columns in stages that build on each other: each is computed once, where one expression would repeat its parts over and over."""
    for stage in stages:
        df = df.withColumns(dict(stage()))
    return df.drop(*(c for c in df.columns if c.startswith("__")))


def _named(*names: str):
    return lambda values: dict(zip(names, values))


def geographic(df: DataFrame, x: str, y: str, zone: str) -> DataFrame:
    """Adds lon and lat of positions in the projections of their zones."""
    c, z = F.col, F.col(zone)
    return _stages(
        df,
        lambda: _named("__xi", "__eta")(G.rolled_up(c(x), c(y), z < 0)),
        lambda: _named("__x", "__h")(G.on_sphere(c("__xi"), c("__eta"))),
        lambda: _named("__chi", "__d")(G.from_transverse(c("__x"), c("__h"))) | {"__flat": G.from_sinusoidal(c(x), c(y))},
        lambda: {
            "lon": F.when(z == DEGREES, c(x)).when(z == SINUSOIDAL, c("__flat.lon")).otherwise(G.middle_meridian(F.abs(z)) + F.degrees("__d")),
            "lat": F.when(z == DEGREES, c(y)).when(z == SINUSOIDAL, c("__flat.lat")).otherwise(G.geodetic(c("__chi"))),
        },
    )


def projected(df: DataFrame, zone: str, x: str, y: str) -> DataFrame:
    """Adds the positions of (lon, lat) in the projections of their zones."""
    c, z = F.col, F.col(zone)
    return _stages(
        df,
        lambda: {"__t": G.conformal(c("lat")), "__d": F.radians(c("lon") - G.middle_meridian(F.abs(z)))},
        lambda: _named("__xi", "__eta")(G.transverse(c("__t"), c("__d"))),
        lambda: _named("__e", "__n")(G.rolled_out(c("__xi"), c("__eta"), z < 0)) | {"__flat": G.to_sinusoidal(c("lat"), c("lon"))},
        lambda: {x: F.when(z == DEGREES, c("lon")).when(z == SINUSOIDAL, c("__flat.x")).otherwise(c("__e")), y: F.when(z == DEGREES, c("lat")).when(z == SINUSOIDAL, c("__flat.y")).otherwise(c("__n"))},
    )


def selected(source: Source, assets: DataFrame) -> DataFrame:
    """Assets with the facts in their names; names that do not fit are left out, and days with a source of lesser rank keep that one only.

    Reading names is most of this work, so it is dealt out, however few files or tasks the assets come in.
    """
    found = assets.repartition("name").withColumns(dict(source.facts(F.col("name"))))
    if source.static:
        return found
    if source.next_day:
        found = found.withColumn("day", F.when(F.col("band").isin(*source.next_day), F.date_sub("day", 1)).otherwise(F.col("day")))
    found = found.where("day is not null")
    if source.rank:
        first = found.groupBy("day").agg(F.min(source.rank).alias("_first"))
        found = found.join(F.broadcast(first), "day").where(F.col(source.rank) == F.col("_first")).drop("_first")  # one row for each day
    return found


def _lattice(zone: Column, size: Column) -> Column:
    """A lattice as one text: fractions as keys are normalized anew by every join, which then moves its rows again."""
    return F.concat_ws("/", zone.cast("string"), size.cast("string"))


def tasks_of(df: DataFrame, pixels: float | None = None) -> int:
    """As many tasks as the pixels ask for, and no fewer than joins have by themselves."""
    asked = math.ceil((pixels or 0) / PIXELS_A_TASK)
    return max(min(asked, MOST_TASKS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_turn(source: Source, chosen: DataFrame) -> DataFrame:
    """Assets with the number of their `turn` in the order of the source, written, so that names are read once and pixels are told apart by numbers."""
    return written(chosen.orderBy(*source.order).withColumn("turn", F.monotonically_increasing_id()))


def _placed(source: Source, chosen: DataFrame, readings: DataFrame, by: str = "name", dealt: bool = False) -> tuple[DataFrame, list[str], Column]:
    """Calibrated readings, dealt out by the pixels of lattices, where each belongs (lattice, day, gy, gx), and what the first of a pixel is the least of.

    chosen: assets in turn. There are as many tasks as their pixels ask for. Assets are the side that is kept in memory, so readings are not sorted.
    """
    tasks = tasks_of(chosen, chosen.agg(F.sum(F.col("rows").cast("double") * F.col("cols"))).first()[0])
    own = [by, "band"]
    read = readings.drop(*(set(chosen.columns) - set(own)))
    assets = chosen.withColumn("lattice", _lattice(F.col("zone"), F.col("size")))  # one text for each asset, not for each of its readings
    if not dealt:
        read, assets = read.repartition(tasks, *own), assets.repartition(tasks, *own)
    joined = read.join(assets.hint("shuffle_hash"), own)
    centre = lambda edge, i, sign: F.col(edge) + sign * (F.col(i) + 0.5) * F.col("size")
    placed = joined.select(
        "*",
        F.floor(-centre("top", "row", -1) / F.col("size")).alias("gy"),
        F.floor(centre("left", "col", 1) / F.col("size")).alias("gx"),
        source.value().cast("double").alias("value"),
    )
    keys = ["lattice", *([] if source.static else ["day"]), "gy", "gx"]
    first = F.col("turn") if source.latest else F.when(F.col("value").isNotNull(), F.col("turn"))
    # Dealt out by pixels alone, as the joins with targets and neighbours ask for: they move no rows again.
    return placed.select(*keys, "band", "turn", "value").repartition(tasks, "lattice", "gy", "gx"), keys, first


def native_pixels(source: Source, chosen: DataFrame, readings: DataFrame, by: str = "name", dealt: bool = False) -> DataFrame:
    """One calibrated reading for each pixel of a lattice, day and band: (lattice, day, band, gy, gx, value), value null where no product has a valid one."""
    placed, keys, first = _placed(source, chosen, readings, by, dealt)
    return placed.groupBy(*keys[:-2], "band", "gy", "gx").agg(F.min_by("value", first).alias("value"))


def _bit(n: int) -> int:
    return 1 << n


def native_bands(source: Source, chosen: DataFrame, readings: DataFrame, bands: Sequence[str], by: str = "name", dealt: bool = False) -> DataFrame:
    """The pixels of a lattice and day with their bands side by side: (lattice, day, gy, gx, v0, v1, ..., there), so that a pixel is grouped, met and moved once for all its bands.

    v0, v1, ...: the readings, in the order of `bands`; there: a bit for each band that has a product, valid or not.
    """
    placed, keys, first = _placed(source, chosen, readings, by, dealt)
    band = F.col("band")
    values = [F.min_by("value", F.when(band == b, first)).alias(f"v{n}") for n, b in enumerate(bands)]
    bit = F.coalesce(*[F.when(band == b, F.lit(_bit(n)).cast("long")) for n, b in enumerate(bands)])
    return placed.groupBy(*keys).agg(*values, F.bit_or(bit).alias("there"))


def _boxes(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """The longitudes and latitudes that rectangles of pixels span, by their corners and the middles of their edges."""
    places = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0.0, 0.5, 1.0) for b in (0.0, 0.5, 1.0) if (a, b) != (0.5, 0.5)]
    x = F.col("left") + F.col("_s.a") * F.col("cols") * F.col("size")
    y = F.col("top") - F.col("_s.b") * F.col("rows") * F.col("size")
    spots = df.withColumn("_s", F.explode(F.array(*places))).select(F.struct(*keys).alias(f"{side}_id"), "zone", x.alias("x"), y.alias("y"))
    ends = (F.min("lon").alias("min_x"), F.max("lon").alias("max_x"), F.min("lat").alias("min_y"), F.max("lat").alias("max_y"))
    return geographic(spots, "x", "y", "zone").groupBy(f"{side}_id").agg(*ends)


def positions(cells: DataFrame, chosen: DataFrame, tile: float = 1.0) -> DataFrame:
    """Where the centre of each target pixel lies in every lattice that has a product near its cell: (cell, y, x, lattice, nth, v, u) in pixels of the lattice, the `nth` of its cell.

    Each target pixel looks back into the lattice, so none is missed however the
    lattices are turned against each other. Cells and products meet in tiles of degrees.
    """
    pairs = box_join(
        _boxes(cells, ["cell"], "left"),
        _boxes(chosen.select("zone", "size", "left", "top", "rows", "cols").distinct(), ["zone", "size", "left", "top"], "right"),
        tile,
    )
    lattices = pairs.select(F.col("left_id.cell").alias("cell"), F.col("right_id.zone").alias("to_zone"), F.col("right_id.size").alias("to_size")).distinct()
    lattices = lattices.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("to_zone", "to_size")))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    few = cells.join(lattices, "cell")
    every = few.repartition(tasks_of(few), "cell").withColumn("y", F.explode(count("rows"))).withColumn("x", F.explode(count("cols")))
    own = every.withColumns({"own_x": F.col("left") + (F.col("x") + 0.5) * F.col("size"), "own_y": F.col("top") - (F.col("y") + 0.5) * F.col("size")})
    there = projected(geographic(own, "own_x", "own_y", "zone"), "to_zone", "to_x", "to_y")
    same = F.col("zone") == F.col("to_zone")
    return there.select(
        "cell",
        "y",
        "x",
        _lattice(F.col("to_zone"), F.col("to_size")).alias("lattice"),
        "nth",
        (-F.when(same, F.col("own_y")).otherwise(F.col("to_y")) / F.col("to_size")).alias("v"),
        (F.when(same, F.col("own_x")).otherwise(F.col("to_x")) / F.col("to_size")).alias("u"),
    )


def _pixel(place: Column) -> Column:
    """The pixel of a place. It is never null, so no test for nulls, with the whole projection written out in it, is pushed below the stages above."""
    return F.coalesce(F.floor(place), F.lit(-(1 << 62)))


def resampled(source: Source, at: DataFrame, native: DataFrame, values: Sequence[str]) -> DataFrame:
    """(cell, day, y, x, *values, there): readings at target pixels, of the nearest native pixel, or shared among the valid ones of the four around; then of the first zone that has one.

    native: (lattice, day, gy, gx, *values, there).
    """
    keys = ["cell", *([] if source.static else ["day"]), "y", "x"]
    there = F.bit_or("there").alias("there")
    if source.bilinear:
        corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
        gy, gx = _pixel(F.col("v") - 0.5) + F.col("c.a"), _pixel(F.col("u") - 0.5) + F.col("c.b")
        around = at.withColumn("c", corner).withColumns({"gy": gy, "gx": gx})
        weight = (1 - F.abs(F.col("v") - 0.5 - F.col("gy"))) * (1 - F.abs(F.col("u") - 0.5 - F.col("gx")))
        met = around.withColumn("w", weight).join(native, ["lattice", "gy", "gx"])
        shared = lambda v: F.sum(F.col("w") * F.col(v)) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col("w"))), F.lit(0.0))
        read = met.groupBy(*keys, "nth").agg(*[shared(v).alias(v) for v in values], there)
    else:
        read = at.withColumns({"gy": _pixel(F.col("v")), "gx": _pixel(F.col("u"))}).join(native, ["lattice", "gy", "gx"])
    first = lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), F.col("nth")))
    return read.groupBy(*keys).agg(*[first(v).alias(v) for v in values], there)


def _asked(cells: DataFrame, found: DataFrame, bands: Sequence[tuple[str, str]], days: DataFrame | None = None) -> DataFrame:
    """(cell, day, band, y, x, value) for every pixel of the cells, day and band, from the bands side by side. bands: (band, the column it stands in)."""
    dated = [] if days is None else ["day"]
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = cells.select("cell", F.explode(count("rows")).alias("y"), "cols").select("cell", "y", F.explode(count("cols")).alias("x"))
    if days is not None:
        calendar = days.agg(F.collect_set("day").alias("_days"))  # one row, as long as the sweep
        asked = asked.crossJoin(F.broadcast(calendar)).withColumn("day", F.explode("_days")).drop("_days")
    laid = asked.join(found, ["cell", *dated, "y", "x"], "left")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(v).alias("value")) for b, v in bands]))
    return laid.withColumn("_b", each).select("cell", *dated, "_b.band", "y", "x", "_b.value")


def fetch(source: Source, assets: DataFrame, readings: DataFrame, cells: DataFrame, bands: Sequence[str], days: DataFrame | None = None, by: str = "name", dealt: bool = False) -> DataFrame:
    """(cell, day, band, y, x, value) for every pixel of the cells, on the days and in the bands asked for; value null where there is none.

    bands: names of the registry; days: (day), unless the source is static. by: the column of assets and
    readings that tells products apart, where it is not their name. dealt: readings are already dealt
    out by `by` and band over as many tasks as they ask for, and are not moved again. Missing products are
    no errors. All joins are by equal keys; the product of cells, days and bands is the result itself.
    """
    chosen = in_turn(source, selected(source, assets.where(F.col("band").isin(*bands))))
    each = list(dict.fromkeys(bands))
    values = [f"v{n}" for n in range(len(each))]
    native = native_bands(source, chosen, readings, each, by, dealt).hint("shuffle_hash")  # a task holds PIXELS_A_TASK of them or fewer, whatever is asked of it; else all are sorted
    found = resampled(source, positions(cells, chosen), native, values)
    if source.whole:
        every = F.bit_or("there").over(Window.partitionBy("cell", *([] if source.static else ["day"])))  # the rows of one cell and day; a join would find all of them twice
        found = found.withColumn("_every", every).where(F.col("_every") == _bit(len(each)) - 1)
    if source.fill is not None:
        has = lambda n: F.col("there").bitwiseAND(F.lit(_bit(n)).cast("long")) != 0
        found = found.withColumns({v: F.when(has(n), F.coalesce(v, F.lit(source.fill))) for n, v in enumerate(values)})
    keys = ["cell", *([] if source.static else ["day"]), "y", "x"]
    return _asked(cells, found.select(*keys, *values), [(b, values[each.index(b)]) for b in bands], None if source.static else days)


def fetch_terrain(assets: DataFrame, readings: DataFrame, cells: DataFrame, least: float, source: Source = SOURCES["dem"], by: str = "name", dealt: bool = False) -> DataFrame:
    """(cell, band, y, x, value) with bands DEM, slope and aspect, for every pixel of the cells.

    Tiles in degrees are laid together first, so slopes know what lies beyond a
    tile's edge; they are found on the native lattice, where a degree along a row gets shorter
    with latitude, and then resampled. Heights under `least` leave all three null.
    """
    assets = in_turn(source, assets)
    native = native_pixels(source, assets, readings, by, dealt)
    size = F.substring_index("lattice", "/", -1).cast("double")
    steep = stencils.gradients(native, ["lattice"], "value").withColumn("size", size)
    across, along = C.degree_spacing(-(F.col("gy") + 0.5) * F.col("size"), F.col("size"), F.col("size"))
    slope, aspect = stencils.slope_and_aspect(F.col("east"), F.col("south"), across, along)
    valid = steep.where(F.col("value") >= least)
    bands = ["DEM", "slope", "aspect"]
    wide = valid.select("lattice", "gy", "gx", F.col("value").alias("DEM"), slope.alias("slope"), aspect.alias("aspect"), F.lit(7).cast("long").alias("there"))
    return _asked(cells, resampled(source, positions(cells, assets), wide, bands).drop("there"), [(b, b) for b in bands])
