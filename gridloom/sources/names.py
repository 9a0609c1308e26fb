"""Facts in product names and small metadata texts. A name that does not fit gives nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(name: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def _date(text: Column, pattern: str = "yyyyMMdd") -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


#: Scenes of level 1 with terrain correction, tier 1.
_LANDSAT = r"^(LC0[89])_L1TP_(\d{3})(\d{3})_(\d{8})_(\d{8})_02_T1(?:\.|$)"
#: Granules of level 1C.
_SENTINEL2 = r"^S2[ABC]_MSIL1C_(\d{8})T\d{6}_N(\d{4})_R\d{3}_(T\d{2}[0-9A-Z]{3})_(\d{8})T\d{6}"
#: Ground-range products, as they are named or as their calibrated rasters are.
_SENTINEL1 = r"^(?:s1_grd_)?S1[A-Z]_IW_GRDH_\w+?_(\d{8})T\d{6}_\d{8}T\d{6}_\d{6}_[0-9A-F]{6}_([0-9A-F]{4})(?:\.|$)"


def landsat_name(name: Column) -> Column:
    """Sensor, path, row, days of acquisition and processing."""
    return F.struct(_part(name, _LANDSAT, 1).alias("sensor"), _part(name, _LANDSAT, 2).alias("path"), _part(name, _LANDSAT, 3).alias("row"), _date(_part(name, _LANDSAT, 4)).alias("acq"), _date(_part(name, _LANDSAT, 5)).alias("proc"))


def sentinel2_name(name: Column) -> Column:
    """Days of acquisition and processing, baseline, tile."""
    return F.struct(_date(_part(name, _SENTINEL2, 1)).alias("acq"), (_part(name, _SENTINEL2, 2).cast("int") / 100).alias("baseline"), _part(name, _SENTINEL2, 3).alias("tile"), _date(_part(name, _SENTINEL2, 4)).alias("proc"))


def manifest_baseline(xml: Column, path: str, name: Column) -> Column:
    """The baseline that a manifest states at a path, else the one in the product's name."""
    return F.coalesce(F.nullif(F.xpath_string(xml, F.lit(path)), F.lit("")).cast("double"), sentinel2_name(name)["baseline"])


def sentinel1_name(name: Column) -> Column:
    """Day of acquisition and the product's own number."""
    return F.struct(_date(_part(name, _SENTINEL1, 1)).alias("acq"), _part(name, _SENTINEL1, 2).alias("uid"))


def julian_date(name: Column) -> Column:
    """The date in A{YYYY}{DOY}."""
    return _date(_part(name, r"(?:^|\.)A(\d{7})", 1), "yyyyDDD")


def cube_name(day: Column, lat: Column, lon: Column, cell: Column) -> Column:
    return F.format_string("PR_%s_%.4f_%.4f_SC%02d.tif", F.date_format(day, "yyyyMMdd"), lat, lon, cell)


_CUBE = r"^PR_(\d{8})_(-?[\d.]+)_(-?[\d.]+)_SC(\d{2,})\.tif$"


def parse_cube_name(name: Column) -> Column:
    return F.struct(_date(_part(name, _CUBE, 1)).alias("day"), _part(name, _CUBE, 2).cast("double").alias("lat"), _part(name, _CUBE, 3).cast("double").alias("lon"), _part(name, _CUBE, 4).cast("int").alias("cell"))


def box_identifier(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    return F.format_string("min_lat=%.4f_min_lon=%.4f_max_lat=%.4f_max_lon=%.4f", min_lat, min_lon, max_lat, max_lon)


def identifier_centre(name: Column) -> tuple[Column, Column]:
    """Means of all lat= and lon= numbers in an identifier."""

    def mean(key: str) -> Column:
        found = F.regexp_extract_all(name, F.lit(rf"{key}=(-?[\d.]*\d)"), F.lit(1))
        return F.aggregate(found, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.nullif(F.size(found), F.lit(0))

    return mean("lat"), mean("lon")


def location_season(name: Column) -> Column:
    return F.substring_index(name, "_dates=", 1)


def month_index(name: Column) -> Column:
    """Month less one: after "dates=", else the month of the first eight-digit date."""
    digits = F.coalesce(_part(name, r"dates=\d{4}-?(\d{2})", 1), _part(name, r"_\d{4}(\d{2})\d{2}(?:_|\.|$)", 1))
    return digits.cast("int") - 1


def strip_epsg(name: Column) -> Column:
    return F.regexp_replace(name, r"_EPSG:\d+\.tif$", "")


def gml_footprint(text: Column) -> Column:
    """(lon, lat) corners of a GML coordinate text, commas or spaces between latitude and longitude; null if odd or under six numbers."""
    numbers = F.filter(F.split(F.trim(text), r"[,\s]+"), lambda t: t != "")
    corners = F.transform(F.sequence(F.lit(0), F.size(numbers) - 2, F.lit(2)), lambda k: F.struct(F.get(numbers, k + 1).cast("double").alias("lon"), F.get(numbers, k).cast("double").alias("lat")))
    return F.when((F.size(numbers) >= 6) & (F.size(numbers) % 2 == 0), corners)


def band_label(variable: Column, step: Column) -> Column:
    return F.concat_ws("_", variable, step.cast("string"))


_MTL = "$.LANDSAT_METADATA_FILE."


#: The corners of a product, clockwise from the upper left.
_CORNERS = [tuple(f"CORNER_{c}_{axis}_PRODUCT" for axis in ("LON", "LAT")) for c in ("UL", "UR", "LR", "LL")]


def mtl_footprint(text: Column) -> Column:
    """(lon, lat) of the four product corners in a scene's JSON metadata, clockwise from the upper left; null if one is missing. The text is built and read once for all of them."""
    schema = "struct<LANDSAT_METADATA_FILE:struct<PROJECTION_ATTRIBUTES:struct<" + ",".join(f"{name}:string" for pair in _CORNERS for name in pair) + ">>>"
    found = F.array(F.from_json(text, schema)["LANDSAT_METADATA_FILE"]["PROJECTION_ATTRIBUTES"])
    corners = F.transform(found, lambda a: F.array(*[F.struct(a[lon].cast("double").alias("lon"), a[lat].cast("double").alias("lat")) for lon, lat in _CORNERS]))
    return F.get(F.filter(corners, lambda ring: F.forall(ring, lambda c: c["lon"].isNotNull() & c["lat"].isNotNull())), F.lit(0))


def mtl_radiometry(text: Column, band: int) -> Column:
    """Factor, summand and sun elevation of a band in a scene's JSON metadata."""
    number = lambda path: F.get_json_object(text, _MTL + path).cast("double")
    rescaling = "LEVEL1_RADIOMETRIC_RESCALING.REFLECTANCE_"
    return F.struct(number(f"{rescaling}MULT_BAND_{band}").alias("mult"), number(f"{rescaling}ADD_BAND_{band}").alias("add"), number("IMAGE_ATTRIBUTES.SUN_ELEVATION").alias("sun_elevation"))
