"""The registry of bands: tiers, least valid readings, and which bands are normalized by fixed numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.columns import bits, two_sigma

#: Bands of each tier in the order of the cube.
TIERS = {
    "s_t_h_x": "VV VH angle B2 B3 B4 B8 B11 B12 B2_landsat B3_landsat B4_landsat B5_landsat B6_landsat B7_landsat".split(),
    "s_t_m_x": "Oa17_radiance Oa21_radiance".split(),
    "s_t_l_x": [*(f"sur_refl_b0{k}" for k in range(1, 8)), "I1", "I3", "NDSI", "NDVI"],
    "sp_x": ["elevation", "slope", "aspect", *(f"land_cover_{k}" for k in range(11))],
    "t_x": "M5 M7 M10 M11 temperature_2m temperature_2m_max total_precipitation u_wind v_wind".split(),
    "st_x": "x y z".split(),
}
#: The least valid reading, inclusive. Radar and its angle, optical, reflectance, radiance, surface
#: reflectance, imager, indices; terrain, land cover; imager, temperature, precipitation, wind; position.
LEAST = {
    "s_t_h_x": [-50, -50, 0, *[-1] * 6, *[1e-7] * 6],
    "s_t_m_x": [-1, -1],
    "s_t_l_x": [*[-100] * 7, -0.01, -0.01, -1, -1],
    "sp_x": [1e-7, 0, 0, *[0] * 11],
    "t_x": [*[-0.01] * 4, 184, 184, -1, -53, -53],
    "st_x": [-1, -1, -1],
}
NODATA = -9999.0
#: Bands that keep their numbers: indices, land cover and position lie in fixed ranges.
FIXED = ("NDSI", "NDVI", *TIERS["sp_x"][3:], *TIERS["st_x"])


def registry(spark: SparkSession) -> DataFrame:
    """(tier, position, band, least), a row for each of the 54 bands; position counts over all tiers."""
    rows = [(tier, band, float(low)) for tier, bands in TIERS.items() for band, low in zip(bands, LEAST[tier])]
    return spark.createDataFrame([(tier, k, band, low) for k, (tier, band, low) in enumerate(rows)], "tier string, position int, band string, least double")


def is_valid(value: Column, least: Column) -> Column:
    """A reading that is neither missing nor the fill, and not under its band's least one."""
    return F.coalesce((value != NODATA) & ~F.isnan(value) & (value >= least), F.lit(False))


def normalized(value: Column, valid: Column, band: Column, mean: Column, std: Column) -> Column:
    """Readings by two deviations around the mean; bands of fixed range as they are, what is not valid as the fill."""
    fixed = band.isin(*FIXED)
    return F.when(~valid, NODATA).when(fixed, value).otherwise(two_sigma(value, mean, F.when(fixed, 1.0).otherwise(std)))

#: For each sensor the first of the quality bits that are zero where the sky is clear, and how many they are.
CLEAR_BITS = {"landsat": (3, 2), "modis": (0, 2), "viirs": (2, 2), "s3": (27, 1), "s2": (10, 2)}
#: Fixed value: the cloud probability, in percent, that clear pixels stay under.
CLEAR_PROBABILITY = 5


def is_clear(sensor: str, quality: Column) -> Column:
    """Whether a sensor's quality word says that a pixel is clear: no cloud or shadow, cloud state 0, or a probability under the bound."""
    if sensor == "s2_probability":
        return quality < CLEAR_PROBABILITY
    low, width = CLEAR_BITS[sensor]
    return bits(quality, low, width) == 0
