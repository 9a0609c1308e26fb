"""Stencils over lattices of any extent: blocks of pixels with a border of their neighbours' pixels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bordered_blocks(pixels: DataFrame, block: int) -> DataFrame:
    """Every pixel (gy, gx) in its own block (by, bx) and, at most three times more, in those whose border it lies on."""
    near = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - 1) / block), F.floor(F.col(c) / block), F.floor((F.col(c) + 1) / block)))
    return pixels.withColumn("by", F.explode(near("gy"))).withColumn("bx", F.explode(near("gx")))


def _neighbours(grid: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The neighbours of all inner pixels; where there is none the one in the same row stands in, then that in the same column, then the pixel itself."""
    rows, cols = grid.shape[0] - 2, grid.shape[1] - 2
    part = lambda y, x: grid[1 + y : 1 + y + rows, 1 + x : 1 + x + cols]
    found = part(dy, dx)
    for other in (part(0, dx), part(dy, 0), part(0, 0)):
        found = np.where(np.isnan(found), other, found)
    return found


def gradients(pixels: DataFrame, keys: Sequence[str], value: str, block: int = 256) -> DataFrame:
    """Third-order differences on 3 x 3 pixels, per pixel: (*keys, gy, gx, value, east, south), east and south in units of the value for one pixel.

    The pixels of a key may span any number of tiles: a task sees one block and its
    border, at most (block + 2) squared pixels. Pixels without a reading are none; edges repeat themselves.
    """
    kept = pixels.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, "gy", "gx", F.col(value).cast("double").alias(value))
    schema = kept.select(*keys, "gy", "gx", value).schema.add("east", "double").add("south", "double")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        top, left = part["by"].iloc[0] * block - 1, part["bx"].iloc[0] * block - 1
        grid = np.full((block + 2, block + 2), np.nan)
        y, x = part["gy"].to_numpy() - top, part["gx"].to_numpy() - left
        grid[y, x] = part[value].to_numpy()
        n = {(a, b): _neighbours(grid, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
        east = ((n[-1, 1] + 2 * n[0, 1] + n[1, 1]) - (n[-1, -1] + 2 * n[0, -1] + n[1, -1])) / 8
        south = ((n[1, -1] + 2 * n[1, 0] + n[1, 1]) - (n[-1, -1] + 2 * n[-1, 0] + n[-1, 1])) / 8
        own = (y >= 1) & (y <= block) & (x >= 1) & (x <= block)
        at = y[own] - 1, x[own] - 1
        return part.loc[own, [*keys, "gy", "gx", value]].assign(east=east[at], south=south[at])

    return bordered_blocks(kept, block).groupBy(*keys, "by", "bx").applyInPandas(run, schema)


def slope_and_aspect(east: Column, south: Column, size_x: Column | float, size_y: Column | float) -> tuple[Column, Column]:
    """Degrees of slope and aspect from differences for one pixel and its sizes in metres. Level ground faces west (270), as from a signed zero."""
    dx, dy = east / size_x, south / size_y
    aspect = F.when((dx == 0) & (dy == 0), 270.0).otherwise(F.pmod(450 - F.degrees(F.atan2(dy, -dx)), F.lit(360.0)))
    return F.degrees(F.atan(F.hypot(dx, dy))), aspect
