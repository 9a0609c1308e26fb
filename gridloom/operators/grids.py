"""Grids of cells: lattices over an area, the grid of a sweep, its rows in order; mosaics over several projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators.aggregates import first_valid
from gridloom.operators.joins import point_in_polygon


def shrunk(ring: Sequence[tuple[float, float]], inset: float) -> list[tuple[float, float]]:
    """A convex ring with every edge moved inwards by `inset`; an error if nothing is left of it."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2
    turn = 1 if area > 0 else -1
    lines = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        nx, ny = -turn * (y2 - y1) / length, turn * (x2 - x1) / length
        lines.append((nx, ny, nx * x1 + ny * y1 + inset))
    corners = []
    for (a, b, c), (d, e, f) in zip([lines[-1], *lines[:-1]], lines):
        cross = a * e - b * d
        corners.append(((c * e - b * f) / cross, (a * f - c * d) / cross))
    if any(nx * x + ny * y < c - 1e-9 * (1 + abs(c)) for x, y in corners for nx, ny, c in lines):
        raise ValueError(f"an inset of {inset} leaves nothing of the area")
    return corners


def lattice(spark: SparkSession, ring: Sequence[tuple[float, float]], size: float, inset: float = 0.0) -> DataFrame:
    """Cells (cell_id, min_x, min_y, max_x, max_y) of a lattice snapped to multiples of `size` that touch an area.

    ring: the area's corners in metres; an inset, which wants a convex area, drops the
    cells of its border. Ids count the lattice's places row by row from the south and
    west, so they follow from a cell's place and are the same however cells are dealt.
    """
    if inset < 0:
        raise ValueError("an inset is not negative")
    ring = shrunk(ring, inset) if inset else list(ring)
    first = lambda k: int(min(c[k] for c in ring) // size)
    last = lambda k: int(-(-max(c[k] for c in ring) // size)) - 1
    rows = spark.range(first(1), last(1) + 1).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(first(0)), F.lit(last(0)))).alias("col"))
    x, y = F.col("col") * size, F.col("row") * size
    _, touched = G.box_in_polygon(x, y, x + size, y + size, ring)
    number = (F.col("row") - first(1)) * (last(0) - first(0) + 1) + F.col("col") - first(0)
    kept = rows.where(touched).select(number.alias("cell_id"), x.alias("min_x"), y.alias("min_y"))
    return kept.select("*", (F.col("min_x") + size).alias("max_x"), (F.col("min_y") + size).alias("max_y"))


def distinct_cells(samples: DataFrame, size: float) -> DataFrame:
    """One cell for each place of the lattice that a sample (id, x, y) lies in, with the least id there."""
    row, col = F.floor(F.col("y") / size), F.floor(F.col("x") / size)
    cells = samples.groupBy(row.alias("row"), col.alias("col")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    low = [F.col(c) * size for c in ("col", "row")]
    return cells.select("row", "col", "first_id", "n", low[0].alias("min_x"), low[1].alias("min_y"), (low[0] + size).alias("max_x"), (low[1] + size).alias("max_y"))


def build_grid(mode: str, ring: Sequence[tuple[float, float]], size: float, samples: DataFrame | None = None, fully_inside: bool = False, inset: float = 0.0, spark: SparkSession | None = None) -> DataFrame:
    """Cells of a sweep: mode A keeps the cells of samples whose centre (or all of them, which may touch its edges) is in the area, mode B tiles the area itself."""
    if mode == "B":
        return lattice(spark or samples.sparkSession, ring, size, inset).select("min_x", "min_y", "max_x", "max_y")
    if mode != "A":
        raise ValueError(f"a grid has mode A or B, not {mode}")
    cells = distinct_cells(samples, size)
    if fully_inside:
        keep = G.box_covered(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), ring)
    else:
        keep = point_in_polygon(F.col("min_x") + size / 2, F.col("min_y") + size / 2, ring)
    return cells.where(keep).select("min_x", "min_y", "max_x", "max_y")


def in_order(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows as they are put out: by day and cell, by prediction day and position, or by name. Spark sorts by ranges, so no task sees all."""
    return rows.orderBy(*keys)


def combined_zones(pixels: DataFrame, target: Sequence[str], zone: str, order: Sequence[str], value: str) -> DataFrame:
    """Mosaic of pixels that come in several projections: in each target pixel the first zone with a valid reading, and in it the first reading by `order`.

    Each pixel carries the target pixel that it falls into, found from its position in
    its own zone, so no two projections meet before the target grid.
    """
    return first_valid(pixels, target, [F.col(zone), *[F.col(o) for o in order]], value)
