"""Product folders, areas of interest, manifests, requests and statistics as readers and writers."""

from __future__ import annotations

import functools
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def products(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """One row for each product file: path, name, length, modified. Contents are not read."""
    return _files(spark, folder, pattern).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def product_catalogue(spark: SparkSession, folders: dict[str, tuple[str, str]]) -> DataFrame:
    """Products of all modalities: modality, path, name, length, modified. folders: modality to (folder, pattern of names)."""
    found = [products(spark, folder, pattern).select(F.lit(modality).alias("modality"), "*") for modality, (folder, pattern) in folders.items()]
    return functools.reduce(DataFrame.unionByName, found)


def decode_products(spark: SparkSession, folder: str, pattern: str, decode: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that `decode` makes of each file's path and content; products of many megabytes want spark.sql.execution.arrow.maxRecordsPerBatch at 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield decode(path, content)

    return _files(spark, folder, pattern).select("path", "content").mapInPandas(run, schema)


#: Schema of `npy_pixels`.
NPY_SCHEMA = "path string, y long, x long, value double"


def npy_pixels(path: str, content: bytes) -> pd.DataFrame:
    """Pixels of a two-dimensional array file."""
    grid = np.load(io.BytesIO(content), allow_pickle=False)
    y, x = np.indices(grid.shape)
    return pd.DataFrame({"path": path, "y": y.ravel(), "x": x.ravel(), "value": grid.ravel().astype(float)})


def area_of_interest(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """Outer ring of the one polygon in a GeoJSON file, its closing corner left out; anything but one polygon is an error."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
    found = spark.read.schema(schema).option("multiLine", "true").json(path).selectExpr("inline(features)").select("geometry.*").limit(2).collect()
    if len(found) != 1 or found[0]["type"] != "Polygon":
        raise ValueError(f"{path}: one polygon is wanted")
    ring = spark.range(1).select(F.from_json(F.lit(found[0]["coordinates"]), "array<array<array<double>>>")[0].alias("r")).first()["r"]
    corners = [(c[0], c[1]) for c in ring]
    return corners[:-1] if corners[0] == corners[-1] else corners


#: Columns of a clip manifest and of point requests.
MANIFEST_SCHEMA = "product string, source string, action string, area_km2 double, valid_pixels long"
REQUEST_SCHEMA = "name string, lat double, lon double, day date"


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.select([F.col(f.split()[0]) for f in MANIFEST_SCHEMA.split(", ")]).write.mode("overwrite").option("header", "true").csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("header", "true").option("enforceSchema", "false").csv(path)


def point_requests(spark: SparkSession, path: str) -> DataFrame:
    """Named points with their days; malformed rows are an error."""
    return spark.read.schema(REQUEST_SCHEMA).option("header", "true").option("mode", "FAILFAST").csv(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    """Means and deviations of bands as JSON lines."""
    stats.select("tier", "band", "n", "mean", "std").write.mode("overwrite").json(path)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tier string, band string, n long, mean double, std double").json(path)
