"""A catalogue of products: items with box, day and assets, extents of collections, items as JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalogue_items(products: DataFrame, collection: Column, item: Column, box: Column, day: Column, href: Column) -> DataFrame:
    """(collection, id, bbox, day, href), a row for each product; box is a struct of min_lon, min_lat, max_lon, max_lat."""
    return products.select(collection.alias("collection"), item.alias("id"), box.alias("bbox"), day.alias("day"), href.alias("href"))


def catalogue_extents(items: DataFrame) -> DataFrame:
    """The box and the days that each collection's items lie in, and their number."""
    low, high = (lambda c: F.min(f"bbox.{c}").alias(c)), (lambda c: F.max(f"bbox.{c}").alias(c))
    return items.groupBy("collection").agg(low("min_lon"), low("min_lat"), high("max_lon"), high("max_lat"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"))


def item_documents(items: DataFrame, version: str = "1.0.0") -> DataFrame:
    """(collection, id, document): each item as a GeoJSON feature of the SpatioTemporal Asset Catalog, to be written as JSON lines."""
    b = F.col("bbox")
    corner = lambda x, y: F.array(b[x], b[y])
    ring = F.array(corner("min_lon", "min_lat"), corner("max_lon", "min_lat"), corner("max_lon", "max_lat"), corner("min_lon", "max_lat"), corner("min_lon", "min_lat"))
    document = F.struct(
        F.lit("Feature").alias("type"), F.lit(version).alias("stac_version"), "id", "collection",
        F.array(b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"]).alias("bbox"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'").alias("datetime")).alias("properties"),
        F.struct(F.struct("href").alias("data")).alias("assets"),
    )
    return items.select("collection", "id", F.to_json(document).alias("document"))
