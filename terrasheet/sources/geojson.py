"""Polygons as GeoJSON features and collections, written and read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of a feature as this module writes it.
FEATURE = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<fill: string, type: string, probability: struct<background: double, building: double, water: double>>"


def closed(ring: Column) -> Column:
    """The ring's coordinate pairs, the first one again at the end."""
    pair = lambda p: F.array(p["x"], p["y"])
    return F.transform(F.concat(ring, F.slice(ring, 1, 1)), pair)


def feature(ring: Column, properties: Column, holes: Column | None = None) -> Column:
    """A Polygon feature as JSON; null members are left out."""
    rings = F.array(closed(ring)) if holes is None else F.concat(F.array(closed(ring)), F.transform(holes, closed))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def collections(features: DataFrame, by: str, json: str = "feature", order: str = "label") -> DataFrame:
    """(by, collection): a FeatureCollection of each map's features, in order. A map's features fit in a task's memory."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, json))), lambda f: f[json]), ",")
    return features.groupBy(by).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}")).alias("collection"))


def write(collected: DataFrame, by: str, path: str) -> None:
    """One folder per map, <by>=..., of text files."""
    collected.select(by, F.col("collection").alias("value")).write.partitionBy(by).text(path)


def read(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(by, type, geometry, properties): a row per feature of what write() has written."""
    whole = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", f"type string, features array<struct<{FEATURE}>>")
    return whole.select(by, F.explode(parsed["features"]).alias("f")).select(by, "f.*")
