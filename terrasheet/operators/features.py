"""Features of objects: robust colour statistics and measures of shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FEATURES, MIN_USABLE_PIXELS, SELECTED
from ..functions import rings


def spectral(df: DataFrame, by: list[str], bands: list[str]) -> DataFrame:
    """Per object median, median absolute deviation, mean, skewness and deviation (of the population) of each band.

    Two aggregations by the same key: the deviations need the medians. Constant bands have skewness 0.
    """
    centre = df.groupBy(*by).agg(*[F.median(b).alias(f"median_{b}") for b in bands])
    near = df.join(centre, by)
    parts = [("mad", lambda b: F.median(F.abs(F.col(b) - F.col(f"median_{b}")))), ("mean", F.avg), ("skew", lambda b: F.coalesce(F.skewness(b), F.lit(0.0))), ("std", F.stddev_pop)]
    first = [F.first(f"median_{b}").alias(f"median_{b}") for b in bands]
    return near.groupBy(*by).agg(F.count("*").alias("n"), *first, *[f(b).alias(f"{name}_{b}") for name, f in parts for b in bands])


def shape(df: DataFrame, ring: str, hull: str, map_area: Column, holes: str | None = None) -> DataFrame:
    """df with the seven measures of shape of a ring and its convex hull; map_area: of the map's outline.

    Null where a divisor is 0.
    """
    box, own = rings.rotated_rectangle(F.col(hull)), F.col("_area")
    inner = F.col(holes) if holes else None
    sized = df.withColumn("_area", rings.area(F.col(ring), inner)).withColumn("_length", rings.perimeter(F.col(ring), inner)).withColumn("_box", box).withColumn("_hull", rings.area(F.col(hull))).withColumn("_around", rings.length(F.col(hull)))
    long, short = F.col("_box.length"), F.col("_box.breadth")
    return sized.withColumns({
        "rectangularity": F.try_divide(own, long * short),
        "solidity": F.try_divide(own, F.col("_hull")),
        "aspect_ratio": F.try_divide(long, short),
        "elongation": F.try_divide(F.abs(long - short), long),
        "circularity": F.try_divide(own, F.col("_length") * F.col("_length")),
        "convexity": F.try_divide(F.col("_around"), F.col("_length")),
        "relative_area": F.try_divide(own, map_area),
    }).drop("_area", "_length", "_box", "_hull", "_around")


def vector(selected: list[int] | None = None, pixels: str = "n", least: int = MIN_USABLE_PIXELS) -> Column:
    """The selected features in order as an array; all zeros for objects of fewer usable pixels, and 0 for nulls."""
    names = [FEATURES[i] for i in (selected or SELECTED)]
    own = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    return F.when(F.coalesce(F.col(pixels), F.lit(0)) < least, F.array_repeat(F.lit(0.0), len(names))).otherwise(own)


def standardise(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """The columns centred and scaled by the deviation of the population, of `fit` or else of df; constants by 1."""
    stats = (fit or df).agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("stats")).scalar()
    scaled = [((F.col(c) - F.col("_stats")[c]["m"]) / F.when(F.col("_stats")[c]["s"] == 0, 1.0).otherwise(F.col("_stats")[c]["s"])).alias(c) for c in columns]
    return df.withColumn("_stats", stats).select(*[c for c in df.columns if c not in columns], *scaled)


def stored(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The feature store at `path`: read if it is there, else computed, written as Parquet and read back."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        compute().write.parquet(path)
        return spark.read.parquet(path)
