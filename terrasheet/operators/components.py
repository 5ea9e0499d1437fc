"""Connected components of flagged pixels.

Each tile is labelled in one task by joining runs of pixels of its rows; then only pixels on both sides of a tile border are joined
as links between tile labels, whose components are found by star contraction. What is shuffled besides the pixels grows
with the borders of the tiles. A component's label is y * width + x of its first pixel in reading order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected, groups_of, in_groups, least_reachable, settled

#: Side of a tile in pixels: a task's group holds at most TILE * TILE of them.
TILE = 256
#: Labels are y * WIDTH + x, so that they don't depend on a map's own width.
WIDTH = 1 << 24


def label_tile(y: np.ndarray, x: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each pixel (in order by y, x, each once) the index of the first pixel of its component.

    Runs of neighbours in a row are found first; a run's neighbours in the row above lie between two places of a sorted
    search, and only runs are joined one by one.
    """
    if not len(y):
        return np.zeros(0, np.int64)
    y, x, wide = y.astype(np.int64) - int(y.min()), x.astype(np.int64) - int(x.min()), int(x.max() - x.min()) + 3
    fresh = np.ones(len(y), bool)
    fresh[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(y)))
    left = y[begin] * wide + x[begin] + 1
    right = left + size - 1
    corner = int(diagonal)
    low = np.searchsorted(right, left - wide - corner)
    many = np.maximum(np.searchsorted(left, right - wide + corner, "right") - low, 0)
    own = np.repeat(np.arange(len(begin)), many)
    above = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    first = np.arange(len(begin))
    nodes, least = least_reachable(own, above)
    first[nodes] = least
    return np.repeat(begin[first], size)


def components(df: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """(map_id, y, x, label) of the pixels in df, which are those that have the flag. diagonal: corners connect as well."""
    kind = df.schema["map_id"].dataType.simpleString()

    def labels(pixels: pd.DataFrame) -> pd.DataFrame:
        pixels = pixels.sort_values(["map_id", "ty", "tx", "y", "x"], ignore_index=True)
        code, _ = groups_of(pixels, ["map_id", "ty", "tx"])
        # one below the other, the tiles don't touch
        first = label_tile(code * (tile + 2) + pixels.y.to_numpy() % tile, pixels.x.to_numpy() % tile, diagonal)
        return pixels.assign(own=pixels.y.to_numpy()[first].astype(np.int64) * WIDTH + pixels.x.to_numpy()[first])[["map_id", "y", "x", "own"]]

    cells = df.select("map_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    tiled = cells.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    labelled = in_groups(tiled, ["map_id", "ty", "tx"], labels, f"map_id {kind}, y int, x int, own long")
    labelled = settled(labelled)  # read three times below

    low, high = lambda c: F.col(c) % tile == 0, lambda c: F.col(c) % tile == tile - 1
    rim = labelled.where(low("y") | low("x") | high("y") | high("x"))
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * diagonal
    ahead = rim.select("map_id", F.col("own").alias("a"), F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])).alias("p"))
    links = ahead.select("map_id", "a", "p.y", "p.x").join(rim.select("map_id", "y", "x", F.col("own").alias("b")), ["map_id", "y", "x"]).where("a <> b").select("map_id", "a", "b").distinct()
    joined = connected(links)
    out = labelled.join(joined.select("map_id", F.col("node").alias("own"), "label"), ["map_id", "own"], "left")
    return out.select("map_id", "y", "x", F.coalesce("label", "own").alias("label"))


def without_small(labelled: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The pixels of components of `least` pixels or more, and those of smaller ones."""
    sizes = labelled.groupBy("map_id", "label").agg(F.count("*").alias("_n"))
    sized = labelled.join(sizes, ["map_id", "label"])
    return sized.where(F.col("_n") >= least).drop("_n"), sized.where(F.col("_n") < least).drop("_n")


def fill_holes(df: DataFrame, flag: str, tile: int = TILE) -> DataFrame:
    """df (dense) with the flag also on pixels without it that no path of such pixels joins to the border."""
    size = df.groupBy("map_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    outside = components(df.where(~F.col(flag)).select("map_id", "y", "x"), False, tile)
    border = outside.join(size, "map_id").where((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("_h")) | (F.col("x") == F.col("_w")))
    open_labels = border.select("map_id", "label").distinct()
    reached = outside.join(open_labels, ["map_id", "label"], "left_semi").select("map_id", "y", "x", F.lit(True).alias("_open"))
    return df.join(reached, ["map_id", "y", "x"], "left").withColumn(flag, F.col("_open").isNull()).drop("_open")
