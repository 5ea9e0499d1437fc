"""Small numpy functions over one dense array or ring, and the raster form of the enlarged difference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps around a pixel, clockwise from the right (y grows downwards).
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def grid(pixels: pd.DataFrame, value: str, fill: float) -> tuple[np.ndarray, int, int]:
    """The values as a dense array, and the least y and x."""
    y0, x0 = int(pixels.y.min()), int(pixels.x.min())
    out = np.full((int(pixels.y.max()) - y0 + 1, int(pixels.x.max()) - x0 + 1), fill, float)
    out[pixels.y.to_numpy() - y0, pixels.x.to_numpy() - x0] = pixels[value].to_numpy(float)
    return out, y0, x0


def traced(mask: np.ndarray, start: tuple[int, int] | None = None, look: int = 4) -> np.ndarray:
    """The border of a mask from the pixel `start`, whose neighbour in the direction `look` is off, as (x, y) of pixel
    centres; runs on a line are merged. By default the outer border of the first component in reading order.
    """
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.zeros((0, 2))
    start = start or (int(ys[0]), int(xs[0]))
    on = lambda p: 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and bool(mask[p])
    path, at = [start], start
    first = None
    while True:
        for k in range(1, 9):
            turn = (look + k) % 8
            to = (at[0] + AROUND[turn][0], at[1] + AROUND[turn][1])
            if on(to):
                break
        else:
            break
        if first is None:
            first = (at, to)
        elif (at, to) == first:
            path.pop()
            break
        path.append(to)
        at, look = to, (turn + 4) % 8
    points = np.array([(x, y) for y, x in path], float)
    if len(points) < 3:
        return points
    before, after = points - np.roll(points, 1, 0), np.roll(points, -1, 0) - points
    corner = (before != after).any(1)
    return points[corner] if corner.any() else points


def parts_of(mask: np.ndarray, diagonal: bool) -> list[np.ndarray]:
    """The components of a mask as masks, the largest first; of equals the first in reading order."""
    from .components import label_tile

    ys, xs = np.nonzero(mask)
    own = label_tile(ys, xs, diagonal)
    labels, sizes = np.unique(own, return_counts=True)
    out = []
    for label in labels[np.argsort(-sizes, kind="stable")]:
        one = np.zeros(mask.shape, bool)
        one[ys[own == label], xs[own == label]] = True
        out.append(one)
    return out


def hole_rings(mask: np.ndarray) -> list[np.ndarray]:
    """The borders of the holes of a mask, the largest first: rings of the mask's own pixels around each."""
    wide = np.pad(mask, 1)
    out = []
    for gap in parts_of(~wide, False):
        y, x = (int(v[0]) for v in np.nonzero(gap))
        if (y, x) == (0, 0):
            continue
        ring = traced(wide, (y, x - 1), 0) - 1  # what lies before a hole's first pixel is no part of it
        if len(ring) > 2:
            out.append(ring)
    return out


def cross_closed(mask: np.ndarray) -> np.ndarray:
    """Binary closing by a cross of 3 x 3, as if the mask lay on an endless plane."""
    wide = np.pad(mask, 2)
    grown = wide | np.roll(wide, 1, 0) | np.roll(wide, -1, 0) | np.roll(wide, 1, 1) | np.roll(wide, -1, 1)
    return (grown & np.roll(grown, 1, 0) & np.roll(grown, -1, 0) & np.roll(grown, 1, 1) & np.roll(grown, -1, 1))[2:-2, 2:-2]


def mitred(ring: np.ndarray, by: float, limit: float = 5.0) -> np.ndarray:
    """The ring moved outwards: neighbouring edges are shifted and meet in their corner, or are cut beyond the limit."""
    if len(ring) < 3:
        return ring
    area = np.sum(ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1])
    own = ring if area > 0 else ring[::-1]
    along = np.roll(own, -1, 0) - own
    along = along / np.maximum(np.hypot(along[:, 0], along[:, 1]), 1e-12)[:, None]
    normal = np.stack([along[:, 1], -along[:, 0]], 1)
    out = []
    for k in range(len(own)):
        a, b = normal[k - 1], normal[k]
        bend = 1 + a @ b
        if bend > 1e-9 and 2 / bend <= limit * limit:
            out.append(own[k] + by * (a + b) / bend)
        else:
            out += [own[k] + by * (a + along[k - 1]), own[k] + by * (b - along[k])]
    return np.array(out)


def enlarged(polygons: DataFrame, by: float, ring: str = "ring") -> DataFrame:
    """polygons with their ring moved outwards by `by`."""
    from .geometry import mapped

    return polygons.withColumn(ring, mapped(lambda p: mitred(p, by))(F.col(ring)))


def without_neighbours(labelled: DataFrame, neighbours: DataFrame, reach: int, outline: DataFrame) -> DataFrame:
    """(map_id, y, x, label): each label grown by `reach` pixels (a square) within the outline, less what neighbours take.

    The raster form of enlarging polygons and subtracting their neighbours (map_id, label, neighbour) one after another, from
    the highest label to the lowest. Of two labels that list each other, the one treated last keeps what both grew into; a
    label that lists another one-sidedly loses it; pixels that a label has from the start are its own. Where grown labels
    that aren't neighbours overlap, both keep a pixel. Growing is two separable steps that drop repeated pixels in between.
    """
    cells = labelled.select("map_id", "label", "y", "x").distinct()
    spread = lambda df, c: df.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))).distinct()
    grown = spread(spread(cells, "x"), "y").join(outline.select("map_id", "y", "x").distinct(), ["map_id", "y", "x"], "left_semi")
    grown = grown.join(cells.withColumn("own", F.lit(True)), ["map_id", "label", "y", "x"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    others = grown.toDF("map_id", *[c if c in ("y", "x") else {"label": "neighbour", "own": "theirs"}[c] for c in grown.columns[1:]])
    kind = labelled.schema["label"].dataType
    near = neighbours.select("map_id", *[F.col(c).cast(kind).alias(c) for c in ("label", "neighbour")]).distinct()
    back = near.select("map_id", F.col("neighbour").alias("label"), F.col("label").alias("neighbour"), F.lit(True).alias("mutual"))
    near = near.join(back, ["map_id", "label", "neighbour"], "left")
    met = grown.where(~F.col("own")).join(others, ["map_id", "y", "x"]).join(near, ["map_id", "label", "neighbour"])
    lost = met.where(F.col("theirs") | (F.col("neighbour") < F.col("label")) | F.col("mutual").isNull()).select("map_id", "label", "y", "x").distinct()
    return grown.join(lost, ["map_id", "label", "y", "x"], "left_anti").select("map_id", "y", "x", "label")
