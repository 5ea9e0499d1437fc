"""Operators on rasters as pixel rows (map_id, y, x, values): stencils, morphology, crops, padding, tiles.

Stencils are separable, first along rows and then along columns, keyed by map and line: two shuffles, whatever the size of
the neighbourhood, and no join. Small ones are windows; those with a wide reach take lines as arrays. Windows by range don't mind missing pixels; those by rows (median_blur) need a
dense raster. Pixels beyond the border never win.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import evenly

KEYS = ("map_id", "y", "x")


def line(axis: str, before: int, after: int):
    """The window of a pixel's neighbours along an axis ('x' or 'y')."""
    other = "y" if axis == "x" else "x"
    return Window.partitionBy("map_id", other).orderBy(axis).rangeBetween(-before, after)


def separable(df: DataFrame, value: str, fold: Callable[[Column], Column], reach: int, out: str | None = None) -> DataFrame:
    """fold over the square of 2 * reach + 1 pixels around each pixel."""
    rows = df.withColumn("_row", fold(F.col(value)).over(line("x", reach, reach)))
    return rows.withColumn(out or value, fold(F.col("_row")).over(line("y", reach, reach))).drop("_row")


def erode(df: DataFrame, value: str, side: int = 5, out: str | None = None) -> DataFrame:
    return separable(df, value, F.min, side // 2, out)


def dilate(df: DataFrame, value: str, side: int = 7, times: int = 1, out: str | None = None) -> DataFrame:
    """times dilations by a square are one by a larger square."""
    return separable(df, value, F.max, side // 2 * times, out)


def closing(df: DataFrame, value: str, side: int = 7, times: int = 1, out: str | None = None) -> DataFrame:
    """Dilations and as many erosions."""
    out = out or value
    return separable(dilate(df, value, side, times, out), out, F.min, side // 2 * times)


def cross_count(df: DataFrame, flag: Column) -> Column:
    """How many of a pixel and its four neighbours have the flag."""
    one = flag.cast("int")
    return F.sum(one).over(line("x", 1, 1)) + F.sum(one).over(line("y", 1, 1)) - one


def cross_dilate(df: DataFrame, flag: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or flag, cross_count(df, F.col(flag)) > 0)


def cross_erode(df: DataFrame, flag: str, out: str | None = None) -> DataFrame:
    """Pixels that have the flag with all four neighbours; beyond the border no pixel has it."""
    return df.withColumn(out or flag, cross_count(df, F.col(flag)) == 5)


def cross_close(df: DataFrame, flag: str, out: str | None = None) -> DataFrame:
    return cross_erode(cross_dilate(df, flag, out), out or flag)


def box_blur(df: DataFrame, value: str, side: int = 3, out: str | None = None) -> DataFrame:
    """Mean of the pixels that lie in the square."""
    reach = side // 2
    rows = df.withColumn("_s", F.sum(value).over(line("x", reach, reach))).withColumn("_n", F.count(value).over(line("x", reach, reach)))
    column = line("y", reach, reach)
    return rows.withColumn(out or value, F.sum("_s").over(column) / F.sum("_n").over(column)).drop("_s", "_n")


def median_blur(df: DataFrame, values: list[str], side: int = 5) -> DataFrame:
    """Median of the square around each pixel, for each of the values; borders are replicated. Needs a dense raster."""
    reach = side // 2

    def around(value: str, axis: str) -> Column:
        window = Window.partitionBy("map_id", "y" if axis == "x" else "x").orderBy(axis)
        near = lambda k, step: F.coalesce(*[step(value, j).over(window) for j in range(k, 0, -1)], F.col(value))
        return F.array(*[near(k, F.lag) for k in range(reach, 0, -1)], F.col(value), *[near(k, F.lead) for k in range(1, reach + 1)])

    others = [c for c in df.columns if c not in values]
    rows = df.select(*others, *[around(v, "x").alias(v) for v in values])
    return rows.select(*others, *[F.array_sort(F.flatten(around(v, "y")))[side * side // 2].alias(v) for v in values])


def by_line(df: DataFrame, axis: str, value: Column, function: Callable[[np.ndarray, np.ndarray], np.ndarray], out: str) -> DataFrame:
    """df with `out` (double): function(positions, values) of each line of pixels along an axis, in order.

    A line is one array, and Arrow hands many of them to numpy at once: one shuffle, whatever the function's reach. Lines may
    lack pixels; a null value comes as NaN, and NaN goes back as null.
    """
    other = "y" if axis == "x" else "x"
    rest = [c for c in df.columns if c not in ("map_id", other, axis)]

    @F.arrow_udf("array<double>")
    def run(positions: pa.Array, values: pa.Array) -> pa.Array:
        at, p, v = positions.offsets.to_numpy(), positions.values.to_numpy(), values.values.to_numpy(zero_copy_only=False).astype(float)
        whole = np.concatenate([function(p[i:j], v[i:j]) for i, j in zip(at, at[1:], strict=False)] + [np.zeros(0)])
        return pa.ListArray.from_arrays(positions.offsets, pa.array(whole, from_pandas=True))

    fields = [F.col(axis), *[F.col(c) for c in rest], value.cast("double").alias("_v")]
    held = evenly(df, "map_id", other).groupBy("map_id", other).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_line"))
    done = held.withColumn("_out", run(F.transform("_line", lambda e: e[axis].cast("long")), F.transform("_line", lambda e: e["_v"])))
    rows = done.select("map_id", other, F.explode(F.arrays_zip("_line", "_out")).alias("_p"))
    return rows.select("map_id", "y" if other == "y" else "_p._line.y", "x" if other == "x" else "_p._line.x", *[F.col(f"_p._line.{c}").alias(c) for c in rest if c != out], F.col("_p._out").alias(out))


def gaussian_blur(df: DataFrame, value: str, sigma: float, reach: int, out: str | None = None) -> DataFrame:
    """Separable weighted mean with the normal density's weights, cut off at reach; borders count what lies inside."""
    weights = np.exp(-(np.arange(-reach, reach + 1.0) ** 2) / (2 * sigma * sigma))

    def smooth(positions: np.ndarray, values: np.ndarray) -> np.ndarray:
        low = positions[0]
        dense = np.zeros((2, positions[-1] - low + 1))
        dense[0, positions - low], dense[1, positions - low] = values, 1.0
        top, bottom = (np.convolve(row, weights)[reach : reach + len(row)] for row in dense)
        return (top / bottom)[positions - low]

    return by_line(by_line(df, "x", F.col(value), smooth, "_row"), "y", F.col("_row"), smooth, out or value).drop("_row")


def local_maxima(df: DataFrame, value: str, region: Column, side: int = 3, out: str = "peak") -> DataFrame:
    """True for pixels of the region that no pixel of the square exceeds."""
    return separable(df, value, F.max, side // 2, "_top").withColumn(out, (F.col("_top") == F.col(value)) & region).drop("_top")


def distance_transform(df: DataFrame, seed: Column, cap: int, out: str = "distance") -> DataFrame:
    """Euclidean distance to the nearest seed, at most cap. In two passes: along rows, then over the columns within cap."""
    before = Window.partitionBy("map_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("map_id", "y").orderBy("x").rowsBetween(0, Window.unboundedFollowing)
    own = F.when(seed, F.col("x"))
    left, right = F.col("x") - F.last(own, True).over(before), F.first(own, True).over(after) - F.col("x")
    rows = df.withColumn("_dx", F.least(left, right))  # least ignores a side without a seed

    def nearest(positions: np.ndarray, along: np.ndarray) -> np.ndarray:
        low, n = positions[0], positions[-1] - positions[0] + 1
        wide = np.full(n + 2 * cap, np.inf)
        wide[cap + positions - low] = np.where(along <= cap, along * along, np.inf)
        best = wide[cap : cap + n].copy()
        for d in range(1, min(cap, n) + 1):
            np.minimum(best, wide[cap - d : cap - d + n] + d * d, out=best)
            np.minimum(best, wide[cap + d : cap + d + n] + d * d, out=best)
        return np.minimum(cap, np.sqrt(best))[positions - low]

    return by_line(rows, "y", F.col("_dx"), nearest, out).drop("_dx")


# ---- shapes of rasters


def min_max(df: DataFrame, values: list[str], per: list[str] | None = None) -> DataFrame:
    """The values scaled to 0..1 by the extremes of all of them together, per map."""
    low = F.least(*[F.min(v) for v in values]).alias("_low")
    top = F.greatest(*[F.max(v) for v in values]).alias("_top")
    keys = per or ["map_id"]
    scaled = [F.coalesce((F.col(v) - F.col("_low")) / F.nullif(F.col("_top") - F.col("_low"), F.lit(0)), F.lit(0.0)).alias(v) for v in values]
    return df.join(df.groupBy(*keys).agg(low, top), keys).select(*[c for c in df.columns if c not in values], *scaled)


def equalise(df: DataFrame, values: list[str], fit: Column, bins: int = 256) -> DataFrame:
    """Integer values 0..bins-1 as the share of the fitted pixels' values, of all bands together, that are no larger.

    Values below all fitted ones get the share of the least. The histogram has at most `bins` rows per map.
    """
    pooled = df.where(fit).select("map_id", F.explode(F.array(*values)).alias("v")).groupBy("map_id", "v").agg(F.count("*").alias("n"))
    packed = pooled.groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("h"), F.sum("n").alias("t"))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda v: F.aggregate("h", F.lit(0).cast("long"), lambda acc, e: acc + F.when(e["v"] <= F.greatest(v.cast("long"), F.col("h")[0]["v"].cast("long")), e["n"]).otherwise(0)) / F.col("t"))
    table = packed.select("map_id", share.alias("_share"))
    return df.join(table, "map_id").select(*[c for c in df.columns if c not in values], *[F.col("_share")[F.col(v)].alias(v) for v in values])


def bounding_box(df: DataFrame, flag: Column, by: list[str] | None = None) -> DataFrame:
    """(keys, y0, x0, y1, x1) of the pixels with the flag, ends inclusive."""
    return df.where(flag).groupBy(*(by or ["map_id"])).agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))


def crop(df: DataFrame, flag: Column) -> DataFrame:
    """The pixels of each map's bounding box, with coordinates from 0; y0 and x0 tell where it lay."""
    box = bounding_box(df, flag)
    inside = df.join(box, "map_id").where("y between y0 and y1 and x between x0 and x1")
    return inside.withColumn("y", F.col("y") - F.col("y0")).withColumn("x", F.col("x") - F.col("x0")).drop("y1", "x1")


def paste(df: DataFrame, part: DataFrame, value: str) -> DataFrame:
    """df with the value of a crop's pixels at the place that y0 and x0 tell."""
    back = part.select("map_id", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), F.col(value).alias("_new"))
    return df.join(back, list(KEYS), "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def pad(df: DataFrame, values: list[str], by: int, fill: int = 255, zero_to: int | None = 255) -> DataFrame:
    """A border of `by` pixels with the value fill; zero_to: what zeros inside become as well, None: they stay."""
    size = df.groupBy("map_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    grid = size.select("map_id", "h", "w", F.explode(F.sequence(F.lit(0), F.col("h") + 2 * by - 1)).alias("y"))
    grid = grid.select("map_id", "h", "w", "y", F.explode(F.sequence(F.lit(0), F.col("w") + 2 * by - 1)).alias("x"))
    border = grid.where((F.col("y") < by) | (F.col("x") < by) | (F.col("y") >= F.col("h") + by) | (F.col("x") >= F.col("w") + by)).select(*KEYS, *[F.lit(fill).cast(df.schema[v].dataType).alias(v) for v in values])
    inner = [F.col(v) if zero_to is None else F.when(F.col(v) == 0, F.lit(zero_to).cast(df.schema[v].dataType)).otherwise(F.col(v)) for v in values]
    moved = df.select("map_id", (F.col("y") + by).alias("y"), (F.col("x") + by).alias("x"), *[c.alias(v) for c, v in zip(inner, values, strict=True)])
    return moved.unionByName(border)


def unpad(df: DataFrame, by: int) -> DataFrame:
    size = df.groupBy("map_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    inner = df.join(size, "map_id").where((F.col("y") >= by) & (F.col("x") >= by) & (F.col("y") <= F.col("_h") - by) & (F.col("x") <= F.col("_w") - by))
    return inner.withColumn("y", F.col("y") - by).withColumn("x", F.col("x") - by).drop("_h", "_w")


def downsample(df: DataFrame, step: int = 2) -> DataFrame:
    kept = df.where((F.col("y") % step == 0) & (F.col("x") % step == 0))
    return kept.withColumn("y", F.floor(F.col("y") / step).cast("int")).withColumn("x", F.floor(F.col("x") / step).cast("int"))


def trim(df: DataFrame, first: int, less: int) -> DataFrame:
    """Drops the first rows and columns; what remains is cut to the raster's own size less `less`."""
    size = df.groupBy("map_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    moved = df.join(size, "map_id").withColumn("y", F.col("y") - first).withColumn("x", F.col("x") - first)
    return moved.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("_h") - less) & (F.col("x") < F.col("_w") - less)).drop("_h", "_w")


def compact(df: DataFrame, flag: Column) -> DataFrame:
    """Only the rows and columns that hold a pixel with the flag, numbered anew. The line lists are small: a map's sides."""
    lines = lambda axis: df.where(flag).select("map_id", axis).distinct().withColumn("_" + axis, F.row_number().over(Window.partitionBy("map_id").orderBy(axis)) - 1)
    kept = df.join(lines("y"), ["map_id", "y"]).join(lines("x"), ["map_id", "x"])
    return kept.withColumn("y", F.col("_y")).withColumn("x", F.col("_x")).select(*df.columns)


def sliding_tiles(df: DataFrame, window: int, trim_by: int) -> DataFrame:
    """Each pixel once for every window that holds it: (ty, tx, wy, wx, inner). Windows step by window - 2 * trim_by.

    Only whole windows count; inner marks the pixels of a window that aren't trimmed, which no two windows share.
    """
    step = window - 2 * trim_by
    size = df.groupBy("map_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))

    def starts(at: str, side: str) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - window + 1) / step))
        last = F.least(F.floor(F.col(at) / step), F.floor((F.col(side) - window) / step))
        return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    tiled = df.join(size, "map_id").withColumn("ty", F.explode(starts("y", "_h"))).withColumn("tx", F.explode(starts("x", "_w")))
    tiled = tiled.withColumn("wy", F.col("y") - F.col("ty") * step).withColumn("wx", F.col("x") - F.col("tx") * step)
    inner = F.col("wy").between(trim_by, window - trim_by - 1) & F.col("wx").between(trim_by, window - trim_by - 1)
    return tiled.withColumn("inner", inner).drop("_h", "_w")


def patches(df: DataFrame, corners: DataFrame, side: int) -> DataFrame:
    """(patch, py, px, values): the pixels of squares given by their corners (map_id, patch, y, x). A range join by blocks."""
    block = lambda c: F.floor(F.col(c) / side).cast("int")
    own = corners.select("map_id", "patch", F.col("y").alias("_cy"), F.col("x").alias("_cx"))
    reach = own.withColumn("_by", F.explode(F.array(block("_cy"), block("_cy") + 1))).withColumn("_bx", F.explode(F.array(block("_cx"), block("_cx") + 1)))
    cells = df.withColumn("_by", block("y")).withColumn("_bx", block("x"))
    inside = cells.join(reach, ["map_id", "_by", "_bx"]).withColumn("py", F.col("y") - F.col("_cy")).withColumn("px", F.col("x") - F.col("_cx"))
    return inside.where((F.col("py").between(0, side - 1)) & (F.col("px").between(0, side - 1))).drop("_by", "_bx", "_cy", "_cx")


def patch_pairs(pixels: DataFrame, distance: str, corners: DataFrame, side: int) -> DataFrame:
    """(map_id, patch, split, py, px, r, g, b, label) of training patches: colours, and the distance (0..1) as a byte, cut off.

    corners: (map_id, patch, split, y, x). Written with partitionBy("split"), a split's pairs lie in a folder of their own.
    """
    label = F.floor(F.col(distance) * 255).cast("int").alias("label")
    own = patches(pixels.select("map_id", "y", "x", "r", "g", "b", label), corners, side)
    return own.join(corners.select("map_id", "patch", "split"), ["map_id", "patch"]).select("map_id", "patch", "split", "py", "px", "r", "g", "b", "label")


def augment(df: DataFrame, copies: int, height: int, width: int, most_shift: float = 0.4) -> DataFrame:
    """df (by map_id) `copies` times over with `copy`: flipped and shifted around the borders, by digests of map and copy.

    Shifts are up to most_shift of a side; what leaves at one side comes in at the other.
    """
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    part = lambda k, n: F.conv(F.substring(F.md5(F.concat_ws("-", F.col("map_id").cast("string"), F.col("copy").cast("string")).cast("binary")), k, 4), 16, 10).cast("int") % n
    reach_y, reach_x = int(height * most_shift), int(width * most_shift)
    y = F.when(part(1, 2) == 1, height - 1 - F.col("y")).otherwise(F.col("y")) + part(5, 2 * reach_y + 1) - reach_y
    x = F.when(part(9, 2) == 1, width - 1 - F.col("x")).otherwise(F.col("x")) + part(13, 2 * reach_x + 1) - reach_x
    return many.withColumn("_y", F.pmod(y, F.lit(height))).withColumn("_x", F.pmod(x, F.lit(width))).withColumn("y", F.col("_y")).withColumn("x", F.col("_x")).drop("_y", "_x")


def labels_eroded(labelled: DataFrame) -> DataFrame:
    """The pixels (map_id, label, y, x) whose four neighbours have the same label as well; a pixel may have several labels."""
    cross = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])).alias("p")
    own = labelled.select("map_id", "label", "y", "x").distinct()
    return own.select("map_id", "label", cross).groupBy("map_id", "label", F.col("p.y").alias("y"), F.col("p.x").alias("x")).agg(F.count("*").alias("_n")).where("_n = 5").drop("_n")
