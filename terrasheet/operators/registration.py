"""Laying one image of a map over another: keypoints, binary descriptors, matches, a homography by consensus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import AROUND, grid
from .sampling import best_share

#: Keypoints of an image, bits of a descriptor, pixels around a keypoint that its direction and its descriptor look at.
KEYPOINTS, BITS, REACH = 500, 256, 15
#: Levels of the pyramid, how much smaller each is, and the least difference of a corner from its surroundings.
LEVELS, FACTOR, CONTRAST = 8, 1.2, 20
#: The circle of radius 3 around a pixel, as (y, x) in order.
CIRCLE = [(0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1), (-3, 0), (-3, 1), (-2, 2), (-1, 3)]


def around(image: np.ndarray, steps: list[tuple[int, int]], fill: str | float = "edge") -> list[np.ndarray]:
    """The image moved by each of the steps; beyond its border it is repeated, or a number."""
    far = max(max(abs(dy), abs(dx)) for dy, dx in steps)
    wide = np.pad(image, far, mode="edge") if fill == "edge" else np.pad(image, far, constant_values=fill)
    return [wide[far + dy : far + dy + image.shape[0], far + dx : far + dx + image.shape[1]] for dy, dx in steps]


def corners(image: np.ndarray, most: int) -> np.ndarray:
    """(y, x) of the pixels of which 9 neighbours in a row on the circle are all brighter, or all darker, by CONTRAST; of
    those the ones whose gradient changes more in every direction than their neighbours', the strongest first.
    """
    ring = np.stack(around(image, CIRCLE)) - image
    arc = lambda m: np.logical_or.reduce([np.logical_and.reduce([m[(k + j) % 16] for j in range(9)]) for k in range(16)])
    found = arc(ring > CONTRAST) | arc(ring < -CONTRAST)
    gy, gx = np.gradient(image.astype(float))
    summed = lambda v: sum(around(v, AROUND + [(0, 0)], 0))
    a, b, c = summed(gx * gx), summed(gx * gy), summed(gy * gy)
    strength = np.where(found, a * c - b * b - 0.04 * (a + c) ** 2, -np.inf)
    peak = np.logical_and.reduce([strength >= v for v in around(strength, AROUND, -np.inf)]) & found
    edge = min(REACH, min(image.shape) // 4)  # what a point looks at beyond the border isn't there; of small images a part
    peak[:edge] = peak[-edge:] = peak[:, :edge] = peak[:, -edge:] = False
    y, x = np.nonzero(peak)
    order = np.lexsort((x, y, -strength[y, x]))[:most]
    return np.stack([y[order], x[order]], 1)


def directions(image: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The direction from each point to the centroid of brightness in the disc around it."""
    dy, dx = np.nonzero(np.add.outer(np.arange(-REACH, REACH + 1) ** 2, np.arange(-REACH, REACH + 1) ** 2) <= REACH**2)
    wide = np.pad(image.astype(float), REACH, mode="edge")
    disc = wide[at[:, :1] + dy, at[:, 1:] + dx]
    return np.arctan2(disc @ (dy - REACH), disc @ (dx - REACH))


def descriptors(image: np.ndarray, at: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """BITS comparisons of pairs of places around each point, turned with it, as 64-bit words. The image is blurred for it;
    the pairs come from a fixed seed."""
    pairs = np.clip(np.random.default_rng(7).normal(0, REACH / 2.5, (BITS, 4)), 2 - REACH, REACH - 2)
    sums = around(sum(around(image.astype(float), [(k, 0) for k in range(-2, 3)])), [(0, k) for k in range(-2, 3)])
    wide = np.pad(sum(sums), REACH + 6, mode="edge")
    cos, sin = np.cos(turned)[:, None], np.sin(turned)[:, None]

    def sample(dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
        y, x = np.rint(sin * dx + cos * dy).astype(int), np.rint(cos * dx - sin * dy).astype(int)
        return wide[at[:, :1] + y + REACH + 6, at[:, 1:] + x + REACH + 6]

    bits = sample(pairs[:, 0], pairs[:, 1]) < sample(pairs[:, 2], pairs[:, 3])
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def smaller(image: np.ndarray, by: float) -> np.ndarray:
    """The image at 1 / by of its size: the mean of the four pixels around each place, by distance."""

    def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(max(1, round(n / by))) + 0.5) * by - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, v), (x0, x1, u) = places(image.shape[0]), places(image.shape[1])
    rows = image[y0] * (1 - v)[:, None] + image[y1] * v[:, None]
    return rows[:, x0] * (1 - u) + rows[:, x1] * u


def described(image: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints (y, x, in the image's pixels) of all levels of the pyramid, and their descriptors. A level has its share by
    its number of pixels."""
    fits = [k for k in range(LEVELS) if round(min(image.shape) / FACTOR**k) >= 2 * REACH]
    shares = FACTOR ** (-2.0 * np.array(fits, float))
    points, words, level = [np.zeros((0, 2))], [np.zeros((0, BITS // 64), np.int64)], image.astype(float)
    for k, share in enumerate(shares / shares.sum()):
        by = np.array(image.shape) / level.shape
        at = corners(level, max(1, round(most * share)))
        points.append((at + 0.5) * by - 0.5)
        words.append(descriptors(level, at, directions(level, at)))
        level = smaller(image.astype(float), FACTOR ** (k + 1))
    return np.concatenate(points), np.concatenate(words)


def keypoints(df: DataFrame, value: str, most: int = KEYPOINTS) -> DataFrame:
    """(map_id, id, y, x, bits array<long>) of each map's pixels; one map per group.

    Corners at several scales, each with a direction, so that descriptors of a turned or smaller image agree. A map of fewer
    than 2 * REACH rows or columns has none.
    """
    kind = df.schema["map_id"].dataType.simpleString()

    def one(pixels: pd.DataFrame) -> pd.DataFrame:
        image, y0, x0 = grid(pixels, value, 0)
        at, bits = described(image, most)
        return pd.DataFrame({"map_id": pixels.map_id.iloc[0], "id": np.arange(len(at)), "y": at[:, 0] + y0, "x": at[:, 1] + x0, "bits": list(bits)})

    return df.select("map_id", "y", "x", value).groupBy("map_id").applyInPandas(one, f"map_id {kind}, id long, y double, x double, bits array<long>")


def matches(fixed: DataFrame, moving: DataFrame, share: float = 0.2) -> DataFrame:
    """(map_id, fx, fy, mx, my, distance): for each keypoint of `fixed` the nearest of `moving` on the map; the best share."""
    a = fixed.select("map_id", F.col("id").alias("a"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("bits").alias("_a"))
    b = moving.select("map_id", F.col("id").alias("b"), F.col("x").alias("mx"), F.col("y").alias("my"), F.col("bits").alias("_b"))
    distance = F.aggregate(F.zip_with("_a", "_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)
    # at most KEYPOINTS of each image of a map meet
    met = a.join(b, "map_id").withColumn("distance", distance)
    best = met.groupBy("map_id", "a").agg(F.min(F.struct("distance", "b", "fx", "fy", "mx", "my")).alias("m")).select("map_id", "a", "m.*")
    return best_share(best, "map_id", ["distance", "a"], share).select("map_id", "fx", "fy", "mx", "my", "distance")


def fitted(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix that takes the source points to the target points with least squares; None if they don't tell."""

    def unit(p: np.ndarray) -> np.ndarray:
        centre = p.mean(0)
        size = np.hypot(*(p - centre).T).mean() or 1.0
        return np.array([[1 / size, 0, -centre[0] / size], [0, 1 / size, -centre[1] / size], [0, 0, 1]])

    a, b = unit(source), unit(target)
    one = np.ones((len(source), 1))
    s, t = np.hstack([source, one]) @ a.T, np.hstack([target, one]) @ b.T
    rows = np.zeros((2 * len(s), 9))
    rows[::2, 3:6], rows[::2, 6:] = -s, t[:, 1:2] * s
    rows[1::2, :3], rows[1::2, 6:] = s, -t[:, :1] * s
    h = np.linalg.inv(b) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ a
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def consensus(source: np.ndarray, target: np.ndarray, reach: float = 3.0, tries: int = 500, seed: int = 42) -> np.ndarray | None:
    """The matrix that most points agree with within `reach`, fitted to all of those; None for fewer than four points."""
    if len(source) < 4:
        return None
    rng, best = np.random.default_rng(seed), np.zeros(len(source), bool)

    def agree(h: np.ndarray | None) -> np.ndarray:
        if h is None:
            return np.zeros(len(source), bool)
        p = np.hstack([source, np.ones((len(source), 1))]) @ h.T
        with np.errstate(all="ignore"):
            return np.hypot(*(p[:, :2] / p[:, 2:] - target).T) <= reach

    for _ in range(tries):
        pick = rng.choice(len(source), 4, replace=False)
        own = agree(fitted(source[pick], target[pick]))
        if own.sum() > best.sum():
            best = own
    return fitted(source[best], target[best]) if best.sum() >= 4 else None


def homographies(found: DataFrame, reach: float = 3.0) -> DataFrame:
    """(map_id, matrix array<double>) that takes a map's moving points to its fixed ones; null if they don't agree."""
    kind = found.schema["map_id"].dataType.simpleString()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        h = consensus(rows[["mx", "my"]].to_numpy(float), rows[["fx", "fy"]].to_numpy(float), reach)
        return pd.DataFrame({"map_id": [rows.map_id.iloc[0]], "matrix": [None if h is None else h.ravel().tolist()]})

    return found.groupBy("map_id").applyInPandas(one, f"map_id {kind}, matrix array<double>")


def silhouette(df: DataFrame, value: str) -> DataFrame:
    """df (dense) with `inside`: within the outline of what the map shows. Edges, widened and closed, with holes filled."""
    from .components import fill_holes
    from .tiles import canny
    from .raster import closing, dilate

    edges = canny(df, value).withColumn("_e", F.lit(1))
    marked = df.join(edges, ["map_id", "y", "x"], "left").withColumn("_e", F.coalesce("_e", F.lit(0)))
    closed = closing(dilate(marked, "_e", 7), "_e", 7).withColumn("inside", F.col("_e") > 0).drop("_e")
    return fill_holes(closed, "inside")


def registered(fixed: DataFrame, moving: DataFrame, height: int, width: int, bands: tuple[str, ...] = ("r", "g", "b"), border: int = 500, first: int = 30, less: int = 100, share: float = 0.2) -> DataFrame:
    """(map_id, y, x, bands, moved_<band>): images of maps laid over others of the same map (map_id, y, x, bands).

    A moving image of more than twice the fixed one's height or width is taken at every second row and column. Both are trimmed
    (first, less) and get a white border; keypoints of their filled silhouettes, the fixed one's blurred by a box of 3 x 3, are
    matched, and the moving image is warped by the homography that most matches agree with, into height x width pixels of the fixed one. Rows and
    columns that the moved image leaves white in the last band are taken out of both. Maps without a homography are left
    out. Each step runs per map; nothing is overwritten.
    """
    from ..functions import color
    from .geometry import inverted, warp
    from .graph import settled
    from .raster import box_blur, compact, pad, trim

    def shown(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        wide = settled(pad(trim(df.select("map_id", "y", "x", *bands), first, less), list(bands), border))
        gray = wide.select("map_id", "y", "x", color.gray(*[F.col(b) for b in bands]).alias("gray"))
        return wide, silhouette(gray, "gray").select("map_id", "y", "x", (F.col("inside").cast("int") * 255).alias("gray"))

    size = lambda df, name: df.groupBy("map_id").agg((F.max("y") + 1).alias(f"{name}_h"), (F.max("x") + 1).alias(f"{name}_w"))
    large = size(moving, "m").join(size(fixed, "f"), "map_id").where("m_h > 2 * f_h or m_w > 2 * f_w").select("map_id", F.lit(2).alias("_step"))
    sized = moving.join(large, "map_id", "left").withColumn("_step", F.coalesce("_step", F.lit(1))).where("y % _step = 0 and x % _step = 0")
    halved = sized.withColumn("y", F.floor(F.col("y") / F.col("_step")).cast("int")).withColumn("x", F.floor(F.col("x") / F.col("_step")).cast("int")).drop("_step")
    (still, still_outline), (other, other_outline) = shown(fixed), shown(halved)
    still_outline = box_blur(still_outline, "gray", 3)
    found = homographies(settled(matches(keypoints(still_outline, "gray"), keypoints(other_outline, "gray"), share)))
    moved = warp(other, list(bands), found.where("matrix is not null").select("map_id", inverted(F.col("matrix")).alias("inverse")), height + 2 * border, width + 2 * border)
    both = still.join(moved.select("map_id", "y", "x", *[F.col(b).alias(f"moved_{b}") for b in bands]), ["map_id", "y", "x"])
    return compact(settled(both), F.col(f"moved_{bands[-1]}") < 250)
