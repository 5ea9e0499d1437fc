"""Tiles with halos: passes over a map that take neighbouring pixels, in many tasks, with the results of a whole map.

A pixel is dealt to its tile and to those that it lies beside, within the halo. A task works on a tile and its halo and gives
back the tile's own pixels. Where a step's reach has no bound, passes are repeated until nothing changes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import groups_of, in_groups, settled

#: Side of a tile in pixels.
TILE = 256
#: Passes after which a result must be settled; else an error.
PASSES = 10_000
#: Steps around a pixel, clockwise from the right (y grows downwards).
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def dealt(df: DataFrame, tile: int, halo: int) -> DataFrame:
    """df (map_id, y, x, ...) with (ty, tx), a row for each tile within `halo` of a pixel, its own among them."""
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    return df.withColumn("ty", F.explode(reach("y"))).withColumn("tx", F.explode(reach("x")))


def own_part(pixels: pd.DataFrame, tile: int) -> np.ndarray:
    """True for the rows of a group of dealt() that aren't its halo."""
    return (pixels.y.to_numpy() // tile == pixels.ty.iloc[0]) & (pixels.x.to_numpy() // tile == pixels.tx.iloc[0])


def canvas(pixels: pd.DataFrame, values: np.ndarray, fill, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values as a dense array over the pixels' box, and each pixel's row and column in it."""
    y, x = pixels.y.to_numpy() - int(pixels.y.min()), pixels.x.to_numpy() - int(pixels.x.min())
    out = np.full((int(y.max()) + 1, int(x.max()) + 1), fill, kind)
    out[y, x] = values
    return out, y, x


# ---- thinning


def peeled(own: np.ndarray, rounds: int) -> np.ndarray:
    """A mask after `rounds` rounds of thinning (fewer if it doesn't change any more): border pixels go, two sides in turn,
    while that keeps their neighbourhood connected. What lies beyond the array is off."""
    own = np.pad(own.astype(bool), 1)
    for _ in range(rounds):
        changed = False
        for side in (0, 1):
            near = [np.roll(own, (-dy, -dx), (0, 1)) for dy, dx in AROUND]
            right, down, left, up = near[0], near[2], near[4], near[6]
            count = sum(n.astype(np.int8) for n in near)
            turns = sum((~near[k] & near[(k + 1) % 8]).astype(np.int8) for k in range(8))
            sides = (~(up & right & down)) & (~(right & down & left)) if side == 0 else (~(up & right & left)) & (~(up & down & left))
            gone = own & (count >= 2) & (count <= 6) & (turns == 1) & sides
            if gone.any():
                own, changed = own & ~gone, True
        if not changed:
            break
    return own[1:-1, 1:-1]


def skeleton(df: DataFrame, tile: int = TILE, rounds: int = 8) -> DataFrame:
    """(map_id, y, x): the skeleton of each map's pixels.

    A pass makes `rounds` rounds of thinning in every tile. A round looks two pixels far, so the halo is twice as wide, and
    tiles give what the whole map gives. Passes end when none of them takes a pixel away.
    """
    kind = df.schema["map_id"].dataType.simpleString()

    def one(pixels: pd.DataFrame) -> pd.DataFrame:
        own = own_part(pixels, tile)
        if not own.any():
            return pd.DataFrame({"map_id": [], "y": [], "x": []})
        mask, y, x = canvas(pixels, True, False, bool)
        keep = own & peeled(mask, rounds)[y, x]
        return pixels.loc[keep, ["map_id", "y", "x"]]

    state = settled(df.select("map_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct())
    before = state.count()
    for _ in range(PASSES):
        state = settled(dealt(state, tile, 2 * rounds).groupBy("map_id", "ty", "tx").applyInPandas(one, f"map_id {kind}, y int, x int"))
        left = state.count()
        if left == before:
            return state
        before = left
    raise RuntimeError(f"the skeleton still changes after {PASSES} passes")


# ---- edges


def ridges(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The size of the gradient, and where it is a ridge across its direction. The image's border is repeated beyond it."""
    wide = np.pad(image.astype(float), 1, mode="edge")
    part = lambda dy, dx: wide[1 + dy : 1 + dy + image.shape[0], 1 + dx : 1 + dx + image.shape[1]]
    gx = part(-1, 1) + 2 * part(0, 1) + part(1, 1) - part(-1, -1) - 2 * part(0, -1) - part(1, -1)
    gy = part(1, -1) + 2 * part(1, 0) + part(1, 1) - part(-1, -1) - 2 * part(-1, 0) - part(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    sector = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    padded = np.pad(size, 1)
    near = lambda dy, dx: padded[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    ridge = np.zeros(size.shape, bool)
    for k, (dy, dx) in enumerate(AROUND[:4]):
        ridge |= (sector == k) & (size > near(dy, dx)) & (size >= near(-dy, -dx))
    return size, ridge


def canny(df: DataFrame, value: str, low: float = 70.0, high: float = 70.0, tile: int = TILE) -> DataFrame:
    """(map_id, y, x): the edge pixels of each dense map: ridges of the gradient over `high`, and those over `low` that a
    path of such joins to one, corner to corner.

    Ridges are found per tile with a halo of two. The paths are components of all pixels over `low`, across tiles.
    """
    from .components import components

    kind = df.schema["map_id"].dataType.simpleString()

    def one(pixels: pd.DataFrame) -> pd.DataFrame:
        own = own_part(pixels, tile)
        if not own.any():
            return pd.DataFrame({"map_id": [], "y": [], "x": [], "strong": []})
        image, y, x = canvas(pixels, pixels[value].to_numpy(float), 0, float)
        size, ridge = ridges(image)
        keep = own & ridge[y, x] & (size[y, x] > low)
        return pixels.loc[keep, ["map_id", "y", "x"]].assign(strong=size[y, x][keep] > high)

    cells = df.select("map_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), value)
    found = settled(dealt(cells, tile, 2).groupBy("map_id", "ty", "tx").applyInPandas(one, f"map_id {kind}, y int, x int, strong boolean"))
    paths = components(found, True, tile)
    strong = paths.join(found.where("strong"), ["map_id", "y", "x"], "left_semi").select("map_id", "label").distinct()
    return paths.join(strong, ["map_id", "label"], "left_semi").select("map_id", "y", "x")


# ---- watershed


def flood(height: np.ndarray, marker: np.ndarray, inside: np.ndarray, rim: list[tuple[int, int, float, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, steps, label) of a tile's pixels that something reaches; label 0 elsewhere. rim: what lies around the tile, as
    (y, x, level, steps, label) with y and x from -1 on."""
    rows, columns = height.shape
    wide = columns + 2
    flat = lambda a, fill: np.pad(a, 1, constant_values=fill).ravel().tolist()
    heights, closed = flat(height, 0.0), flat(~inside, True)
    level, steps, label = [0.0] * len(heights), [0] * len(heights), [0] * len(heights)
    heap: list[tuple[float, int, int, int]] = []

    def spread(k: int) -> None:
        for j in (k - wide, k - 1, k + 1, k + wide):
            if 0 <= j < len(closed) and not closed[j]:
                climb = heights[j] > level[k]
                heapq.heappush(heap, (heights[j] if climb else level[k], 0 if climb else steps[k] + 1, label[k], j))

    sources = [((y + 1) * wide + x + 1, height[y, x].item(), 0, int(marker[y, x])) for y, x in zip(*(v.tolist() for v in np.nonzero(inside & (marker > 0))), strict=True)]
    beyond = [((y + 1) * wide + x + 1, own, n, m) for y, x, own, n, m in rim]
    for k, own, n, m in sources + beyond:
        level[k], steps[k], label[k], closed[k] = own, n, m, True
    for k, *_ in sources + beyond:
        spread(k)
    while heap:
        own, n, m, k = heapq.heappop(heap)
        if not closed[k]:
            level[k], steps[k], label[k], closed[k] = own, n, m, True
            spread(k)
    shaped = lambda a, kind: np.array(a, kind).reshape(rows + 2, wide)[1:-1, 1:-1]
    return shaped(level, float), shaped(steps, np.int64), np.where(inside, shaped(label, np.int64), 0)


def watershed(df: DataFrame, height: str, marker: str, mask: str, tile: int = TILE) -> DataFrame:
    """(map_id, y, x, label) of the mask's pixels that a marker (label > 0) reaches over the four neighbours.

    A way from a marker has a level, the greatest height on it, and steps since it has been on that level. A pixel has the
    label of the ways of least level, of these the fewest steps, of these the least label; a marker keeps its own. This is
    the order in which water rises, and on flat ground the nearest marker's water comes first. It doesn't depend on tiles.

    Each tile is flooded from its markers and from what its neighbours' rims had in the last pass. Tiles beside a rim that
    has changed are flooded again, until none has. Only rims are exchanged.
    """
    kind = df.schema["map_id"].dataType.simpleString()
    keys = ["map_id", "ty", "tx"]
    rim_columns = ["map_id", "ty", "tx", "from_y", "from_x", "y", "x", "level", "steps", "label"]
    rim_schema = f"map_id {kind}, ty int, tx int, from_y int, from_x int, y int, x int, level double, steps long, label long"

    def flooded(rows: pd.DataFrame) -> pd.DataFrame:
        """The pixels of tiles that something reaches, with level, steps and label. rows: tiles' pixels and what lies around them."""
        first = np.sort(groups_of(rows, keys)[1])
        y, x, level, steps, label, inside, rim = (rows[c].to_numpy() for c in ("y", "x", "level", "steps", "label", "inside", "rim"))
        found = []
        for a, b in zip(first, np.append(first[1:], len(rows)), strict=True):
            own, near = a + np.flatnonzero(~rim[a:b]), a + np.flatnonzero(rim[a:b])
            if not len(own):
                continue
            y0, x0 = y[own].min(), x[own].min()
            down, across = y[own] - y0, x[own] - x0
            shape = (down.max() + 1, across.max() + 1)
            canvases = [np.zeros(shape, k) for k in (float, np.int64, bool)]
            for out, values in zip(canvases, (level, label, inside), strict=True):
                out[down, across] = values[own]
            near = near[(y[near] >= y0 - 1) & (y[near] <= y0 + shape[0]) & (x[near] >= x0 - 1) & (x[near] <= x0 + shape[1])]
            got = flood(*canvases, list(zip((y[near] - y0).tolist(), (x[near] - x0).tolist(), level[near].tolist(), steps[near].tolist(), label[near].tolist(), strict=True)))
            at_y, at_x = np.nonzero(got[2])
            found.append((np.full(len(at_y), a), at_y + y0, at_x + x0, *(g[at_y, at_x] for g in got)))
        of, *values = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 6
        return rows.iloc[of][keys].reset_index(drop=True).assign(**dict(zip(("y", "x", "level", "steps", "label"), values, strict=True)))

    def rims_of(rows: pd.DataFrame) -> pd.DataFrame:
        own, parts = flooded(rows), []
        for dy, dx in AROUND[::2]:
            out = own[((own.y + dy) // tile != own.ty) | ((own.x + dx) // tile != own.tx)]
            parts.append(out.assign(from_y=out.ty, from_x=out.tx, ty=out.ty + dy, tx=out.tx + dx))
        return pd.concat(parts)[rim_columns]

    def with_rims(cells: DataFrame, rims: DataFrame) -> DataFrame:
        return cells.unionByName(rims.select(*keys, "y", "x", "level", "steps", "label", F.lit(True).alias("inside"), F.lit(True).alias("rim")))

    cells = df.select("map_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(height).cast("double").alias("level"), F.lit(0).cast("long").alias("steps"), F.coalesce(F.col(marker).cast("long"), F.lit(0)).alias("label"), F.coalesce(F.col(mask).cast("boolean"), F.lit(False)).alias("inside"), F.lit(False).alias("rim"))
    cells = settled(dealt(cells, tile, 0))
    all_tiles = settled(cells.select(*keys).distinct())
    rims = cells.sparkSession.createDataFrame([], rim_schema)
    active = all_tiles
    for _ in range(PASSES):
        now = with_rims(cells.join(active, keys, "left_semi"), rims.join(active, keys, "left_semi"))
        own = settled(in_groups(now, keys, rims_of, rim_schema).join(all_tiles, keys, "left_semi"))
        kept = rims.join(active.select("map_id", F.col("ty").alias("from_y"), F.col("tx").alias("from_x")), ["map_id", "from_y", "from_x"], "left_anti").select(*rim_columns)
        active = settled(own.join(rims, rim_columns, "left_anti").select(*keys).distinct())
        rims = settled(kept.unionByName(own))
        if active.isEmpty():
            return in_groups(with_rims(cells, rims), keys, lambda rows: flooded(rows)[["map_id", "y", "x", "label"]], f"map_id {kind}, y int, x int, label long")
    raise RuntimeError(f"labels still change after {PASSES} passes")
