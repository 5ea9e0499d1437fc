"""Steps that must be done one after another, as rounds of those that don't wait for each other.

Polygons of a map change in the order of their labels, and each looks only at a few others. Polygons that are linked by
neighbours, however far, are a group; up to GROUP_NUMBERS coordinates, one task does a group's steps one after another. Steps
of larger groups go in rounds: a step is ready when the steps before it that touch the same polygons are done. A round takes
all ready steps of all maps, so the number of rounds is the longest chain of steps that wait for each other, and no task holds
a large group: only a polygon and its neighbours.

Polygons are lists of rings, a ring the flat list x, y, x, y... in whole steps of 1 / SCALE (overlay), what it encloses on
its left (y upwards), holes the other way round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .borders import follow
from .geometry import RING, evenly
from .graph import connected, settled
from .overlay import SCALE, moved_out, straightened, turned

RINGS = "array<array<long>>"
#: Rounds after which all steps must be done; else an error.
ROUNDS = 100_000
#: Coordinates of the polygons of a group whose steps one task does in their order; beyond it, rounds are run.
GROUP_NUMBERS = 400_000


# ---- a small overlay in numpy, by the same steps as overlay.py


def merged(ends: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (n x 4) from their lesser end, each once, with the sums of their weights (n x 2)."""
    back = (ends[:, 2] < ends[:, 0]) | ((ends[:, 2] == ends[:, 0]) & (ends[:, 3] < ends[:, 1]))
    own = np.where(back[:, None], ends[:, [2, 3, 0, 1]], ends)
    some = (own[:, :2] != own[:, 2:]).any(1)
    own, at = np.unique(own[some], axis=0, return_inverse=True)
    total = np.zeros((len(own), 2), np.int64)
    np.add.at(total, at.ravel(), (weight * np.where(back, -1, 1)[:, None])[some])
    keep = total.any(1)
    return own[keep], total[keep]


def turn(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (e[:, 3] - e[:, 1]) * (x - e[:, 0])


def cut(ends: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces that meet at their ends only: all are cut where they cross or pass another one's end, again and again. Of two
    pieces of which one passes the other's end the crossing waits for the next round."""
    while True:
        low, top = np.minimum(ends[:, 1], ends[:, 3]), np.maximum(ends[:, 1], ends[:, 3])
        near = (ends[:, None, 2] >= ends[None, :, 0] - 1) & (ends[None, :, 2] >= ends[:, None, 0] - 1) & (top[:, None] >= low[None] - 1) & (top[None] >= low[:, None] - 1)
        i, j = np.nonzero(np.triu(near, 1))
        p, q = ends[i], ends[j]
        d1, d2, d3, d4 = turn(q, p[:, 0], p[:, 1]), turn(q, p[:, 2], p[:, 3]), turn(p, q[:, 0], q[:, 1]), turn(p, q[:, 2], q[:, 3])
        cross = (np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0)
        part = np.divide(d1, d1.astype(float) - d2, out=np.zeros(len(d1)), where=cross)
        half_up = lambda v: np.floor(v + 0.5).astype(np.int64)
        x, y = half_up(p[:, 0] + (p[:, 2] - p[:, 0]) * part), half_up(p[:, 1] + (p[:, 3] - p[:, 1]) * part)
        found = []
        for d, own, e, f, a in ((d3, i, p, q, 0), (d4, i, p, q, 2), (d1, j, q, p, 0), (d2, j, q, p, 2)):
            px, py = f[:, a], f[:, a + 1]
            dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
            boxed = (px >= e[:, 0]) & (px <= e[:, 2]) & (py >= np.minimum(e[:, 1], e[:, 3])) & (py <= np.maximum(e[:, 1], e[:, 3]))
            corner = (np.sign(dx) * np.sign(dy) < 0) & (2 * d == dx - dy)
            found.append((own, px, py, boxed & ((np.abs(2 * d) < np.abs(dx) + np.abs(dy)) | corner)))
        cross &= ~np.logical_or.reduce([f[3] for f in found])
        found += [(i, x, y, cross), (j, x, y, cross)]
        of, x, y = (np.concatenate([f[k][f[3]] for f in found]) for k in range(3))
        inner = ((x != ends[of, 0]) | (y != ends[of, 1])) & ((x != ends[of, 2]) | (y != ends[of, 3]))
        if not inner.any():
            return ends, weight
        marks = np.unique(np.stack([of[inner], x[inner], y[inner]], 1), axis=0)
        every = np.arange(len(ends))
        rows = np.concatenate([np.stack([every, ends[:, 0], ends[:, 1]], 1), marks, np.stack([every, ends[:, 2], ends[:, 3]], 1)])
        e = ends[rows[:, 0]]
        along = (rows[:, 1] - e[:, 0]) * (e[:, 2] - e[:, 0]) + (rows[:, 2] - e[:, 1]) * (e[:, 3] - e[:, 1])
        rank = np.concatenate([np.zeros(len(ends)), np.ones(len(marks)), np.full(len(ends), 2)])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], along, rank, rows[:, 0]))]
        same = rows[1:, 0] == rows[:-1, 0]
        ends, weight = merged(np.concatenate([rows[:-1, 1:], rows[1:, 1:]], 1)[same], weight[rows[:-1, 0][same]])


def windings(ends: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right of each piece (n x 2 both): rays go upwards, from upright pieces to the right."""
    mx, my = ends[:, 0] + ends[:, 2], ends[:, 1] + ends[:, 3]
    level = ends[:, 0] < ends[:, 2]
    left, right = np.zeros_like(weight), np.zeros_like(weight)
    if level.any():
        w, m = ends[level], np.flatnonzero(level)
        over = (2 * w[None, :, 0] <= mx[m, None]) & (mx[m, None] < 2 * w[None, :, 2])
        over &= (w[None, :, 2] - w[None, :, 0]) * (my[m, None] - 2 * w[None, :, 1]) - (w[None, :, 3] - w[None, :, 1]) * (mx[m, None] - 2 * w[None, :, 0]) < 0
        left[m] = -(over.astype(np.int64) @ weight[level])
        right[m] = left[m] - weight[m]
    if not level.all():
        tall = ends[:, 1] != ends[:, 3]
        down = (ends[:, 1] > ends[:, 3])[tall]
        w = np.where(down[:, None], ends[tall][:, [2, 3, 0, 1]], ends[tall])
        up, m = weight[tall] * np.where(down, -1, 1)[:, None], np.flatnonzero(~level)
        over = (2 * w[None, :, 1] <= my[m, None]) & (my[m, None] < 2 * w[None, :, 3])
        over &= (w[None, :, 2] - w[None, :, 0]) * (my[m, None] - 2 * w[None, :, 1]) - (w[None, :, 3] - w[None, :, 1]) * (mx[m, None] - 2 * w[None, :, 0]) > 0
        right[m] = over.astype(np.int64) @ up
        left[m] = right[m] + weight[m]
    return left, right


def kept_rings(ends: np.ndarray, weight: np.ndarray, rule: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """The border of where the rule holds, as rings (n x 2) with that on their left."""
    ends, weight = cut(*merged(ends, weight))
    if not len(ends):
        return []
    left, right = windings(ends, weight)
    a, b = rule(left[:, 0], left[:, 1]), rule(right[:, 0], right[:, 1])
    own = np.where(a[:, None], ends, ends[:, [2, 3, 0, 1]])[a != b]
    n = len(own)
    if not n:
        return []
    at = np.concatenate([own[:, :2], own[:, 2:]])
    ray = np.concatenate([own[:, 2:] - own[:, :2], own[:, :2] - own[:, 2:]]).astype(float)
    order = np.lexsort((np.arange(2 * n) >= n, -np.arctan2(ray[:, 1], ray[:, 0]), at[:, 1], at[:, 0]))  # clockwise around each vertex
    fresh = np.append(True, (at[order[1:]] != at[order[:-1]]).any(1))
    first = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    after = np.append(order[1:], -1)
    closing = np.append(first[1:], 2 * n) - 1
    after[closing] = order[first[group[closing]]]
    comes = order >= n
    link = np.empty(n, np.int64)
    link[order[comes] - n] = after[comes]
    ring, place = follow(link)
    rows = np.lexsort((place, ring))
    parts = np.split(own[rows, :2], np.flatnonzero(np.diff(ring[rows])) + 1)
    return [r for r in map(straightened, parts) if len(r) > 2]


def ends_of(rings: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros((0, 4), np.int64), *(np.concatenate([r, np.roll(r, -1, 0)], 1) for r in rings)]).astype(np.int64)


def solved(first: list[np.ndarray], second: list[np.ndarray], rule: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    a, b = ends_of(first), ends_of(second)
    return kept_rings(np.concatenate([a, b]), np.repeat([[1, 0], [0, 1]], (len(a), len(b)), 0), rule)


def grown(rings: list[np.ndarray], by: float) -> list[np.ndarray]:
    """Oriented rings moved out by `by` steps, with mitred corners."""
    raw = [np.round(moved_out(r.astype(float), by)).astype(np.int64) for r in rings]
    return solved([r for r in raw if len(r) > 2], [], lambda a, b: a > 0)


def oriented(rings: list[np.ndarray]) -> list[np.ndarray]:
    """A valid polygon's outer ring and holes (the first and the others), as this module has them."""
    return [turned(r, k == 0) for k, r in enumerate(rings) if len(r) > 2]


def flat(rings: list[np.ndarray]) -> list[list[int]]:
    return [r.ravel().tolist() for r in rings]


def lists(value) -> list[np.ndarray]:
    return [] if value is None else [np.asarray(r, np.int64).reshape(-1, 2) for r in value]


def in_steps(column: str, scale: int = SCALE):
    """A column of rings (array of rings of points) as RINGS."""
    step = lambda v: F.round(v * scale).cast("long")
    return F.transform(column, lambda r: F.flatten(F.transform(r, lambda p: F.array(step(p["x"]), step(p["y"])))))


def in_units(rings: np.ndarray, scale: int = SCALE) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in rings / scale]


def gathered(sized: DataFrame, links: DataFrame, key: str, most: int) -> DataFrame:
    """(map_id, key, group, small) for polygons (map_id, key, numbers): the least key that links (map_id, a, b) lead to, and
    whether the group has at most `most` numbers."""
    found = connected(links).select("map_id", F.col("node").alias(key), F.col("label").alias("group"))
    own = sized.join(found, ["map_id", key], "left").withColumn("group", F.coalesce("group", F.col(key).cast("long")))
    total = own.groupBy("map_id", "group").agg((F.sum("numbers") <= most).alias("small"))
    return settled(own.join(total, ["map_id", "group"]).select("map_id", key, "group", "small"))


# ---- the enlarged difference


def clamped(outline: DataFrame, boxes: DataFrame, scale: int = SCALE, strip: float = 64.0) -> DataFrame:
    """(map_id, label, clip): what a map's outline (map_id, rings) looks like from inside each label's box (map_id, label, x0,
    y0, x1, y1, in steps): its edges, with what lies outside the box moved onto the box's border. Windings inside stay.

    clip is the flat list of ends of such edges. An edge meets the boxes that it passes above, below or beside.
    """
    size = int(strip * scale)
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    whole = outline.select("map_id", F.explode("rings").alias("r"))
    n = F.size("r") / 2
    corner = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: F.struct(*[F.get("r", (2 * k + d)).alias(a) for a, d in (("ax", 0), ("ay", 1))], *[F.get("r", ((2 * k + 2 + d) % F.size("r")).cast("int")).alias(b) for b, d in (("bx", 0), ("by_", 1))]))
    edge = whole.where("size(r) > 4").select("map_id", F.explode(corner).alias("e")).select("map_id", "e.*")
    edge = edge.withColumns({"ex0": F.least("ax", "bx"), "ex1": F.greatest("ax", "bx"), "ey0": F.least("ay", "by_"), "ey1": F.greatest("ay", "by_")})
    pairs = []
    for lo, hi, e_lo, e_hi in (("x0", "x1", "ex0", "ex1"), ("y0", "y1", "ey0", "ey1")):
        dealt = edge.withColumn("strip", F.explode(F.sequence(at(e_lo), at(e_hi))))
        mine = boxes.withColumn("strip", F.explode(F.sequence(at(lo), at(hi))))
        pairs.append(mine.join(dealt, ["map_id", "strip"]).where((F.col(e_hi) >= F.col(lo)) & (F.col(e_lo) <= F.col(hi))).drop("strip"))
    met = pairs[0].unionByName(pairs[1]).distinct()
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    share = lambda v, a, d: F.when(d != 0, (F.col(v) - F.col(a)) / d)
    cuts = F.array_sort(F.filter(F.array(F.lit(0.0), F.lit(1.0), share("x0", "ax", dx), share("x1", "ax", dx), share("y0", "ay", dy), share("y1", "ay", dy)), lambda t: t.isNotNull() & (t >= 0) & (t <= 1)))
    inside = lambda v, lo, hi: F.least(F.greatest(F.round(v).cast("long"), F.col(lo)), F.col(hi))
    walk = F.transform(cuts, lambda t: F.struct(inside(F.col("ax") + t * dx, "x0", "x1").alias("x"), inside(F.col("ay") + t * dy, "y0", "y1").alias("y")))
    steps = met.select("map_id", "label", walk.alias("w")).select("map_id", "label", F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("s"))
    moved = steps.where("s.a <> s.b").select("map_id", "label", F.array("s.a.x", "s.a.y", "s.b.x", "s.b.y").alias("e"))
    return moved.groupBy("map_id", "label").agg(F.flatten(F.collect_list("e")).alias("clip"))


def widened(polygons: DataFrame, by: float, scale: int = SCALE) -> DataFrame:
    """polygons (map_id, label, own) with `wide`, own grown by `by`."""
    kinds = ", ".join(f"{c} {polygons.schema[c].dataType.simpleString()}" for c in ("map_id", "label"))

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(wide=[flat(grown(lists(r), by * scale)) for r in rows.own])

    return polygons.select("map_id", "label", "own").mapInPandas(widen, f"{kinds}, own {RINGS}, wide {RINGS}")


def overlapping(boxes: DataFrame, cell: int) -> DataFrame:
    """(map_id, label, other) for boxes that overlap or touch, by the grid cells that they share."""
    reach = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long"))
    dealt = boxes.withColumn("cx", F.explode(reach("x0", "x1"))).withColumn("cy", F.explode(reach("y0", "y1")))
    theirs = dealt.select("map_id", "cx", "cy", F.col("label").alias("other"), *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")])
    met = dealt.join(theirs, ["map_id", "cx", "cy"]).where("label <> other and x0 <= ox1 and ox0 <= x1 and y0 <= oy1 and oy0 <= y1")
    return met.select("map_id", "label", "other").distinct()


def without_neighbours(polygons: DataFrame, neighbours: DataFrame, by: float, outline: DataFrame | None = None, extract: bool = True, scale: int = SCALE, group_numbers: int = GROUP_NUMBERS) -> DataFrame:
    """(map_id, label, rings, changed): valid polygons (map_id, label, ring, holes) grown by `by`, less their neighbours
    (map_id, label, neighbour), one after another from the highest label on.

    A polygon grows, is cut to the outline (map_id, ring, holes; null: not cut), and loses what each neighbour has just then:
    its own shape, or the changed one if the neighbour's turn was earlier. With `extract` neighbours are grown by `by` for
    this, and what a changed polygon has is no longer part of the outline for those after it. A polygon of which nothing
    would be left stays as it was. rings: outer ones and holes in steps (RINGS), of several parts perhaps.
    """
    keys = ["map_id", "label"]
    hole_rings = F.coalesce("holes", F.array().cast(f"array<{RING}>"))
    start = polygons.select(*keys, in_steps(F.concat(F.array("ring"), hole_rings), scale).alias("own"))
    kinds = ", ".join(f"{c} {polygons.schema[c].dataType.simpleString()}" for c in keys)

    def orient(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(own=[flat(oriented(lists(r))) for r in rows.own])

    start = settled(widened(evenly(start, *keys).mapInPandas(orient, f"{kinds}, own {RINGS}"), by, scale))
    coordinate = lambda side, fold: fold(F.transform(F.flatten("wide"), lambda v, i: F.when(i % 2 == side, v)))
    margin = int(by * scale) if extract else 0  # neighbours are grown once more
    boxes = settled(start.where("size(wide) > 0").select(*keys, *[(fold(side) + d * (margin + 2)).alias(n) for n, side, fold, d in (("x0", 0, lambda s: coordinate(s, F.array_min), -1), ("y0", 1, lambda s: coordinate(s, F.array_min), -1), ("x1", 0, lambda s: coordinate(s, F.array_max), 1), ("y1", 1, lambda s: coordinate(s, F.array_max), 1))]))
    clip = None
    if outline is not None:
        whole = outline.select("map_id", in_steps(F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(f"array<{RING}>"))), scale).alias("rings"))

        def orient_outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield rows.assign(rings=[flat(oriented(lists(r))) for r in rows.rings])

        whole = whole.mapInPandas(orient_outline, f"map_id {polygons.schema['map_id'].dataType.simpleString()}, rings {RINGS}")
        clip = clamped(whole, boxes, scale)
    listed = neighbours.select("map_id", F.col("label").cast(polygons.schema["label"].dataType).alias("label"), F.col("neighbour").cast(polygons.schema["label"].dataType).alias("other"), F.lit(True).alias("listed")).where("label <> other").distinct()
    pairs = listed
    if extract and outline is not None:
        touching = overlapping(boxes, int(64 * scale)).where("other > label").withColumn("listed", F.lit(False))
        pairs = listed.unionByName(touching).groupBy(*keys, "other").agg(F.max("listed").alias("listed"))
    pairs = settled(pairs.join(start.select("map_id", F.col("label").alias("other")), ["map_id", "other"], "left_semi").join(start.select(*keys), keys, "left_semi"))
    ready = start if clip is None else start.join(clip, keys, "left")
    todo = settled(ready.select(*keys, "own", "wide", (F.lit(None).cast("array<long>") if clip is None else F.coalesce("clip", F.array().cast("array<long>"))).alias("clip")))
    numbers = F.aggregate("own", F.lit(0).cast("long"), lambda n, r: n + F.size(r)).alias("numbers")
    groups = gathered(start.select(*keys, numbers), pairs.select("map_id", F.col("label").cast("long").alias("a"), F.col("other").cast("long").alias("b")), "label", group_numbers)

    def less(wide, clip_ends, takers: list) -> list[np.ndarray]:
        a = ends_of(lists(wide))
        if clip_ends is not None:
            a = np.concatenate([a, np.asarray(clip_ends, np.int64).reshape(-1, 4)])
        b = ends_of([r for t in takers for r in lists(t)])
        least = 1 if clip_ends is None else 2
        return kept_rings(np.concatenate([a, b]), np.repeat([[1, 0], [0, 1]], (len(a), len(b)), 0), lambda p, q: (p >= least) & (q <= 0))

    def in_order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("label", ascending=False)
        at = {label: k for k, label in enumerate(rows.label)}
        first = list(rows["wide"] if extract else rows.own)
        rings, changed, wider = list(rows.own), [False] * len(rows), list(rows["wide"])
        for k, (label, wide, clip_ends, others, are_listed) in enumerate(zip(rows.label, rows["wide"], rows["clip"], rows.others, rows.are_listed, strict=True)):
            takers = []
            for other, is_listed in zip(others, are_listed, strict=True):
                j = at[other]
                if other < label:
                    takers.append(first[j])
                elif is_listed:
                    takers.append(wider[j] if extract else rings[j])
                elif changed[j]:
                    takers.append(rings[j])
            own = less(wide, clip_ends, takers)
            if own:
                rings[k], changed[k] = flat(own), True
                if extract:
                    wider[k] = flat(grown(own, by * scale))
        return pd.DataFrame({"map_id": rows.map_id, "label": rows.label, "rings": rings, "changed": changed})

    linked = pairs.groupBy(*keys).agg(F.collect_list(F.struct("other", "listed")).alias("links"))
    no_links = lambda c, kind: F.coalesce(F.col(f"links.{c}"), F.array().cast(f"array<{kind}>"))
    small = todo.join(groups.where("small").drop("small"), keys).join(linked, keys, "left").withColumn("others", no_links("other", pairs.schema["other"].dataType.simpleString())).withColumn("are_listed", no_links("listed", "boolean")).drop("links")
    done = settled(evenly(small, "map_id", "group").groupBy("map_id", "group").applyInPandas(in_order, f"{kinds}, rings {RINGS}, changed boolean"))
    large = groups.where("not small").select(*keys)
    if large.isEmpty():
        return done
    todo, pairs = todo.join(large, keys, "left_semi"), pairs.join(large, keys, "left_semi")
    state = settled(start.join(large, keys, "left_semi").select(*keys, F.col("own").alias("rings"), F.col("wide").alias("grown"), F.lit(False).alias("changed"), F.lit(False).alias("done")))
    shape = "wide" if extract else "own"  # of neighbours whose turn comes later
    later = pairs.where("other < label").join(start.select("map_id", F.col("label").alias("other"), F.col(shape).alias("taken")), ["map_id", "other"])
    later = settled(later.groupBy(*keys).agg(F.collect_list("taken").alias("later")))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [less(*r) for r in zip(rows["wide"], rows["clip"], rows.takers, strict=True)]
            changed = [bool(r) for r in out]
            rings = [flat(r) if ok else own for r, ok, own in zip(out, changed, rows.own, strict=True)]
            wider = [flat(grown(r, by * scale)) if ok and extract else wide for r, ok, wide in zip(out, changed, rows.wide, strict=True)]
            yield pd.DataFrame({"map_id": rows.map_id, "label": rows.label, "rings": rings, "grown": wider, "changed": changed, "done": True})

    waits = pairs.where("other > label")
    for _ in range(ROUNDS):
        open_ones = state.where("not done").select("map_id", "label")
        if open_ones.isEmpty():
            return state.select(*keys, "rings", "changed").unionByName(done)
        blocked = waits.join(open_ones.withColumnRenamed("label", "other"), ["map_id", "other"], "left_semi").select(*keys).distinct()
        now = todo.join(open_ones, keys, "left_semi").join(blocked, keys, "left_anti")
        theirs = state.select("map_id", F.col("label").alias("other"), "rings", F.col("grown"), F.col("changed").alias("theirs_changed"))
        met = now.select(*keys).join(waits, keys).join(theirs, ["map_id", "other"])
        taken = F.when(F.col("listed"), F.col("grown") if extract else F.col("rings")).when(F.col("theirs_changed"), F.col("rings"))
        takers = met.select(*keys, taken.alias("taken")).where("taken is not null").groupBy(*keys).agg(F.collect_list("taken").alias("takers"))
        none = F.array().cast(f"array<{RINGS}>")
        both = F.concat(F.coalesce("takers", none), F.coalesce("later", none)).alias("takers")
        made = now.join(takers, keys, "left").join(later, keys, "left").select(*keys, "own", "wide", "clip", both).mapInPandas(step, state.schema)
        fresh = settled(made)
        state = settled(state.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh))
    raise RuntimeError(f"polygons are still left after {ROUNDS} rounds")


def as_rings(folded: DataFrame, scale: int = SCALE) -> DataFrame:
    """(map_id, label, ring): every ring of the polygons of without_neighbours, in units, oriented as they are."""
    at = lambda r, k, d: (F.get(r, (2 * k + d).cast("int")) / scale)
    points = F.transform(F.sequence(F.lit(0), (F.size("r") / 2 - 1).cast("int")), lambda k: F.struct(at("r", k, 0).alias("x"), at("r", k, 1).alias("y")))
    return folded.select("map_id", "label", F.explode("rings").alias("r")).select("map_id", "label", points.alias("ring"))


def parts(folded: DataFrame, scale: int = SCALE) -> DataFrame:
    """(map_id, label, ring, holes, changed): the largest part of each polygon of without_neighbours, in units."""
    kinds = ", ".join(f"{c} {folded.schema[c].dataType.simpleString()}" for c in ("map_id", "label"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [largest_of(lists(r)) for r in rows.rings]
            yield pd.DataFrame({"map_id": rows.map_id, "label": rows.label, "ring": [in_units(f[0], scale) for f in found], "holes": [[in_units(h, scale) for h in f[1]] for f in found], "changed": rows.changed})

    return folded.mapInPandas(split, f"{kinds}, ring {RING}, holes array<{RING}>, changed boolean")


def area_of(ring: np.ndarray) -> float:
    p, q = ring.astype(float), np.roll(ring, -1, 0).astype(float)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2


def encloses(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring.astype(float), np.roll(ring, -1, 0).astype(float)
    over = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[over], b[over]
    return bool((x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])).sum() % 2)


def largest_of(rings: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The outer ring of the part of the largest area, and its holes."""
    outer = [r for r in rings if area_of(r) > 0]
    if not outer:
        return np.zeros((0, 2)), []
    own: dict[int, list[np.ndarray]] = {k: [] for k in range(len(outer))}
    for hole in (r for r in rings if area_of(r) < 0):
        x, y = (hole[0] + hole[1]) / 2
        around = [k for k, r in enumerate(outer) if area_of(r) > -area_of(hole) and encloses(r, x, y)]
        if around:
            own[min(around, key=lambda k: area_of(outer[k]))].append(hole)
    best = max(own, key=lambda k: (area_of(outer[k]) + sum(map(area_of, own[k])), -k))
    return outer[best], own[best]


# ---- snapping


def snapped_pair(line: np.ndarray, vertices: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """A polygon and its neighbour after they have been snapped to each other.

    First each vertex of the neighbour near an edge of the polygon (less than reach away, not near the edge's ends) moves
    onto it, the last such edge counts, and becomes a vertex of the polygon there, in the neighbour's order. Then all pairs
    of their vertices within reach of each other, by the places that these have before, move to the floor of the middle of
    where they are, in the order of the polygon's vertices and then of the neighbour's.
    """
    moved, result = vertices.copy(), []
    for k in range(len(line)):
        a, b = line[k], line[(k + 1) % len(line)]
        result.append(a)
        span = (b - a) @ (b - a)
        if not span:
            continue
        u = (vertices - a) @ (b - a) / span
        foot = a + u[:, None] * (b - a)
        near = (u >= 0.05) & (u <= 0.95) & (np.hypot(*(vertices - foot).T) < reach)
        moved[near] = foot[near]
        result += list(foot[near])
    line = np.array(result).reshape(-1, 2)
    close = np.hypot(*(line[:, None] - moved[None]).transpose(2, 0, 1)) <= reach
    for i, j in zip(*np.nonzero(close), strict=True):
        line[i] = moved[j] = np.floor((line[i] + moved[j]) / 2)
    return line, moved


def snap_polygons(points: DataFrame, neighbours: DataFrame, reach: float, group_numbers: int = GROUP_NUMBERS) -> DataFrame:
    """(map_id, poly, seq, x, y) after each pair of neighbours (map_id, label, neighbour) has been snapped once, from the
    highest label on, a label's neighbours in their order. A group is snapped in one task; of groups with more than
    group_numbers coordinates, a round snaps all pairs whose polygons no earlier pair waits for.
    """
    kind = points.schema["map_id"].dataType.simpleString()
    state = settled(points.groupBy("map_id", F.col("poly").cast("long").alias("poly")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))).alias("xy")))
    polys = state.select("map_id", "poly")
    own, other = F.col("label").cast("long"), F.col("neighbour").cast("long")
    # of a pair that lists each other, the higher label's turn comes first and takes it off the other's list
    listed = neighbours.where("label <> neighbour").select("map_id", own.alias("a"), other.alias("b")).distinct()
    turns = listed.groupBy("map_id", F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).agg(F.max("a").alias("a"))
    pairs = turns.select("map_id", "a", F.when(F.col("a") == F.col("hi"), F.col("lo")).otherwise(F.col("hi")).alias("b"))
    for c in ("a", "b"):
        pairs = pairs.join(polys.withColumnRenamed("poly", c), ["map_id", c], "left_semi")
    left = settled(pairs.select("map_id", "a", "b"))
    groups = gathered(state.select("map_id", "poly", F.size("xy").cast("long").alias("numbers")), left, "poly", group_numbers)

    def in_order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("poly", ascending=False)
        now = {poly: np.asarray(xy, float).reshape(-1, 2) for poly, xy in zip(rows.poly, rows.xy, strict=True)}
        for a, others in zip(rows.poly, rows.others, strict=True):
            for b in others:
                now[a], now[b] = snapped_pair(now[a], now[b], reach)
        return pd.DataFrame({"map_id": rows.map_id, "poly": rows.poly, "xy": [now[poly].ravel().tolist() for poly in rows.poly]})

    lists_of = left.groupBy("map_id", F.col("a").alias("poly")).agg(F.sort_array(F.collect_list("b")).alias("others"))
    small = state.join(groups.where("small").drop("small"), ["map_id", "poly"]).join(lists_of, ["map_id", "poly"], "left").withColumn("others", F.coalesce("others", F.array().cast("array<long>")))
    snapped = settled(evenly(small, "map_id", "group").groupBy("map_id", "group").applyInPandas(in_order, f"map_id {kind}, poly long, xy array<double>"))
    large = settled(groups.where("not small").select("map_id", "poly"))
    state = settled(state.join(large, ["map_id", "poly"], "left_semi"))
    left = settled(left.join(large.withColumnRenamed("poly", "a"), ["map_id", "a"], "left_semi"))

    def snap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            both = [snapped_pair(np.asarray(p, float).reshape(-1, 2), np.asarray(q, float).reshape(-1, 2), reach) for p, q in zip(rows.xy, rows.other_xy, strict=True)]
            for k, name in ((0, "a"), (1, "b")):
                yield pd.DataFrame({"map_id": rows.map_id, "poly": rows[name], "xy": [r[k].ravel().tolist() for r in both]})

    order = F.struct((-F.col("a")).alias("a"), "b")
    for _ in range(ROUNDS):
        if left.isEmpty():
            return state.unionByName(snapped).select("map_id", "poly", F.posexplode(F.sequence(F.lit(0), (F.size("xy") / 2 - 1).cast("int"))).alias("seq", "k"), "xy").select("map_id", "poly", "seq", F.get("xy", 2 * F.col("k")).alias("x"), F.get("xy", 2 * F.col("k") + 1).alias("y"))
        ends = left.select("map_id", order.alias("turn"), F.explode(F.array("a", "b")).alias("poly")).groupBy("map_id", "poly").agg(F.min("turn").alias("turn"))
        both_first = ends.groupBy("map_id", "turn").agg(F.count("*").alias("n")).where("n = 2").select("map_id", (-F.col("turn.a")).alias("a"), F.col("turn.b").alias("b"))
        ready = settled(both_first)
        met = ready.join(state.withColumnRenamed("poly", "a"), ["map_id", "a"]).join(state.select("map_id", F.col("poly").alias("b"), F.col("xy").alias("other_xy")), ["map_id", "b"])
        fresh = settled(met.select("map_id", "a", "b", "xy", "other_xy").mapInPandas(snap, f"map_id {kind}, poly long, xy array<double>"))
        state = settled(state.join(fresh.select("map_id", "poly"), ["map_id", "poly"], "left_anti").unionByName(fresh))
        left = settled(left.join(ready, ["map_id", "a", "b"], "left_anti"))
    raise RuntimeError(f"pairs are still left after {ROUNDS} rounds")
