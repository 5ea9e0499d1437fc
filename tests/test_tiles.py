"""Tiles and halos give what a whole map gives, whatever the tile's side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasheet.operators import graph, tiles

from .test_operators import mask, pixels


def cells(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("side", [5, 8, 64])
def test_skeleton_by_tiles(spark, side):
    own = mask(11, 23, 31, 0.8)
    own[5:15, 4:20] = True
    ys, xs = np.nonzero(tiles.peeled(own, 10**6))
    got = cells(tiles.skeleton(pixels(spark, own).where("v"), side, rounds=1 if side == 5 else 3))
    assert got == {(1, int(y), int(x)) for y, x in zip(ys, xs, strict=True)}


def test_hysteresis_by_tiles(spark):
    rng = np.random.default_rng(2)
    image = np.cumsum(rng.integers(-9, 10, (21, 30)), 1) + np.cumsum(rng.integers(-9, 10, (21, 30)), 0)
    df = pixels(spark, image)
    size, ridge = tiles.ridges(image)
    strong, whole = ridge & (size > 90), None
    while whole is None or (whole != strong).any():
        whole, near = strong, np.pad(strong, 1)
        grown = np.logical_or.reduce([near[1 + dy : 22 + dy, 1 + dx : 31 + dx] for dy, dx in [*tiles.AROUND, (0, 0)]])
        strong = ridge & (size > 30) & grown
    assert whole.sum() > (ridge & (size > 90)).sum()
    for side in (4, 7, 64):
        assert cells(tiles.canny(df, "v", 30, 90, side)) == {(1, int(y), int(x)) for y, x in zip(*np.nonzero(whole), strict=True)}


def best_ways(height, marker, inside):
    """(level, steps, label) by relaxing all pixels until nothing changes: first level and steps, then labels along best ways."""
    far = (np.inf, 0)
    state = {p: far for p in zip(*(v.tolist() for v in np.nonzero(inside)), strict=True)}
    fixed = {p for p in state if marker[p] > 0}
    state.update({p: (height[p], 0) for p in fixed})
    step = lambda s, h: (h, 0) if h > s[0] else (s[0], s[1] + 1)
    around = lambda p: [q for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)) if q in state]
    changed = True
    while changed:
        changed = False
        for p in state:
            if p not in fixed:
                new = min([step(state[q], height[p]) for q in around(p) if state[q] != far], default=far)
                if new != state[p]:
                    state[p], changed = new, True
    label = {}
    for p in sorted((p for p in state if state[p] != far), key=lambda p: state[p]):
        label[p] = int(marker[p]) if p in fixed else min(label[q] for q in around(p) if q in label and state[q] != far and step(state[q], height[p]) == state[p])
    return label


@pytest.mark.parametrize("seed", range(3))
def test_watershed_by_tiles(spark, seed):
    rng = np.random.default_rng(seed)
    inside = rng.random((19, 22)) < 0.85
    height = rng.integers(0, 4, inside.shape).astype(float)
    marker = np.where((rng.random(inside.shape) < 0.03) & inside, rng.integers(1, 9, inside.shape), 0)
    want = best_ways(height, marker, inside)
    df = pixels(spark, height, "h").join(pixels(spark, marker.astype(int), "k"), ["map_id", "y", "x"]).join(pixels(spark, inside, "m"), ["map_id", "y", "x"])
    for side in (4, 8, 64) if seed == 0 else (6,):
        got = {(r.y, r.x): r.label for r in tiles.watershed(df, "h", "k", "m", side).collect()}
        assert got == want


def test_water_on_flat_ground_meets_half_way(spark):
    flat = np.zeros((1, 11))
    marker = np.zeros((1, 11), int)
    marker[0, 0], marker[0, 10] = 7, 3
    df = pixels(spark, flat, "h").join(pixels(spark, marker, "k"), ["map_id", "y", "x"]).join(pixels(spark, flat == 0, "m"), ["map_id", "y", "x"])
    got = {r.x: r.label for r in tiles.watershed(df, "h", "k", "m", 3).collect()}
    assert [got[x] for x in range(11)] == [7] * 5 + [3] * 6


def test_nothing_to_flood(spark):
    df = spark.createDataFrame([], "map_id int, y int, x int, h double, k int, m boolean")
    assert tiles.watershed(df, "h", "k", "m").count() == 0 and tiles.skeleton(df).count() == 0 and tiles.canny(df, "h").count() == 0


def test_groups_are_whole_in_any_batches(spark):
    rows = [(None if k == 5 else k, i % 3, i) for k in range(12) for i in range((k * 7) % 23)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(3)
    calls = spark.sparkContext.accumulator(0)

    def sums(own):
        calls.add(1)
        return own.groupby(["a", "b"], dropna=False, as_index=False).agg(n=("v", "size"), total=("v", "sum"))

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("2", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            calls.value = 0
            got = graph.in_groups(df, ["a", "b"], sums, "a int, b int, n long, total long").collect()
            assert sorted(map(repr, got)) == sorted(map(repr, df.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("v").alias("total")).collect()))
        assert calls.value <= 8  # twice in each of four tasks, not once for each of 33 groups
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
