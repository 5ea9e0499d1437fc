"""Folds in rounds against the same steps one after another, and the small overlay against the large one."""

import signal

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasheet.operators import folds, overlay

from .test_operators import ring

S = overlay.SCALE
RULES = {"INTERSECTION": lambda a, b: (a % 2 == 1) & (b % 2 == 1), "DIFFERENCE": lambda a, b: (a % 2 == 1) & (b % 2 == 0)}


def steps(points):
    return np.array(points, np.int64).reshape(-1, 2) * S


def area(rings):
    return round(sum(map(folds.area_of, rings)) / S / S, 6)


def test_small_and_large_overlay_agree(spark):
    rng = np.random.default_rng(4)
    shapes = {k: [[tuple(p) for p in rng.integers(0, 15, (rng.integers(3, 9), 2)).tolist()] for _ in range(2)] for k in range(15)}
    frame = lambda i: spark.createDataFrame([(k, ring(*s[i])) for k, s in shapes.items()], "k int, ring array<struct<x: double, y: double>>")
    for name, rule in RULES.items():
        got = {r.k: round(r.area, 6) for r in overlay.overlaid(frame(0), frame(1), ["k"], getattr(overlay, name), cell=4.0).groupBy("k").agg(F.sum("area").alias("area")).collect()}
        for k, (p, q) in shapes.items():
            assert area(folds.solved([steps(p)], [steps(q)], rule)) == pytest.approx(got.get(k, 0), abs=1e-5)


def squares(seed, n=9):
    """Rectangles of whole corners, some of them overlapping, with those around as neighbours (one-sided ones as well)."""
    rng = np.random.default_rng(seed)
    boxes = {}
    for k in range(1, n + 1):
        x, y = rng.integers(0, 20, 2)
        w, h = rng.integers(2, 7, 2)
        boxes[k] = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    near = {(a, b) for a in boxes for b in boxes if a != b and abs(boxes[a][0][0] - boxes[b][0][0]) < 8 and abs(boxes[a][0][1] - boxes[b][0][1]) < 8 and rng.random() < 0.8}
    return boxes, near


def in_turn(boxes, near, by, outline, extract):
    """The difference with enlarged polygons, one polygon after another."""
    now = {k: [steps(b)] for k, b in boxes.items()}
    left = [steps(outline)] if outline else None
    whole = lambda rings: folds.solved(rings, [], lambda a, b: a > 0)
    for k in sorted(boxes, reverse=True):
        big = folds.grown(now[k], by * S)
        if left is not None:
            big = folds.kept_rings(folds.ends_of(big + left), np.ones((len(folds.ends_of(big + left)), 1), int) * [[1, 0]], lambda a, b: a > 1)
        for other in sorted(b for a, b in near if a == k):
            theirs = folds.grown(now[other], by * S) if extract else now[other]
            big = folds.solved(big, whole(theirs), lambda a, b: (a > 0) & (b <= 0))
        if big:
            now[k] = big
            if extract and left is not None:
                left = folds.solved(left, big, lambda a, b: (a > 0) & (b <= 0))
    return now


@pytest.mark.parametrize("seed,extract,outline", [(0, True, True), (1, False, True), (2, True, False)])
def test_difference_in_rounds_equals_the_fold(spark, seed, extract, outline):
    frame = [(1, 1), (22, 1), (24, 12), (22, 22), (2, 20)] if outline else None
    maps = {m: squares(10 * seed + m) for m in range(2)}
    polygons = spark.createDataFrame([(m, k, ring(*b), []) for m, (boxes, _) in maps.items() for k, b in boxes.items()], "map_id int, label long, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>")
    near = spark.createDataFrame([(m, a, b) for m, (_, pairs) in maps.items() for a, b in pairs], "map_id int, label long, neighbour long")
    whole = spark.createDataFrame([(m, ring(*frame), []) for m in maps], polygons.drop("label").schema) if outline else None
    got = folds.without_neighbours(polygons, near, 1.5, whole, extract).collect()
    want = {m: in_turn(boxes, pairs, 1.5, frame, extract) for m, (boxes, pairs) in maps.items()}
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        own, expected = folds.lists(r.rings), want[r.map_id][r.label]
        off = folds.solved(own, expected, lambda a, b: (a > 0) != (b > 0))
        assert area(own) == pytest.approx(area(expected), abs=0.01) and abs(area(off)) < 0.01, (r.map_id, r.label)


def test_the_outline_far_from_a_box_counts(spark):
    """A box inside a large outline is not cut; one in its hole vanishes, and so stays as it was."""
    schema = "map_id int, label long, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>"
    box = lambda x, y, w: ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))
    polygons = spark.createDataFrame([(1, 1, box(20, 20, 4), []), (1, 2, box(60, 60, 2), []), (1, 3, box(96, 40, 4), [])], schema)
    outline = spark.createDataFrame([(1, box(0, 0, 100), [box(50, 50, 30)])], "map_id int, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>")
    near = spark.createDataFrame([], "map_id int, label long, neighbour long")
    got = {r.label: (area(folds.lists(r.rings)), r.changed) for r in folds.without_neighbours(polygons, near, 1.0, outline).collect()}
    assert got == {1: (36, True), 2: (4, False), 3: (30, True)}


def test_snapping_in_rounds_equals_the_fold(spark):
    rng = np.random.default_rng(8)
    shapes = {(m, k): rng.integers(0, 30, (rng.integers(3, 7), 2)).astype(float) for m in range(2) for k in range(1, 7)}
    near = {(m, a, b) for m in range(2) for a in range(1, 7) for b in range(1, 8) if a != b and rng.random() < 0.4}
    points = spark.createDataFrame([(m, k, i, float(x), float(y)) for (m, k), p in shapes.items() for i, (x, y) in enumerate(p)], "map_id int, poly long, seq int, x double, y double")
    got = {}
    for r in folds.snap_polygons(points, spark.createDataFrame(sorted(near), "map_id int, label long, neighbour long"), 4.0).orderBy("seq").collect():
        got.setdefault((r.map_id, r.poly), []).append((r.x, r.y))
    now, lists = dict(shapes), {(m, a): sorted(b for n, c, b in near if (n, c) == (m, a)) for m in range(2) for a in range(1, 8)}
    for m in range(2):
        for a in range(6, 0, -1):
            for b in list(lists[m, a]):
                if b == 7:
                    continue  # no such polygon
                now[m, a], now[m, b] = folds.snapped_pair(now[m, a], now[m, b], 4.0)
                if a in lists[m, b]:
                    lists[m, b].remove(a)
    assert {k: [tuple(p) for p in v.tolist()] for k, v in now.items()} == got


def test_all_close_vertices_meet():
    line, other = folds.snapped_pair(np.array([(0.0, 0.0), (50.0, 0.0), (50.0, 50.0)]), np.array([(1.0, 1.0), (1.0, -1.0), (100.0, 100.0)]), 4.0)
    assert other[0].tolist() == [0, 0] and other[1].tolist() == [0, -1] and line[0].tolist() == [0, -1]


def test_cutting_ends_on_crowded_points():
    """Edges between neighbouring whole points: diagonals pass exactly between the points beside them."""
    rng = np.random.default_rng(0)
    signal.alarm(60)  # it would go on for ever
    try:
        for _ in range(40):
            p, q = rng.integers(-4, 5, (2, rng.integers(5, 40), 2))
            ends, _ = folds.cut(*folds.merged(folds.ends_of([p, q]), np.ones((len(p) + len(q), 2), np.int64)))
            assert (np.abs(ends[:, 2:] - ends[:, :2]).max(1) >= 1).all()
    finally:
        signal.alarm(0)


#: Edges that leave two points a step apart, side by side: cut where they cross, they would cross again a step further on.
SLIDING = [[1174330, 1808419, 1179648, 1824372], [1179648, 1824372, 1179648, 1835008], [1179648, 1835008, 1174330, 1808419], [1114112, 1507328, 1179648, 1835008], [1179648, 1835008, 983040, 1572864], [983040, 1572864, 1114112, 1507328]]


def test_cutting_ends_on_edges_that_slide_along_each_other(spark):
    signal.alarm(60)  # it would take thousands of rounds
    try:
        ends, _ = folds.cut(*folds.merged(np.array(SLIDING), np.ones((6, 2), np.int64)))
    finally:
        signal.alarm(0)
    given = spark.createDataFrame([(0, 0, *e) for e in SLIDING], "k int, side int, ax long, ay long, bx long, by_ long")
    large = overlay.arranged(given, ["k"], 16 * S).select(*overlay.ENDS).collect()
    assert len(ends) < 20 and sorted(map(tuple, ends.tolist())) == sorted(map(tuple, large))


@pytest.mark.parametrize("extract", [True, False])
def test_groups_in_one_task_equal_rounds(spark, extract):
    maps = {m: squares(70 + m, 7) for m in range(2)}
    polygons = spark.createDataFrame([(m, k, ring(*b), []) for m, (boxes, _) in maps.items() for k, b in boxes.items()], "map_id int, label long, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>")
    near = spark.createDataFrame([(m, a, b) for m, (_, pairs) in maps.items() for a, b in pairs], "map_id int, label long, neighbour long")
    results = [{(r.map_id, r.label): (sorted(map(tuple, r.rings)), r.changed) for r in folds.without_neighbours(polygons, near, 1.5, extract=extract, group_numbers=most).collect()} for most in (0, 30, folds.GROUP_NUMBERS)]
    assert len(results[0]) == 14 and results[0] == results[1] == results[2]


def test_snapping_in_one_task_equals_rounds(spark):
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(k % 2, k, i, float(x), float(y)) for k in range(10) for i, (x, y) in enumerate(rng.integers(0, 25, (5, 2)))], "map_id int, poly long, seq int, x double, y double")
    near = spark.createDataFrame([(k % 2, k, j) for k in range(10) for j in range(10) if k % 2 == j % 2 and k != j and rng.random() < 0.4], "map_id int, label long, neighbour long")
    results = [sorted(map(tuple, folds.snap_polygons(points, near, 4.0, most).collect())) for most in (0, folds.GROUP_NUMBERS)]
    assert len(results[0]) > 10 and results[0] == results[1]
