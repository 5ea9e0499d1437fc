"""Hand-computed cases, brute force and invariants of the operators."""

import json
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasheet.config import IOU_THRESHOLDS
from terrasheet.functions import color, rings
from terrasheet.operators import borders, components, evaluation, features, folds, geometry, kernels, learning, overlay, raster, registration, sampling, tiles
from terrasheet.plans import geometry_queries
from terrasheet.sources import geojson, images
from terrasheet.streaming import maps


def pixels(spark, array, name="v", map_id=1):
    array = np.asarray(array)
    rows = [(map_id, int(y), int(x), array[y, x].item()) for y in range(array.shape[0]) for x in range(array.shape[1])]
    kind = {"b": "boolean", "i": "int", "f": "double"}[array.dtype.kind]
    return spark.createDataFrame(rows, f"map_id int, y int, x int, {name} {kind}")


def dense(df, name="v"):
    rows = df.select("y", "x", name).collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), object)
    for r in rows:
        out[r.y, r.x] = r[name]
    return out


def mask(seed, h=9, w=11, share=0.45):
    return np.random.default_rng(seed).random((h, w)) < share


def ring(*points):
    return [{"x": float(a), "y": float(b)} for a, b in points]


def one(spark, column, **given):
    schema = "a array<struct<x: double, y: double>>"
    return spark.createDataFrame([(given["a"],)], schema).select(column.alias("v")).first().v


def test_colours(spark):
    row = spark.sql("select 200 r, 100 g, 50 b, 74 r2, 210 g2, 245 b2, 255 r3, 190 g3, 218 b3")
    out = row.select(color.gray(F.col("r"), F.col("g"), F.col("b"), color.SWAPPED_LUMA).alias("gray"), color.hex_color(F.col("r2"), F.col("g2"), F.col("b2")).alias("hex"), *[c.alias(n) for c, n in zip(color.hsv(F.lit(0.5), F.lit(0.5), F.lit(0.5), 1.0), "hsv", strict=True)]).first()
    assert (out.gray, out.hex, out.h, out.s, out.v) == (96, "#4ad2f5", 0.0, 0.0, 0.5)


def test_ring_measures(spark):
    box = ring((0, 0), (4, 0), (4, 3), (0, 3))
    a = F.col("a")
    assert one(spark, rings.area(a), a=box) == 12 and one(spark, rings.perimeter(a), a=box) == 14
    assert one(spark, rings.area(a), a=[]) is None or one(spark, rings.area(a), a=[]) == 0
    rect = one(spark, rings.rotated_rectangle(a), a=box)
    assert (rect.length, rect.breadth) == (4, 3)
    row = features.shape(spark.createDataFrame([(box, box)], "ring array<struct<x:double,y:double>>, hull array<struct<x:double,y:double>>"), "ring", "hull", F.lit(24.0)).first()
    assert row.rectangularity == 1 and row.solidity == 1 and row.aspect_ratio == pytest.approx(4 / 3)
    assert row.elongation == 0.25 and row.circularity == pytest.approx(12 / 196) and row.convexity == 1 and row.relative_area == 0.5


def test_simplify():
    line = np.array([(0, 0), (5, 0.5), (10, 0)], float)
    assert geometry.simplified(line, 1, False).tolist() == [[0, 0], [10, 0]]
    line = np.array([(0, 0), (2, 0.3), (4, 3), (6, 0.2), (8, 0.1), (10, 0)], float)
    assert geometry.simplified(line, 1, False).tolist() == line[[0, 2, 3, 5]].tolist()
    assert len(geometry.simplified(np.zeros((0, 2)), 1, True)) == 0


def test_hull_and_representative_point():
    rng = random.Random(3)
    for _ in range(30):
        pts = np.array([(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(rng.randint(1, 30))], float)
        hull = geometry.hull_points(pts)
        if len(hull) > 2:
            for a, b in zip(hull, np.roll(hull, -1, 0), strict=True):
                assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for p in pts)
    x, y = geometry.representative(np.array([(0, 0), (10, 0), (10, 10), (9, 1), (0, 10)], float))[0]
    assert 0 < x < 10 and 0 < y < 10


def test_components_cross_tiles(spark):
    own = mask(1, 12, 13)
    for diagonal in (False, True):
        found = {(r.y, r.x): r.label for r in components.components(pixels(spark, own).where("v"), diagonal, tile=4).collect()}
        ys, xs = np.nonzero(own)
        first = components.label_tile(ys, xs, diagonal)
        want = {(int(y), int(x)): int(ys[k]) * components.WIDTH + int(xs[k]) for y, x, k in zip(ys, xs, first, strict=True)}
        assert found == want
    assert components.components(pixels(spark, own).where("false"), tile=4).count() == 0


def test_diagonal_pair(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "map_id int, y int, x int")
    assert components.components(df, False).select("label").distinct().count() == 2
    assert components.components(df, True).select("label").distinct().count() == 1


def test_morphology_invariants(spark):
    df = pixels(spark, mask(2).astype(int))
    closed = dense(raster.closing(df, "v", 3))
    again = dense(raster.closing(raster.closing(df, "v", 3), "v", 3))
    assert (closed == again).all() and (closed >= dense(df)).all()
    flipped = df.withColumn("v", 1 - F.col("v"))
    assert (dense(raster.erode(df, "v", 3)) == 1 - dense(raster.dilate(flipped, "v", 3))).all()


def test_distance_transform(spark):
    own = mask(4, share=0.1)
    own[2, 3] = True
    got = dense(raster.distance_transform(pixels(spark, own), F.col("v"), 50), "distance").astype(float)
    ys, xs = np.nonzero(own)
    for y in range(own.shape[0]):
        for x in range(own.shape[1]):
            assert got[y, x] == pytest.approx(min(math.hypot(y - a, x - b) for a, b in zip(ys, xs, strict=True)))
    assert set(dense(raster.distance_transform(pixels(spark, own & False), F.col("v"), 5), "distance").ravel()) == {5.0}


def test_fill_holes(spark):
    own = np.zeros((7, 7), bool)
    own[1:6, 1:6] = True
    own[2:4, 2:4] = False
    own[0, 0] = False
    filled = dense(components.fill_holes(pixels(spark, own), "v", tile=3)).astype(bool)
    want = np.zeros((7, 7), bool)
    want[1:6, 1:6] = True
    assert (filled == want).all()


def test_watershed_covers_what_markers_reach():
    own = mask(5, 12, 12, 0.7)
    markers = np.zeros(own.shape, int)
    ys, xs = np.nonzero(own)
    markers[ys[0], xs[0]], markers[ys[-1], xs[-1]] = 1, 2
    labels = tiles.flood(np.random.default_rng(1).random(own.shape), markers, own, [])[2]
    assert set(np.unique(labels)) <= {0, 1, 2} and (labels[~own] == 0).all()
    group = components.label_tile(ys, xs, False)
    reached = {g for g, y, x in zip(group, ys, xs, strict=True) if markers[y, x]}
    assert all((labels[y, x] > 0) == (g in reached) for g, y, x in zip(group, ys, xs, strict=True))


def test_trace_and_skeleton():
    own = np.zeros((6, 8), bool)
    own[1:5, 2:7] = True
    assert {tuple(p) for p in kernels.traced(own)} == {(2, 1), (6, 1), (6, 4), (2, 4)}
    assert len(kernels.traced(np.zeros((2, 2), bool))) == 0
    assert kernels.traced(np.array([[True]])).tolist() == [[0, 0]]
    thin = tiles.peeled(own, 10**6)
    assert thin.any() and not (thin & ~own).any()


def test_mitre():
    box = np.array([(0, 0), (4, 0), (4, 3), (0, 3)], float)
    assert {tuple(np.round(p, 6)) for p in kernels.mitred(box, 1)} == {(-1, -1), (5, -1), (5, 4), (-1, 4)}


def test_snapping_moves_onto_lines(spark):
    rows = [(1, i, x, y) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, -10), (0, -10)])] + [(2, i, x, y) for i, (x, y) in enumerate([(5, 2), (9, 20), (1, 20)])]
    near = spark.createDataFrame([(1, 1, 2)], "map_id int, label int, neighbour int")
    points = spark.createDataFrame([(1, *map(float, r)) for r in rows], "map_id int, poly double, seq double, x double, y double").withColumn("poly", F.col("poly").cast("int"))
    out = folds.snap_polygons(points, near, 4).collect()
    assert (2, 5.0, 0.0) in {(r.poly, r.x, r.y) for r in out} and (1, 5.0, 0.0) in {(r.poly, r.x, r.y) for r in out}


def test_midpoints_are_floors(spark):
    df = spark.createDataFrame([(1, 1, 0, 0), (2, 2, 3, 0), (3, 1, 50, 50)], "id long, poly int, x long, y long")
    assert [tuple(r) for r in geometry.midpoint_snaps(df, 4.0).collect()] == [(1, 2, 1, 0)]


def test_neighbours_are_asymmetric(spark):
    cells = [(1, y, x, 1) for y in range(10) for x in range(10)] + [(1, y, x, 2) for y in range(20, 26) for x in range(20, 26)]
    df = spark.createDataFrame(cells, "map_id int, y int, x int, label long")
    assert [(r.label, r.neighbour) for r in geometry.box_neighbours(df, 20, cell=8).collect()] == [(1, 2)]


def test_sweep(spark):
    df = spark.createDataFrame([(0.5,), (0.71,), (0.9,)], "iou double")
    row = evaluation.threshold_sweep(df, 4, None, [0.7]).first()
    assert (row.tp, row.precision, row.recall) == (2, 0.6667, 0.5) and row.f1 == pytest.approx(2 * 0.6667 * 0.5 / 1.1667)
    exact = spark.createDataFrame([(0.7,)], "iou double")
    assert evaluation.threshold_sweep(exact, 1).where(F.col("threshold") == IOU_THRESHOLDS[4]).first().tp == 0
    nothing = evaluation.threshold_sweep(df.limit(0), 0, None, [0.5]).first()
    assert (nothing.tp, nothing.precision, nothing.recall, nothing.f1) == (0, None, None, None)


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.8,), (1.0,)], "v double")
    assert [r.n for r in evaluation.histogram(df, F.col("v")).orderBy("bin").collect()] == [1, 1, 2]


def test_robust_statistics(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 2, 5, 11, 3)] + [("b", 1), ("b", 1)], "k string, v int")
    rows = {r.k: r for r in features.spectral(df, ["k"], ["v"]).collect()}
    a = rows["a"]
    assert (a.median_v, a.mad_v, a.mean_v) == (2.5, 1.0, 4.0) and a.std_v == pytest.approx(3.366502, abs=1e-6) and a.skew_v == pytest.approx(1.310489, abs=1e-6)
    assert rows["b"].skew_v == 0


def test_best_share_floors(spark):
    df = spark.range(9).withColumn("g", F.lit(1))
    assert sampling.best_share(df, "g", ["id"], 0.2).count() == 1


def test_warp_identity(spark):
    own = np.arange(12).reshape(3, 4)
    out = raster_of = dense(geometry.warp(pixels(spark, own), ["v"], [1, 0, 0, 0, 1, 0, 0, 0, 1], 3, 4))
    assert (raster_of == out).all() and (out.astype(float) == own).all()


def test_consensus_finds_a_shift():
    rng = np.random.default_rng(2)
    source = rng.random((40, 2)) * 100
    target = source + (5, -3)
    target[:8] += 60
    h = registration.consensus(source, target)
    assert np.allclose(h, [[1, 0, 5], [0, 1, -3], [0, 0, 1]], atol=1e-6)
    assert registration.consensus(source[:3], target[:3]) is None


def test_registration_of_a_moved_map(spark):
    image = np.random.default_rng(9).integers(0, 255, (60, 60))
    fixed, moving = pixels(spark, image[4:54, 3:53]), pixels(spark, image[:50, :50])
    found = registration.matches(registration.keypoints(fixed, "v", 80), registration.keypoints(moving, "v", 80), 0.2)
    matrix = np.array(registration.homographies(found).first().matrix).reshape(3, 3)
    assert np.allclose(matrix, [[1, 0, -3], [0, 1, -4], [0, 0, 1]], atol=0.2)


def test_png_and_image_scan(spark, tmp_path):
    bands = np.random.default_rng(3).integers(0, 255, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one-building.png").write_bytes(images.png(bands))
    (tmp_path / "a" / "grey.png").write_bytes(images.png(bands[:, :, 0]))
    scanned = images.read_images(spark, str(tmp_path / "a"), "*.png")
    rows = {(r.y, r.x): (r.r, r.g, r.b) for r in images.pixels(scanned.where("name like 'one%'")).collect()}
    assert all(rows[y, x] == tuple(int(v) for v in bands[y, x]) for y in range(5) for x in range(7))
    assert images.pixels(scanned.where("name = 'grey'")).where("r <> g or g <> b").count() == 0
    assert images.masks(scanned).select("map_id", "class").distinct().collect()[0][:] == ("one", "building")


def test_mask_files_round_trip(spark, tmp_path):
    own = mask(6)
    file = images.as_png(pixels(spark, own.astype(int) * 255), ["map_id"], "v").first().png
    (tmp_path / "m.png").write_bytes(file)
    back = images.pixels(images.read_images(spark, str(tmp_path)))
    assert {(r.y, r.x) for r in back.where("r > 0").collect()} == set(zip(*map(lambda v: v.tolist(), np.nonzero(own)), strict=True))
    assert file[:4] == b"\x89PNG" and zlib.crc32(b"") == 0


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, ring((0, 0), (2, 0), (0, 2))), (1, 4, ring((1, 1), (3, 1), (1, 3))), (2, 1, ring((0, 0), (1, 0), (0, 1)))], "map_id int, label long, ring array<struct<x:double,y:double>>")
    properties = F.struct(F.lit("#ff7fcc").alias("fill"), F.lit("building").alias("type"), F.struct(F.lit(0.1).alias("background"), F.lit(0.7).alias("building"), F.lit(0.2).alias("water")).alias("probability"))
    whole = geojson.collections(df.select("map_id", "label", geojson.feature(F.col("ring"), properties).alias("feature")), "map_id")
    geojson.write(whole, "map_id", str(tmp_path / "out"))
    back = geojson.read(spark, str(tmp_path / "out"), "map_id").where("map_id = 1").collect()
    assert len(back) == 2 and back[0].properties.probability.building == 0.7
    assert back[0].geometry.coordinates[0][0] == back[0].geometry.coordinates[0][-1] == [1.0, 1.0]


def test_maps_that_arrive(spark, tmp_path):
    df = pixels(spark, mask(7))
    df.write.parquet(str(tmp_path / "in"))
    stream = maps.arriving(spark, str(tmp_path / "in"), "map_id int, y int, x int, v boolean")
    maps.process(stream, lambda b: components.components(b.where("v"), tile=8), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("map_id", "y", "x", "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, components.components(df.where("v"), tile=8).collect()))


def test_vectorised_maps_cover_their_segments(spark):
    from terrasheet.plans import proxies, vectorise

    df = proxies.raster(spark, "/root/testdata/sf0.001").where("map_id < 2")
    settings = vectorise.Settings(least_pixels=6, tolerance=0.0, reach=3, enlarge=1.0, tile=16, dark_most=60, sensitivity=0.02)
    labelled = vectorise.segments(df, settings=settings)
    assert labelled.groupBy("map_id", "y", "x").count().where("count > 1").count() == 0
    assert labelled.groupBy("map_id", "label").count().where("count < 6").count() == 0
    own = vectorise.vectorise(df, settings)
    assert own.select("class").distinct().where("class not in ('contours', 'background', 'building', 'water')").count() == 0
    grown = borders.contours(labelled)
    best = evaluation.matched(geometry.rasterise(grown), labelled).groupBy("map_id", "truth").agg(F.max("iou").alias("iou"))
    assert best.count() == labelled.select("map_id", "label").distinct().count() and best.agg(F.avg("iou")).first()[0] > 0.8


def test_a_prediction_meets_the_segment_under_its_point(spark):
    """A box over two true segments counts for the one in its middle only; one over nothing has no row; pixels are eroded."""
    from terrasheet.plans import vectorise

    boxes = [(0, 1, ring((0, 0), (9, 0), (9, 5), (0, 5)), []), (0, 2, ring((30, 0), (34, 0), (34, 4), (30, 4)), [])]
    polygons = spark.createDataFrame(boxes, "map_id int, label long, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>")
    truth = spark.createDataFrame([(0, y, x, 7 if x < 7 else 8) for y in range(6) for x in range(10)], "map_id int, y int, x int, label long")
    inside = {(r.y, r.x) for r in geometry.rasterise(polygons.where("label = 1"), holes="holes").collect()}
    eroded = {(y, x) for y, x in inside if {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} <= inside}
    common = sum(x < 7 for _, x in eroded)
    row = vectorise.evaluated(polygons, truth).collect()
    assert [(r.pred, r.truth, r.pred_area, r.truth_area) for r in row] == [(1, 7, len(eroded), 42)]
    assert row[0].iou == common / (len(eroded) + 42 - common)
    assert vectorise.evaluated(polygons, truth, (50, 90)).count() == 0


def test_segments_with_holes(spark):
    """A thick frame with two holes, one of a single pixel: areas, GeoJSON and pixels keep them."""
    own = np.ones((12, 14), bool)
    own[3:6, 3:8] = own[8, 10] = False
    df = pixels(spark, own).where("v").select("map_id", "y", "x", F.lit(5).cast("long").alias("label"))
    row = borders.contours(df).first()
    assert len(row.holes) == 2 and [tuple(p) for p in row.ring] == [(0, 0), (13, 0), (13, 11), (0, 11)]
    area = borders.contours(df).select(rings.area(F.col("ring"), F.col("holes")).alias("a")).first().a
    squares = [int(own[y : y + 2, x : x + 2].sum()) for y in range(11) for x in range(13)]
    assert area == squares.count(4) + squares.count(3) / 2
    filled = {(r.y, r.x) for r in geometry.rasterise(borders.contours(df), holes="holes").collect()}
    assert not filled & {(4, 5), (8, 10)} and (1, 1) in filled and (4, 9) in filled
    points = spark.createDataFrame([(1, 4.5, 4.5), (2, 1.5, 1.5), (3, 10.2, 8.1), (4, 20.0, 4.0)], "id int, x double, y double")
    assert {r.id for r in geometry.holding(points, borders.contours(df).withColumnRenamed("label", "poly"), 3.0, holes="holes").collect()} == {2}


def test_copies_of_a_place_are_members_not_pairs(spark):
    """The links of places and their members give every pair of the full join; their number grows with the copies only."""
    rows = [(k, k % 3 + 5 * (k < 2), float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (3, 0), (0, 4), (50, 50)] * 20)]
    df = spark.createDataFrame(rows, "id long, poly int, x double, y double")
    links = [tuple(r) for r in geometry.radius_links(df, 5.0).collect()]
    assert len(links) == 3 + 76
    place = {b: a for a, b, d in links if d == 0} | {k: k for k in range(4)}
    near = {(a, b): d for a, b, d in links if d} | {(k, k): 0.0 for k in range(4)}
    full = {tuple(r) for r in geometry.radius_pairs(df, 5.0).collect()}
    pairs = [(a, b, near.get(tuple(sorted((place[a], place[b]))))) for a in range(80) for b in range(a + 1, 80)]
    assert full == {p for p in pairs if p[2] is not None}
    mids = geometry.midpoint_links(df, 5.0).collect()
    at = {r.b: (r.a, r.poly) for r in mids if r.poly is not None}
    middle = {(r.a, r.b): (r.x, r.y) for r in mids if r.poly is None} | {(r.a, r.a): (r.x, r.y) for r in mids if r.a == r.b}
    got = {(a, b, *middle.get(tuple(sorted((at[a][0], at[b][0]))), ())) for a in range(80) for b in range(a + 1, 80) if at[a][1] != at[b][1]}
    assert {g for g in got if len(g) == 4} == {tuple(r) for r in geometry.midpoint_snaps(df, 5.0).collect()}


def test_pairs_of_a_small_table_are_dealt_to_all_partitions(spark):
    df = spark.createDataFrame([(k, float(k % 90), float(k % 70)) for k in range(900)], "id long, x double, y double")
    assert geometry.radius_pairs(df, 5.0).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_points_at_one_place_meet_edges_once(spark):
    """Rows between the edges and the counts don't grow with copies of a point."""
    square = spark.createDataFrame([(1, ring((0, 0), (10, 0), (10, 10), (0, 10)))], "poly int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(k, 5.0, 5.0) for k in range(500)] + [(500, 15.0, 5.0)], "id long, x double, y double")
    found = geometry.holding(points, square, 4.0)
    assert {r.id for r in found.collect()} == set(range(500)) and found.count() == 500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [x" in plan  # places, before they meet edges


def test_the_largest_part_is_traced(spark):
    own = np.zeros((9, 9), bool)
    own[0, 0] = own[4:8, 4:8] = True
    df = pixels(spark, own).where("v").select("map_id", "y", "x", F.lit(1).alias("label"))
    assert [tuple(p) for p in borders.contours(df).first().ring] == [(4, 4), (7, 4), (7, 7), (4, 7)]


def test_closing_before_tracing():
    own = np.ones((5, 7), bool)
    own[2, 3] = False
    assert kernels.cross_closed(own).all()
    assert (kernels.cross_closed(np.eye(4, dtype=bool)) >= np.eye(4, dtype=bool)).all()


def test_labels_that_are_not_neighbours_keep_their_pixels(spark):
    cells = [(0, 0, 0, 1), (0, 0, 3, 2), (0, 0, 6, 3)]
    df = spark.createDataFrame(cells, "map_id int, y int, x int, label long")
    outline = spark.createDataFrame([(0, 0, x) for x in range(9)], "map_id int, y int, x int")
    both = spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "map_id int, label long, neighbour long")
    got = {}
    for r in kernels.without_neighbours(df, both, 2, outline).collect():
        got.setdefault(r.label, set()).add(r.x)
    # 1 is treated last and keeps 1 and 2; 2 and 3 aren't neighbours, so both have 4 and 5
    assert got == {1: {0, 1, 2}, 2: {3, 4, 5}, 3: {4, 5, 6, 7, 8}}
    one = spark.createDataFrame([(0, 1, 2)], "map_id int, label long, neighbour long")
    got = {(r.label, r.x) for r in kernels.without_neighbours(df, one, 2, outline).collect()}
    assert (1, 1) not in got and (1, 2) not in got and {(2, 1), (2, 2)} <= got


def test_forest_in_the_flow(spark):
    rows = {r.label: r for r in geometry_queries.QUERIES["vectorised_classified"](spark, "/root/testdata/sf0.001").where("map_id = 0").collect()}
    contour = json.loads(rows.pop(-1).gis)
    assert contour["properties"] == {"fill": "#FFFFFF", "type": "contours"} and len(rows) > 3
    for r in rows.values():
        told = json.loads(r.gis)["properties"]
        assert told["type"] == r["class"] and abs(sum(told["probability"].values()) - 1) < 1e-6
        assert max(told["probability"], key=told["probability"].get) == r["class"]


@pytest.mark.parametrize("diagonal", [False, True])
def test_runs_give_the_components_of_a_walk(diagonal):
    rng = np.random.default_rng(4)
    for density in (0.3, 0.5, 0.7):
        own = rng.random((30, 40)) < density
        ys, xs = np.nonzero(own)
        got = components.label_tile(ys + 5, xs + 9, diagonal)
        seen = {}
        at = {(a, b): k for k, (a, b) in enumerate(zip(ys.tolist(), xs.tolist(), strict=True))}
        for p, k in at.items():
            if k in seen:
                continue
            todo, seen[k] = [p], k
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        j = at.get((y + dy, x + dx))
                        if j is not None and j not in seen and (diagonal or not dy or not dx):
                            seen[j] = k
                            todo.append((y + dy, x + dx))
        assert got.tolist() == [seen[k] for k in range(len(ys))]


def test_edges_in_blocks_cross_as_all_pairs_do():
    rng = np.random.default_rng(5)
    for n in (4, 9, 40, 700):
        angle = np.sort(rng.random(n) * 2 * np.pi)
        star = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(1, 5, (n, 1))
        assert not geometry.crosses_itself(star, 16)
        knot = star.copy()
        knot[[0, n // 2]] = knot[[n // 2, 0]]
        assert geometry.crosses_itself(knot, 16) == geometry.crosses_itself(knot, 10_000)


def test_rings_through_arrow_keep_nulls_and_empty_ones(spark):
    df = spark.createDataFrame([(1, ring((0, 0), (4, 0), (2, 1), (4, 3), (0, 3))), (2, None), (3, []), (4, ring((1, 1)))], "id int, a array<struct<x: double, y: double>>")
    got = {r.id: r.h for r in df.select("id", geometry.convex_hull(F.col("a")).alias("h")).collect()}
    assert [tuple(p) for p in got[1]] == [(0, 0), (4, 0), (4, 3), (0, 3)] and got[2] is None and got[3] == [] and len(got[4]) == 1


def test_repaired_rings(spark):
    box = ring((0, 0), (4, 0), (4, 3), (0, 3))
    bow = ring((0, 0), (20, 10), (20, 0), (0, 12))
    df = spark.createDataFrame([(1, box), (2, bow), (3, ring((1, 1), (5, 4))), (4, []), (5, None)], "id int, a array<struct<x: double, y: double>>")
    got = {r.id: r.v for r in overlay.valid_polygons(df.withColumnRenamed("a", "ring"), ["id"]).withColumnRenamed("ring", "v").collect()}
    assert [tuple(p) for p in got[1]] == [(0, 0), (4, 0), (4, 3), (0, 3)]
    fixed = np.array([tuple(p) for p in got[2]])
    assert geometry.crosses_itself(np.array([(p["x"], p["y"]) for p in bow])) and not geometry.crosses_itself(fixed) and fixed[:, 0].max() <= 12
    assert [tuple(p) for p in got[3]] == [(1, 1), (5, 1), (5, 4), (1, 4)] and got[4] == [] and got[5] is None


def test_links_are_joined_alike_in_one_task_and_by_stars(spark):
    from terrasheet.operators import graph

    rng = random.Random(6)
    rows = [(m, rng.randrange(60), rng.randrange(60)) for m in (1, 2) for _ in range(40)] + [(3, k, k + 1) for k in range(50)]
    links = spark.createDataFrame(rows, "map_id int, a long, b long")
    alone, stars = (sorted(map(tuple, graph.connected(links, n).collect())) for n in (1000, 0))
    assert alone == stars and len(alone) > 80
    assert graph.connected(links.limit(0)).count() == 0


def test_nearest_by_bits_in_rounds(spark):
    """Near ones, copies and far ones (found in the last round only), in two words."""
    rng = random.Random(6)
    word = lambda: rng.getrandbits(64)
    bits = [(word(), word()) for _ in range(12)]
    bits += [(a ^ 1 << rng.randrange(64), b ^ 5 << 20) for a, b in bits[:6]] + [bits[0], bits[0], (~bits[3][0] & (1 << 64) - 1, ~bits[3][1] & (1 << 64) - 1)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(i, [signed(a), signed(b)]) for i, (a, b) in enumerate(bits)]
    df = spark.createDataFrame([*rows, (100, None)], "id long, bits array<long>")
    far = lambda i, k: (bits[i][0] ^ bits[k][0]).bit_count() + (bits[i][1] ^ bits[k][1]).bit_count()
    for itself in (False, True):
        got = {r.query: (r.distance, r.match) for r in learning.nearest_by_bits(df, df, itself=itself).collect()}
        assert got == {i: min((far(i, k), k) for k in range(len(bits)) if itself or k != i) for i in range(len(bits))}
    alone = learning.nearest_by_bits(df.where("id = 3"), df.where("id in (3, 20)"), itself=False).first()  # its complement
    assert alone is None or (alone.distance, alone.match) == (128, 20)
    assert learning.nearest_by_bits(df, df.limit(0)).count() == 0


def test_queries_take_all_polygons_and_points(spark):
    sf = "/root/testdata/sf0.001"
    own = geometry_queries.QUERIES
    kept = components.without_small(components.components(geometry_queries.px(spark, sf).where("m"), True, tile=16), 4)[0]
    assert own["polygon_snapping"](spark, sf).select("map_id", "poly").distinct().count() == kept.select("map_id", "label").distinct().count()
    df = geometry_queries.px(spark, sf).select("map_id", "y", "x", "m", "gt").toPandas()
    both = df[df["m"] & df["gt"]]
    want = {(r.map_id, r.y * 32 + r.x, r.y // 5 * 100 + (r.x + 1) // 5 + 1) for r in both.itertuples()}
    assert {tuple(r) for r in own["matched_all_points"](spark, sf).select("map_id", "pred", "truth").where("truth is not null").collect()} == want


def test_registered_maps(spark):
    """An image of the same shapes, moved by (3, 5), lies over the fixed one again."""
    own = np.full((70, 80), 255)
    own[10:40, 12:30] = own[30:55, 25:62] = own[14:22, 48:66] = 60
    moved = np.full((70, 80), 255)
    moved[3:, 5:] = own[:-3, :-5]
    frames = [pixels(spark, a).select("map_id", "y", "x", *[F.col("v").alias(c) for c in "rgb"]) for a in (own, moved)]
    rows = registration.registered(*frames, 70, 80, border=20, first=0, less=0, share=0.6).select("y", "x", "r", "moved_r").collect()
    assert len(rows) > 1000
    same = sum(abs(r.r - r.moved_r) < 40 for r in rows)
    assert same > 0.9 * len(rows)


def test_feature_store_is_read_back(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        return spark.range(3).toDF("obj")

    for _ in range(2):
        assert features.stored(spark, f"{tmp_path}/store", compute).count() == 3
    assert made == [1]


def test_a_turned_and_smaller_image_is_registered(spark):
    """Boxes of several greys, turned by 30 degrees and made smaller by a fifth around the middle."""
    rng = np.random.default_rng(1)
    image = np.zeros((200, 220))
    for _ in range(50):
        y, x = rng.integers(15, 165, 2)
        h, w = rng.integers(8, 40, 2)
        image[y : y + h, x : x + w] = rng.integers(0, 256)
    cos, sin = math.cos(math.radians(30)) / 0.8, math.sin(math.radians(30)) / 0.8
    back = [cos, sin, 110 - 110 * cos - 100 * sin, -sin, cos, 100 + 110 * sin - 100 * cos, 0.0, 0.0, 1.0]
    fixed = pixels(spark, image)
    moved = geometry.warp(fixed, ["v"], back, 200, 220)
    found = registration.homographies(registration.matches(registration.keypoints(fixed, "v"), registration.keypoints(moved, "v"))).first().matrix
    for x, y in ((60, 50), (160, 50), (60, 150), (160, 150)):
        got = np.array(found).reshape(3, 3) @ [x, y, 1]
        want = np.array(back).reshape(3, 3) @ [x, y, 1]
        assert np.hypot(*(got[:2] / got[2] - want[:2])) < 2


def test_keypoints_have_directions():
    """The brightest side of a disc gives its direction; a flat image has no corners."""
    image = np.zeros((61, 61))
    image[30:, :] = 100
    assert registration.directions(image, np.array([[30, 30]]))[0] == pytest.approx(math.pi / 2, abs=0.05)
    assert registration.directions(image.T, np.array([[30, 30]]))[0] == pytest.approx(0, abs=0.05)
    assert len(registration.corners(np.full((40, 40), 7.0), 9)) == 0 and len(registration.described(np.zeros((9, 9)), 9)[0]) == 0


def test_tightly_packed_tables_are_not_broadcast(spark):
    """Half a million pixels are a file of a few hundred kilobytes, but far more in a join's memory."""
    from terrasheet.operators.graph import settled

    pixels = settled(spark.range(500_000).selectExpr("int(id div 1024) as map_id", "int(id div 32 % 32) as y", "int(id % 32) as x", "id div 4 as label"))
    other = spark.range(100_000_000).selectExpr("int(id % 5000) as map_id")
    plan = lambda df: other.join(df, "map_id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(pixels) and "Broadcast" in plan(settled(pixels.limit(10)))
