"""Queries on rasters, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import CLASSES, FOREGROUND_MOST, PALETTE, PALETTE_CLASS
from ..functions import color, rings
from ..operators import components as cc
from ..operators import borders, geometry, kernels, raster, tiles
from ..operators.graph import shared_folder
from ..sources import images
from .proxies import on_px, labelled_sql
from .proxies import raster as px



def bands():
    return F.col("r"), F.col("g"), F.col("b")


def at(*columns):
    return ["map_id", "y", "x", *columns]


def gray_foreground(spark, sf):
    df = px(spark, sf).withColumn("gray", color.gray(*bands(), color.SWAPPED_LUMA))
    return df.select(*at("gray"), color.gray(*bands()).alias("luma"), F.round(color.gray_mean(*bands()), 6).alias("mean"), (F.col("gray") <= FOREGROUND_MOST).alias("foreground"), (F.col("gray") <= 128).alias("dark"))


def weights(a, b, c):
    return f"CAST(floor(r * CAST({a} AS DOUBLE) + g * CAST({b} AS DOUBLE) + b * CAST({c} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT)"


GRAY = weights(0.114, 0.587, 0.299)


def minmax_normalise(spark, sf):
    return raster.min_max(px(spark, sf), ["r", "g", "b"]).select(*at(), *[F.round(c, 6).alias(c) for c in "rgb"])


def rgb_to_hsv(spark, sf):
    h, s, v = color.hsv(*bands())
    return px(spark, sf).select(*at(), *[F.round(c, 6).alias(n) for c, n in ((h, "h"), (s, "s"), (v, "v"))]).where("v > 0.3")


HSV = """hsv AS (SELECT map_id, y, x, m, CASE WHEN t = l THEN 0.0 WHEN t = r THEN (g - b) / (t - l) WHEN t = g THEN 2 + (b - r) / (t - l) ELSE 4 + (r - g) / (t - l) END / 6 AS h0, CASE WHEN t = 0 THEN 0.0 ELSE (t - l) / t END AS s, t AS v
  FROM (SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS l FROM (SELECT map_id, y, x, m, CAST(r AS DOUBLE) / 255 AS r, CAST(g AS DOUBLE) / 255 AS g, CAST(b AS DOUBLE) / 255 AS b FROM px)))"""


def equalise_hist(spark, sf):
    return raster.equalise(px(spark, sf), ["r", "g", "b"], F.col("m")).select(*at(), *[F.round(c, 6).alias(c) for c in "rgb"])


def palette_assign(spark, sf):
    k = color.nearest(*bands(), PALETTE)
    return px(spark, sf).select(*at(), k.alias("colour")).select(*at("colour"), color.lookup(color.lookup(F.col("colour"), PALETTE_CLASS), CLASSES).alias("class"))


COLOURS = ", ".join(f"({i}, {r}, {g}, {b}, '{CLASSES[k]}')" for i, ((r, g, b), k) in enumerate(zip(PALETTE, PALETTE_CLASS, strict=True)))


def palette_hex(spark, sf):
    k = color.nearest(*bands(), PALETTE)
    return px(spark, sf).select(*at(), color.hex_color(*bands()).alias("hex"), *[(color.lookup(color.lookup(k, PALETTE_CLASS), CLASSES) == c).cast("int").alias(c) for c in CLASSES])


def median_blur5(spark, sf):
    return raster.median_blur(px(spark, sf).select(*at("r", "g", "b")), ["r", "g", "b"])


def stencil(function, *columns):
    return lambda spark, sf: function(px(spark, sf)).select(*at(*columns))


def around(fold, reach, where=""):
    """SQL of a fold over the square around each pixel."""
    return on_px(f"SELECT a.map_id, a.y, a.x, {fold} FROM px a JOIN px b ON a.map_id = b.map_id AND abs(a.y - b.y) <= {reach} AND abs(a.x - b.x) <= {reach} {where} GROUP BY a.map_id, a.y, a.x")


def folded(name, source, column, fold, reach):
    return f"{name} AS MATERIALIZED (SELECT a.map_id, a.y, a.x, {fold} AS v FROM {source} a JOIN {source} b ON a.map_id = b.map_id AND abs(a.y - b.y) <= {reach} AND abs(a.x - b.x) <= {reach} GROUP BY 1, 2, 3)".replace("$", f"b.{column}")


CROSS = "a.map_id = b.map_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1"


def gaussian_blur(spark, sf):
    return raster.gaussian_blur(px(spark, sf).select(*at("r")), "r", 50.0, 100).select(*at(), F.round("r", 6).alias("r"))


def local_maxima(spark, sf):
    return raster.local_maxima(px(spark, sf), "r", F.col("m")).select(*at("peak"))


def edt_capped(spark, sf):
    return raster.distance_transform(px(spark, sf), F.col("m") & (F.col("r") < 40), 50).select(*at(), F.round(F.col("distance") / 50, 6).alias("d"))


def components(diagonal):
    return lambda spark, sf: cc.components(px(spark, sf).where("m"), diagonal, tile=16)


def remove_small(spark, sf):
    kept, small = cc.without_small(cc.components(px(spark, sf).where("m"), False, tile=16), 5)
    return kept.withColumn("small", F.lit(False)).unionByName(small.withColumn("small", F.lit(True))).select(*at("label", "small"))


def fill_holes(spark, sf):
    return cc.fill_holes(px(spark, sf).select(*at("m")), "m", tile=16).select(*at("m"))


def label_bbox_crop(spark, sf):
    return raster.crop(px(spark, sf).select(*at("r", "m")), F.col("m") & F.col("y").between(5, 20) & F.col("x").between(7, 25)).select(*at("r", "y0", "x0"))


def crop_paste(spark, sf):
    df = px(spark, sf).select(*at("r", "m"))
    part = raster.crop(df, F.col("y").between(5, 20) & F.col("x").between(7, 25)).withColumn("r", F.col("r") + 1000)
    return raster.paste(df, part, "r").select(*at("r"))


def padding(spark, sf):
    return raster.pad(px(spark, sf).select(*at("r", "g")), ["r", "g"], 3)


def padding_removed(spark, sf):
    return raster.unpad(raster.pad(px(spark, sf).select(*at("r")), ["r"], 3), 3)


def downsample_trim(spark, sf):
    return raster.trim(raster.downsample(px(spark, sf).select(*at("r"))), 2, 5)


def row_col_compaction(spark, sf):
    return raster.compact(px(spark, sf).select(*at("r", "g")), F.col("g") < 6)


def sliding_tiles(spark, sf):
    return raster.sliding_tiles(px(spark, sf).select(*at("r")), 12, 3).groupBy("map_id", "ty", "tx").agg(F.count("*").alias("n"), F.sum("r").alias("total"), F.sum(F.when(F.col("inner"), F.col("r"))).alias("inner_total"))


def patch_corners(df):
    """Four patches of each map."""
    four = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    return df.select("map_id").distinct().select("map_id", four).select("map_id", (F.col("map_id").cast("long") * 4 + F.col("k")).alias("patch")).select("map_id", "patch", (F.col("patch") * 5 % 24).cast("int").alias("y"), (F.col("patch") * 7 % 24).cast("int").alias("x"))


def patch_pixels(spark, sf):
    corners = patch_corners(px(spark, sf))
    return raster.patches(px(spark, sf).select(*at("r")), corners, 8).select("map_id", "patch", "py", "px", "r")


def bbox_neighbors(spark, sf):
    kept, _ = cc.without_small(cc.components(px(spark, sf).where("m"), True, tile=16), 4)
    return geometry.box_neighbours(kept, 4, cell=8)


def difference_enlarged(spark, sf):
    df = px(spark, sf)
    labels = cc.without_small(cc.components(df.where("m"), True, tile=16), 4)[0]
    return kernels.without_neighbours(labels, geometry.box_neighbours(labels, 4, cell=8), 2, df.where("gt or m"))


def watershed(spark, sf):
    df = raster.distance_transform(px(spark, sf), ~F.col("m"), 50).withColumn("height", -F.col("distance"))
    peaks = raster.local_maxima(df, "distance", F.col("m")).withColumn("label", F.when(F.col("peak"), F.col("y") * 1000 + F.col("x") + 1).otherwise(0))
    return tiles.watershed(peaks, "height", "label", "m", 16)


def contour_areas(spark, sf):
    """Areas and holes of traced segments: the rings' area is that of the whole and half squares between pixel centres."""
    own = borders.contours(cc.components(px(spark, sf).where("m"), True, tile=16), tile=16)
    return own.select("map_id", "label", F.size("holes").cast("long").alias("n_holes"), rings.area(F.col("ring"), F.col("holes")).alias("area"))


def image_scan(spark, sf):
    """The maps as PNG files, and the pixels that Spark's image source finds in them."""
    at = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    images.write_png(images.as_png(px(spark, sf), ["map_id"], ["r", "g", "b"]).withColumn("name", F.col("map_id").cast("string")), at)
    return images.pixels(images.read_images(spark, at, "*.png")).withColumn("map_id", F.col("map_id").cast("int"))


def mask_scan(spark, sf):
    """Class masks as files <map>-<class>.png, and the pixels that are set in them; maps lack some classes."""
    at, df = f"{shared_folder(spark)}/masks-{uuid.uuid4().hex}", px(spark, sf)
    kinds = F.explode(F.filter(F.array(F.when(F.col("m"), "building"), F.when(F.col("gt") & (F.col("map_id") != 1), "water")), lambda c: c.isNotNull()))
    named = df.select("map_id", kinds.alias("class"), "y", "x", F.lit(255).alias("v"))
    images.write_png(images.as_png(named, ["map_id", "class"], "v").withColumn("name", F.concat_ws("-", "map_id", "class")), at)
    return images.masks(images.read_images(spark, at, "*.png")).withColumn("map_id", F.col("map_id").cast("int"))


def patch_pairs(spark, sf):
    """Pairs of training patches, written by split and read back."""
    at = f"{shared_folder(spark)}/patches-{uuid.uuid4().hex}"
    df = raster.distance_transform(px(spark, sf), F.col("m") & (F.col("r") < 40), 50).withColumn("d", F.col("distance") / 50)
    corners = patch_corners(px(spark, sf)).withColumn("split", F.when(F.col("patch") % 4 == 0, "test").otherwise("train"))
    raster.patch_pairs(df, "d", corners, 8).write.partitionBy("split").parquet(at)
    return spark.read.parquet(at)


def skeletonise(spark, sf):
    return tiles.skeleton(px(spark, sf).where("m"), 16)


def contour_trace(spark, sf):
    """The corners of each segment's border (part 0) and of its holes (from 1 on), in order."""
    own = borders.contours(cc.components(px(spark, sf).where("m"), True, tile=16), tile=16)
    rows = own.select("map_id", "label", F.posexplode(F.concat(F.array("ring"), "holes")).alias("part", "r")).select("map_id", "label", "part", F.posexplode("r").alias("k", "p"))
    return rows.select("map_id", "label", "part", "k", F.col("p.y").cast("int").alias("y"), F.col("p.x").cast("int").alias("x"))


def canny_edges(spark, sf):
    return tiles.canny(px(spark, sf), "r", 150.0, 450.0, 16)


def mask_png(spark, sf):
    return images.as_png(px(spark, sf).withColumn("v", F.when(F.col("m"), 255).otherwise(0)), ["map_id"], "v")


def augmented(spark, sf):
    return raster.augment(px(spark, sf).select(*at("r")), 4, 32, 32).select(*at("copy", "r"))


QUERIES = {
    "augmented": augmented,
    "gray_foreground_mask": gray_foreground,
    "minmax_normalise": minmax_normalise,
    "rgb_to_hsv": rgb_to_hsv,
    "equalise_hist": equalise_hist,
    "palette_assign": palette_assign,
    "palette_hex": palette_hex,
    "median_blur5": median_blur5,
    "erode5": stencil(lambda df: raster.erode(df, "r", 5), "r"),
    "dilate7": stencil(lambda df: raster.dilate(df, "r", 7), "r"),
    "closing7": stencil(lambda df: raster.closing(df, "r", 7), "r"),
    "cross_close": stencil(lambda df: raster.cross_close(df, "m"), "m"),
    "cross_erode": stencil(lambda df: raster.cross_erode(df, "m"), "m"),
    "box_blur3": stencil(lambda df: raster.box_blur(df, "r").withColumn("r", F.round("r", 6)), "r"),
    "gaussian_blur": gaussian_blur,
    "local_maxima": local_maxima,
    "edt_capped": edt_capped,
    "components4": components(False),
    "components8": components(True),
    "remove_small": remove_small,
    "fill_holes": fill_holes,
    "label_bbox_crop": label_bbox_crop,
    "crop_paste": crop_paste,
    "padding": padding,
    "padding_removed": padding_removed,
    "downsample_trim": downsample_trim,
    "row_col_compaction": row_col_compaction,
    "sliding_tiles": sliding_tiles,
    "patch_pixels": patch_pixels,
    "bbox_neighbors": bbox_neighbors,
    "difference_enlarged": difference_enlarged,
    "watershed": watershed,
    "skeletonise": skeletonise,
    "contour_trace": contour_trace,
    "contour_areas": contour_areas,
    "image_scan": image_scan,
    "mask_scan": mask_scan,
    "patch_pairs": patch_pairs,
    "canny_edges": canny_edges,
    "mask_png": mask_png,
}

LARGE8 = labelled_sql("m", True) + ", big AS MATERIALIZED (SELECT * FROM labelled WHERE (map_id, label) IN (SELECT (map_id, label) FROM (SELECT map_id, label FROM labelled GROUP BY 1, 2 HAVING count(*) >= 4)))"
SCALE = "max(greatest(r, g, b)) OVER (PARTITION BY map_id)", "min(least(r, g, b)) OVER (PARTITION BY map_id)"



def skeleton_sql() -> str:
    """Thinning of maps as lists of 34 x 34 pixels with a frame, both sides in a step."""
    at = [1, 35, 34, 33, -1, -35, -34, -33]  # clockwise from the right
    n = lambda k: f"l[i + {at[k]}]"
    count = " + ".join(n(k) for k in range(8))
    turns = " + ".join(f"(1 - {n(k)}) * {n((k + 1) % 8)}" for k in range(8))
    right, down, left, up = n(0), n(2), n(4), n(6)
    sides = [f"{up} * {right} * {down} = 0 AND {right} * {down} * {left} = 0", f"{up} * {right} * {left} = 0 AND {up} * {down} * {left} = 0"]
    peel = lambda s: f"list_transform(l, lambda v, i: CASE WHEN v = 0 THEN 0 WHEN {count} BETWEEN 2 AND 6 AND {turns} = 1 AND {sides[s]} THEN 0 ELSE 1 END)"
    return f"""cell AS (SELECT map_id, range AS i, range // 34 - 1 AS y, range % 34 - 1 AS x FROM (SELECT DISTINCT map_id FROM px), range(34 * 34)),
thin AS (SELECT map_id, 0 AS k, list(CAST(coalesce(m, false) AS INT) ORDER BY i) AS l, CAST(NULL AS INT[]) AS before FROM cell LEFT JOIN px USING (map_id, y, x) GROUP BY 1
  UNION ALL SELECT map_id, k + 1, {peel(1)}, o FROM (SELECT map_id, k, {peel(0)} AS l, l AS o FROM thin WHERE l IS DISTINCT FROM before))
SELECT map_id, CAST(i // 34 - 1 AS INT) AS y, CAST(i % 34 - 1 AS INT) AS x FROM (SELECT map_id, unnest(l) AS v, unnest(range(34 * 34)) AS i FROM thin WHERE l = before) WHERE v = 1"""


HEX = "CAST('0x' || substr(md5(CAST(map_id AS VARCHAR) || '-' || CAST(copy AS VARCHAR)), {0}, 4) AS INT)"

ORACLES = {
    "augmented": on_px(f"c AS (SELECT map_id, y, x, r, CAST(k.range AS INT) AS copy FROM px, range(4) k), d AS (SELECT *, {HEX.format(1)} % 2 AS fy, {HEX.format(5)} % 25 - 12 AS sy, {HEX.format(9)} % 2 AS fx, {HEX.format(13)} % 25 - 12 AS sx FROM c) SELECT map_id, CAST((CASE WHEN fy = 1 THEN 31 - y ELSE y END + sy + 64) % 32 AS INT) AS y, CAST((CASE WHEN fx = 1 THEN 31 - x ELSE x END + sx + 64) % 32 AS INT) AS x, copy, r FROM d"),
    "gray_foreground_mask": on_px(f"SELECT map_id, y, x, {GRAY} AS gray, {weights(0.299, 0.587, 0.114)} AS luma, round((r + g + b) / CAST(3 AS DOUBLE), 6) AS mean, {GRAY} <= 253 AS foreground, {GRAY} <= 128 AS dark FROM px"),
    "minmax_normalise": on_px(f"s AS (SELECT *, {SCALE[0]} AS t, {SCALE[1]} AS l FROM px) SELECT map_id, y, x, {', '.join(f'round(CAST({c} - l AS DOUBLE) / (t - l), 6) AS {c}' for c in 'rgb')} FROM s"),
    "rgb_to_hsv": on_px(HSV + " SELECT map_id, y, x, round(CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END, 6) AS h, round(s, 6) AS s, round(v, 6) AS v FROM hsv WHERE round(v, 6) > 0.3"),
    "equalise_hist": on_px("v AS (SELECT map_id, unnest([r, g, b]) AS v FROM px WHERE m), c AS (SELECT map_id, v, sum(count(*)) OVER (PARTITION BY map_id ORDER BY v) / CAST(sum(count(*)) OVER (PARTITION BY map_id) AS DOUBLE) AS c FROM v GROUP BY 1, 2), f AS (SELECT map_id, min(c) AS f FROM c GROUP BY 1) SELECT px.map_id, y, x, " + ", ".join(f"round(coalesce((SELECT max(c) FROM c WHERE c.map_id = px.map_id AND c.v <= px.{b}), f), 6) AS {b}" for b in "rgb") + " FROM px JOIN f ON f.map_id = px.map_id"),
    "palette_assign": on_px(f"c(k, cr, cg, cb, name) AS (VALUES {COLOURS}) SELECT map_id, y, x, k AS colour, name AS class FROM (SELECT *, row_number() OVER (PARTITION BY map_id, y, x ORDER BY (r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb), k) AS n FROM px, c) WHERE n = 1"),
    "palette_hex": on_px(f"c(k, cr, cg, cb, name) AS (VALUES {COLOURS}) SELECT map_id, y, x, printf('#%02x%02x%02x', r, g, b) AS hex, " + ", ".join(f"CAST(name = '{c}' AS INT) AS {c}" for c in CLASSES) + " FROM (SELECT *, row_number() OVER (PARTITION BY map_id, y, x ORDER BY (r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb), k) AS n FROM px, c) WHERE n = 1"),
    "median_blur5": on_px("o AS (SELECT CAST(a.range AS INT) AS dy, CAST(b.range AS INT) AS dx FROM range(-2, 3) a, range(-2, 3) b) SELECT a.map_id, a.y, a.x, " + ", ".join(f"CAST(quantile_disc(s.{c}, 0.5) AS INT) AS {c}" for c in "rgb") + " FROM px a, o JOIN px s ON s.map_id = a.map_id AND s.y = least(31, greatest(0, a.y + dy)) AND s.x = least(31, greatest(0, a.x + dx)) GROUP BY 1, 2, 3"),
    "erode5": around("min(b.r) AS r", 2),
    "dilate7": around("max(b.r) AS r", 3),
    "closing7": on_px(folded("d", "px", "r", "max($)", 3) + "," + folded("e", "d", "v", "min($)", 3) + " SELECT map_id, y, x, v AS r FROM e"),
    "cross_close": on_px(f"d AS MATERIALIZED (SELECT a.map_id, a.y, a.x, bool_or(b.m) AS m FROM px a JOIN px b ON {CROSS} GROUP BY 1, 2, 3) SELECT a.map_id, a.y, a.x, count(*) FILTER (b.m) = 5 AS m FROM d a JOIN d b ON {CROSS} GROUP BY 1, 2, 3"),
    "cross_erode": on_px(f"SELECT a.map_id, a.y, a.x, count(*) FILTER (b.m) = 5 AS m FROM px a JOIN px b ON {CROSS} GROUP BY 1, 2, 3"),
    "box_blur3": around("round(avg(b.r), 6) AS r", 1),
    "gaussian_blur": on_px("w AS (SELECT *, exp(-CAST(d * d AS DOUBLE) / 5000) AS k FROM (SELECT range AS d FROM range(-100, 101))), h AS MATERIALIZED (SELECT a.map_id, a.y, a.x, sum(k * b.r) / sum(k) AS v FROM px a JOIN px b ON a.map_id = b.map_id AND a.y = b.y JOIN w ON b.x - a.x = d GROUP BY 1, 2, 3) SELECT a.map_id, a.y, a.x, round(sum(k * b.v) / sum(k), 6) AS r FROM h a JOIN h b ON a.map_id = b.map_id AND a.x = b.x JOIN w ON b.y - a.y = d GROUP BY 1, 2, 3"),
    "local_maxima": around("any_value(a.m) AND any_value(a.r) = max(b.r) AS peak", 1),
    "edt_capped": on_px("SELECT a.map_id, a.y, a.x, round(least(50.0, coalesce(sqrt(min((a.y - s.y) * (a.y - s.y) + (a.x - s.x) * (a.x - s.x))), 50.0)) / 50.0, 6) AS d FROM px a LEFT JOIN (SELECT * FROM px WHERE m AND r < 40) s ON a.map_id = s.map_id GROUP BY 1, 2, 3"),
    "components4": on_px(labelled_sql("m", False) + " SELECT * FROM labelled"),
    "components8": on_px(labelled_sql("m", True) + " SELECT * FROM labelled"),
    "remove_small": on_px(labelled_sql("m", False) + " SELECT map_id, y, x, label, count(*) OVER (PARTITION BY map_id, label) < 5 AS small FROM labelled"),
    "fill_holes": on_px("r AS (SELECT map_id, y, x FROM px WHERE NOT m AND (y IN (0, 31) OR x IN (0, 31)) UNION SELECT b.map_id, b.y, b.x FROM r a JOIN px b ON a.map_id = b.map_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND NOT b.m) SELECT map_id, y, x, (map_id, y, x) NOT IN (SELECT (map_id, y, x) FROM r) AS m FROM px"),
    "label_bbox_crop": on_px("k AS (SELECT map_id, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM px WHERE m AND y BETWEEN 5 AND 20 AND x BETWEEN 7 AND 25 GROUP BY 1) SELECT map_id, y - y0 AS y, x - x0 AS x, r, y0, x0 FROM px JOIN k USING (map_id) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1"),
    "crop_paste": on_px("SELECT map_id, y, x, CASE WHEN y BETWEEN 5 AND 20 AND x BETWEEN 7 AND 25 THEN r + 1000 ELSE r END AS r FROM px"),
    "padding": on_px("a AS (SELECT m.map_id, CAST(p.range AS INT) AS y, CAST(q.range AS INT) AS x FROM (SELECT DISTINCT map_id FROM px) m, range(38) p, range(38) q) SELECT a.map_id, a.y, a.x, coalesce(nullif(r, 0), 255) AS r, coalesce(nullif(g, 0), 255) AS g FROM a LEFT JOIN px ON a.map_id = px.map_id AND a.y = px.y + 3 AND a.x = px.x + 3"),
    "padding_removed": on_px("SELECT map_id, y, x, coalesce(nullif(r, 0), 255) AS r FROM px"),
    "downsample_trim": on_px("SELECT map_id, y // 2 - 2 AS y, x // 2 - 2 AS x, r FROM px WHERE y % 2 = 0 AND x % 2 = 0 AND y // 2 BETWEEN 2 AND 12 AND x // 2 BETWEEN 2 AND 12"),
    "row_col_compaction": on_px("a AS (SELECT map_id, y, row_number() OVER (PARTITION BY map_id ORDER BY y) - 1 AS n FROM (SELECT DISTINCT map_id, y FROM px WHERE g < 6)), c AS (SELECT map_id, x, row_number() OVER (PARTITION BY map_id ORDER BY x) - 1 AS n FROM (SELECT DISTINCT map_id, x FROM px WHERE g < 6)) SELECT map_id, CAST(a.n AS INT) AS y, CAST(c.n AS INT) AS x, r, g FROM px JOIN a USING (map_id, y) JOIN c USING (map_id, x)"),
    "sliding_tiles": on_px("SELECT map_id, CAST(ty.range AS INT) AS ty, CAST(tx.range AS INT) AS tx, count(*) AS n, CAST(sum(r) AS BIGINT) AS total, CAST(sum(r) FILTER (y - ty.range * 6 BETWEEN 3 AND 8 AND x - tx.range * 6 BETWEEN 3 AND 8) AS BIGINT) AS inner_total FROM px, range(4) ty, range(4) tx WHERE y - ty.range * 6 BETWEEN 0 AND 11 AND x - tx.range * 6 BETWEEN 0 AND 11 GROUP BY 1, 2, 3"),
    "patch_pixels": on_px("k AS (SELECT CAST(i // 4 AS INT) AS map_id, i AS patch, i * 5 % 24 AS cy, i * 7 % 24 AS cx FROM (SELECT unnest(range(4 * k)) AS i FROM maps)) SELECT map_id, patch, CAST(y - cy AS INT) AS py, CAST(x - cx AS INT) AS px, r FROM px JOIN k USING (map_id) WHERE y - cy BETWEEN 0 AND 7 AND x - cx BETWEEN 0 AND 7"),
    "bbox_neighbors": on_px(LARGE8 + ", box AS (SELECT map_id, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM big GROUP BY 1, 2) SELECT DISTINCT b.map_id, b.label, p.label AS neighbour FROM box b JOIN big p ON p.map_id = b.map_id AND p.label <> b.label AND p.y >= y0 AND p.y < y1 + 4 AND p.x >= x0 AND p.x < x1 + 4"),
    "image_scan": on_px("SELECT map_id, y, x, r, g, b FROM px"),
    "mask_scan": on_px("SELECT map_id, 'building' AS class, y, x FROM px WHERE m UNION ALL SELECT map_id, 'water', y, x FROM px WHERE gt AND map_id <> 1"),
    "patch_pairs": on_px("""e AS MATERIALIZED (SELECT a.map_id, a.y, a.x, any_value(a.r) AS r, any_value(a.g) AS g, any_value(a.b) AS b, least(50.0::DOUBLE, coalesce(sqrt(min((a.y - s.y) * (a.y - s.y) + (a.x - s.x) * (a.x - s.x))), 50.0::DOUBLE)) / 50.0::DOUBLE AS d FROM px a LEFT JOIN (SELECT * FROM px WHERE m AND r < 40) s ON a.map_id = s.map_id GROUP BY 1, 2, 3),
k AS (SELECT CAST(i // 4 AS INT) AS map_id, i AS patch, i * 5 % 24 AS cy, i * 7 % 24 AS cx, CASE WHEN i % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM (SELECT unnest(range(4 * k)) AS i FROM maps))
SELECT map_id, patch, split, CAST(y - cy AS INT) AS py, CAST(x - cx AS INT) AS px, r, g, b, CAST(floor(d * 255) AS INT) AS label FROM e JOIN k USING (map_id) WHERE y - cy BETWEEN 0 AND 7 AND x - cx BETWEEN 0 AND 7"""),
    # ridges of the gradient over the upper threshold, and those over the lower one that reach them
    "canny_edges": on_px("""w AS (SELECT a.range AS dy, b.range AS dx, b.range * (2 - abs(a.range)) AS kx, a.range * (2 - abs(b.range)) AS ky FROM range(-1, 2) a, range(-1, 2) b),
g AS MATERIALIZED (SELECT a.map_id, a.y, a.x, sum(b.r * kx) AS gx, sum(b.r * ky) AS gy FROM px a, w, px b WHERE b.map_id = a.map_id AND b.y = least(greatest(a.y + dy, 0), 31) AND b.x = least(greatest(a.x + dx, 0), 31) GROUP BY 1, 2, 3),
s AS MATERIALIZED (SELECT map_id, y, x, abs(gx) + abs(gy) AS size, CAST(round(atan2(gy, gx) / (pi() / 4)) + 8 AS INT) % 4 AS sector FROM g),
d(sector, dy, dx) AS (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)),
e AS MATERIALIZED (SELECT s.map_id, s.y, s.x, s.size FROM s JOIN d USING (sector) LEFT JOIN s f ON f.map_id = s.map_id AND f.y = s.y + d.dy AND f.x = s.x + d.dx LEFT JOIN s b ON b.map_id = s.map_id AND b.y = s.y - d.dy AND b.x = s.x - d.dx WHERE s.size > 150 AND s.size > coalesce(f.size, 0) AND s.size >= coalesce(b.size, 0)),
h AS (SELECT map_id, y, x FROM e WHERE size > 450 UNION SELECT e.map_id, e.y, e.x FROM h JOIN e ON e.map_id = h.map_id AND abs(e.y - h.y) <= 1 AND abs(e.x - h.x) <= 1) SELECT map_id, y, x FROM h"""),
    "watershed": on_px("""d AS MATERIALIZED (SELECT a.map_id, a.y, a.x, any_value(a.m) AS m, least(2500, coalesce(min((a.y - s.y) * (a.y - s.y) + (a.x - s.x) * (a.x - s.x)), 2500)) AS d FROM px a LEFT JOIN (SELECT * FROM px WHERE NOT m) s ON a.map_id = s.map_id GROUP BY 1, 2, 3),
k AS MATERIALIZED (SELECT a.map_id, a.y, a.x, -any_value(a.d) AS h, CASE WHEN any_value(a.d) = max(b.d) THEN a.y * 1000 + a.x + 1 ELSE 0 END AS marker FROM d a JOIN d b ON a.map_id = b.map_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.m GROUP BY 1, 2, 3),
s(map_id, y, x, level, steps) USING KEY (map_id, y, x) AS (SELECT map_id, y, x, h, 0 FROM k WHERE marker > 0
  UNION SELECT map_id, y, x, s[1], s[2] FROM (SELECT n.map_id, n.y, n.x, min([greatest(s.level, n.h), CASE WHEN n.h > s.level THEN 0 ELSE s.steps + 1 END]) AS s FROM s JOIN k n ON n.map_id = s.map_id AND abs(n.y - s.y) + abs(n.x - s.x) = 1 AND n.marker = 0 GROUP BY 1, 2, 3) c
  WHERE NOT EXISTS (SELECT 1 FROM recurring.s o WHERE o.map_id = c.map_id AND o.y = c.y AND o.x = c.x AND [o.level, o.steps] <= c.s)),
e AS MATERIALIZED (SELECT a.map_id, a.y AS ay, a.x AS ax, b.y, b.x FROM s a JOIN s b ON a.map_id = b.map_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 JOIN k n ON n.map_id = b.map_id AND n.y = b.y AND n.x = b.x AND n.marker = 0 WHERE b.level = greatest(a.level, n.h) AND b.steps = CASE WHEN n.h > a.level THEN 0 ELSE a.steps + 1 END),
l AS (SELECT map_id, y, x, marker AS label FROM k WHERE marker > 0 UNION SELECT e.map_id, e.y, e.x, l.label FROM l JOIN e ON e.map_id = l.map_id AND e.ay = l.y AND e.ax = l.x)
SELECT map_id, y, x, CAST(min(label) AS BIGINT) AS label FROM l GROUP BY 1, 2, 3"""),
    "skeletonise": on_px(skeleton_sql()),
    "contour_trace": on_px(labelled_sql("m", True) + """, side(s, ay, ax, oy, ox) AS (VALUES (0, 0, 1, -1, 0), (1, 1, 0, 0, 1), (2, 0, -1, 1, 0), (3, -1, 0, 0, -1)),
c AS MATERIALIZED (SELECT p.map_id, p.label, (CAST(p.y AS BIGINT) * 16777216 + p.x) * 4 + s AS id, s, p.y, CASE WHEN g.y IS NOT NULL THEN (CAST(g.y AS BIGINT) * 16777216 + g.x) * 4 + (s + 3) % 4 WHEN f.y IS NOT NULL THEN (CAST(f.y AS BIGINT) * 16777216 + f.x) * 4 + s ELSE (CAST(p.y AS BIGINT) * 16777216 + p.x) * 4 + (s + 1) % 4 END AS next
  FROM labelled p CROSS JOIN side LEFT JOIN labelled o ON o.map_id = p.map_id AND o.label = p.label AND o.y = p.y + oy AND o.x = p.x + ox LEFT JOIN labelled g ON g.map_id = p.map_id AND g.label = p.label AND g.y = p.y + oy + ay AND g.x = p.x + ox + ax LEFT JOIN labelled f ON f.map_id = p.map_id AND f.label = p.label AND f.y = p.y + ay AND f.x = p.x + ax WHERE o.y IS NULL),
r AS (SELECT map_id, id, id AS l FROM c UNION SELECT r.map_id, c.next, r.l FROM r JOIN c ON c.map_id = r.map_id AND c.id = r.id WHERE r.l < c.next),
ring AS MATERIALIZED (SELECT map_id, l AS ring, any_value(label) AS label, sum(CASE s WHEN 2 THEN y + 1 WHEN 0 THEN -y ELSE 0 END) AS area, count(*) AS n FROM (SELECT map_id, id, min(l) AS l FROM r GROUP BY 1, 2) JOIN c USING (map_id, id) GROUP BY 1, 2),
w AS (SELECT map_id, ring, ring AS id, 0 AS pos FROM ring UNION ALL SELECT w.map_id, ring, c.next, pos + 1 FROM w JOIN c ON c.map_id = w.map_id AND c.id = w.id WHERE c.next <> ring),
o AS MATERIALIZED (SELECT w.map_id, w.ring, label, area, CASE WHEN area < 0 AND pos = 0 THEN n ELSE pos END AS pos, w.id // 4 AS p, coalesce(lead(w.id // 4) OVER (PARTITION BY w.map_id, w.ring ORDER BY pos), w.ring // 4) AS q FROM w JOIN ring USING (map_id, ring)),
t AS (SELECT *, coalesce(lag(p) OVER k, last_value(p) OVER (PARTITION BY map_id, ring ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b FROM o WHERE p <> q WINDOW k AS (PARTITION BY map_id, ring ORDER BY pos)),
corner AS (SELECT map_id, ring, label, area, pos, p FROM t WHERE p - b <> q - p UNION ALL SELECT map_id, ring, any_value(label), any_value(area), 0, any_value(p) FROM o GROUP BY 1, 2 HAVING count(DISTINCT p) = 1),
part AS (SELECT map_id, ring, CASE WHEN area > 0 THEN 0 ELSE row_number() OVER (PARTITION BY map_id, label, area > 0 ORDER BY area, ring) END AS part FROM (SELECT map_id, ring, any_value(label) AS label, any_value(area) AS area FROM corner GROUP BY 1, 2 HAVING any_value(area) > 0 OR count(*) > 2))
SELECT map_id, label, CAST(part AS INT) AS part, CAST(row_number() OVER (PARTITION BY map_id, ring ORDER BY pos) - 1 AS INT) AS k, CAST(p // 16777216 AS INT) AS y, CAST(p % 16777216 AS INT) AS x FROM corner JOIN part USING (map_id, ring)"""),
    # squares of 2 x 2 pixels: full ones count 1, those of three pixels 1/2; their numbers give the Euler number as well
    "contour_areas": on_px(labelled_sql("m", True) + """, q AS (SELECT map_id, label, y + dy AS qy, x + dx AS qx, count(*) AS n, bool_or(dy = dx) AND bool_or(dy <> dx) AS sides FROM labelled, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx) GROUP BY 1, 2, 3, 4)
SELECT map_id, label, 1 - (count(*) FILTER (n = 1) - count(*) FILTER (n = 3) - 2 * count(*) FILTER (n = 2 AND NOT sides)) // 4 AS n_holes, count(*) FILTER (n = 4) + count(*) FILTER (n = 3) / 2.0::DOUBLE AS area FROM q GROUP BY 1, 2"""),
    "difference_enlarged": on_px(LARGE8 + """, boxes AS (SELECT map_id, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM big GROUP BY 1, 2),
near AS MATERIALIZED (SELECT DISTINCT b.map_id, b.label, p.label AS neighbour FROM boxes b JOIN big p ON p.map_id = b.map_id AND p.label <> b.label AND p.y >= b.y0 AND p.y < b.y1 + 4 AND p.x >= b.x0 AND p.x < b.x1 + 4),
pair AS MATERIALIZED (SELECT n.*, r.label IS NULL AS onesided FROM near n LEFT JOIN near r ON r.map_id = n.map_id AND r.label = n.neighbour AND r.neighbour = n.label),
grown AS MATERIALIZED (SELECT o.map_id, o.y, o.x, b.label, bool_or(o.y = b.y AND o.x = b.x) AS own FROM (SELECT * FROM px WHERE gt OR m) o JOIN big b ON o.map_id = b.map_id AND abs(o.y - b.y) <= 2 AND abs(o.x - b.x) <= 2 GROUP BY 1, 2, 3, 4),
lost AS (SELECT DISTINCT g.map_id, g.y, g.x, g.label FROM grown g JOIN grown h USING (map_id, y, x) JOIN pair p ON p.map_id = g.map_id AND p.label = g.label AND p.neighbour = h.label WHERE NOT g.own AND (h.own OR h.label < g.label OR p.onesided))
SELECT map_id, y, x, label FROM grown ANTI JOIN lost USING (map_id, y, x, label)"""),
}
