"""From pixels to classified polygons and back to scores: the operators put together, lazily, for any number of maps."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASSES, EDT_CAP, ENLARGE, FEATURES, FILLS, FOREGROUND_MOST, MIN_SEGMENT_PIXELS, MIN_VALUE, NEIGHBOUR_REACH, PALETTE, PALETTE_CLASS, SELECTED, SENSITIVITY, SIMPLIFY, SNAP, TREES
from ..functions import color, rings
from ..operators import borders, components, evaluation, features, folds, geometry, learning, overlay, raster, tiles
from ..operators.graph import settled
from ..sources import geojson


class Settings(NamedTuple):
    """What a user of the maps chooses. marker_region: where peaks are sought, 'high' distances or the 'low' band;
    extract_contour: the contours feature is what segments leave of the map's outline, not the whole outline.
    """

    foreground_most: int = FOREGROUND_MOST
    dark_most: int = 110
    sensitivity: float = SENSITIVITY
    marker_region: str = "high"
    least_pixels: int = MIN_SEGMENT_PIXELS
    tolerance: float = SIMPLIFY
    method: int = 1
    enlarge: float = ENLARGE
    snap: float = SNAP
    reach: int = NEIGHBOUR_REACH
    tile: int = 256
    extract_contour: bool = False


def estimated_distance(pixels: DataFrame, dark_most: int) -> DataFrame:
    """pixels with `d`, 0 on dark lines to 1 far from them: what stands in for a trained network's estimate."""
    line = color.gray(F.col("r"), F.col("g"), F.col("b"), color.SWAPPED_LUMA) <= dark_most
    return raster.distance_transform(pixels, line, EDT_CAP).withColumn("d", F.col("distance") / EDT_CAP).drop("distance")


def segments(pixels: DataFrame, distance: Callable[[DataFrame], DataFrame] | None = None, settings: Settings = Settings()) -> DataFrame:
    """(map_id, y, x, label): segments of each map's foreground that grow from the peaks of the distance."""
    own = (distance or (lambda p: estimated_distance(p, settings.dark_most)))(pixels)
    gray = color.gray(F.col("r"), F.col("g"), F.col("b"), color.SWAPPED_LUMA)
    own = own.withColumn("inside", gray <= settings.foreground_most).withColumn("far", (F.col("d") >= settings.sensitivity).cast("int"))
    if settings.marker_region == "low":
        own = raster.erode(own.withColumn("far", 1 - F.col("far")), "far", 5)
    own = settled(raster.local_maxima(own, "d", (F.col("far") == 1) & F.col("inside")).select("map_id", "y", "x", "d", "inside", "peak"))
    markers = components.components(own.where("peak"), False, settings.tile).select("map_id", "y", "x", (F.col("label") + 1).alias("marker"))
    joined = own.join(markers, ["map_id", "y", "x"], "left").select("map_id", "y", "x", (1 - F.col("d")).alias("height"), F.coalesce("marker", F.lit(0)).alias("marker"), "inside")
    return settled(components.without_small(tiles.watershed(joined, "height", "marker", "inside", settings.tile), settings.least_pixels)[0])


PROBABILITY = "struct<background: double, building: double, water: double>"
#: The columns that a forest reads, in the order of features.vector.
CHOSEN = [FEATURES[i] for i in SELECTED]


def nearest_palette(df: DataFrame) -> DataFrame:
    """(map_id, label, class, probability): the class of the palette colour nearest to an object's mean colour, without
    probabilities. For use without a trained model.
    """
    own = color.lookup(color.lookup(color.nearest(F.col("mean_r"), F.col("mean_g"), F.col("mean_b"), PALETTE), PALETTE_CLASS), CLASSES)
    return df.select("map_id", "label", own.alias("class"), F.lit(None).cast(PROBABILITY).alias("probability"))


def vectors(df: DataFrame) -> DataFrame:
    """df with the chosen features as columns: zeros for objects of too few usable pixels."""
    own = features.vector()
    return df.withColumn("_v", own).withColumns({c: F.col("_v")[i] for i, c in enumerate(CHOSEN)}).drop("_v")


def training_objects(pixels: DataFrame, masks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(map_id, label, class, features): the objects of class masks (map_id, class, y, x), described for a forest.

    An object is a component of a class's mask whose ring encloses more than least_pixels; maps without a class's mask have
    none of it.
    """
    parts = []
    for k, name in enumerate(CLASSES[1:]):
        own = components.components(masks.where(F.col("class") == name), True, settings.tile)
        parts.append(own.withColumn("label", F.col("label") * len(CLASSES) + k).withColumn("class", F.lit(name)))
    labelled = settled(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    polygons = borders.contours(labelled, tile=settings.tile).where(rings.area(F.col("ring")) > settings.least_pixels)
    polygons = settled(polygons.withColumn("ring", geometry.simplify(F.col("ring"), 3.0)).drop("holes"))
    return vectors(described(pixels, labelled.drop("class"), polygons)).join(labelled.select("map_id", "label", "class").distinct(), ["map_id", "label"])


def trained(objects: DataFrame, trees: int = TREES) -> Callable[[DataFrame], DataFrame]:
    """A classifier for vectorise from training_objects: standardised chosen features, a forest with balanced classes."""
    fit = settled(objects.select("class", *CHOSEN))
    model: PipelineModel = learning.forest(features.standardise(fit, CHOSEN), CHOSEN, "class", trees)

    def classify(df: DataFrame) -> DataFrame:
        ready = features.standardise(vectors(df).select("map_id", "label", *CHOSEN), CHOSEN, fit=fit).withColumn("_id", F.struct("map_id", "label"))
        found = learning.classify(ready.withColumn("class", F.lit(CLASSES[1])), model, "class", "_id")
        share = F.struct(*[F.coalesce(F.col("probability")[c], F.lit(0.0)).alias(c) for c in CLASSES[1:]])
        return found.select("_id.map_id", "_id.label", F.col("predicted").alias("class"), share.alias("probability"))

    return classify


def described(pixels: DataFrame, labelled: DataFrame, polygons: DataFrame) -> DataFrame:
    """(map_id, label, n, 22 features, mean_r, mean_g, mean_b) of each segment, from blurred and equalised colours."""
    inside = pixels.select("map_id", "y", "x", "r", "g", "b").join(labelled.select("map_id", "y", "x", F.lit(True).alias("_in")), ["map_id", "y", "x"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    even = raster.equalise(raster.median_blur(inside, ["r", "g", "b"]), ["r", "g", "b"], F.col("_in"))
    h, s, v = color.hsv(F.col("r"), F.col("g"), F.col("b"), 1.0)
    bright = even.where("_in").withColumns({"h": h, "s": s, "v": v}).where(F.col("v") > MIN_VALUE).join(labelled, ["map_id", "y", "x"])
    spectral = features.spectral(bright.select("map_id", "label", "h", "s", "v"), ["map_id", "label"], ["h", "s", "v"])
    mean = pixels.join(labelled, ["map_id", "y", "x"]).groupBy("map_id", "label").agg(*[F.avg(c).alias(f"mean_{c}") for c in "rgb"])
    own = polygons if "holes" in polygons.columns else polygons.withColumn("holes", F.array().cast(f"array<{geometry.RING}>"))
    whole = own.groupBy("map_id").agg(F.sum(rings.area(F.col("ring"))).alias("_map_area"))
    shapes = features.shape(own.withColumn("hull", geometry.convex_hull(F.col("ring"))).join(whole, "map_id"), "ring", "hull", F.col("_map_area"), "holes").drop("ring", "holes", "hull", "_map_area")
    return shapes.join(mean, ["map_id", "label"]).join(spectral, ["map_id", "label"], "left")


def vectorise(pixels: DataFrame, settings: Settings = Settings(), classify: Callable[[DataFrame], DataFrame] = nearest_palette, distance: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(map_id, label, class, ring, holes, points, gis, simple): each segment as a classified polygon and as GeoJSON features.

    Segments are closed by a cross, traced with their holes, simplified, made valid and classified (nearest_palette, or what
    trained gives). method 1 closes gaps: polygons grow by `enlarge` with mitred corners, within the map's outline, less their
    neighbours, from the highest label on (folds.without_neighbours); 2 snaps the vertices of neighbours, which moves the
    points only, so that the two features differ. With method 1 a map also has a contours feature, of label -1, without a
    simple one: its outline, or with extract_contour what the polygons leave of it.
    """
    pixels = settled(pixels)  # read by each of the steps below
    labelled = segments(pixels, distance, settings)
    keys = ["map_id", "label"]

    def traced(df: DataFrame) -> DataFrame:
        own = borders.contours(df, closing=True, hole_tolerance=settings.tolerance, tile=settings.tile).withColumn("ring", geometry.simplify(F.col("ring"), settings.tolerance))
        return overlay.valid_polygons(own, keys)

    polygons = settled(traced(labelled))
    named = classify(described(pixels, labelled, polygons))
    near = geometry.box_neighbours(labelled, settings.reach)
    contour = None
    if settings.method == 1:
        outline = pixels.where(color.gray(F.col("r"), F.col("g"), F.col("b"), color.SWAPPED_LUMA) <= settings.foreground_most).select("map_id", "y", "x")
        contour = settled(traced(outline.withColumn("label", F.lit(-1).cast(labelled.schema["label"].dataType))))
        # neighbours count with what they have, not grown once more: see the README
        folded = settled(folds.without_neighbours(polygons, near, settings.enlarge, contour, extract=False))
        polygons = folds.parts(folded).drop("changed").withColumn("points", F.col("ring"))
        if settings.extract_contour:
            rest = overlay.overlaid(contour, folds.as_rings(folded.where("changed")), ["map_id"], overlay.LESS_UNION, ("holes", None))
            contour = overlay.largest(rest, ["map_id"]).withColumn("label", F.lit(-1).cast(labelled.schema["label"].dataType))
    else:
        vertices = polygons.select("map_id", F.col("label").alias("poly"), F.posexplode("ring").alias("seq", "p")).select("map_id", "poly", "seq", "p.x", "p.y")
        moved = geometry.rings_of(folds.snap_polygons(vertices, near, settings.snap), ["map_id", "poly"], [F.col("seq")])
        polygons = polygons.join(moved.select("map_id", F.col("poly").alias("label"), F.col("ring").alias("points")), ["map_id", "label"])
    out = polygons.join(named, ["map_id", "label"])
    fill = F.create_map(*[F.lit(v) for pair in FILLS.items() for v in pair])[F.col("class")]
    properties = F.struct(fill.alias("fill"), F.col("class").alias("type"), "probability")
    out = out.select("map_id", "label", "class", "ring", "holes", "points", geojson.feature(F.col("ring"), properties, F.col("holes")).alias("gis"), geojson.feature(F.col("points"), properties).alias("simple"))
    if contour is None:
        return out
    own = F.struct(F.lit("#FFFFFF").alias("fill"), F.lit(CLASSES[0]).alias("type"))
    whole = contour.select("map_id", "label", F.lit(CLASSES[0]).alias("class"), "ring", "holes", F.lit(None).cast(out.schema["points"].dataType).alias("points"), geojson.feature(F.col("ring"), own, F.col("holes")).alias("gis"), F.lit(None).cast("string").alias("simple"))
    return out.unionByName(whole.where(F.size("ring") > 2))


def collections(vectorised: DataFrame) -> DataFrame:
    """(map_id, gis, simple): the two collections of each map, features by label; the simple one has no contours."""
    gis, simple = (geojson.collections(vectorised.where(F.col(c).isNotNull()), "map_id", c) for c in ("gis", "simple"))
    return gis.select("map_id", F.col("collection").alias("gis")).join(simple.select("map_id", F.col("collection").alias("simple")), "map_id", "left")


def evaluated(polygons: DataFrame, truth: DataFrame, areas: tuple[float, float] | None = None) -> DataFrame:
    """evaluation.matched_at_points of polygons (map_id, label, ring, holes), filled with pixels and eroded by a cross, and true
    segments (map_id, y, x, label): each polygon meets the one segment under a point inside it."""
    own = polygons if "holes" in polygons.columns else polygons.withColumn("holes", F.array().cast(f"array<{geometry.RING}>"))
    point = geometry.representative_point(F.col("ring"))
    points = own.withColumn("p", point).select("map_id", F.col("label").alias("pred"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    return evaluation.matched_at_points(raster.labels_eroded(geometry.rasterise(own, holes="holes")), points, truth, areas)
