"""How well predicted segments and classes match the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import IOU_BINS, IOU_THRESHOLDS


def class_raster(maps: DataFrame, masks: DataFrame, classes: list[str]) -> DataFrame:
    """(map_id, y, x, class_id): of the classes with a mask, 1 for the first. masks: (map_id, class, y, x) of set pixels.

    A map without a mask of some class simply has no pixels of it; where masks overlap, the last class wins.
    """
    index = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i + 1)])
    known = masks.where(F.col("class").isin(*classes)).join(maps.select("map_id").distinct(), "map_id", "left_semi")
    return known.groupBy("map_id", "y", "x").agg(F.max(index[F.col("class")]).alias("class_id"))


def matched(predicted: DataFrame, truth: DataFrame, areas: tuple[float, float] | None = None) -> DataFrame:
    """(map_id, pred, truth, iou, pred_area, truth_area) for each predicted segment and each true one that it overlaps.

    Both have a row (map_id, y, x, label) per pixel. One join by pixel and counts by label: linear in the pixels. areas:
    bounds of true areas (exclusive) and of predicted ones (inclusive).
    """
    size = lambda df, name: df.groupBy("map_id", "label").agg(F.count("*").alias(f"{name}_area")).withColumnRenamed("label", name)
    p, t = predicted.select("map_id", "y", "x", F.col("label").alias("pred")), truth.select("map_id", "y", "x", F.col("label").alias("truth"))
    common = p.join(t, ["map_id", "y", "x"]).groupBy("map_id", "pred", "truth").agg(F.count("*").alias("common"))
    pairs = common.join(size(predicted, "pred"), ["map_id", "pred"]).join(size(truth, "truth"), ["map_id", "truth"])
    if areas:
        pairs = pairs.where((F.col("truth_area") > areas[0]) & (F.col("truth_area") < areas[1]) & F.col("pred_area").between(*areas))
    iou = F.col("common") / (F.col("pred_area") + F.col("truth_area") - F.col("common"))
    return pairs.select("map_id", "pred", "truth", iou.alias("iou"), "pred_area", "truth_area")


def at_points(points: DataFrame, truth: DataFrame) -> DataFrame:
    """Points (map_id, pred, px, py) with the true label under them; those over none are left out."""
    at = points.withColumn("y", F.floor("py").cast("int")).withColumn("x", F.floor("px").cast("int"))
    return at.join(truth.select("map_id", "y", "x", F.col("label").alias("truth")), ["map_id", "y", "x"])


def matched_at_points(predicted: DataFrame, points: DataFrame, truth: DataFrame, areas: tuple[float, float] | None = None) -> DataFrame:
    """matched() rows for each predicted segment and the one true segment under its point (map_id, pred, px, py).

    A segment whose point lies over no true segment has no row; one that doesn't overlap the segment under its point has an
    IoU of 0, and one without pixels an area of 0.
    """
    met = at_points(points, truth).select("map_id", "pred", "truth")
    common = matched(predicted, truth).select("map_id", "pred", "truth", "iou")
    size = lambda df, name: df.groupBy("map_id", "label").agg(F.count("*").alias(f"{name}_area")).withColumnRenamed("label", name)
    pairs = met.join(common, ["map_id", "pred", "truth"], "left").join(size(predicted, "pred"), ["map_id", "pred"], "left").join(size(truth, "truth"), ["map_id", "truth"])
    pairs = pairs.withColumns({"iou": F.coalesce("iou", F.lit(0.0)), "pred_area": F.coalesce("pred_area", F.lit(0))})
    if areas:
        pairs = pairs.where((F.col("truth_area") > areas[0]) & (F.col("truth_area") < areas[1]) & F.col("pred_area").between(*areas))
    return pairs.select("map_id", "pred", "truth", "iou", "pred_area", "truth_area")


def one_to_one(matches: DataFrame) -> DataFrame:
    """Of the matches of a true segment, the one of the highest IoU; ties go to the least predicted label."""
    best = F.row_number().over(Window.partitionBy("map_id", "truth").orderBy(F.desc("iou"), "pred"))
    return matches.withColumn("_k", best).where("_k = 1").drop("_k")


def significant(value: Column, digits: int = 4) -> Column:
    """Rounded to so many significant digits."""
    size = F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - size)
    return F.when(value == 0, 0.0).otherwise(F.round(value * scale) / scale)


def threshold_sweep(matches: DataFrame, true_number: Column | int, predicted_number: Column | int | None = None, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, tp, precision, recall, f1) for each IoU threshold, in one pass.

    Several matches of one true segment all count, so recall can exceed 1 (one_to_one avoids it). Precision and recall
    are rounded to four significant digits before F1 is made from them; F1 isn't rounded. Rates without a denominator are null. The numbers
    may be columns of one row, as DataFrame.scalar gives them.
    """
    steps = thresholds or IOU_THRESHOLDS
    hits = F.array(*[F.struct(F.lit(t).alias("threshold"), F.sum((F.col("iou") >= t).cast("long")).alias("tp")) for t in steps])
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    total = F.count("*") if predicted_number is None else lit(predicted_number)
    rows = matches.agg(hits.alias("hits"), total.cast("double").alias("n")).select(F.explode("hits").alias("h"), "n").select("h.threshold", F.coalesce("h.tp", F.lit(0)).alias("tp"), "n")
    rows = rows.withColumn("precision", significant(F.try_divide(F.col("tp"), F.col("n")))).withColumn("recall", significant(F.try_divide(F.col("tp"), lit(true_number).cast("double"))))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.select("threshold", "tp", "precision", "recall", f1.alias("f1"))


def histogram(df: DataFrame, value: Column, edges: list[float] | None = None) -> DataFrame:
    """(bin, low, high, n, percent) for every bin, empty ones too; the last one holds its upper edge."""
    edges = edges or IOU_BINS
    last = len(edges) - 2
    below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value)) - 1
    place = F.when(value == edges[-1], last).when((below >= 0) & (below <= last), below)
    counts = df.select(place.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(last + 1)], "bin int, low double, high double")
    rows = every.join(F.broadcast(counts), "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # a row per bin
    return rows.withColumn("percent", 100 * F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy())))


def confusion(df: DataFrame, true: str, predicted: str, classes: list) -> DataFrame:
    """A row per true class: its number and the share of each predicted class, as columns p_<class>."""
    shares = [F.avg((F.col(predicted) == c).cast("double")).alias(f"p_{c}") for c in classes]
    return df.where(F.col(true).isin(*classes)).groupBy(F.col(true).alias("true_class")).agg(F.count("*").alias("support"), *shares)


def classification_report(df: DataFrame, true: str, predicted: str, classes: list) -> DataFrame:
    """(class, precision, recall, f1, support) per class, and the rows 'macro avg' and 'weighted avg'; 0 where undefined."""
    hit = lambda c: F.count_if((F.col(true) == c) & (F.col(predicted) == c))
    counted = F.array(*[F.struct(F.lit(str(c)).alias("class"), hit(c).alias("tp"), F.count_if(F.col(predicted) == c).alias("pp"), F.count_if(F.col(true) == c).alias("support")) for c in classes])
    rows = df.agg(counted.alias("c")).select(F.explode("c").alias("c")).select("c.*")
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    rows = rows.withColumn("precision", rate("tp", "pp")).withColumn("recall", rate("tp", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    rows = rows.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support")
    rates = ("precision", "recall", "f1")
    macro = rows.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in rates], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("class"), *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c) for c in rates], F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)
