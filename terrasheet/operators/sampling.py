"""Splits and samples that come out the same on every run: by digests of ids, never by a random number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split(df: DataFrame, id_column: str, class_column: str, shares: dict[str, float], out: str = "part") -> DataFrame:
    """df with the name of each row's part: of a class's rows, in the order of the ids' MD5 digests, the floor of the
    summed shares ends a part; rows beyond all shares get null.

    The rows of one class are numbered without gathering them: first by a prefix of the digest, then within it.
    """
    rows = df.withColumn("_d", F.md5(F.col(id_column).cast("string").cast("binary"))).withColumn("_p", F.substring("_d", 1, 2))
    sizes = rows.groupBy(class_column, "_p").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(class_column)
    before = sizes.select(class_column, "_p", (F.sum("_n").over(own.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias("_all"))
    placed = rows.join(before, [class_column, "_p"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(class_column, "_p").orderBy("_d", id_column))
    ends, summed = [], 0.0
    for name, share in shares.items():
        summed = round(summed + share, 9)
        ends.append(F.when(F.col("_place") <= F.floor(F.col("_all") * summed), F.lit(name)))
    return placed.withColumn("_place", place).withColumn(out, F.coalesce(*ends)).select(*df.columns, out)


def weighted_draws(df: DataFrame, by: str, order: str, weight: str, draws: Column, block: int = 1 << 16) -> DataFrame:
    """(by, draw, order): for each u of `draws` (array<double> in 0..1), the row whose part of the summed weights holds it.

    Rows lie one after another in order, a whole number; u belongs to the row with cdf before <= u < cdf. Equal draws give
    equal rows. Weights are summed by blocks of `order` first; only the rows of blocks that a draw falls in are sorted and
    summed one by one, each block in a task of its own.
    """
    placed = df.withColumn("_b", F.floor(F.col(order) / block))
    window = Window.partitionBy(by).orderBy("_b")
    blocks = placed.groupBy(by, "_b").agg(F.sum(weight).alias("_own"))
    blocks = blocks.withColumn("_end", F.sum("_own").over(window)).withColumn("_all", F.sum("_own").over(Window.partitionBy(by))).withColumn("_start", F.col("_end") - F.col("_own"))
    within = lambda u, low, high: (u >= F.coalesce(low / F.col("_all"), F.lit(0.0))) & (u < high / F.col("_all"))
    hit = blocks.withColumn("_u", F.filter(draws, lambda u: within(u, F.col("_start"), F.col("_end")))).where("size(_u) > 0").select(by, "_b", "_start", "_all", "_u")
    own = placed.select(by, "_b", order, weight).join(hit, [by, "_b"])
    end = F.col("_start") + F.sum(weight).over(Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    drawn = own.withColumn("_last", end).withColumn("u", F.explode(F.filter("_u", lambda u: within(u, F.col("_last") - F.col(weight), F.col("_last")))))
    return drawn.select(by, F.col("u").alias("draw"), order)


def best_share(df: DataFrame, by: str, order: list[str], share: float) -> DataFrame:
    """Of each group the floor of the share of its rows that come first in order."""
    window = Window.partitionBy(by)
    kept = df.withColumn("_k", F.row_number().over(window.orderBy(*order))).withColumn("_n", F.count("*").over(window))
    return kept.where(F.col("_k") <= F.floor(F.col("_n") * share)).drop("_k", "_n")
