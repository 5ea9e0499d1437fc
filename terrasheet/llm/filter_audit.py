"""What filters of documents do together: for each order of them, what a step removes, and each filter's Shapley share.

A document has a flag per filter (true: it fails). Documents with the same flags, part and labels are only counted, and so
a small table of profiles stands for the corpus. SQL CUBE over the flags and the part sums it up for each selection of
columns; the rows of a selection in which all its flags are false are the survivors of that set of filters. An order's step
joins the survivors of two sets: the filters before it and those with it.

`flags` has the five filters of the registered audit: A, fewer than 100 words; B, different words under 80 % of the words;
C, letters A-Z over 10 % of the characters; D, any of #$%&*|; E, the same text as a row of a smaller doc_id.

Same texts are found by digest. Rows are counted by document, part, flags and digest before anything is joined, so a text
of a third of all rows is a few rows from then on; rows without a doc_id, which no label can belong to, are dealt by digest
in the join with the labels.

Null text is empty, null lang the part ''. Rows that repeat a doc_id and its text count as rows of their own and don't fail
E by each other; a row without a doc_id neither fails E nor makes others fail. A document with several labels has quality
or toxic = 1 if one of them says so; null labels say nothing. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 100, 80, 10
COUNTS = ("kept", "good", "toxic")


def own_flags(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, part, A, B, C, D, digest) of each row: what a document's own text and lang say."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), whole.alias("whole"), F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "").alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("whole", "[^A-Z]++", ""))
    return split.select(
        "doc_id",
        "part",
        (n < LEAST_WORDS).alias("A"),
        (100 * distinct < LEAST_DISTINCT_PERCENT * n).alias("B"),
        (100 * capitals > MOST_CAPITALS_PERCENT * F.length("whole")).alias("C"),
        F.col("whole").rlike("[#$%&*|]").alias("D"),
        F.unhex(F.sha2("whole", 256)).alias("digest"),
    )


def profiles(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A..E, kept, good, toxic): how many rows have these flags, and how many of them the labels call good and toxic.

    flagged: own_flags' rows.
    """
    own = ["part", *FILTERS[:-1]]
    rows = flagged.groupBy("doc_id", "digest", *own).agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(f"is_{c}")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(says("quality"), says("toxic")).withColumn("lot", F.lit(0))
    lot = F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(0)
    labelled = rows.withColumn("lot_", lot).join(marks, (F.col("doc_id") == F.col("of")) & (F.col("lot_") == F.col("lot")), "left")
    labelled = labelled.select("doc_id", "digest", *own, "n", *[F.coalesce(f"is_{c}", F.lit(0)).alias(f"is_{c}") for c in ("quality", "toxic")])
    # doc_id by doc_id the rows may be many; of each text there are only as many as parts and labels
    alike = labelled.groupBy("digest", *own, "is_quality", "is_toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    )
    found = alike.withColumn("smallest", F.min("least").over(Window.partitionBy("digest")))
    passing = F.col("nameless") + F.when(F.col("least") == F.col("smallest"), F.col("first.n")).otherwise(0)
    split = found.select(*own, "is_quality", "is_toxic", F.explode(F.array(F.struct(F.lit(False).alias("E"), passing.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - passing).alias("n")))).alias("of"))
    counted = split.select(*own, "of.E", "is_quality", "is_toxic", "of.n").where("n > 0")
    return counted.groupBy("part", *FILTERS).agg(F.sum("n").alias("kept"), F.sum(F.col("n") * F.col("is_quality")).alias("good"), F.sum(F.col("n") * F.col("is_toxic")).alias("toxic"))


def survivors(counted: DataFrame) -> DataFrame:
    """(part, filters, kept, good, toxic): what passes each set of filters, in each part; zeros aren't there.

    filters has a bit for each filter, the first one's the highest.
    """
    n = len(FILTERS)
    cube = counted.cube(*FILTERS, "part").agg(F.grouping_id().alias("left_out"), *[F.sum(c).alias(c) for c in COUNTS])
    chosen = F.bitwise_not(F.shiftright("left_out", 1)).bitwiseAND((1 << n) - 1)
    failed = F.coalesce(F.greatest(*[F.col(f).cast("int") for f in FILTERS]), F.lit(0))  # of columns that are left out: null
    return cube.where((F.col("left_out") % 2 == 0) & (failed == 0)).select("part", chosen.cast("int").alias("filters"), *COUNTS)


def bits(filters: str) -> int:
    """The set of these filters as survivors() has it."""
    return sum(1 << len(FILTERS) - 1 - FILTERS.index(f) for f in filters)


def shapley_terms() -> list[tuple[str, int, int, int]]:
    """(filter, before, after, orders): in how many orders the filter's step leads from one set to the other."""
    n = len(FILTERS)
    out = []
    for f in FILTERS:
        others = FILTERS.replace(f, "")
        for k in range(n):
            out += [(f, bits("".join(s)), bits("".join(s) + f), factorial(k) * factorial(n - 1 - k)) for s in combinations(others, k)]
    return out


def audit(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per part, order of the filters and step; see the module. Columns: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    counted = stored(profiles(own_flags(docs, text), labels), "profiles")  # the corpus is read once
    every = 1 << len(FILTERS)
    passing = survivors(counted)
    # each part has all sets: those that nothing passes were missing
    parts = passing.where("filters = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(every - 1))).alias("filters"))
    full = parts.join(passing, ["part", "filters"], "left").select("part", "filters", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
    full = stored(full, "survivors")
    as_side = lambda side: full.select("part", *[F.col(c).alias(f"{c}_{side}") for c in ("filters", *COUNTS)])
    before, after = as_side("before"), as_side("after")

    def stepped(steps: DataFrame) -> DataFrame:
        """The survivors of both sets of each step; the steps are fixed and few."""
        return F.broadcast(steps).join(before, "filters_before").join(after, ["part", "filters_after"])

    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = spark.createDataFrame([(o, k + 1, o[k], bits(o[:k]), bits(o[: k + 1])) for o in orders for k in range(len(o))], "filter_order string, step int, filter string, filters_before int, filters_after int")
    terms = spark.createDataFrame(shapley_terms(), "filter string, filters_before int, filters_after int, orders long")
    whole = bits(FILTERS)
    removed = F.col("kept_before") - F.col("kept_after")
    pick = lambda condition: F.sum(F.when(condition, removed).otherwise(0))
    shares = stepped(terms).groupBy("part", "filter").agg(
        F.sum(removed * F.col("orders")).alias("shapley"), pick(F.col("filters_before") == 0).alias("fails"), pick(F.col("filters_after") == whole).alias("unique_fails")
    )
    lost = lambda c: (F.col(f"{c}_before") - F.col(f"{c}_after")).alias(f"{c}_lost")
    done = stepped(steps).select("part", "filter_order", "step", "filter", F.col("kept_after").alias("kept"), removed.alias("removed"), lost("good"), lost("toxic"))
    return done.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
