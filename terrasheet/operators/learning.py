"""Models: k-means from given colours, naive Bayes, forests and linear machines on Spark ML, importances, principal axes."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PALETTE, TREE_DEPTH, TREES
from .features import standardise
from .graph import settled


def lloyd(df: DataFrame, start: list[tuple[float, float, float]] | None = None, rounds: int = 10, digits: int = 6, by: str = "map_id") -> DataFrame:
    """df (by, r, g, b) with `cluster`: the nearest centre before the last update, from given centres, for each map by itself.

    Rounds run over the distinct colours of each map and their numbers, counted once; what a round keeps is a row of centres
    per map. A centre without pixels stays. Centres are rounded, so that results don't depend on the order of sums.
    """
    first = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(p, "rgb", strict=True)]) for p in (start or PALETTE)])
    colours = settled(df.groupBy(by, "r", "g", "b").agg(F.count("*").alias("n")))
    centres = settled(colours.select(by).distinct().withColumn("centres", first))

    def assigned(rows: DataFrame) -> DataFrame:
        far = lambda c: sum((F.col(v) - c[v]) * (F.col(v) - c[v]) for v in "rgb")
        best = F.array_min(F.transform("centres", lambda c, i: F.struct(far(c).alias("d"), i.alias("k"))))
        return rows.join(centres, by).withColumn("cluster", best["k"])

    for _ in range(rounds - 1):
        means = [F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), digits).alias(c) for c in "rgb"]
        moved = assigned(colours).groupBy(by, "cluster").agg(*means).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.struct("r", "g", "b")))).alias("moved"))
        centres = settled(centres.join(moved, by).select(by, F.transform("centres", lambda c, i: F.coalesce(F.element_at("moved", i), c)).alias("centres")))
    return assigned(df).select(*df.columns, "cluster")


def gaussian_likelihoods(df: DataFrame, features: list[str], label: str, least_variance: float = 1e-9) -> DataFrame:
    """(label, prior, and m_<f>, v_<f> for each feature): what naive Bayes with normal densities learns."""
    stats = [x for f in features for x in (F.avg(f).alias(f"m_{f}"), (F.var_pop(f) + least_variance).alias(f"v_{f}"))]
    counted = df.groupBy(label).agg(F.count("*").alias("n"), *stats)
    return counted.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).drop("n")


def gaussian_predict(df: DataFrame, model: DataFrame, features: list[str], label: str, id_column: str) -> DataFrame:
    """(id, predicted, log_likelihood): the label of the highest log-likelihood, the least of equals.

    The model, a row per label, becomes one array, so that rows aren't multiplied.
    """
    fields = [label, "prior", *[f"{k}_{f}" for f in features for k in "mv"]]
    table = model.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("t")).scalar()

    def score(t):
        parts = [F.log(t["prior"])] + [-0.5 * (F.log(2 * F.lit(3.141592653589793) * t[f"v_{f}"]) + (F.col(f) - t[f"m_{f}"]) * (F.col(f) - t[f"m_{f}"]) / t[f"v_{f}"]) for f in features]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return F.struct((-F.round(total, 6)).alias("l"), t[label].alias("k"))

    best = F.array_min(F.transform(F.col("_t"), score))
    return df.withColumn("_t", table).select(id_column, best["k"].alias("predicted"), (-best["l"]).alias("log_likelihood"))


def balanced(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """df with the weight n / (classes * n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    sizes = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(0)))).withColumn("_k", F.count("*").over(Window.partitionBy(F.lit(0))))
    return df.join(F.broadcast(sizes), label).withColumn(out, F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")  # a row per class


def forest(train: DataFrame, features: list[str], label: str, trees: int = TREES, depth: int = TREE_DEPTH, seed: int = 42) -> PipelineModel:
    """A random forest with balanced classes; labels are indexed in alphabetical order."""
    stages = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep"), VectorAssembler(inputCols=features, outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(balanced(train.withColumn(label, F.col(label).cast("string")), label))


def linear_machines(train: DataFrame, features: list[str], label: str, rounds: int = 20) -> PipelineModel:
    """One linear support vector machine per class against the rest; stands for kernel machines, which Spark ML lacks."""
    stages = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=features, outputCol="_x"), OneVsRest(classifier=LinearSVC(maxIter=rounds), featuresCol="_x", labelCol="_y")]
    return Pipeline(stages=stages).fit(train.withColumn(label, F.col(label).cast("string")))


def naive_bayes(train: DataFrame, features: list[str], label: str) -> PipelineModel:
    stages = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=features, outputCol="_x"), NaiveBayes(featuresCol="_x", labelCol="_y", modelType="gaussian")]
    return Pipeline(stages=stages).fit(train.withColumn(label, F.col(label).cast("string")))


def classify(df: DataFrame, model: PipelineModel, label: str, id_column: str) -> DataFrame:
    """(id, predicted, probability): the class and the map of class to probability (empty for models without)."""
    names = model.stages[0].labels
    scored = model.transform(df.withColumn(label, F.col(label).cast("string")))
    share = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.slice(vector_to_array("probability"), 1, len(names))) if "probability" in scored.columns else F.create_map().cast("map<string,double>")
    return scored.select(id_column, F.array(*[F.lit(n) for n in names])[F.col("prediction").cast("int")].alias("predicted"), share.alias("probability"))


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """(feature, importance, deviation): by impurity, with the deviation over the trees; the most important first."""
    own = model.stages[-1]
    each = [t.featureImportances.toArray() for t in own.trees]
    rows = [(f, float(own.featureImportances.toArray()[i]), float((sum((e[i] - sum(x[i] for x in each) / len(each)) ** 2 for e in each) / len(each)) ** 0.5)) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double, deviation double").orderBy(F.desc("importance"), "feature")


def permutation_importances(model: PipelineModel, df: DataFrame, features: list[str], label: str, id_column: str, repeats: int = 3) -> DataFrame:
    """(feature, drop): the mean loss of accuracy when a feature's values are dealt anew to the rows.

    Row k of the order by one digest of the id gets the value of row k of another order; both orders are ranked by Spark.
    All features and repeats are scored in one job over their union.
    """
    base = df.withColumn(label, F.col(label).cast("string")).select(id_column, label, *features)
    order = lambda salt: F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(id_column), F.lit(64))).orderBy(F.md5(F.concat(F.col(id_column).cast("string"), F.lit(salt)).cast("binary")), id_column))
    block = F.pmod(F.xxhash64(id_column), F.lit(64))
    parts = [base.withColumn("_f", F.lit("")).withColumn("_r", F.lit(0))]
    for f in features:
        for r in range(repeats):
            own = base.withColumn("_b", block).withColumn("_k", order("own"))
            other = base.select(block.alias("_b"), order(f"{f}-{r}").alias("_k"), F.col(f).alias("_v"))
            parts.append(own.join(other, ["_b", "_k"]).withColumn(f, F.col("_v")).select(*base.columns).withColumn("_f", F.lit(f)).withColumn("_r", F.lit(r)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    scored = model.transform(union)
    rates = scored.groupBy("_f", "_r").agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("rate"))
    whole = rates.where("_f = ''").select("rate").scalar()
    return rates.where("_f <> ''").withColumn("whole", whole).groupBy(F.col("_f").alias("feature")).agg(F.avg(F.col("whole") - F.col("rate")).alias("drop"))


def principal_axes(df: DataFrame, features: list[str], id_column: str, k: int = 3) -> DataFrame:
    """(id, axis1 .. axisk): projections of the standardised features on their principal axes."""
    scaled = standardise(df.select(id_column, *features), features).withColumn("_x", array_to_vector(F.array(*[F.col(f) for f in features])))
    model = PCA(k=k, inputCol="_x", outputCol="_z").fit(scaled)
    return model.transform(scaled).select(id_column, *[vector_to_array("_z")[i].alias(f"axis{i + 1}") for i in range(k)])


#: Bits of a chunk of nearest_by_bits.
CHUNK = 16


def chunks_of(bits: Column) -> Column:
    """The chunks of an array of 64-bit words, as whole numbers."""
    return F.flatten(F.transform(bits, lambda w: F.array(*[F.shiftrightunsigned(w, k).bitwiseAND((1 << CHUNK) - 1).cast("int") for k in range(0, 64, CHUNK)])))


def nearest_by_bits(queries: DataFrame, base: DataFrame, bits: str = "bits", itself: bool = True) -> DataFrame:
    """(query, match, distance): for each query the descriptor with the fewest differing bits, the least id of equals.

    Multi-index hashing: descriptors are looked up by chunks of 16 bits. Round s probes, for the queries that are still open,
    all chunks with s bits changed. Of m chunks one has at most d / m of d differing bits, so after round s all descriptors at
    a distance below m * (s + 1) have been met, and a query whose best is among them is done. The last round would have met
    all. Equal descriptors are one entry. A base row with the query's own id counts only if `itself`; rows without bits and
    queries without any other row have no match.
    """
    known = base.where(F.col(bits).isNotNull()).select("id", F.col(bits).alias("bits"))
    entries = known.groupBy("bits").agg(F.min("id").alias("a"))
    if itself:
        entries = entries.withColumn("b", F.col("a"))
    else:
        second = known.join(entries, "bits").where("id > a").groupBy("bits").agg(F.min("id").alias("b"))
        entries = entries.join(second, "bits", "left")
    entries = settled(entries)
    index = entries.select(F.col("bits").alias("theirs"), "a", "b", F.posexplode(chunks_of(F.col("bits"))).alias("chunk", "key"))
    left = settled(queries.where(F.col(bits).isNotNull()).select(F.col("id").alias("query"), F.col(bits).alias("bits")).distinct())
    best = left.sparkSession.createDataFrame([], T.StructType([T.StructField("query", left.schema["query"].dataType), T.StructField("distance", T.IntegerType()), T.StructField("match", known.schema["id"].dataType)]))
    distance = F.aggregate(F.zip_with("bits", "theirs", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)
    match = F.when(F.col("a") == F.col("query"), F.col("b")).otherwise(F.col("a")) if not itself else F.col("a")
    for s in range(CHUNK + 1):
        masks = ",".join(str(sum(1 << k for k in own)) for own in combinations(range(CHUNK), s))
        probes = left.select("query", "bits", F.posexplode(chunks_of(F.col("bits"))).alias("chunk", "own"))
        probes = probes.withColumn("mask", F.explode(F.split(F.lit(masks), ",").cast("array<int>")))
        met = probes.withColumn("key", F.col("own").bitwiseXOR(F.col("mask"))).join(index, ["chunk", "key"]).select("query", distance.alias("distance"), match.alias("match")).where("match is not null")
        found = best.unionByName(met).groupBy("query").agg(F.min(F.struct("distance", "match")).alias("m"))
        best = settled(found.select("query", "m.distance", "m.match"))
        proved = (s + 1) * F.size("bits") * (64 // CHUNK)
        left = settled(left.join(best, "query", "left").where(F.col("distance").isNull() | (F.col("distance") >= proved)).select("query", "bits"))
        if left.isEmpty():
            break
    return best.select("query", "match", "distance")
