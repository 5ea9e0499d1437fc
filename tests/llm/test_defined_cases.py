"""Cases that the docstrings define: names that clash, ids that are missing, labels that disagree, equal texts."""

import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from terrasheet.llm import bpe, queries, token_counts, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_an_id_column_named_like_a_result_is_an_error(spark):
    df = spark.createDataFrame([(1, "a b", 2)], "begin int, text string, ids int")
    with pytest.raises(ValueError):
        token_counts.section_tokens(df, "begin", "text", RANKS, public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        bpe.encode_texts(df, "ids", "text", RANKS, public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        bpe.decode_ids(bpe.encode_texts(df, "begin", "text", RANKS, public_tokenizers.PATTERN).withColumnRenamed("begin", "decoded"), "decoded", "ids", RANKS, public_tokenizers.PATTERN)
    assert token_counts.section_tokens(df.withColumnRenamed("begin", "id"), "id", "text", RANKS, public_tokenizers.PATTERN).count() == 1


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables of which every third row lacks its id, and whose labels contradict each other for one id."""
    at = str(tmp_path_factory.mktemp("corpus"))
    plain = "some ordinary words of a quiet text about the weather and the sea"
    rows = [Row(None if k % 3 == 0 else k, f"{plain} {k} you moron idiot" if k % 4 == 0 else f"{plain} {k}", "en" if k % 2 else "de", "s", 1) for k in range(1, 400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [Row(k, 1, int(k % 4 == 0)) for k in range(1, 400)] + [Row(8, 1, 0), Row(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", ["op6_toxicity", "op10_language"])
def test_rows_without_an_id_are_not_held_out(spark, corpus, name):
    got = queries.QUERIES[name](spark, corpus)
    assert got.count() == 399 and got.where("held_out is null").count() == 0
    assert got.where("doc_id is null and held_out").count() == 0 and got.where("held_out").count() > 0


def test_labels_that_disagree_are_toxic_in_every_run(spark, corpus):
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    models = [toxicity.train(docs, x, F.col("doc_id") % 5 > 0) for x in (labels, labels.repartition(7), labels.where("doc_id <> 8 or toxic = 1"))]
    assert all(m.toxic == models[0].toxic and m.ordinary == models[0].ordinary and (m.weights == models[0].weights).all() for m in models)


def test_equal_texts_have_equal_scores_in_any_batch(spark, corpus):
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(toxicity.train(docs, labels, F.col("doc_id").isNotNull()))
    texts = [r.text for r in docs.limit(60).collect()] * 3
    assert scorer.scores(texts).tolist() == [scorer.scores([t])[0] for t in texts]
