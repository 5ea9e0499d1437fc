"""The corpus pipeline's decisions on documents with planted cases, and its columns on odd tables."""

import hashlib
import random

import public_tokenizers as P
import tiktoken

from pyspark.sql import functions as F

import corpus_pipeline
from terrasheet.llm import bpe


EXTRA = ["row", "row_", "spans", "base", "kept", "score", "id", "n_words", "_toxicity", "_first", "_secrets", "_merged", "component_id", "with.dot"]


def tables(spark, at, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def planted():
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices(["ba", "do", "ki", "lu", "me"], k=rng.randint(1, 4))) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        text = prose(60)
        if i % 5 == 0:
            words = text.split()
            for k in (5, 20, 40):
                words[k] = rng.choice(["blackguard", "scoundrel"])
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, 1, int(i % 5 == 0)))
    passage = prose(14)
    extra = {1000: docs[1][1], 1001: prose(30) + " " + passage + " " + prose(30), 1002: prose(20) + " password = 'hunter22hunter' " + prose(20), 1003: None, 1004: "", 1005: prose(30) + " scoundrel blackguard scoundrel " + prose(10)}
    docs += list(extra.items())
    return [(i, t, "xx", "s", len(t or "")) for i, t in docs], labels, [(1, passage), (2, None)]


def test_planted_cases(spark, tmp_path):
    docs, labels, items = planted()
    at = tables(spark, tmp_path, docs, labels, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    toxic = {i for i, _, y in labels if y} | {1005}
    assert len(toxic & got.keys()) <= 1
    clean = {d[0] for d in docs} - toxic - {1000, 1001}
    assert clean - got.keys() == set() and not {1000, 1001} & got.keys()
    ids = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(corpus_pipeline.RANKS))}, special_tokens={})
    texts = {d[0]: d[1] or "" for d in docs}
    for i in (1, 2, 1003, 1004):
        assert got[i].n_tokens == len(ids.encode_ordinary(texts[i])) and got[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()
    redacted = bpe.codec(corpus_pipeline.RANKS, P.PATTERN).decode(bytes(got[1002].ids)).decode()
    assert "hunter22" not in redacted and "<secret>" in redacted


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    docs = [(1, None, None, None, None), (1, "twice", "xx", "s", 5), (1, "twice", "xx", "s", 5), (1, "another text of this id", "xx", "s", 5)]
    docs += [(None, "no id", "xx", "s", 5), (None, "no id", "xx", "s", 5), (None, "twice", "xx", "s", 5), (2, "", "xx", "s", 0), (5, "TWICE", "xx", "s", 0), (5, "unrelated words", "xx", "s", 0)]
    at = tables(spark, tmp_path / "a", docs, [(1, 1, 0)], [(1, "some passage")])
    df = spark.read.parquet(f"{at}/documents.parquet")
    df = df.select("*", *[F.lit(c).alias(c) for c in EXTRA])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, at)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", *EXTRA], name
        assert [(r["with.dot"], r._toxicity) for r in df.select("`with.dot`", "_toxicity").distinct().collect()] == [("with.dot", "_toxicity")]
    want = [("1", "None"), ("1", "another text of this id"), ("1", "twice"), ("2", ""), ("5", "unrelated words"), ("None", "no id")]
    assert sorted((str(r.doc_id), str(r.text)) for r in df.collect()) == want
    none = tables(spark, tmp_path / "b", docs[:0], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0
