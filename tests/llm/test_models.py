"""Toxicity and language identification on small made-up texts."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasheet.llm import language_id, queries, toxicity

SYLLABLES = {"xx": ["ba", "do", "ki", "lu", "me"], "yy": ["sch", "ung", "ein", "ach", "ver"]}


def prose(rng, kind, n):
    return " ".join("".join(rng.choices(SYLLABLES[kind], k=rng.randint(1, 4))) for _ in range(n))


def labelled(rows=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        toxic = i % 5 == 0
        words = prose(rng, "xx", 60).split()
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["zounds", "blackguard", "knave", "scoundrel"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxic_words_are_found_on_unseen_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 4 != 1)
    fresh = labelled(200, 9)
    odd = [(1000, None), (1001, ""), (1002, "!!"), (1003, "x" * 100_000), (1004, fresh[0][1]), (1005, fresh[0][1])]
    df = spark.createDataFrame([(i, t, "s") for i, t, _ in fresh] + [(i, t, "s") for i, t in odd], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.toxicity(df, model).collect()}
    assert all(0 <= v <= 1 for v in got.values())
    assert sum((got[i] >= 0.7) == bool(y) for i, _, y in fresh) >= 196
    assert got[1004] == got[1005] == got[0] and got[1000] == got[1001] == got[1002] < 0.7


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert model is None and toxicity.toxicity(docs, model).first().score == 0.0
    assert toxicity.toxicity(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels.limit(0), F.lit(True)) is None


def test_windows_cover_all_words():
    w = lambda *x: b" " + " ".join(x).encode() + b" " + toxicity.PAD
    assert list(toxicity.windows("One, TWO\nthree")) == [w("one", "two", "three")]
    assert list(toxicity.windows("a b c d e f g h")) == [w(*"abcdef"), w(*"defgh")]
    assert list(toxicity.windows(None)) == list(toxicity.windows("")) == list(toxicity.windows("!?")) == []
    long = " ".join(f"w{k}" for k in range(400_000))  # several pieces
    words = long.split()
    assert list(toxicity.windows(long)) == [w(*words[k : k + 6]) for k in range(0, 400_000 - 3, 3)]


def test_distances_are_the_differences_of_two_compressed_lengths():
    """Brute force: each window by a compressor of its own, made anew."""
    rng = random.Random(4)
    ordinary, tail = (prose(rng, "xx", n).encode() for n in (40, 400))
    ordinary, toxic = ordinary + tail, b" knave  scoundrel  blackguard " + tail
    text = prose(rng, "xx", 50) + " Scoundrel! " + prose(rng, "yy", 20)
    own = toxicity.Distances(ordinary, toxic)
    brute = [len(toxicity.compressor(ordinary).compress(w)) - len(toxicity.compressor(toxic).compress(w)) for w in toxicity.windows(text)]
    assert own.of(text) == brute and max(brute) >= 3
    near = [min(max(d, toxicity.NEAREST), toxicity.FARTHEST) for d in brute]
    assert own.counts(text).tolist() == [near.count(d) for d in range(toxicity.NEAREST, toxicity.FARTHEST + 1)]
    x = toxicity.features(own.counts(text)[None])[0]
    want = [math.log1p(sum(d >= k for d in near)) for k in range(toxicity.FARTHEST, 0, -1)] + [math.log1p(sum(d <= k for d in near)) for k in range(toxicity.NEAREST, 0)]
    assert x.tolist() == pytest.approx([1.0, *want, math.log1p(len(near))])


def test_toxic_dictionary_holds_all_marked_words_and_both_share_a_tail(spark):
    rng = random.Random(5)
    toxic = ["".join(rng.choices("fghjpqrstwxz", k=11)) for _ in range(400)]
    rows = [(f"{prose(rng, 'xx', 20)} {' '.join(toxic[k % 20 * 20 : k % 20 * 20 + 20]) if k < 700 else ''}", int(k < 700)) for k in range(1400)]
    ordinary, own = toxicity.dictionaries(spark.createDataFrame(rows, "text string, label int"), 700, 700)
    assert all(f" {w} ".encode() in own and f" {w} ".encode() not in ordinary for w in toxic)
    assert own[-200:] == ordinary[-200:]
    assert min(toxicity.Distances(ordinary, own).of(" ".join(toxic))) > 3


def test_prediction_is_more_than_a_word_list(spark):
    """Words that training never saw as such, but whose beginnings are toxic, are found, where a list of words finds none."""
    stems = ["zoundq", "blackguarx", "knavish", "scoundrw"]
    rng = random.Random(7)

    def rows(n, start):
        out = []
        for i in range(n):
            words = prose(rng, "xx", 60).split()
            if i % 4 == 0:
                for _ in range(4):
                    words[rng.randrange(60)] = rng.choice(stems) + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4))
            out.append((start + i, " ".join(words), int(i % 4 == 0)))
        return out

    known, fresh = rows(600, 0), rows(200, 10_000)
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([r[:2] for r in known], schema)
    labels = spark.createDataFrame([(i, y) for i, _, y in known], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.toxicity(spark.createDataFrame([r[:2] for r in fresh], schema), model).collect()}
    listed = {w for _, t, y in known if y for w in t.split()} - {w for _, t, y in known if not y for w in t.split()}
    by_list = sum(y for _, t, y in fresh if any(w in listed for w in t.split() if w[:6] in {s[:6] for s in stems}))
    caught = sum(got[i] for i, _, y in fresh if y)
    assert caught >= 45 and caught > by_list and sum(got[i] for i, _, y in fresh if not y) <= 2


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/labels.parquet"), reason="no tables")
def test_held_out_rows_of_the_tables(spark):
    at = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [(r.predicted, truth[r.doc_id]) for r in queries.op6_toxicity(spark, at).collect() if r.held_out and truth.get(r.doc_id) is not None]
    hits = sum(p and y for p, y in rows)
    assert hits >= 0.75 * sum(y for _, y in rows) and hits >= 0.9 * sum(p for p, _ in rows)


def scalar_bits(texts, text):
    """The code length of a text under the PPM model of some texts, a byte at a time."""
    counts = {}
    for t in texts:
        data = b"\n" * language_id.ORDER + t.encode().lower()
        for k in range(language_id.ORDER, len(data)):
            for order in range(language_id.ORDER + 1):
                own = counts.setdefault(data[k - order : k], {})
                own[data[k]] = own.get(data[k], 0) + 1
    total, data = 0.0, b"\n" * language_id.ORDER + text.encode().lower()
    for k in range(language_id.ORDER, len(data)):
        for order in range(language_id.ORDER, -1, -1):
            own = counts.get(data[k - order : k])
            if own is None:
                continue
            if data[k] in own:
                total += math.log2((sum(own.values()) + len(own)) / own[data[k]])
                break
            total += math.log2((sum(own.values()) + len(own)) / len(own))
        else:
            total += 8
    return total


def test_code_lengths_against_a_scalar_model(spark):
    rng = random.Random(6)
    known = {k: [prose(rng, k, 30) + " é漢" for _ in range(4)] for k in ("xx", "yy")}
    docs = spark.createDataFrame([(t, k) for k, own in known.items() for t in own], "text string, lang string")
    langs, counts = language_id.train(docs, "text", "lang", F.lit(True))
    texts = ["", "Ba", "schungein ba do", "q?🙂 é漢é", prose(rng, "xx", 60), prose(rng, "yy", 60)]
    data, at = language_id.text_bytes(pa.array(texts))
    got = language_id.Trees(counts).code_lengths(language_id.LOWER[data], at)
    want = [[scalar_bits(known[k], t) for k in langs] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_language_of_a_text_longer_than_a_slice(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, prose(rng, k, 40), k) for i in range(20) for k in ("xx", "yy")], "doc_id long, text string, lang string")
    model = language_id.train(docs, "text", "lang", F.lit(True))
    long = prose(rng, "xx", 400_000)
    df = spark.createDataFrame([(1, long), (2, long), (3, "z" * 3_000_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.predict(df, "doc_id", "text", *model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == "xx" and rows[1].score == rows[2].score


def test_language_id(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, k, 40), k, "en") for i in range(120) for k in ("xx", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string")
    model = language_id.train(docs, "text", "lang", F.col("doc_id") % 4 != 0)
    texts = [None, "", "123 !", "schungein", "badoki", prose(rng, "xx", 5000), "ungverach", "ungverach"]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in language_id.predict(df, "doc_id", "text", *model).collect()}
    assert [got[i].lang_pred for i in range(8)] == ["und", "und", "und", "yy", "xx", "xx", "yy", "yy"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].score == 0
    own = language_id.predict(docs.where("doc_id % 4 = 0"), "doc_id", "text", *model, keep={"lang": F.col("lang")}).collect()
    assert all(r.lang == r.lang_pred for r in own)
    nothing = language_id.train(docs.limit(0), "text", "lang", F.lit(True))
    assert {r.lang_pred for r in language_id.predict(df, "doc_id", "text", *nothing).collect()} == {"und"}
    assert language_id.predict(df.limit(0), "doc_id", "text", *model).count() == 0
