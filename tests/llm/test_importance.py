"""Importance resampling against plain loops with zlib's checksum."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from terrasheet.llm import importance


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, target, buckets, least_words, percent, seed):
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s = Counter(bucket(w) for _, t in docs for w in words(t))
    t = Counter(bucket(w) for x in target for w in words(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        w = words(text)
        weight = sum(gain[bucket(x)] for x in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    most = percent * len(able) // 100
    ranks = sorted((*r, k + 1) for k, r in enumerate(able[:most]))
    drawn = Counter(r[:4] for r in ranks)
    rest = []
    for r in rows:
        if drawn[r]:
            drawn[r] -= 1
        else:
            rest.append((*r, None))
    return sorted(ranks + rest, key=repr)


def check(spark, docs, target, buckets=97, least_words=3, percent=40, seed=2024):
    d = spark.createDataFrame([Row(i, t, "x", 5) for i, t in docs], "doc_id long, text string, digest string, n int")
    b = spark.createDataFrame([Row(t) for t in target], "text string")
    got = importance.resample(d, b, buckets=buckets, seed=seed, least_words=least_words, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, buckets, least_words, percent, seed)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB9é漢 _\0") | st.characters(exclude_categories=["Cs"]), max_size=120), max_size=6))
def test_checksums_equal_zlib(texts):
    found, counts = importance.slice_buckets(pa.array(texts, pa.string()), 65_537)
    want = [[zlib.crc32(w.encode()) % 65_537 for w in words(t)] for t in texts]
    assert found.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_long_words():
    texts = ["a" * k for k in range(1, 120)] + ["b" * 100_000 + " c"]
    found, _ = importance.slice_buckets(pa.array(texts), 1 << 16)
    assert found.tolist() == [zlib.crc32(w.encode()) % (1 << 16) for t in texts for w in words(t)]


def test_resample_equals_plain_loops(spark):
    draw = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "漢字", "UPPER"]
    docs = [(k, " ".join(draw.choice(vocabulary, draw.integers(0, 30)))) for k in range(120)]
    docs += [(k, "the very same text of many copies") for k in range(1000, 1200)] + [(7, docs[7][1]), (500, None), (501, ""), (None, "one two three four"), (502, "x " * 5000)]
    check(spark, docs, [" ".join(draw.choice(vocabulary, 40)) for _ in range(5)] + [None, "W1"])


def test_more_buckets_than_two_bytes_hold(spark):
    check(spark, [(k, f"some words of document {k} and more") for k in range(40)], ["other words of document 3"], buckets=100_003)


def test_ties_go_to_smaller_ids(spark):
    check(spark, [(k, "same words in all of them") for k in range(300)] + [(5, "same words in all of them")] * 3, ["them"], percent=50)


def test_none_and_all_are_drawn(spark):
    docs = [(k, f"a b c d{k}") for k in range(9)]
    check(spark, docs, ["c"], percent=0)
    check(spark, docs, ["c"], percent=100)
    check(spark, docs, ["c"], least_words=50)
    check(spark, docs, [])
    check(spark, docs, ["c"], least_words=0)


def test_empty_corpus(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(d, d.select("text")).collect() == []
