"""Merge rounds against the library: ids, texts, digests, on corpus texts, the model's own pieces and odd characters."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from terrasheet.llm import piece_bpe, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CODEC = piece_bpe.codec(MODEL)


def ids_of(texts):
    return [np.frombuffer(x, "<i4").tolist() for x in CODEC.encode(texts)]


def test_every_piece_and_runs():
    texts = [CODEC.model.id_to_piece(i) for i in range(CODEC.model.vocab_size())]
    texts += [c * k for c in " a=-0é漢" for k in (1, 2, 3, 7, 16, 17, 33, 100, 1001)]
    assert ids_of(texts) == CODEC.model.encode(texts)


def test_pieces_in_random_order():
    draw = random.Random(7)
    pieces = [CODEC.model.id_to_piece(i) for i in range(259, CODEC.model.vocab_size())]
    texts = ["".join(draw.choices(pieces, k=draw.randint(1, 25))) for _ in range(3000)]
    assert ids_of(texts) == CODEC.model.encode(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" ▁a\n\0"), max_size=40), max_size=5))
def test_any_text(texts):
    got = ids_of(texts)
    assert got == CODEC.model.encode(texts)
    for ids in got:
        assert CODEC.decode(np.array(ids, np.int32), most=3) == CODEC.model.decode(ids)


def test_out_of_order_words_are_done_one_by_one():
    """Runs of marks: the pair of two has the worst score, those of longer runs have better ones."""
    pieces = CODEC.pieces
    for k in range(2, 70):
        text = piece_bpe.MARK * k
        alone = pieces.one_by_one([int(pieces.char[ord(piece_bpe.MARK)])] * k)
        assert alone == CODEC.model.encode(text[1:])  # the library puts one before


def test_long_texts_in_parts(monkeypatch):
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab 漢字\n", k=30_000)), "x" * 70_000, " " * 5000, "".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(50_000))]
    want = CODEC.model.encode(texts)
    monkeypatch.setattr(piece_bpe, "PART", 1000)
    assert ids_of(texts) == want
    for t, ids in zip(texts, want, strict=True):
        assert CODEC.decode(np.array(ids, np.int32), most=500) == t


def test_forgetting_changes_nothing(monkeypatch):
    texts = ["some words here", "other words there", "some words here"]
    want = CODEC.model.encode(texts)
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 0)
    assert [ids_of([t])[0] for t in texts] == want


def test_query_equals_the_library(spark):
    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op11_sentencepiece"](spark, at).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        ids = CODEC.model.encode(text)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(CODEC.model.decode(ids).encode()).hexdigest())
        assert (got[key].n_tokens, got[key].ids_sha256, got[key].decoded_sha256) == want


def test_odd_rows(spark):
    schema = "key long, text string, ids int, n_tokens string"
    rows = [Row(1, None, 5, "x"), Row(2, "", 5, None), Row(None, "a b", None, "x"), Row(None, "a b", None, "x")]
    df = spark.createDataFrame(rows, schema)
    back = piece_bpe.decode_ids(piece_bpe.encode_texts(df, "key", "text", MODEL), "key", "ids", MODEL)
    assert back.columns == ["key", "n_tokens", "ids_sha256", "decoded"]
    got = sorted(((r.key or 0), r.n_tokens, r.decoded) for r in back.collect())
    assert got == [(0, 2, "a b"), (0, 2, "a b"), (1, 0, ""), (2, 0, "")]
    assert piece_bpe.encode_texts(df.limit(0), "key", "text", MODEL).collect() == []
    with pytest.raises(ValueError):
        piece_bpe.encode_texts(df, "ids", "text", MODEL)
