"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: up to ORDER bytes of context, with the counts of the bytes that followed.
A byte's probability in a context is n / (total + kinds); the escape to the next shorter context has kinds / (total +
kinds), where kinds is the number of different bytes seen there. A context that the language hasn't is no escape; below
order 0 all 256 bytes are alike. Statistics are frozen, so a text's code length under a language is a sum over its
bytes, and the language with the shortest code wins; ties go to the first in alphabetical order.

Training counts n-grams on Spark over a bounded sample of labelled rows and merges them by key; what reaches the driver
is one count per different n-gram, bounded by the sample. In a task the trees are sparse: an n-gram and a context have an
entry for each language that has them. A slice of texts is turned into its different n-grams, whose code lengths under all
languages come from walking up the orders, adding escapes; each byte then takes its n-gram's.

A text that is null or has no letter is `und`. Repeated rows have equal results; very long texts are treated whole, in a
task's memory (some 60 bytes of numpy for a byte of text). Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_fraction, schema_of, text_bytes, text_slices
from .words import LOWER

ORDER = 3
#: Rows of each language that a model is trained on, at most about.
TRAINING_ROWS = 3000

_LETTER = regex.compile(r"\p{L}")
_trees: dict[str, Trees | None] = {}


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte, it and the ORDER bytes before it as one number, the latest lowest; newlines precede a text."""
    out = data.astype(np.int64)
    for k in range(1, ORDER + 1):
        before = np.full(len(data), 10, np.int64)
        before[k:] = data[:-k] if k < len(data) else 0
        for j in range(k):
            edge = at[:-1] + j
            before[edge[edge < np.minimum(at[1:], len(data))]] = 10
        out |= before << (8 * k)
    return out


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows (lang, text): per task first, then merged."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in text_slices(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                data, at = text_bytes(batch.filter(pa.array(langs == lang)).column("text"))
                own = held.setdefault(lang, [])
                own.append(np.unique(grams(LOWER[data], at), return_counts=True))
                if len(own) > 8:
                    own[:] = [merged(own)]
        for lang, own in held.items():
            keys, n = merged(own)
            for k in range(0, len(keys), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part])), pa.array(keys[part]), pa.array(n[part])], ["lang", "gram", "n"])

    parts = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def train(df: DataFrame, text_column: str, lang_column: str, usable: Column, rows_per_language: int = TRAINING_ROWS, key: Column | None = None) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """The languages in order and each one's n-grams and counts. Rows without text or language don't count.

    Of a language with more usable rows, those whose key hashes lowest are taken, about rows_per_language. key: a row's
    id, else its text, by which copies are taken all or none.
    """
    rows = df.where(usable & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"), F.xxhash64(F.col(text_column) if key is None else key).alias("_key"))
    sizes = {r.lang: bounded_fraction(r["n"], rows_per_language) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], []
    share = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    sample = rows.where(F.pmod("_key", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    found = count_grams(sample).toArrow()
    langs = sorted(sizes)
    out = []
    lang, gram, n = found.column("lang").combine_chunks(), found.column("gram").to_numpy(), found.column("n").to_numpy()
    names = np.array(lang.to_pylist(), object)
    for name in langs:
        own = names == name
        order = np.argsort(gram[own])
        out.append((gram[own][order], n[own][order]))
    return langs, out


class Entries(NamedTuple):
    """Values of languages by key: keys ascending, those of key k from begin[k] to begin[k + 1]."""

    keys: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Entries:
        """From each language's (keys, values)."""
        keys = np.concatenate([k for k, _ in parts])
        lang = np.repeat(np.arange(len(parts), dtype=np.int16), [len(k) for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        different, begin = np.unique(keys[order], return_index=True)
        return cls(different, np.append(begin, len(keys)), lang[order], np.concatenate([v for _, v in parts])[order].astype(np.float32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of the keys: the index of the key, the language and the value of each."""
        if not len(self.keys):
            return np.zeros(0, np.int64), self.lang, self.value
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[at] == keys)
        low, many = self.begin[at[row]], self.begin[at[row] + 1] - self.begin[at[row]]
        pick = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        return np.repeat(row, many), self.lang[pick], self.value[pick]


class Trees:
    """The trees of all languages: by order, the code lengths in bits of n-grams and of escapes from contexts."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = len(counts)
        self.levels: list[tuple[Entries, Entries]] = []
        for order in range(ORDER + 1):
            found, escapes = [], []
            for gram, many in counts:
                keys, at = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
                n = np.bincount(at, many, len(keys))
                contexts, at = np.unique(keys >> 8, return_inverse=True)
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                found.append((keys, np.log2((total + kinds)[at] / n)))
                escapes.append((contexts, np.log2((total + kinds) / kinds)))
            self.levels.append((Entries.of(found), Entries.of(escapes)))

    def gram_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each n-gram after the others, under each language."""
        out = np.full((len(grams), self.langs), 8.0, np.float32)  # of 256 bytes, all alike
        for order, (found, escapes) in enumerate(self.levels):
            for entries, keys, known in ((escapes, grams >> 8 & ((1 << 8 * order) - 1), False), (found, grams & ((1 << 8 * (order + 1)) - 1), True)):
                row, lang, value = entries.find(keys)
                if known:
                    out[row, lang] = value
                else:
                    out[row, lang] += value
        return out

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        different, which = np.unique(grams(data, at), return_inverse=True)
        bits = self.gram_lengths(different)
        out = np.empty((len(at) - 1, self.langs))
        for lang in range(self.langs):  # one at a time, so that memory doesn't grow with their number
            sums = np.concatenate(([0.0], np.cumsum(bits[which, lang], dtype=np.float64)))
            out[:, lang] = sums[at[1:]] - sums[at[:-1]]
        return out


def predict(df: DataFrame, id_column: str, text_column: str, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, the columns of keep, lang_pred, score). score is the language's share of the likelihood of all languages.

    A text that is null or has no letter is `und` with score 0, as are all texts if no language was learned.
    """
    given = df.select(id_column, *[c.alias(k) for k, c in (keep or {}).items()], F.col(text_column).alias("text"))
    others = given.columns[:-1]
    model, key = df.sparkSession.sparkContext.broadcast((langs, counts)), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = model.value
        if key not in _trees:  # a worker builds the table once
            _trees.clear()
            _trees[key] = Trees(own) if names else None
        trees = _trees[key]
        for batch in text_slices(batches, "text", 1 << 20):
            texts = batch.column("text")
            und = np.array([x is None or not _LETTER.search(x) for x in texts.to_pylist()]) | (trees is None)
            best, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if trees:
                data, at = text_bytes(texts)
                bits = trees.code_lengths(LOWER[data], at)
                best = np.argmin(bits, 1)
                share = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
            found = [None if u else names[b] for u, b in zip(und, best, strict=True)]
            columns = [pa.array([x or "und" for x in found]), pa.array(np.where(und, 0.0, share))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], [*others, "lang_pred", "score"])

    return given.mapInArrow(score, schema_of(given, others, "lang_pred string, score double"))
