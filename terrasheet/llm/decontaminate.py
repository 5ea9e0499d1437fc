"""Benchmark decontamination by winnowing.

Documents and benchmark items are words (A-Z lower-cased; digits, a-z and everything beyond ASCII). Of the GRAM-word
grams, the one with the least hash in each run of WINDOW words is a fingerprint, the rightmost of equals. A run of
WINDOW words that a document shares with an item has the same fingerprint in both, so joining fingerprints misses none.
A hit is extended: each WINDOW-word run around it is looked up among the items' runs, and its words are compared. Items
of fewer words have no such run; all their words are one window, for which documents' grams of that length are looked up.

While the items' windows take few bytes (BROADCAST_BYTES, summed first), they go to every task and documents are read in
one pass without a shuffle. Beyond it, fingerprints are joined by a shuffle, only documents with a common one are read
again, and their windows meet the items' different windows; the items of a set of windows are looked up once for all
documents that hold just these. Both ways give the same rows.

Null and empty texts have no words and no hits; an item without words has no window. Rows are per document row. Item ids
of any simple type are compared and listed as strings; rows of one item id are one item, and an item without an id makes
hits but is neither counted nor listed. Columns' names can't clash: only the named ones are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_of, stored, text_bytes, text_slices
from .words import ALPHANUMERIC, LOWER, find_words, gram_hashes, same_text, word_hashes

WINDOW, GRAM = 10, 5
#: Bytes of items' windows that may be broadcast, and what a window takes beside its words and its item's id.
BROADCAST_BYTES, WINDOW_BYTES = 64 << 20, 200


class Words(NamedTuple):
    """The words of the texts of a batch: bytes, where each begins and ends, its text, its hash."""

    data: np.ndarray
    first: np.ndarray
    last: np.ndarray
    of: np.ndarray
    hashes: np.ndarray
    texts: int

    def bodies(self, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The words from each start, with single spaces between."""
        raw = self.data.tobytes() if len(starts) else b""
        out = []
        for s, m in zip(starts.tolist(), lengths.tolist(), strict=True):
            out.append(b" ".join(raw[self.first[k] : self.last[k]] for k in range(s, s + m)))
        return out


def words_of(column: pa.Array) -> Words:
    data, at = text_bytes(column)
    data = LOWER[data]
    first, last, of = find_words(data, at, ALPHANUMERIC)
    return Words(data, first, last, of, word_hashes(data, first, last), len(column))


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of all texts."""
    gram = gram_hashes(words.hashes, GRAM)
    windows = len(words.hashes) - WINDOW + 1
    if windows <= 0:
        return np.zeros(0, np.int64), gram[:0]
    least, where = gram[:windows].copy(), np.arange(windows)
    for k in range(1, WINDOW - GRAM + 1):
        next_one = gram[k : k + windows]
        lower = next_one <= least
        least[lower] = next_one[lower]
        where[lower] = (np.arange(windows) + k)[lower]
    at = np.unique(where[same_text(words.of, WINDOW)])
    return at, gram[at]


def window_hashes(words: Words, starts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the m words from each start."""
    rows = words.hashes[starts[:, None] + np.arange(m)].ravel()
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2
    return tuple(gram_hashes(rows, m, seed)[::m] for seed in (0, 1))


def around(words: Words, seeds: np.ndarray) -> np.ndarray:
    """The starts of the windows that hold a seed's gram, within its text."""
    starts = np.unique((seeds[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
    starts = starts[(starts >= 0) & (starts + WINDOW <= len(words.of))]
    return starts[words.of[starts] == words.of[starts + WINDOW - 1]]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True for the words inside any of the windows."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def item_windows(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item_id string, m, h1, h2, body): each window of each item once; m is its number of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            w = words_of(batch.column("text"))
            counts = np.bincount(w.of, minlength=w.texts)
            for m in [*range(1, WINDOW), WINDOW]:
                good = same_text(w.of, m)
                if m < WINDOW:
                    good &= (counts == m)[w.of[: len(good)]]
                starts = np.flatnonzero(good)
                if not len(starts):
                    continue
                h1, h2 = window_hashes(w, starts, m)
                bodies = w.bodies(starts, np.full(len(starts), m))
                ids = batch.column("item_id").take(pa.array(w.of[starts]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(starts), m, np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(bodies, pa.binary())], ["item_id", "m", "h1", "h2", "body"])

    named = items.select(F.col(id_column).cast("string").alias("item_id"), F.col(text_column).alias("text"))
    return named.mapInArrow(cut, "item_id string, m int, h1 long, h2 long, body binary").distinct()


def item_prints(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(h): the fingerprints of all items, and the hashes of short items' windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_column):
            w = words_of(batch.column(text_column))
            parts = [winnow(w)[1]]
            counts = np.bincount(w.of, minlength=w.texts)
            for m in range(1, WINDOW):
                starts = np.flatnonzero(same_text(w.of, m))
                parts.append(window_hashes(w, starts[counts[w.of[starts]] == m], m)[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(parts)).view(np.int64))], ["h"])

    return items.select(id_column, text_column).mapInArrow(cut, "h long").distinct()


class Windows:
    """The items' windows, for look-up by hash."""

    def __init__(self, rows: pa.Table, prints: np.ndarray):
        h1 = rows.column("h1").to_numpy().view(np.uint64)
        order = np.lexsort((rows.column("h2").to_numpy(), h1))
        self.h1, self.h2 = h1[order], rows.column("h2").to_numpy().view(np.uint64)[order]
        self.body = [rows.column("body")[int(k)].as_py() for k in order]
        self.item = [rows.column("item_id")[int(k)].as_py() for k in order]
        self.prints = np.sort(prints.view(np.uint64))
        self.short = sorted(set(rows.column("m").to_pylist()) - {WINDOW})

    def has(self, hashes: np.ndarray, among: np.ndarray) -> np.ndarray:
        if not len(among):
            return np.zeros(len(hashes), bool)
        return among[np.minimum(np.searchsorted(among, hashes), len(among) - 1)] == hashes

    def candidates(self, words: Words) -> list[tuple[np.ndarray, int]]:
        """Starts of possible windows, by length: around common fingerprints, and of short items' grams."""
        at, prints = winnow(words)
        out = [(around(words, at[self.has(prints, self.prints)]), WINDOW)]
        for m in self.short:
            starts = np.flatnonzero(same_text(words.of, m))
            out.append((starts[self.has(gram_hashes(words.hashes, m)[starts], self.prints)], m))
        return out

    def occurring(self, words: Words) -> tuple[np.ndarray, np.ndarray, list[list]]:
        """Starts and lengths of the windows of items that occur in the texts, and the items of each."""
        starts, lengths, items = [], [], []
        for at, m in self.candidates(words):
            h1, h2 = window_hashes(words, at, m)
            good = self.has(h1, self.h1)
            at, h1, h2 = at[good], h1[good], h2[good]
            lo, hi = np.searchsorted(self.h1, h1, "left"), np.searchsorted(self.h1, h1, "right")
            for s, second, a, b, body in zip(at.tolist(), h2, lo.tolist(), hi.tolist(), words.bodies(at, np.full(len(at), m)), strict=True):
                own = [self.item[k] for k in range(a, b) if self.h2[k] == second and self.body[k] == body]
                if own:
                    starts.append(s)
                    lengths.append(m)
                    items.append(own)
        return np.array(starts, np.int64), np.array(lengths, np.int64), items


_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def report(words: Words, starts: np.ndarray, lengths: np.ndarray, items: list[list]) -> list[pa.Array]:
    hit = covered(starts, lengths, len(words.of))
    n_hit = np.bincount(words.of[hit], minlength=words.texts)
    found: list[set] = [set() for _ in range(words.texts)]
    for s, own in zip(starts.tolist(), items, strict=True):
        found[words.of[s]].update(x for x in own if x is not None)
    return [pa.array(np.bincount(words.of, minlength=words.texts)), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array([digest(x) for x in found]), pa.array(n_hit > 0)]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each document.

    n_hit: words inside an occurrence of an item's window; n_items: items with such a window; items_sha256: their ids,
    sorted as strings and comma-joined, hashed.
    """
    windows = stored(item_windows(items, item_id, item_text), "item-windows")
    schema = schema_of(docs, [doc_id], "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    size = windows.agg(F.sum(F.octet_length("body") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + WINDOW_BYTES)).first()[0] or 0
    if size > broadcast_bytes:
        return _by_shuffle(docs, items, windows, doc_id, doc_text, item_id, item_text)
    prints = item_prints(items, item_id, item_text).toArrow().column("h").to_numpy()  # fewer than the windows
    known = docs.sparkSession.sparkContext.broadcast(Windows(windows.toArrow(), prints))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, doc_text):
            words = words_of(batch.column(doc_text))
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), *report(words, *known.value.occurring(words))], [doc_id, *_NAMES])

    return docs.select(doc_id, doc_text).mapInArrow(scan, schema)


def _by_shuffle(docs: DataFrame, items: DataFrame, windows: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str) -> DataFrame:
    """The same through shuffles: fingerprints are joined, then the windows of documents with common ones."""
    short = sorted(r.m for r in windows.where(F.col("m") < WINDOW).select("m").distinct().collect())

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            w = words_of(batch.column("text"))
            at, h = winnow(w)
            of, hashes = [w.of[at]], [h]
            for m in short:
                starts = np.flatnonzero(same_text(w.of, m))
                of.append(w.of[starts])
                hashes.append(gram_hashes(w.hashes, m)[starts])
            rows = np.unique(np.rec.fromarrays([np.concatenate(of), np.concatenate(hashes)]))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows["f0"].copy())), pa.array(rows["f1"].copy().view(np.int64))], ["row", "h"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            w = words_of(batch.column("text"))
            own = [np.sort(np.array(x, np.int64).view(np.uint64)) for x in batch.column("common").to_pylist()]

            def common(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
                cuts = np.searchsorted(of, np.arange(w.texts + 1))
                return np.concatenate([np.isin(hashes[a:b], x) for x, a, b in zip(own, cuts, cuts[1:], strict=False)] + [np.zeros(0, bool)])

            at, h = winnow(w)
            parts = [(around(w, at[common(h, w.of[at])]), WINDOW)]
            for m in short:
                starts = np.flatnonzero(same_text(w.of, m))
                parts.append((starts[common(gram_hashes(w.hashes, m)[starts], w.of[starts])], m))
            for starts, m in parts:
                h1, h2 = window_hashes(w, starts, m)
                begin = np.searchsorted(w.of, w.of[starts])
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(w.of[starts])), pa.array(starts - begin), pa.array(np.full(len(starts), m, np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(w.bodies(starts, np.full(len(starts), m)), pa.binary())], ["row", "at", "m", "h1", "h2", "body"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            w = words_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(np.bincount(w.of, minlength=w.texts))], ["row", "id", "n_words"])

    rows = stored(docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    common = rows.select("row", "text").mapInArrow(prints, "row long, h long").join(item_prints(items, item_id, item_text), "h", "left_semi")
    again = rows.select("row", "text").join(common.groupBy("row").agg(F.collect_set("h").alias("common")), "row")
    # different windows, each with a key for its set of items; a common window is one row here, whatever the items
    as_key = lambda c: F.sha2(F.to_json(c), 256)
    held = windows.groupBy("h1", "h2", "m", "body").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("key", as_key(F.col("items")))
    held = stored(held, "window-items")
    hits = again.select("row", "text", "common").mapInArrow(candidates, "row long, at long, m int, h1 long, h2 long, body binary").join(held.select("h1", "h2", "m", "body", "key"), ["h1", "h2", "m", "body"])
    spans = F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("m")).alias("to"))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    cover = F.aggregate(spans, none, lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(acc["to"], x["at"]))).alias("n"), F.greatest(acc["to"], x["to"]).alias("to")), lambda acc: acc["n"])
    found = stored(hits.groupBy("row").agg(cover.alias("n_hit"), F.array_sort(F.collect_set("key")).alias("keys")).withColumn("sets", as_key(F.col("keys"))), "decontamination-hits")
    sets = found.select("sets", "keys").dropDuplicates(["sets"]).select("sets", F.explode("keys").alias("key"))
    listed = sets.join(held.select("key", "items").dropDuplicates(["key"]), "key").groupBy("sets").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    listed = listed.select("sets", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = found.select("row", "n_hit", "sets").join(listed, "sets")
    out = rows.select("row", "id", "text").mapInArrow(sizes, schema_of(rows, ["row", "id"], "n_words long")).join(found, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(doc_id), "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
