"""Toxicity by compression distance: two zstandard dictionaries, one of toxic text and one of ordinary text.

A text is words (A-Z lower-cased; digits, a-z and everything beyond ASCII). A window is WINDOW words, and the next one
begins STRIDE words on. Every window is compressed with both dictionaries; its distance is the number of bytes that it
takes less with the toxic one. Each dictionary has words of its own class, then a tail: content that zstandard's trainer
picks from ordinary windows, the same in both. Ordinary text finds its matches in the tail, at the same cost in both, so
what the distance shows is the class. (Without a common tail, the two dictionaries' luck with ordinary words hides the
few toxic ones.) The last bytes of a block are never matched, so every window ends with PAD.

Training, on a bounded sample of labelled rows (LABELLED of each label, about), of which two thirds make the
dictionaries and the rest, which those have not seen, calibrates:

1. Document frequencies of words and of their beginnings, by label. Those that the labels' likelihood ratio test finds
   in toxic rows far more often mark toxic words. The toxic dictionary begins with all marked words, the frequent last;
   the ordinary one begins with as many bytes of the most frequent other words.
2. zstandard trains the tail on TAIL_WINDOWS windows, about, of ordinary rows that hold no marked word.
3. A logistic regression of how many of a row's windows reach each threshold of distance gives the score.

Labels are joined to rows; language, source and id aren't looked at. Null and empty texts, and texts without words, have
no window; their score is the share of label 1 among the calibrating rows. Without labels of both kinds every score is 0.
Rows are scored one by one in one pass without a shuffle; equal texts have equal scores. A very long text is read in
pieces, so that memory doesn't grow with its number of windows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import batched
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_fraction, schema_of, stored, text_slices
from .words import ALPHANUMERIC, LOWER

#: Labelled rows of each label that the classifier is fitted on, at most about.
LABELLED = 6000
#: Words of a window, and from one to the next (half of it).
WINDOW, STRIDE = 6, 3
#: Bytes of the tail, windows that it is trained on, about, and words of such a window.
TAIL_BYTES, TAIL_WINDOWS, TAIL_WORDS = 65_536, 200_000, 3
#: A mark of toxic words: least likelihood ratio statistic, least ratio of the document frequencies, least rows.
LEAST_G2, LEAST_RATIO, LEAST_ROWS = 16.0, 8.0, 3
#: Distances at which windows are counted; those beyond count as the last one.
NEAREST, FARTHEST = -2, 5
#: Bytes of text that a task holds at once, and in which a long text is read.
SLICE, PIECE = 1 << 20, 1 << 20

PAD = b"\n" * 8
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_PLAIN = np.where(ALPHANUMERIC[LOWER], LOWER, 32).astype(np.uint8).tobytes()


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray  # of the features
    share: float  # of label 1, for texts without windows


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").encode().lower().decode())


def beginnings(word: str) -> set[str]:
    """A word's beginnings of three characters or more, and the whole word, which ends with a space."""
    return {word[:k] for k in range(3, len(word))} | {f"{word} "}


def runs(text: str | None, size: int) -> Iterator[bytes]:
    """The words of a text, `size` at a time, with single spaces between."""

    def one_by_one() -> Iterator[bytes]:
        data, at = (text or "").encode().translate(_PLAIN), 0
        while at < len(data):
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
            yield from data[at:end].split()
            at = end

    return map(b" ".join, batched(one_by_one(), size))


def windows(text: str | None) -> Iterator[bytes]:
    """The windows of a text: two runs of STRIDE words each, or its only one."""
    parts = runs(text, STRIDE)
    last, many = next(parts, None), False
    for part in parts:
        yield b" " + last + b" " + part + b" " + PAD
        last, many = part, True
    if last is not None and not many:
        yield b" " + last + b" " + PAD


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    # greedy: a cost-based search takes literals for cheap, which in so short a block they aren't
    log = max(14, (len(content) - 1).bit_length())
    params = zstandard.ZstdCompressionParameters(window_log=log + 1, hash_log=log, chain_log=log, search_log=6, min_match=5, strategy=zstandard.STRATEGY_GREEDY, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=params)


class Distances:
    """Compresses the windows of texts with both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary).compress, compressor(toxic).compress

    def of(self, text: str | None) -> list[int]:
        return [len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text)]

    def counts(self, text: str | None) -> np.ndarray:
        """How many windows have each distance from NEAREST (or less) to FARTHEST (or more)."""
        out = np.zeros(FARTHEST - NEAREST + 1, np.int64)
        for part in batched((len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text)), 1 << 16):
            out += np.bincount(np.clip(np.array(part), NEAREST, FARTHEST) - NEAREST, minlength=len(out))
        return out


def frequencies(rows: DataFrame) -> DataFrame:
    """(unit, toxic, ordinary): documents of each label that hold a word or a beginning. Counted in tasks, then by key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(), Counter()
        for batch in text_slices(batches, "text", SLICE):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                held[label].update(set().union(*map(beginnings, set(words(text)))))
            if sum(map(len, held)) > 200_000:
                yield from emitted(*held)
                held = Counter(), Counter()
        yield from emitted(*held)

    def emitted(ordinary: Counter, toxic: Counter) -> Iterator[pa.RecordBatch]:
        units = list(ordinary.keys() | toxic.keys())
        for k in range(0, len(units), 1 << 15):
            part = units[k : k + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[u] for u in part], pa.int64()), pa.array([ordinary[u] for u in part], pa.int64())], ["unit", "toxic", "ordinary"])

    parts = rows.mapInArrow(count, "unit string, toxic long, ordinary long")
    return parts.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def g2(hits: Column, rows: int, other_hits: Column, other_rows: int) -> Column:
    """Twice the logarithm of the likelihood ratio of two frequencies against one."""

    def part(k: Column, n: int, p: Column) -> Column:
        term = lambda x, q: F.when(x > 0, x * F.log(q)).otherwise(0.0)
        return term(k, p) + term(F.lit(n) - k, 1 - p)

    both = (hits + other_hits) / (rows + other_rows)
    return 2 * (part(hits, rows, hits / rows) + part(other_hits, other_rows, other_hits / other_rows) - part(hits, rows, both) - part(other_hits, other_rows, both))


def tail_of(samples: list[bytes], size: int = TAIL_BYTES) -> bytes:
    """zstandard's dictionary of the samples, a quarter of them in bytes at most; their end if they are too few to train on."""
    size = min(size, sum(map(len, samples)) // 4)
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=50, d=6).as_bytes()
        except zstandard.ZstdError:  # too few samples for this size
            size //= 2
    return b"".join(samples)[-TAIL_BYTES:]


def dictionaries(rows: DataFrame, toxic_rows: int, ordinary_rows: int) -> tuple[bytes, bytes]:
    """The content of the ordinary dictionary and of the toxic one, from rows (text, label): bounded, as the sample."""
    units = stored(frequencies(rows), "toxicity-units")
    ratio = F.col("toxic") / toxic_rows / ((F.col("ordinary") + 0.5) / ordinary_rows)
    test = g2(F.col("toxic"), toxic_rows, F.col("ordinary"), ordinary_rows)
    found = units.where(F.col("toxic") >= LEAST_ROWS).where(ratio > LEAST_RATIO).where(test >= LEAST_G2)
    marks = {r.unit for r in found.select("unit").collect()}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("marked", pa.array([not marks.isdisjoint(beginnings(u[:-1])) for u in batch.column("unit").to_pylist()], pa.bool_()))

    whole = units.where(F.col("unit").endswith(" ")).mapInArrow(marked, "unit string, toxic long, ordinary long, marked boolean")
    bad = [f" {r.unit}" for r in whole.where("marked and toxic > 0").orderBy("toxic", "unit").collect()]
    toxic = "".join(bad).encode()
    common = whole.where("not marked and ordinary > 0").orderBy(F.desc("ordinary"), "unit").limit(len(toxic) // 3).collect()  # a word takes three bytes or more
    ordinary = "".join(f" {r.unit}" for r in reversed(common)).encode()
    size = min(len(toxic), len(ordinary)) if ordinary else 0

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            for text in batch.column("text").to_pylist():
                for part in batched(runs(text, TAIL_WORDS), 1 << 14):
                    kept = [b" " + w + b" " for w in part if all(marks.isdisjoint(beginnings(x)) for x in w.decode().split())]
                    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["run"])

    plain = stored(rows.where("label = 0").select("text").mapInArrow(clean, "run binary"), "toxicity-runs")
    share = bounded_fraction(plain.count(), TAIL_WINDOWS)
    samples = plain.where(F.pmod(F.xxhash64("run"), F.lit(1 << 20)) < int(share * (1 << 20))).toArrow().column("run").to_pylist()
    tail = tail_of(sorted(samples))
    return (ordinary[-size:] if size else b"") + tail, toxic[-size:] + tail


def distances_of(rows: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """(label, counts): how many of each row's windows have each distance."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Distances(ordinary, toxic)
        for batch in text_slices(batches, "text", SLICE):
            counts = [own.counts(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(counts, pa.list_(pa.int64()))], ["label", "counts"])

    return rows.mapInArrow(measure, "label int, counts array<long>")


def features(counts: np.ndarray) -> np.ndarray:
    """1, then logarithms of 1 + a number: of windows at each distance above 0 or farther, below 0 or nearer, of all.

    counts: texts x distances.
    """
    zero = -NEAREST
    far = np.cumsum(counts[:, :zero:-1], axis=1)
    near = np.cumsum(counts[:, :zero], axis=1)
    return np.hstack([np.ones((len(counts), 1)), np.log1p(np.hstack([far, near, counts.sum(1, keepdims=True)]))])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method; a small penalty keeps them finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(rows: DataFrame, ordinary: bytes, toxic: bytes) -> Model:
    """The weights of the features, from rows (text, label)."""
    found = distances_of(rows, ordinary, toxic).toArrow().combine_chunks()  # bounded, as the sample
    y = found.column("label").to_numpy().astype(float)
    counts = np.array(found.column("counts").to_pylist(), np.int64).reshape(-1, FARTHEST - NEAREST + 1)
    has = counts.sum(1) > 0
    weights = logistic(features(counts[has]), y[has])
    return Model(ordinary, toxic, weights, float(y.mean()) if len(y) else 0.0)


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most: int = LABELLED) -> Model | None:
    """Fits the model to labelled rows for which usable(id) holds; None if they haven't both labels.

    An id with both labels is toxic; rows without an id aren't learned from. Of a label with more rows than `most`, those whose id hashes lowest are taken, about `most`; equal texts count once.
    """
    known = labels.where(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("label")).where("_id is not null").groupBy("_id").agg(F.max("label").alias("label"))
    sizes = {r.label: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("label") == 1, bounded_fraction(sizes[1], most)).otherwise(bounded_fraction(sizes[0], most))
    known = stored(known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share * (1 << 20)), "toxicity-labels")
    known = F.broadcast(known) if known.count() <= 8 * most else known  # ids and labels of the sample only
    rows = docs.where(usable).select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).join(known, "_id")
    sample = stored(rows.select("text", "label", F.xxhash64("text").alias("part")).dropDuplicates(["part", "label"]), "toxicity-sample")
    seen = F.pmod("part", F.lit(3)) > 0
    first = sample.where(seen)
    has = {r.label: r["n"] for r in first.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(has) < 2:
        return None
    return calibrated(sample.where(~seen).select("text", "label"), *dictionaries(first.select("text", "label"), has[1], has[0]))


_loaded: dict[str, Scorer] = {}


class Scorer:
    def __init__(self, model: Model):
        self.model, self.distances = model, Distances(model.ordinary, model.toxic)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        counts = np.array([self.distances.counts(t) for t in texts]).reshape(-1, FARTHEST - NEAREST + 1)
        # summed row by row and rounded, so that a text's score doesn't depend on the others of its batch
        found = 1 / (1 + np.exp(-np.clip((features(counts) * self.model.weights).sum(1).round(9), -30, 30)))
        return np.where(counts.sum(1) > 0, found, self.model.share).round(12)


def toxicity(docs: DataFrame, model: Model | None, text_column: str = "text", output: str = "score") -> DataFrame:
    """docs with a column `output` (double, 0 to 1: the likelihood of the label 1), in place of one of that name."""
    kept = [c for c in docs.columns if c != output]
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded and shared.value is not None:
            _loaded.clear()
            _loaded[key] = Scorer(shared.value)
        own = _loaded.get(key)
        for batch in text_slices(batches, text_column, SLICE):
            scores = own.scores(batch.column(text_column).to_pylist()) if own else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*kept, output])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema_of(docs, kept, f"`{output}` double"))
