"""Importance resampling towards a target: hashed word features, one weight a text, noise of each document.

Identical texts are collapsed by grouping the full text, so a text's words are found and its weight is summed once however
many copies there are; its counts are multiplied by the number of copies. Words of many texts are found and hashed together
in numpy arrays. The buckets of a text's words are written to the shared folder: counts and weights are sums over them, and
no text is read again. Weights come back to the documents by the digest of their text; a text of very many documents is a
skewed key there, which Spark's adaptive join splits, as nothing but the drawing follows it.

Drawing is by the Gumbel trick: the highest of weight plus noise, where the noise is a function of the document's id. Scores
are whole numbers, so a histogram of them (bounded by the range of gains and noise, not by the documents) gives the least
score that is drawn. Only documents of that score or more are sorted, over range partitions, and numbered by partition.

Null text has no words, weight 0, and is never drawn unless the least number of words is 0. A null doc_id is hashed as an
empty string and comes last among ties. Repeated rows are documents of their own, with equal scores. An empty target or
corpus gives gains by the formula, with counts of 0. Extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import schema_of, stored, text_bytes, text_slices
from .words import ALPHANUMERIC, LOWER, find_words

#: The registered query's parameters: buckets, seed of the noise, least words of a drawn document, percent that is drawn.
BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Words up to this many bytes are hashed together, byte by byte; longer ones singly.
LONG_WORD = 48


def crc_table() -> np.ndarray:
    """What the checksum's register becomes by each byte: the polynomial 0xEDB88320, eight times."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = crc_table()


def word_checksums(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """zlib's crc32 of each word of data, all words together: a step takes the next byte of the words that have one."""
    size = last - first
    order = np.argsort(-size, kind="stable")
    at, size = first[order], size[order]
    out = np.full(len(first), 0xFFFFFFFF, np.uint32)
    long = int(np.count_nonzero(size > LONG_WORD))
    for k in range(long):
        out[k] = zlib.crc32(data[at[k] : at[k] + size[k]]) ^ 0xFFFFFFFF
    more = np.cumsum(np.bincount(np.minimum(size, LONG_WORD), minlength=LONG_WORD + 1)[::-1])[::-1]  # words of k bytes or more
    for k in range(LONG_WORD):
        to = int(more[k + 1])
        if to <= long:
            break
        part = out[long:to]
        out[long:to] = CRC[(part ^ data[at[long:to] + k]) & 0xFF] ^ part >> 8
    back = np.empty_like(out)
    back[order] = out ^ np.uint32(0xFFFFFFFF)
    return back


def slice_buckets(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of these texts, and how many words each text has."""
    data, at = text_bytes(column)
    data = LOWER[data]
    first, last, of = find_words(data, at, ALPHANUMERIC)
    return word_checksums(data, first, last) % np.uint32(buckets), np.bincount(of, minlength=len(column)).astype(np.int64)


def stored_as(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def with_buckets(texts: DataFrame, text: str, buckets: int) -> DataFrame:
    """The rows of texts with `features` in the place of the text: the buckets of its words, in their order."""
    others = [c for c in texts.columns if c != text]
    schema = schema_of(texts, others, "features binary")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            found, counts = slice_buckets(batch.column(text), buckets)
            data = found.astype(stored_as(buckets)).tobytes()
            ends = (np.cumsum(counts) * stored_as(buckets).itemsize).tolist()
            rows = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(rows, pa.binary())], [*others, "features"])

    return texts.mapInArrow(find, schema)


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in `features`, each row n times. A task sends a row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_slices(batches, "features"):
            data, at = text_bytes(batch.column("features"))
            size = np.diff(at) // stored_as(buckets).itemsize
            own, times = np.frombuffer(data.tobytes(), stored_as(buckets)), np.repeat(batch.column("n").to_numpy(), size)
            order = np.argsort(own, kind="stable")
            sums = np.append(0, np.cumsum(times[order]))  # whole numbers: bincount's weights are doubles
            edges = np.searchsorted(own[order], np.arange(buckets + 1))
            total += sums[edges[1:]] - sums[edges[:-1]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = found.select("n", "features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: 1000 times the logarithm of its smoothed share in the target over that in the source, rounded down."""
    n, s, t = len(source), source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def with_weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """The rows of found with n_features and weight, the mean gain of the features rounded down, instead of `features`."""
    others = [c for c in found.columns if c != "features"]
    schema = schema_of(found, others, "n_features long, weight long")
    kind = stored_as(len(gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "features"):
            data, at = text_bytes(batch.column("features"))
            at = at // kind.itemsize
            sums = np.append(0, np.cumsum(gain[np.frombuffer(data.tobytes(), kind)]))
            n = np.diff(at)
            weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n), pa.array(weight)], [*others, "n_features", "weight"])

    return found.mapInArrow(weigh, schema)


def collapsed(rows: DataFrame, text: str) -> DataFrame:
    """(text, n): the different texts and their copies."""
    return rows.select(F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate of the document's id, times 1000, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight) of each document."""
    found = stored(with_buckets(collapsed(docs, text).withColumn("digest", digest(F.col("text"))), "text", buckets), "features", "zstd")
    aim = with_buckets(collapsed(target, text), "text", buckets)
    texts = with_weights(found.drop("n"), gains(bucket_counts(found, buckets), bucket_counts(aim, buckets)))
    return docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest")).join(texts, "digest").select("doc_id", "n_features", "weight")


def least_drawn(scores: DataFrame, most: int) -> int | None:
    """The least score among the `most` highest ones; None if there are none. scores: (score, n), as many rows as scores."""
    left, least = most, None
    for r in sorted(scores.collect(), key=lambda r: -r.score):
        if left <= 0:
            break
        left, least = left - r.n, r.score
    return least


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (1, 2, 3...) in this order, by range partitions: each is numbered by itself, then moved up by
    the sizes of those before it."""
    schema = schema_of(rows, rows.columns, "part_ int, place_ long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            place = pa.array(np.arange(at + 1, at + 1 + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, place], [*batch.schema.names, "place_"])

    lots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(lots, *order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id())
    placed = stored(sorted_rows.mapInArrow(number, schema), "places")
    sizes = sorted((r.part_, r.n) for r in placed.groupBy("part_").agg(F.count("*").alias("n")).collect())
    before = accumulate((n for _, n in sizes), initial=0)
    moved = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part_ int, before_ long")
    return placed.join(F.broadcast(moved), "part_").select(*rows.columns, (F.col("place_") + F.col("before_")).alias(name))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document; rank is null where it isn't drawn."""
    score = (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")
    scored = stored(weighted(docs, target, doc_id, text, buckets).select("*", score), "scores")
    able = F.col("n_features") >= least_words
    counts = stored(scored.where(able).groupBy("score").agg(F.count("*").alias("n")), "histogram")
    most = percent * (counts.agg(F.sum("n")).head()[0] or 0) // 100
    least = least_drawn(counts, most)
    undrawn = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select("*", undrawn)
    chosen = able & (F.col("score") >= least)
    ranked = numbered(scored.where(chosen), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.unionByName(scored.where(~chosen).select("*", undrawn))
