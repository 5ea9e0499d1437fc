"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document is the set of its distinct shingles of words (A-Z lower-cased, words between white space). Documents with the
same words are one class; only classes go on. SuperMinHash gives each shingle a random order of the SLOTS slots and takes
them level by level, so that a level's values lie above the last one's: a text stops at the first level at which all its
slots have values. Classes that agree on a band of slots are candidates, by bucket.

A bucket isn't paired with itself. First its members meet two pivots, its least and its greatest id, and links are joined
to components. Then, only in buckets that still hold several components, members outside the least component meet all
others. Both go by cells: the two sides are dealt by hash into blocks of bounded size, and each pair of blocks is one
task's work. A first pass has signatures only and tells which members have a partner worth a look; a second one, of these
alone, has their texts and compares full sets. It returns links only, one for a member and another component.

Candidates agree in Scheme.least_equal slots of their signatures. A pair at the similarity of 0.85 is missed by all bands
of 5 slots with a probability of 8e-7, one at 0.8 by those of 4 with 1e-7; by least_equal with 1e-7. Full sets are of
64-bit shingle hashes (see words.word_hashes).

Texts without words, empty or null, have no shingles and are linked with nothing. Repeated rows are copies; rows that
share an id are taken for one document. Ids are integers. A row without an id makes no links: if its words are those of a
class, it belongs to that component and isn't kept; else its component is null and it is kept. Other columns don't matter.
Very long texts are treated whole, in a task's memory (some 60 bytes of numpy for a byte of text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored, text_bytes, text_slices
from .graph import components
from .words import LOWER, NOT_SPACE, find_words, gram_hashes, mix, word_hashes

SLOTS = 120
#: Members of a block, and of one that meets a single pivot; shingles of theirs; ids and buckets that may be broadcast.
BLOCK, STAR_BLOCK, BLOCK_SHINGLES, BROADCAST_IDS, BROADCAST_BUCKETS = 512, 128, 1 << 19, 1_000_000, 100_000
#: Members of a block where members of several components meet by their signatures alone.
SIGNATURE_BLOCK = 1024

_U = np.uint64


class Scheme(NamedTuple):
    """What follows from a least similarity of `percent` hundredths of sets of `size`-word shingles."""

    size: int
    percent: int

    @property
    def rows(self) -> int:
        return 5 if self.percent >= 85 else 4

    @property
    def bands(self) -> int:
        return SLOTS // self.rows

    @property
    def least_equal(self) -> int:
        """Fewer equal slots leave the similarity out of question: over 5 standard deviations below."""
        p = self.percent / 100
        return int(SLOTS * p - 5 * (SLOTS * p * (1 - p)) ** 0.5) - 2


def superminhash(shingles: np.ndarray, of: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) of the shingle hashes, of which `of` (ascending) tells the text. No shingles: all ones."""
    out = np.full(texts * slots, np.iinfo(np.uint64).max, np.uint64)
    order = None  # of the slots, for each shingle; what is before the level is used up
    for level in range(slots):
        if not len(shingles):
            break
        bits = mix(shingles + _U((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = level + ((bits >> _U(32)) * _U(slots - level) >> _U(32)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            rows = np.arange(len(shingles))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, level]
        np.minimum.at(out, of * slots + slot, mix(bits) >> _U(8) | _U(level << 56))
        todo = (out.reshape(texts, slots) == np.iinfo(np.uint64).max).any(1)[of]
        shingles, of = shingles[todo], of[todo]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(shingles), 1))
            order[np.arange(len(shingles)), pick[todo]] = 0
        else:
            order = order[todo]
    return out.reshape(texts, slots)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their texts (both by text), and each text's two hashes of its words in order."""
    data, at = text_bytes(column)
    data = LOWER[data]
    first, last, of = find_words(data, at, NOT_SPACE)
    words = word_hashes(data, first, last)
    texts = len(column)
    counts = np.bincount(of, minlength=texts)
    begin = np.concatenate(([0], np.cumsum(counts)))
    gram = gram_hashes(words, size)
    whole = of[: len(gram)] == of[size - 1 :] if len(gram) else np.zeros(0, bool)
    parts, owners = [gram[whole]], [of[: len(gram)][whole]]
    for k in range(1, size):  # shorter texts: all their words
        own = np.flatnonzero(counts == k)
        if len(own):
            parts.append(gram_hashes(words[(begin[own][:, None] + np.arange(k)).ravel()], k)[::k])
            owners.append(own)
    shingles, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(words)) - begin[of]
    keys = np.zeros((2, texts), np.uint64)
    for k in range(2):
        np.add.at(keys[k], of, mix(words ^ mix(place.astype(np.uint64) * _U(2) + _U(k))))
    return shingles[fresh], owner[fresh], keys, counts


def signatures(df: DataFrame, id_column: str, text_column: str, scheme: Scheme) -> DataFrame:
    """(id, n_shingles, k1, k2, bands array<long>, sig binary) per row; without words all but id and n_shingles are null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 20):
            shingles, owner, keys, counts = shingle_sets(batch.column("text"), scheme.size)
            n = len(counts)
            slots = superminhash(shingles, owner, n)
            bands = np.zeros((n, scheme.bands), np.uint64)
            for k in range(scheme.rows):
                bands = mix(bands * _U(0x9E3779B97F4A7C15) + slots[:, k :: scheme.rows])
            bands = mix(bands + np.arange(1, scheme.bands + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))  # of one band only
            none = pa.array(counts == 0)
            low = slots.astype(np.uint8)
            edges = pa.array(np.arange(n + 1) * scheme.bands, pa.int32())
            columns = [
                pa.array(np.bincount(owner, minlength=n)),
                pa.array(keys[0].view(np.int64)),
                pa.array(keys[1].view(np.int64)),
                pa.ListArray.from_arrays(edges, pa.array(bands.ravel().view(np.int64))),
                pa.array([row.tobytes() for row in low], pa.binary()),
            ]
            hidden = [pa.compute.if_else(none, pa.scalar(None, c.type), c) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), columns[0], *hidden], ["id", "n_shingles", "k1", "k2", "bands", "sig"])

    import pyarrow.compute  # noqa: F401

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(sign, "id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary")


def texts_of(ids: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, t): the texts of the ids (one column), read again and kept."""
    ids = stored(ids.toDF("id").distinct(), "pair-ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("t")).where(F.col("id").isNotNull() & F.col("t").isNotNull())
    return stored(texts.join(few, "id", "left_semi"), "pair-texts")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: the least id that links reach, and whether that is its own."""
    if percent < 80:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    scheme = Scheme(size, percent)
    rows = stored(signatures(docs, id_column, text_column, scheme), "signatures")
    some = rows.where("k1 is not null and id is not null")
    same = some.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stored(same, "classes")
    texts = lambda ids: texts_of(ids, docs, id_column, text_column)

    members = classes.select("rep", F.explode("bands").alias("key"))
    buckets = stored(members.groupBy("key").agg(F.min("rep").alias("p0"), F.max("rep").alias("p1")).where("p0 < p1"), "buckets")
    crowd = stored(members.join(F.broadcast(buckets) if buckets.count() <= BROADCAST_BUCKETS else buckets, "key"), "crowd")

    pairs = crowd.select("rep", F.explode(F.array("p0", "p1")).alias("key")).where("rep <> key").distinct()
    pivots = pairs.select("key").distinct().select("key", F.col("key").alias("rep"), F.lit(True).alias("few"))
    stars = stored(pivots.unionByName(pairs.withColumn("few", F.lit(False))).withColumn("component", F.col("rep")), "stars")
    links = stored(links_in(stars, classes, scheme, texts, False), "links")
    found = components(links)

    placed = crowd.select("key", "rep").join(found.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key", "least")
    inside = placed.join(mixed, "key").select("key", "rep", "component", (F.col("component") != F.col("least")).alias("few"))
    every = inside.where("few").unionByName(inside.withColumn("few", F.lit(False)))
    rest = links_in(stored(every, "inside"), classes, scheme, texts, True)
    found = components(links.union(rest))

    owner = classes.select("k1", "k2", F.col("rep").alias("node")).join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("c"))
    out = rows.select("id", "n_shingles", "k1", "k2").join(owner, ["k1", "k2"], "left")
    own = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_column), "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("id"), F.col("c").isNull()).alias("kept"))


def links_in(groups: DataFrame, classes: DataFrame, scheme: Scheme, texts: Callable[[DataFrame], DataFrame], by_band: bool) -> DataFrame:
    """Links (a, b) between members of a group that are of different components: its `few` against its others.

    groups: (key, rep, component, few). by_band: keys are bands' hashes, and a pair is looked at in its first common band.
    """
    sized = groups.join(classes.select("rep", "n", "sig", *["bands"] * by_band), "rep")
    block = BLOCK if by_band else STAR_BLOCK
    near = in_cells(sized, ["sig", *["bands"] * by_band], SIGNATURE_BLOCK if by_band else block, 1 << 40).mapInArrow(cellwise(screened(scheme, by_band)), "key long, rep long, few boolean").distinct()
    near = stored(near.join(groups, ["key", "rep", "few"]), "near")
    whole = near.join(classes.select("rep", "n"), "rep").join(texts(near.select("rep")).toDF("rep", "text"), "rep")
    return in_cells(whole, ["text"], block, BLOCK_SHINGLES).mapInArrow(cellwise(compared(scheme)), "a long, b long").distinct()


def in_cells(members: DataFrame, columns: list[str], block: int, shingles: int) -> DataFrame:
    """Members (key, rep, component, few, n, columns) dealt to cells (key, i, j), sorted by cell: block i of a group's few
    against block j of its others. A block has `block` members, or so, and `shingles` of their shingles.
    """
    blocks = lambda few: F.ceil(F.greatest(F.lit(1), F.count(F.when(few, 1)) / block, F.sum(F.when(few, F.col("n"))) / shingles)).cast("int")
    sizes = stored(members.select("key", "few", "n").groupBy("key").agg(blocks(F.col("few")).alias("rows"), blocks(~F.col("few")).alias("cols")), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_BUCKETS else sizes
    own = lambda side: F.array(F.pmod(F.xxhash64("rep"), F.col(side)).cast("int"))
    every = lambda side: F.sequence(F.lit(0), F.col(side) - 1)
    held = members.join(sizes, "key").withColumn("i", F.explode(F.when(F.col("few"), own("rows")).otherwise(every("rows"))))
    held = held.withColumn("j", F.explode(F.when(F.col("few"), every("cols")).otherwise(own("cols"))))
    return held.select("key", "i", "j", "few", "rep", "component", "n", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def common_sizes(own: np.ndarray, sets: np.ndarray, begin: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How many elements of `own` (ascending) each of the sets numbered `which` holds; set k lies from begin[k] on."""
    if not len(own) or not len(which):
        return np.zeros(len(which), np.int64)
    sizes = begin[which + 1] - begin[which]
    at = np.repeat(begin[which] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    values = sets[at]
    hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    return np.bincount(np.repeat(np.arange(len(which)), sizes), hit, len(which)).astype(np.int64)


def signature_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def screened(scheme: Scheme, by_band: bool):
    """Of a cell the members (key, rep, few) that have a partner by their signatures' and sets' sizes."""

    def run(cell: pa.Table, few: np.ndarray) -> pa.RecordBatch | None:
        comp, n = (cell.column(c).to_numpy() for c in ("component", "n"))
        sig, good, right = signature_matrix(cell.column("sig")), np.zeros(len(few), bool), np.flatnonzero(~few)
        if by_band:
            bands = np.array(cell.column("bands").combine_chunks().flatten()).reshape(-1, scheme.bands)
            bands = bands[:, : int(np.argmax(bands[0] == cell.column("key")[0].as_py()))]
        for x in np.flatnonzero(few).tolist():
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= scheme.percent * np.maximum(n[right], n[x]))]
            y = y[(sig[y] == sig[x]).sum(1) >= scheme.least_equal]
            if by_band and len(y):
                y = y[~(bands[y] == bands[x]).any(1)]  # taken in an earlier band
            good[y] = True
            good[x] |= len(y) > 0
        kept = cell.select(["key", "rep", "few"]).filter(pa.array(good))
        return kept.combine_chunks().to_batches()[0] if good.any() else None

    return run


def compared(scheme: Scheme):
    """Of a cell the links (a, b) by full sets."""

    def run(cell: pa.Table, few: np.ndarray) -> pa.RecordBatch | None:
        rep, comp, n = (cell.column(c).to_numpy() for c in ("rep", "component", "n"))
        sets, of, _, _ = shingle_sets(cell.column("text").combine_chunks(), scheme.size)
        begin = np.searchsorted(of, np.arange(len(rep) + 1))
        right, a, b = np.flatnonzero(~few), [], []
        for x in np.flatnonzero(few).tolist():
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= scheme.percent * np.maximum(n[right], n[x]))]
            common = common_sizes(sets[begin[x] : begin[x + 1]], sets, begin, y)
            y = y[(100 * common >= scheme.percent * (n[y] + n[x] - common)) & (common > 0)]
            y = y[np.unique(comp[y], return_index=True)[1]]  # one link joins the components
            a += np.minimum(rep[y], rep[x]).tolist()
            b += np.maximum(rep[y], rep[x]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    return run


def cellwise(function: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None]):
    """Applies function(rows, few) to each cell with both sides, of rows that are sorted by cell."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(cell[:, lo].tolist())
                if key != last and held:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches):
            few = cell.column("few").to_numpy()
            if few.any() and not few.all():
                found = function(cell, few)
                if found is not None:
                    yield found
        give_back()

    return run
