"""Byte-level BPE by merge replay over blocks of the corpus.

A task cuts its texts into the pattern's pieces, keeps the distinct pieces that it hasn't met, and replays the merges on
all of them together: an inverted index has, for each merge rank, the positions in the block where that merge can be
made. Ranks are taken in ascending order; a merge touches its two neighbours only, whose new pairs enter the index.
Nothing is shuffled; the number of pieces that a task remembers is bounded, and forgetting them changes no result.

Null is encoded as empty text: no ids, no bytes. Repeated rows give repeated rows, an empty table an empty one. A very long
text is cut into pieces whole, in a task's memory. Other columns aren't read, whatever their names; an id column must not
have the name of a column of the result (ids, n_tokens, ids_sha256, decoded): that is a ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import byte_lengths, check_names, text_slices

#: Pieces that a task remembers with their ids, and bytes of text whose new pieces are replayed together.
REMEMBERED, BLOCK_BYTES = 150_000, 8 << 20

_loaded: dict[tuple[str, str], Codec] = {}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            token, _, rank = line.partition(b" ")
            if rank:
                tokens[int(rank)] = base64.b64decode(token)
    return [tokens[i] for i in range(len(tokens))]


class Merges:
    """The merges of a vocabulary: which rank the pair of two tokens has, if any. The rank is the merged token's id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = rank = {t: i for i, t in enumerate(tokens)}
        self.base = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {rank[t[:k]] << 20 | rank[t[k:]]: i for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank}
        self.keys = np.array([*sorted(pairs), np.iinfo(np.int64).max])
        self.ranks = np.array([*(pairs[k] for k in self.keys[:-1].tolist()), -1], np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def one(self, piece: bytes) -> list[int]:
        """A single piece's ids: again and again, the leftmost of its lowest merges."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = min((self.rank.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if found[0] == 1 << 30:
                break
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        return [self.rank[p] for p in parts]


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, one after another, and where each piece's begin (one more: the end).

    Positions of a block are linked to the next and previous symbol of their piece. `where` is the inverted index.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n, ends = len(data), np.cumsum([len(p) for p in pieces], dtype=np.int64)
    symbol = merges.base[data]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends - 1] = -1
    before[np.concatenate(([0], ends[:-1]))] = -1
    rank = np.full(n, -1, np.int32)  # of the pair that begins at a position
    at = np.flatnonzero(after >= 0)
    rank[at] = merges.of(symbol[at], symbol[at + 1])
    where: dict[int, list[np.ndarray]] = {}
    due: list[int] = []
    out_of_order: list[np.ndarray] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = [0, *cuts.tolist(), len(ranks)]
        for k, r in enumerate(ranks[firsts[:-1]].tolist()):
            if r in where:
                where[r].append(positions[firsts[k] : firsts[k + 1]])
            else:
                where[r] = [positions[firsts[k] : firsts[k + 1]]]
                heapq.heappush(due, r)

    at = np.flatnonzero(rank >= 0).astype(np.int32)
    if len(at):
        enter(at, rank[at])
    while due:
        now = heapq.heappop(due)
        found = where.pop(now)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[rank[at] == now]
        if not len(at):
            continue
        gone = after[at]
        touching = gone[:-1] == at[1:]
        if touching.any():  # of overlapping pairs, every second one stays
            keep, chain = np.ones(len(at), bool), touching.tolist()
            for k, joined in enumerate(chain):
                if joined and keep[k]:
                    keep[k + 1] = False
            at, gone = at[keep], gone[keep]
        following = after[gone]
        symbol[at], after[at], rank[gone] = now, following, -1
        some = following >= 0
        before[following[some]] = at[some]
        previous = before[at]
        touched = np.concatenate((at, previous[previous >= 0]))
        if len(at) > 1 and (following[:-1] == at[1:]).any():
            touched = np.unique(touched)
        beyond = after[touched]
        new = np.where(beyond >= 0, merges.of(symbol[touched], symbol[beyond]), -1)
        rank[touched] = new
        good = new >= 0
        if good.any():
            touched, new = touched[good], new[good]
            if (new < now).any():
                out_of_order.append(touched[new < now])
            enter(touched, new)
    starts = np.concatenate(([0], ends[:-1]))
    alive = reached(after, starts)
    ids = symbol[alive]
    edges = np.concatenate(([0], np.cumsum(alive)))[np.concatenate((starts, [n]))]
    if out_of_order:  # a merge of a lower rank became possible after a higher one: such pieces are done singly
        again = np.unique(np.searchsorted(ends, np.concatenate(out_of_order), "right")).tolist()
        lists = np.split(ids, edges[1:-1])
        for k in again:
            lists[k] = np.array(merges.one(pieces[k]), np.int32)
        ids, edges = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    return ids, edges


def reached(after: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True for the positions that the links reach from the pieces' starts."""
    alive = np.zeros(len(after), bool)
    at = starts
    while len(at):
        alive[at] = True
        at = after[at]
        at = at[at >= 0]
    return alive


class Codec:
    """Encodes texts and decodes ids under a rank file and a pattern, without special tokens."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.merges = Merges(self.tokens)
        self.split = regex.compile(pattern).findall
        self.index: dict[str, int] = {}  # of the pieces met so far
        self.ids: list[bytes] = []  # of each of them

    def pieces(self, text: str) -> np.ndarray:
        """The numbers of a text's pieces; new pieces get the next numbers."""
        index = self.index
        number = index.setdefault
        return np.array([number(p, len(index)) for p in self.split(text)], np.int32)

    def learn(self) -> None:
        """Replays the merges over the pieces that are new since the last call."""
        new = [p.encode() for p in islice(self.index, len(self.ids), None)]
        if new:
            ids, edges = replay(new, self.merges)
            data = ids.astype("<u4").tobytes()
            edges = (4 * edges).tolist()
            self.ids += [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def joined(self, numbers: np.ndarray) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers, from its pieces' numbers."""
        return b"".join(map(self.ids.__getitem__, numbers.tolist()))

    def forget(self) -> None:
        if len(self.ids) > REMEMBERED:
            self.index, self.ids = {}, []

    def encode(self, texts: list[str]) -> list[bytes]:
        numbers = [self.pieces(x) for x in texts]
        self.learn()
        out = [self.joined(x) for x in numbers]
        self.forget()
        return out

    def decode(self, ids: bytes) -> bytes:
        return decoded(self.tokens, ids)


def decoded(tokens: list[bytes], ids: bytes) -> bytes:
    """The bytes of ids, which are little-endian unsigned 32-bit integers."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def encode_texts(df: DataFrame, id_column: str, text_column: str, ranks: str, pattern: str) -> DataFrame:
    """(id, ids): the text's ids as the bytes of little-endian unsigned 32-bit integers. The rank file is on every machine."""
    check_names(id_column, "ids")
    id_type = df.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)

        def learned(block: list[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            own.learn()
            for keys, numbers in block:
                yield pa.RecordBatch.from_arrays([keys, pa.array([own.joined(x) for x in numbers], pa.binary())], [id_column, "ids"])
            own.forget()

        block, held = [], 0
        for batch in text_slices(batches, text_column):
            block.append((batch.column(id_column), [own.pieces(x or "") for x in batch.column(text_column).to_pylist()]))
            held += int(byte_lengths(batch.column(text_column)).sum())
            if held >= BLOCK_BYTES:
                yield from learned(block)
                block, held = [], 0
        yield from learned(block)

    return df.select(id_column, text_column).mapInArrow(encode, f"`{id_column}` {id_type}, ids binary")


def decode_ids(df: DataFrame, id_column: str, ids_column: str, ranks: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded): the bytes that the ids stand for. keep_ids: the ids column as well, at the end."""
    check_names(id_column, "n_tokens", "ids_sha256", "decoded")
    id_type = df.schema[id_column].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_ranks(ranks)  # decoding needs no merges
        for batch in text_slices(batches, ids_column):
            ids = [x or b"" for x in batch.column(ids_column).to_pylist()]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([decoded(tokens, x) for x in ids], pa.binary())]
            kept = [batch.column(ids_column)] * keep_ids
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *columns, *kept], [id_column, "n_tokens", "ids_sha256", "decoded", *[ids_column] * keep_ids])

    schema = f"`{id_column}` {id_type}, n_tokens long, ids_sha256 string, decoded binary" + f", `{ids_column}` binary" * keep_ids
    return df.select(id_column, ids_column).mapInArrow(decode, schema)
