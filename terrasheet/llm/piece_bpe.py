"""SentencePiece BPE by vectorised merge rounds, and decoding.

A text is a mark for the space that the library puts before it, then its characters, spaces as marks. It is cut into words
before each run of marks, as no piece has a mark after another character (checked when the model is read). A task merges
the distinct words that it hasn't met, all together: their symbols lie in flat numpy arrays, and a round

1. takes the best pair of each word (a segmented minimum of the pairs' ranks),
2. merges all places of it that don't overlap, the leftmost first, in all words at once,
3. drops the merged symbols' second halves and looks up the pairs beside them, the only ones that changed;

words without a pair leave the arrays. Words are cut further between characters that stand side by side in no piece, since
nothing is ever merged across, so a long text without spaces falls into short words. The library merges one place after
another: where a merge makes a pair that is at least as good as its own while other places of it are left, that word is
done anew one merge at a time, from a heap. Characters without a piece become their UTF-8 bytes' pieces.

Null is encoded as empty text: no ids, empty text back. Other columns aren't read, whatever their names; an id column with
the name of a column of the result is a ValueError. Repeated rows give repeated rows, an empty table an empty one. A very
long text is cut into words part by part; the words that a task remembers are bounded, and forgetting them changes no id.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import byte_lengths, check_names, schema_of, text_slices

#: Words that a task remembers with their ids; bytes of text whose new words are merged together; characters of a text that
#: are cut into words, and ids of a text that are decoded, at once.
REMEMBERED, BLOCK_BYTES, PART = 100_000, 4 << 20, 1 << 20
MARK = "▁"
NONE = np.iinfo(np.int32).max

_words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
_edge = re.compile(f"(?<!{MARK}){MARK}")
_loaded: dict[str, Codec] = {}


class Pieces:
    """A model's pieces as tables: characters' ids, pairs that make a piece, their ranks, bytes' ids."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        size = model.vocab_size()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        names = {model.id_to_piece(i): i for i in set(range(size)).difference(special)}
        if any(MARK in p.lstrip(MARK) for p in names) or any(model.is_unused(i) for i in names.values()):
            raise ValueError("a piece with a mark inside, or an unused one, which cutting into words doesn't allow for")
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(map(model.is_byte, self.bytes.tolist())):
            raise ValueError("the model has no pieces for bytes")
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in names.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        scores = np.array([model.get_score(i) for i in range(size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # equal scores, equal ranks
        pairs = {names[p[:k]] << 32 | names[p[k:]]: i for p, i in names.items() for k in range(1, len(p)) if p[:k] in names and p[k:] in names}
        self.keys = np.array([*sorted(pairs), np.iinfo(np.int64).max])
        self.into = np.array([*(pairs[k] for k in self.keys[:-1].tolist()), -1], np.int32)
        beside = {ord(a) << 32 | ord(b) for p in names for a, b in zip(p, p[1:], strict=False)}
        self.beside = np.array([*sorted(beside), np.iinfo(np.int64).max])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes (or -1) and its rank (or NONE). A symbol of -1 makes none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        into = np.where((self.keys[at] == key) & (left >= 0), self.into[at], -1)
        return into, np.where(into >= 0, self.rank[into], NONE)

    def apart(self, chars: np.ndarray) -> np.ndarray:
        """True where a character and the one before it stand side by side in no piece."""
        key = chars[:-1].astype(np.int64) << 32 | chars[1:]
        return self.beside[np.searchsorted(self.beside, key)] != key

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """A word's symbols after all merges, made one at a time: the best rank first, then the leftmost place."""
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        due: list[tuple[int, int, int, int, int]] = []

        def look(lefts: list[int]) -> None:
            lefts = [k for k in lefts if k >= 0 and after[k] >= 0]
            if lefts:
                into, rank = self.pairs(np.array([symbols[k] for k in lefts]), np.array([symbols[after[k]] for k in lefts]))
                for k, i, r in zip(lefts, into.tolist(), rank.tolist(), strict=True):
                    if i >= 0:
                        heapq.heappush(due, (r, k, symbols[k], symbols[after[k]], i))

        look([*range(len(symbols))])
        while due:
            _, k, left, right, made = heapq.heappop(due)
            gone = after[k]
            if symbols[k] != left or gone < 0 or symbols[gone] != right:
                continue  # merged meanwhile
            symbols[k], symbols[gone], after[k] = made, -2, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            look([before[k], k])
        return [s for s in symbols if s != -2]


def merge_rounds(symbols: np.ndarray, starts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """What each place holds after all merges, or -2 if it was merged into one on its left. starts: of the words."""
    n = len(symbols)
    out = np.full(n, -2, np.int32)
    if not n:
        return out
    whole, whole_starts = symbols, starts
    symbols, place = symbols.copy(), np.arange(n)
    last = np.zeros(n, bool)
    last[np.append(starts[1:], n) - 1] = True
    word = np.arange(len(starts))
    into, rank = np.full(n, -1, np.int32), np.full(n, NONE, np.int32)

    def look(at: np.ndarray) -> None:
        into[at], rank[at] = -1, NONE
        at = at[~last[at]]
        into[at], rank[at] = pieces.pairs(symbols[at], symbols[at + 1])

    look(np.arange(n))
    again: list[np.ndarray] = []
    anew = np.zeros(len(starts), bool)  # of the words in the arrays: to be done one merge at a time
    while len(symbols):
        best = np.minimum.reduceat(rank, starts)
        done = (best == NONE) | anew
        if done.any():
            again.append(word[anew])
            sizes = np.diff(starts, append=len(symbols))
            off = np.repeat(done, sizes)
            out[place[off]] = symbols[off]
            symbols, place, last, into, rank = symbols[~off], place[~off], last[~off], into[~off], rank[~off]
            word, best, sizes, anew = word[~done], best[~done], sizes[~done], anew[~done]
            starts = np.cumsum(sizes) - sizes
            if not len(symbols):
                break
        sizes = np.diff(starts, append=len(symbols))
        hit = np.flatnonzero(rank == np.repeat(best, sizes))  # never a word's last symbol, so a run of hits lies in one word
        first = np.append(True, hit[1:] != hit[:-1] + 1)
        run = hit[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]
        chosen = hit[(hit - run) % 2 == 0]
        symbols[chosen] = into[chosen]
        last[chosen] |= last[chosen + 1]
        stay = np.ones(len(symbols), bool)
        stay[chosen + 1] = False
        symbols, place, last, into, rank = symbols[stay], place[stay], last[stay], into[stay], rank[stay]
        starts = starts - np.searchsorted(chosen + 1, starts)
        chosen = chosen - np.arange(len(chosen))
        own = np.searchsorted(starts, chosen, "right") - 1
        inner = chosen > starts[own]
        look(chosen)
        look(chosen[inner] - 1)
        better = rank[chosen] <= best[own]
        better[inner] |= rank[chosen[inner] - 1] <= best[own[inner]]
        anew[own[better & (np.bincount(own, minlength=len(starts))[own] > 1)]] = True
    ends = np.append(whole_starts[1:], n)
    for k in np.concatenate(again).tolist() if again else []:
        a, b = int(whole_starts[k]), int(ends[k])
        alone = pieces.one_by_one(whole[a:b].tolist())
        out[a:b] = -2
        out[a : a + len(alone)] = alone  # their places don't matter, only their order
    return out


def encode_words(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and where each word's begin (one more: the end)."""
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    n = len(chars)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    begins = np.zeros(n, bool)
    begins[np.append(0, ends[:-1])] = True
    begins[1:] |= pieces.apart(chars)
    out = merge_rounds(pieces.char[chars], np.flatnonzero(begins), pieces)
    width = np.where(out == -2, 0, 1)
    unknown = np.flatnonzero(out == -1)
    if len(unknown):  # each is a word of its own
        width[unknown] = 1 + (chars[unknown] > 0x7F) + (chars[unknown] > 0x7FF) + (chars[unknown] > 0xFFFF)
    ids = np.repeat(out, width)
    if len(unknown):
        ids[ids == -1] = pieces.bytes[np.frombuffer(chars[unknown].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
    return ids, np.append(0, np.cumsum(width))[np.append(0, ends)]


class Codec:
    """Encodes texts under a model, without begin or end ids; remembers the ids of words that it has met."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.index: dict[str, int] = {}
        self.ids: list[bytes] = []

    @cached_property
    def pieces(self) -> Pieces:
        """Only for encoding: a task that decodes has no use of the tables."""
        return Pieces(self.model)

    def words(self, text: str) -> np.ndarray:
        """The numbers of a text's words; new words get the next numbers."""
        index, number = self.index, self.index.setdefault
        if not text:
            return np.zeros(0, np.int32)
        text, out, at = MARK + text.replace(" ", MARK), [], 0
        while at < len(text):
            cut = _edge.search(text, at + PART) if len(text) - at > PART else None
            to = cut.start() if cut else len(text)
            out.append(np.array([number(w, len(index)) for w in _words(text, at, to)], np.int32))
            at = to
        return np.concatenate(out)

    def learn(self) -> None:
        """Merges the words that are new since the last call."""
        new = list(islice(self.index, len(self.ids), None))
        if new:
            ids, edges = encode_words(new, self.pieces)
            data, edges = ids.astype("<i4").tobytes(), (4 * edges).tolist()
            self.ids += [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def joined(self, numbers: np.ndarray) -> bytes:
        return b"".join(map(self.ids.__getitem__, numbers.tolist()))

    def forget(self) -> None:
        if len(self.ids) > REMEMBERED:
            self.index, self.ids = {}, []

    def encode(self, texts: list[str]) -> list[bytes]:
        numbers = [self.words(x) for x in texts]
        self.learn()
        out = [self.joined(x) for x in numbers]
        self.forget()
        return out

    def decode(self, ids: np.ndarray, most: int = PART) -> str:
        """The text of ids by the library's decode, in parts of `most` ids or so, cut before a piece that begins with a mark."""
        out, at = [], 0
        while at < len(ids):
            to = at + most
            while to < len(ids) and not self.model.id_to_piece(int(ids[to])).startswith(MARK):
                to += 1
            out.append(self.model.decode(ids[at:to].tolist()))
            at = to
        return " ".join(out)  # the mark that a part begins with is a space, which decode drops


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode_texts(df: DataFrame, id_column: str, text_column: str, model: str) -> DataFrame:
    """(id, ids): the text's ids as the bytes of little-endian 32-bit integers. The model file is on every machine."""
    check_names(id_column, "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)

        def learned(block: list[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            own.learn()
            for keys, numbers in block:
                yield pa.RecordBatch.from_arrays([keys, pa.array([own.joined(x) for x in numbers], pa.binary())], [id_column, "ids"])
            own.forget()

        block, held = [], 0
        for batch in text_slices(batches, text_column):
            block.append((batch.column(id_column), [own.words(x or "") for x in batch.column(text_column).to_pylist()]))
            held += int(byte_lengths(batch.column(text_column)).sum())
            if held >= BLOCK_BYTES:
                yield from learned(block)
                block, held = [], 0
        yield from learned(block)

    return df.select(id_column, text_column).mapInArrow(encode, schema_of(df, [id_column], "ids binary"))


def decimal_digest(ids: np.ndarray) -> str:
    """The digest of the ids' decimals joined by commas, part by part."""
    out = hashlib.sha256()
    for at in range(0, len(ids), PART):
        out.update(("," * (at > 0) + ",".join(map(str, ids[at : at + PART].tolist()))).encode())
    return out.hexdigest()


def decode_ids(df: DataFrame, id_column: str, ids_column: str, model: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded): the number of ids, the digest of their decimals joined by commas, their text."""
    check_names(id_column, "n_tokens", "ids_sha256", "decoded")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in text_slices(batches, ids_column, 1 << 20):
            ids = [np.frombuffer(x or b"", "<i4") for x in batch.column(ids_column).to_pylist()]
            digests = [decimal_digest(x) for x in ids]
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array([own.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *columns], [id_column, "n_tokens", "ids_sha256", "decoded"])

    return df.select(id_column, ids_column).mapInArrow(decode, schema_of(df, [id_column], "n_tokens long, ids_sha256 string, decoded string"))
