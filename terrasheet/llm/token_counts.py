"""Token counts by section: whole texts are encoded once, and tokens are attributed to the sections they lie in.

A text is encoded as a whole, so that no section boundary changes its tokens. The tokens' byte spans are then joined with
the sections' spans (sorted search, not pairs), and a token that crosses a boundary goes by a rule:

- n_tokens: to the section that holds its first byte;
- token_share: to each section in proportion to the token's bytes in it.

Over sections that cover a text without overlap, both add up to the text's tokens. One pass, without a shuffle.

Repeated rows give repeated sections, an empty table none. A very long text is encoded whole, in a task's memory. Other
columns aren't read, whatever their names; an id column named like a column of the result is a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import read_ranks
from .common import check_names, text_slices

_loaded: dict[tuple[str, str], tuple] = {}


def encoder(ranks: str, pattern: str):
    """tiktoken's encoder and the byte length of each token."""
    import tiktoken

    if (ranks, pattern) not in _loaded:
        tokens = read_ranks(ranks)
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        _loaded[ranks, pattern] = own, np.array([len(t) for t in tokens], np.int64)
    return _loaded[ranks, pattern]


def lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte spans of a text's lines, each with its newline; an empty text is one empty line."""
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    return np.concatenate(([0], ends[:-1])), ends


def attribute(lengths: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n_tokens and token_share of the spans [begin, end), from the tokens' byte lengths in order."""
    edges = np.concatenate(([0], np.cumsum(lengths)))
    firsts = edges[:-1]
    whole = np.searchsorted(firsts, end) - np.searchsorted(firsts, begin)
    along = np.arange(len(edges))
    return whole, np.interp(end, edges, along) - np.interp(begin, edges, along)


def section_tokens(df: DataFrame, id_column: str, text_column: str, ranks: str, pattern: str, spans_column: str | None = None) -> DataFrame:
    """(id, section_id, begin, end, n_tokens, token_share) for each section of each text.

    spans_column: array<struct<begin: int, end: int>> of code points, cut to the text; they may overlap or leave gaps. A
    null element, and one whose end isn't after its begin, is an empty section. Without it, sections are lines with their
    newline. A null text is empty: it has one empty line, and its given sections have no tokens. A null array has none.
    """
    check_names(id_column, "section_id", "begin", "end", "n_tokens", "token_share")
    id_type = df.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoder(ranks, pattern)
        for batch in text_slices(batches, text_column):
            texts = [x or "" for x in batch.column(text_column).to_pylist()]
            spans = batch.column(spans_column).to_pylist() if spans_column else None
            parts = []
            for k, text in enumerate(texts):
                data = np.frombuffer(text.encode(), np.uint8)
                chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where code points begin
                if spans is None:
                    begin, end = lines(data)
                    shown = np.searchsorted(chars, begin), np.searchsorted(chars, end)
                else:
                    own = [((s or {}).get("begin") or 0, (s or {}).get("end") or 0) for s in spans[k] or []]
                    shown = np.clip(np.array(own, np.int64).reshape(-1, 2).T, 0, len(chars) - 1)
                    shown[1] = np.maximum(shown[0], shown[1])
                    begin, end = chars[shown[0]], chars[shown[1]]
                ids = np.array(encode.encode_ordinary(text), np.int64)
                parts.append((np.arange(len(begin)), *shown, *attribute(sizes[ids], begin, end)))
            rows = np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts])
            columns = [np.concatenate([p[c] for p in parts]) for c in range(5)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(rows)), *(pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True))], [id_column, "section_id", "begin", "end", "n_tokens", "token_share"])

    own = [id_column, text_column, *[spans_column] * bool(spans_column)]
    return df.select(*own).mapInArrow(count, f"`{id_column}` {id_type}, section_id int, begin long, end long, n_tokens long, token_share double")
