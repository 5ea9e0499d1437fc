"""Telephony audio in a binary column: WAV files of mu-law, A-law or IMA ADPCM samples, read back, expanded and resampled.

Rows are independent, so every function is one pass without a shuffle. Within a task the payloads of a slice lie end to
end in one numpy array: companded samples are expanded by lookup tables of 256 entries, and ADPCM blocks, which don't
depend on each other, are decoded side by side, one step of all blocks at a time.

Nulls and empty payloads are stored as files with no samples; a file that isn't such a WAV reads back as null. Repeated
rows have equal files; very long payloads are treated whole, in a task's memory (a WAV file holds less than 4 GB). Only the
named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import schema_of, text_slices

#: Fixed values of the formats: the WAV format tags, and the step sizes and index steps of IMA ADPCM.
TAGS = {"alaw": 6, "mulaw": 7, "ima": 17}
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

#: Bytes of an ADPCM block: a header of 4 and two samples in each other byte.
BLOCK = 64
#: Samples of an ADPCM block: one in its header, two in each other byte.
BLOCK_SAMPLES = 1 + 2 * (BLOCK - 4)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(part > 0, (low + 256) << np.maximum(part - 1, 0), low)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM samples (blocks x BLOCK_SAMPLES) of ADPCM blocks (blocks x BLOCK bytes), all blocks at once."""
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((len(blocks), BLOCK_SAMPLES), np.int16)
    out[:, 0] = sample
    for k in range(BLOCK_SAMPLES - 1):
        code = (blocks[:, 4 + k // 2] >> (4 * (k & 1)) & 15).astype(np.int32)
        step = IMA_STEPS[index]
        change = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
        sample = np.clip(sample + change * (1 - (code >> 2 & 2)), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code & 7], 0, 88)
        out[:, k + 1] = sample
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    if to % rate == 0:
        part, wide = to // rate, pcm.astype(np.int32)
        out = np.empty((len(pcm), part), np.int16)
        out[:, 0], out[-1] = pcm, pcm[-1]
        for k in range(1, part):
            out[:-1, k] = (wide[:-1] * (part - k) + wide[1:] * k) // part
        return out.ravel()
    at = np.arange(-(-len(pcm) * to // rate)) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def wav(payload: bytes, codec: str, rate: int = 8000) -> bytes:
    ima = codec == "ima"
    extra = struct.pack("<HH", 2, BLOCK_SAMPLES) if ima else struct.pack("<H", 0)
    per_second = rate * BLOCK // BLOCK_SAMPLES if ima else rate
    form = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per_second, BLOCK if ima else 1, 4 if ima else 8) + extra
    samples = len(payload) // BLOCK * BLOCK_SAMPLES if ima else len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(data: bytes) -> tuple[str, int, bytes] | None:
    """Codec, rate and stored bytes of a WAV file; None if it isn't one of these."""
    codec = rate = None
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            return None
        if name == b"fmt " and size >= 16:
            tag, _, rate = struct.unpack_from("<HHI", data, at + 8)
            codec = next((k for k, v in TAGS.items() if v == tag), None)
        elif name == b"data":
            return (codec, rate, data[at + 8 : at + 8 + size]) if codec else None
        at += 8 + size + (size & 1)
    return None


def as_payload(text: Column, unit: int = 64) -> Column:
    """A text's UTF-8 bytes, with zero bytes appended up to a positive multiple of `unit`."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    padded = (F.greatest(F.octet_length(data), F.lit(1)) + (unit - 1)) - (F.greatest(F.octet_length(data), F.lit(1)) + (unit - 1)) % unit
    return F.call_function("rpad", data, padded.cast("int"), F.lit(b"\0"))


def store_audio(df: DataFrame, id_column: str, payload: Column, codec: str = "mulaw", rate: int = 8000, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, the columns of keep, media): the payload bytes, as they are, as the samples of a WAV file. Lossless."""
    given = df.select(F.col(id_column), *[c.alias(k) for k, c in (keep or {}).items()], payload.alias("payload"))
    others = given.columns[:-1]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "payload"):
            media = [wav(x or b"", codec, rate) for x in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(media, pa.binary())], [*others, "media"])

    return given.mapInArrow(store, schema_of(given, others, "media binary"))


def read_audio(media: DataFrame, id_column: str, to_rate: int = 16000, keep: list[str] | None = None, also: tuple[int, ...] = ()) -> DataFrame:
    """What the stored files hold: codec, rate, sizes and digests of their bytes, features, and pcm, resampled to to_rate.
    also: other rates, each with a column pcm_<rate>.

    feature: the samples' number, energy, peak and sign changes under the file's codec, and the CRCs of the samples that its
    bytes give as mu-law, A-law and ADPCM. Equal bytes have equal features. pcm: 16-bit samples, little-endian.
    """
    others, more = [id_column, *(keep or [])], [f"pcm_{rate}" for rate in also]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "media"):
            files = batch.column("media").to_pylist()
            found = [unwav(x) if x else None for x in files]
            adpcm = decode_all([f[2] if f else b"" for f in found])
            rows = [describe(x, f, a, (to_rate, *also)) for x, f, a in zip(files, found, adpcm, strict=True)]
            columns = [batch.column(c) for c in others] + [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(KINDS + (pa.binary(),) * len(also))]
            yield pa.RecordBatch.from_arrays(columns, [*others, *NAMES, *more])

    schema = schema_of(media, others, "codec string, rate int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary" + "".join(f", {c} binary" for c in more))
    return media.select(*others, "media").mapInArrow(read, schema)


NAMES = ("codec", "rate", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")
KINDS = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())


def decode_all(payloads: list[bytes]) -> list[np.ndarray]:
    """The samples of each payload's whole ADPCM blocks; the blocks of all payloads are decoded together."""
    blocks = [len(x) // BLOCK for x in payloads]
    data = np.frombuffer(b"".join(x[: n * BLOCK] for x, n in zip(payloads, blocks, strict=True)), np.uint8)
    return np.split(decode_ima(data.reshape(-1, BLOCK)).ravel(), np.cumsum(blocks)[:-1] * BLOCK_SAMPLES)


def describe(media: bytes | None, found: tuple[str, int, bytes] | None, adpcm: np.ndarray, to_rates: tuple[int, ...]) -> tuple:
    if found is None:
        known = (len(media), hashlib.sha256(media).hexdigest()) if media is not None else (None, None)
        return (None,) * 5 + known + (None,) * (1 + len(to_rates))
    codec, rate, data = found
    raw = np.frombuffer(data, np.uint8)
    heard_as = {"mulaw": MULAW[raw], "alaw": ALAW[raw], "ima": adpcm}
    own = heard_as[codec]
    wide = own.astype(np.int64)
    parts = [len(own), int(wide @ wide), int(np.abs(wide).max(initial=0)), int(np.count_nonzero(np.diff(np.signbit(own))))]
    parts += [zlib.crc32(x.astype("<i2").tobytes()) for x in heard_as.values()]
    heard = [resample(own, rate, to).astype("<i2").tobytes() for to in to_rates]
    return (codec, rate, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), ":".join(map(str, parts)), *heard)
