import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from terrasheet.llm import bpe, media, queries, token_counts

TEXTS = [None, "", " ", "a", "Don't stop 123 is\n\n \tit  ", "été 漢字 🙂🙂", "ab" * 3000, "x\x00y\x1c", "la la la", "la la la", "a\nb\n\nc"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string, section_id string")


def reference():
    tokens = bpe.read_ranks(queries.RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def documents(tmp_path, spark, texts):
    frame(spark, texts).drop("ids", "section_id").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_bpe_equals_the_library(spark, tmp_path):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aaabbc  \n'sdté漢.,!12") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    encode = reference()
    got = {r.doc_id: r for r in queries.op5_bpe(spark, documents(tmp_path, spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = encode.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_replay_when_a_merge_enables_an_earlier_one():
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"aa", b"ab"]
    merges = bpe.Merges(tokens)
    pieces = [b"abcabc", b"aaaa", b"aaaaa", b"bcbcab", b"a", b"xyz", b"aabc"]
    ids, edges = bpe.replay(pieces, merges)
    assert [x.tolist() for x in np.split(ids, edges[1:-1])] == [merges.one(p) for p in pieces]


def test_empty_table(spark):
    none = frame(spark, []).limit(0)
    assert bpe.decode_ids(bpe.encode_texts(none, "doc_id", "text", queries.RANKS, P.PATTERN), "doc_id", "ids", queries.RANKS, P.PATTERN).count() == 0
    assert token_counts.section_tokens(none, "doc_id", "text", queries.RANKS, P.PATTERN).count() == 0
    assert media.read_audio(media.store_audio(none, "doc_id", media.as_payload(F.col("text"))), "doc_id").count() == 0


def test_token_counts_against_brute_force(spark, tmp_path):
    encode = reference()
    rows = queries.op1_token_counts(spark, documents(tmp_path, spark, TEXTS)).orderBy("doc_id", "section_id").collect()
    for i, text in enumerate(TEXTS):
        text = text or ""
        own = [r for r in rows if r.doc_id == i]
        parts = text.splitlines(keepends=True) if not any(c in text for c in "\x1c") else [text]
        assert [text[r.begin : r.end] for r in own] == (parts or [""])
        ids = encode.encode_ordinary(text)
        assert sum(r.n_tokens for r in own) == len(ids)
        assert abs(sum(r.token_share for r in own) - len(ids)) < 1e-6
        at = 0
        want, share = [0] * len(own), [0.0] * len(own)
        ends = np.cumsum([len(p.encode()) for p in parts or [""]])
        for token in encode.decode_tokens_bytes(ids):
            for k in range(len(token)):
                s = int(np.searchsorted(ends, at + k, "right"))
                want[s] += k == 0
                share[s] += 1 / len(token)
            at += len(token)
        assert [r.n_tokens for r in own] == want
        assert np.allclose([r.token_share for r in own], share)


def test_given_sections_may_overlap_and_leave_gaps(spark):
    df = spark.createDataFrame([(1, "hello world again", [(0, 5), (3, 11), (20, 30), (4, 2), None]), (2, None, [(0, 1)]), (3, "x", None)], "k long, t string, s array<struct<begin:int,end:int>>")
    rows = token_counts.section_tokens(df, "k", "t", queries.RANKS, P.PATTERN, "s").orderBy("k", "section_id").collect()
    assert [(r.k, r.begin, r.end) for r in rows] == [(1, 0, 5), (1, 3, 11), (1, 17, 17), (1, 4, 4), (1, 0, 0), (2, 0, 0)]
    assert [r.n_tokens for r in rows][2:] == [0, 0, 0, 0]


def scalar_ima(block):
    sample = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.IMA_STEPS[index])
            change = step >> 3
            if code & 4:
                change += step
            if code & 2:
                change += step >> 1
            if code & 1:
                change += step >> 2
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            index = max(0, min(88, index + int(media.IMA_INDEX[code & 7])))
            out.append(sample)
    return out


def test_adpcm_against_a_scalar_decoder():
    data = np.random.default_rng(1).integers(0, 256, (40, 64), dtype=np.uint8)
    assert media.decode_ima(data).tolist() == [scalar_ima(bytes(b)) for b in data]


def test_companding_tables():
    assert media.MULAW[[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124]
    assert media.ALAW[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]


def scalar_mulaw(code):
    code = ~code & 0xFF
    size = (((code & 15) * 8 + 132) << (code >> 4 & 7)) - 132
    return -size if code & 128 else size


def scalar_alaw(code):
    code ^= 0x55
    size = (code & 15) * 16 + 8
    if code >> 4 & 7:
        size = (size + 256) << (code >> 4 & 7) - 1
    return size if code & 128 else -size


def scalar_feature(data):
    """The feature of mu-law bytes, a sample at a time; the PCM has every other sample."""
    pack = lambda samples: b"".join(x.to_bytes(2, "little", signed=True) for x in samples)
    own, law = [scalar_mulaw(b) for b in data], [scalar_alaw(b) for b in data]
    ima = [x for k in range(0, len(data), 64) for x in scalar_ima(data[k : k + 64])]
    changes = sum((a < 0) != (b < 0) for a, b in zip(own, own[1:], strict=False))
    heard = pack(own[::2])
    return ":".join(map(str, [len(own), sum(x * x for x in own), max(map(abs, own)), changes, *(zlib.crc32(pack(x)) for x in (own, law, ima)), len(heard), zlib.crc32(heard)]))


def test_resampling_against_a_scalar_loop():
    pcm = np.random.default_rng(2).integers(-32768, 32768, 999).astype(np.int16)
    for rate, to in ((8000, 16000), (8000, 24000), (8000, 4000), (8000, 6000), (11025, 8000), (8000, 8000)):
        want = []
        for k in range(-(-len(pcm) * to // rate)):
            at = k * rate / to
            low = min(int(at), len(pcm) - 1)
            high = min(low + 1, len(pcm) - 1)
            want.append(float(pcm[low]) + (at - low) * (float(pcm[high]) - float(pcm[low])))
        got = media.resample(pcm, rate, to)
        assert len(got) == len(want) and np.abs(got - np.array(want)).max() <= 1
    assert len(media.resample(pcm[:0], 8000, 16000)) == 0


def test_media_round_trip(spark, tmp_path):
    texts = TEXTS + ["z" * 64, "z" * 65]
    rows = {r.doc_id: r for r in queries.op7_media(spark, documents(tmp_path, spark, texts)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        padded = data + b"\0" * ((-len(data)) % 64 if data else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        file = media.wav(padded, "mulaw")
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert r.feature == scalar_feature(padded)
    assert rows[8].feature == rows[9].feature


def test_media_is_heard_at_twice_its_rate(spark, tmp_path):
    texts = [None, "a", "z" * 65, "é" * 700]
    for r in queries.op7_media(spark, documents(tmp_path, spark, texts)).collect():
        data = (texts[r.doc_id] or "").encode()
        own = [scalar_mulaw(b) for b in data + b"\0" * ((-len(data)) % 64 if data else 64)]
        between = [(a + b) // 2 for a, b in zip(own, own[1:] + own[-1:], strict=True)]
        heard = b"".join(x.to_bytes(2, "little", signed=True) for pair in zip(own, between, strict=True) for x in pair)
        assert (r.pcm_bytes, r.pcm_crc32) == (len(heard), zlib.crc32(heard))


def test_other_files_read_back_as_null(spark):
    df = spark.createDataFrame([(1, bytearray(b"RIFFxxxxWAVE")), (2, None), (3, bytearray(media.wav(b"\x01\x02\x03", "alaw")))], "k long, media binary")
    rows = {r.k: r for r in media.read_audio(df, "k").collect()}
    assert rows[1].codec is None and rows[2].media_bytes is None
    assert rows[3].codec == "alaw" and rows[3].payload_bytes == 3 and len(rows[3].pcm) == 12
