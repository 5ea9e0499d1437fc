"""Near-duplicate groups and WARC archives against brute force."""

import gzip
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasheet.llm import near_dedup, warc, words


def groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").encode().lower().decode()) if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, percent):
    """Copies, near copies just over and under the threshold, chains, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(80)]
    texts = [None, "", "  ", "One", "one", "one two", "ONE\ttwo", "one two three"]
    for k in range(160):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    chain = list(base[::-1])
    for k in range(20):
        chain[k * 4] = word()
        texts.append(" ".join(chain))
    texts += [texts[20]] * 5 + [" ".join(word() for _ in range(rng.randint(1, 50))) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_against_brute_force(spark):
    for size, percent in ((3, 85), (5, 80)):
        rows = corpus(size, percent)
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, n_shingles int")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df, size=size, percent=percent).collect()}
        assert got == groups(rows, size, percent)


def test_small_blocks_find_the_same(spark, monkeypatch):
    rows = corpus(11, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "STAR_BLOCK", 7)
    monkeypatch.setattr(near_dedup, "BROADCAST_BUCKETS", 0)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df).collect()}
    assert got == {i: g[1] for i, g in groups(rows, 3, 85).items()}


def test_groups_of_odd_tables(spark):
    data = [(None, "a b c"), (None, "lonely"), (None, None), (3, None), (5, "a b c"), (5, "a b c"), (7, "A  B c"), (9, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect()), key=str)
    copies = [(None, 1, 5, False), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False)]
    assert rows == sorted([*copies, (None, 1, None, True), (None, 0, None, True), (3, 0, 3, True), (9, 0, 9, True)], key=str)
    assert near_dedup.near_groups(df.limit(0)).count() == 0


def test_words_without_collisions():
    """Thue-Morse words collide under any polynomial modulo a power of two."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    long = "x" * 700_000  # longer than a table of powers
    hashes = near_dedup.shingle_sets(pa.array([word, other, long, long + "x", long[:-1] + "y", long]), 1)[0]
    assert len(set(hashes.tolist())) == 5
    data = np.frombuffer(b"abc ab " + long.encode(), np.uint8)
    for (prime, base), field in zip(words._FIELDS, (0, 1), strict=True):
        want = [sum((c + 1) * pow(base, len(w) - 1 - k, prime) for k, c in enumerate(w)) % prime for w in (b"abc", b"ab")]
        assert words._polynomial(data[:7], np.array([0, 4]), np.array([3, 6]), field).tolist() == want
        total = 0
        for c in long.encode():
            total = (total * base + c + 1) % prime
        assert words._polynomial(data[7:], np.zeros(1, np.int64), np.array([len(long)]), field).tolist() == [total]


def test_long_texts_and_thue_morse_words_in_groups(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    rng = random.Random(1)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]  # longer than a slice
    near = list(long)
    near[1000:1010] = ["changed"] * 10
    rows = [(1, f"{word} {word} {word}"), (3, word.translate(str.maketrans("ab", "ba")) + f" {word} {word}"), (4, " ".join(long)), (5, " ".join(near)), (6, " ".join(long[:150_000]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 3: 3, 4: 4, 5: 4, 6: 6} and got[4][0] == len(set(zip(long, long[1:], long[2:])))


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:340], rng.integers(0, 1 << 63, 60).astype(np.uint64)])
    sig = near_dedup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 400), 2)
    assert abs((sig[0] == sig[1]).mean() - 340 / 460) < 0.12
    alone = near_dedup.superminhash(a, np.zeros(400, np.int64), 1)
    assert (alone[0] == sig[0]).all()


PAGES = [(1, "http://a/", "x" * 1200), (2, "http://b/", "x" * 1200), (3, "http://c/", "short"), (4, "http://d/\r\n", "short"), (5, None, None), (6, "u", "é漢\r\n\r\nWARC/1.1\r\n" * 200), (7, "u", "y" * 999), (8, "u", "y" * 999), (9, "u", "x" * 1200)]


def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string")


def archives(spark, at, compress):
    warc.write_archives(warc.with_revisits(pages(spark).repartition(1), "page_id", "url", "html").coalesce(1), at, compress=compress)
    return warc.read_archives(spark, at)


def test_archives_round_trip(spark, tmp_path):
    for compress in (True, False):
        rows = archives(spark, f"{tmp_path}/{compress}", compress).collect()
        assert all(r.gap is None for r in rows) and len(rows) == len(PAGES)
        by = {int(r.record_id.removeprefix(warc.ID_PREFIX)): r for r in rows}
        for i, _, html in PAGES:
            data = (html or "").encode()
            revisit = i in (1, 2)
            assert by[i].type == ("revisit" if revisit else "response")
            assert by[i].refers_to == (f"{warc.ID_PREFIX}9" if revisit else None)
            assert by[i].payload_length == len(data) and by[i].payload_digest == hashlib.sha1(data).hexdigest()
            assert by[i].payload == (None if revisit else data)


def whole(compress):
    parts = [warc.record(str(i), u or "urn:none", "2026-01-01T00:00:00Z", (h or "").encode(), None) + b"\r\n" for i, u, h in PAGES]
    return [b"".join(m + b"\0" for m in warc.members(p)) if compress else p for p in parts]


def test_members_are_gzip():
    assert b"".join(gzip.decompress(p) for p in whole(True)) == b"".join(whole(False))


def test_salvage_of_damaged_archives():
    for compress in (True, False):
        parts = whole(compress)
        for damage in range(len(parts)):
            hurt = bytearray(parts[damage])
            hurt[-6] ^= 0x55  # the block's end, or the checksum of a member
            data = b"".join([*parts[:damage], bytes(hurt), *parts[damage + 1 :]])
            found = list(warc.salvage(data))
            ids = [r.headers["warc-record-id"] for r in found if isinstance(r, warc.Record)]
            assert ids == [f"<{warc.ID_PREFIX}{p[0]}>" for k, p in enumerate(PAGES) if k != damage]
            gaps = [g for g in found if isinstance(g, warc.Gap)]
            begin = len(b"".join(parts[:damage]))
            assert [(g.begin, g.end) for g in gaps] == [(begin, begin + len(hurt))]
        data = b"junk" + b"".join(parts)[:-9]
        found = list(warc.salvage(data))
        assert (found[0].begin, found[0].end) == (0, 4) and isinstance(found[-1], warc.Gap) and found[-1].end == len(data)
        assert len(found) == len(PAGES) + 1
    assert list(warc.salvage(b"")) == []


def test_long_records_take_several_members(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 500)
    data = b"".join(m + b"\0" for m in warc.members(warc.record("1", "u", "d", b"z" * 3000, None) + b"\r\n"))
    found = list(warc.salvage(data + whole(True)[2]))
    assert [len(warc.payload_of(r.headers, r.block)) for r in found] == [3000, 5]


def test_long_addresses_and_records_at_the_end_of_files(spark, tmp_path):
    html = random.Random(3).randbytes(9 << 20).hex()  # over 15 MB: two members
    rows = [(1, "data:," + "x" * 100_000, "a"), (2, " " * 40_000, "b"), (3, "u", html), (4, "v", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for compress in (True, False):
        at = f"{tmp_path}/{compress}"
        warc.write_archives(warc.with_revisits(df, "page_id", "url", "html").coalesce(1), at, compress=compress, row_bytes=1, file_rows=1)
        read = warc.read_archives(spark, at).collect()
        assert all(r.gap is None for r in read) and len({r.archive for r in read}) == len(rows)
        got = {int(r.record_id.removeprefix(warc.ID_PREFIX)): (r.url, r.payload.decode()) for r in read}
        assert got == {i: (u.replace(" ", "%20"), h) for i, u, h in rows}


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 100).alias("html")).coalesce(1)
    for compress in (True, False):
        at = f"{tmp_path}/{compress}"
        warc.write_archives(warc.with_revisits(rows, "page_id", "url", "html").coalesce(1), at, compress=compress, row_bytes=50_000, file_rows=4)
        sizes = [r.length for r in spark.read.format("binaryFile").load(at).select("length").collect()]
        assert len(sizes) > 12 and max(sizes) <= 4 * 50_000 + 8
        assert warc.complete(warc.read_archives(spark, at)).count() == 400


def test_gaps_are_logged_and_can_be_errors(spark, tmp_path):
    parts = whole(True)
    hurt = bytearray(parts[2])
    hurt[20] ^= 0x55
    os.makedirs(f"{tmp_path}/a")
    with open(f"{tmp_path}/a/one.warc.gz", "wb") as f:
        f.write(b"".join([*parts[:2], bytes(hurt), *parts[3:]]))
    found = warc.read_archives(spark, f"{tmp_path}/a")
    begin = len(parts[0]) + len(parts[1])
    assert [(r.begin, r.end) for r in warc.gaps(found).collect()] == [(begin, begin + len(hurt))]
    assert found.where("gap is null").count() == len(PAGES) - 1
    with pytest.raises(Exception, match=f"a gap in .*one.warc.gz, bytes {begin} to"):
        warc.complete(found).select("record_id").collect()


def test_revisits_of_rows_without_ids_and_repeated_rows(spark):
    x, y = "x" * 1500, "y" * 1500
    rows = [(None, x), (4, x), (4, x), (7, x), (None, y), (3, "short"), (9, "short"), (5, y), (5, "z" * 1500)]
    df = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string")
    got = sorted(((r.id, bytes(r.payload).decode()[0], r.refers_to) for r in warc.with_revisits(df, "page_id", "url", "html").collect()), key=str)
    assert got == sorted([(None, "x", 7), (4, "x", 7), (4, "x", 7), (7, "x", None), (None, "y", 5), (3, "s", None), (9, "s", None), (5, "y", None), (5, "z", None)], key=str)


def test_headers_longer_than_a_member(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 500)
    found = list(warc.salvage(warc.packed_record(warc.record("1", "u" * 2000, "d", b"z" * 3000, None) + b"\r\n") + b"\0"))
    assert len(found) == 1 and found[0].headers["warc-target-uri"] == "u" * 2000


def test_empty_table(spark, tmp_path):
    warc.write_archives(warc.with_revisits(pages(spark).limit(0), "page_id", "url", "html"), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0
