"""The filter audit against a plain loop over documents, orders and steps."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import Row

from terrasheet.llm import filter_audit


def flags(text, smaller):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": smaller,
    }


def plain(docs, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = [(i, lang or "", flags(text or "", i is not None and least[text or ""] < i)) for i, text, lang in docs]
    out, shares = {}, Counter()
    for part in {p for _, p, _ in rows}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                own = [(i, x) for i, p, x in rows if p == part]
                reach = [(i, x) for i, x in own if not any(x[g] for g in order[:k])]
                gone = [i for i, x in reach if x[f]]
                shares[part, f] += len(gone)
                only = sum(x[f] and sum(x.values()) == 1 for _, x in own)
                out[part, "".join(order), k + 1] = [len(reach) - len(gone), len(gone), sum(x[f] for _, x in own) - len(gone), only, sum(i in good for i in gone), sum(i in toxic for i in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(spark, docs, labels):
    d = spark.createDataFrame([Row(*x, "e") for x in docs], "doc_id long, text string, lang string, E string")
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == plain(docs, labels)


def test_audit_equals_plain_loops(spark):
    many = " ".join(f"w{k}" for k in range(120))
    texts = [None, "", "a b", many, f"{many}\x0b#", "SHOUT " * 120, many.upper(), "x " * 101, f"{many} é漢", "  ", "a b"]
    docs = [(100 - k, t, lang) for k, (t, lang) in enumerate((t, lang) for t in texts for lang in ("en", None, "", "de"))]
    docs += [(3, many, "en"), (3, many, "en"), (None, many, "en"), (None, many, "fr"), (None, "odd", "fr"), (None, "odd", "fr")]
    labels = [(k, k % 2, (k % 3 == 0) * 1) for k in range(60, 101)] + [(3, 1, 1), (100, 1, None), (99, None, 1), (None, 1, 1), (98, 0, 1), (98, 1, 0)]
    check(spark, docs, labels)


def test_copies_pass_once(spark):
    check(spark, [(k, "same", "en" if k % 3 else "de") for k in range(200, 0, -1)], [(1, 1, 0), (7, 1, 1)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    check(spark, [(1, "one", "en")], [])


def test_survivors_have_all_sets(spark):
    counted = spark.createDataFrame([Row("en", False, True, False, False, True, 4, 1, 0), Row("en", False, False, False, False, False, 2, 0, 1)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, kept long, good long, toxic long")
    got = {r.filters: r.kept for r in filter_audit.survivors(counted).collect()}
    assert got == {s: 2 if s & (filter_audit.bits("B") | filter_audit.bits("E")) else 6 for s in range(32)}
