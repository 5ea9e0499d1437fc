"""Secrets in texts, with DataFrame functions only: three patterns, and character Markov models for other random strings.

Two first-order Markov models of characters are counted from labelled samples, one of random strings and one of ordinary
identifiers. A run of identifier characters is a secret if it has a letter, the logarithm of its likelihood ratio reaches
the threshold and it doesn't overlap a pattern's span. The ratios of pairs of characters are whole thousandths of a nat
(at most 66 * 66 of them), so that sums don't depend on their order; they are a literal of the plan. The threshold is
calibrated: of the ordinary samples that training hasn't seen, one in FALSE_HITS lies above it.

Samples may be given (label, sample); labelled_samples makes them. Random ones are encodings of hashed numbers in three
alphabets. Ordinary ones are words of the corpus, and identifiers made of such words and of PROGRAM_WORDS: joined by
capitals, underscores, hyphens, slashes or dots, with and without numbers.

One pass over the texts, without a shuffle. Positions are code points, ends exclusive. The work grows in proportion to a
text's length: positions and overlaps come from running totals that are taken in chunks. Null and empty texts have no spans;
repeated rows have equal ones; very long texts are treated whole, in a task's memory. The id column may have any name;
other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, by kind in their order, the group that is measured, and its least length.
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: What finds the same matches as a pattern that is only a run, without stopping at every short one.
SEARCH = {"assign": PATTERNS["assign"][0], "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
KINDS = [*PATTERNS, "markov"]

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters that a run needs, and the least threshold, in nats, whatever calibration says.
LEAST_CHARS, LEAST_NATS = 16, 9.0
#: One in so many unseen ordinary samples may reach the threshold.
FALSE_HITS = 1000
#: Random strings and identifiers that are generated, and documents whose words are taken, about, to train the models.
RANDOM_SAMPLES, IDENTIFIERS, TRAINING_DOCS = 4000, 40_000, 2000
#: Words that identifiers of programs are made of, beside those of the corpus.
PROGRAM_WORDS = """
account action add address all api app array async auth base batch block body box buffer build button cache call case
channel char check checkpoint child class clear click client close code color column command config connection container
content context control convert copy count create current data date default delete device dir display document down
element elements encoder end entry error event exception export factory field file filter find first flag folder format
frame from function get global graph group handler has hash header height id image import index info init input insert
instance int internationalisation interface is item iterator job key kind label last layer layout length level library
line link list listener load local log loop make manager map match max memory menu message method min mode model models
module mouse name net next node note null num number object offset old on open option order output package page param
paragraph parent parse part path player point position print process profile project property query queue random range
read record ref register remove render report request reset resource response rest result return root row run save scale
schema screen script search section select send server service session set shape show size sort source stack start state
stop store stream string style system table tag target task test text thread time timer title token tool total train tree
type update upload url use user util utils validate value version view widget width window with word work write
""".split()

SPAN = "struct<start: int, kind: int, end: int, begin_byte: int, end_byte: int>"
#: Elements that one running total goes over; the totals of chunks have one of their own.
CHUNK = 512


class Model(NamedTuple):
    ratios: dict[str, int]
    least: int  # thousandths of a nat


# ---- arrays


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, add: Callable[[Column, Column], Column], first: int = 0) -> Column:
    """Of an array of numbers the totals before each element, and after the last one: one more than there are.

    Appending copies an array, so totals are taken within chunks and over the chunks' own totals.
    """
    zero = F.lit(first)
    none = F.array().cast("array<int>")
    totals = lambda part, start: F.aggregate(part, F.struct(start.alias("sum"), none.alias("out")), lambda acc, v: F.struct(add(acc["sum"], v).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out")), lambda acc: acc["out"])
    whole = lambda part: F.aggregate(part, zero, add)

    def chunked(v: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(CHUNK))
        chunks = F.transform(cuts, lambda k: F.slice(v, k + 1, CHUNK))
        return let(chunks, lambda c: F.concat(F.flatten(F.zip_with(c, totals(F.transform(c, whole), zero), totals)), F.array(F.aggregate(F.transform(c, whole), zero, add))))

    return let(values, chunked)


plus = lambda a, b: a + b
larger = lambda a, b: F.greatest(a, b)


# ---- spans


def occurrences(text: Column, kind: str) -> Column:
    """array<SPAN> of a kind's leftmost matches that are long enough."""
    pattern, group, least = PATTERNS[kind]
    good = lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least
    return placed(text, SEARCH[kind], KINDS.index(kind), good)


def placed(text: Column, pattern: str, kind: int, good: Callable[[Column], Column]) -> Column:
    """Spans of the pattern's matches, by the lengths of matches and of the texts between. Those without good(match) go."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans(pieces: Column) -> Column:
        # pieces: what lies between and what matches, by turns
        ends = lambda size: F.transform(pieces, size)
        at, byte = running(ends(lambda p: F.length(p)), plus), running(ends(lambda p: F.octet_length(p)), plus)
        rows = F.arrays_zip(pieces.alias("piece"), at.alias("at"), byte.alias("byte"))
        hits = F.filter(rows, lambda r, i: (i % 2 == 1) & good(r["piece"]) & r["piece"].isNotNull())
        return F.transform(hits, lambda r: F.struct(r["at"].alias("start"), F.lit(kind).alias("kind"), (r["at"] + F.length(r["piece"])).alias("end"), r["byte"].alias("begin_byte"), (r["byte"] + F.octet_length(r["piece"])).alias("end_byte")).cast(SPAN))

    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    turns = lambda p: F.slice(F.flatten(F.zip_with(p["between"], p["found"], lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), 1, 2 * F.size(p["found"]) + 1)
    return F.when(text.rlike(pattern), let(F.struct(between.alias("between"), found.alias("found")), lambda p: let(turns(p), spans))).otherwise(none)


def apart(base: Column, runs: Column) -> Column:
    """Those of runs (array<SPAN>) that overlap no span of base. Both in order by start."""

    def free(both: Column) -> Column:
        is_base = lambda x: x["kind"] < len(PATTERNS)
        before = running(F.transform(both, lambda x: F.when(is_base(x), x["end"]).otherwise(0)), larger)
        # the least start of base spans that follow, as the greatest of negated ones from the end
        after = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(is_base(x), -x["start"]).otherwise(-(1 << 31) + 1))), larger, -(1 << 31) + 1))
        rows = F.arrays_zip(both.alias("span"), F.slice(before, 1, F.size(both)).alias("before"), F.slice(after, 2, F.size(both)).alias("after"))
        own = F.filter(rows, lambda r: ~is_base(r["span"]) & (r["before"] <= r["span"]["start"]) & (-r["after"] >= r["span"]["end"]))
        return F.transform(own, lambda r: r["span"])

    return F.when((F.size(runs) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(base, runs)), free)).otherwise(runs)


# ---- models


def pair_counts(samples: DataFrame) -> DataFrame:
    """(label, pair, n): the pairs of neighbouring characters in samples (label int: 1 random, 0 ordinary; sample string)."""
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substring("sample", i, F.lit(2))))
    return samples.where(F.length("sample") > 1).select("label", pairs.alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def train(samples: DataFrame) -> Model:
    """Ratios and threshold from labelled samples (label int: 1 random, 0 ordinary; sample string), bounded by the caller.

    Half of them, by hash, give the log-likelihood ratios of pairs, each model's transitions smoothed by adding 1/2; of the
    other half the ordinary ones that are long enough give the threshold.
    """
    part = F.pmod(F.xxhash64("sample"), F.lit(2))
    counts: dict[tuple[int, str], int] = {(r.label, r.pair): r.n for r in pair_counts(samples.where(part == 0)).where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect()}
    totals = {(y, a): sum(counts.get((y, a + b), 0) for b in LETTERS) for y in (0, 1) for a in LETTERS}
    share = lambda y, a, b: (counts.get((y, a + b), 0) + 0.5) / (totals[y, a] + 0.5 * len(LETTERS))
    ratios = {a + b: round(1000 * math.log(share(1, a, b) / share(0, a, b))) for a in LETTERS for b in LETTERS}
    runs = samples.where(part == 1).where("label = 0").where(F.col("sample").rlike(f"^[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}$") & F.col("sample").rlike("[A-Za-z]"))
    most = runs.select(F.percentile(score(F.col("sample"), ratios), 1 - 1 / FALSE_HITS).alias("p")).first().p
    return Model(ratios, max(round(1000 * LEAST_NATS), math.ceil(most or 0) + 1))


def picked(words: Column, *numbers: Column) -> Column:
    """Of an array of words those at the places that numbers tell."""
    return F.array(*[F.get(words, F.pmod(n, F.size(words)).cast("int")) for n in numbers])


def labelled_samples(df: DataFrame, text_column: str, random_samples: int = RANDOM_SAMPLES, identifiers: int = IDENTIFIERS, training_docs: int = TRAINING_DOCS, key: Column | None = None) -> DataFrame:
    """(label, sample): random strings, and ordinary words and identifiers, from about training_docs texts of df.

    The texts are those whose key (a row's id; else the text itself, by which copies are taken all or none) hashes lowest;
    words that touch a pattern's match, or a digit, are no ordinary samples.
    """
    spark = df.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    forms = F.array(F.rtrim(F.translate(F.base64(F.unhex(digest)), "=", "")), F.substring(digest, 1, 40), F.substring(F.upper(F.translate(F.base64(F.unhex(digest)), "+/=", "")), 1, 30))
    random = spark.range(random_samples).select(F.lit(1).alias("label"), F.explode(forms).alias("sample"))
    share = min(1.0, training_docs / max(1, df.count()))
    texts = df.where(F.pmod(F.xxhash64(F.col(text_column) if key is None else key), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col(text_column).alias("t"))
    for pattern in SEARCH.values():
        texts = texts.select(F.regexp_replace("t", pattern, " ").alias("t"))
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]{4,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("sample"))

    # a bounded vocabulary: words of letters, the first of each of 4096 buckets of their hash
    bucket = F.pmod(F.xxhash64(F.lower("sample")), F.lit(4096))
    own = words.where(F.col("sample").rlike("^[A-Za-z]{4,12}$")).groupBy(bucket.alias("b")).agg(F.min(F.lower("sample")).alias("w"))
    vocabulary = own.agg(F.array_sort(F.collect_list("w")).alias("own")).select(F.when(F.size("own") > 0, F.col("own")).otherwise(F.lit(PROGRAM_WORDS)).alias("own"), F.lit(PROGRAM_WORDS).alias("known"))
    n = [F.xxhash64("id", F.lit(-1 - k)) for k in range(8)]
    made = spark.range(identifiers).crossJoin(F.broadcast(vocabulary))  # one row
    parts = F.slice(picked(F.when(F.col("id") % 2 == 0, F.col("known")).otherwise(F.col("own")), *n[:5]), 1, F.lit(2) + F.pmod(n[5], F.lit(4)).cast("int"))
    numbered = F.when(F.pmod(n[6], F.lit(2)) == 0, F.transform(parts, lambda w, i: F.concat(w, F.pmod(F.xxhash64("id", i), F.lit(1000)).cast("string")))).otherwise(parts)
    camel = F.array_join(F.transform(numbered, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")
    joined = [F.array_join(numbered, sep) for sep in ("_", "-", "/", "")]
    styles = F.array(camel, F.initcap(camel), *joined, F.upper(joined[0]), F.concat(joined[0], F.lit("="), camel))
    ordinary = made.select(F.get(styles, F.pmod(n[7], F.lit(8)).cast("int")).alias("sample"))
    return random.unionByName(words.unionByName(ordinary).select(F.lit(0).alias("label"), "sample"))


def score(run: Column, ratios: dict[str, int]) -> Column:
    """Thousandths of a nat by which a run of LETTERS is likelier random than ordinary."""
    low, width = ord(min(LETTERS)), ord(max(LETTERS)) - ord(min(LETTERS)) + 1
    table = [0] * (width * width)
    for pair, value in ratios.items():
        table[(ord(pair[0]) - low) * width + ord(pair[1]) - low] = value
    known = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # one literal, once the plan is optimised
    codes = F.transform(F.split(run, ""), F.ascii)
    at = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.get(known, (a - low) * width + b - low))
    return F.aggregate(at, F.lit(0), plus)


def secrets(df: DataFrame, id_column: str, text_column: str, model: Model) -> DataFrame:
    """(id, base, spans): array<SPAN> of the patterns' matches, and of all secrets, by start, then kind as in KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    base = F.array_sort(F.concat(*[occurrences(text, kind) for kind in PATTERNS]))
    good = lambda m: m.rlike("[A-Za-z]") & (score(m, model.ratios) >= model.least)
    runs = placed(text, f"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}", KINDS.index("markov"), good)
    found = given.select("id", base.alias("base"), runs.alias("runs"))
    return found.select(F.col("id").alias(id_column), "base", F.array_sort(F.concat("base", apart(F.col("base"), F.col("runs")))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with its spans (array<SPAN>, by start) replaced by a mark, those that overlap by one; null stays null."""

    def merged(s: Column) -> Column:
        """The bytes of the texts between the secrets: array<struct<a, b>>, b null for the last one."""
        before = running(F.transform(s, lambda x: x["end_byte"]), larger)
        rows = F.arrays_zip(s.alias("span"), F.slice(before, 1, F.size(s)).alias("before"))
        heads = F.filter(rows, lambda r: r["before"] <= r["span"]["begin_byte"])
        inner = F.transform(heads, lambda r: F.struct(r["before"].alias("a"), r["span"]["begin_byte"].alias("b")))
        return F.array_append(inner, F.struct(F.element_at(before, -1).alias("a"), F.lit(None).cast("int").alias("b")))

    pieces = let(text.cast("binary"), lambda data: F.transform(merged(spans), lambda p: F.substring(data, p["a"] + 1, F.coalesce(p["b"], F.octet_length(data)) - p["a"]).cast("string")))
    return F.when(F.size(spans) > 0, F.array_join(pieces, mark)).otherwise(text)
