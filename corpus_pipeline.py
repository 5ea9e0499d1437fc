"""A training corpus from raw documents, in five stages of the operators in terrasheet.llm.

Each stage works on all that its predecessor kept and its output is written before the next one reads it, so a lost
executor costs no more than the stage that runs. The first four return the columns of documents:

1. toxicity: documents with a score of TOXIC or more go. Labels are learned from rows whose crc32(doc_id) mod 3 isn't 1.
2. near_dedup: of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the row of the least doc_id
   stays (one without a doc_id only if no other has one; of rows with equal ids any one). Rows are told apart by a number
   of their own: different texts of one doc_id all stay, and so do rows without words.
3. decontamination: documents that hold a window of a benchmark item go.
4. secrets: secrets are replaced by a mark in the text, and n_chars is counted anew; no document goes.
5. bpe: doc_id, the number of token ids, the ids (little-endian unsigned 32-bit integers) and digests of these and of
   the bytes that decoding gives back.

Null and empty texts pass all stages; an empty table gives an empty one. Other columns of documents are kept by the first
four, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasheet.llm import bpe, decontaminate, near_dedup, secret_scan, toxicity
from terrasheet.llm.common import stored, table

TOXIC = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def packed(docs: DataFrame) -> DataFrame:
    """(row, text): all columns as one, so that no operator's own columns can clash with them."""
    return docs.select(F.struct(*columns(docs)).alias("row"), "text")


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs hasn't, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable)
    scored = toxicity.toxicity(packed(docs), model, output="score")
    return scored.where(F.col("score") < TOXIC).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = unused(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    ids = numbered.select(F.col(row).alias("row"), "doc_id")
    groups = near_dedup.near_groups(numbered, row, "text", size=SHINGLE_WORDS, percent=SIMILAR_PERCENT).select(F.col(row).alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = groups.join(ids, "row").groupBy("component_id").agg(first).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(packed(docs), table(spark, sf_dir, "benchmark"), doc_id="row")
    return found.where(~F.col("contaminated")).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.labelled_samples(docs, "text", key=F.col("doc_id")))
    found = secret_scan.secrets(packed(docs), "row", "text", model)
    clean = secret_scan.redacted(F.col("row.text"), F.col("spans"))
    size = F.when(F.size("spans") > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(F.col("row").withField("text", clean).withField("n_chars", size).alias("row")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # stored between, so that a task has one Python worker at a time
    ids = stored(bpe.encode_texts(docs, "doc_id", "text", RANKS, public_tokenizers.PATTERN), "pipeline-ids", "zstd")
    back = bpe.decode_ids(ids, "doc_id", "ids", RANKS, public_tokenizers.PATTERN, keep_ids=True)
    return back.select("doc_id", "n_tokens", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: The stages are models and whole texts; SQL can't express them. tests/llm/test_pipeline.py checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
