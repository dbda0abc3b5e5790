"""A training-corpus pipeline: quality ranking, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and gives the documents that stay; the last one gives their tokens. Stages are judged on what the one
before has kept, which is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe_codec, decontaminate, near_dups, quality, secret_scan
from tallyspark.llm.common import keep, table

#: Least similarity of near-duplicates, in percent, that the second stage removes.
NEAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts; null texts rank as empty ones, repeated rows and rows without an id one by one, and without labels all stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates at ``NEAR_PERCENT``: see ``near_dups.deduplicated`` for ties, repeated ids and texts without words. Rows without an id stay."""
    return near_dups.deduplicated(docs, percent=NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark, row by row, whether or not their id is null or repeated. Null and empty texts stay.

    Texts are searched and dropped by a 64-bit hash of the text, since ids needn't be unique.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = decontaminate.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("hits") > 0).select(F.col("doc_id").alias("hash")).distinct()
    whole = docs.select(key.alias("hash"), F.struct(*docs.columns).alias("whole"))
    return whole.join(hit, "hash", "left_anti").select("whole.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars counted anew; null texts stay null, with 0 characters."""
    masked = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit integers), and whether decoding them gives the text back; null and empty texts have none."""
    coded = bpe_codec.encode(docs, decoded=True)
    return coded.select(*(c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns), "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("secrets", without_secrets), ("tokens", as_tokens)]
#: The first stage fits a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of what all stages keep of ``documents``, one row for each document; empty without documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
