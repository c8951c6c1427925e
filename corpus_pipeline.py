"""Corpus pipeline over ``documents``: language ID, SimHash near-dedup, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``:

* language_id drops documents whose language is ``und`` or scores under one half;
* simhash_dedup keeps one document (the smallest doc_id) of each group of near-duplicates: texts whose sets of five-word
  shingles are alike by 0.8 or more, found exactly (the op2 query's fingerprints and two bits are not used here);
* decontaminate drops documents in which a benchmark item is found;
* secret_scan replaces found secrets in the texts by a mark and sets n_chars accordingly;
* best_fit_packing returns the places of all token pieces in sequences of at most 1,024 tokens.

SQL cannot express hashing by fingerprints, alignment, lexing or packing, so there is no oracle: the stages are tested
against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, near_dup, packing, secret_scan
from quern.llm.common import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.near_dedup(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.redact(docs)
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
