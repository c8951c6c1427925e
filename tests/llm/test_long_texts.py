"""Runs of a million characters, alone and behind words, go through every operator over texts, with a row for each document."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, lexical, license_scan, near_dup, packing, secret_scan, simhash, source_audit, token_count, toxicity

PROSE = "The quick brown fox jumps over the lazy dog and then sleeps under the old tree by the river all day long. " * 3
RUNS = [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "‍\U0001f469" * 500_000, "ab " * 350_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, PROSE, "en", "s") for i in range(3)] + [(10 + i, r, "en", "s") for i, r in enumerate(RUNS)] + [(20 + i, PROSE + r, "fr", "t") for i, r in enumerate(RUNS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long")).repartition(4).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE)], "item_id long, text string")


def test_rows_for_every_document(docs, bench):
    n = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in simhash.simhash_groups(docs).collect()} == ids
    counts = {r.doc_id: r for r in token_count.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert set(counts) == ids and counts[10].n_tokens == 0 and counts[20].n_tokens == counts[0].n_tokens and counts[24].over_limit
    assert secret_scan.scan(docs).count() == secret_scan.redact(docs).count() == n
    model = langid.fit(docs)
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}[10] == "und"
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert toxicity.toxicity(docs, toxicity.fit(docs, labels)).count() == n


def test_searches_and_statistics(docs, bench):
    top = {r.doc_id for r in lexical.ranked(docs, bench).collect()}
    assert top >= {0, 1, 2, 20, 21} and not top & {10, 11, 12, 13}
    assert source_audit.divergence(docs, least=1).where("part = 'term' AND item = 'fox'").count() == 0  # no source has more of it than its language
    clean = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert clean == {10, 11, 12, 13, 14}
    license_scan.license_scan(docs).collect()


def test_near_duplicates_and_packing(docs):
    kept = {r.doc_id for r in near_dup.near_dedup(docs).collect()}
    assert 0 in kept and not kept & {1, 2}
    placed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 1024 for r in placed)
