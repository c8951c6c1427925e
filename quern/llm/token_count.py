"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled for the counting.

Tier one is a compact table of the lengths of frequent pre-tokens (words between ASCII white space), fitted on a bounded
sample: about ``SAMPLE`` documents, and of their words the ``ENTRIES`` most frequent, encoded once on the driver and
broadcast. Tier two is each worker's bounded cache, filled by encoding the misses with the tokenizer. The table decides the
work, never the counts; ``hit_rate`` measures it.

The tokenizer must drop white space (as word_bpe_49k does): then no token crosses it and a text's count is the sum over its
words. Others are refused with an error. A special string inside a text counts as the library counts it.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are counted row by row; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm.common import arrow_map, worker_state
from quern.llm.vocab import LONGEST, WordCounter, drops_white_space, packed, read_tokenizer

LIMIT = 2048
#: Documents whose words are counted for tier one, at most about; entries of the table.
SAMPLE, ENTRIES = 20_000, 200_000


def sample_of(docs: DataFrame, sample: int, text: str) -> DataFrame:
    """About ``sample`` rows, evenly drawn."""
    return docs.select(text).where(F.rand(11) < min(1.0, sample / max(docs.count(), 1)))


def frequent_words(docs: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES, text: str = "text") -> list[bytes]:
    """The most frequent words (up to ``LONGEST`` bytes) of a sample of documents; counted by Spark, ``entries`` collected."""

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for x in b.column(0).cast(pa.large_binary()):
                held.update(w for w in (x.as_py() or b"").split() if len(w) <= LONGEST)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counts = sample_of(docs, sample, text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(entries).select("word").toArrow().column(0).to_pylist()


def frequent_lengths(docs: DataFrame, held: str, sample: int = SAMPLE, entries: int = ENTRIES, text: str = "text") -> dict[bytes, int]:
    """Word -> number of tokens of the frequent words, as the tokenizer gives them."""
    words = frequent_words(docs, sample, entries, text)
    found = Tokenizer.from_str(held).encode_batch([w.decode(errors="replace") for w in words], add_special_tokens=False)
    return {w: len(e.ids) for w, e in zip(words, found, strict=True)}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, entries: int = ENTRIES) -> DataFrame:
    """``docs`` to key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    held = read_tokenizer(path)
    if not drops_white_space(held):
        raise ValueError(f"{path} keeps white space or joins words: a text's count is not the sum over its words")
    state = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, held, packed(frequent_lengths(docs, held, sample, entries, text))))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counter = worker_state(state, WordCounter)
        data = [x.as_py() or b"" for x in b.column(1).cast(pa.large_binary())]
        n = [counter.count(x) for x in data]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            [key, "n_bytes", "n_tokens", "over_limit"],
        )

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean", 256, stateful=True)


def hit_rate(docs: DataFrame, path: str, sample: int = SAMPLE, entries: int = ENTRIES, text: str = "text") -> float:
    """The share of the words of all documents that tier one knows."""
    state = docs.sparkSession.sparkContext.broadcast(set(frequent_words(docs, sample, entries, text)))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        words = [(x.as_py() or b"").split() for x in b.column(0).cast(pa.large_binary())]
        return pa.RecordBatch.from_arrays([pa.array([sum(map(state.value.__contains__, w)) for w in words], pa.int64()), pa.array([len(w) for w in words], pa.int64())], ["hits", "n"])

    r = arrow_map(docs.select(text), run, "hits long, n long", 256).agg(F.sum("hits"), F.sum("n")).first()
    return (r[0] or 0) / max(r[1] or 0, 1)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
