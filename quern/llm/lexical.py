"""Ranked lexical search by Fagin's threshold algorithm.

Each query's ``k`` best documents, by integer impacts: a term weighs by its document frequency, its occurrences count with a
saturation that depends on the document's length. Statistics cover all documents.

Queries come in blocks of at most ``TERMS`` distinct terms, whatever their number; a block takes one pass over the texts,
which writes a forward index (document, length, the block's terms and their counts) to the shared folder. Document
frequencies and lengths are sums over it. The search then runs where the index lies, in shards of documents whose dense
forward index takes ``CELLS`` cells: each shard sorts a list of documents by impact for every term; a query reads its lists
round-robin, ``STRIDE`` places at a time, looks the new documents up in the forward index for their whole score, and stops when
the threshold (the sum of the impacts at the places reached) falls strictly below its kth score. A task keeps its k best from
shard to shard, so later shards stop earlier. Tasks return at most k rows a query, which are merged in two steps.

Defined results: null texts and queries, and those without a term, have no result and count in no statistic. Documents of
score 0 are no results. Equal scores rank by ascending id. Repeated documents are ranked row by row, repeated queries answered
row by row. Documents with a null id count in the statistics and are never returned. Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import terms
from quern.llm.common import arrow_map, limit_batches, scratch

K = 50
#: Distinct terms of a block of queries; cells (documents x terms) of a shard's forward index; places read from a list at a time.
TERMS, CELLS, STRIDE = 1 << 14, 1 << 23, 64
#: Groups of tasks that merge their results first.
MERGES = 32


def query_blocks(queries: DataFrame, key: str, most: int) -> Iterator[tuple[dict[bytes, int], list[tuple[int, np.ndarray]]]]:
    """(term -> number, [(key, numbers of the query's terms)]) of one block after another; a block's size is bounded."""
    by, vocab, items, size = terms.table(digits=True), {}, [], 0
    for r in queries.select(key, F.col("text").cast("binary")).toLocalIterator():
        own = dict.fromkeys(terms.split(r[1], by))
        if items and (len(vocab) + len(own) > most or size + len(own) > 8 * most):
            yield vocab, items
            vocab, items, size = {}, [], 0
        if own:
            items.append((r[0], np.array([vocab.setdefault(t, len(vocab)) for t in own], np.int64)))
            size += len(own)
    if items:
        yield vocab, items


def forward_index(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document with repeats), terms (numbers), tfs, of every document with a term at all."""
    held, by = docs.sparkSession.sparkContext.broadcast(vocab), terms.table(digits=True)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        numbers, ids, ns, found, tfs = held.value.get, [], [], [], []
        for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = terms.split(text.as_py(), by)
            if words:
                counts = Counter(map(numbers, words))
                counts.pop(None, None)
                ids.append(d), ns.append(len(words)), found.append(list(counts)), tfs.append(list(counts.values()))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"]
        )

    return arrow_map(docs.select("doc_id", F.col("text").cast("binary")), run, "doc_id long, n long, terms array<int>, tfs array<int>", 256)


class Shard:
    """Some documents' forward index (documents x terms, the saturated counts) and its lists by falling impact."""

    def __init__(self, ids: np.ndarray, ms: np.ndarray, lengths: np.ndarray, found: np.ndarray, tfs: np.ndarray, size: int):
        doc = np.repeat(np.arange(len(ids)), lengths)
        tf = tfs.astype(np.int64)
        g = 1_000_000_000 * tf // (1000 * tf + 20 * ms[doc])
        self.ids, self.forward = ids, np.zeros((len(ids), size), np.int32)
        self.forward[doc, found] = g
        order = np.lexsort((-g, found))
        self.docs, self.impacts = doc[order], g[order]
        self.starts = np.searchsorted(found[order], np.arange(size + 1))

    def search(self, numbers: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, stride: int = STRIDE) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """``best`` (scores, ids: falling scores, then ascending ids) with this shard's documents; documents looked up."""
        at, ends, depth, looked = self.starts[numbers], self.starts[numbers + 1], 0, 0
        seen = np.zeros(len(self.ids), bool)
        while True:
            # What the next place of each list holds bounds every document not seen yet; an exhausted list adds nothing.
            there = at + depth < ends
            threshold = int((weights[there] * self.impacts[at[there] + depth]).sum())
            if threshold < (int(best[0][k - 1]) if len(best[0]) >= k else 1):
                return best, looked
            new = np.concatenate([self.docs[a + depth : min(a + depth + stride, e)] for a, e in zip(at[there].tolist(), ends[there].tolist(), strict=True)])
            new = np.unique(new[~seen[new]])
            seen[new] = True
            looked += len(new)
            scores = self.forward[new[:, None], numbers].astype(np.int64) @ weights
            good = scores >= (best[0][k - 1] if len(best[0]) >= k else 1)
            scores, ids = np.append(best[0], scores[good]), np.append(best[1], self.ids[new[good]])
            order = np.lexsort((ids, -scores))[:k]
            best, depth = (scores[order], ids[order]), depth + stride


def weights_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def search(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """The forward index to query (place in ``items``), doc_id, score: each task's k best of every query."""
    size = len(weights)
    held = index.sparkSession.sparkContext.broadcast((items, weights))
    limit_batches(index.sparkSession)
    rows = max(64, CELLS // size)

    def run(batches):
        items, weights = held.value
        own = [weights[x] for x in items]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)

        def take(part: pa.Table):
            lists = part.column("terms").combine_chunks()
            ms = np.array([50 + 50 * x * n // total for x in part.column("n").to_pylist()], np.int64)
            shard = Shard(part.column("doc_id").to_numpy(), ms, lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(), part.column("tfs").combine_chunks().flatten().to_numpy(), size)
            for i, x in enumerate(items):
                best[i] = shard.search(x, own[i], best[i], k)[0]

        parts, there = [], 0
        for b in batches:
            for i in range(0, b.num_rows, rows):
                parts.append(b.slice(i, rows))
                there += parts[-1].num_rows
                if there >= rows:
                    table = pa.Table.from_batches(parts)
                    take(table.slice(0, rows))
                    parts = table.slice(rows).to_batches()
                    there -= rows
        if there:
            take(pa.Table.from_batches(parts))
        for i, (scores, ids) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids), pa.array(scores)], ["query", "doc_id", "score"])

    return index.where("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(run, "query int, doc_id long, score long")


def ranked(docs: DataFrame, queries: DataFrame, k: int = K, key: str = "item_id", block: int = TERMS) -> DataFrame:
    """``key``, rank (from 1), doc_id, score: the ``k`` documents of ``docs`` (doc_id, text) for each of ``queries`` (key, text)."""
    spark, kind = docs.sparkSession, queries.schema[key].dataType.simpleString()
    schema, out = f"{key} {kind}, rank int, doc_id long, score long", None
    for vocab, items in query_blocks(queries, key, block):
        index = scratch(forward_index(docs, vocab), "forward")
        n, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocab), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the block
            df[r["term"]] = r["count"]
        found = search(index, [x for _, x in items], weights_of(df, n), n, max(total, 1), k)
        order = [F.desc("score"), F.asc("doc_id")]
        for by in (["query", F.spark_partition_id() % MERGES], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"query int, {key} {kind}")
        part = found.join(names, "query").select(key, "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ranked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), stats AS (
  SELECT count(*) AS n, sum(n)::BIGINT AS l FROM lengths
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, stats s WHERE term IN (SELECT term FROM items) GROUP BY term
), scores AS (
  SELECT i.item_id, t.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + (50 * d.n * s.n) // s.l))))::BIGINT AS score
  FROM items i JOIN weights w ON i.term = w.term JOIN tf t ON i.term = t.term JOIN lengths d ON t.doc_id = d.doc_id, stats s
  GROUP BY i.item_id, t.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
