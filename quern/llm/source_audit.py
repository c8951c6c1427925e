"""Divergence of sources by joint count histograms.

Every (lang, source) group counts the terms that its language keeps: those in at least ``LEAST`` of its documents. For each
pair of sources of a language the distinct (count, count) combinations are tallied, the implied zero cells included, and the
measure f is evaluated once per combination, times its multiplicity. All arithmetic is exact.

One pass over the texts counts in the tasks (bounded tables, flushed when full) and deals (lang, term); a source's size is
no key, so a hot source does not matter. The histograms are built in two ways, so that no pair of sources is ever emitted
for a term:

* the sources of a language are numbered and dealt in tiles of ``TILE``; a term is one row per tile it occurs in, with its
  counts, and numpy tallies the combinations of two tiles for thousands of terms at once;
* cells where one count (or both) is zero come by inclusion and exclusion from each source's own histogram of counts.

``divergence`` returns both parts: ``pair`` (each other source of the language, all ranks) and ``term`` (the terms that a
group has more of than its language, to rank ``TOP``). The number of pair rows is the square of a language's sources, as
asked for; its terms only add to the histograms.

Defined results: null text, lang and source are read as ''. A group without terms has pair rows only. A language that keeps
no term gives pair rows of value 0. Equal values rank by item, as UTF-8. Repeated rows count as so many documents. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import terms
from quern.llm.common import limit_batches, merge_splits, release_state, scratch

LEAST, TOP, TILE = 10, 10, 64
#: Entries of a task's table of counts; rows of terms that are tallied at once.
ENTRIES, ROWS = 300_000, 1 << 14
SCALE = 1_000_000_000


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it): one row or more per key and task."""
    split_by = terms.table(digits=False)

    def flushed(held: dict):
        for (lang, source), (n, d) in held.items():
            keys = list(n)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), terms.texts(part), pa.array([n[k] for k in part], pa.int64()), pa.array([d[k] for k in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    def run(batches):
        release_state()
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, d = held[lang, source]
                size -= len(n)
                found = terms.split(text.as_py(), split_by)
                n.update(found)
                d.update(set(found))
                size += len(n)
                if size > ENTRIES:
                    yield from flushed(held)
                    size = 0
        yield from flushed(held)

    limit_batches(docs.sparkSession)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    return merge_splits(docs.select(*text, F.coalesce("text", F.lit("")).cast("binary").alias("text"))).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, total (of the language), lead (true in one row per lang and term), of kept terms."""
    counts = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    out = counts.select("lang", "source", "term", "n", F.sum("n").over(own).alias("total"), F.sum("docs").over(own).alias("docs"), (F.min("source").over(own) == F.col("source")).alias("lead"))
    return out.where(F.col("docs") >= least).drop("docs")


def tally(rows: DataFrame) -> DataFrame:
    """Rows of (lang, left, right: tiles, slots_l, counts_l, slots_r, counts_r) to lang, a, b, ca, cb, m, both counts over 0."""
    names = ["lang", "a", "b", "ca", "cb", "m"]

    def cells(key, part):
        lang, left, right = key
        dense = []
        for s, c in ((0, 1), (2, 3)):
            m = np.zeros((len(part), TILE), np.int64)
            m[np.repeat(np.arange(len(part)), [len(p[s]) for p in part]), np.concatenate([p[s] for p in part])] = np.concatenate([p[c] for p in part])
            dense.append(m)
        values, ranks = np.unique(np.stack(dense), return_inverse=True)
        x, y = ranks.reshape(2, len(part), TILE)
        n = len(values)
        for i in np.flatnonzero(dense[0].any(axis=0)).tolist():
            there = dense[0][:, i] > 0
            for j in np.flatnonzero(dense[1][there].any(axis=0)).tolist():
                if left == right and j <= i:
                    continue
                both = there & (dense[1][:, j] > 0)
                code, m = np.unique(x[both, i] * n + y[both, j], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(m), pa.string()), pa.array(np.full(len(m), left * TILE + i)), pa.array(np.full(len(m), right * TILE + j)), pa.array(values[code // n]), pa.array(values[code % n]), pa.array(m)],
                    names,
                )

    def run(batches):
        release_state()
        held, size = defaultdict(list), 0

        def flushed():
            for key, part in held.items():
                yield from cells(key, part)
            held.clear()

        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            lists = [[x.values.to_numpy() for x in b.column(i)] for i in range(3, 7)]
            for k, key in enumerate(keys):
                held[key].append([x[k] for x in lists])
            size += b.num_rows
            if size >= ROWS:
                yield from flushed()
                size = 0
        yield from flushed()

    cols = rows.select("lang", "left", "right", "slots_l", "counts_l", "slots_r", "counts_r")
    return cols.mapInArrow(run, "lang string, a long, b long, ca long, cb long, m long").groupBy(*names[:-1]).agg(F.sum("m").alias("m"))


def joint_histograms(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, a, b, ca, cb, m for numbers a < b of sources: the whole histogram, its multiplicities add up to the kept terms.

    Inclusion and exclusion: a cell (ca, 0) is what the source's own histogram has at ca less its cells with a count of the
    other, and (0, 0) is what remains of all kept terms.
    """
    numbered = kept.join(groups.select("lang", "source", "number"), ["lang", "source"])
    tiles = numbered.groupBy("lang", "term", F.expr(f"number div {TILE}").alias("tile")).agg(F.collect_list(F.struct((F.col("number") % TILE).alias("slot"), "n")).alias("held"))
    tiles = tiles.select("lang", "term", "tile", F.col("held.slot").alias("slots"), F.col("held.n").alias("counts"))
    side = lambda t: [F.col("tile").alias(t), F.col("slots").alias(f"slots_{t[0]}"), F.col("counts").alias(f"counts_{t[0]}")]
    rows = tiles.select("lang", *side("left"), *side("right"))
    if (groups.agg(F.max("number")).first()[0] or 0) >= TILE:  # else every term is one row, and two tiles never meet
        left, right = tiles.select("lang", "term", *side("left")), tiles.select("lang", "term", *side("right"))
        rows = rows.unionByName(left.join(right, ["lang", "term"]).where("left < right").drop("term"))
    both = scratch(tally(rows), "cells")
    own = numbered.groupBy("lang", "number", "n").agg(F.count("*").alias("m"))
    other = groups.select(F.col("lang").alias("own_lang"), F.col("number").alias("other"))
    single = own.join(other, (F.col("lang") == F.col("own_lang")) & (F.col("number") != F.col("other")))
    first = F.col("number") < F.col("other")
    zero = F.lit(0).cast("long")
    single = single.select("lang", F.least("number", "other").alias("a"), F.greatest("number", "other").alias("b"), F.when(first, F.col("n")).otherwise(zero).alias("ca"), F.when(first, zero).otherwise(F.col("n")).alias("cb"), "m")
    pairs = groups.select("lang", F.col("number").alias("a")).join(other, (F.col("lang") == F.col("own_lang")) & (F.col("a") < F.col("other")))
    none = pairs.join(langs.select("lang", "v"), "lang").select("lang", "a", F.col("other").alias("b"), zero.alias("ca"), zero.alias("cb"), F.col("v").alias("m"))
    at = lambda df, ca, cb, sign: df.select("lang", "a", "b", ca, cb, (sign * F.col("m")).alias("m"))
    ca, cb, za, zb = F.col("ca"), F.col("cb"), zero.alias("ca"), zero.alias("cb")
    cells = none.unionByName(single).unionByName(at(single, za, zb, -1)).unionByName(at(both, ca, cb, 1))
    cells = cells.unionByName(at(both, ca, zb, -1)).unionByName(at(both, za, cb, -1)).unionByName(at(both, za, zb, 1))
    return cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")


def share(count: str, total: str) -> str:
    """p in parts of ``SCALE`` for a count of a group with so many occurrences; ``v`` is the language's number of kept terms."""
    return f"(1 + (cast({SCALE} AS decimal(20, 0)) * cast({count} + 2 AS decimal(18, 0))) div cast({total} + 2 * v AS decimal(38, 0)))"


def measure(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    docs = docs.select("text", "lang", "source")
    kept = scratch(kept_terms(docs, least), "terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("lead").alias("v"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "lang_n", "v"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = scratch(groups.withColumn("number", number), "groups")

    of_lang = groups.groupBy("lang").agg(F.max("lang_n").alias("lang_n"), F.max("v").alias("v"))
    cells = joint_histograms(kept, groups, of_lang.where("v > 0"))
    side = lambda k: groups.select("lang", F.col("number").alias(k), F.col("source").alias(f"source_{k}"), F.col("group_n").alias(f"n_{k}"))
    priced = cells.join(side("a").join(of_lang, "lang"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    priced = priced.selectExpr("lang", "source_a", "source_b", "m", f"{share('ca', 'n_a')} AS p", f"{share('cb', 'n_b')} AS q")
    values = priced.groupBy("lang", "source_a", "source_b").agg(F.expr(f"sum(m * {measure('p', 'q')})").alias("value"))
    nothing = groups.where("v = 0")
    empty = nothing.select("lang", F.col("source").alias("source_a"), F.col("number").alias("x")).join(nothing.select("lang", F.col("source").alias("source_b"), F.col("number").alias("y")), "lang").where("x < y")
    values = values.unionByName(empty.select("lang", "source_a", "source_b", F.lit(0).cast("long").alias("value")))
    both = F.explode(F.array(*[F.struct(F.col(f"source_{a}").alias("source"), F.col(f"source_{b}").alias("item")) for a, b in ("ab", "ba")])).alias("x")
    pair = values.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    term = kept.join(groups.select("lang", "source", "group_n", "lang_n", "v"), ["lang", "source"])
    term = term.selectExpr("lang", "source", "term", f"{share('n', 'group_n')} AS p", f"{share('total', 'lang_n')} AS q").where("p > q")
    term = term.selectExpr("lang", "source", "'term' AS part", "term AS item", f"{measure('p', 'q')} AS value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT l.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, any_value(l.v) AS v, coalesce(sum(c.c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN langs l ON g.lang = l.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * g.v) AS p
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), terms AS (
  SELECT p.lang, p.source, p.term AS item, p.p, 1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS q
  FROM p JOIN kept k ON p.lang = k.lang AND p.term = k.term JOIN langs l ON p.lang = l.lang WHERE p.c > 0
), out AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', item, (((p - q) * (p - q)) // (p + q))::BIGINT FROM terms WHERE p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM out
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
