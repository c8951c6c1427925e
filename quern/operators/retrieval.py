"""Retrieval and ranking (R1-R22). Queries are scalars where the reference serves one request, tables where it loops."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X
from quern.functions import vectors as V


def search_terms(query: str, cap: int = 40) -> list[str]:
    """The whole query, its parts of two or more characters, and n-grams (8 down to 2) of runs of CJK characters."""
    q = query.strip()
    if not q:
        return []
    parts = [p for p in re.split(r"[\W_]+", q) if len(p) >= 2]
    runs = re.findall("[㐀-鿿]{2,}", q)
    grams = (run[i : i + n] for run in runs for n in range(min(8, len(run)), 1, -1) for i in range(len(run) - n + 1))
    return list(dict.fromkeys([q, *parts, *grams]))[:cap]


def text_search(nodes: DataFrame, query: str, limit: int, cards: DataFrame | None = None, bodies: DataFrame | None = None, mentions: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Nodes (not deprecated) with a term in name, definition, alias, card, body or evidence; reasons; ranked; top ``limit``.

    Card, body and evidence hits become sets of node ids first, so each side table is scanned once and joined as a flag;
    evidence of the same source and anchor goes through the distinct pairs that hit, not through all pairs.
    """
    terms = search_terms(query)
    hit = lambda c: X.contains_any(c, terms)
    n = nodes.where(F.coalesce(F.col("status") != "deprecated", F.lit(False)))
    flags = {"name": hit("name"), "definition": hit("definition"), "alias": F.exists(F.coalesce("aliases", F.array().cast("array<string>")), hit)}
    sides: dict[str, DataFrame] = {}
    if cards is not None:
        sides["card"] = cards.where(hit("summary") | hit(F.to_json("sections"))).select(F.col("node_id").alias("id"))
    if bodies is not None:
        sides["body"] = bodies.where(hit("content")).select(F.col("node_id").alias("id"))
    if mentions is not None and evidence is not None:
        found = evidence.where(hit("excerpt")).select("id", "source_id", "anchor_ref")
        by_ref = mentions.select("target_id", F.explode("source_refs").alias("ref")).join(found, F.col("ref") == F.col("id"), "left_semi").select("target_id")
        by_place = mentions.join(found.select("source_id", "anchor_ref").distinct(), ["source_id", "anchor_ref"], "left_semi").select("target_id")
        sides["evidence"] = by_ref.union(by_place).select(F.col("target_id").alias("id"))
    for name, df in sides.items():
        n = n.join(df.distinct().withColumn(f"_{name}", F.lit(True)), "id", "left")
        flags[name] = F.coalesce(F.col(f"_{name}"), F.lit(False))
    for name, flag in flags.items():
        n = n.withColumn(f"hit_{name}", F.coalesce(flag, F.lit(False)))
    reasons = F.array_compact(F.array(*[F.when(F.col(f"hit_{k}"), F.lit(k)) for k in flags]))
    rank = (
        F.when(F.col("name") == query, 0).when(F.col("name").isin(terms), 1).when(F.col("hit_name"), 2).when(F.col("hit_definition"), 3).otherwise(4)
    )
    n = n.withColumn("reasons", reasons).where(F.size("reasons") > 0).withColumn("text_rank", rank)
    return n.orderBy("text_rank", F.char_length("name"), "name", "id").limit(limit).select("id", "name", "kind", "text_rank", "reasons")


def vector_search(vectors: DataFrame, query: Sequence[float], limit: int, reason: str = "embedding") -> DataFrame:
    """Exact top-k by cosine over (id, embedding); ties by id. The query vector is a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = V.cosine("embedding", q)
    return vectors.where(F.col("embedding").isNotNull()).select("id", sim.alias("similarity"), F.lit(reason).alias("reason")).orderBy(F.desc("similarity"), "id").limit(limit)


def vector_search_with_fallback(units: DataFrame | None, nodes: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """Unit vectors first, node vectors only for nodes without a unit vector (all, if there are no units); best per id."""
    if units is None:
        return vector_search(nodes, query, limit)
    rest = nodes.join(units.select("id"), "id", "left_anti")
    return merge_vector_rows(vector_search(units, query, limit, "apiunit_embedding"), vector_search(rest, query, limit), limit)


def merge_vector_rows(units: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Highest similarity per id, ties by unit rows first; top ``limit``."""
    both = units.unionByName(nodes).withColumn("reason_rank", F.when(F.col("reason") == "apiunit_embedding", 0).otherwise(1))
    best = both.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("neg"), "reason_rank", "reason", "similarity")).alias("b"))
    return best.select("id", "b.similarity", "b.reason", "b.reason_rank").orderBy(F.desc("similarity"), "reason_rank", "id").limit(limit).drop("reason_rank")


def rrf(text_rows: DataFrame, vector_rows: DataFrame, limit: int, k: int = S.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two bounded ranked lists (id, rank, reasons) by a full outer join."""
    t = text_rows.select("id", F.col("rank").alias("trank"), F.col("reasons").alias("treasons"))
    v = vector_rows.select("id", F.col("rank").alias("vrank"), F.col("reasons").alias("vreasons"), "similarity")
    part = lambda r: F.coalesce(1 / (F.lit(k) + F.col(r)), F.lit(0.0))
    none = F.array().cast("array<string>")
    f = t.join(v, "id", "full_outer").select(
        "id", (part("trank") + part("vrank")).alias("score"), F.col("trank").isNotNull().alias("text_match"), F.col("vrank").isNotNull().alias("vector_match"), "similarity",
        F.array_distinct(F.concat(F.coalesce("treasons", none), F.coalesce("vreasons", none))).alias("reasons"),
    )
    return f.orderBy(F.desc("score"), "id").limit(limit)


def ranked(df: DataFrame, *order: str | Column) -> DataFrame:
    """Ranks 1..n of a bounded list (the output of a top-k)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def hybrid_search(nodes: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float] | None, limit: int = 8, mode: str = "hybrid", **sides) -> DataFrame:
    """Mode ``text``, ``vector`` or ``hybrid``; without a query vector the text branch alone (text_only). Limit 1..30."""
    limit = max(1, min(30, limit))
    empty = nodes.sparkSession.createDataFrame([], "id string, rank int, reasons array<string>, similarity double")
    t = v = empty
    if mode != "vector":
        found = text_search(nodes, query, limit * 3, **sides)
        t = ranked(found, "text_rank", F.char_length("name"), "name", "id").select("id", "rank", "reasons")
    if mode != "text" and vector is not None:
        found = vector_search(vectors, vector, limit * 3)
        v = ranked(found, F.desc("similarity"), "id").select("id", "rank", F.array("reason").alias("reasons"), "similarity")
    return rrf(t, v, limit)


def simple_search(nodes: DataFrame, query: str, limit: int = 60) -> DataFrame:
    """R9, text part: one literal pattern on name, definition or alias; by name; twice the limit (at most 200)."""
    hit = lambda c: F.contains(X.col(c), F.lit(query))
    found = nodes.where("status <> 'deprecated'").where(hit("name") | hit("definition") | F.exists("aliases", hit))
    return found.orderBy("name", "id").limit(2 * min(200, limit)).select("id", "name", "kind")


def semantic_neighbours(vectors: DataFrame, of: str, limit: int = 10) -> DataFrame:
    """Nearest vectors to that of id ``of``, itself left out; ties by id; limit clamped to 1..24. The one row is broadcast."""
    one = vectors.where(F.col("id") == of).select(F.col("embedding").alias("q")).limit(1)
    found = vectors.where((F.col("id") != of) & F.col("embedding").isNotNull()).crossJoin(F.broadcast(one))
    return found.select("id", V.cosine("embedding", "q").alias("similarity")).orderBy(F.desc("similarity"), "id").limit(max(1, min(24, limit)))


def local_candidates(terms: DataFrame, nodes: DataFrame, query: str, limit: int, kind: str | None = None, domain_nodes: DataFrame | None = None) -> DataFrame:
    """One row per matching term: exact 100, prefix 85, definition (case-insensitive LIKE, unescaped) 70; three times the limit."""
    q = re.sub(r"\s+", " ", query.strip().lower())
    n = nodes.where("status <> 'deprecated'")
    if kind:
        n = n.where(F.col("kind") == kind)
    if domain_nodes is not None:
        n = n.join(domain_nodes, "id", "left_semi")
    j = n.join(terms.select(F.col("node_id").alias("id"), "term_norm", "term"), "id")
    score = F.when(F.col("term_norm") == q, S.SCORE_EXACT).when(F.startswith("term_norm", F.lit(q)), S.SCORE_PREFIX).when(F.ilike("definition", F.lit(f"%{query}%")), S.SCORE_DEFINITION)
    return j.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "name", "id", "term").limit(3 * limit).select("id", "name", "kind", "term", "score")


def vector_candidates(vectors: DataFrame, query: Sequence[float], limit: int, least: float = S.VECTOR_LEAST) -> DataFrame:
    """Twice the limit, similarity at least ``least``, score 40 + 50 * similarity."""
    found = vector_search(vectors, query, 2 * limit).where(F.col("similarity") >= least)
    return found.select("id", "similarity", (S.VECTOR_BASE + S.VECTOR_SCALE * F.col("similarity")).alias("score"))


def merge_candidates(rows: DataFrame, limit: int, key: Sequence[str] = ()) -> DataFrame:
    """Fold of candidates (node_id, name, score, method, pos) in order of pos, per ``key`` and node.

    A greater score replaces what was held (its bonus is lost); any other adds a tenth of its score and its method.
    The fold runs inside an aggregate over each node's own few rows.
    """
    step = F.aggregate(
        F.array_sort(F.collect_list(F.struct("pos", "score", "method", "name"))),
        F.struct(F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("score"), F.lit("").alias("method"), F.lit(None).cast("string").alias("name")),
        lambda a, r: F.when(
            a["top"].isNull() | (r["score"] > a["score"]),
            F.struct(r["score"].alias("top"), r["score"].alias("score"), r["method"].alias("method"), r["name"].alias("name")),
        ).otherwise(F.struct(a["top"].alias("top"), (a["score"] + r["score"] * S.DUPLICATE_BONUS).alias("score"), F.concat_ws("+", a["method"], r["method"]).alias("method"), a["name"].alias("name"))),
    )
    out = rows.groupBy(*key, "node_id").agg(step.alias("f")).select(*key, "node_id", "f.name", "f.score", "f.method")
    if not key:
        return out.orderBy(F.desc("score"), "name", "node_id").limit(limit)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "name", "node_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)


def best_of_queries(rows: DataFrame) -> DataFrame:
    """Per node the highest score over all queries (trimmed, distinct); ties keep the first query."""
    b = rows.groupBy("node_id").agg(F.max(F.struct("score", (-F.col("query_pos")).alias("neg"), "method")).alias("b"))
    return b.select("node_id", "b.score", (-F.col("b.neg")).alias("query_pos"), "b.method")


def rank_rows(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per query and node (the highest score) with ranks 1..n per query."""
    one = rows.groupBy(key, "node_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "node_id")))


def artifact_search(nodes: DataFrame, query: str, limit: int = 60) -> DataFrame:
    """Case-insensitive search over name, definition, aliases and tags; 1, .95, .9, .82 (alias) or .7."""
    q = query.strip().lower()
    name = F.lower(F.trim("name"))
    whole = F.lower(F.concat_ws(" ", "name", "definition", "aliases", "tags"))
    score = (
        F.when(name == q, 1.0).when(F.startswith(name, F.lit(q)), 0.95).when(F.contains(name, F.lit(q)), 0.9)
        .when(F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q))), 0.82).otherwise(0.7)
    )
    if not q:
        return nodes.limit(0).select("id", "name", F.lit(0.0).alias("score"))
    return nodes.where(F.contains(whole, F.lit(q))).select("id", "name", score.alias("score")).orderBy(F.desc("score"), "name", "id").limit(max(1, limit))


def compact(c: str | Column) -> Column:
    """Lower-cased letters and digits only (the form in which catalogues are matched)."""
    return F.regexp_replace(F.lower(X.col(c)), r"[^\p{L}\p{N}]+", "")


def book_score(haystack: Column, query: str, subject: Column | None = None) -> Column:
    """200 for the whole query (3 or more characters), and min(40, 8 + 2 * length) for each distinct term found."""
    squeeze = lambda s: re.sub(r"[\W_]+", "", s.lower())
    q = squeeze(query)
    terms = list(dict.fromkeys(t for t in (squeeze(p) for p in re.split(r"[\s/_·-]+", query)) if len(t) >= 2))
    if not q and not terms:
        return F.lit(1)
    score = F.when(F.contains(haystack, F.lit(q)), 200).otherwise(0) if len(q) >= 3 else F.lit(0)
    for t in terms:
        score = score + F.when(F.contains(haystack, F.lit(t)), min(40, 8 + 2 * len(t))).otherwise(0)
    return score


def hint_score(title: Column, path: Column, body: Column, title_terms: Sequence[str], path_terms: Sequence[str], terms: Sequence[str]) -> Column:
    """R17, node part: 100/70/35 for title terms, 24 for path terms, 8 for terms anywhere, over compact texts."""
    score = F.lit(0)
    for t in title_terms:
        near = F.contains(title, F.lit(t)) | F.contains(F.lit(t), title)
        score = score + F.when(title == t, 100).when(near, 70).when(F.contains(path, F.lit(t)), 35).otherwise(0)
    for t in path_terms:
        score = score + F.when(F.contains(path, F.lit(t)), 24).otherwise(0)
    every = F.concat_ws(" ", title, path, body)
    for t in terms:
        if len(t) >= 2:
            score = score + F.when(F.contains(every, F.lit(t)), 8).otherwise(0)
    return score


def metadata_score(text: Column, subject: Column, stage: Column, subjects: Sequence[str], stages: Sequence[str], grades: Sequence[str], keywords: Sequence[str]) -> Column:
    """R17, book part: subject 40 (20 anywhere), stage 20 (8), grade 6, keyword of 3 or more characters 10."""
    score = F.lit(0)
    for t in subjects:
        score = score + F.when(subject == t, 40).when(F.contains(text, F.lit(t)), 20).otherwise(0)
    for t in stages:
        score = score + F.when(stage == t, 20).when(F.contains(text, F.lit(t)), 8).otherwise(0)
    for t in grades:
        score = score + F.when(F.contains(text, F.lit(t)), 6).otherwise(0)
    for t in keywords:
        if len(t) >= 3:
            score = score + F.when(F.contains(text, F.lit(t)), 10).otherwise(0)
    return score


def lock_books(books: DataFrame, stages: Sequence[tuple[Column, Column]], score: Column, limit: int) -> DataFrame:
    """Rows that pass every staged filter; if none do, the ``limit`` best by score. Each stage is (applies, passes).

    Whether any row passes is a one-row aggregate joined back, so no action runs on the driver.
    """
    ok = F.lit(True)
    for applies, passes in stages:
        ok = ok & (~applies | F.coalesce(passes, F.lit(False)))
    b = books.withColumn("locked", ok).withColumn("score", score)
    any_locked = b.agg(F.coalesce(F.max("locked"), F.lit(False)).alias("any_locked"))
    top = b.orderBy(F.desc("locked"), F.desc("score"), "path").limit(limit)
    whole = b.where("locked").select(*b.columns)
    return whole.unionByName(top.crossJoin(F.broadcast(any_locked)).where("not any_locked").drop("any_locked"))


def grounding_context(hits: DataFrame, evidence: DataFrame, max_hits: int = 6, per_hit: int = 5, chars: int = 900) -> DataFrame:
    """Text of the first hits with up to five excerpts each, cut to ``chars``. hits: id, name, rank; evidence: node_id, id, excerpt."""
    h = hits.where(F.col("rank") <= max_hits)
    cut = F.when(F.char_length(F.trim("excerpt")) > chars, F.concat(F.substring(F.trim("excerpt"), 1, chars - 3), F.lit("..."))).otherwise(F.trim("excerpt"))
    e = evidence.join(h.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("node_id").orderBy("id"))).where(F.col("n") <= per_hit)
    e = e.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("evidence_id: "), "id", F.lit("\n"), cut).alias("t")))), lambda x: x["t"]), "\n").alias("excerpts"))
    j = h.join(e, h["id"] == e["node_id"], "left")
    return j.select("id", "rank", F.concat_ws("\n", F.concat(F.lit("node_id: "), "id"), F.concat(F.lit("name: "), "name"), "excerpts").alias("context"))


def check_citations(citations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Citations (node_id, evidence_id) against retrieved (node_id, evidence_id) pairs: a reason for invalid ones, valid ones once."""
    c = citations.select(F.trim(F.coalesce("node_id", F.lit(""))).alias("node_id"), F.trim(F.coalesce("evidence_id", F.lit(""))).alias("evidence_id"))
    known = pairs.select("node_id").distinct().withColumn("known", F.lit(True))
    own = pairs.select("node_id", "evidence_id").distinct().withColumn("own", F.lit(True))
    c = c.join(known, "node_id", "left").join(own, ["node_id", "evidence_id"], "left")
    reason = (
        F.when((F.col("node_id") == "") | (F.col("evidence_id") == ""), "missing node_id or evidence_id").when(F.col("known").isNull(), "node was not retrieved")
        .when(F.col("own").isNull(), "evidence does not belong to retrieved node")
    )
    c = c.select("node_id", "evidence_id", reason.alias("reason"))
    return c.where("reason is not null").unionByName(c.where("reason is null").distinct())


def grounding_status(n_valid: Column, n_invalid: Column, n_unsupported: Column) -> Column:
    return F.when(n_valid == 0, "insufficient_context").when((n_invalid > 0) | (n_unsupported > 0), "partial").otherwise("grounded")


def read_queries(spark: SparkSession, path: str | None = None, values: Sequence[str] = ()) -> DataFrame:
    """query_text, query_id from values, a text file or JSON lines; an error if there is none."""
    if values:
        df = spark.createDataFrame([(v.strip(), None) for v in values], "query_text string, query_id string")
    elif path and path.endswith((".jsonl", ".json")):
        df = spark.read.schema("query_text string, query_id string").json(path)
    elif path:
        df = spark.read.text(path).select(F.trim("value").alias("query_text"), F.lit(None).cast("string").alias("query_id"))
    else:
        raise ValueError("no retrieval queries")
    df = df.where(F.coalesce(F.trim("query_text"), F.lit("")) != "")
    if not df.take(1):
        raise ValueError("no retrieval queries")
    return df
