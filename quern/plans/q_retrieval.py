"""Retrieval queries over the graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import normalize as N
from quern.operators import retrieval as R
from quern.plans.catalog import register
from quern.sources.views import Views, ctes

QUERY = "red ring"
TERMS = ("red ring", "red", "ring")
TOP = 10
_HIT = " OR ".join("contains({0}, '%s')" % t for t in TERMS)
_RANK = f"CASE WHEN name = '{QUERY}' THEN 0 WHEN name IN ('red ring', 'red', 'ring') THEN 1 WHEN {_HIT.format('name')} THEN 2 WHEN {_HIT.format('definition')} THEN 3 ELSE 4 END"
_ALIAS = f"len(list_filter(aliases, lambda a: {_HIT.format('a')})) > 0"
_TEXT = f"""hit_e AS (SELECT id, source_id, anchor_ref FROM evidence WHERE {_HIT.format('excerpt')}),
ev AS (SELECT target_id AS id FROM mentions WHERE source_refs[1] IN (SELECT id FROM hit_e) UNION SELECT target_id FROM mentions WHERE (source_id, anchor_ref) IN (SELECT source_id, anchor_ref FROM hit_e)),
bd AS (SELECT node_id AS id FROM bodies WHERE {_HIT.format('content')}),
cd AS (SELECT c.node_id AS id FROM cards c LEFT JOIN sections s ON c.node_id = s.node_id WHERE {_HIT.format('summary')} OR {_HIT.format("array_to_string(s.content, ',')")}),
f AS (SELECT n.*, {_HIT.format('name')} AS h1, {_HIT.format('definition')} AS h2, {_ALIAS} AS h3, id IN (SELECT id FROM cd) AS h4, id IN (SELECT id FROM bd) AS h5, id IN (SELECT id FROM ev) AS h6
  FROM nodes n WHERE status <> 'deprecated'),
t AS (SELECT id, name, kind, {_RANK} AS text_rank,
  concat_ws(',', CASE WHEN h1 THEN 'name' END, CASE WHEN h2 THEN 'definition' END, CASE WHEN h3 THEN 'alias' END, CASE WHEN h4 THEN 'card' END, CASE WHEN h5 THEN 'body' END, CASE WHEN h6 THEN 'evidence' END) AS reasons
  FROM f WHERE h1 OR h2 OR h3 OR h4 OR h5 OR h6)"""
_COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
_SIM = f"sim AS (SELECT a.id, a.vec_id, a.label, {_COS} AS s FROM vectors a, (SELECT e FROM vectors WHERE vec_id = 7) b)"


def _first_vector(v: Views, k: int = 7) -> list[float]:
    """The stored vector that stands in for an embedding service's answer: one row."""
    return v.embeddings.where(F.col("vec_id") == k).select(F.col("embedding").cast("array<double>")).first()[0]


def _sides(v: Views) -> dict:
    return {"cards": v.cards, "bodies": v.bodies, "mentions": v.mentions, "evidence": v.evidence}


@register("r2_text_search", f"{ctes('nodes', 'evidence', 'mentions', 'cards', 'bodies')}, {_TEXT} SELECT id, name, kind, text_rank, reasons FROM t ORDER BY text_rank, length(name), name, id LIMIT 90")
def r2(spark, d):
    v = Views(spark, d)
    return R.text_search(v.nodes, QUERY, 90, **_sides(v)).withColumn("reasons", F.array_join("reasons", ","))


@register("r4_vector_topk", f"{ctes('vectors')}, {_SIM} SELECT id, round(s, 6) AS similarity FROM sim ORDER BY s DESC, id LIMIT 20")
def r4(spark, d):
    v = Views(spark, d)
    return R.vector_search(v.embeddings, _first_vector(v), 20).select("id", F.round("similarity", 6).alias("similarity"))


@register("r5_vector_fallback", f"""{ctes('vectors')}, {_SIM},
u AS (SELECT id, s, 0 AS rr FROM sim WHERE label < 5 ORDER BY s DESC, id LIMIT 15), n AS (SELECT id, s, 1 AS rr FROM sim WHERE label >= 5 ORDER BY s DESC, id LIMIT 15)
SELECT id, round(s, 6) AS similarity, CASE rr WHEN 0 THEN 'apiunit_embedding' ELSE 'embedding' END AS reason FROM (SELECT * FROM u UNION ALL SELECT * FROM n) ORDER BY s DESC, rr, id LIMIT 15""")
def r5(spark, d):
    v = Views(spark, d)
    out = R.vector_search_with_fallback(v.embeddings.where("label < 5"), v.embeddings, _first_vector(v), 15)
    return out.withColumn("similarity", F.round("similarity", 6))


_FUSED = f"""{ctes('nodes', 'evidence', 'mentions', 'cards', 'bodies', 'vectors')}, {_TEXT}, {_SIM},
tr AS (SELECT id, reasons, row_number() OVER (ORDER BY text_rank, length(name), name, id) AS r FROM t QUALIFY r <= 24),
vr AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS r FROM sim QUALIFY r <= 24)
SELECT coalesce(tr.id, vr.id) AS id, round(coalesce(1 / (60 + tr.r), 0) + coalesce(1 / (60 + vr.r), 0), 9) AS score, tr.id IS NOT NULL AS text_match, vr.id IS NOT NULL AS vector_match,
  concat_ws(',', reasons, CASE WHEN vr.id IS NOT NULL THEN 'embedding' END) AS reasons
FROM tr FULL JOIN vr ON tr.id = vr.id ORDER BY coalesce(1 / (60 + tr.r), 0) + coalesce(1 / (60 + vr.r), 0) DESC, 1 LIMIT 8"""


@register("r7_hybrid_rrf", _FUSED)
def r7(spark, d):
    v = Views(spark, d)
    out = R.hybrid_search(v.nodes, v.embeddings, QUERY, _first_vector(v), 8, **_sides(v))
    return out.select("id", F.round("score", 9).alias("score"), "text_match", "vector_match", F.array_join("reasons", ",").alias("reasons"))


@register("r8_text_only_mode", f"""{ctes('nodes', 'evidence', 'mentions', 'cards', 'bodies')}, {_TEXT}
SELECT id, round(1 / (60 + r), 9) AS score, true AS text_match, false AS vector_match FROM (SELECT id, row_number() OVER (ORDER BY text_rank, length(name), name, id) AS r FROM t) WHERE r <= 8""")
def r8(spark, d):
    v = Views(spark, d)
    return R.hybrid_search(v.nodes, v.embeddings, QUERY, None, 8, **_sides(v)).select("id", F.round("score", 9).alias("score"), "text_match", "vector_match")


@register("r9_simple_search", f"""{ctes('nodes')} SELECT id, name, kind FROM nodes WHERE status <> 'deprecated' AND (contains(name, 'ring') OR contains(definition, 'ring') OR len(list_filter(aliases, lambda a: contains(a, 'ring'))) > 0)
ORDER BY name, id LIMIT 120""")
def r9(spark, d):
    return R.simple_search(Views(spark, d).nodes, "ring")


@register("r10_semantic_neighbours", f"{ctes('vectors')}, {_SIM} SELECT id, round(s, 6) AS similarity FROM sim WHERE vec_id <> 7 ORDER BY s DESC, id LIMIT 10")
def r10(spark, d):
    return R.semantic_neighbours(Views(spark, d).embeddings, "part:7").withColumn("similarity", F.round("similarity", 6))


_TERMS = """terms AS (SELECT DISTINCT id AS node_id, term, lower(trim(term)) AS term_norm FROM (SELECT id, name AS term FROM nodes WHERE status <> 'deprecated'
  UNION ALL SELECT id, unnest(aliases) FROM nodes WHERE status <> 'deprecated'))"""
_LOCAL = f"""{ctes('nodes')}, {_TERMS},
loc AS (SELECT id, name, kind, term, CASE WHEN term_norm = 'red' THEN 100.0 WHEN starts_with(term_norm, 'red') THEN 85.0 WHEN definition ILIKE '%red%' THEN 70.0 END AS score FROM nodes JOIN terms ON id = node_id WHERE status <> 'deprecated')"""


def _terms(v: Views):
    t = N.node_terms(v.nodes).where("term_type <> 'tag'").select("node_id", "term", "term_norm")
    return t


@register("r11_local_candidates", f"{_LOCAL} SELECT id, name, kind, term, score::DOUBLE AS score FROM loc WHERE score IS NOT NULL ORDER BY score DESC, name, id, term LIMIT 60")
def r11(spark, d):
    v = Views(spark, d)
    return R.local_candidates(_terms(v), v.nodes, "red", 20)


@register("r12_vector_candidates", f"{ctes('vectors')}, {_SIM} SELECT id, round(s, 6) AS similarity, round(40 + 50 * s, 6) AS score FROM (SELECT * FROM sim ORDER BY s DESC, id LIMIT 40) WHERE s >= 0.3")
def r12(spark, d):
    v = Views(spark, d)
    return R.vector_candidates(v.embeddings, _first_vector(v), 20, 0.3).select("id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


_CAND = """c AS (SELECT 'part:' || user_id AS node_id, 'n' || user_id AS name, value AS score, event_type AS method, event_id AS pos, user_id % 7 AS query_pos FROM events)"""


def _candidates(v: Views):
    return v.table("events").selectExpr(
        "concat('part:', user_id) AS node_id", "concat('n', user_id) AS name", "value AS score", "event_type AS method", "event_id AS pos", "user_id % 7 AS query_pos"
    )


@register("r13_merge_candidates", f"""WITH RECURSIVE {_CAND},
o AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY pos) AS i FROM c),
f AS (SELECT node_id, i, score, method FROM o WHERE i = 1 UNION ALL
  SELECT o.node_id, o.i, CASE WHEN o.score > f.score THEN o.score ELSE f.score + o.score * 0.1 END, CASE WHEN o.score > f.score THEN o.method ELSE f.method || '+' || o.method END
  FROM f JOIN o ON o.node_id = f.node_id AND o.i = f.i + 1)
SELECT node_id, round(score, 6) AS score, method FROM f QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY i DESC) = 1""")
def r13(spark, d):
    return R.merge_candidates(_candidates(Views(spark, d)), 1 << 30).select("node_id", F.round("score", 6).alias("score"), "method")


@register("r14_best_of_queries", f"WITH {_CAND} SELECT node_id, max(score) AS score, arg_max(query_pos, score) AS query_pos FROM (SELECT node_id, score, min(query_pos) AS query_pos FROM c GROUP BY ALL) GROUP BY node_id")
def r14(spark, d):
    return R.best_of_queries(_candidates(Views(spark, d))).select("node_id", "score", "query_pos")


@register("r15_rank_rows", f"""WITH {_CAND} SELECT query_pos, node_id, score, row_number() OVER (PARTITION BY query_pos ORDER BY score DESC, node_id)::INT AS rank
FROM (SELECT query_pos, node_id, max(score) AS score FROM c GROUP BY ALL)""")
def r15(spark, d):
    return R.rank_rows(_candidates(Views(spark, d)), "query_pos")


@register("r16_artifact_search", f"""{ctes('nodes')} SELECT id, name, CASE WHEN lower(name) = 'ring' THEN 1.0 WHEN starts_with(lower(name), 'ring') THEN 0.95 WHEN contains(lower(name), 'ring') THEN 0.9
  WHEN len(list_filter(aliases, lambda a: contains(lower(a), 'ring'))) > 0 THEN 0.82 ELSE 0.7 END::DOUBLE AS score
FROM nodes WHERE contains(lower(concat_ws(' ', name, definition, array_to_string(aliases, ' '), array_to_string(tags, ' '))), 'ring') ORDER BY score DESC, name, id LIMIT 60""")
def r16(spark, d):
    return R.artifact_search(Views(spark, d).nodes, "ring")


def _books(v: Views):
    return v.table("part").selectExpr("concat('part:', p_partkey) AS path", "p_name AS title", "p_type AS subject", "p_brand AS stage", "p_size % 5 AS grade", "p_name", "p_partkey")


_COMPACT = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@register("r17_hint_scores", f"""WITH b AS (SELECT 'part:' || p_partkey AS path, {_COMPACT.format('p_name')} AS title, {_COMPACT.format("concat_ws(' ', p_type, p_brand)")} AS path_text, {_COMPACT.format('p_type')} AS subject, {_COMPACT.format('p_brand')} AS stage FROM part),
s AS (SELECT path, (CASE WHEN title = 'ring' THEN 100 WHEN contains(title, 'ring') OR contains('ring', title) THEN 70 WHEN contains(path_text, 'ring') THEN 35 ELSE 0 END)
  + (CASE WHEN contains(path_text, 'brand1') THEN 24 ELSE 0 END) + (CASE WHEN contains(concat_ws(' ', title, path_text, ''), 'an') THEN 8 ELSE 0 END)
  + (CASE WHEN subject = 'promo' THEN 40 WHEN contains(title || path_text, 'promo') THEN 20 ELSE 0 END) + (CASE WHEN stage = 'brand12' THEN 20 WHEN contains(title || path_text, 'brand12') THEN 8 ELSE 0 END) AS score FROM b)
SELECT path, score::INT AS score FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 6""")
def r17(spark, d):
    b = _books(Views(spark, d)).select("path", R.compact("title").alias("title"), R.compact(F.concat_ws(" ", "subject", "stage")).alias("path_text"), R.compact("subject").alias("subject"), R.compact("stage").alias("stage"))
    node = R.hint_score(F.col("title"), F.col("path_text"), F.lit(""), ["ring"], ["brand1"], ["an"])
    book = R.metadata_score(F.concat("title", "path_text"), F.col("subject"), F.col("stage"), ["promo"], ["brand12"], [], [])
    return b.select("path", (node + book).alias("score")).where("score > 0").orderBy(F.desc("score"), "path").limit(6)


@register("r18_lock_books", """SELECT 'part:' || p_partkey AS path, true AS locked FROM part WHERE p_size % 5 = 2 AND p_brand = (SELECT min(p_brand) FROM part)""")
def r18(spark, d):
    v = Views(spark, d)
    b = _books(v)
    least = b.agg(F.min("stage")).first()[0]
    return R.lock_books(b, [(F.lit(True), F.col("grade") == 2), (F.lit(True), F.col("stage") == least)], F.col("grade"), 8).select("path", "locked")


@register("r19_book_candidates", """SELECT 'part:' || p_partkey AS path, p_type AS subject, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS stage FROM part
WHERE p_type = 'PROMO' OR p_name ILIKE '%re%' ORDER BY subject NULLS LAST, stage NULLS LAST, p_name, path LIMIT 48""")
def r19(spark, d):
    b = Views(spark, d).table("part").select(F.concat(F.lit("part:"), "p_partkey").alias("path"), F.col("p_type").alias("subject"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("stage"), "p_name")
    found = b.where((F.col("subject") == "PROMO") | F.ilike("p_name", F.lit("%re%")))
    return found.orderBy(F.asc_nulls_last("subject"), F.asc_nulls_last("stage"), "p_name", "path").limit(48).drop("p_name")


@register("r20_top_book", f"""WITH b AS (SELECT 'part:' || p_partkey AS path, p_name AS title, {_COMPACT.format("concat_ws(' ', p_name, p_type, p_brand)")} AS h FROM part)
SELECT path, title, (CASE WHEN contains(h, 'redring') THEN 200 ELSE 0 END + CASE WHEN contains(h, 'red') THEN 14 ELSE 0 END + CASE WHEN contains(h, 'ring') THEN 16 ELSE 0 END)::INT AS score FROM b ORDER BY score DESC, title, path LIMIT 1""")
def r20(spark, d):
    b = _books(Views(spark, d)).select("path", "title", R.compact(F.concat_ws(" ", "title", "subject", "stage")).alias("h"))
    return b.select("path", "title", R.book_score(F.col("h"), "red ring").alias("score")).where("score > 0").orderBy(F.desc("score"), "title", "path").limit(1)


@register("r21_grounding_context", f"""{ctes('evidence', 'mentions')},
h AS (SELECT target_id AS id, row_number() OVER (ORDER BY count(*) DESC, target_id) AS rank FROM mentions GROUP BY target_id QUALIFY rank <= 6),
e AS (SELECT h.id AS node_id, ev.id, ev.excerpt, row_number() OVER (PARTITION BY h.id ORDER BY ev.id) AS n FROM h JOIN mentions m ON m.target_id = h.id JOIN evidence ev ON ev.id = m.source_refs[1] QUALIFY n <= 5),
g AS (SELECT node_id, string_agg('evidence_id: ' || id || chr(10) || CASE WHEN length(trim(excerpt, ' ')) > 900 THEN substr(trim(excerpt, ' '), 1, 897) || '...' ELSE trim(excerpt, ' ') END, chr(10) ORDER BY n) AS x FROM e GROUP BY node_id)
SELECT h.id, md5(concat_ws(chr(10), 'node_id: ' || h.id, 'name: ' || h.id, x)) AS context FROM h LEFT JOIN g ON node_id = h.id""")
def r21(spark, d):
    v = Views(spark, d)
    h = v.mentions.groupBy(F.col("target_id").alias("id")).count().orderBy(F.desc("count"), "id").limit(6)
    h = R.ranked(h, F.desc("count"), "id").select("id", F.col("id").alias("name"), "rank")
    e = v.mentions.select(F.col("target_id").alias("node_id"), F.explode("source_refs").alias("id")).join(v.evidence.select("id", "excerpt"), "id")
    return R.grounding_context(h, e).select("id", F.md5("context").alias("context"))


@register("r22_citations", f"""{ctes('mentions')}, c AS (SELECT CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'part:' || user_id END AS node_id, 'doc:' || event_id % 200 AS evidence_id FROM events),
p AS (SELECT DISTINCT target_id AS node_id, source_refs[1] AS evidence_id FROM mentions),
r AS (SELECT trim(c.node_id) AS node_id, c.evidence_id, CASE WHEN trim(c.node_id) = '' THEN 'missing node_id or evidence_id' WHEN trim(c.node_id) NOT IN (SELECT node_id FROM p) THEN 'node was not retrieved'
  WHEN (trim(c.node_id), c.evidence_id) NOT IN (SELECT node_id, evidence_id FROM p) THEN 'evidence does not belong to retrieved node' END AS reason FROM c)
SELECT node_id, evidence_id, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT DISTINCT node_id, evidence_id, reason FROM r WHERE reason IS NULL""")
def r22(spark, d):
    v = Views(spark, d)
    c = v.table("events").selectExpr("if(event_id % 11 = 0, ' ', concat('part:', user_id)) AS node_id", "concat('doc:', event_id % 200) AS evidence_id")
    return R.check_citations(c, v.mentions.select(F.col("target_id").alias("node_id"), F.explode("source_refs").alias("evidence_id")))


@register("m5_cosine_pairs", f"""{ctes('vectors')} SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1""")
def m5(spark, d):
    e = Views(spark, d).embeddings
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(V.cosine("x", "y"), 6).alias("similarity"))


