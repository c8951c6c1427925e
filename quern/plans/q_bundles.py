"""Bundle assembly and image filter: every turn of a conversation gives a node, unit, edge and so on of its lesson."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import bundles as B
from quern.plans.catalog import register

#: The bundle tables over (c: conversation, t: turn, x: text); read by both engines.
_RAW = {
    "nodes": """SELECT 'run:' || c AS lesson, pos, CASE WHEN t % 7 = 6 THEN '' ELSE 'n:' || c % 3 || '-' || t % 4 END AS id, CASE WHEN t % 3 = 0 THEN ' ' ELSE 'Name ' || t % 5 || ' ' END AS name,
      CASE WHEN t % 4 = 1 THEN '' ELSE x END AS definition, CASE WHEN t % 5 = 2 THEN {a}'Alias ' || c % 2, ' '{b} ELSE {none} END AS aliases, CASE WHEN t % 2 = 0 THEN {a}'law', 'odd'{b} ELSE {none} END AS domains FROM turns""",
    "units": """SELECT 'run:' || c AS lesson, pos, CASE WHEN t % 3 = 2 THEN 'ev1' ELSE 'ev' || t END AS anchor, CASE WHEN t % 5 = 3 OR c % 13 = 0 THEN ' ' ELSE x END AS excerpt, 'line:' || t AS locator,
      CASE WHEN t % 4 = 1 THEN 'image' ELSE 'text' END AS modality, {a}'n:' || c % 3 || '-' || t % 4, 'nope', 'n:' || c % 3 || '-' || (t + 1) % 4{b} AS node_ids FROM turns""",
    "edges": """SELECT 'run:' || c AS lesson, pos, CASE t % 3 WHEN 0 THEN 'n:' || c % 3 || '-' || t % 4 WHEN 1 THEN ' NAME  ' || t % 5 ELSE 'alias ' || c % 2 END AS from_key, 'n:' || c % 3 || '-' || (t + 2) % 4 AS to_key,
      CASE WHEN t % 4 = 3 THEN 'odd' ELSE 'uses' END AS type, 'ev' || t AS evidence_anchor, CASE WHEN t % 2 = 0 THEN 0.0 ELSE 0.5 END AS confidence FROM turns""",
    "profiles": "SELECT 'run:' || c AS lesson, pos, 'n:' || c % 3 || '-0' AS node_id, CASE WHEN t % 8 = 0 THEN 'physics' ELSE 'odd' END AS domain, {a}'primary', 'higher'{b} AS school_stages, {none} AS curriculum_roles FROM turns WHERE t % 4 = 0",
    "cards": "SELECT 'run:' || c AS lesson, pos, 'n:' || c % 3 || '-' || t % 4 AS node_id, 'ev' || t AS evidence_anchor, x AS essence, {a}' a', '', 'b'{b} AS key_points FROM turns WHERE t % 3 = 0",
    "hints": "SELECT 'run:' || c AS lesson, 1 AS pos, x AS excerpt, 'line:' || t AS locator, 'table' AS modality FROM turns WHERE t = 4 AND c % 13 <> 0",
    "lessons": """SELECT DISTINCT 'run:' || c AS lesson, 'Book ' || c % 5 || '!' AS book_id, 'a' || c AS anchor_ref, 'T' || c AS title, 'src' AS source_id, CASE WHEN c % 2 = 0 THEN 'physics' ELSE 'cooking' END AS subject,
      'higher' AS school_stage, CASE WHEN c % 11 = 0 THEN 'no_knowledge' ELSE 'extracted' END AS disposition FROM turns""",
}
_TURNS = "SELECT conv_id AS c, turn AS t, CAST(turn + 1 AS INT) AS pos, text AS x FROM "
_MORE = {
    "nodes": {c: "string" for c in ("title", "label", "term", "kind", "subkind", "scope", "notes")} | {c: "array<string>" for c in ("knowledge_form", "learning_mode", "tags")},
    "edges": {"directionality": "string", "notes": "string"},
    "cards": {c: "string" for c in ("summary", "definition", "example", "application", "misconception")},
    "lessons": {c: "string" for c in ("source_path", "grade_band", "content_role", "extraction_policy", "md")} | {"page_start": "int", "page_end": "int"},
}


def tables(spark, d):
    raw = {}
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    turns = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), (F.col("turn") + 1).cast("int").alias("pos"), F.col("text").alias("x"))
    for name, sql in _RAW.items():
        sql = sql.replace("{a}", "array(").replace("{b}", ")").replace("{none}", "cast(array() AS array<string>)")
        raw[name] = spark.sql(sql.replace("FROM turns", "FROM {turns}"), turns=turns)
        raw[name] = raw[name].withColumns({c: F.lit(None).cast(kind) for c, kind in _MORE.get(name, {}).items()})
    return B.assemble(**raw)


def decisions(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("turn % 4 = 1")
    return turns.selectExpr("concat('run:', conv_id) AS lesson", "concat_ws(':', 'evidence', concat('Book-', conv_id % 5), turn + 1) AS id", "conv_id % 3 = 0 OR turn = 5 AS keep", "'decorative' AS relevance", "'told' AS reason")


_CTES = "WITH turns AS (" + _TURNS + "conversations),\n" + ",\n".join(f"raw_{k} AS ({v.replace('{a}', '[').replace('{b}', ']').replace('{none}', '[]::VARCHAR[]')})" for k, v in _RAW.items())
_SQL = _CTES + r""",
heads AS (SELECT *, 'Book-' || regexp_extract(book_id, '\d+') AS book FROM raw_lessons),
named AS (SELECT lesson, pos, id, trim(name) AS own, trim(definition, E' \n\t') AS d, aliases, domains, trim(string_split_regex(trim(definition, E' \n\t'), '[。；;，,：:\n]')[1], E' \n\t') AS clause FROM raw_nodes WHERE id <> ''),
inferred AS (SELECT *, CASE WHEN own <> '' THEN own WHEN len(aliases) > 0 THEN aliases[1] WHEN clause <> '' THEN trim(left(clause, 32), E' \n\t') ELSE replace(substr(id, 3), '-', ' ') END AS name FROM named),
nodes AS (SELECT lesson, id, min(pos) AS pos, arg_min(name, pos) AS name, CASE WHEN arg_min(d, pos) = '' THEN arg_min(name, pos) ELSE arg_min(d, pos) END AS definition,
  list_filter(arg_min(aliases, pos), lambda a: a <> ' ') AS aliases, CASE WHEN len(arg_min(domains, pos)) = 0 THEN ['general'] ELSE arg_min(domains, pos) END AS domains FROM inferred GROUP BY lesson, id),
valid AS (SELECT u.*, trim(excerpt, E' \n\t') AS e, 'evidence:' || book || ':' || pos AS id FROM raw_units u JOIN heads USING (lesson) WHERE trim(excerpt, E' \n\t') <> ''),
anchors AS (SELECT lesson, anchor, arg_max(id, pos) AS ref FROM valid GROUP BY ALL),
found AS (SELECT lesson, 0 AS part, pos, id, e AS excerpt, locator, modality, 'model' AS extraction_method FROM valid
  UNION ALL SELECT r.lesson, 1, r.pos, 'evidence:' || book || ':hint:' || (r.pos + (SELECT count(*) FROM valid v WHERE v.lesson = r.lesson)), trim(r.excerpt, E' \n\t'), r.locator, r.modality, 'markdown_hint' FROM raw_hints r JOIN heads USING (lesson) WHERE disposition <> 'no_knowledge' AND trim(r.excerpt, E' \n\t') <> ''),
every AS (SELECT * FROM found UNION ALL SELECT lesson, 2, 1, 'evidence:' || book || ':backfill:1', title, 'lesson-chunk', 'text', 'model_missing_evidence_backfill' FROM heads
  WHERE disposition <> 'no_knowledge' AND lesson IN (SELECT lesson FROM nodes) AND lesson NOT IN (SELECT lesson FROM found)),
evidence AS (SELECT * EXCLUDE (part, pos), row_number() OVER (PARTITION BY lesson ORDER BY part, pos)::INT AS pos FROM every),
told AS (SELECT u.lesson, u.pos, a.ref, unnest(u.node_ids) AS node_id, generate_subscripts(u.node_ids, 1) - 1 AS k FROM raw_units u JOIN anchors a USING (lesson, anchor)),
said AS (SELECT t.* FROM told t JOIN nodes n ON n.lesson = t.lesson AND n.id = t.node_id),
firsts AS (SELECT lesson, node_id, arg_min(ref, pos * 100 + k) AS ref FROM said GROUP BY ALL),
mentions AS (SELECT s.lesson, pos, k, 'mention:' || book || ':' || replace(node_id, ':', '-') || ':' || pos AS id, node_id AS target_id, CASE WHEN pos = 1 THEN 'defines' ELSE 'focuses_on' END AS role, ref FROM said s JOIN heads USING (lesson)),
claims AS (SELECT lesson, id, pos, unnest(list_prepend(id, list_prepend(name, aliases))) AS key FROM nodes),
keys AS (SELECT lesson, key, arg_max(id, pos) AS id FROM (SELECT lesson, id, pos, key FROM claims UNION ALL SELECT lesson, id, pos, trim(regexp_replace(lower(key), '\s+', ' ', 'g')) FROM claims) GROUP BY ALL),
edges AS (SELECT e.lesson, e.pos, e.type, coalesce(f1.id, f2.id) AS from_id, coalesce(t1.id, t2.id) AS to_id, CASE WHEN confidence = 0 THEN 0.8 ELSE confidence END::DOUBLE AS confidence, a.ref
  FROM raw_edges e LEFT JOIN keys f1 ON f1.lesson = e.lesson AND f1.key = trim(from_key) LEFT JOIN keys f2 ON f2.lesson = e.lesson AND f2.key = trim(regexp_replace(lower(from_key), '\s+', ' ', 'g'))
  LEFT JOIN keys t1 ON t1.lesson = e.lesson AND t1.key = trim(to_key) LEFT JOIN keys t2 ON t2.lesson = e.lesson AND t2.key = trim(regexp_replace(lower(to_key), '\s+', ' ', 'g'))
  LEFT JOIN anchors a ON a.lesson = e.lesson AND a.anchor = e.evidence_anchor WHERE e.type = 'uses' AND coalesce(f1.id, f2.id) IS NOT NULL AND coalesce(t1.id, t2.id) IS NOT NULL),
given AS (SELECT p.* FROM raw_profiles p JOIN nodes n ON n.lesson = p.lesson AND n.id = p.node_id WHERE domain = 'physics'),
profiles AS (SELECT lesson, pos, node_id, domain, 'higher,primary' AS stages, false AS backfilled FROM given
  UNION ALL SELECT n.lesson, n.pos, n.id, CASE WHEN n.domains = ['law', 'odd'] THEN 'law' WHEN h.subject = 'physics' AND n.domains = ['general'] THEN 'general' ELSE 'general' END, 'higher', true
  FROM nodes n JOIN heads h USING (lesson) WHERE (n.lesson, n.id) NOT IN (SELECT lesson, node_id FROM given)),
own_cards AS (SELECT c.lesson, c.pos, c.node_id, n.name AS title, n.definition AS summary, a.ref, [coalesce(v.e, '')] AS s1, [trim(essence, E' \n\t')] AS s2, ['a', 'b'] AS s3, [''] AS s4, [''] AS s5, [''] AS s6, false AS backfilled
  FROM raw_cards c JOIN nodes n ON n.lesson = c.lesson AND n.id = c.node_id LEFT JOIN anchors a ON a.lesson = c.lesson AND a.anchor = c.evidence_anchor LEFT JOIN valid v ON v.lesson = a.lesson AND v.id = a.ref),
cards AS (SELECT * FROM own_cards UNION ALL SELECT n.lesson, n.pos, n.id, n.name, n.definition, f.ref, [n.definition], [n.definition], [n.definition], [n.name], [h.title], ['需结合证据原文确认适用范围。'], true
  FROM nodes n JOIN heads h USING (lesson) LEFT JOIN firsts f ON f.lesson = n.lesson AND f.node_id = n.id WHERE (n.lesson, n.id) NOT IN (SELECT lesson, node_id FROM own_cards)),
dropped AS (SELECT e.lesson, e.id FROM evidence e JOIN heads USING (lesson) JOIN turns t ON 'run:' || t.c = e.lesson AND t.t % 4 = 1 AND e.id = 'evidence:' || book || ':' || (t.t + 1) WHERE e.modality = 'image' AND NOT (t.c % 3 = 0 OR t.t = 5)),
remaining AS (SELECT * FROM evidence WHERE (lesson, id) NOT IN (SELECT lesson, id FROM dropped)),
touched AS (SELECT DISTINCT d.lesson, f.fallback FROM dropped d LEFT JOIN (SELECT lesson, arg_min(id, CASE WHEN modality = 'image' THEN 1000 ELSE 0 END + pos) AS fallback FROM remaining GROUP BY lesson) f ON f.lesson = d.lesson AND d.lesson IN (SELECT lesson FROM nodes)),
gone AS (SELECT lesson, id AS ref, true AS hit FROM dropped)
"""
_EDGE_ID = "'edge:auto-' || substr(sha1(from_id || '||uses||' || to_id), 1, 12)"
_PROFILE_ID = "'domain-profile:auto-' || substr(sha1(p.node_id || '||' || domain), 1, 12)"
_KINDS = ("definition", "essence", "key-points", "example", "application", "misconception")


def _refs(c="source_refs"):
    return F.array_join(c, ",").alias("refs")


def _sections():
    return F.array_join(F.transform("sections", lambda s: F.concat_ws("~", s["id"], F.array_join(s["content"], "^"), F.array_join(s["source_refs"], ","))), "|").alias("sections")


def _shown(ref: str) -> str:
    return " || '|' || ".join(f"'{k}~' || array_to_string(s{i}, '^') || '~' || {ref}" for i, k in enumerate(_KINDS, 1))


@register("m25_nodes", f"{_SQL} SELECT lesson, pos, id, name, definition, array_to_string(aliases, '|') AS aliases, array_to_string(domains, '|') AS domains FROM nodes")
def m25_nodes(spark, d):
    return tables(spark, d)["nodes"].select("lesson", "pos", "id", "name", "definition", F.array_join("aliases", "|").alias("aliases"), F.array_join("domains", "|").alias("domains"))


@register("m25_evidence", f"{_SQL} SELECT lesson, pos, id, excerpt, locator, modality, extraction_method, substr(excerpt, 1, 120) AS claim, extraction_method = 'model_missing_evidence_backfill' AS synthetic FROM evidence")
def m25_evidence(spark, d):
    return tables(spark, d)["evidence"].select("lesson", "pos", "id", "excerpt", "locator", "modality", "extraction_method", F.col("normalized_claims")[0].alias("claim"), F.coalesce("review.synthetic", F.lit(False)).alias("synthetic"))


@register("m25_mentions", f"{_SQL} SELECT lesson, pos, id, target_id, role, ref AS refs FROM mentions")
def m25_mentions(spark, d):
    return tables(spark, d)["mentions"].select("lesson", "pos", "id", "target_id", "role", _refs())


@register("m25_edges", f"{_SQL} SELECT lesson, pos, {_EDGE_ID} AS id, from_id, to_id, confidence, coalesce(ref, '') AS refs FROM edges")
def m25_edges(spark, d):
    return tables(spark, d)["edges"].select("lesson", "pos", "id", "from_id", "to_id", "confidence", _refs())


@register("m25_profiles", f"{_SQL} SELECT p.lesson, {_PROFILE_ID} AS id, p.node_id, domain, stages, 'core' AS roles, coalesce(f.ref, '') AS refs, backfilled FROM profiles p LEFT JOIN firsts f ON f.lesson = p.lesson AND f.node_id = p.node_id")
def m25_profiles(spark, d):
    return tables(spark, d)["profiles"].select("lesson", "id", "node_id", "domain", F.array_join("school_stages", ",").alias("stages"), F.array_join("curriculum_roles", ",").alias("roles"), _refs(), "backfilled")


@register("m25_cards", f"{_SQL} SELECT lesson, pos, node_id, title, summary, {_shown("coalesce(ref, '')")} AS sections, coalesce(ref, '') AS refs, backfilled FROM cards")
def m25_cards(spark, d):
    return tables(spark, d)["cards"].select("lesson", "pos", "node_id", "title", "summary", _sections(), _refs(), "backfilled")


@register("m25_counts", _SQL + "SELECT lesson, " + ", ".join(f"(SELECT count(*) FROM {t} x WHERE x.lesson = h.lesson) AS n_{t}" for t in B.TABLES) + " FROM heads h")
def m25_counts(spark, d):
    return tables(spark, d)["counts"]


def _filtered(spark, d):
    return B.filter_images(tables(spark, d), decisions(spark, d))


#: The reference of a row after the filter: without dropped ones, and the lesson's fallback where none is left.
_MENDED = "CASE WHEN g.hit OR x.ref IS NULL THEN CASE WHEN t.lesson IS NOT NULL THEN coalesce(t.fallback, '') ELSE '' END ELSE x.ref END"
_MEET = "LEFT JOIN gone g ON g.lesson = x.lesson AND g.ref = x.ref LEFT JOIN touched t ON t.lesson = x.lesson"


@register("m26_evidence", f"{_SQL} SELECT lesson, id, modality, CASE WHEN modality = 'image' THEN 'decorative' ELSE '' END AS relevance FROM remaining")
def m26_evidence(spark, d):
    return _filtered(spark, d)["evidence"].select("lesson", "id", "modality", F.coalesce("image_relevance.relevance", F.lit("")).alias("relevance"))


@register("m26_edges", f"{_SQL} SELECT x.lesson, x.pos, {_EDGE_ID} AS id, {_MENDED} AS refs FROM edges x {_MEET} WHERE g.hit IS NULL")
def m26_edges(spark, d):
    return _filtered(spark, d)["edges"].select("lesson", "pos", "id", _refs())


@register("m26_mentions", f"""{_SQL}, held AS (SELECT x.lesson, x.id, x.target_id, x.role, x.ref FROM mentions x {_MEET} WHERE g.hit IS NULL)
SELECT lesson, id, target_id, role, ref AS refs FROM held UNION ALL SELECT n.lesson, 'mention:image-filter-backfill:' || n.id, n.id, 'mentions', t.fallback FROM nodes n JOIN touched t ON t.lesson = n.lesson
WHERE t.fallback IS NOT NULL AND (n.lesson, n.id) NOT IN (SELECT lesson, target_id FROM held)""")
def m26_mentions(spark, d):
    return _filtered(spark, d)["mentions"].select("lesson", "id", "target_id", "role", _refs())


@register("m26_cards", f"{_SQL} SELECT x.lesson, x.pos, x.node_id, {_shown(_MENDED)} AS sections, {_MENDED} AS refs FROM cards x {_MEET}")
def m26_cards(spark, d):
    return _filtered(spark, d)["cards"].select("lesson", "pos", "node_id", _sections(), _refs())


@register("m26_nodes_profiles", f"""{_SQL}, p AS (SELECT p.lesson, {_PROFILE_ID} AS id, f.ref FROM profiles p LEFT JOIN firsts f ON f.lesson = p.lesson AND f.node_id = p.node_id)
SELECT x.lesson, x.id, {_MENDED} AS refs FROM (SELECT lesson, id, NULL::VARCHAR AS ref FROM nodes UNION ALL SELECT lesson, id, ref FROM p) x {_MEET}""")
def m26_nodes_profiles(spark, d):
    out = _filtered(spark, d)
    return out["nodes"].select("lesson", "id", _refs()).unionByName(out["profiles"].select("lesson", "id", _refs()))
