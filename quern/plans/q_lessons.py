"""Lessons merged in order: every brand is a lesson, every part a staged node with evidence, an edge, a profile, a mention and a card."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import lessons as L
from quern.plans.catalog import register


def merged(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").selectExpr("concat('run:', p_brand) AS lesson", "cast(p_partkey AS int) AS pos", "p_name", "p_type", "p_brand", "p_partkey AS k")
    lessons = p.groupBy("lesson").agg(F.min("k").alias("ordinal"))
    nodes = p.selectExpr(
        "lesson", "pos", "concat('r', k % 7) AS raw_id", "p_type AS kind", "p_brand AS subkind", "p_name AS name", "cast(array() AS array<string>) AS aliases", "'' AS semantic_key",
        "cast(NULL AS array<double>) AS embedding", "CASE WHEN k % 11 = 5 THEN 'old' WHEN k % 11 = 6 THEN 'nothing' END AS existing_id",
    )
    none = "cast(array() AS array<string>)"
    canonical = spark.sql(f"SELECT 'old' AS id, 'elsewhere' AS kind, '' AS subkind, 'old' AS name, {none} AS aliases, '' AS semantic_key, cast(NULL AS array<double>) AS embedding")
    tables = {
        "evidence": p.selectExpr("lesson", "pos", "concat('e', k % 3) AS raw_id", "'a' AS anchor_ref", "p_name AS excerpt"),
        "edges": p.selectExpr("lesson", "pos", "concat('r', k % 7) AS raw_from", "concat('r', k % 9) AS raw_to", "'uses' AS type", "array(concat('e', k % 3), ' x', concat('e', k % 3)) AS source_refs"),
        "profiles": p.selectExpr("lesson", "pos", "concat('r', k % 4) AS raw_node_id", "if(k % 5 = 0, '', 'physics') AS domain", "array(p_type) AS school_stages", f"{none} AS curriculum_roles", "array(concat('e', k % 3), 'gone') AS source_refs"),
        "mentions": p.selectExpr("lesson", "pos", "concat('m', k) AS raw_id", "'node' AS target_type", "concat('r', k % 9) AS target_raw", "array(concat('e', k % 4)) AS source_refs"),
        "cards": p.selectExpr("lesson", "pos", "concat('c', k) AS raw_id", "concat('r', k % 8) AS raw_node_id", "array('e0') AS source_refs", "array(named_struct('id', 's', 'source_refs', array('e0', 'e1', ' e0'))) AS sections"),
        "old_profiles": spark.sql(f"SELECT '' AS id, {none} AS school_stages, {none} AS curriculum_roles, {none} AS source_refs").where("id <> ''"),
        "old_evidence": spark.sql("SELECT 'gone' AS id").where("id <> 'gone'"),
    }
    return L.merge_lessons(lessons, nodes, canonical=canonical, **tables)


_SQL = """WITH p AS (SELECT 'run:' || p_brand AS lesson, p_partkey AS k, p_name, p_type, p_brand, min(p_partkey) OVER (PARTITION BY p_brand) AS o FROM part),
free AS (SELECT *, row_number() OVER w AS i, first_value(p_brand) OVER w AS brand FROM p WHERE k % 11 NOT IN (5, 6) WINDOW w AS (PARTITION BY p_name, p_type ORDER BY o, k)),
mapped AS (SELECT lesson, k, 'r' || k % 7 AS raw_id, p_type || '/' || brand || ':auto-' || substr(sha1(p_type || '/' || brand || '||' || lower(p_name)), 1, 12) AS canonical_id, CASE WHEN i = 1 THEN 'created' ELSE 'matched' END AS resolution FROM free
  UNION ALL SELECT lesson, k, 'r' || k % 7, 'old', 'matched' FROM p WHERE k % 11 = 5),
names AS (SELECT lesson, raw_id, arg_max(canonical_id, k) AS id FROM mapped GROUP BY ALL),
ev AS (SELECT lesson, k, o, 'e' || k % 3 AS raw, 'evidence:auto-' || substr(sha1(lesson || '||e' || k % 3 || '||a||' || p_name), 1, 12) AS id FROM p),
refs AS (SELECT lesson, raw, arg_max(id, k) AS id FROM ev GROUP BY ALL),
edges AS (SELECT p.lesson, p.k, 'edge:auto-' || substr(sha1(f.id || '||uses||' || t.id), 1, 12) AS id, f.id AS from_id, t.id AS to_id, coalesce(r.id, 'e' || p.k % 3) || ',x' AS refs
  FROM p JOIN names f ON f.lesson = p.lesson AND f.raw_id = 'r' || p.k % 7 JOIN names t ON t.lesson = p.lesson AND t.raw_id = 'r' || p.k % 9 LEFT JOIN refs r ON r.lesson = p.lesson AND r.raw = 'e' || p.k % 3),
prof AS (SELECT p.lesson, p.k, p.o, p.p_type, 'domain-profile:auto-' || substr(sha1(n.id || '||physics'), 1, 12) AS id, r.id AS ref FROM p JOIN names n ON n.lesson = p.lesson AND n.raw_id = 'r' || p.k % 4
  JOIN refs r ON r.lesson = p.lesson AND r.raw = 'e' || p.k % 3 WHERE p.k % 5 <> 0),
last AS (SELECT * FROM prof QUALIFY row_number() OVER (PARTITION BY id, o ORDER BY k DESC) = 1),
sizes AS (SELECT a.lesson, a.k, (SELECT count(DISTINCT v) FROM (SELECT b.ref AS v FROM last b WHERE b.id = a.id AND b.o < a.o UNION ALL SELECT a.ref)) AS n FROM prof a),
mentions AS (SELECT p.lesson, p.k, coalesce(n.id, 'r' || p.k % 9) AS target_id FROM p LEFT JOIN names n ON n.lesson = p.lesson AND n.raw_id = 'r' || p.k % 9),
cards AS (SELECT p.lesson, p.k, n.id AS node_id FROM p JOIN names n ON n.lesson = p.lesson AND n.raw_id = 'r' || p.k % 8)
"""


@register("m19_lesson_nodes", f"{_SQL} SELECT lesson, k::INTEGER AS pos, raw_id, canonical_id, resolution FROM mapped")
def m19_nodes(spark, d):
    return merged(spark, d)["node_map"].select("lesson", "pos", "raw_id", "canonical_id", "resolution")


@register("m19_lesson_errors", f"{_SQL} SELECT lesson, 'r' || k % 7 AS raw_id, count(*) AS n FROM p WHERE k % 11 = 6 GROUP BY ALL")
def m19_errors(spark, d):
    return merged(spark, d)["errors"].groupBy("lesson", "raw_id").agg(F.count("*").alias("n"))


@register("m19_lesson_edges", f"{_SQL} SELECT lesson, k::INTEGER AS pos, id, from_id, to_id, refs FROM edges")
def m19_edges(spark, d):
    return merged(spark, d)["edges"].select("lesson", "pos", "id", "from_id", "to_id", F.array_join("source_refs", ",").alias("refs"))


@register("m19_lesson_profiles", f"""{_SQL} SELECT id, (SELECT string_agg(t, ',' ORDER BY f) FROM (SELECT p_type AS t, min(o) AS f FROM last b WHERE b.id = a.id GROUP BY 1)) AS stages,
(SELECT string_agg(t, ',' ORDER BY f) FROM (SELECT ref AS t, min(o) AS f FROM last b WHERE b.id = a.id GROUP BY 1)) AS refs FROM (SELECT DISTINCT id FROM last) a""")
def m19_profiles(spark, d):
    return merged(spark, d)["profiles"].select("id", F.array_join("school_stages", ",").alias("stages"), F.array_join("source_refs", ",").alias("refs"))


_COUNT = "(SELECT count(*) FROM {} x WHERE x.lesson = l.lesson{})"


@register("m19_lesson_stats", f"""{_SQL} SELECT lesson, {_COUNT.format('mapped', " AND resolution = 'created'")} AS nodes_created, {_COUNT.format('mapped', " AND resolution = 'matched'")} AS nodes_matched, 0::BIGINT AS nodes_review,
{_COUNT.format('edges', '')} AS edges_upserted, {_COUNT.format('prof', '')} AS domain_profiles_upserted, {_COUNT.format('mentions', '')} AS mentions_upserted, {_COUNT.format('p', '')} AS evidence_upserted,
(2 * {_COUNT.format('edges', '')} + {_COUNT.format('mentions', '')} + 3 * {_COUNT.format('cards', '')} + coalesce((SELECT sum(n) FROM sizes x WHERE x.lesson = l.lesson), 0))::BIGINT AS evidence_links_upserted,
{_COUNT.format('cards', '')} AS node_cards_upserted FROM (SELECT DISTINCT lesson FROM p) l""")
def m19_lesson_stats(spark, d):
    return merged(spark, d)["stats"].drop("ordinal")
