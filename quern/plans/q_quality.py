"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import quality as Q
from quern.plans.catalog import register
from quern.sources.views import Views, ctes

_ALL = ctes("nodes", "edges", "evidence", "mentions", "profiles", "cards", "bodies")
_REFS = """SELECT {c} AS category, {k} AS id, 'Missing evidence source references' AS message FROM {t} WHERE len(source_refs) = 0
UNION ALL SELECT {c}, k, 'Missing evidence ' || ref FROM (SELECT {k} AS k, unnest(source_refs) AS ref FROM {t}) WHERE ref NOT IN (SELECT id FROM ev)"""


def _refs(category: str, key: str, table: str) -> str:
    return _REFS.format(c=f"'{category}'", k=key, t=table)


_STAGES = "'primary', 'junior-secondary', 'senior-secondary', 'higher'"
_KNOWN = "ev AS (SELECT id FROM evidence WHERE NOT synthetic), st AS (SELECT c.node_id, n_sections, list(section_type) AS l FROM cards c LEFT JOIN sections s ON s.node_id = c.node_id GROUP BY ALL)"
_QA = f"""{_ALL}, {_KNOWN}, i AS (
SELECT 'node' AS category, id, 'Invalid kind: ' || kind AS message FROM nodes UNION ALL SELECT 'node_card', id, 'Missing node card' FROM nodes WHERE id NOT IN (SELECT node_id FROM cards)
UNION ALL SELECT 'mention', id, 'Missing mention' FROM nodes WHERE id NOT IN (SELECT target_id FROM mentions) UNION ALL SELECT 'domain_profile', id, 'Missing domain profile' FROM nodes WHERE id NOT IN (SELECT node_id FROM profiles)
UNION ALL SELECT 'edge', id, 'Invalid edge type: ' || type FROM edges UNION ALL {_refs('edge', 'id', 'edges')} UNION ALL SELECT 'edge', id, 'Missing source node' FROM edges WHERE from_id NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'edge', id, 'Missing target node' FROM edges WHERE to_id NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'domain_profile', id, 'Invalid domain: ' || domain FROM profiles
UNION ALL SELECT 'domain_profile', id, 'Invalid school stages: [''' || school_stages[1] || ''']' FROM profiles UNION ALL SELECT 'domain_profile', id, 'Invalid curriculum roles: [''' || curriculum_roles[1] || ''', ''' || curriculum_roles[2] || ''']' FROM profiles
UNION ALL {_refs('domain_profile', 'id', 'profiles')} UNION ALL {_refs('mention', 'id', 'mentions')} UNION ALL SELECT 'node_card', node_id, 'Missing summary' FROM cards WHERE trim(summary) = ''
UNION ALL {_refs('node_card', 'node_id', 'cards')}
UNION ALL SELECT 'node_card', c.node_id, 'Missing required sections: [' || array_to_string(list_sort(list_filter(['definition', 'essence', 'key_points', 'example', 'application', 'misconception'],
  lambda x: NOT list_contains(l, x) OR l[1] IS NULL)).list_transform(lambda x: '''' || x || ''''), ', ') || ']' FROM st c WHERE n_sections < 6 OR n_sections > 4
UNION ALL {_refs('node_card_section', "node_id || ':' || CASE WHEN id <> '' THEN id WHEN section_type <> '' THEN section_type ELSE 'section' END", 'sections')}
UNION ALL SELECT 'node_body', node_id, 'Missing body content' FROM bodies WHERE trim(content) = '' UNION ALL {_refs('node_body', 'node_id', 'bodies')})"""


def _qa(v: Views):
    known = v.evidence.where(F.coalesce(F.get_json_object("properties", "$.synthetic"), F.lit("")) != "true")
    return Q.strict_qa(v.nodes, v.edges, v.profiles, v.mentions, known, v.cards, v.bodies)


@register("q1_strict_qa", f"{_QA} SELECT category, split_part(message, ':', 1) AS rule, count(*) AS n, md5(string_agg(id || message, '' ORDER BY id, message)) AS digest FROM (SELECT category, id, CASE WHEN message LIKE 'Missing evidence doc%' THEN 'Missing evidence: ' || message ELSE message END AS message FROM i) GROUP BY ALL")
def q1(spark, d):
    i = _qa(Views(spark, d))
    i = i.withColumn("message", F.when(F.startswith("message", F.lit("Missing evidence doc")), F.concat(F.lit("Missing evidence: "), "message")).otherwise(F.col("message")))
    return Q.ordered_digests(i.withColumn("rule", F.split_part("message", F.lit(":"), F.lit(1))), ["category", "rule"], ["id", "message"])


@register("q2_scoped_issues", f"""{_QA}, b AS (SELECT DISTINCT target_id AS id FROM mentions JOIN evidence e ON e.id = source_refs[1] WHERE e.source_id = 'src3') SELECT category, count(*) AS n FROM i WHERE id IN (SELECT id FROM b) GROUP BY 1""")
def q2(spark, d):
    v = Views(spark, d)
    return Q.scope_issues(_qa(v), Q.book_nodes(v.mentions, v.evidence, "src3")).groupBy("category").agg(F.count("*").alias("n"))


_LESSON = """ln AS (SELECT conv_id AS lesson, conv_id || ':' || turn AS id, CASE WHEN turn % 3 = 0 THEN 'concept' ELSE role END AS kind, CASE WHEN turn % 5 = 4 THEN 'Chapter 1' WHEN turn % 7 = 6 THEN 'x' ELSE role END AS name,
  CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS definition, CASE WHEN turn % 2 = 0 THEN ['ev:' || conv_id || ':' || turn] ELSE [] END AS refs, turn FROM conversations),
le AS (SELECT lesson, id || '>' AS id, id AS from_id, lesson || ':' || (turn + 2) AS to_id, refs, CASE WHEN turn % 2 = 0 THEN 'uses' ELSE 'odd' END AS type FROM ln WHERE turn % 3 <> 1),
lv AS (SELECT conv_id AS lesson, 'ev:' || conv_id || ':' || turn AS id, turn % 6 <> 0 AS ok FROM conversations WHERE turn % 2 = 0)"""


def _lessons(v: Views):
    n = v.table("conversations").selectExpr(
        "conv_id AS lesson", "concat(conv_id, ':', turn) AS id", "if(turn % 3 = 0, 'concept', role) AS kind", "case when turn % 5 = 4 then 'Chapter 1' when turn % 7 = 6 then 'x' else role end AS name",
        "if(turn % 4 = 3, '', text) AS definition", "if(turn % 2 = 0, array(concat('ev:', conv_id, ':', turn)), array()) AS source_refs", "turn", "'active' AS status",
    )
    e = n.where("turn % 3 <> 1").selectExpr("lesson", "concat(id, '>') AS id", "id AS from_id", "concat(lesson, ':', turn + 2) AS to_id", "source_refs", "if(turn % 2 = 0, 'uses', 'odd') AS type", "'active' AS status")
    ev = v.table("conversations").where("turn % 2 = 0").selectExpr("conv_id AS lesson", "concat('ev:', conv_id, ':', turn) AS id", "turn % 6 <> 0 AS quality_ok", "if(turn % 6 <> 0, '{}', '{\"synthetic\":true}') AS properties")
    return n, e, ev


@register("q3_admission_warnings", f"""WITH {_LESSON}, ends AS (SELECT lesson, from_id AS id FROM le UNION SELECT lesson, to_id FROM le)
SELECT lesson, id AS raw_node_id, 'name is too short' AS warning FROM ln WHERE length(name) <= 1 UNION ALL SELECT lesson, id, 'looks like a heading' FROM ln WHERE name = 'Chapter 1'
UNION ALL SELECT lesson, id, 'has no staged relations' FROM ln WHERE lesson IN (SELECT lesson FROM le) AND (lesson, id) NOT IN (SELECT lesson, id FROM ends)""")
def q3(spark, d):
    n, e, _ = _lessons(Views(spark, d))
    return Q.admission_warnings(n.withColumnRenamed("id", "raw_node_id"), e)


_ERR = f"""{_LESSON}, good AS (SELECT id FROM lv WHERE ok), err AS (
SELECT lesson, id, 'invalid kind' AS message FROM ln WHERE kind <> 'concept' UNION ALL SELECT lesson, id, 'missing definition' FROM ln WHERE definition = '' UNION ALL SELECT lesson, id, 'missing domain profile' FROM ln WHERE turn % 2 <> 0
UNION ALL SELECT lesson, id, 'missing node card' FROM ln WHERE turn % 3 <> 0 UNION ALL SELECT lesson, id, 'missing mention' FROM ln WHERE turn % 5 = 0 UNION ALL SELECT lesson, id, 'no evidence-backed reference' FROM ln WHERE len(refs) = 0 OR refs[1] NOT IN (SELECT id FROM good)
UNION ALL SELECT lesson, id, 'invalid type' FROM le WHERE type = 'odd' UNION ALL SELECT lesson, id, 'missing node endpoint' FROM le WHERE to_id NOT IN (SELECT id FROM ln)
UNION ALL SELECT lesson, id, 'no evidence source_refs' FROM le WHERE len(refs) = 0 OR refs[1] NOT IN (SELECT id FROM good))"""


def _errors(v: Views):
    n, e, ev = _lessons(v)
    m = n.where("turn % 5 <> 0").selectExpr("lesson", "concat('m', id) AS id", "id AS target_id", "source_refs")
    return Q.staging_errors(n, e, ev, m, n.where("turn % 3 = 0").selectExpr("lesson", "id AS node_id"), n.where("turn % 2 = 0").selectExpr("lesson", "id AS node_id"))


@register("q3_staging_errors", f"WITH {_ERR} SELECT * FROM err")
def q3b(spark, d):
    return _errors(Views(spark, d))


@register("q4_lesson_gate", f"""WITH {_ERR}, ends AS (SELECT lesson, from_id AS id FROM le UNION SELECT lesson, to_id FROM le), w AS (SELECT lesson, id FROM ln WHERE length(name) <= 1 UNION ALL SELECT lesson, id FROM ln WHERE name = 'Chapter 1'
UNION ALL SELECT lesson, id FROM ln WHERE lesson IN (SELECT lesson FROM le) AND (lesson, id) NOT IN (SELECT lesson, id FROM ends)), l AS (SELECT DISTINCT lesson FROM ln)
SELECT lesson, coalesce(e, 0) AS n_errors, coalesce(w, 0) AS n_warnings, coalesce(r, 0) AS n_review, CASE WHEN coalesce(e, 0) > 0 THEN 'blocked' ELSE 'success' END AS status, coalesce(w, 0) > 0 AS review_required
FROM l LEFT JOIN (SELECT lesson, count(*) AS e FROM err GROUP BY 1) USING (lesson) LEFT JOIN (SELECT lesson, count(*) AS w, count(DISTINCT id) AS r FROM w GROUP BY 1) USING (lesson)""")
def q4(spark, d):
    v = Views(spark, d)
    n, e, _ = _lessons(v)
    return Q.lesson_gate(n.select("lesson").distinct(), _errors(v), Q.admission_warnings(n.withColumnRenamed("id", "raw_node_id"), e))


@register("q5_staging_integrity", f"""{ctes('nodes', 'edges', 'mentions', 'cards')}, k AS (SELECT id FROM nodes WHERE kind <> 'PROMO') SELECT category, count(*) AS n FROM (SELECT 'edge' AS category FROM edges WHERE from_id NOT IN (SELECT id FROM k) UNION ALL SELECT 'edge' FROM edges WHERE to_id NOT IN (SELECT id FROM k)
UNION ALL SELECT 'mention' FROM mentions WHERE target_id NOT IN (SELECT id FROM k) UNION ALL SELECT 'card' FROM cards WHERE node_id NOT IN (SELECT id FROM k)) GROUP BY 1""")
def q5(spark, d):
    v = Views(spark, d)
    return Q.staging_integrity(v.edges, v.mentions, v.cards, v.nodes.where("kind <> 'PROMO'")).groupBy("category").agg(F.count("*").alias("n"))


@register("q6_mark_passed", "SELECT DISTINCT conv_id AS lesson, CASE WHEN conv_id % 4 = 1 THEN CASE WHEN conv_id IN (SELECT conv_id FROM conversations WHERE turn >= 6) THEN 'blocked' ELSE 'qa_passed' END WHEN conv_id % 4 = 0 THEN 'staged' ELSE 'other' END AS status FROM conversations")
def q6(spark, d):
    c = Views(spark, d).table("conversations")
    lessons = c.selectExpr("conv_id AS lesson", "case conv_id % 4 when 1 then 'merged' when 0 then 'staged' else 'other' end AS status").distinct()
    return Q.mark_passed(lessons, c.where("turn >= 6").select(F.col("conv_id").alias("lesson")))


@register("q7_reviews", "SELECT review_status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 30 = 10 THEN CASE WHEN lang = 'en' THEN 'approved' ELSE 'pending' END WHEN doc_id % 70 = 0 THEN 'rejected' ELSE '' END AS review_status FROM documents) GROUP BY 1")
def q7(spark, d):
    doc = Views(spark, d).table("documents").selectExpr("doc_id AS id", "lang", "case when doc_id % 30 = 10 then 'pending' when doc_id % 70 = 0 then 'rejected' else '' end AS review_status")
    reviews = doc.where("lang = 'en'").select("id", F.lit("approved").alias("decision"))
    return Q.apply_reviews(doc, reviews).groupBy("review_status").agg(F.count("*").alias("n"))


_QUALITY = f"""WITH {_LESSON}, l AS (SELECT DISTINCT lesson, CASE lesson % 4 WHEN 0 THEN 'staged' WHEN 1 THEN 'blocked' ELSE 'merged' END AS status FROM ln), ins AS (SELECT * FROM le WHERE to_id IN (SELECT id FROM ln)),
t AS (SELECT lesson, status, (SELECT count(*) FROM ln WHERE ln.lesson = l.lesson) AS node_count, (SELECT count(*) FROM le WHERE le.lesson = l.lesson) AS relation_count, (SELECT count(*) FROM lv WHERE lv.lesson = l.lesson AND ok) AS evidence_count,
(SELECT count(*) FROM ln WHERE ln.lesson = l.lesson AND refs[1] IN (SELECT id FROM lv WHERE ok)) + (SELECT count(*) FROM le WHERE le.lesson = l.lesson AND refs[1] IN (SELECT id FROM lv WHERE ok)) AS covered,
(SELECT count(*) FROM ln WHERE ln.lesson = l.lesson AND id NOT IN (SELECT from_id FROM ins) AND id NOT IN (SELECT to_id FROM ins)) AS isolated_count FROM l)"""


def _quality(v: Views):
    n, e, ev = _lessons(v)
    lessons = n.selectExpr("lesson", "case lesson % 4 when 0 then 'staged' when 1 then 'blocked' else 'merged' end AS status", "0 AS recorded_nodes").distinct()
    return Q.lesson_quality(lessons, n, e, ev)


@register("a1_lesson_quality", f"{_QUALITY} SELECT lesson, status, node_count, relation_count, evidence_count, round(covered / (node_count + relation_count), 6) AS coverage, isolated_count, round(isolated_count / node_count, 6) AS isolated_ratio FROM t")
def a1(spark, d):
    q = _quality(Views(spark, d))
    return q.select("lesson", "status", "node_count", "relation_count", "evidence_count", F.round("coverage", 6).alias("coverage"), "isolated_count", F.round("isolated_ratio", 6).alias("isolated_ratio"))


_DASHBOARD = f"""WITH RECURSIVE {_LESSON}, l AS (SELECT DISTINCT lesson, 'b' || lesson % 3 AS book_id, CASE lesson % 4 WHEN 0 THEN 'staged' WHEN 1 THEN 'blocked' ELSE 'merged' END AS status, lesson % 5 = 0 AS required FROM ln
  UNION ALL SELECT DISTINCT lesson + 1000000, 'none', 'staged', false FROM ln),
q AS (SELECT conv_id AS lesson, turn, 'ev:' || conv_id || ':' || turn AS id, turn % 6 <> 0 AS ok, turn IN (0, 4) AS pending FROM conversations WHERE turn % 2 = 0),
ins AS (SELECT lesson, from_id AS a, to_id AS b FROM le WHERE to_id IN (SELECT id FROM ln)), sym AS (SELECT * FROM ins UNION SELECT lesson, b, a FROM ins),
reach(lesson, id, r) AS (SELECT lesson, id, id FROM ln UNION SELECT x.lesson, x.id, s.b FROM reach x JOIN sym s ON s.lesson = x.lesson AND s.a = x.r),
comp AS (SELECT lesson, count(DISTINCT root) AS n FROM (SELECT lesson, id, min(r) AS root FROM reach GROUP BY ALL) GROUP BY 1),
merges AS (SELECT conv_id AS lesson, conv_id || ':' || turn AS id FROM conversations WHERE turn % 4 = 1 AND conv_id % 2 = 0),
listed AS (SELECT lesson, lesson || ':1' AS id FROM l WHERE required AND lesson % 10 <> 0 UNION ALL SELECT lesson, 'x' FROM l WHERE required AND lesson % 10 <> 0),
canon AS (SELECT conv_id AS lesson, turn FROM conversations WHERE conv_id % 6 = 0 AND turn IN (1, 3)),
t AS (SELECT *, (SELECT count(*) FROM ln WHERE ln.lesson = l.lesson) AS nodes, (SELECT count(*) FROM le WHERE le.lesson = l.lesson) AS edges, (SELECT count(*) FROM q WHERE q.lesson = l.lesson) AS staged, (SELECT count(*) FROM q WHERE q.lesson = l.lesson AND ok) AS good,
  (SELECT count(*) FROM q WHERE q.lesson = l.lesson AND pending) AS images, (SELECT count(*) FROM canon c WHERE c.lesson = l.lesson) AS canonical, (SELECT count(*) FROM canon c WHERE c.lesson = l.lesson AND turn = 1) AS canonical_images,
  (SELECT count(DISTINCT id) FROM merges m WHERE m.lesson = l.lesson) AS merge_review_count, (SELECT count(*) FROM listed m WHERE m.lesson = l.lesson) AS n_listed,
  (SELECT count(DISTINCT id) FROM (SELECT * FROM merges UNION ALL SELECT * FROM listed) m WHERE m.lesson = l.lesson) AS reviewed, coalesce((SELECT n FROM comp WHERE comp.lesson = l.lesson), 0) AS components FROM l),
u AS (SELECT *, CASE WHEN status IN ('merged', 'qa_passed') OR canonical > 0 THEN canonical_images ELSE images END AS image_review_count FROM t)
SELECT lesson, status, CASE WHEN nodes > 0 THEN nodes ELSE 7 END AS node_count, CASE WHEN edges > 0 THEN edges ELSE 8 END AS relation_count, CASE WHEN staged > 0 THEN good ELSE 9 END AS evidence_count, components AS disconnected_components, image_review_count, merge_review_count,
CASE WHEN required THEN greatest(1, n_listed) ELSE 0 END AS quality_review_count, image_review_count + reviewed + (required AND n_listed = 0)::INT + (status = 'blocked' AND NOT required)::INT AS manual_pending_items FROM u"""


@register("a1_lesson_dashboard", _DASHBOARD)
def a1_dashboard(spark, d):
    v = Views(spark, d)
    n, e, ev = _lessons(v)
    c = v.table("conversations")
    said = "case turn when 0 then '{\"synthetic\":true,\"image_relevance\":{\"relevance\":\"uncertain\"}}' when 4 then '{\"image_relevance\":{\"review_status\":\" pending\"}}' when 6 then '{\"synthetic\":true}' else '{}' end AS properties"
    ev = c.where("turn % 2 = 0").selectExpr("conv_id AS lesson", "concat('ev:', conv_id, ':', turn) AS id", "if(turn in (0, 4), ' Image', 'text') AS modality", said)
    cols = ["concat('a', lesson) AS batch_anchor", "7 AS recorded_nodes", "8 AS recorded_edges", "9 AS recorded_evidence"]
    ids = n.select("lesson").distinct()
    lessons = ids.selectExpr(
        "lesson", "concat('b', lesson % 3) AS book_id", "case lesson % 4 when 0 then 'staged' when 1 then 'blocked' else 'merged' end AS status", "lesson % 5 = 0 AS review_required",
        "if(lesson % 10 = 0, array(' '), array(' x ', concat(lesson, ':1'), 'x')) AS review_node_ids", *cols,
    )
    lessons = lessons.unionByName(ids.selectExpr("lesson + 1000000 AS lesson", "'none' AS book_id", "'staged' AS status", "false AS review_required", "array('unused') AS review_node_ids", *cols))
    canonical = c.where("conv_id % 6 = 0 AND turn IN (1, 3)").selectExpr("concat('b', conv_id % 3) AS source_id", "concat('a', conv_id) AS anchor_ref", "'image' AS modality", "if(turn = 1, '{\"image_relevance\":{\"review_status\":\"pending\"}}', '{}') AS properties")
    merges = c.where("turn % 4 = 1 AND conv_id % 2 = 0").selectExpr("conv_id AS lesson", "concat(conv_id, ':', turn) AS raw_node_id")
    return Q.lesson_dashboard(lessons, n, e, ev, canonical, merges).drop("coverage", "isolated_count", "isolated_ratio")


@register("a2_dataset_quality", f"{_QUALITY} SELECT count(*) AS lesson_count, sum(node_count)::BIGINT AS node_count, sum(relation_count)::BIGINT AS relation_count, sum(evidence_count)::BIGINT AS evidence_count, round(sum(covered) / sum(node_count + relation_count), 6) AS coverage, sum(isolated_count)::BIGINT AS isolated_count, count(*) FILTER (status = 'blocked') AS blocked FROM t")
def a2(spark, d):
    return Q.dataset_quality(_quality(Views(spark, d))).withColumn("coverage", F.round("coverage", 6))


@register("a4_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a4(spark, d):
    return Q.status_counts(Views(spark, d).table("orders"), "o_orderstatus")


_MAP = "nm AS (SELECT c_mktsegment AS book, o_orderpriority AS lesson, l_partkey AS node, l_returnflag <> 'N' AS owned FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"


def _node_map(v: Views):
    j = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.selectExpr("c_mktsegment AS book", "o_orderpriority AS lesson", "l_partkey AS node", "l_returnflag <> 'N' AS owned")


@register("a5_book_summary", f"""WITH {_MAP}, ow AS (SELECT book, node, bool_or(owned) AS owned FROM nm GROUP BY ALL), ob AS (SELECT *, count(*) OVER (PARTITION BY node) AS k FROM ow),
bk AS (SELECT DISTINCT c_mktsegment AS book FROM customer), r AS (SELECT c_mktsegment AS book, o_orderdate AS u, o_orderstatus AS s FROM orders JOIN customer ON c_custkey = o_custkey), ed AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_partkey AS a, l_suppkey + 10000000 AS b FROM lineitem)
SELECT book, (SELECT count(*) FROM r WHERE r.book = bk.book AND s <> 'P') AS lesson_runs, (SELECT count(*) FROM r WHERE r.book = bk.book AND s = 'P') AS pipeline_jobs, (SELECT count(*) FROM r WHERE s = 'P') AS running_jobs,
(SELECT count(*) FROM ob WHERE ob.book = bk.book AND owned) AS canonical_nodes, (SELECT count(*) FROM ob WHERE ob.book = bk.book AND (NOT owned OR k > 1)) AS shared_nodes,
(SELECT count(DISTINCT id) FROM ed WHERE a IN (SELECT node FROM ow WHERE ow.book = bk.book AND owned)) AS edges, (SELECT count(*) FROM customer WHERE c_mktsegment = bk.book) AS evidence,
(SELECT count(*) FROM customer WHERE c_mktsegment = bk.book AND c_acctbal > 0) AS mentions, (SELECT max(u) FROM r WHERE r.book = bk.book) AS updated_at, false AS deletable FROM bk""")
def a5(spark, d):
    v = Views(spark, d)
    c = v.table("customer")
    r = v.table("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).selectExpr("c_mktsegment AS book", "o_orderdate AS updated_at", "if(o_orderstatus = 'P', 'running', 'done') AS status")
    e = v.table("lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id", "l_partkey AS from_id", "l_suppkey + 10000000 AS to_id")
    b = c.select(F.col("c_mktsegment").alias("book"))
    return Q.book_summary(b.distinct(), r.where("status <> 'running'"), r.where("status = 'running'"), _node_map(v), e, b, c.where("c_acctbal > 0").select(F.col("c_mktsegment").alias("book")))


@register("a6_book_nodes", f"""WITH {_MAP}, m AS (SELECT node, bool_or(owned) AS owned, count(DISTINCT lesson) AS lessons FROM nm WHERE book = 'BUILDING' GROUP BY node)
SELECT node, owned, lessons, node IN (SELECT node FROM nm WHERE book <> 'BUILDING') AS shared, (SELECT count(*) FROM m) AS total FROM m ORDER BY node LIMIT 100 OFFSET 50""")
def a6(spark, d):
    return Q.book_node_page(_node_map(Views(spark, d)), "BUILDING", 100, 50)


@register("a7_json_bytes", """SELECT sum(octet_length(encode('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}')))::BIGINT AS bytes, count(*) AS n FROM nation""")
def a7(spark, d):
    return Q.json_bytes(Views(spark, d).table("nation").select("n_nationkey", "n_name"))


@register("a8_cluster_sizes", "SELECT label, count(*) AS size FROM embeddings GROUP BY 1")
def a8(spark, d):
    return Q.cluster_sizes(Views(spark, d).embeddings)


@register("a10_library_totals", "SELECT count(*) AS books, count(DISTINCT p_type) AS subjects, sum(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END)::BIGINT AS nodes FROM part")
def a10(spark, d):
    return Q.library_totals(Views(spark, d).table("part").selectExpr("p_type AS subject", "if(p_size % 2 = 0, p_size, null) AS stored_nodes", "1 AS counted_nodes"))
