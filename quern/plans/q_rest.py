"""Vector, lineage and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import vectors as V
from quern.operators import cluster as C
from quern.operators import lineage as L
from quern.plans.catalog import register
from quern.sources import tables as T
from quern.sources.views import Views, ctes


@register("v1_parse_embeddings", "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN NULL ELSE 2 END::INT AS dims FROM part")
def v1(spark, d):
    p = Views(spark, d).table("part").selectExpr("p_partkey", "case p_partkey % 5 when 0 then '[]' when 1 then '[1, oops' when 2 then '[1, 2.5]' when 3 then '[0.1,-2]' else ' [3e2, 4]' end AS t")
    e = V.parse_embedding("t")
    return p.select("p_partkey", F.when(e.isNotNull(), F.size(e)).alias("dims"))


@register("v3_communities")
def v3(spark, d):
    return C.spherical_kmeans(Views(spark, d).embeddings.select("id", "embedding"))


@register("v4_kmeans")
def v4(spark, d):
    return C.kmeans(Views(spark, d).embeddings.select("id", "embedding"))


@register("v5_pca_layout")
def v5(spark, d):
    return C.pca_layout(Views(spark, d).embeddings.select("id", "embedding"))


@register("v6_write_layout", f"{ctes('vectors')} SELECT id, label::VARCHAR AS cluster, round(e[1], 4) AS x FROM vectors")
def v6(spark, d):
    e = Views(spark, d).embeddings
    n = e.select("id", F.create_map(F.lit("kind"), F.lit("k")).alias("properties"))
    out = C.write_layout(n, e.select("id", "label"), e.select("id", F.col("embedding")[0].cast("double").alias("x"), F.lit(0.0).alias("y")))
    return out.select("id", F.col("properties")["cluster"].alias("cluster"), F.col("properties")["x"].cast("double").alias("x"))


@register("v7_embedding_text", f"{ctes('nodes')} SELECT id, name || chr(10) || definition || CASE WHEN key % 2 = 0 THEN chr(10) || tags[1] ELSE '' END AS text FROM nodes")
def v7(spark, d):
    n = Views(spark, d).nodes
    return n.select("id", C.embedding_text("name", "definition", F.when(F.col("key") % 2 == 0, F.col("tags")[0]).otherwise(" ")).alias("text"))


@register("v8_unit_text", f"""{ctes('nodes', 'evidence', 'mentions')}, x AS (SELECT target_id AS id, list(f ORDER BY eid)[1:12] AS l FROM (SELECT target_id, e.id AS eid, trim(regexp_replace(excerpt, '\\s+', ' ', 'g')) AS f FROM mentions JOIN evidence e ON e.id = source_refs[1]) GROUP BY 1)
SELECT n.id, md5(concat_ws(chr(10), trim(name), trim(definition), CASE WHEN l IS NOT NULL THEN array_to_string(list_transform(l, lambda t: CASE WHEN length(t) > 900 THEN substr(t, 1, 897) || '...' ELSE t END), chr(10)) END)) AS text FROM nodes n LEFT JOIN x USING (id)""")
def v8(spark, d):
    v = Views(spark, d)
    e = v.mentions.select(F.col("target_id").alias("id"), F.explode("source_refs").alias("ref")).join(v.evidence.select(F.col("id").alias("ref"), "excerpt"), "ref")
    e = e.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ref", "excerpt"))), 1, 12)["excerpt"].alias("excerpts"))
    j = v.nodes.join(e, "id", "left")
    t = C.unit_text(F.col("name"), F.col("definition"), F.lit(None).cast("array<string>"), F.lit(""), F.col("excerpts"))
    return j.select("id", F.md5(t).alias("text"))


@register("v9_stale_units", f"{ctes('nodes')} SELECT id FROM nodes WHERE key % 3 <> 0 OR key % 2 = 0")
def v9(spark, d):
    n = Views(spark, d).nodes
    u = n.select("id", F.col("definition").alias("text"))
    stored = n.where("key % 3 = 0").select("id", F.sha2("definition", 256).alias("hash"), F.when(F.col("key") % 2 == 0, "old").otherwise("m1").alias("model"))
    return C.stale(u, stored, "m1").select("id")


@register("v10_layouts", f"""{ctes('vectors')}, r AS (SELECT id, label AS community, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS n FROM vectors) SELECT id, community, round(24 * sqrt(n) * cos(n * pi() * (3 - sqrt(5))), 6) + 0.0 AS x, round(24 * sqrt(n) * sin(n * pi() * (3 - sqrt(5))), 6) + 0.0 AS y FROM r""")
def v10(spark, d):
    e = Views(spark, d).embeddings
    out = C.phyllotaxis(e.select("id", F.col("label").alias("community")))
    return out.select("id", "community", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@register("v11_stable_angles", """WITH RECURSIVE h AS (SELECT p_partkey, 'part:' || p_partkey AS s, 1 AS i, 0::BIGINT AS h FROM part UNION ALL SELECT p_partkey, s, i + 1, (h * 31 + ascii(substr(s, i, 1))) % 4294967296 FROM h WHERE i <= length(s))
SELECT p_partkey, (h % 360)::INT AS angle FROM h WHERE i = length(s) + 1""")
def v11(spark, d):
    return Views(spark, d).table("part").select("p_partkey", X.stable_angle(F.concat(F.lit("part:"), "p_partkey")).alias("angle"))


_RUNS = """runs AS (SELECT DISTINCT c_mktsegment AS book, c_custkey AS lesson FROM customer), nm AS (SELECT o_custkey AS lesson, 'part:' || l_partkey AS node, l_returnflag = 'R' AS owned FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
mine AS (SELECT node, bool_or(owned) AS owned FROM nm WHERE lesson IN (SELECT lesson FROM runs WHERE book = 'BUILDING') GROUP BY node)"""


def _scope(v: Views):
    runs = v.table("customer").selectExpr("c_mktsegment AS book", "c_custkey AS lesson").distinct()
    nm = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey AS lesson", "concat('part:', l_partkey) AS node", "l_returnflag = 'R' AS owned")
    return runs, nm


@register("l1_book_scope", f"{ctes('nodes', 'edges', 'mentions')}, {_RUNS} SELECT 'nodes' AS t, count(*) AS n FROM nodes WHERE id IN (SELECT node FROM mine WHERE owned) UNION ALL SELECT 'edges', count(*) FROM edges WHERE from_id IN (SELECT node FROM mine WHERE owned) UNION ALL SELECT 'mentions', count(*) FROM mentions WHERE target_id IN (SELECT node FROM mine WHERE owned) UNION ALL SELECT 'runs', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'")
def l1(spark, d):
    v = Views(spark, d)
    s = L.BookScope(*_scope(v), v.edges, "BUILDING")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
    return n(s.rows(v.nodes, "node", "id"), "nodes").union(n(s.rows(v.edges, "edge", "id"), "edges")).union(n(s.rows(v.mentions, "node", "target_id"), "mentions")).union(n(s.rows(v.table("customer"), "lesson", "c_custkey"), "runs"))


@register("l2_delete_rest", f"{ctes('nodes')}, {_RUNS} SELECT id FROM nodes WHERE id NOT IN (SELECT node FROM mine WHERE owned)")
def l2(spark, d):
    v = Views(spark, d)
    return L.BookScope(*_scope(v), v.edges, "BUILDING").rest(v.nodes, "node", "id").select("id")


@register("l1_export_scope", f"""{ctes('nodes', 'edges', 'mentions', 'profiles', 'evidence')}, {_RUNS}, mr AS (SELECT o_orderkey // 8 AS run, list(DISTINCT o_custkey) AS sel FROM orders GROUP BY 1), e AS (SELECT id FROM edges WHERE from_id IN (SELECT node FROM mine))
SELECT 'mentions' AS t, count(*) AS n FROM mentions WHERE target_id IN (SELECT node FROM mine) UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'profiles', count(*) FROM profiles WHERE node_id IN (SELECT node FROM mine)
UNION ALL SELECT 'merge_runs', count(*) FROM mr WHERE len(list_filter(sel, lambda x: x IN (SELECT lesson FROM runs WHERE book = 'BUILDING'))) > 0 UNION ALL SELECT 'terms', count(*) FROM part""".replace("len(list_filter(sel, lambda x: x IN (SELECT lesson FROM runs WHERE book = 'BUILDING'))) > 0", "run IN (SELECT o_orderkey // 8 FROM orders WHERE o_custkey IN (SELECT lesson FROM runs WHERE book = 'BUILDING'))"))
def l1b(spark, d):
    v = Views(spark, d)
    s = L.BookScope(*_scope(v), v.edges, "BUILDING", owned=False, profiles=v.profiles, evidence=v.evidence)
    merges = v.table("orders").groupBy((F.col("o_orderkey") / 8).cast("long").alias("run")).agg(F.collect_set("o_custkey").alias("selection"))
    parts = [
        ("mentions", s.table("mentions", v.mentions.withColumn("target_type", F.lit("node")))), ("edges", s.table("edges", v.edges)), ("profiles", s.table("domain_profiles", v.profiles)),
        ("merge_runs", s.table("merge_runs", merges)), ("terms", s.table("taxonomy_terms", v.table("part"))),
    ]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = one if out is None else out.union(one)
    return out


@register("l2_all_conflicts", f"""{ctes('mentions')}, {_RUNS}, own AS (SELECT lesson FROM runs WHERE book = 'BUILDING'), mr AS (SELECT DISTINCT 'run:' || o_orderkey // 8 AS run, o_custkey AS lesson FROM orders), tg AS (SELECT node AS id FROM mine WHERE owned)
SELECT DISTINCT run AS node, 'mixed merge' AS reason FROM mr WHERE lesson NOT IN (SELECT lesson FROM own) AND run IN (SELECT run FROM mr WHERE lesson IN (SELECT lesson FROM own))
UNION ALL SELECT DISTINCT target_id, 'external mention' FROM mentions WHERE source_id <> 'BUILDING' AND target_id IN (SELECT id FROM tg) UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'external evidence' FROM lineitem WHERE l_linestatus <> 'BUILDING' AND 'part:' || l_partkey IN (SELECT id FROM tg)""")
def l2c(spark, d):
    v = Views(spark, d)
    merges = v.table("orders").select(F.concat(F.lit("run:"), (F.col("o_orderkey") / 8).cast("long")).alias("merge_run"), F.col("o_custkey").alias("lesson")).distinct()
    links = v.table("lineitem").selectExpr("l_linestatus AS source_id", "concat('part:', l_partkey) AS owner_id")
    return L.delete_conflicts(*_scope(v), "BUILDING", merges, v.mentions, links).where("reason NOT IN ('matched only', 'shared')")


@register("l2_delete_conflicts", f"WITH {_RUNS}, o AS (SELECT DISTINCT node FROM nm WHERE lesson NOT IN (SELECT lesson FROM runs WHERE book = 'BUILDING')) SELECT node, 'matched only' AS reason FROM mine WHERE NOT owned UNION ALL SELECT node, 'shared' FROM mine WHERE owned AND node IN (SELECT node FROM o)")
def l2b(spark, d):
    return L.delete_conflicts(*_scope(Views(spark, d)), "BUILDING")


@register("l3_may_start", """WITH j AS (SELECT q AS queue, n_name AS book FROM nation, (SELECT unnest([0, 1]) AS q) WHERE n_nationkey % 6 = q AND n_nationkey < 6 * (3 + q))
SELECT q::INT AS queue, n_name AS book FROM nation, (SELECT unnest([0, 1]) AS q) WHERE (q, n_name) NOT IN (SELECT queue, book FROM j) AND q IN (SELECT queue FROM j GROUP BY 1 HAVING count(*) < 4)""")
def l3(spark, d):
    """Two queues with three and four running jobs: only the first lets requests in."""
    n = Views(spark, d).table("nation")
    asked, out = n.selectExpr("n_name AS book"), None
    for queue, running in ((0, 3), (1, 4)):
        jobs = n.selectExpr("n_name AS book", f"if(n_nationkey % 6 = {queue} AND n_nationkey < {6 * running}, 'running', 'done') AS status")
        may = L.may_start(jobs, asked).select(F.lit(queue).alias("queue"), "book")
        out = may if out is None else out.union(may)
    return out


@register("l5_slots", "SELECT conv_id AS book, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3)::INT AS slot FROM conversations")
def l5(spark, d):
    return L.slots(Views(spark, d).table("conversations").selectExpr("conv_id AS book", "turn"), ["turn"], 3)


_STATE = "CASE event_type WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'running' ELSE 'completed' END"


@register("l7_latest_states", f"SELECT user_id, arg_max({_STATE}, event_id) AS status, max(event_id) AS seq, min(ts) FILTER ({_STATE} = 'running') AS started_at, max(ts) FILTER ({_STATE} <> 'running') AS finished_at FROM events GROUP BY 1")
def l7(spark, d):
    return L.latest_state(Views(spark, d).table("events").selectExpr("user_id", f"{_STATE} AS status", "event_id AS seq", "ts"), ["user_id"])


@register("l8_step_states", f"""WITH s AS (SELECT user_id AS job, event_id % 4 AS step, {_STATE} AS st FROM events) SELECT job, step, CASE WHEN bool_or(st = 'blocked') THEN 'blocked' WHEN bool_or(st = 'running') THEN 'active' WHEN bool_and(st = 'completed') THEN 'complete' ELSE 'pending' END AS state FROM s GROUP BY ALL""")
def l8(spark, d):
    return L.step_states(Views(spark, d).table("events").selectExpr("user_id AS job", "event_id % 4 AS step", "concat('retry-', event_id % 2, '-s') AS stage", f"{_STATE} AS status"))


@register("l9_failed_anchors", f"WITH l AS (SELECT user_id AS job, 'a' || event_id % 6 AS anchor, arg_max({_STATE}, event_id) AS st FROM events GROUP BY ALL) SELECT job, string_agg(anchor, ',' ORDER BY anchor) AS anchors FROM l WHERE st = 'blocked' GROUP BY 1")
def l9(spark, d):
    e = Views(spark, d).table("events").selectExpr("user_id AS job", "concat('a', event_id % 6) AS anchor", f"{_STATE} AS status", "event_id AS seq")
    return L.failed_anchors(e).select("job", F.array_join("anchors", ",").alias("anchors"))


@register("l10_image_reviews", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE doc_id % 2 = 0 END AS keep, CASE doc_id % 3 WHEN 0 THEN 'relevant' WHEN 1 THEN 'decorative' ELSE lang END AS relevance, CASE doc_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS review_status FROM documents")
def l10(spark, d):
    e = Views(spark, d).table("documents")
    acts = e.where("doc_id % 3 <> 2").selectExpr("doc_id AS id", "if(doc_id % 3 = 0, 'approve', 'reject') AS action")
    return L.review_images(e.selectExpr("doc_id AS id", "doc_id % 2 = 0 AS keep", "lang AS relevance", "'pending' AS review_status"), acts)


@register("l11_file_metadata", """WITH f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Physics Grade ' || p_size || ' senior.pdf' WHEN 1 THEN '初中化学_' || p_partkey || '.pdf' ELSE 'other ' || p_partkey || '.PDF' END AS n FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'physics' WHEN 1 THEN 'chemistry' ELSE 'general' END AS subject, CASE p_partkey % 3 WHEN 0 THEN 'senior-secondary' WHEN 1 THEN 'junior-secondary' ELSE 'general' END AS stage, regexp_extract(lower(n), '(?:grade|g)[\\s_-]*(\\d+)', 1) AS grade,
trim(regexp_replace(regexp_replace(lower(n), '\\.[a-z0-9]+$', ''), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha256(n), 1, 8) AS book_id FROM f""")
def l11(spark, d):
    p = Views(spark, d).table("part").selectExpr("p_partkey", "case p_partkey % 3 when 0 then concat('Physics Grade ', p_size, ' senior.pdf') when 1 then concat('初中化学_', p_partkey, '.pdf') else concat('other ', p_partkey, '.PDF') end AS n")
    subject, stage, grade, book = L.file_metadata("n")
    return p.select("p_partkey", subject.alias("subject"), stage.alias("stage"), grade.alias("grade"), book.alias("book_id"))


@register("l12_type_groups", "SELECT CASE p_type WHEN 'PROMO' THEN 'a' WHEN 'SMALL' THEN 'a' WHEN 'LARGE' THEN 'b' ELSE 'other' END AS grp, count(*) AS n, count(*) FILTER (p_type IN ('PROMO', 'LARGE')) AS n_selected FROM part GROUP BY 1")
def l12(spark, d):
    g = spark.createDataFrame([("PROMO", "a"), ("SMALL", "a"), ("LARGE", "b")], "type string, grp string")
    return L.type_groups(Views(spark, d).table("part").select(F.col("p_type").alias("type")), g, ["PROMO", "LARGE"])


@register("s1_s2_visible_evidence", f"{ctes('evidence')} SELECT id FROM evidence WHERE source_id = 'src3' AND NOT (modality = 'image' AND (NOT keep OR coalesce(review, '') IN ('rejected', 'pending') OR (review IS NULL AND uncertain)))")
def s1(spark, d):
    v = Views(spark, d)
    return T.visible(v.evidence.where("source_id = 'src3'")).select("id")


@register("s3_node_body", f"{ctes('bodies')} SELECT node_id, content FROM bodies WHERE node_id = 'part:20' AND trim(content) <> ''")
def s3(spark, d):
    return T.node_body(Views(spark, d).bodies.withColumn("status", F.lit("active")), "part:20").select("node_id", "content")


@register("s14_export_size", f"""{ctes('cards')} SELECT count(*) AS n, sum(octet_length(encode('{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}}')))::BIGINT AS bytes FROM customer""")
def s14(spark, d):
    rows = T.export_json(Views(spark, d).table("customer").select("c_custkey", "c_name"), 1 << 40)
    return rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))


@register("s15_artifact", f"""{ctes('nodes', 'links', 'profiles')}, n AS (SELECT id FROM nodes WHERE status <> 'deprecated') SELECT 'nodes' AS part, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM links WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)
UNION ALL SELECT 'profiles', count(*) FROM profiles WHERE status <> 'deprecated' AND node_id IN (SELECT id FROM n)""")
def s15(spark, d):
    v = Views(spark, d)
    parts = T.artifact(v.nodes, v.links.withColumn("status", F.lit("active")), v.profiles)
    return T.table_counts({"nodes": parts["nodes"], "edges": parts["edges"], "profiles": parts["profiles"]}).withColumnRenamed("table", "part")


@register("s16_verification", f"{ctes('nodes', 'links')} SELECT 'dangling ' || e AS problem, count(*) AS n FROM (SELECT 'from_id' AS e FROM links JOIN nodes ON id = from_id WHERE kind = 'PROMO' UNION ALL SELECT 'to_id' FROM links JOIN nodes ON id = to_id WHERE kind = 'PROMO') GROUP BY 1 UNION ALL SELECT 'not exactly one unit', count(*) FROM nodes WHERE kind <> 'PROMO' AND key % 5 <> 0")
def s16(spark, d):
    v = Views(spark, d)
    n = v.nodes.where("kind <> 'PROMO'")
    e = v.links.withColumn("id", F.concat_ws(">", "from_id", "to_id"))
    u = n.where("key % 5 = 0").select(F.col("id").alias("node_id"))
    return T.verify_artifact({"nodes": n, "edges": e}, {}, u).groupBy("problem").agg(F.count("*").alias("n"))


@register("s18_admin_page", "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_suppkey || ' ' || s_name), '1') ORDER BY s_name, s_suppkey LIMIT 20 OFFSET 5")
def s18(spark, d):
    return T.admin_page(Views(spark, d).table("supplier").select("s_suppkey", "s_name"), "1", "s_name", 20, 5)


@register("s19_counts", "SELECT 'part' AS \"table\", count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def s19(spark, d):
    t = Views(spark, d).table
    return T.table_counts({n: t(n) for n in ("part", "orders", "documents")})


@register("s20_update_row", "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'Renamed' ELSE n_name END AS n_name FROM nation")
def s20(spark, d):
    return T.update_rows(Views(spark, d).table("nation").select("n_nationkey", "n_name"), {"n_nationkey": 3}, {"n_name": "Renamed"}, ["n_name"])


@register("s22_catalogue", "SELECT r_name AS dataset, (SELECT count(DISTINCT n_name) FROM nation WHERE n_regionkey = r_regionkey) AS n_books, (SELECT count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n_profiles, r_name = (SELECT min(r_name) FROM region) AS active FROM region")
def s22(spark, d):
    t = Views(spark, d).table
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return T.source_catalogue(t("region").select(F.col("r_name").alias("dataset"), F.lit(False).alias("is_active")), n.selectExpr("r_name AS dataset", "n_name AS book"), n.join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("r_name AS dataset"))


@register("s23_s24_catalogues", "SELECT CASE conv_id % 10 WHEN 0 THEN 'canonical' ELSE 'r' || conv_id % 10 END AS book, max(turn) + 1 AS n_pages, count(*) AS n_blocks FROM conversations GROUP BY 1")
def s23(spark, d):
    b = Views(spark, d).table("conversations").selectExpr("concat('r', conv_id % 10) AS root", "turn AS page_index")
    return T.reader_books(b, spark.createDataFrame([("r0", "canonical")], "root string, book string"))
