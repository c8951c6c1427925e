"""Graph and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import filters as X
from quern.operators import graph as G
from quern.plans.catalog import register
from quern.sources.views import Views, ctes

_HIDDEN = "(modality = 'image' AND (NOT keep OR coalesce(review, '') IN ('rejected', 'pending') OR (review IS NULL AND uncertain)))"


@register("f1_hidden_images", f"{ctes('evidence')} SELECT {_HIDDEN} AS hidden, modality, count(*) AS n FROM evidence GROUP BY ALL")
def f1(spark, d):
    return Views(spark, d).evidence.groupBy(X.hidden_image().alias("hidden"), "modality").agg(F.count("*").alias("n"))


@register("f2_review_queue", f"{ctes('evidence')} SELECT id FROM evidence WHERE modality = 'image' AND (review = 'pending' OR (review IS NULL AND uncertain)) ORDER BY key DESC, id LIMIT 500")
def f2(spark, d):
    return X.review_queue(Views(spark, d).evidence.withColumn("created_at", F.col("key"))).select("id")


@register("f4_quality_evidence", f"{ctes('evidence')} SELECT id FROM evidence WHERE NOT synthetic AND NOT quality_excluded")
def f4(spark, d):
    return Views(spark, d).evidence.where(X.quality_evidence()).select("id")


@register("f5_valid_refs", f"{ctes('nodes', 'evidence')} SELECT id FROM nodes WHERE source_refs[1] IN (SELECT id FROM evidence WHERE NOT synthetic AND NOT quality_excluded) OR source_refs[2] IN (SELECT id FROM evidence WHERE NOT synthetic AND NOT quality_excluded)")
def f5(spark, d):
    v = Views(spark, d)
    return X.with_valid_ref(v.nodes, "id", "source_refs", v.evidence.where(X.quality_evidence()))


@register("f6_f8_display", """SELECT CASE WHEN event_type IN ('click', 'view') THEN 'backbone' ELSE CASE WHEN user_id % 3 = 0 THEN 'support' ELSE '' END END AS layer,
CASE WHEN user_id % 5 = 0 THEN 'backbone' WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'backbone' ELSE 'support' END AS resolved,
CASE WHEN event_type = 'click' THEN 'entity' WHEN event_type = 'error' THEN 'rule' ELSE 'sub' END AS type, count(*) AS n FROM events GROUP BY ALL""")
def f6(spark, d):
    e = Views(spark, d).table("events").selectExpr(
        "*", "if(event_type IN ('click', 'view'), '{\"node_layer\":\"backbone\"}', if(user_id % 3 = 0, '{\"layer\":\"support\"}', '{}')) AS properties",
        "case when event_type = 'error' then if(user_id % 2 = 0, 'rule', 'resource') else 'thing' end AS kind", "if(event_type = 'click', 'particle', 'sub') AS subkind", "if(user_id % 5 = 0, 'backbone', '') AS explicit",
    )
    kind = F.when(F.col("event_type") == "error", "rule").otherwise(F.col("kind"))
    sub = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("subkind"))
    return e.groupBy(X.layer().alias("layer"), X.resolve_layer("kind", "subkind", "explicit").alias("resolved"), X.display_type(kind, sub).alias("type")).agg(F.count("*").alias("n"))


def _shown(v: Views):
    n = v.nodes.select("id", F.col("kind").alias("type"), F.when(F.col("key") % 3 == 0, "backbone").otherwise("support").alias("layer"), "name", "definition", "aliases", "key")
    e = v.links.withColumn("id", F.concat_ws(">", "from_id", "to_id")).withColumn("expands", F.lit(True)).distinct()
    return n, e


_LINKED = f"""{ctes('nodes', 'links')}, n AS (SELECT id, kind AS type, CASE WHEN key % 3 = 0 THEN 'backbone' ELSE 'support' END AS layer, name, definition, aliases, key FROM nodes),
e AS (SELECT DISTINCT from_id, to_id, from_id || '>' || to_id AS id FROM links), deg AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e) GROUP BY id),
pick AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1)"""


def _pick(e) -> str:
    return G.degrees(e).orderBy(F.desc("degree"), "id").first()[0]


@register("f9_visible_nodes", f"""{_LINKED}, near AS (SELECT to_id AS id FROM e, pick WHERE from_id = pick.id UNION SELECT from_id FROM e, pick WHERE to_id = pick.id)
SELECT n.id, type, layer FROM n WHERE type IN ('PROMO', 'SMALL', 'LARGE') AND (layer = 'backbone' OR id IN (SELECT id FROM near) OR id IN (SELECT id FROM pick))""")
def f9(spark, d):
    n, e = _shown(Views(spark, d))
    pick = _pick(e)
    base = X.visible_nodes(n, e, ["PROMO", "SMALL", "LARGE"], expanded=pick).unionByName(n.where((F.col("id") == pick) & F.col("type").isin("PROMO", "SMALL", "LARGE")))
    return base.select("id", "type", "layer").distinct()


@register("f9_focus", f"""{_LINKED}, near AS (SELECT to_id AS id FROM e, pick WHERE from_id = pick.id UNION SELECT from_id FROM e, pick WHERE to_id = pick.id UNION SELECT id FROM pick)
SELECT id, type FROM n WHERE type IN ('PROMO', 'SMALL', 'LARGE') AND id IN (SELECT id FROM near)""")
def f9b(spark, d):
    n, e = _shown(Views(spark, d))
    return X.visible_nodes(n, e, ["PROMO", "SMALL", "LARGE"], focus=_pick(e)).select("id", "type")


@register("f10_induced_edges", f"{_LINKED} SELECT from_id, to_id FROM e WHERE from_id IN (SELECT id FROM n WHERE layer = 'backbone') AND to_id IN (SELECT id FROM n WHERE layer = 'backbone')")
def f10(spark, d):
    n, e = _shown(Views(spark, d))
    return X.induced_edges(e, n.where("layer = 'backbone'")).select("from_id", "to_id")


@register("f11_client_search", f"""{_LINKED} SELECT n.id, name, coalesce(degree, 0) AS degree FROM n LEFT JOIN deg ON n.id = deg.id
WHERE contains(lower(concat_ws(' ', n.id, name, definition, array_to_string(aliases, ' '))), 'red')""")
def f11(spark, d):
    n, e = _shown(Views(spark, d))
    n = n.join(G.degrees(e), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return X.client_search(n, "RED").select("id", "name", "degree")


@register("f12_optional_filters", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('5-LOW')")
def f12(spark, d):
    return X.optional_filters(Views(spark, d).table("orders"), o_orderstatus=["F", "P"], o_orderpriority=["5-LOW"], o_custkey=None).agg(F.count("*").alias("n"))


@register("f13_missing_embeddings", f"{ctes('nodes')} SELECT id FROM nodes WHERE status <> 'deprecated' AND key NOT IN (SELECT vec_id FROM embeddings)")
def f13(spark, d):
    v = Views(spark, d)
    return X.missing_embeddings(v.nodes.join(v.embeddings.select("id", "embedding"), "id", "left")).select("id")


@register("g1_isolated", f"{ctes('nodes', 'edges')} SELECT id, name, kind FROM nodes WHERE status <> 'deprecated' AND id NOT IN (SELECT from_id FROM edges WHERE status <> 'deprecated' AND type = 'R' AND created_at < '1993-06-01') AND id NOT IN (SELECT to_id FROM edges WHERE status <> 'deprecated' AND type = 'R' AND created_at < '1993-06-01')")
def g1(spark, d):
    v = Views(spark, d)
    return G.isolated(v.nodes, v.edges.where("type = 'R' AND created_at < '1993-06-01'")).select("id", "name", "kind")


_CC = """reach AS (SELECT id, min(b) AS component FROM r GROUP BY id)"""
_SYM = "s AS (SELECT from_id AS a, to_id AS b FROM e0 UNION SELECT to_id, from_id FROM e0), r(id, b) AS (SELECT a, a FROM s UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.b)"


@register("g2_cycle_nodes", f"""{ctes('links')}, e0 AS (SELECT DISTINCT from_id, to_id FROM links WHERE from_id <> to_id),
p(a, b) AS (SELECT from_id, to_id FROM e0 UNION SELECT p.a, e0.to_id FROM p JOIN e0 ON e0.from_id = p.b), c AS (SELECT DISTINCT a AS id FROM p WHERE a = b)
SELECT id FROM c UNION SELECT x.b FROM p x JOIN p y ON x.b = y.a WHERE x.a IN (SELECT id FROM c) AND y.b IN (SELECT id FROM c)""")
def g2(spark, d):
    return G.on_cycles(Views(spark, d).links.where("from_id <> to_id"))


@register("g3_weak_components", f"""{ctes('links')}, e0 AS (SELECT DISTINCT from_id, to_id FROM links), {_SYM}, {_CC},
big AS (SELECT component, count(*) AS size, array_to_string(list_sort(list(id))[1:3], ',') AS sample_nodes FROM reach GROUP BY component HAVING count(*) > 5) SELECT * FROM big WHERE (SELECT count(*) FROM big) > 1""")
def g3(spark, d):
    return G.weak_components(Views(spark, d).links.withColumn("status", F.lit("active"))).select("component", "size", F.array_join("sample_nodes", ",").alias("sample_nodes"))


@register("g3_components", f"""{ctes('links')}, e0 AS (SELECT DISTINCT from_id, to_id FROM links WHERE from_id <> to_id), {_SYM}, {_CC} SELECT id, component FROM reach""")
def g3b(spark, d):
    return G.components(Views(spark, d).links)


@register("g4_graph_stats", f"""{ctes('nodes', 'links')}, ids AS (SELECT id FROM nodes), e0 AS (SELECT DISTINCT from_id, to_id FROM links WHERE from_id IN (SELECT id FROM ids) AND to_id IN (SELECT id FROM ids)), {_SYM}, {_CC}
SELECT (SELECT count(*) FROM ids WHERE id NOT IN (SELECT a FROM s)) AS isolated, (SELECT count(DISTINCT component) FROM reach) + (SELECT count(*) FROM ids WHERE id NOT IN (SELECT a FROM s)) AS components""")
def g4(spark, d):
    v = Views(spark, d)
    return G.graph_stats(v.nodes, v.links)


@register("g5_communities", f"""{ctes('nodes', 'links')}, ids AS (SELECT id FROM nodes), e0 AS (SELECT DISTINCT from_id, to_id FROM links WHERE from_id <> to_id AND from_id IN (SELECT id FROM ids) AND to_id IN (SELECT id FROM ids)), {_SYM}, {_CC}
SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS community_id FROM reach""")
def g5(spark, d):
    v = Views(spark, d)
    return G.communities(v.nodes, v.links.withColumn("type", F.lit("uses")))


@register("g6_degrees", f"{ctes('edges')} SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id")
def g6(spark, d):
    return G.degrees(Views(spark, d).edges)


_LABELED = f"{_LINKED}, m AS (SELECT n.id, layer, coalesce(degree, 0) AS degree, key % 7 AS community_id FROM n LEFT JOIN deg ON n.id = deg.id)"


@register("g7_labels", f"""{_LABELED}, r AS (SELECT id, row_number() OVER (PARTITION BY community_id ORDER BY layer <> 'backbone', degree DESC, id) AS c, row_number() OVER (ORDER BY layer <> 'backbone', degree DESC, id) AS o FROM m),
q AS (SELECT id, row_number() OVER (ORDER BY (c > 1), o) AS k FROM r) SELECT id FROM q, (SELECT count(*) AS n FROM m) WHERE k <= least(42, greatest(18, round(sqrt(n) * 2.5)))""")
def g7(spark, d):
    v = Views(spark, d)
    n, e = _shown(v)
    n = n.join(G.degrees(e), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return G.label_ids(n, n.select("id", (F.col("key") % 7).alias("community_id")), v.n_parts)


@register("a9_community_info", f"{_LABELED}, t AS (SELECT community_id, type, count(*) AS c FROM m JOIN n ON m.id = n.id GROUP BY ALL) SELECT community_id, sum(c)::BIGINT AS node_count, arg_max(type, (c, -ord)) AS dominant_type FROM (SELECT *, dense_rank() OVER (ORDER BY type) AS ord FROM t) GROUP BY community_id")
def a9(spark, d):
    n, _ = _shown(Views(spark, d))
    return G.community_info(n.select("id", (F.col("key") % 7).alias("community_id")), n)


@register("j14_prepared_nodes", f"""{_LINKED.replace("ctes", "")}, mt AS (SELECT 'part:' || l.doc_id % p AS id, source AS book FROM labels l JOIN documents x ON l.doc_id = x.doc_id, (SELECT count(*) AS p FROM part)),
b AS (SELECT DISTINCT id, book FROM mt), near AS (SELECT DISTINCT x.o AS id, b.book FROM (SELECT from_id AS a, to_id AS o FROM e UNION SELECT to_id, from_id FROM e) x JOIN n ON n.id = x.a AND n.layer = 'backbone' JOIN b ON b.id = x.a),
al AS (SELECT id, book FROM b UNION SELECT near.id, book FROM near JOIN n ON n.id = near.id WHERE layer = 'support')
SELECT n.id, layer, coalesce(degree, 0) AS degree, coalesce((SELECT string_agg(book, ',' ORDER BY book) FROM al WHERE al.id = n.id), '') AS books FROM n LEFT JOIN deg ON deg.id = n.id""")
def j14(spark, d):
    v = Views(spark, d)
    n, e = _shown(v)
    nodes, _ = G.prepare_graph(n, e, v.mentions)
    return nodes.select("id", "layer", "degree", F.array_join("books", ",").alias("books"))


@register("j15_radial", f"""{_LINKED}, x AS (SELECT e.id AS edge_id, CASE WHEN from_id = pick.id THEN to_id ELSE from_id END AS neighbour, e.id NOT LIKE '%0%' AS support FROM e, pick WHERE from_id = pick.id OR to_id = pick.id)
SELECT neighbour, edge_id, degree FROM x JOIN deg ON deg.id = neighbour QUALIFY row_number() OVER (PARTITION BY neighbour ORDER BY support, degree DESC, edge_id) = 1 ORDER BY support, degree DESC, edge_id LIMIT 18""")
def j15(spark, d):
    _, e = _shown(Views(spark, d))
    e = e.withColumn("layer", F.when(F.contains("id", F.lit("0")), "backbone").otherwise("support"))
    return G.radial_neighbours(e, G.degrees(e), _pick(e))


@register("j16_neighbours", f"{_LINKED} SELECT to_id AS id FROM e, pick WHERE from_id = pick.id UNION SELECT from_id FROM e, pick WHERE to_id = pick.id")
def j16(spark, d):
    _, e = _shown(Views(spark, d))
    return X.neighbours(e, _pick(e))
