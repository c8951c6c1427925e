"""Normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import normalize as N
from quern.plans.catalog import register
from quern.sources.views import Views, ctes


@register("n1_edge_duplicates", f"""{ctes('edges')}, r AS (SELECT id, first_value(id) OVER w AS kept_id, row_number() OVER w AS k FROM edges WHERE status <> 'deprecated'
WINDOW w AS (PARTITION BY from_id, to_id, type ORDER BY created_at, id)) SELECT id, kept_id FROM r WHERE id <> kept_id""")
def n1(spark, d):
    return N.edge_duplicates(Views(spark, d).edges)


@register("n2_undirected_duplicates", f"""{ctes('edges')}, r AS (SELECT id, first_value(id) OVER (PARTITION BY type, directionality, CASE directionality WHEN 'undirected' THEN least(from_id, to_id) ELSE from_id END,
CASE directionality WHEN 'undirected' THEN greatest(from_id, to_id) ELSE to_id END ORDER BY created_at, id) AS kept_id FROM edges WHERE status <> 'deprecated') SELECT id, kept_id FROM r WHERE id <> kept_id""")
def n2(spark, d):
    return N.undirected_edge_duplicates(Views(spark, d).edges)


@register("n3_self_loops", """SELECT a AS from_id, count(*) AS n FROM (SELECT 'part:' || l_partkey AS a, 'part:' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem)
WHERE a = b GROUP BY a""")
def n3(spark, d):
    return N.self_loops(Views(spark, d).all_links.withColumn("status", F.lit("active"))).groupBy("from_id").agg(F.count("*").alias("n"))


@register("n4_duplicate_groups", f"""{ctes('nodes')} SELECT lower(name) AS normalized_name, kind, string_agg(id, ',' ORDER BY created_at, id) AS ids FROM nodes WHERE status = 'active' GROUP BY ALL HAVING count(*) > 1""")
def n4(spark, d):
    return N.duplicate_groups(Views(spark, d).nodes).withColumn("ids", F.array_join("ids", ","))


_CODE = "lower(regexp_replace(subkind, '[\\s\\-/]+', '_', 'g'))"
_CANON = f"""s AS (SELECT *, CASE WHEN regexp_full_match({_CODE}, '[a-z][a-z0-9_]*') THEN 15 ELSE 0 END + CASE WHEN regexp_full_match(id, '[a-z0-9/_:-]+') THEN 3 ELSE 0 END
  + CASE WHEN key IN (SELECT vec_id FROM embeddings) THEN 1 ELSE 0 END AS score FROM nodes WHERE status = 'active'),
c AS (SELECT lower(name) AS normalized_name, kind, id AS canonical_id, score::INT AS score, count(*) OVER (PARTITION BY lower(name), kind) AS n FROM s
  QUALIFY row_number() OVER (PARTITION BY lower(name), kind ORDER BY score DESC, created_at, id) = 1)"""


def _nodes(v: Views):
    return v.nodes.join(v.embeddings.select("id", F.lit(True).alias("e")), "id", "left").withColumn("has_embedding", F.coalesce("e", F.lit(False))).drop("e")


@register("n5_canonical_nodes", f"{ctes('nodes')}, {_CANON} SELECT * FROM c WHERE n > 1")
def n5(spark, d):
    return N.canonical_nodes(_nodes(Views(spark, d)))


@register("n6_merged_groups", f"""{ctes('nodes')}, {_CANON},
m AS (SELECT canonical_id, s.*, s.id <> canonical_id AS later FROM s JOIN c ON lower(s.name) = normalized_name AND s.kind = c.kind WHERE n > 1),
r AS (SELECT canonical_id, ref, min(k) AS k FROM (SELECT canonical_id, unnest(source_refs) AS ref, row_number() OVER (PARTITION BY canonical_id ORDER BY later, created_at, id) * 10 + unnest([1, 2]) AS k FROM m) GROUP BY ALL)
SELECT canonical_id, (SELECT string_agg(ref, ',' ORDER BY k) FROM r WHERE r.canonical_id = m.canonical_id) AS source_refs, string_agg(id, ',' ORDER BY created_at, id) FILTER (later) AS merged_from FROM m GROUP BY canonical_id""")
def n6(spark, d):
    return N.merge_groups(_nodes(Views(spark, d))).select("canonical_id", F.array_join("source_refs", ",").alias("source_refs"), F.array_join("merged_from", ",").alias("merged_from"))


@register("n7_remapped_edges", f"""{ctes('nodes', 'edges')}, {_CANON}, m AS (SELECT s.id AS duplicate_id, canonical_id FROM s JOIN c ON lower(s.name) = normalized_name AND s.kind = c.kind WHERE n > 1 AND s.id <> canonical_id)
SELECT coalesce(canonical_id, from_id) AS from_id, count(*) AS n FROM edges LEFT JOIN m ON duplicate_id = from_id GROUP BY ALL""")
def n7(spark, d):
    v = Views(spark, d)
    return N.remap(v.edges, N.remap_table(_nodes(v)), "from_id").groupBy("from_id").agg(F.count("*").alias("n"))


@register("n8_profile_groups", f"""{ctes('profiles', 'evidence')}, p AS (SELECT *, 'profile:' || substr(sha1(node_id || '||' || domain), 1, 12) AS cid FROM profiles WHERE status <> 'deprecated'),
st AS (SELECT node_id, domain, string_agg(x, ',' ORDER BY k) AS school_stages FROM (SELECT node_id, domain, school_stages[1] AS x, min(created_at || id) AS k FROM p GROUP BY ALL) GROUP BY ALL),
rf AS (SELECT node_id, domain, string_agg(x, ',' ORDER BY k) AS source_refs FROM (SELECT node_id, domain, source_refs[1] AS x, min(created_at || id) AS k FROM p WHERE source_refs[1] IN (SELECT id FROM evidence) GROUP BY ALL) GROUP BY ALL)
SELECT node_id, domain, cid AS canonical_profile_id, arg_min(id, created_at || id) AS primary_id, count(*)::INT AS n_duplicates, st.school_stages, coalesce(rf.source_refs, '') AS source_refs, min(created_at) AS created_at
FROM p JOIN st USING (node_id, domain) LEFT JOIN rf USING (node_id, domain) GROUP BY ALL""")
def n8(spark, d):
    v = Views(spark, d)
    g = N.profile_groups(v.profiles, v.evidence)
    return g.select("node_id", "domain", "canonical_profile_id", "primary_id", F.size("duplicate_ids").alias("n_duplicates"), F.array_join("school_stages", ",").alias("school_stages"), F.array_join("source_refs", ",").alias("source_refs"), "created_at")


@register("n8_profile_properties", """WITH p AS (SELECT 'part:' || o_custkey % 50 AS node_id, o_orderpriority AS domain, strftime(o_orderdate, '%Y-%m-%d') || 'prof:' || o_orderkey AS k, o_orderkey AS n, o_orderstatus AS s FROM orders),
t AS (SELECT node_id, domain, string_agg(s, ',' ORDER BY k) AS tags FROM (SELECT node_id, domain, s, min(k) AS k FROM p GROUP BY ALL) GROUP BY ALL)
SELECT node_id, domain, arg_min(n, k)::VARCHAR AS n, max(tags) AS tags FROM p JOIN t USING (node_id, domain) GROUP BY ALL""")
def n8b(spark, d):
    o = Views(spark, d).table("orders").selectExpr(
        "concat('part:', o_custkey % 50) AS node_id", "o_orderpriority AS domain", "date_format(o_orderdate, 'yyyy-MM-dd') AS created_at", "concat('prof:', o_orderkey) AS id", "'active' AS status",
        """concat('{"n": ', o_orderkey, ', "none": "", "tags": ["', o_orderstatus, '"]}') AS properties""",
    )
    g = N.merge_profile_properties(o)
    return g.select("node_id", "domain", F.get_json_object("properties", "$.n").alias("n"), F.regexp_replace(F.get_json_object("properties", "$.tags"), r'[\[\]" ]', "").alias("tags"))


_GROUPS = "g AS (SELECT p_partkey AS k, 'part:' || p_partkey AS node_id, 'part:' || (p_partkey - p_partkey % 4) AS canonical_id, lpad(p_partkey::VARCHAR, 10, '0') AS created_at, p_name, p_brand, p_size FROM part)"


def _groups(v: Views):
    """Four neighbouring parts to a group of duplicates; the first is canonical."""
    p = v.table("part").selectExpr("p_partkey AS k", "concat('part:', p_partkey) AS node_id", "lpad(p_partkey, 10, '0') AS created_at", "p_name", "p_brand", "p_size")
    remap = p.where("k % 4 <> 0").selectExpr("node_id AS duplicate_id", "concat('part:', k - k % 4) AS canonical_id")
    return p, remap


@register("n6_merged_cards", f"""WITH {_GROUPS}, c AS (SELECT * FROM g WHERE k % 3 <> 0), s AS (SELECT canonical_id, 's' || (i + k % 2) AS id, created_at, i, p_brand, p_name FROM c, LATERAL (SELECT unnest([0, 1]) AS i)),
x AS (SELECT canonical_id, id, p_brand, min(created_at || i) AS o FROM s GROUP BY ALL), y AS (SELECT canonical_id, id, string_agg(p_brand, '+' ORDER BY o) AS content, min(o) AS o FROM x GROUP BY ALL),
z AS (SELECT canonical_id, string_agg(id || ':' || content, '|' ORDER BY o) AS sections FROM y GROUP BY 1), m AS (SELECT canonical_id, p_brand, min(created_at) AS o FROM c GROUP BY ALL)
SELECT canonical_id AS node_id, 'card:' || arg_min(k, ((node_id <> canonical_id)::INT || created_at)) AS id, sections, (SELECT string_agg(p_brand, chr(10) || chr(10) ORDER BY o) FROM m WHERE m.canonical_id = c.canonical_id) AS summary FROM c JOIN z USING (canonical_id) GROUP BY ALL""")
def n6b(spark, d):
    p, remap = _groups(Views(spark, d))
    cards = p.where("k % 3 <> 0").selectExpr(
        "node_id", "concat('card:', k) AS id", "p_name AS title", "p_brand AS summary", "array(concat('doc:', k)) AS source_refs", "created_at",
        "transform(array(0, 1), i -> named_struct('id', concat('s', i + k % 2), 'title', p_name, 'section_type', 'other', 'content', array(p_brand), 'source_refs', array(concat('doc:', k)))) AS sections",
    )
    shown = F.array_join(F.transform("sections", lambda s: F.concat(s["id"], F.lit(":"), F.array_join(s["content"], "+"))), "|")
    return N.merge_group_cards(cards, remap).select("node_id", "id", shown.alias("sections"), "summary")


@register("n6_merged_bodies", f"""WITH {_GROUPS}, b AS (SELECT *, ['imported_unit', 'card_expansion', 'manual', 'other'][(p_size % 4 + 1)::INT] AS kind FROM g WHERE k % 5 <> 0), m AS (SELECT canonical_id, p_brand, min(created_at) AS o FROM b GROUP BY ALL)
SELECT canonical_id AS node_id, CASE min(CASE kind WHEN 'manual' THEN 0 WHEN 'other' THEN 1 WHEN 'card_expansion' THEN 2 ELSE 3 END) WHEN 0 THEN 'manual' WHEN 1 THEN 'model_generation' WHEN 2 THEN 'card_expansion' ELSE 'imported_unit' END AS generated_from,
string_agg('img:' || k, ',' ORDER BY created_at) AS media, (SELECT string_agg(p_brand, chr(10) || chr(10) ORDER BY o) FROM m WHERE m.canonical_id = b.canonical_id) AS content FROM b GROUP BY canonical_id""")
def n6c(spark, d):
    p, remap = _groups(Views(spark, d))
    bodies = p.where("k % 5 <> 0").selectExpr("node_id", "p_brand AS content", "array(concat('img:', k)) AS media_refs", "array(concat('doc:', k)) AS source_refs", "element_at(array('imported_unit', 'card_expansion', 'manual', 'other'), cast(p_size % 4 + 1 AS int)) AS generated_from", "created_at")
    return N.merge_group_bodies(bodies, remap).select("node_id", "generated_from", F.array_join("media_refs", ",").alias("media"), "content")


@register("n9_card_sections", f"""{ctes('cards')} SELECT c.node_id, i::INT AS i, CASE WHEN s.id = '' THEN 'section-' || i ELSE s.id END AS id, s.title, CASE WHEN section_type = '' THEN 'other' ELSE section_type END AS section_type,
array_to_string(list_filter(list_transform(content, lambda x: trim(x)), lambda x: x <> ''), '|') AS content FROM cards c JOIN sections s ON c.node_id = s.node_id""")
def n9(spark, d):
    c = N.card_sections(Views(spark, d).cards).select("node_id", F.posexplode("sections").alias("i", "s"))
    return c.select("node_id", "i", "s.id", "s.title", "s.section_type", F.array_join("s.content", "|").alias("content"))


@register("n10_node_terms", f"""{ctes('nodes')}, t AS (SELECT id AS node_id, name AS term, 'canonical' AS term_type, 0 AS pos FROM nodes WHERE status <> 'deprecated'
UNION ALL SELECT id, unnest(aliases), 'alias', unnest(range(1, len(aliases) + 1)) FROM nodes WHERE status <> 'deprecated' UNION ALL SELECT id, unnest(tags), 'tag', 99 FROM nodes WHERE status <> 'deprecated')
SELECT node_id, term_type, lower(trim(term)) AS term_norm, arg_min(term, pos) AS term FROM t WHERE trim(term) <> '' GROUP BY ALL""")
def n10(spark, d):
    return N.node_terms(Views(spark, d).nodes)


@register("n11_normalize_summary", f"""{ctes('nodes', 'edges', 'profiles', 'cards')} SELECT
(SELECT count(*) FROM (SELECT id, first_value(id) OVER (PARTITION BY from_id, to_id, type ORDER BY created_at, id) AS kept FROM edges WHERE status <> 'deprecated') WHERE id <> kept) AS duplicate_edges,
(SELECT count(*) FROM (SELECT DISTINCT node_id, domain FROM profiles WHERE status <> 'deprecated')) AS profile_groups, (SELECT count(DISTINCT node_id) FROM sections) AS modified_cards,
(SELECT count(*) FROM (SELECT DISTINCT id, lower(t) FROM (SELECT id, unnest(aliases) AS t FROM nodes WHERE status <> 'deprecated') WHERE trim(t) <> '')) + 2 * (SELECT count(*) FROM nodes WHERE status <> 'deprecated') AS terms""")
def n11(spark, d):
    v = Views(spark, d)
    return N.normalize_summary(v.edges, v.profiles, v.cards, v.nodes)


@register("n12_book_keys", """SELECT DISTINCT value FROM (SELECT source AS value FROM documents UNION SELECT c_mktsegment FROM customer UNION SELECT o_orderpriority FROM orders UNION SELECT event_type FROM events UNION SELECT r_name FROM region)""")
def n12(spark, d):
    t = Views(spark, d).table
    return N.distinct_values((t("documents"), "source"), (t("customer"), "c_mktsegment"), (t("orders"), "o_orderpriority"), (t("events"), "event_type"), (t("region"), "r_name"))


@register("n13_evidence_links", f"""{ctes('edges', 'profiles', 'mentions', 'cards')} SELECT owner_type, ordinal::INT AS ordinal, count(*) AS n, count(DISTINCT evidence_id) AS evidence FROM (
SELECT 'edge' AS owner_type, unnest(source_refs) AS evidence_id, unnest(range(1, len(source_refs) + 1))::INT AS ordinal FROM edges UNION ALL SELECT 'domain_profile', unnest(source_refs), unnest(range(1, len(source_refs) + 1)) FROM profiles
UNION ALL SELECT 'mention', unnest(source_refs), unnest(range(1, len(source_refs) + 1)) FROM mentions UNION ALL SELECT 'node_card', unnest(source_refs), unnest(range(1, len(source_refs) + 1)) FROM cards) GROUP BY ALL""")
def n13(spark, d):
    v = Views(spark, d)
    links = N.evidence_links(edge=(v.edges, "id", "source_refs"), domain_profile=(v.profiles, "id", "source_refs"), mention=(v.mentions, "id", "source_refs"), node_card=(v.cards, "node_id", "source_refs"))
    return links.groupBy("owner_type", "ordinal").agg(F.count("*").alias("n"), F.countDistinct("evidence_id").alias("evidence"))


@register("n14_refs_union", f"""{ctes('nodes', 'cards')} SELECT n.id, array_to_string(list_sort(list_distinct(list_concat(n.source_refs, c.source_refs))), ',') AS refs FROM nodes n JOIN cards c ON n.id = c.node_id""")
def n14(spark, d):
    v = Views(spark, d)
    j = v.nodes.select("id", F.col("source_refs").alias("a")).join(v.cards.select(F.col("node_id").alias("id"), F.col("source_refs").alias("b")), "id")
    return j.select("id", F.array_join(N.refs_union("a", "b"), ",").alias("refs"))


@register("n15_guarded_update", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND (c_custkey % 2 = 0) THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_custkey % 3 = 0 AND c_custkey % 2 <> 0 AS conflict FROM customer""")
def n15(spark, d):
    c = Views(spark, d).table("customer")
    patch = c.where("c_custkey % 3 = 0").selectExpr("c_custkey", "if(c_custkey % 2 = 0, c_mktsegment, 'stale') AS expected", "'NEW' AS value")
    return N.guarded_update(c.select("c_custkey", "c_mktsegment"), patch, "c_custkey", "c_mktsegment")


@register("s12_upsert", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'new ' || s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 8 = 4 THEN 1.5 ELSE s_acctbal END AS v FROM supplier
UNION ALL SELECT -s_suppkey - 1, 'added', 1.5 FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 8 = 4 UNION ALL SELECT -s_suppkey - 1, 'added', NULL FROM supplier WHERE s_suppkey % 8 = 0""")
def s12(spark, d):
    s = Views(spark, d).table("supplier")
    old = s.selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS v")
    new = s.where("s_suppkey % 4 = 0").selectExpr("s_suppkey AS id", "concat('new ', s_name) AS name", "if(s_suppkey % 8 = 4, 1.5D, null) AS v")
    new = new.unionByName(s.where("s_suppkey % 4 = 0").selectExpr("-s_suppkey - 1 AS id", "'added' AS name", "if(s_suppkey % 8 = 4, 1.5D, null) AS v"))
    return N.upsert(old, new, ["id"], ("v",))


@register("m1_m4_text_merge", """SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '  X ', '\\s+', ' ', 'g'))) AS norm, CASE WHEN p_name = p_type THEN p_name ELSE p_name || chr(10) || chr(10) || p_type END AS merged,
substr(sha1(p_name || '||' || p_type), 1, 12) AS suffix, lower(p_type) || ':auto-' || substr(sha1(lower(p_type) || '||' || lower(trim(p_name))), 1, 12) AS node_id FROM part""")
def m1(spark, d):
    p = Views(spark, d).table("part")
    return p.select(
        "p_partkey", X.normalize_term(F.concat(F.lit("  "), "p_name", F.lit("  X "))).alias("norm"), X.merge_text("p_name", "p_type", "p_name").alias("merged"),
        X.stable_suffix("p_name", "p_type").alias("suffix"), X.canonical_node_id(F.lower("p_type"), "p_name").alias("node_id"),
    )
