"""Entity resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.variants import add_classification
from quern.operators import resolve as M
from quern.plans.catalog import register
from quern.sources.views import Views, ctes

_FIRST = "f AS (SELECT name, kind, min(created_at) AS c FROM nodes GROUP BY ALL)"


def _rows(v: Views):
    none = F.array().cast("array<string>")
    n = v.nodes.withColumn("aliases", none).withColumn("semantic_key", F.lit("")).withColumn("embedding", F.lit(None).cast("array<double>"))
    first = n.groupBy("name", "kind").agg(F.min("created_at").alias("c"))
    n = n.join(first, ["name", "kind"]).withColumn("is_canonical", (F.col("created_at") == F.col("c")) & (F.col("kind") != "PROMO"))
    cols = ["kind", "subkind", "name", "aliases", "semantic_key", "embedding", "created_at"]
    return n.where("not is_canonical").select(F.col("id").alias("raw_id"), *cols), n.where("is_canonical").select("id", *cols)


@register("m8_resolution", f"""{ctes('nodes')}, {_FIRST}, g AS (SELECT n.*, f.c, first_value(n.id) OVER w AS fid, first_value(subkind) OVER w AS fsub FROM nodes n JOIN f USING (name, kind) WINDOW w AS (PARTITION BY name, kind ORDER BY created_at, n.id))
SELECT id AS raw_id, CASE WHEN kind <> 'PROMO' THEN fid ELSE kind || '/' || fsub || ':auto-' || substr(sha1(kind || '/' || fsub || '||' || lower(trim(name))), 1, 12) END AS canonical_id,
CASE WHEN kind = 'PROMO' AND id = fid THEN 'created' ELSE 'matched' END AS resolution FROM g WHERE NOT (created_at = c AND kind <> 'PROMO')""")
def m8(spark, d):
    staged, canonical = _rows(Views(spark, d))
    return M.resolve(staged, canonical).select("raw_id", "canonical_id", "resolution")


#: Names with known similarities: equal, one inside the other, or without a common character.
_NAMES = "CASE key % 4 WHEN 0 THEN repeat('ab', (key % 3 + 4)::INT) WHEN 1 THEN repeat('ab', 5) WHEN 2 THEN repeat('cd', 6) ELSE upper(repeat('ab', 6)) || ' ' END"


@register("m7_pair_scores", f"""{ctes('nodes', 'vectors')}, n AS (SELECT nodes.id, key, kind, 's' || key % 3 AS subkind, lower(trim({_NAMES})) AS name, CASE WHEN key % 5 < 2 THEN 'k' ELSE '' END AS sk, e FROM nodes LEFT JOIN vectors ON vectors.id = nodes.id),
p AS (SELECT x.id AS raw_id, y.id, CASE WHEN x.name = y.name THEN 1.0 WHEN contains(x.name, y.name) OR contains(y.name, x.name) THEN greatest(0.96, 2.0 * least(length(x.name), length(y.name)) / (length(x.name) + length(y.name))) ELSE 0.0 END::DOUBLE AS lexical,
  CASE WHEN x.sk = 'k' AND y.sk = 'k' THEN 1.0 ELSE 0.0 END::DOUBLE AS semantic, coalesce(CASE WHEN list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e) > 0 THEN list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) END, 0.0) AS embedding,
  x.subkind = y.subkind AS same_sub FROM n x JOIN n y ON x.kind = y.kind AND y.key = x.key + 1),
w AS (SELECT *, 0.45 * lexical + 0.35 * semantic + 0.2 * embedding AS w, lexical >= 0.98 OR semantic = 1 AS same FROM p)
SELECT raw_id, id, round(lexical, 6)::DOUBLE AS lexical, semantic, round(embedding, 6)::DOUBLE AS embedding, round(least(1.0, greatest(CASE WHEN same THEN greatest(w, 0.94) WHEN NOT same_sub THEN w * 0.85 ELSE w END,
  CASE WHEN embedding >= 0.92 AND lexical >= 0.65 THEN 0.9 ELSE w * 0.0 - 9 END)), 6)::DOUBLE AS score FROM w""")
def m7(spark, d):
    v = Views(spark, d)
    n = v.nodes.withColumn("aliases", F.array().cast("array<string>")).withColumn("subkind", F.expr("concat('s', key % 3)")).withColumn("name", F.expr(_NAMES.replace("::INT", ""))).withColumn("semantic_key", F.expr("if(key % 5 < 2, 'k', '')")).join(v.embeddings.select("id", "embedding"), "id", "left")
    pairs = n.select(F.col("id").alias("raw_id"), (F.col("key") + 1).alias("k")).join(n.select("id", F.col("key").alias("k")), "k").select("raw_id", "id")
    cols = ["kind", "subkind", "name", "aliases", "semantic_key", "embedding"]
    s = M.score_pairs(n.select(F.col("id").alias("raw_id"), *cols), n.select("id", *cols), pairs)
    return s.select("raw_id", "id", *[F.round(c, 6).alias(c) for c in ("lexical", "semantic", "embedding", "score")])


#: Names that share two thirds and differ by a hash: alike enough for an embedding to decide, never nearly equal.
_HASHED = "concat(repeat('abcdefgh', 8), md5(CAST(vec_id AS STRING)))"


@register("m8_embedding_matches", f"""WITH RECURSIVE v AS (SELECT vec_id, 'part:' || vec_id AS id, embedding::DOUBLE[] AS e, lpad(vec_id::VARCHAR, 10, '0') AS o FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.92),
s AS (SELECT vec_id, row_number() OVER (ORDER BY o) AS i, (SELECT min('part:' || b) FROM l WHERE a = vec_id AND b % 3 = 0) AS canon, coalesce((SELECT list(b) FROM l WHERE a = vec_id AND b % 3 <> 0), []) AS near FROM v WHERE vec_id % 3 <> 0),
r(i, made) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT s.i, CASE WHEN canon IS NOT NULL OR list_has_any(near, made) THEN made ELSE list_append(made, vec_id) END FROM r JOIN s ON s.i = r.i + 1)
SELECT 'part:' || vec_id AS raw_id, coalesce(canon, 'concept:auto-' || substr(sha1('concept||' || repeat('abcdefgh', 8) || md5(CASE WHEN list_contains(made, vec_id) THEN vec_id ELSE list_extract(list_intersect(made, near), 1) END::VARCHAR)), 1, 12)) AS canonical_id,
CASE WHEN canon IS NULL AND list_contains(made, vec_id) THEN 'created' ELSE 'matched' END AS resolution, CASE WHEN canon IS NULL AND list_contains(made, vec_id) THEN 0.0 ELSE 0.9 END::DOUBLE AS score
FROM s JOIN r USING (i)""")
def m8b(spark, d):
    """Names differ by hashes, so embeddings alone decide; a third of the vectors are canonical."""
    e = Views(spark, d).embeddings
    none = F.array().cast("array<string>")
    n = e.select("id", "vec_id", F.lit("concept").alias("kind"), F.lit("").alias("subkind"), F.expr(_HASHED).alias("name"), none.alias("aliases"), F.lit("").alias("semantic_key"), "embedding", F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("created_at"))
    got = M.resolve(n.where("vec_id % 3 <> 0").drop("vec_id").withColumnRenamed("id", "raw_id"), n.where("vec_id % 3 = 0").drop("vec_id"))
    return got.withColumn("score", F.round("score", 6))


@register("m9_existing_only", f"""{ctes('nodes', 'mentions')} SELECT id AS raw_id, target_id AS canonical_id, 'ok' AS outcome FROM mentions WHERE target_id IN (SELECT id FROM nodes WHERE kind <> 'PROMO')
UNION ALL SELECT id, target_id, 'unknown canonical node' FROM mentions WHERE target_id NOT IN (SELECT id FROM nodes WHERE kind <> 'PROMO')""")
def m9(spark, d):
    v = Views(spark, d)
    ok, bad = M.existing_only(v.mentions.select(F.col("id").alias("raw_id"), F.concat(F.lit(" "), "target_id").alias("existing_canonical_node_id")), v.nodes.where("kind <> 'PROMO'"))
    return ok.select("raw_id", "canonical_id", F.lit("ok").alias("outcome")).unionByName(bad.select("raw_id", "canonical_id", F.col("message").alias("outcome")))


@register("m10_merge_payloads", f"""{ctes('nodes')} SELECT x.id, CASE WHEN length(x.name) <= length(y.name) THEN x.name ELSE y.name END AS name, CASE WHEN trim(x.definition) = trim(y.definition) THEN x.definition ELSE x.definition || chr(10) || chr(10) || y.definition END AS definition,
array_to_string(CASE WHEN x.tags[1] = y.tags[1] THEN x.tags ELSE list_concat(x.tags, y.tags) END, ',') AS tags, CASE WHEN x.created_at <> '' THEN x.created_at ELSE y.created_at END AS created_at FROM nodes x JOIN nodes y ON y.key = x.key + 1""")
def m10(spark, d):
    n = Views(spark, d).nodes.withColumn("properties", F.lit('{"a": "x"}')).withColumn("scope", F.lit(""))
    cols = ["name", "kind", "subkind", "definition", "aliases", "tags", "properties", "scope", "created_at"]
    e = n.select("id", (F.col("key") + 1).alias("k"), *[F.col(c).alias(f"e_{c}") for c in cols])
    s = n.select(F.col("key").alias("k"), *[F.col(c).alias(f"s_{c}") for c in cols])
    return M.merge_payloads(e.join(s, "k")).select("id", "name", "definition", F.array_join("tags", ",").alias("tags"), "created_at")


@register("m11_subkinds", """SELECT p_brand AS subkind, CASE WHEN regexp_full_match(lower(regexp_replace(p_brand, '[\\s\\-/]+', '_', 'g')), '[a-z][a-z0-9_]*') THEN lower(p_brand) END AS subkind_code, p_brand AS raw_subkind, count(*) AS n FROM part GROUP BY ALL
UNION ALL SELECT p_type, lower(p_type), p_type, count(*) FROM part GROUP BY ALL""")
def m11(spark, d):
    p = Views(spark, d).table("part")
    both = p.select(F.col("p_brand").alias("subkind")).union(p.select("p_type"))
    return M.subkind_classes(both).groupBy("subkind", "subkind_code", "raw_subkind").agg(F.count("*").alias("n"))


@register("m13_remap_refs", f"""{ctes('nodes')}, r AS (SELECT id, unnest(source_refs) AS ref, unnest([1, 2]) AS pos FROM nodes), m AS (SELECT id, CASE WHEN substr(ref, 5)::BIGINT % 2 = 0 THEN 'canon:' || substr(ref, 5)::BIGINT % 3 ELSE ref END AS ref, pos FROM r),
f AS (SELECT id, ref, min(pos) AS pos FROM m GROUP BY ALL) SELECT id, string_agg(ref, ',' ORDER BY pos) AS refs FROM f GROUP BY id""")
def m13(spark, d):
    v = Views(spark, d)
    table = v.evidence.where("key % 2 = 0").selectExpr("id AS raw_id", "concat('canon:', key % 3) AS canonical_id")
    return M.remap_refs(v.nodes.select("id", "source_refs"), "id", "source_refs", table).select("id", F.array_join("source_refs", ",").alias("refs"))


@register("m14_merge_edges", f"""{ctes('edges', 'nodes')}, t AS (SELECT id, 'canon:' || key % 50 AS c FROM nodes WHERE kind <> 'PROMO')
SELECT 'edge:' || substr(sha1(t.c || '||' || type || '||' || to_id), 1, 12) AS id, t.c AS from_id, to_id, count(*) AS n FROM edges JOIN t ON t.id = from_id GROUP BY ALL""")
def m14(spark, d):
    v = Views(spark, d)
    table = v.nodes.where("kind <> 'PROMO'").selectExpr("id AS raw_id", "concat('canon:', key % 50) AS canonical_id")
    table = table.unionByName(v.table("supplier").selectExpr("concat('supp:', s_suppkey) AS raw_id", "concat('supp:', s_suppkey) AS canonical_id"))
    e = v.edges.select(F.col("from_id").alias("from_raw"), F.col("to_id").alias("to_raw"), "type", F.col("id").alias("raw_edge_id"))
    return M.merge_edges(e, table).groupBy("id", "from_id", "to_id").agg(F.count("*").alias("n"))


@register("m15_evidence_ids", f"{ctes('evidence')} SELECT 'evidence:auto-' || substr(sha1(source_id || '||' || evidence.id || '||' || anchor_ref || '||' || excerpt), 1, 12) AS id FROM evidence")
def m15(spark, d):
    e = Views(spark, d).evidence.selectExpr("source_id AS lesson_run_id", "id AS raw_evidence_id", "anchor_ref", "excerpt")
    return M.evidence_ids(e).select("id")


@register("m16_merge_profiles", f"""{ctes('profiles', 'evidence')}, b AS (SELECT node_id, domain, school_stages[1] AS st, source_refs[1] AS ref FROM profiles) SELECT node_id, domain, count(DISTINCT st)::INT AS n_stages,
count(DISTINCT ref) FILTER (ref IN (SELECT id FROM evidence WHERE NOT synthetic))::INT AS n_refs FROM b GROUP BY ALL""")
def m16(spark, d):
    v = Views(spark, d)
    old, new = v.profiles.where("status = 'deprecated'"), v.profiles.where("status <> 'deprecated'")
    known = v.evidence.where(F.coalesce(F.get_json_object("properties", "$.synthetic") != "true", F.lit(True)))
    return M.merge_profiles(new, old, known).select("node_id", "domain", F.size("school_stages").alias("n_stages"), F.size("source_refs").alias("n_refs"))


@register("m17_merge_mentions", f"{ctes('mentions', 'nodes')} SELECT 'mention:auto-' || substr(sha1(source_id || '||' || mentions.id || '||node||canon:' || substr(target_id, 6)), 1, 12) AS id, 'canon:' || substr(target_id, 6) AS target_id FROM mentions WHERE target_id IN (SELECT id FROM nodes WHERE kind <> 'PROMO')")
def m17(spark, d):
    v = Views(spark, d)
    table = v.nodes.where("kind <> 'PROMO'").selectExpr("id AS raw_id", "concat('canon:', key) AS canonical_id")
    m = v.mentions.selectExpr("source_id AS lesson_run_id", "id AS raw_mention_id", "target_id AS target_raw_id")
    return M.merge_mentions(m, table).select("id", "target_id")


@register("m19_resolution_stats", f"""{ctes('nodes')}, {_FIRST}, g AS (SELECT n.*, f.c, first_value(n.id) OVER (PARTITION BY name, kind ORDER BY created_at, n.id) AS fid FROM nodes n JOIN f USING (name, kind))
SELECT CASE WHEN kind = 'PROMO' AND id = fid THEN 'created' ELSE 'matched' END AS resolution, count(*) AS n FROM g WHERE NOT (created_at = c AND kind <> 'PROMO') GROUP BY 1""")
def m19(spark, d):
    staged, canonical = _rows(Views(spark, d))
    return M.resolution_stats(M.resolve(staged, canonical))


@register("m21_normalize_staged", """WITH r AS (SELECT user_id AS k, event_id AS pos, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'e' || user_id END AS raw, 'e' || user_id AS id FROM events),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1) SELECT id AS raw_node_id, CASE WHEN kind = 'click' THEN 'procedural' WHEN kind = 'view' THEN 'metacognitive' ELSE 'conceptual' END AS modes, CASE WHEN pos % 3 = 0 THEN 'universal' WHEN pos % 3 = 1 THEN 'domain-specific' ELSE 'elsewhere' END AS scope FROM f""")
def m21(spark, d):
    e = Views(spark, d).table("events").selectExpr(
        "event_id AS pos", "if(event_id % 3 = 0, ' ', concat('e', user_id)) AS raw_node_id", "concat('e', user_id) AS id", "if(event_type = 'click', 'method', 'rule') AS kind",
        "if(event_type = 'view', array('metacognitive', 'odd', 'metacognitive'), array()) AS learning_mode", "element_at(array(' universal ', ' ', 'elsewhere'), cast(event_id % 3 + 1 AS int)) AS scope",
    )
    return M.normalize_staged_nodes(e).select("raw_node_id", F.array_join("learning_mode", ",").alias("modes"), "scope")


@register("m21_staged_edges", """WITH r AS (SELECT l_orderkey || '-' || l_linenumber % 3 AS id, l_linenumber AS pos, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, l_partkey, l_suppkey) = 1)
SELECT id AS raw_edge_id, CASE l_returnflag WHEN 'R' THEN 'uses' WHEN 'A' THEN 'is_a' ELSE 'odd' END AS type, CASE WHEN l_linestatus = 'F' THEN 'undirected' ELSE 'directed' END AS directionality, CASE WHEN pos % 2 = 0 THEN 0.8 ELSE pos / 10 END::DOUBLE AS confidence,
CASE WHEN l_returnflag NOT IN ('R', 'A') THEN 'unknown type' END AS error FROM f""")
def m21b(spark, d):
    li = Views(spark, d).table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    e = li.selectExpr(
        "l_linenumber AS pos", "if(l_linenumber % 2 = 0, '', concat(l_orderkey, '-', l_linenumber % 3, ' ')) AS id", "concat(l_orderkey, '-', l_linenumber % 3) AS raw_edge_id",
        "case l_returnflag when 'R' then ' uses' when 'A' then 'is_a' else 'odd' end AS edge_type", "l_partkey AS from", "l_suppkey AS to_raw_node_id", "if(l_linestatus = 'F', 'Two-Way ', 'x') AS directionality",
        "if(l_linenumber % 2 = 0, 0.0D, l_linenumber / 10D) AS confidence",
    )
    return M.normalize_staged_edges(e).select("raw_edge_id", "type", "directionality", "confidence", "error")


@register("m21_staged_others", """SELECT 'profile' AS artefact, o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'primary' ELSE '' END AS detail, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown domain' END AS error FROM orders
UNION ALL SELECT 'evidence', doc_id::VARCHAR, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'image' END || ':b:' || md5(trim(text)), NULL FROM documents
UNION ALL SELECT 'mention', 'm' || doc_id, 'mentions:node:a1', NULL FROM labels GROUP BY doc_id UNION ALL SELECT 'card', 'part:' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'section:other:' || p_brand ELSE 's:essence:' || p_brand END, CASE WHEN p_partkey % 7 = 0 THEN 'missing id' END FROM part""")
def m21c(spark, d):
    t = Views(spark, d).table
    p = t("orders").selectExpr("concat(o_orderkey, ' ') AS raw_profile_id", "'n' AS node_id", "if(o_orderkey % 5 = 0, 'none', 'physics') AS domain", "if(o_orderkey % 2 = 0, array('primary', 'odd', ' primary'), array()) AS school_stages")
    e = t("documents").selectExpr("cast(doc_id AS string) AS id", "text AS excerpt", "if(doc_id % 2 = 0, '', 'image') AS modality")
    m = t("labels").selectExpr("0 AS pos", "concat('m', doc_id) AS id").distinct()
    c = t("part").selectExpr("if(p_partkey % 7 = 0, ' ', 'c') AS id", "concat('part:', p_partkey) AS node_id", "array(named_struct('id', if(p_partkey % 2 = 0, '', 's'), 'title', '', 'section_type', if(p_partkey % 2 = 0, '', 'essence'), 'content', array(' ', concat(p_brand, ' ')), 'source_refs', array('a', 'a'))) AS sections")
    s = F.element_at("sections", 1)
    return (
        M.normalize_staged_profiles(p).select(F.lit("profile").alias("artefact"), F.col("raw_profile_id").alias("id"), F.array_join("school_stages", ",").alias("detail"), "error")
        .unionByName(M.normalize_staged_evidence(e, "b", "a1").select(F.lit("evidence").alias("artefact"), F.col("raw_evidence_id").alias("id"), F.concat_ws(":", "modality", "source_id", F.md5("excerpt")).alias("detail"), "error"))
        .unionByName(M.normalize_staged_mentions(m, "b", "a1").select(F.lit("mention").alias("artefact"), F.col("raw_mention_id").alias("id"), F.concat_ws(":", "role", "target_type", "anchor_ref").alias("detail"), "error"))
        .unionByName(M.normalize_staged_cards(c).select(F.lit("card").alias("artefact"), F.col("raw_node_id").alias("id"), F.concat_ws(":", s["id"], s["section_type"], F.array_join(s["content"], ",")).alias("detail"), "error"))
    )


@register("m17_merged_cards", f"""{ctes('cards')}, k AS (SELECT node_id, 'card:' || key AS card, source_refs, key, d FROM cards WHERE key % 3 <> 0), x AS (SELECT 'node_card' AS owner_type, card AS owner_id, source_refs[1] AS ref FROM k
UNION ALL SELECT 'node_card_section', card || ':' || CASE WHEN s.id = '' THEN 'section-' || i ELSE s.id END, s.source_refs[1] FROM k JOIN sections s USING (node_id) WHERE len(s.source_refs) > 0)
SELECT owner_type, owner_id, CASE WHEN substr(ref, 5)::BIGINT % 2 = 0 THEN 'canon:' || ref ELSE ref END AS evidence_id, 1 AS ordinal FROM x""")
def m17b(spark, d):
    v = Views(spark, d)
    cards = v.cards.selectExpr("concat('card:', substr(node_id, 6)) AS raw_card_id", "node_id AS raw_node_id", "'' AS title", "summary", "source_refs", "sections")
    table = v.nodes.where("key % 3 <> 0").selectExpr("id AS raw_id", "concat('n:', id) AS canonical_id")
    known = v.evidence.where("key % 2 = 0").selectExpr("id AS raw_id", "concat('canon:', id) AS canonical_id")
    return M.merge_cards(cards, table, known)[1]


@register("m22_repaired_mentions", f"""{ctes('nodes', 'cards', 'mentions', 'evidence')}, r AS (SELECT id AS n, unnest(source_refs) AS ref, unnest([0, 1]) AS pos FROM nodes UNION ALL SELECT node_id, unnest(source_refs), 9 FROM cards),
f AS (SELECT n, ref, min(pos) AS pos FROM r WHERE ref IN (SELECT id FROM evidence) GROUP BY ALL) SELECT 'mention:auto:' || n AS id, n AS target_id, string_agg(ref, ',' ORDER BY pos, ref) AS refs FROM f WHERE n NOT IN (SELECT target_id FROM mentions) AND n IN (SELECT id FROM nodes) GROUP BY n""")
def m22(spark, d):
    v = Views(spark, d)
    n = v.nodes.select(F.col("id").alias("raw_id"), "source_refs")
    refs = n.select("raw_id", F.posexplode("source_refs").alias("pos", "ref")).unionByName(v.cards.select(F.col("node_id").alias("raw_id"), F.lit(9).alias("pos"), F.explode("source_refs").alias("ref")))
    _, new = M.repair_mentions(n, refs, v.mentions, v.evidence)
    return new.select("id", "target_id", F.array_join("source_refs", ",").alias("refs"))


@register("m24_strict_bundle", """WITH e AS (SELECT l_partkey AS a, l_suppkey AS b, CASE l_returnflag WHEN 'R' THEN 'uses' WHEN 'A' THEN 'is_a' ELSE 'odd' END AS t, l_linestatus AS s FROM lineitem)
SELECT a, b, t AS type, s AS anchor FROM e WHERE t <> 'odd' AND s = 'F' AND a IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO') GROUP BY ALL""")
def m24(spark, d):
    t = Views(spark, d).table
    e = t("lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id", "l_partkey AS from_id", "l_suppkey + 10000000 AS to_id", "case l_returnflag when 'R' then 'uses' when 'A' then 'is_a' else 'odd' end AS type", "l_linestatus AS anchor")
    n = t("part").where("p_type <> 'PROMO'").selectExpr("p_partkey AS id").union(t("supplier").selectExpr("s_suppkey + 10000000 AS id"))
    a = spark.createDataFrame([("F",)], "anchor string")
    return M.strict_bundle(e, n, a).select(F.col("from_id").alias("a"), (F.col("to_id") - 10000000).alias("b"), "type", "anchor")


_LABEL = "CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END"


@register("m12_classifications", f"""WITH s AS (SELECT p_partkey, {_LABEL} AS label, CASE WHEN p_partkey % 3 <> 0 THEN lower(p_type) END AS code FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '{{"classifications":{{"raw_subkinds":["' || label || '"],"subkinds":["a","b"' || coalesce(',"' || code || '"', '') || '],"x":1}},"y":[2,null]}}'
  ELSE '{{"classifications":{{"raw_subkinds":["' || label || '"]' || coalesce(',"subkinds":["' || code || '"]', '') || '}}}}' END AS properties FROM s""")
def m12(spark, d):
    held = "CASE p_partkey % 4 WHEN 0 THEN '{\"y\":[2,null],\"classifications\":{\"subkinds\":[\"a\",\" b \",\"a\"],\"x\":1}}' WHEN 1 THEN 'bad' WHEN 2 THEN '{}' END AS held"
    p = Views(spark, d).table("part").selectExpr("p_partkey", held, f"{_LABEL} AS label")
    return p.select("p_partkey", add_classification("held", "label").alias("properties"))


@register("m25_artifacts", f"""{ctes('nodes', 'mentions', 'evidence', 'cards')}, e AS (SELECT target_id AS n, count(*) AS k FROM mentions JOIN evidence ev ON ev.id = mentions.source_refs[1] GROUP BY 1)
SELECT id, coalesce(k, 0) AS n_evidence, id IN (SELECT node_id FROM cards) AS has_card FROM nodes LEFT JOIN e ON n = id""")
def m25(spark, d):
    v = Views(spark, d)
    ev = v.mentions.select(F.col("target_id").alias("node_id"), F.explode("source_refs").alias("id")).join(v.evidence.select("id", "excerpt"), "id")
    return M.assemble_artifacts(v.nodes, ev, v.cards).select("id", "n_evidence", "has_card")


@register("m26_drop_evidence", f"{ctes('nodes', 'evidence')} SELECT id, array_to_string(list_filter(source_refs, lambda r: r NOT IN (SELECT e.id FROM evidence e WHERE e.modality = 'image')), ',') AS refs FROM nodes".replace("r NOT IN (SELECT e.id FROM evidence e WHERE e.modality = 'image')", "substr(r, 5)::BIGINT % 10 <> 0"))
def m26(spark, d):
    v = Views(spark, d)
    return M.drop_evidence(v.nodes.select("id", "source_refs"), "id", v.evidence.where("modality = 'image'")).select("id", F.array_join("source_refs", ",").alias("refs"))


@register("m27_m28_decisions", "SELECT p_type AS subject, CASE p_type WHEN 'PROMO' THEN 'physics' WHEN 'SMALL' THEN 'math' ELSE 'general' END AS template, sha256(p_type || chr(10) || p_brand) AS key, p_type IN ('SMALL') AS kept, count(*) AS n FROM part GROUP BY ALL")
def m27(spark, d):
    p = Views(spark, d).table("part").select(F.col("p_type").alias("subject"), "p_brand")
    t = spark.createDataFrame([("PROMO", "physics"), ("SMALL", "math")], "subject string, template string")
    label = F.when(F.col("subject") == "SMALL", "relevant").otherwise("decorative")
    return M.with_template(p, t, "general").groupBy("subject", "template", M.cache_key("subject", "p_brand").alias("key"), M.keep_image(label).alias("kept")).agg(F.count("*").alias("n"))


