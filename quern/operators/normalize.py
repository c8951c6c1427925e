"""Normalisation, deduplication and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X
from quern.functions.similarity import merge_json_list_udf


def active(df: DataFrame) -> DataFrame:
    """Rows that are not deprecated; a null status counts as active."""
    return df.where(~F.col("status").eqNullSafe("deprecated"))


def edge_duplicates(edges: DataFrame) -> DataFrame:
    """Active edges by (from, to, type), the earliest kept; returns the rows to deprecate with the id that stays.

    The kept row is an aggregate joined back, so a pair that a third of all edges share is no hot window; only groups with
    repeats are joined, usually a small side.
    """
    e = active(edges).withColumn("key", F.struct("created_at", "id"))
    kept = e.groupBy("from_id", "to_id", "type").agg(F.min("key").alias("kept"), F.count("*").alias("n")).where("n > 1")
    j = e.join(kept, ["from_id", "to_id", "type"])
    return j.where(F.col("id") != F.col("kept.id")).select("id", F.col("kept.id").alias("kept_id"))


def undirected_edge_duplicates(edges: DataFrame) -> DataFrame:
    """Duplicates by type, directionality and endpoints, those of undirected edges in either order, with the id that stays.

    The earliest edge is kept; an aggregate joined back as in N1, so no pair is a hot window.
    """
    un = F.col("directionality") == "undirected"
    a = F.when(un, F.least("from_id", "to_id")).otherwise(F.col("from_id"))
    b = F.when(un, F.greatest("from_id", "to_id")).otherwise(F.col("to_id"))
    keys = ["type", "directionality", "a", "b"]
    e = edges.where("status <> 'deprecated'").select("type", "directionality", a.alias("a"), b.alias("b"), F.struct("created_at", "id").alias("key"))
    j = e.join(e.groupBy(*keys).agg(F.min("key").alias("kept"), F.count("*").alias("n")).where("n > 1"), keys)
    return j.where(F.col("key.id") != F.col("kept.id")).select("key.id", F.col("kept.id").alias("kept_id"))


def self_loops(edges: DataFrame) -> DataFrame:
    """Active edges from a node to itself."""
    return edges.where("status <> 'deprecated' AND from_id = to_id")


def duplicate_groups(nodes: DataFrame) -> DataFrame:
    """Groups of active nodes with one lower-case name and kind; ids by (created_at, id)."""
    g = nodes.where("status = 'active'").groupBy(F.lower("name").alias("normalized_name"), "kind")
    out = g.agg(F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("ids")).where(F.size("ids") > 1)
    return out.select("normalized_name", "kind", F.col("ids.id").alias("ids"))


def canonical_score() -> Column:
    """10 for a valid subkind, 5 more if specific, 3 for a plain ASCII id, 1 for an embedding."""
    code = X.subkind_code("subkind")
    return (
        F.when(code.isNotNull(), 10).otherwise(0) + F.when(code.isNotNull() & ~code.isin(*S.GENERIC_SUBKINDS), 5).otherwise(0)
        + F.when(F.col("id").rlike("^[a-z0-9/_:-]+$"), 3).otherwise(0) + F.when(F.col("has_embedding"), 1).otherwise(0)
    )


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """Per duplicate group the canonical node; needs has_embedding. One partial aggregate, no window."""
    n = nodes.where("status = 'active'").withColumn("score", canonical_score())
    g = n.groupBy(F.lower("name").alias("normalized_name"), "kind").agg(F.min(F.struct((-F.col("score")).alias("neg"), "created_at", "id")).alias("b"), F.count("*").alias("n"))
    return g.where("n > 1").select("normalized_name", "kind", F.col("b.id").alias("canonical_id"), (-F.col("b.neg")).alias("score"), "n")


def remap_table(nodes: DataFrame) -> DataFrame:
    """Duplicate id -> canonical id for all groups."""
    c = canonical_nodes(nodes).select("normalized_name", "kind", "canonical_id")
    n = nodes.where("status = 'active'").withColumn("normalized_name", F.lower("name"))
    return n.join(c, ["normalized_name", "kind"]).where("id <> canonical_id").select(F.col("id").alias("duplicate_id"), "canonical_id")


def merge_groups(nodes: DataFrame) -> DataFrame:
    """One row per duplicate group: united aliases, tags and references in (canonical first, created_at, id) order, merged_from."""
    c = canonical_nodes(nodes).select("normalized_name", "kind", "canonical_id")
    n = nodes.where("status = 'active'").withColumn("normalized_name", F.lower("name")).join(c, ["normalized_name", "kind"])
    row = F.struct((F.col("id") != F.col("canonical_id")).alias("later"), "created_at", "id", "definition", "aliases", "tags", "source_refs")
    g = n.groupBy("canonical_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    col = lambda c: F.flatten(F.transform("rows", lambda r: r[c]))
    return g.select(
        "canonical_id", X.unique_strings(col("aliases")).alias("aliases"), X.unique_strings(col("tags")).alias("tags"), X.unique_strings(col("source_refs")).alias("source_refs"),
        F.array_join(X.unique_strings(F.transform("rows", lambda r: r["definition"])), "\n\n").alias("definition"),
        F.transform(F.filter("rows", lambda r: r["later"]), lambda r: r["id"]).alias("merged_from"),
    )


def remap(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``column`` through (duplicate_id, canonical_id); unknown ids stay."""
    t = table.select(F.col("duplicate_id").alias(column), "canonical_id")
    return df.join(t, column, "left").withColumn(column, F.coalesce("canonical_id", column)).drop("canonical_id")


def profile_id(node: str | Column, domain: str | Column) -> Column:
    return F.concat(F.lit("profile:"), X.stable_suffix(node, domain))


def profile_groups(profiles: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Active profiles of one (node, domain) merged in (created_at, id) order; only groups that need it."""
    row = F.struct("created_at", "id", "school_stages", "curriculum_roles", "source_refs")
    g = active(profiles).groupBy("node_id", "domain").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min("created_at").alias("created_at"))
    g = g.withColumn("canonical_profile_id", profile_id("node_id", "domain"))
    col = lambda c: X.unique_strings(F.flatten(F.transform("rows", lambda r: r[c])))
    other = F.filter("rows", lambda r: r["id"] != F.col("canonical_profile_id"))
    g = g.where((F.size("rows") > 1) | (F.size(other) > 0))
    out = g.select(
        "node_id", "domain", "canonical_profile_id",
        F.when(F.size(other) < F.size("rows"), F.col("canonical_profile_id")).otherwise(F.element_at("rows", 1)["id"]).alias("primary_id"),
        F.transform(other, lambda r: r["id"]).alias("duplicate_ids"), col("school_stages").alias("school_stages"), col("curriculum_roles").alias("curriculum_roles"),
        col("source_refs").alias("source_refs"), "created_at",
    )
    if evidence is None:
        return out
    ref = out.select("canonical_profile_id", F.posexplode("source_refs").alias("pos", "ref")).join(evidence.select(F.col("id").alias("ref")), "ref", "left_semi")
    ref = ref.groupBy("canonical_profile_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref")))["ref"].alias("kept"))
    out = out.join(ref, "canonical_profile_id", "left")
    return out.withColumn("source_refs", F.coalesce("kept", F.array().cast("array<string>"))).drop("kept")


def merge_profile_properties(profiles: DataFrame) -> DataFrame:
    """N8, properties: the JSON objects of all active rows of a (node, domain) merged in (created_at, id) order."""
    rows = F.array_sort(F.collect_list(F.struct("created_at", "id", "properties")))
    return active(profiles).groupBy("node_id", "domain").agg(merge_json_list_udf(rows["properties"]).alias("properties"))


def merge_group_cards(cards: DataFrame, remap: DataFrame) -> DataFrame:
    """N6, cards of a duplicate group as one of the canonical node, in (created_at, node_id) order.

    The id, title and time are those of the canonical node's own card, else of the first; summaries and references are united,
    sections with one id become one: the first filled title, united content and references. Sections without an id are
    numbered. cards: node_id, id, title, summary, source_refs, sections, created_at; ``remap``: duplicate_id, canonical_id.
    """
    c = _canonical(cards, remap)
    own = F.struct((F.col("node_id") != F.col("canonical_id")).alias("other"), "created_at", "node_id", "id", "title")
    rows = F.array_sort(F.collect_list(F.struct("created_at", "node_id", "summary", "source_refs")))
    g = c.groupBy("canonical_id").agg(F.min(own).alias("own"), rows.alias("rows"))
    s = c.select("canonical_id", "created_at", "node_id", F.posexplode("sections").alias("pos", "s"))
    s = s.select("canonical_id", F.struct("created_at", "node_id", "pos").alias("at"), "s.*").withColumn("id", F.trim(F.coalesce("id", F.lit(""))))
    first = F.min("at").over(Window.partitionBy("canonical_id", "id"))
    new = F.sum(((F.col("at") == first) | (F.col("id") == "")).cast("int")).over(Window.partitionBy("canonical_id").orderBy("at"))
    s = s.withColumn("id", F.when(F.col("id") == "", F.concat(F.lit("section-"), new)).otherwise(F.col("id")))
    parts = F.array_sort(F.collect_list(F.struct("at", "title", "section_type", "content", "source_refs")))
    s = s.groupBy("canonical_id", "id").agg(F.min("at").alias("at"), parts.alias("p"))
    filled = lambda c: F.coalesce(F.try_element_at(F.filter(F.transform("p", lambda r: r[c]), lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(1)), F.lit(""))
    united = lambda c: X.unique_strings(F.flatten(F.transform("p", lambda r: r[c])))
    one = F.struct("at", "id", filled("title").alias("title"), F.element_at("p", 1)["section_type"].alias("section_type"), united("content").alias("content"), united("source_refs").alias("source_refs"))
    s = s.select("canonical_id", one.alias("s")).groupBy("canonical_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    s = s.select("canonical_id", F.transform("s", lambda r: r.dropFields("at")).alias("sections"))
    text = F.array_join(X.unique_strings(F.transform("rows", lambda r: r["summary"])), "\n\n")
    refs = X.unique_strings(F.flatten(F.transform("rows", lambda r: r["source_refs"])))
    g = g.select(F.col("canonical_id"), F.col("own.id").alias("id"), F.col("own.title").alias("title"), text.alias("summary"), refs.alias("source_refs"), F.col("own.created_at").alias("created_at"))
    return g.join(s, "canonical_id", "left").withColumnRenamed("canonical_id", "node_id")


def _canonical(df: DataFrame, remap: DataFrame) -> DataFrame:
    """``df`` (node_id, ...) with canonical_id, only of nodes in groups of duplicates."""
    ids = remap.select(F.col("duplicate_id").alias("node_id"), "canonical_id").union(remap.select("canonical_id", "canonical_id")).distinct()
    return df.join(ids, "node_id")


#: The provenance of a merged body, the preferred one first.
PROVENANCE = ("manual", "model_generation", "card_expansion", "imported_unit")


def merge_group_bodies(bodies: DataFrame, remap: DataFrame) -> DataFrame:
    """N6, bodies of a duplicate group as one of the canonical node, in (created_at, node_id) order, by preferred provenance.

    bodies: node_id, content, media_refs, source_refs, generated_from, created_at.
    """
    c = _canonical(bodies, remap)
    rank = F.coalesce(*[F.when(F.col("generated_from") == p, F.lit(i)) for i, p in enumerate(PROVENANCE)], F.lit(1))
    own = F.min(F.struct((F.col("node_id") != F.col("canonical_id")).alias("other"), "created_at", "node_id"))
    rows = F.array_sort(F.collect_list(F.struct("created_at", "node_id", "content", "media_refs", "source_refs")))
    g = c.groupBy("canonical_id").agg(own.alias("own"), rows.alias("rows"), F.min(rank).alias("rank"))
    united = lambda k: X.unique_strings(F.flatten(F.transform("rows", lambda r: r[k])))
    text = F.array_join(X.unique_strings(F.transform("rows", lambda r: r["content"])), "\n\n")
    kind = F.element_at(F.array(*[F.lit(p) for p in PROVENANCE]), F.col("rank") + 1)
    return g.select(F.col("canonical_id").alias("node_id"), text.alias("content"), united("media_refs").alias("media_refs"), united("source_refs").alias("source_refs"), kind.alias("generated_from"), F.col("own.created_at").alias("created_at"))


def card_sections(cards: DataFrame) -> DataFrame:
    """Defaults for section id, title and type, trimmed content without empty lines, and whether anything changed."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""

    def fix(s, i):
        sid = F.when(blank(s["id"]), F.concat(F.lit("section-"), i)).otherwise(s["id"])
        return F.struct(
            sid.alias("id"), F.when(blank(s["title"]), sid).otherwise(s["title"]).alias("title"), F.when(blank(s["section_type"]), F.lit("other")).otherwise(s["section_type"]).alias("section_type"),
            F.filter(F.transform(s["content"], lambda x: F.trim(x)), lambda x: x != "").alias("content"), s["source_refs"].alias("source_refs"),
        )

    fixed = F.transform("sections", fix)
    return cards.select("node_id", fixed.alias("sections"), (~fixed.eqNullSafe(F.col("sections"))).alias("modified"))


def node_terms(nodes: DataFrame) -> DataFrame:
    """node_id, term, term_norm, term_type of names, aliases and tags; the first of equal normal forms per type stays."""
    none = F.array().cast("array<string>")
    terms = F.concat(
        F.array(F.struct(F.col("name").alias("term"), F.lit("canonical").alias("term_type"))),
        F.transform(F.coalesce("aliases", none), lambda t: F.struct(t.alias("term"), F.lit("alias").alias("term_type"))),
        F.transform(F.coalesce("tags", none), lambda t: F.struct(t.alias("term"), F.lit("tag").alias("term_type"))),
    )
    t = active(nodes).where(F.coalesce("id", F.lit("")) != "").select(F.col("id").alias("node_id"), F.posexplode(terms).alias("pos", "t"))
    t = t.select("node_id", "pos", "t.term", "t.term_type", X.normalize_term("t.term").alias("term_norm")).where(F.coalesce("term_norm", F.lit("")) != "")
    first = t.groupBy("node_id", "term_type", "term_norm").agg(F.min(F.struct("pos", "term")).alias("f"))
    return first.select("node_id", F.col("f.term").alias("term"), "term_norm", "term_type")


def normalize_summary(edges: DataFrame, profiles: DataFrame, cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of what a normalisation run changes: one row."""
    parts = [
        ("duplicate_edges", edge_duplicates(edges)), ("profile_groups", profile_groups(profiles)), ("modified_cards", card_sections(cards).where("modified")),
        ("terms", node_terms(nodes)),
    ]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def distinct_values(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Distinct values of one column over several tables, null left out."""
    out = None
    for df, c in columns:
        one = df.select(F.col(c).alias("value")).where(F.col(c).isNotNull()).distinct()
        out = one if out is None else out.union(one)
    return out.distinct()


def evidence_links(**owners: tuple[DataFrame, str, str]) -> DataFrame:
    """UNION ALL of (owner_type, owner_id, evidence_id, ordinal from 1) over tables with arrays of references."""
    out = None
    for kind, (df, key, refs) in owners.items():
        one = df.select(F.lit(kind).alias("owner_type"), F.col(key).alias("owner_id"), F.posexplode(refs).alias("pos", "evidence_id"))
        one = one.select("owner_type", "owner_id", "evidence_id", (F.col("pos") + 1).alias("ordinal"))
        out = one if out is None else out.unionByName(one)
    return out


def refs_union(a: str | Column, b: str | Column) -> Column:
    """Sorted distinct union of two reference arrays."""
    return F.array_sort(F.array_union(X.col(a), X.col(b)))


def guarded_update(current: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """Patch rows (key, expected, value) apply where the current value still is the expected one (null-safe); a conflict flag."""
    j = current.join(patch, key, "left")
    ok = F.col("value").isNotNull() & F.col(column).eqNullSafe(F.col("expected"))
    return j.select(key, F.when(ok, F.col("value")).otherwise(F.col(column)).alias(column), (F.col("value").isNotNull() & ~ok).alias("conflict"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: tuple[str, ...] = (), do_nothing: bool = False) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; ``do_nothing`` keeps the old ones (evidence)."""
    if do_nothing:
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
    if keep_old_if_null:
        was = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep_old_if_null])
        new = new.join(was, keys, "left")
        new = new.select(*[F.coalesce(c, f"_{c}").alias(c) if c in keep_old_if_null else F.col(c) for c in old.columns])
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
