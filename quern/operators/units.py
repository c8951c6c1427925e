"""Joins and unit assembly (J1-J23, A11): evidence closure, nested units, fragments, media, completeness. Batch forms for all nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.filters import hidden_image
from quern.operators.normalize import active

_NONE = "array()"


def reference_pairs(mentions: DataFrame, profiles: DataFrame, edges: DataFrame, cards: DataFrame, bodies: DataFrame) -> DataFrame:
    """(node_id, evidence_id) of every reference a node has, with repeats: mentions, profiles, edges at either end, card, card sections, body."""
    one = lambda df, key, refs: df.select(F.col(key).alias("node_id"), F.explode(refs).alias("evidence_id"))
    act = active(edges)
    parts = [
        one(mentions, "target_id", "source_refs"), one(active(profiles), "node_id", "source_refs"), one(act, "from_id", "source_refs"), one(act, "to_id", "source_refs"),
        one(cards, "node_id", "source_refs"), one(cards, "node_id", F.flatten(F.transform("sections", lambda s: s["source_refs"]))), one(bodies, "node_id", "source_refs"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def evidence_closure(nodes: DataFrame, evidence: DataFrame, mentions: DataFrame, by_place: bool = True, **owners: DataFrame) -> DataFrame:
    """(node_id, evidence_id) by reference, and by the (source, anchor) of the node's mentions.

    The OR is two equi-joins and a distinct union. ``by_place=False`` leaves the second out: its result is all evidence of
    a place for every node mentioned there, which grows with their product where places are large.
    """
    ids = nodes.select(F.col("id").alias("node_id"))
    # Distinct after the join: it deals by node, and the distinct rows are found where they lie.
    refs = reference_pairs(mentions, **owners).join(ids, "node_id", "left_semi").distinct()
    out = refs.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").select("node_id", "evidence_id")
    if by_place:
        places = mentions.select(F.col("target_id").alias("node_id"), "source_id", "anchor_ref").distinct().join(ids, "node_id", "left_semi")
        near = places.join(evidence.select(F.col("id").alias("evidence_id"), "source_id", "anchor_ref"), ["source_id", "anchor_ref"]).select("node_id", "evidence_id")
        out = out.union(near).distinct()
    return out


def nested(df: DataFrame, key: str, name: str, order: list[str], fields: list[str]) -> DataFrame:
    """Children of each key as one array of structs, in order."""
    row = F.struct(*order, *[f for f in fields if f not in order])
    return df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias(name))


def _children(edges: DataFrame, profiles: DataFrame, mentions: DataFrame, closure: DataFrame, evidence: DataFrame) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """The child tables of J2 by name: rows with the node's id, the columns of their order, more columns."""
    act = active(edges)
    ev = closure.join(evidence.where(~hidden_image()).select(F.col("id").alias("evidence_id"), "source_id", "anchor_ref", "excerpt"), "evidence_id")
    return {
        "outgoing": (act.select(F.col("from_id").alias("id"), "type", F.col("id").alias("edge_id"), "to_id"), ["type", "edge_id"], ["to_id"]),
        "incoming": (act.select(F.col("to_id").alias("id"), "type", F.col("id").alias("edge_id"), "from_id"), ["type", "edge_id"], ["from_id"]),
        "profiles": (active(profiles).select(F.col("node_id").alias("id"), "domain", F.col("id").alias("profile_id")), ["domain", "profile_id"], []),
        "mentions": (mentions.select(F.col("target_id").alias("id"), F.col("id").alias("mention_id"), "role"), ["mention_id"], ["role"]),
        "evidence": (ev.withColumnRenamed("node_id", "id"), ["source_id", "anchor_ref", "evidence_id"], ["excerpt"]),
    }


def _with_parts(nodes: DataFrame, parts: list[DataFrame], cards: DataFrame, bodies: DataFrame) -> DataFrame:
    parts = [*parts, cards.select(F.col("node_id").alias("id"), F.struct("summary", "sections").alias("card")), bodies.where(F.trim("content") != "").select(F.col("node_id").alias("id"), F.col("content").alias("body"))]
    out = nodes
    for p in parts:
        out = out.join(p, "id", "left")
    return out


def units(nodes: DataFrame, edges: DataFrame, profiles: DataFrame, mentions: DataFrame, closure: DataFrame, evidence: DataFrame, cards: DataFrame, bodies: DataFrame) -> DataFrame:
    """One nested row per node: outgoing and incoming edges, profiles, mentions, evidence, card, body. One join per child table.

    Every node carries the whole text of each evidence row it refers to, so all units together grow with references times
    texts; for counts and first children of all nodes there is ``unit_counts``.
    """
    parts = [nested(rows, "id", name, order, fields) for name, (rows, order, fields) in _children(edges, profiles, mentions, closure, evidence).items()]
    return _with_parts(nodes, parts, cards, bodies)


def unit_counts(nodes: DataFrame, edges: DataFrame, profiles: DataFrame, mentions: DataFrame, closure: DataFrame, evidence: DataFrame, cards: DataFrame, bodies: DataFrame) -> DataFrame:
    """J2 without the lists: per node and child table n_<name> (0 if it has none) and first_<name> (the first child's place in the order), card, body.

    The children are those of ``units``; they are counted as they are read, never gathered, and no text is moved.
    """
    children = _children(edges, profiles, mentions, closure, evidence)
    parts = [rows.groupBy("id").agg(F.count("*").alias(f"n_{name}"), F.min(F.struct(*order)).alias(f"first_{name}")) for name, (rows, order, _) in children.items()]
    return _with_parts(nodes, parts, cards, bodies).withColumns({f"n_{name}": F.coalesce(f"n_{name}", F.lit(0)) for name in children})


def neighbour_edges(edges: DataFrame, of: str) -> DataFrame:
    """A node's active edges with direction and other end, by type."""
    a = active(edges)
    out = a.where(F.col("from_id") == of).select(F.lit("outgoing").alias("direction"), "type", "id", F.col("to_id").alias("other"))
    return out.union(a.where(F.col("to_id") == of).select(F.lit("incoming"), "type", "id", F.col("from_id"))).orderBy("direction", "type", "id")


def mention_evidence(mentions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(mention_id, evidence_id) by reference or by equal (source, anchor): two equi-joins, distinct union."""
    e = evidence.select(F.col("id").alias("evidence_id"), "source_id", "anchor_ref")
    by_ref = mentions.select(F.col("id").alias("mention_id"), F.explode("source_refs").alias("evidence_id")).join(e.select("evidence_id"), "evidence_id", "left_semi").select("mention_id", "evidence_id")
    by_place = mentions.select(F.col("id").alias("mention_id"), "source_id", "anchor_ref").join(e, ["source_id", "anchor_ref"]).select("mention_id", "evidence_id")
    return by_ref.union(by_place).distinct()


def page_hits(evidence: DataFrame, page: int) -> DataFrame:
    """Evidence whose page interval holds the page; an open end is the start."""
    return evidence.where((F.col("page_start") <= page) & (F.lit(page) <= F.coalesce("page_end", "page_start")))


def related_units(evidence: DataFrame, mentions: DataFrame, cards: DataFrame, source: str, page: int) -> DataFrame:
    """Per node mentioned with evidence of a page: evidence ids (sorted), role count, card summary."""
    hit = page_hits(evidence.where(F.col("source_id") == source), page).select(F.col("id").alias("ref"))
    m = mentions.select("target_id", "role", F.explode("source_refs").alias("ref")).join(hit, "ref")
    g = m.groupBy(F.col("target_id").alias("node_id")).agg(F.array_sort(F.collect_set("ref")).alias("evidence_ids"), F.countDistinct("role").alias("n_roles"))
    return g.join(cards.select("node_id", "summary"), "node_id", "left")


def job_list(jobs: DataFrame, stages: DataFrame, outlines: DataFrame, limit: int) -> DataFrame:
    """Jobs with stage label and title (outline title, else book title, else book id), newest first, top-k."""
    title = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("outline_title", "book_title")], F.col("book_id").cast("string"))
    j = jobs.join(stages, "stage_id", "left").join(outlines, "book_id", "left")
    return j.select("job_id", "status", F.coalesce("stage_label", F.lit("")).alias("stage"), title.alias("title"), "updated_at").orderBy(F.desc("updated_at"), "job_id").limit(limit)


def job_status(events: DataFrame) -> DataFrame:
    """Per job its current stage: a running one, else the last blocked, else the last event; with counts."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "blocked", 1).otherwise(2)
    g = events.groupBy("job_id").agg(
        F.min(F.struct(rank.alias("r"), (-F.col("seq")).alias("s"), "stage", "status")).alias("b"), F.count("*").alias("n_events"), F.count_if(F.col("status") == "blocked").alias("n_blocked")
    )
    return g.select("job_id", F.col("b.stage").alias("current_stage"), F.col("b.status").alias("status"), "n_events", "n_blocked")


def bundle_by_book(mentions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts of mentions and evidence per book, a book of either side counts."""
    m = mentions.groupBy("source_id").agg(F.count("*").alias("mentions"))
    e = evidence.groupBy("source_id").agg(F.count("*").alias("evidence"))
    j = m.join(e, "source_id", "full_outer")
    return j.select("source_id", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


def fragments(pairs: DataFrame, evidence: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Per node, source and anchor: the outline's markdown lines if there is a span (markdown, md_start, md_end), else the excerpts.

    Excerpts come in id order; image excerpts stay out of the text.
    """
    e = pairs.join(evidence.select(F.col("id").alias("evidence_id"), "source_id", "anchor_ref", "excerpt", "modality"), "evidence_id")
    g = e.groupBy("node_id", "source_id", "anchor_ref").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "modality", "excerpt"))).alias("items"))
    plain = F.array_join(F.transform(F.filter("items", lambda i: (i["modality"] != "image") & (i["excerpt"] != "")), lambda i: i["excerpt"]), "\n\n")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("items", lambda i: i["modality"]))), ",")
    g = g.select("node_id", "source_id", "anchor_ref", plain.alias("text"), kinds.alias("modalities"), F.size("items").alias("n_excerpts"))
    if spans is None:
        return g.withColumn("source_kind", F.lit("evidence_excerpt"))
    j = g.join(spans, ["source_id", "anchor_ref"], "left")
    ok = (F.col("md_start") > 0) & (F.col("md_end") >= F.col("md_start"))
    cut = F.trim(F.array_join(F.slice(F.split("markdown", "\n"), F.col("md_start"), F.col("md_end") - F.col("md_start") + 1), "\n"))
    cut = F.when(ok & (cut != ""), cut)
    return j.select("node_id", "source_id", "anchor_ref", F.coalesce(cut, "text").alias("text"), "modalities", "n_excerpts", F.when(cut.isNotNull(), "outline_markdown").otherwise("evidence_excerpt").alias("source_kind"))


def media(evidence: DataFrame) -> DataFrame:
    """Visible images with a caption (first filled of caption, locator, excerpt), one per path."""
    cap = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in ("caption", "locator", "excerpt")], F.lit(""))
    m = evidence.where((F.col("modality") == "image") & ~hidden_image()).withColumn("cap", cap)
    return m.groupBy("path").agg(F.min(F.struct("id", "cap")).alias("m")).select("path", F.col("m.id").alias("evidence_id"), F.col("m.cap").alias("caption"))


def nodes_for_bodies(nodes: DataFrame, mentions: DataFrame, evidence: DataFrame, bodies: DataFrame, source: str | None = None, overwrite: bool = False) -> DataFrame:
    """Active nodes with evidence of the book, without a filled body unless ``overwrite``."""
    e = evidence if source is None else evidence.where(F.col("source_id") == source)
    m = mentions.select(F.col("target_id").alias("id"), F.explode("source_refs").alias("ref")).join(e.select(F.col("id").alias("ref")), "ref", "left_semi")
    n = nodes.where("status <> 'deprecated'").join(m.select("id").distinct(), "id", "left_semi")
    return n if overwrite else n.join(bodies.where(F.trim("content") != "").select(F.col("node_id").alias("id")), "id", "left_anti")


def collected_evidence(closure: DataFrame, evidence: DataFrame, cap: int = 12) -> DataFrame:
    """At most ``cap`` pieces of visible evidence per node, by source, anchor and id: a top-k per node."""
    e = closure.join(evidence.where(~hidden_image()).select(F.col("id").alias("evidence_id"), "source_id", "anchor_ref"), "evidence_id")
    w = Window.partitionBy("node_id").orderBy("source_id", "anchor_ref", "evidence_id")
    return e.withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap)


def visible_evidence(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that nodes refer to, visible only, with its place by page (null pages last), then id."""
    r = nodes.select(F.col("id").alias("node_id"), F.explode("source_refs").alias("evidence_id")).distinct()
    e = r.join(evidence.where(~hidden_image()).select(F.col("id").alias("evidence_id"), "page_start"), "evidence_id")
    w = Window.partitionBy("node_id").orderBy(F.asc_nulls_last("page_start"), "evidence_id")
    return e.withColumn("position", F.row_number().over(w))


def asset_name(ref: str | Column) -> Column:
    """An asset reference without query, scheme noise and leading dots: the form in which paths are compared."""
    return F.regexp_replace(F.regexp_replace(F.trim(X.col(ref)), r"[?#].*$", ""), r"^(\./|/)+", "")


def body_media(bodies: DataFrame, assets: DataFrame) -> DataFrame:
    """Image references of bodies matched to assets (path, evidence_id) by equal path or path suffix; unresolved ones keep a null.

    The join key is the file name, so the suffix test runs on a few rows per name.
    """
    refs = bodies.select("node_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), 1))).alias("ref"))
    refs = refs.withColumn("key", asset_name("ref")).withColumn("name", F.element_at(F.split("key", "/"), -1))
    a = assets.select(asset_name("path").alias("asset"), "evidence_id").withColumn("name", F.element_at(F.split("asset", "/"), -1))
    j = refs.join(a, "name", "left")
    same = (F.col("asset") == F.col("key")) | F.endswith("asset", F.concat(F.lit("/"), "key")) | F.endswith("key", F.concat(F.lit("/"), "asset"))
    best = j.groupBy("node_id", "ref").agg(F.min(F.when(same, F.struct((F.col("asset") != F.col("key")).alias("far"), "evidence_id"))).alias("b"))
    return best.select("node_id", "ref", F.col("b.evidence_id").alias("evidence_id"))


def changed_media(bodies: DataFrame, resolved: DataFrame) -> DataFrame:
    """Bodies whose media differ (null-safe) from the resolved ones."""
    return bodies.join(resolved.withColumnRenamed("media", "new_media"), "node_id").where(~F.col("media").eqNullSafe(F.col("new_media")))


def fragment_evidence(frags: DataFrame, evidence: DataFrame) -> DataFrame:
    """(fragment_id, evidence_id): known excerpt ids and all evidence of the fragment's source and anchor."""
    ids = frags.select("fragment_id", F.explode("excerpt_ids").alias("evidence_id")).join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").select("fragment_id", "evidence_id")
    near = frags.select("fragment_id", "source_id", "anchor_ref").join(evidence.select(F.col("id").alias("evidence_id"), "source_id", "anchor_ref"), ["source_id", "anchor_ref"])
    return ids.union(near.select("fragment_id", "evidence_id")).distinct()


def profile_tasks(profiles: DataFrame, contexts: DataFrame, closure: DataFrame) -> DataFrame:
    """One task per (profile, stage) with the reason to skip it: missing stage, context, evidence, protected, unchanged.

    contexts: profile_id, stage, context, fingerprint, old_fingerprint, generated_from.
    """
    p = active(profiles).select(F.col("id").alias("profile_id"), "node_id", F.explode_outer("school_stages").alias("stage"))
    j = p.join(contexts, ["profile_id", "stage"], "left").join(closure.select("node_id").distinct().withColumn("has_evidence", F.lit(True)), "node_id", "left")
    reason = (
        F.when(F.col("stage").isNull(), "missing_stage").when(F.coalesce(F.trim("context"), F.lit("")) == "", "missing_context").when(F.col("has_evidence").isNull(), "missing_evidence")
        .when(F.col("generated_from") == "manual", "protected").when(F.col("fingerprint").eqNullSafe(F.col("old_fingerprint")), "unchanged")
    )
    return j.select("profile_id", "node_id", "stage", reason.alias("skip_reason"))


def card_markdown(cards: DataFrame) -> DataFrame:
    """A card as markdown: summary, then titled sections, each paragraph once."""
    sec = F.transform("sections", lambda s: F.array_join(F.concat(F.array(F.concat(F.lit("## "), F.trim(s["title"]))), F.filter(F.transform(s["content"], lambda c: F.trim(c)), lambda c: c != "")), "\n\n"))
    return cards.select("node_id", F.array_join(X.unique_strings(F.concat(F.array("summary"), sec)), "\n\n").alias("markdown"))


def assessment_mentions(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mentions of existing canonical candidates only."""
    return mentions.join(candidates.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def completeness(nodes: DataFrame, closure: DataFrame, edges: DataFrame, profiles: DataFrame, mentions: DataFrame, cards: DataFrame, bodies: DataFrame, core: Column | None = None) -> DataFrame:
    """Nine signals per node (definition, core, relations, evidence, fragments, profiles, body references, card, mentions) and a score.

    ``core``: whether the node has a semantic core; false if not given. Score: round(100 * passed / 9).
    """
    act = active(edges)
    has = {
        "relations": act.select(F.col("from_id").alias("id")).union(act.select(F.col("to_id").alias("id"))), "evidence": closure.select(F.col("node_id").alias("id")),
        "profiles": profiles.where((F.trim("domain") != "") | (F.size("school_stages") > 0)).select(F.col("node_id").alias("id")),
        "body_refs": bodies.where((F.trim("content") != "") & (F.size("source_refs") > 0)).select(F.col("node_id").alias("id")),
        "card": cards.where((F.trim("summary") != "") | (F.size("sections") > 0)).select(F.col("node_id").alias("id")), "mentions": mentions.select(F.col("target_id").alias("id")),
    }
    out = nodes.select("id", (F.coalesce(F.trim("definition"), F.lit("")) != "").alias("definition"), (F.lit(False) if core is None else core).alias("core"))
    for name, df in has.items():
        out = out.join(df.distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    out = out.withColumn("fragments", F.col("evidence"))
    names = ["definition", "core", "relations", "evidence", "fragments", "profiles", "body_refs", "card", "mentions"]
    passed = sum((F.col(n).cast("int") for n in names[1:]), F.col(names[0]).cast("int"))
    return out.select("id", *names, passed.alias("passed"), F.round(passed * 100 / 9).cast("int").alias("score"))
