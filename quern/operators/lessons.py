"""Staged lessons merged in order, with state that outlives a lesson, as joins over all lessons at once.

The reference order is (ordinal of the lesson, place in it). What a row sees of earlier lessons is:

* canonical nodes made by earlier rows: the ordered resolution (``resolve``) over one order key for all lessons, which folds
  distinct signatures inside link components only;
* evidence: an id is known to a lesson if it existed or a lesson up to this one brings it: the least ordinal of an id;
* profiles: the state of an id before a lesson holds what the last row of each earlier lesson brought, so a value counts from
  its first such lesson: also a least ordinal, and running sums of these give the sizes that a sequential run would see.

Nothing is folded lesson by lesson, so neither a long list of lessons nor a profile that all of them touch is a chain of jobs
or one task's work.

Tables (all with ``lesson``, and ``pos`` for the order): lessons: lesson, ordinal; nodes: raw_id, kind, subkind, name, aliases,
semantic_key, embedding, existing_id (set: this canonical node or an error); evidence: raw_id, anchor_ref, excerpt; edges:
raw_from, raw_to, type, source_refs; profiles: raw_node_id, domain, school_stages, curriculum_roles, source_refs; mentions:
raw_id, target_type, target_raw, source_refs; cards: raw_id, raw_node_id, source_refs, sections (array of id, source_refs).
Existing state: canonical (id, kind, subkind, name, aliases, semantic_key, embedding), old_profiles (id, school_stages,
curriculum_roles, source_refs), old_evidence (id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import graph as G
from quern.operators import resolve as M

STATS = ("nodes_created", "nodes_matched", "nodes_review", "edges_upserted", "domain_profiles_upserted", "mentions_upserted", "evidence_upserted", "evidence_links_upserted", "node_cards_upserted")
def _none() -> Column:
    return F.array().cast("array<string>")


def _key(ordinal: str, pos: str) -> Column:
    """An order key over all lessons: strings of one width."""
    return F.concat_ws("/", F.lpad(F.col(ordinal).cast("string"), 12, "0"), F.lpad(F.col(pos).cast("string"), 12, "0"))


def node_map(lessons: DataFrame, nodes: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lesson, pos, raw_id, canonical_id, resolution, score of every staged node; errors: lesson, raw_id, existing_id)."""
    staged = nodes.join(lessons.select("lesson", "ordinal"), "lesson").withColumn("at", _key("ordinal", "pos"))
    free = staged.where(F.coalesce("existing_id", F.lit("")) == "")
    got = G.cut(M.resolve(free.select(F.col("at").alias("raw_id"), F.col("at").alias("created_at"), "kind", "subkind", "name", "aliases", "semantic_key", "embedding"), canonical))
    out = free.join(got.withColumnRenamed("raw_id", "at"), "at").select("lesson", "pos", "raw_id", "canonical_id", "resolution", "score")
    # A named canonical node is there from the start or since the row that made it.
    made = got.where("resolution <> 'matched'").groupBy("canonical_id").agg(F.min("raw_id").alias("since"))
    there = canonical.select(F.col("id").alias("canonical_id"), F.lit("").alias("since")).unionByName(made).groupBy("canonical_id").agg(F.min("since").alias("since"))
    named = staged.where(F.coalesce("existing_id", F.lit("")) != "").join(there, F.col("existing_id") == F.col("canonical_id"), "left")
    known = F.coalesce(F.col("since") < F.col("at"), F.lit(False))
    found = named.where(known).select("lesson", "pos", "raw_id", "canonical_id", F.lit("matched").alias("resolution"), F.lit(1.0).alias("score"))
    return out.unionByName(found), named.where(~known).select("lesson", "raw_id", "existing_id")


def remapped(df: DataFrame, keys: list[str], refs: Column, table: DataFrame) -> DataFrame:
    """keys, refs: trimmed references of a lesson through its evidence map (lesson, ref, evidence_id), distinct, in order."""
    rows = df.select(*keys, F.posexplode(refs).alias("i", "ref")).withColumn("ref", F.trim("ref")).where("ref <> ''")
    rows = rows.join(table, ["lesson", "ref"], "left").withColumn("ref", F.coalesce("evidence_id", "ref"))
    return rows.groupBy(*keys).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "ref"))), lambda x: x["ref"])).alias("refs"))


def _with_refs(df: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    return df.drop("source_refs").join(remapped(df, keys, F.col("source_refs"), table).withColumnRenamed("refs", "source_refs"), keys, "left").withColumn("source_refs", F.coalesce("source_refs", _none()))


def merge_profiles(rows: DataFrame, old: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final profiles: id, school_stages, curriculum_roles, source_refs; links: lesson, pos, id, n).

    rows: id, lesson, ordinal, pos and arrays; known: id of evidence and the ordinal since when it is known. ``n`` is the
    number of references a row's merged profile has: all values whose first bringing lesson lies before, and its own new ones.
    """
    last = rows.join(rows.groupBy("id", "ordinal").agg(F.max("pos").alias("pos")), ["id", "ordinal", "pos"], "left_semi")
    start = rows.groupBy("id").agg(F.min("ordinal").alias("ordinal"))
    was = old.join(start, "id").select("id", "ordinal", F.lit(-1).alias("pos"), "school_stages", "curriculum_roles", "source_refs")
    bring = was.unionByName(last.select("id", "ordinal", "pos", "school_stages", "curriculum_roles", "source_refs"))

    def values(df: DataFrame, column: str) -> DataFrame:
        return df.select("id", "ordinal", "pos", F.posexplode(column).alias("i", "v")).withColumn("v", F.trim("v")).where("v <> ''")

    def fresh(df: DataFrame) -> DataFrame:
        since = known.select(F.col("id").alias("v"), "since")
        return df.join(since, "v").where("since <= ordinal").drop("since")

    def merged(column: str) -> DataFrame:
        v = values(bring, column)
        v = fresh(v) if column == "source_refs" else v
        first = v.groupBy("id", "v").agg(F.min(F.struct("ordinal", "pos", "i")).alias("at"))
        return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(column))

    out = reduce(lambda a, c: a.join(merged(c), "id", "left"), ("school_stages", "curriculum_roles", "source_refs"), start.select("id"))
    out = out.select("id", *[F.coalesce(c, _none()).alias(c) for c in ("school_stages", "curriculum_roles", "source_refs")]).unionByName(old.join(start, "id", "left_anti").select("id", "school_stages", "curriculum_roles", "source_refs"))
    # Sizes: values first brought before a lesson (old ones before every lesson), by a running sum over (id, ordinal).
    first = fresh(values(bring, "source_refs")).groupBy("id", "v").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    first = first.select("id", "v", F.when(F.col("at.pos") < 0, -1).otherwise(F.col("at.ordinal")).alias("since"))
    steps = first.groupBy("id", F.col("since").alias("ordinal")).agg(F.count("*").alias("k"))
    marks = rows.select("id", "ordinal").distinct().withColumn("k", F.lit(0).cast("long")).unionByName(steps)
    marks = marks.groupBy("id", "ordinal").agg(F.sum("k").alias("k"))
    sofar = marks.select("id", "ordinal", F.coalesce(F.sum("k").over(Window.partitionBy("id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = fresh(values(rows, "source_refs")).select("id", "ordinal", "pos", "v").distinct().join(first, ["id", "v"], "left")
    own = own.where(F.coalesce(F.col("since") >= F.col("ordinal"), F.lit(True))).groupBy("id", "ordinal", "pos").agg(F.count("*").alias("new"))
    links = rows.select("lesson", "id", "ordinal", "pos").join(sofar, ["id", "ordinal"]).join(own, ["id", "ordinal", "pos"], "left")
    return out, links.select("lesson", "pos", "id", (F.col("before") + F.coalesce("new", F.lit(0))).alias("n"))


def merge_lessons(lessons: DataFrame, nodes: DataFrame, evidence: DataFrame, edges: DataFrame, profiles: DataFrame, mentions: DataFrame, cards: DataFrame, canonical: DataFrame, old_profiles: DataFrame, old_evidence: DataFrame) -> dict[str, DataFrame]:
    """The merge of all lessons: node_map, errors, evidence, edges, profiles (final state), mentions, cards, and stats by lesson.

    Edges and cards of unmapped nodes are dropped, mentions keep an unmapped target as it is, a raw id of several rows of a
    lesson means the last. Rows of a lesson that is not listed are left out; repeated ids are repeated upserts, counted each.
    """
    only = lambda df: df.join(lessons.select("lesson"), "lesson", "left_semi")
    mapped, errors = node_map(lessons, nodes, canonical)
    mapped = G.cut(mapped)
    table = mapped.groupBy("lesson", "raw_id").agg(F.max_by("canonical_id", "pos").alias("canonical_id"))

    out_evidence = M.evidence_ids(only(evidence).withColumnRenamed("lesson", "lesson_run_id").withColumnRenamed("raw_id", "raw_evidence_id")).withColumnRenamed("lesson_run_id", "lesson")
    refs = out_evidence.groupBy("lesson", F.col("raw_evidence_id").alias("ref")).agg(F.max_by("id", "pos").alias("evidence_id"))
    known = old_evidence.select("id", F.lit(-1).alias("since")).unionByName(out_evidence.join(lessons, "lesson").select("id", F.col("ordinal").alias("since")))
    known = known.groupBy("id").agg(F.min("since").alias("since"))

    side = lambda raw, c: table.select("lesson", F.col("raw_id").alias(raw), F.col("canonical_id").alias(c))
    e = only(edges).join(side("raw_from", "from_id"), ["lesson", "raw_from"]).join(side("raw_to", "to_id"), ["lesson", "raw_to"])
    e = _with_refs(e, ["lesson", "pos"], refs).select("lesson", "pos", F.concat(F.lit("edge:auto-"), X.stable_suffix("from_id", "type", "to_id")).alias("id"), "from_id", "to_id", "type", "source_refs")

    p = only(profiles).where(F.coalesce("domain", F.lit("")) != "").join(side("raw_node_id", "node_id"), ["lesson", "raw_node_id"]).join(lessons.select("lesson", "ordinal"), "lesson")
    p = _with_refs(p, ["lesson", "pos"], refs).withColumn("id", F.concat(F.lit("domain-profile:auto-"), X.stable_suffix("node_id", "domain")))
    p = p.withColumns({c: F.coalesce(c, _none()) for c in ("school_stages", "curriculum_roles")})
    out_profiles, profile_links = merge_profiles(p.select("id", "lesson", "ordinal", "pos", "school_stages", "curriculum_roles", "source_refs"), old_profiles, known)

    m = only(mentions).join(side("target_raw", "target_id"), ["lesson", "target_raw"], "left").withColumn("target_id", F.coalesce("target_id", "target_raw"))
    m = _with_refs(m, ["lesson", "pos"], refs).select("lesson", "pos", F.concat(F.lit("mention:auto-"), X.stable_suffix("lesson", "raw_id", "target_type", "target_id")).alias("id"), "target_id", "source_refs")

    c = _with_refs(only(cards).join(side("raw_node_id", "node_id"), ["lesson", "raw_node_id"]), ["lesson", "pos"], refs)
    parts = c.select("lesson", "pos", F.posexplode("sections").alias("s", "section"))
    inner = remapped(parts, ["lesson", "pos", "s"], F.col("section.source_refs"), refs)
    parts = parts.join(inner, ["lesson", "pos", "s"], "left").groupBy("lesson", "pos").agg(F.array_sort(F.collect_list(F.struct("s", F.col("section.id").alias("id"), F.coalesce("refs", _none()).alias("source_refs")))).alias("held"))
    c = c.drop("sections").join(parts, ["lesson", "pos"], "left").select("lesson", "pos", F.col("raw_id").alias("id"), "node_id", "source_refs", F.coalesce(F.transform("held", lambda x: F.struct(x["id"].alias("id"), x["source_refs"].alias("source_refs"))), F.array().cast("array<struct<id:string,source_refs:array<string>>>")).alias("sections"))

    n_of = lambda col: F.size(col).cast("long")
    inside = F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["source_refs"]))
    counted = [
        mapped.select("lesson", F.concat(F.lit("nodes_"), "resolution").alias("what"), F.lit(1).cast("long").alias("n")),
        *[df.select("lesson", F.lit(f"{name}_upserted").alias("what"), F.lit(1).cast("long").alias("n")) for name, df in (("edges", e), ("domain_profiles", p), ("mentions", m), ("evidence", out_evidence), ("node_cards", c))],
        *[df.select("lesson", F.lit("evidence_links_upserted").alias("what"), n.alias("n")) for df, n in ((e, n_of("source_refs")), (m, n_of("source_refs")), (c, n_of("source_refs") + inside), (profile_links, F.col("n")))],
    ]
    sums = reduce(DataFrame.unionByName, counted).groupBy("lesson").agg(*[F.sum(F.when(F.col("what") == s, F.col("n"))).alias(s) for s in STATS])
    stats = lessons.select("lesson", "ordinal").join(sums, "lesson", "left").na.fill(0, list(STATS))
    return {"node_map": mapped, "errors": errors, "evidence": out_evidence, "edges": e, "profiles": out_profiles, "mentions": m, "cards": c, "stats": stats}


def total_stats(stats: DataFrame) -> DataFrame:
    """One row: merged (lessons) and the sums of all counts."""
    return stats.agg(F.count("*").alias("merged"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STATS])
