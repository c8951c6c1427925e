"""Quality dashboards, rules and aggregates (A1-A10, Q1-Q7). Every rule is one DataFrame; results are unions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X
from quern.operators.filters import quality_evidence
from quern.operators.graph import components
from quern.operators.normalize import active
from quern.shared import scratch


def _issue(df: DataFrame, category: str, key: str | Column, message: str | Column) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(category).alias("category"), key.cast("string").alias("id"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Unknown values up to which they are sent to all tasks.
FEW = 100_000


def unknown(values: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct values (one column) that are not known, as a written table: the rows that hold them need no dealing where they are few."""
    gone = scratch(values.distinct().join(known, values.columns, "left_anti"), "unknown")
    return F.broadcast(gone) if gone.count() <= FEW else gone


def reference_issues(df: DataFrame, category: str, key: str, gone: DataFrame, refs: str = "source_refs") -> list[DataFrame]:
    """Rows without references, with empty ones, and with unknown ones (one issue per reference). gone: the unknown references (ref)."""
    r = df.select(F.col(key).alias("k"), F.explode(refs).alias("ref"))
    blank = F.coalesce(F.trim("ref"), F.lit("")) == ""
    gone = r.where(~blank).join(gone, "ref")
    return [
        _issue(df.where(F.coalesce(F.size(refs), F.lit(0)) <= 0), category, key, "Missing evidence source references"),
        _issue(r.where(blank), category, "k", "Invalid empty evidence reference"), _issue(gone, category, "k", F.concat(F.lit("Missing evidence "), "ref")),
    ]


def _missing(ids: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return ids.join(other.select(F.col(key).alias("id")), "id", "left_anti")


def strict_qa(nodes: DataFrame, edges: DataFrame, profiles: DataFrame, mentions: DataFrame, evidence: DataFrame, cards: DataFrame, bodies: DataFrame) -> DataFrame:
    """Q1: issues (category, id, message) of all rules. Null-safe: a null value is invalid where a vocabulary is asked for."""
    bad = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    odd = lambda c, values: F.array_sort(F.array_except(c, F.array(*[F.lit(v) for v in values])))
    shown = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    types = F.array_distinct(F.transform("sections", lambda s: s["section_type"]))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(s) for s in S.CARD_SECTIONS]), types))
    sec = cards.select("node_id", F.explode("sections").alias("s"))
    sec_name = F.coalesce(F.when(F.col("s.id") != "", F.col("s.id")), F.when(F.col("s.section_type") != "", F.col("s.section_type")), F.lit("section"))
    sec = sec.select(F.concat_ws(":", "node_id", sec_name).alias("k"), F.col("s.source_refs").alias("source_refs"))
    refs = _union([df.select(F.explode("source_refs").alias("ref")) for df in (edges, profiles, mentions, cards, sec, bodies)]).where("ref IS NOT NULL")
    gone = unknown(refs, evidence.select(F.col("id").alias("ref")))
    ends = unknown(edges.select(F.col("from_id").alias("end")).union(edges.select("to_id")), nodes.select(F.col("id").alias("end")))
    # A null end is no node either.
    lost = lambda c: edges.join(ends, F.col(c).eqNullSafe(F.col("end")), "left_semi")
    parts = [
        _issue(nodes.where(bad("kind", S.NODE_KINDS)), "node", "id", F.concat(F.lit("Invalid kind: "), F.coalesce("kind", F.lit("")))),
        _issue(nodes.where(empty("name") | empty("definition")), "node", "id", "Missing name or definition"),
        _issue(_missing(nodes, cards, "node_id"), "node_card", "id", "Missing node card"), _issue(_missing(nodes, mentions, "target_id"), "mention", "id", "Missing mention"),
        _issue(_missing(nodes, profiles, "node_id"), "domain_profile", "id", "Missing domain profile"),
        _issue(edges.where(bad("type", S.EDGE_TYPES)), "edge", "id", F.concat(F.lit("Invalid edge type: "), F.coalesce("type", F.lit("")))),
        _issue(edges.where(bad("directionality", ("directed", "undirected"))), "edge", "id", F.concat(F.lit("Invalid directionality: "), F.coalesce("directionality", F.lit("")))),
        *reference_issues(edges, "edge", "id", gone),
        _issue(lost("from_id"), "edge", "id", "Missing source node"), _issue(lost("to_id"), "edge", "id", "Missing target node"),
        _issue(profiles.where(bad("domain", S.DOMAINS)), "domain_profile", "id", F.concat(F.lit("Invalid domain: "), F.coalesce("domain", F.lit("")))),
        _issue(profiles.where(F.size(odd("school_stages", S.SCHOOL_STAGES)) > 0), "domain_profile", "id", F.concat(F.lit("Invalid school stages: "), shown(odd("school_stages", S.SCHOOL_STAGES)))),
        _issue(profiles.where(F.size(odd("curriculum_roles", S.CURRICULUM_ROLES)) > 0), "domain_profile", "id", F.concat(F.lit("Invalid curriculum roles: "), shown(odd("curriculum_roles", S.CURRICULUM_ROLES)))),
        *reference_issues(profiles, "domain_profile", "id", gone), *reference_issues(mentions, "mention", "id", gone),
        _issue(cards.where(empty("summary")), "node_card", "node_id", "Missing summary"), *reference_issues(cards, "node_card", "node_id", gone),
        _issue(cards.where(F.size(missing) > 0), "node_card", "node_id", F.concat(F.lit("Missing required sections: "), shown(missing))),
        *reference_issues(sec, "node_card_section", "k", gone),
        _issue(bodies.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti"), "node_body", "node_id", "Missing node"),
        _issue(bodies.where(empty("content")), "node_body", "node_id", "Missing body content"), *reference_issues(bodies, "node_body", "node_id", gone),
    ]
    for c, values, name in (("domains", S.DOMAINS, "domains"), ("learning_modes", S.LEARNING_MODES, "learning modes")):
        if c in nodes.columns:
            parts.append(_issue(nodes.where(F.coalesce(F.size(c), F.lit(0)) <= 0), "node", "id", f"{c} must be a non-empty array"))
            parts.append(_issue(nodes.where(F.size(odd(c, values)) > 0), "node", "id", F.concat(F.lit(f"Invalid {name}: "), shown(odd(c, values)))))
    if "generated_from" in bodies.columns:
        parts.append(_issue(bodies.where((F.col("generated_from") != "") & bad("generated_from", S.BODY_ORIGINS)), "node_body", "node_id", F.concat(F.lit("Invalid generated_from: "), "generated_from")))
    return _union(parts)


def ordered_digests(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per group of ``keys`` (strings): n, its rows, and digest, the MD5 of its ``order`` columns (strings), joined without separators, rows in that order.

    All rows are sorted in ranges, and each range packs its stretch of a group into few compressed pieces. MD5 goes from start to
    end, so one task reads the pieces of a group in turn; it holds a batch of them and never the group. Nulls count as empty.
    """
    rows = rows.select(*keys, *order).orderBy(*keys, *order)
    names = ", ".join(f"{k} string" for k in keys)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            text = pc.binary_join_element_wise(*[pc.fill_null(b.column(c), "").cast(pa.large_string()) for c in order], pa.scalar("", pa.large_string()))
            group = list(zip(*[b.column(k).to_pylist() for k in keys], strict=True))
            ends = [i for i in range(1, len(group)) if group[i] != group[i - 1]] + [len(group)]
            at, body = 0, text.buffers()[2]
            place = np.frombuffer(text.buffers()[1], np.int64)[text.offset :]
            for end in ends if group else []:
                piece = zlib.compress(memoryview(body)[place[at] : place[end]] if body else b"", 1)
                yield pa.RecordBatch.from_pydict({**{k: pa.array([v], pa.string()) for k, v in zip(keys, group[at], strict=True)}, "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n": pa.array([end - at], pa.int64()), "body": pa.array([piece], pa.binary())})
                at, seq = end, seq + 1

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, md5 = None, 0, None
        told = lambda: pa.RecordBatch.from_pydict({**{k: pa.array([v], pa.string()) for k, v in zip(keys, of, strict=True)}, "n": pa.array([n], pa.int64()), "digest": pa.array([md5.hexdigest()])})
        for b in batches:
            for i, group in enumerate(zip(*[b.column(k).to_pylist() for k in keys], strict=True)):
                if group != of:
                    if md5:
                        yield told()
                    of, n, md5 = group, 0, hashlib.md5()
                n += b.column("n")[i].as_py()
                md5.update(zlib.decompress(b.column("body")[i].as_buffer()))
        if md5:
            yield told()

    pieces = rows.mapInArrow(pack, f"{names}, part int, seq int, n long, body binary")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "part", "seq").mapInArrow(digest, f"{names}, n long, digest string")


def scope_issues(issues: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Q2: issues of a book's nodes (id, or the part before a colon-separated section)."""
    return issues.join(node_ids.select(F.col("id")), "id", "left_semi")


def book_nodes(mentions: DataFrame, evidence: DataFrame, source: str) -> DataFrame:
    """Q2: distinct nodes whose mentions refer to evidence of the book."""
    r = mentions.select(F.col("target_id").alias("id"), F.explode("source_refs").alias("ref"))
    return r.join(evidence.where(F.col("source_id") == source).select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()


def admission_warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q3, admission: names of one character, headings, assessment labels, and nodes without relations in lessons that have some.

    nodes: lesson, raw_node_id, name; edges: lesson, from_id, to_id.
    """
    name = F.trim("name")
    matches = lambda patterns: reduce(lambda a, b: a | b, [name.rlike(p) for p in patterns])
    ends = edges.select("lesson", F.col("from_id").alias("raw_node_id")).union(edges.select("lesson", F.col("to_id").alias("raw_node_id"))).distinct()
    lone = nodes.join(edges.select("lesson").distinct(), "lesson", "left_semi").join(ends, ["lesson", "raw_node_id"], "left_anti")
    say = lambda df, text: df.select("lesson", "raw_node_id", F.lit(text).alias("warning"))
    return _union([
        say(nodes.where(F.char_length(name) <= 1), "name is too short"), say(nodes.where(matches(S.STRUCTURAL_NAMES)), "looks like a heading"),
        say(nodes.where(matches(S.ASSESSMENT_NAMES)), "looks like an assessment label"), say(lone, "has no staged relations"),
    ])


def staging_errors(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, mentions: DataFrame, cards: DataFrame, profiles: DataFrame) -> DataFrame:
    """Q3, errors (lesson, id, message). All inputs have lesson and raw ids; evidence has quality_ok; refs are arrays."""
    good = evidence.where("quality_ok").select("lesson", F.col("id").alias("ref"))
    say = lambda df, key, text: df.select("lesson", F.col(key).alias("id"), (F.lit(text) if isinstance(text, str) else text).alias("message"))
    of = lambda df, key: df.select("lesson", F.col(key).alias("id"))
    refs = nodes.select("lesson", "id", F.explode("source_refs").alias("ref")).union(mentions.select("lesson", F.col("target_id"), F.explode("source_refs")))
    backed = refs.join(good, ["lesson", "ref"], "left_semi").select("lesson", "id").distinct()
    edge_ok = edges.select("lesson", "id", F.explode("source_refs").alias("ref")).join(good, ["lesson", "ref"], "left_semi").select("lesson", "id").distinct()
    ends = lambda c: edges.join(of(nodes, "id").withColumnRenamed("id", c), ["lesson", c], "left_anti")
    mref = mentions.select("lesson", F.col("id").alias("mid"), F.explode("source_refs").alias("ref"))
    return _union([
        say(nodes.where(~F.coalesce(F.col("kind").isin(*S.NODE_KINDS), F.lit(False))), "id", "invalid kind"), say(nodes.where(F.coalesce("definition", F.lit("")) == ""), "id", "missing definition"),
        say(nodes.join(of(profiles, "node_id"), ["lesson", "id"], "left_anti"), "id", "missing domain profile"), say(nodes.join(of(cards, "node_id"), ["lesson", "id"], "left_anti"), "id", "missing node card"),
        say(nodes.join(of(mentions, "target_id"), ["lesson", "id"], "left_anti"), "id", "missing mention"), say(nodes.join(backed, ["lesson", "id"], "left_anti"), "id", "no evidence-backed reference"),
        say(edges.where(~F.coalesce(F.col("type").isin(*S.EDGE_TYPES), F.lit(False))), "id", "invalid type"), say(ends("from_id").unionByName(ends("to_id")).distinct(), "id", "missing node endpoint"),
        say(edges.join(edge_ok, ["lesson", "id"], "left_anti"), "id", "no evidence source_refs"),
        say(mentions.join(of(nodes, "id").withColumnRenamed("id", "target_id"), ["lesson", "target_id"], "left_anti"), "id", "missing node"),
        say(mref.join(evidence.select("lesson", F.col("id").alias("ref")), ["lesson", "ref"], "left_anti"), "mid", "missing evidence"),
    ])


def lesson_gate(lessons: DataFrame, errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """Q3, Q4: per lesson blocked or success, counts of errors and warnings, whether a review is required."""
    e = errors.groupBy("lesson").agg(F.count("*").alias("n_errors"))
    w = warnings.groupBy("lesson").agg(F.count("*").alias("n_warnings"), F.countDistinct("raw_node_id").alias("n_review"))
    j = lessons.join(e, "lesson", "left").join(w, "lesson", "left").na.fill(0, ["n_errors", "n_warnings", "n_review"])
    return j.withColumn("status", F.when(F.col("n_errors") > 0, "blocked").otherwise("success")).withColumn("review_required", F.col("n_warnings") > 0)


def staging_integrity(edges: DataFrame, mentions: DataFrame, cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """Q5: rows that refer to a node that is not staged."""
    n = nodes.select("id")
    gone = lambda df, c: df.join(n.withColumnRenamed("id", c), c, "left_anti")
    return _union([
        _issue(gone(edges, "from_id"), "edge", "id", "missing source"), _issue(gone(edges, "to_id"), "edge", "id", "missing target"),
        _issue(gone(mentions, "target_id"), "mention", "id", "missing target"), _issue(gone(cards, "node_id"), "card", "node_id", "missing node"),
    ])


def mark_passed(lessons: DataFrame, blocked: DataFrame) -> DataFrame:
    """Q6: merged lessons become qa_passed, or blocked where they have issues; other states stay."""
    b = blocked.select("lesson").distinct().withColumn("bad", F.lit(True))
    j = lessons.join(b, "lesson", "left")
    return j.withColumn("status", F.when((F.col("status") == "merged") & F.col("bad").isNotNull(), "blocked").when(F.col("status") == "merged", "qa_passed").otherwise(F.col("status"))).drop("bad")


def apply_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Q7: decisions (id, decision) apply to pending rows only."""
    j = rows.join(reviews, "id", "left")
    return j.withColumn("review_status", F.when((F.col("review_status") == "pending") & F.col("decision").isNotNull(), F.col("decision")).otherwise(F.col("review_status"))).drop("decision")


def lesson_quality(lessons: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """A1, A3: per lesson counts, coverage (objects with a valid reference / objects), isolated nodes and their ratio; recorded counts as fallback.

    lessons: lesson, status, recorded_nodes; nodes/edges: lesson, id, source_refs (edges: from_id, to_id); evidence: lesson, id, properties.
    """
    n, e = active(nodes), active(edges)
    good = evidence.where(quality_evidence()).select("lesson", F.col("id").alias("ref"))
    objects = n.select("lesson", F.concat(F.lit("n"), "id").alias("o"), "source_refs").union(e.select("lesson", F.concat(F.lit("e"), "id"), "source_refs"))
    covered = objects.select("lesson", "o", F.explode("source_refs").alias("ref")).join(good, ["lesson", "ref"], "left_semi").select("lesson", "o").distinct()
    inside = e.join(n.select("lesson", F.col("id").alias("from_id")), ["lesson", "from_id"], "left_semi").join(n.select("lesson", F.col("id").alias("to_id")), ["lesson", "to_id"], "left_semi")
    touched = inside.select("lesson", F.col("from_id").alias("id")).union(inside.select("lesson", F.col("to_id"))).distinct()
    alone = n.join(touched, ["lesson", "id"], "left_anti")
    count = lambda df, name: df.groupBy("lesson").agg(F.count("*").alias(name))
    out = lessons
    for df, name in ((n, "nodes"), (e, "relations"), (good, "evidence"), (covered, "covered"), (alone, "isolated")):
        out = out.join(count(df, name), "lesson", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    total = F.col("nodes") + F.col("relations")
    return out.select(
        "lesson", "status", F.when(F.col("nodes") > 0, F.col("nodes")).otherwise(F.coalesce("recorded_nodes", F.lit(0))).alias("node_count"), F.col("relations").alias("relation_count"),
        F.col("evidence").alias("evidence_count"), F.when(total > 0, F.col("covered") / total).otherwise(0.0).alias("coverage"), F.col("isolated").alias("isolated_count"),
        F.when(F.col("nodes") > 0, F.col("isolated") / F.col("nodes")).otherwise(0.0).alias("isolated_ratio"), "covered", total.alias("supportable"),
    )


def lesson_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1: lesson, components: of the graphs of all lessons at once, by one run over (lesson, node) keys.

    Lone nodes count one each; edges to nodes that the lesson lacks count nothing; ids are trimmed, empty ones left out. The
    rounds work on edges of all lessons together, so many small graphs need as many rounds as the largest of them, and a
    lesson of any size is spread over tasks.
    """
    key = lambda c: F.concat_ws("\u0001", F.col("lesson").cast("string"), F.trim(c))
    ids = nodes.where(F.trim("id") != "").select("lesson", key("id").alias("id")).distinct()
    at = lambda c: ids.select(F.col("id").alias(c))
    inside = edges.select(key("from_id").alias("from_id"), key("to_id").alias("to_id")).join(at("from_id"), "from_id", "left_semi").join(at("to_id"), "to_id", "left_semi")
    met = ids.join(components(inside), "id", "left")
    return met.groupBy("lesson").agg(F.countDistinct(F.coalesce("component", "id")).alias("components"))


def pending_image(modality: str | Column = "modality", properties: str | Column = "properties") -> Column:
    """A1: an image whose review is pending, or open with an uncertain relevance."""
    said = lambda f: F.trim(F.coalesce(F.get_json_object(X.col(properties), f"$.image_relevance.{f}"), F.lit("")))
    return (F.lower(F.trim(F.coalesce(X.col(modality), F.lit("")))) == "image") & ((said("review_status") == "pending") | ((said("review_status") == "") & (said("relevance") == "uncertain")))


def lesson_dashboard(lessons: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, canonical_evidence: DataFrame, merge_reviews: DataFrame) -> DataFrame:
    """A1 in full: ``lesson_quality`` with components, fallbacks to recorded counts, and what waits for a review.

    lessons: lesson, book_id, batch_anchor, status, recorded_nodes, recorded_edges, recorded_evidence, review_required,
    review_node_ids. evidence as in ``lesson_quality`` with modality; canonical_evidence: source_id, anchor_ref, modality,
    properties; merge_reviews: lesson, raw_node_id. Images under review are counted on the canonical evidence of merged
    lessons and of those that have any, else on the staged evidence. Every table is aggregated once and joined.
    """
    live = active(nodes)
    base = lesson_quality(lessons.select("lesson", "status", "recorded_nodes"), nodes, edges, evidence)
    staged = evidence.groupBy("lesson").agg(F.count("*").alias("n_staged"), F.count_if(pending_image()).alias("staged_images"))
    canonical = canonical_evidence.groupBy(F.col("source_id").alias("book_id"), F.col("anchor_ref").alias("batch_anchor")).agg(F.count("*").alias("n_canonical"), F.count_if(pending_image()).alias("canonical_images"))
    merged = merge_reviews.groupBy("lesson").agg(F.countDistinct("raw_node_id").alias("merge_review_count"))
    listed = lessons.where("review_required").select("lesson", F.explode(F.array_distinct(F.filter(F.transform("review_node_ids", lambda x: F.trim(x)), lambda x: x != ""))).alias("raw_node_id"))
    own = listed.groupBy("lesson").agg(F.count("*").alias("listed"))
    both = listed.unionByName(merge_reviews.select("lesson", "raw_node_id")).groupBy("lesson").agg(F.countDistinct("raw_node_id").alias("reviewed"))
    out = base.join(lessons.drop("status", "recorded_nodes", "review_node_ids"), "lesson").join(lesson_components(live, active(edges)), "lesson", "left").join(canonical, ["book_id", "batch_anchor"], "left")
    for df in (staged, merged, own, both):
        out = out.join(df, "lesson", "left")
    out = out.na.fill(0, ["components", "n_canonical", "canonical_images", "n_staged", "staged_images", "merge_review_count", "listed", "reviewed", "recorded_edges", "recorded_evidence"])
    required = F.coalesce("review_required", F.lit(False))
    images = F.when(F.col("status").isin("merged", "qa_passed") | (F.col("n_canonical") > 0), F.col("canonical_images")).otherwise(F.col("staged_images"))
    out = out.withColumn("image_review_count", images).withColumn("quality_review_count", F.when(required, F.greatest(F.lit(1), "listed")).otherwise(0))
    alone = F.when(required & (F.col("listed") == 0), 1).otherwise(0) + F.when((F.col("status") == "blocked") & ~required, 1).otherwise(0)
    return out.select(
        "lesson", "status", "node_count", F.when(F.col("relation_count") > 0, F.col("relation_count")).otherwise(F.col("recorded_edges")).alias("relation_count"),
        F.when(F.col("n_staged") > 0, F.col("evidence_count")).otherwise(F.col("recorded_evidence")).alias("evidence_count"), "coverage", "isolated_count", "isolated_ratio",
        F.col("components").alias("disconnected_components"), "image_review_count", "merge_review_count", "quality_review_count", (F.col("image_review_count") + F.col("reviewed") + alone).alias("manual_pending_items"),
    )


def dataset_quality(lessons: DataFrame) -> DataFrame:
    """A2: totals over lessons: one row."""
    return lessons.agg(
        F.count("*").alias("lesson_count"), F.sum("node_count").alias("node_count"), F.sum("relation_count").alias("relation_count"), F.sum("evidence_count").alias("evidence_count"),
        F.coalesce(F.try_divide(F.sum("covered"), F.sum("supportable")), F.lit(0.0)).alias("coverage"), F.sum("isolated_count").alias("isolated_count"), F.count_if(F.col("status") == "blocked").alias("blocked"),
    )


def status_counts(runs: DataFrame, status: str = "status") -> DataFrame:
    """A4: rows per status."""
    return runs.groupBy(status).agg(F.count("*").alias("n"))


def book_summary(books: DataFrame, runs: DataFrame, jobs: DataFrame, node_map: DataFrame, edges: DataFrame, evidence: DataFrame, mentions: DataFrame) -> DataFrame:
    """A5: per book counts of runs, jobs, owned, matched-only and shared nodes, edges, evidence, mentions, last update, deletable.

    Every table is aggregated once and joined; node_map: book, node, owned.
    """
    owner = node_map.groupBy("book", "node").agg(F.max("owned").alias("owned"))
    users = owner.groupBy("node").agg(F.count("*").alias("n_books"))
    o = owner.join(users, "node")
    nodes = o.groupBy("book").agg(F.count_if("owned").alias("canonical_nodes"), F.count_if(~F.col("owned")).alias("matched_only"), F.count_if(F.col("owned") & (F.col("n_books") > 1)).alias("shared"))
    own = owner.where("owned").select("book", "node")
    touch = edges.select("id", F.col("from_id").alias("node")).union(edges.select("id", F.col("to_id"))).join(own, "node").select("book", "id").distinct()
    running = jobs.agg(F.count_if(F.col("status") == "running").alias("running_jobs"))
    n = lambda df, name: df.groupBy("book").agg(F.count("*").alias(name))
    out = books.join(nodes, "book", "left")
    for df in (n(runs, "lesson_runs"), n(jobs, "pipeline_jobs"), n(touch, "edges"), n(evidence, "evidence"), n(mentions, "mentions")):
        out = out.join(df, "book", "left")
    last = runs.select("book", "updated_at").union(jobs.select("book", "updated_at")).groupBy("book").agg(F.max("updated_at").alias("updated_at"))
    out = out.join(last, "book", "left").na.fill(0).crossJoin(F.broadcast(running))
    shared = (F.col("shared") + F.col("matched_only")).alias("shared_nodes")
    free = ((F.col("matched_only") == 0) & (F.col("shared") == 0) & (F.col("running_jobs") == 0)).alias("deletable")
    return out.select("book", "lesson_runs", "pipeline_jobs", "running_jobs", "canonical_nodes", shared, "edges", "evidence", "mentions", "updated_at", free)


def book_node_page(node_map: DataFrame, book: str, limit: int, offset: int = 0) -> DataFrame:
    """A book's nodes with ownership, lessons, whether other books use them, and the total: a page in node order.

    node_map: book, lesson, node, owned. The total is one aggregate, not a window over all rows.
    """
    mine = node_map.where(F.col("book") == book).groupBy("node").agg(F.max("owned").alias("owned"), F.countDistinct("lesson").alias("lessons"))
    others = node_map.where(F.col("book") != book).select("node").distinct().withColumn("shared", F.lit(True))
    j = mine.join(others, "node", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    total = mine.agg(F.count("*").alias("total"))
    return j.orderBy("node").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def json_bytes(df: DataFrame) -> DataFrame:
    """Bytes of all rows as JSON: one row."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("bytes"), F.count("*").alias("n"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Members per label."""
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def library_totals(books: DataFrame) -> DataFrame:
    """A10: books, distinct subjects, nodes (recorded counts where given): one row."""
    return books.agg(F.count("*").alias("books"), F.countDistinct("subject").alias("subjects"), F.sum(F.coalesce("stored_nodes", "counted_nodes")).alias("nodes"))


def rank_within(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
