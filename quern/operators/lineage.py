"""Lineage, lifecycle and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quern.functions import text as X


#: How the rows of each table belong to a book: (id set, column, other columns that must hold a value).
_BOOK, _NODE, _LESSON, _JOB = [("book", "book_id", {})], [("node", "node_id", {})], [("lesson", "lesson_run_id", {})], [("job", "job_id", {})]
SCOPE = {
    "source_artifacts": [("book", "book_id", {}), ("book", "source_id", {"book_id": None})], "textbook_outlines": _BOOK, "mineru_sources": _BOOK, "nodes": [("node", "id", {})], "node_terms": _NODE,
    "edges": [("node", "from_id", {}), ("node", "to_id", {})], "domain_profiles": _NODE,
    "mentions": [("book", "source_id", {}), ("node", "target_id", {"target_type": "node"}), ("edge", "target_id", {"target_type": "edge"}), ("profile", "target_id", {"target_type": "domain_profile"})],
    "evidence": [("book", "source_id", {})], "evidence_links": [("evidence", "evidence_id", {})], "node_cards": _NODE, "node_bodies": _NODE, "unit_embeddings": _NODE,
    "retrieval_candidates": [("node", "candidate_node_id", {})], "lesson_runs": _BOOK, "pipeline_jobs": _BOOK, "pipeline_job_stages": _JOB, "pipeline_job_events": _JOB, "pipeline_worker_states": _JOB,
    "staging_nodes": _LESSON, "staging_edges": _LESSON, "staging_domain_profiles": _LESSON, "staging_mentions": _LESSON, "staging_evidence": _LESSON, "staging_node_cards": _LESSON,
    "merge_runs": [("lesson", "selection", {})], "canonical_node_map": _LESSON,
}
#: Tables that no book owns; all their rows belong to every scope.
GLOBAL_TABLES = ("datasets", "enrich_library", "enrich_books", "taxonomy_terms", "taxonomy_edges")


class BookScope:
    """L1: the rows of every table that belong to a book, through lesson runs, the canonical map, nodes and edges.

    The id sets are frames that every table is semi-joined with; nothing is collected. ``owned``: only nodes that the book
    made or that a reviewer gave it; otherwise all nodes that its lessons are mapped to, as for exports.
    """

    def __init__(self, runs: DataFrame, node_map: DataFrame, edges: DataFrame, book: str, owned: bool = True, profiles: DataFrame | None = None, evidence: DataFrame | None = None, jobs: DataFrame | None = None):
        self.book = book
        self.runs = runs.where(F.col("book") == book).select("lesson").distinct()
        mine = node_map.join(self.runs, "lesson", "left_semi")
        self.nodes = mine.groupBy("node").agg(F.max("owned").alias("owned")).where("owned").select("node") if owned else mine.select("node").distinct()
        n = self.nodes
        self.edges = edges.join(n, F.col("from_id") == n["node"], "left_semi").select("id").union(edges.join(n, F.col("to_id") == n["node"], "left_semi").select("id")).distinct()
        self.sets = {"book": runs.sparkSession.range(1).select(F.lit(book)), "lesson": self.runs, "node": self.nodes, "edge": self.edges}
        if profiles is not None:
            self.sets["profile"] = profiles.join(n, profiles["node_id"] == n["node"], "left_semi").select("id").distinct()
        if evidence is not None:
            self.sets["evidence"] = evidence.where(F.col("source_id") == book).select("id").distinct()
        if jobs is not None:
            self.sets["job"] = jobs.where(F.col("book_id") == book).select("job_id").distinct()

    def rows(self, df: DataFrame, by: str, column: str) -> DataFrame:
        """Rows of ``df`` whose ``column`` is the book itself (by='book') or in one of the id sets."""
        if by == "book":
            return df.where(F.col(column) == self.book)
        return df.join(self.sets[by].toDF(column), column, "left_semi").select(*df.columns)

    def rest(self, df: DataFrame, by: str, column: str) -> DataFrame:
        """L2: the table without the book's rows."""
        if by == "book":
            return df.where(~F.col(column).eqNullSafe(self.book))
        return df.join(self.sets[by].toDF(column), column, "left_anti").select(*df.columns)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """The rows of one of the known tables that belong to the book: those that any of its conditions holds for."""
        if name in GLOBAL_TABLES:
            return df
        out, found = df, F.lit(False)
        for i, (by, column, needs) in enumerate(SCOPE[name]):
            flag, key = f"_in{i}", f"_id{i}"
            ids = self.sets[by].toDF(key).withColumn(flag, F.lit(True))
            if isinstance(df.schema[column].dataType, ArrayType):
                hit = df.select(column, F.explode(column).alias(key)).join(ids, key).select(F.col(column).alias(key), flag).distinct()
                out = out.join(hit, F.col(column) == F.col(key), "left").drop(key)
            else:
                out = out.join(ids, F.col(column) == F.col(key), "left").drop(key)
            ok = F.col(flag).isNotNull()
            for c, v in needs.items():
                ok = ok & F.col(c).eqNullSafe(F.lit(v))
            found = found | ok
        return out.where(found).select(*df.columns)


def delete_conflicts(
    runs: DataFrame, node_map: DataFrame, book: str, merges: DataFrame | None = None, mentions: DataFrame | None = None, links: DataFrame | None = None, targets: DataFrame | None = None
) -> DataFrame:
    """L2: why a book cannot go: node (the object in the way), reason.

    Nodes it only matched, nodes that other books use, merge runs (merge_run, lesson) that hold its lessons and others,
    mentions of other books (source_id, target_id) of its objects, evidence links of other books (source_id, owner_id) to them.
    ``targets``: ids of the book's nodes, edges, profiles and the like; by default its nodes.
    """
    own = runs.where(F.col("book") == book).select("lesson").distinct()
    mine = node_map.join(own, "lesson", "left_semi").groupBy("node").agg(F.max("owned").alias("owned"))
    others = node_map.join(own, "lesson", "left_anti").select("node").distinct()
    out = mine.where("not owned").select("node", F.lit("matched only").alias("reason"))
    out = out.union(mine.where("owned").join(others, "node", "left_semi").select("node", F.lit("shared").alias("reason")))
    ids = (mine.where("owned").select(F.col("node").alias("id")) if targets is None else targets.select("id")).distinct()
    if merges is not None:
        held = merges.join(own, "lesson", "left_semi").select("merge_run").distinct()
        mixed = merges.join(own, "lesson", "left_anti").join(held, "merge_run", "left_semi").select("merge_run").distinct()
        out = out.union(mixed.select("merge_run", F.lit("mixed merge")))
    for df, column, reason in ((mentions, "target_id", "external mention"), (links, "owner_id", "external evidence")):
        if df is not None:
            hit = df.where(F.col("source_id") != book).join(ids, F.col(column) == ids["id"], "left_semi")
            out = out.union(hit.select(column, F.lit(reason)).distinct())
    return out


def may_start(jobs: DataFrame, requests: DataFrame, most: int = 4) -> DataFrame:
    """L3, as a query: requests (book) that may start: no running job of the book, and fewer than ``most`` running in all."""
    busy = jobs.where("status = 'running'")
    n = busy.agg(F.count("*").alias("running"))
    return requests.join(busy.select("book"), "book", "left_anti").crossJoin(F.broadcast(n)).where(F.col("running") < most).select("book")


def batch_units(chunks: DataFrame, lessons: DataFrame) -> DataFrame:
    """The units of a book: its chunks if it has any, else its lessons."""
    return chunks.unionByName(lessons.join(chunks.select("book").distinct(), "book", "left_anti"))


def slots(units: DataFrame, order: Sequence[str], workers: int) -> DataFrame:
    """Worker slots: the unit's number modulo the number of workers, numbered inside each book."""
    n = F.row_number().over(Window.partitionBy("book").orderBy(*order)) - 1
    return units.withColumn("slot", (n % workers).cast("int"))


def stages_to_run(stages: Sequence[str], start: str | None = None, only: Sequence[str] = ()) -> list[str]:
    """Stages from ``start`` on, or the selected ones, in their order."""
    if only:
        return [s for s in stages if s in only]
    return list(stages[stages.index(start) :]) if start else list(stages)


def latest_state(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last state per key with first start and last end: one aggregate, no window."""
    g = events.groupBy(*keys).agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("completed", "blocked"), F.col("ts"))).alias("finished_at"),
    )
    return g


def step_states(stages: DataFrame) -> DataFrame:
    """Per job and step: blocked if any stage is, else active if any runs, else complete if all are done, else pending.

    stages: job, step, stage, status; retries (ids with a ``retry-`` prefix) count for their stage.
    """
    s = stages.withColumn("stage", F.regexp_replace("stage", r"^retry-\d*-?", ""))
    flag = lambda x: F.max(F.coalesce(F.col("status") == x, F.lit(False)))
    every = F.min(F.coalesce(F.col("status") == "completed", F.lit(False)))
    state = F.when(flag("blocked"), "blocked").when(flag("running"), "active").when(every, "complete").otherwise("pending")
    return s.groupBy("job", "step").agg(state.alias("state"))


def failed_anchors(runs: DataFrame) -> DataFrame:
    """Per job the anchors to resume: those whose last state is blocked."""
    last = runs.groupBy("job", "anchor").agg(F.max_by("status", "seq").alias("status"))
    return last.where("status = 'blocked'").groupBy("job").agg(F.array_sort(F.collect_list("anchor")).alias("anchors"))


def review_images(evidence: DataFrame, actions: DataFrame) -> DataFrame:
    """Decisions (id, action) on images: keep, relevance and review status; rows without one stay."""
    j = evidence.join(actions, "id", "left")
    act = F.col("action")
    return j.select(
        "id", F.when(act.isin("approve", "keep"), True).when(act == "reject", False).otherwise(F.col("keep")).alias("keep"),
        F.when(act.isin("approve", "keep"), "relevant").when(act == "reject", "decorative").otherwise(F.col("relevance")).alias("relevance"),
        F.when(act.isin("approve", "keep"), "approved").when(act == "reject", "rejected").otherwise(F.col("review_status")).alias("review_status"),
    )


#: Marks in file names and what they say.
SUBJECTS = (("物理|physics", "physics"), ("化学|chem", "chemistry"), ("生物|bio", "biology"), ("数学|math", "mathematics"), ("历史|history", "history"), ("地理|geograph", "geography"))
STAGES = (("小学|primary", "primary"), ("初中|junior", "junior-secondary"), ("高中|senior|必修", "senior-secondary"))


def file_metadata(name: str | Column) -> tuple[Column, Column, Column, Column]:
    """Subject, stage, grade and book id of a file name: first matching marks; the id is a slug with a hash suffix."""
    n = F.lower(X.col(name))
    pick = lambda table: F.coalesce(*[F.when(n.rlike(p), F.lit(v)) for p, v in table], F.lit("general"))
    grade = F.coalesce(F.when(n.rlike(r"(?:grade|g)[\s_-]*\d+"), F.regexp_extract(n, r"(?:grade|g)[\s_-]*(\d+)", 1)), F.lit(""))
    stem = F.regexp_replace(n, r"\.[a-z0-9]+$", "")
    slug = F.regexp_replace(F.regexp_replace(stem, r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return pick(SUBJECTS), pick(STAGES), grade, F.concat_ws("-", F.nullif(slug, F.lit("")), F.substring(F.sha2(X.col(name), 256), 1, 8))


def type_groups(nodes: DataFrame, groups: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Per group of types the number of nodes and of those with a selected type."""
    j = nodes.join(groups, "type", "left").withColumn("grp", F.coalesce("grp", F.lit("other")))
    return j.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("type").isin(*selected)).alias("n_selected"))
