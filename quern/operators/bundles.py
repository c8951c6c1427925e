"""Lesson bundles to artefact tables (M25), and the image filter over them.

All bundles are assembled at once: every table is keyed by ``lesson`` and ``pos`` (the place in its list), every reference
is settled by one equi-join on (lesson, key), and what stays open is backfilled by an anti-join. "First" and "last" are
aggregates over ``pos``, never an order of rows, so a lesson of any size is no special case.

A name of a node in an edge is settled by a cascade: an exact key (id, name or alias), else the same key normalised; where
several nodes claim a key, the last claim counts. Each (edge, side) offers its keys with a priority, all of them meet the claims in one
join, and the best hit is an aggregate.

Tables of a bundle, all with ``lesson`` and all but the first with ``pos`` (from 1):

* lessons: book_id, anchor_ref, title, source_id, source_path, page_start, page_end, subject, school_stage, grade_band,
  content_role, extraction_policy, disposition (``no_knowledge`` or other), md;
* nodes: id, name, title, label, term, kind, subkind, definition, scope, notes, aliases, domains, knowledge_form, learning_mode, tags;
* units: anchor, excerpt, locator, modality, node_ids;
* edges: from_key, to_key, type, evidence_anchor, directionality, confidence, notes;
* profiles: node_id, domain, school_stages, curriculum_roles;
* cards: node_id, evidence_anchor, summary, definition, essence, key_points, example, application, misconception;
* hints (found in the text, not by the model): excerpt, locator, modality.

Rows of a lesson that is not in ``lessons`` are left out. Null texts count as empty, null arrays as empty arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X
from quern.functions.similarity import nfkc_udf

TABLES = ("nodes", "evidence", "mentions", "edges", "profiles", "cards")
#: Section ids, titles and kinds of a card, the text of a backfilled misconception and of a missing decision.
SECTIONS = (("definition", "定义", "definition"), ("essence", "核心本质", "essence"), ("key-points", "关键要点", "key_points"), ("example", "示例", "example"), ("application", "应用", "application"), ("misconception", "常见误解", "misconception"))
MISCONCEPTION, UNDECIDED = "需结合证据原文确认适用范围。", "图片相关性判断缺少结果，默认保留。"
#: Prefixes of node ids that are not shown, and where the first clause of a definition ends.
ID_PREFIX, CLAUSE_END = r"(?i)^(node|n|concept|entity|property|prop|rule|method|representation|event|e|m|p)[:_-]+", "[。；;，,：:\n]"
NAME_CHARS, CLAIM_CHARS, BACKFILL_CHARS = 32, 120, 600


def strip(c: str | Column) -> Column:
    """Without white space (Unicode) at both ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(X.col(c).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def strings(c: str | Column) -> Column:
    """The trimmed non-empty strings of an array, repeats included."""
    return F.filter(F.transform(F.coalesce(X.col(c), F.array().cast("array<string>")), strip), lambda x: x != "")


def either(*cs: Column) -> Column:
    """The first that is not empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def or_default(c: str, default: str) -> Column:
    return F.when(F.size(strings(c)) > 0, strings(c)).otherwise(F.array(F.lit(default))).alias(c)


def token(c: Column) -> Column:
    """A text as a part of an id: letters, digits, ``.``, ``_`` and ``-`` only."""
    t = F.regexp_replace(strip(nfkc_udf(c)), r"[^\p{L}\p{N}._-]+", "-")
    return either(F.regexp_replace(F.regexp_replace(t, "-{2,}", "-"), r"^[._-]+|[._-]+$", ""), F.lit("item"))


def cut(c: Column, limit: int) -> Column:
    """M25's excerpt: white space collapsed; over ``limit`` characters cut before it, with an ellipsis in its place."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…")))


def inferred_name() -> Column:
    """name, title, label, term, first alias, first clause of the definition (32 characters), or the id in words."""
    clause = strip(F.split("definition", CLAUSE_END)[0])
    short = F.when(F.char_length(clause) > NAME_CHARS, strip(F.substring(clause, 1, NAME_CHARS))).otherwise(clause)
    words = strip(F.regexp_replace(F.regexp_replace("id", ID_PREFIX, ""), "[_-]+", " "))
    return either(F.col("name"), *[strip(c) for c in ("title", "label", "term")], F.coalesce(F.get(strings("aliases"), F.lit(0)), F.lit("")), short, words)


def _nodes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept nodes, issues): the first row of each id; rows without id or name go."""
    clean = raw.select("*").withColumns({c: strip(c) for c in ("id", "name", "definition")}).withColumn("own", F.col("name")).withColumn("name", inferred_name())
    lost = (F.col("id") == "") | (F.col("name") == "")
    said = F.array(
        F.when(lost, F.concat(F.lit("Dropped model node with missing id/name: "), F.to_json(F.struct("id", F.col("own").alias("name"))))),
        F.when(~lost & (F.col("own") == ""), F.concat(F.lit("Backfilled missing name for model node "), "id", F.lit("."))),
        F.when(~lost & (F.col("definition") == ""), F.concat(F.lit("Backfilled empty definition for model node "), "id", F.lit("."))),
    )
    issues = clean.select("lesson", "pos", F.posexplode(said).alias("k", "issue")).where("issue IS NOT NULL")
    kept = clean.where(~lost).groupBy("lesson", "id").agg(F.min_by(F.struct(*[c for c in clean.columns if c not in ("lesson", "id", "own")]), "pos").alias("r")).select("lesson", "id", "r.*")
    return kept.select(
        "lesson", "pos", "id", "name", strip("kind").alias("kind"), "subkind", either(F.col("definition"), F.col("name")).alias("definition"), strings("aliases").alias("aliases"),
        or_default("domains", "general"), or_default("knowledge_form", "propositional"), or_default("learning_mode", "conceptual"),
        either(F.coalesce("scope", F.lit("")), F.lit("domain-specific")).alias("scope"), strings("tags").alias("tags"), strip("notes").alias("notes"), F.array().cast("array<string>").alias("source_refs"),
    ), issues


def _evidence(lessons: DataFrame, units: DataFrame, hints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Units with anchor and excerpt, then hints, then a synthetic row where a lesson has nodes but no evidence."""
    head = lessons.select("lesson", "book", "disposition", F.col("title"), "anchor_ref", "md")
    valid = units.where("anchor <> '' AND excerpt <> ''")
    own = valid.join(head, "lesson").select("lesson", F.lit(0).alias("part"), "pos", F.concat_ws(":", F.lit("evidence"), "book", F.col("pos").cast("string")).alias("id"), "excerpt", strip("locator").alias("locator"), either(F.coalesce("modality", F.lit("")), F.lit("text")).alias("modality"), F.lit("model").alias("extraction_method"))
    before = valid.groupBy("lesson").agg(F.count("*").alias("n"))
    found = hints.withColumn("excerpt", strip("excerpt")).where("excerpt <> ''").join(head.where("disposition <> 'no_knowledge'"), "lesson").join(before, "lesson", "left")
    found = found.select("lesson", F.lit(1).alias("part"), "pos", F.concat_ws(":", F.lit("evidence"), "book", F.lit("hint"), (F.coalesce("n", F.lit(0)) + F.col("pos")).cast("string")).alias("id"), "excerpt", strip("locator").alias("locator"), "modality", F.lit("markdown_hint").alias("extraction_method"))
    every = own.unionByName(found)
    bare = head.where("disposition <> 'no_knowledge'").join(nodes.select("lesson").distinct(), "lesson", "left_semi").join(every.select("lesson"), "lesson", "left_anti")
    made = either(cut(F.coalesce("md", F.lit("")), BACKFILL_CHARS), strip("title"), F.col("anchor_ref"))
    bare = bare.select("lesson", F.lit(2).alias("part"), F.lit(1).alias("pos"), F.concat_ws(":", F.lit("evidence"), "book", F.lit("backfill:1")).alias("id"), made.alias("excerpt"), F.lit("lesson-chunk").alias("locator"), F.lit("text").alias("modality"), F.lit("model_missing_evidence_backfill").alias("extraction_method"))
    order = Window.partitionBy("lesson").orderBy("part", "pos")
    synthetic = F.when(F.col("part") == 2, F.struct(F.lit(True).alias("synthetic"), F.lit(True).alias("quality_excluded"), F.lit("pending").alias("review_status")))
    out = every.unionByName(bare).withColumn("pos", F.row_number().over(order)).withColumn("review", synthetic)
    place = lessons.select("lesson", F.lit("textbook").alias("source_type"), "source_id", "anchor_ref", "source_path", "page_start", "page_end", "content_role", "extraction_policy")
    return out.drop("part").join(place, "lesson").withColumn("normalized_claims", F.array(F.substring("excerpt", 1, CLAIM_CHARS)))


def _section(i: int, content: Column, refs: Column, backfilled: bool) -> Column:
    key, title, kind = SECTIONS[i]
    return F.struct(F.lit(key).alias("id"), F.lit(title).alias("title"), F.lit(kind).alias("section_type"), content.alias("content"), refs.alias("source_refs"), F.lit(backfilled).alias("backfilled"))


def _refs(c: str) -> Column:
    """An array of one reference, or an empty one."""
    return F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


def assemble(lessons: DataFrame, nodes: DataFrame, units: DataFrame, edges: DataFrame, profiles: DataFrame, cards: DataFrame, hints: DataFrame) -> dict[str, DataFrame]:
    """The artefact tables of all bundles: nodes, evidence, mentions, edges, profiles, cards, and issues, counts.

    Order of ``issues`` is (lesson, part, pos, k). ``counts`` has a row per lesson, also for one without anything.
    """
    lessons = lessons.withColumn("book", token(F.col("book_id"))).withColumn("disposition", F.when(F.col("disposition") == "no_knowledge", "no_knowledge").otherwise("extracted"))
    only = lambda df: df.join(lessons.select("lesson"), "lesson", "left_semi")
    kept, issues = _nodes(only(nodes))
    units = only(units).withColumns({c: strip(c) for c in ("anchor", "excerpt")})
    evidence = _evidence(lessons, units, only(hints), kept)
    book = lessons.select("lesson", "book", "source_id", "anchor_ref")

    # An anchor of several units means the last of them.
    own = evidence.where("extraction_method = 'model'")
    anchors = units.where("anchor <> '' AND excerpt <> ''").groupBy("lesson", "anchor").agg(F.max("pos").alias("at"))
    anchors = anchors.join(book.select("lesson", "book"), "lesson").select("lesson", "anchor", F.concat_ws(":", F.lit("evidence"), "book", F.col("at").cast("string")).alias("evidence_id"))
    ids = kept.select("lesson", F.col("id").alias("node_id"))

    told = units.join(anchors, ["lesson", "anchor"]).select("lesson", "pos", "evidence_id", F.posexplode(strings("node_ids")).alias("k", "node_id")).join(ids, ["lesson", "node_id"], "left_semi")
    mentions = told.join(book, "lesson").select(
        "lesson", "pos", "k", F.concat_ws(":", F.lit("mention"), "book", token(F.col("node_id")), F.col("pos").cast("string")).alias("id"), F.lit("textbook").alias("source_type"), "source_id", "anchor_ref",
        F.lit("node").alias("target_type"), F.col("node_id").alias("target_id"), F.when(F.col("pos") == 1, "defines").otherwise("focuses_on").alias("role"), F.array("evidence_id").alias("source_refs"), F.lit(0.88).alias("confidence"),
    )
    first = told.groupBy("lesson", "node_id").agg(F.min_by("evidence_id", F.struct("pos", "k")).alias("ref"))

    # Claims of keys: id, name, aliases, each also normalised; the last node and claim of a key counts.
    words = F.concat(F.array("id", "name"), "aliases")
    claims = F.flatten(F.transform(words, lambda w: F.array(w, X.normalize_term(w))))
    claimed = kept.select("lesson", "id", "pos", F.posexplode(claims).alias("k", "key")).groupBy("lesson", "key").agg(F.max_by("id", F.struct("pos", "k")).alias("node_id"))
    edges = only(edges).withColumns({c: strip(c) for c in ("from_key", "to_key", "type", "evidence_anchor")})
    offers = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(i).alias("rank"), key.alias("key")) for side in ("from", "to") for i, key in enumerate((F.col(f"{side}_key"), X.normalize_term(f"{side}_key")))])).alias("o")
    hits = edges.select("lesson", "pos", offers).select("lesson", "pos", "o.*").join(claimed, ["lesson", "key"]).groupBy("lesson", "pos")
    side = lambda s: F.min_by(F.when(F.col("side") == s, F.col("node_id")), F.when(F.col("side") == s, F.col("rank"))).alias(f"{s}_id")
    settled = edges.where(F.col("type").isin(*S.EDGE_TYPES)).join(hits.agg(side("from"), side("to")).where("from_id IS NOT NULL AND to_id IS NOT NULL"), ["lesson", "pos"])
    settled = settled.join(anchors.withColumnRenamed("anchor", "evidence_anchor"), ["lesson", "evidence_anchor"], "left")
    good = F.col("confidence").isNotNull() & (F.col("confidence") != 0) & ~F.isnan(F.col("confidence").cast("double"))
    out_edges = settled.select(
        "lesson", "pos", F.concat(F.lit("edge:auto-"), X.stable_suffix("from_id", "type", "to_id")).alias("id"), "type", "from_id", "to_id", either(F.coalesce("directionality", F.lit("")), F.lit("directed")).alias("directionality"),
        F.when(good, F.col("confidence").cast("double")).otherwise(0.8).alias("confidence"), _refs("evidence_id").alias("source_refs"), strip("notes").alias("notes"),
    )
    lost = edges.groupBy("lesson").agg(F.count("*").alias("n")).join(out_edges.groupBy("lesson").agg(F.count("*").alias("k")), "lesson", "left").withColumn("lost", F.col("n") - F.coalesce("k", F.lit(0))).where("lost > 0")
    text = F.concat(F.lit("Dropped "), F.col("lost").cast("string"), F.lit(" edges that could not be resolved to valid node ids or relation types."))
    issues = issues.withColumn("part", F.lit(0)).unionByName(lost.select("lesson", F.lit(0).alias("pos"), F.lit(0).alias("k"), text.alias("issue"), F.lit(1).alias("part")))

    stage = lessons.select("lesson", "school_stage", "subject", "grade_band", F.col("title").alias("lesson_title"))
    given = only(profiles).withColumns({c: strip(c) for c in ("node_id", "domain")}).where(F.col("domain").isin(*S.DOMAINS)).join(ids, ["lesson", "node_id"], "left_semi")
    profile = lambda: F.concat(F.lit("domain-profile:auto-"), X.stable_suffix("node_id", "domain")).alias("id")
    explicit = given.join(first, ["lesson", "node_id"], "left").join(stage, "lesson").select("lesson", "pos", profile(), "node_id", "domain", X.unique_strings(F.array("school_stage"), "school_stages").alias("school_stages"), or_default("curriculum_roles", "core"), _refs("ref").alias("source_refs"), F.lit(False).alias("backfilled"))
    bare = kept.select("lesson", "pos", F.col("id").alias("node_id"), "domains").join(given, ["lesson", "node_id"], "left_anti").join(first, ["lesson", "node_id"], "left").join(stage, "lesson")
    default = F.when(F.col("subject").isin(*S.DOMAINS), F.col("subject")).otherwise("general")
    valid = F.filter("domains", lambda d: d.isin(*S.DOMAINS))
    domain = F.when((F.size(valid) == 0) | F.array_contains(valid, default), default).otherwise(F.get(valid, F.lit(0)))
    bare = bare.withColumn("domain", domain).select("lesson", "pos", profile(), "node_id", "domain", F.array("school_stage").alias("school_stages"), F.array(F.lit("core")).alias("curriculum_roles"), _refs("ref").alias("source_refs"), F.lit(True).alias("backfilled"))
    out_profiles = explicit.unionByName(bare)

    own_cards = only(cards).withColumns({c: strip(c) for c in ("node_id", "evidence_anchor", "summary", "definition", "essence", "example", "application", "misconception")})
    named = kept.select("lesson", F.col("id").alias("node_id"), F.col("name").alias("title"), F.col("definition").alias("node_definition"), F.col("pos").alias("node_pos"))
    own_cards = own_cards.join(named, ["lesson", "node_id"]).join(anchors.withColumnRenamed("anchor", "evidence_anchor"), ["lesson", "evidence_anchor"], "left")
    own_cards = own_cards.join(own.select("lesson", F.col("id").alias("evidence_id"), "excerpt"), ["lesson", "evidence_id"], "left")
    card = lambda: F.concat(F.lit("node-card:auto-"), X.stable_suffix("node_id")).alias("id")
    one = lambda c: F.array(c)
    texts = [one(either(F.col("definition"), strip("excerpt"))), one(F.col("essence")), strings("key_points"), one(F.col("example")), one(F.col("application")), one(F.col("misconception"))]
    full = own_cards.select("lesson", "pos", card(), "node_id", "title", either(F.col("summary"), F.col("node_definition")).alias("summary"), F.array(*[_section(i, t, _refs("evidence_id"), False) for i, t in enumerate(texts)]).alias("sections"), _refs("evidence_id").alias("source_refs"), F.lit(False).alias("backfilled"))
    bare = named.join(own_cards, ["lesson", "node_id"], "left_anti").join(first, ["lesson", "node_id"], "left").join(stage, "lesson")
    texts = [one(F.col("node_definition"))] * 3 + [one(F.col("title")), one(F.coalesce("lesson_title", F.lit(""))), one(F.lit(MISCONCEPTION))]
    bare = bare.select("lesson", F.col("node_pos").alias("pos"), card(), "node_id", "title", F.col("node_definition").alias("summary"), F.array(*[_section(i, t, _refs("ref"), True) for i, t in enumerate(texts)]).alias("sections"), _refs("ref").alias("source_refs"), F.lit(True).alias("backfilled"))
    out = {"nodes": kept, "evidence": evidence, "mentions": mentions, "edges": out_edges, "profiles": out_profiles, "cards": full.unionByName(bare)}
    return out | {"issues": issues, "counts": counts(lessons, out)}


def counts(lessons: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """lesson and the number of its rows of every artefact table."""
    each = reduce(DataFrame.unionByName, [df.groupBy("lesson").agg(F.count("*").alias("n")).withColumn("name", F.lit(t)) for t, df in tables.items() if t in TABLES])
    got = each.groupBy("lesson").agg(*[F.sum(F.when(F.col("name") == t, F.col("n"))).alias(f"n_{t}") for t in TABLES])
    return lessons.select("lesson").join(got, "lesson", "left").na.fill(0)


# --- the image filter ----------------------------------------------------------------------------------------------


def filter_images(tables: dict[str, DataFrame], decisions: DataFrame) -> dict[str, DataFrame]:
    """Drop the image evidence that is not kept, prune every reference to it, repair what became bare.

    ``decisions``: lesson, id, keep, relevance, reason; images without one are kept as uncertain. Lessons that lose nothing
    stay as they are. Elsewhere, edges and mentions that had references and lose all go; every other empty list (nodes,
    edges, profiles, cards and their sections) gets the lesson's first remaining evidence that is no image (else its
    first), and a node without a mention gets one. Afterwards no reference to a dropped row is left; a second pass
    changes nothing. A lesson's dropped ids travel as one short array, so each table meets them in one join on lesson.
    """
    evidence = tables["evidence"]
    image = F.lower(F.coalesce("modality", F.lit(""))) == "image"
    said = decisions.groupBy("lesson", "id").agg(F.min(F.struct("keep", "relevance", "reason")).alias("d"))
    judged = evidence.join(said, ["lesson", "id"], "left")
    drops = image & (F.col("d.keep") == F.lit(False))
    undecided = F.struct(F.lit(True).alias("keep"), F.lit("uncertain").alias("relevance"), F.lit(UNDECIDED).alias("reason"))
    left = judged.where(~F.coalesce(drops, F.lit(False))).withColumn("image_relevance", F.when(image, F.coalesce("d", undecided))).drop("d")
    gone = judged.where(drops).groupBy("lesson").agg(F.array_sort(F.collect_set("id")).alias("dropped"))
    issues = judged.where(drops).select("lesson", F.lit(2).alias("part"), "pos", F.lit(0).alias("k"), F.concat(F.lit("Filtered image evidence "), "id", F.lit(": "), F.coalesce("d.reason", F.lit(""))).alias("issue"))
    head = left.groupBy("lesson").agg(F.min_by("id", F.struct(image, "pos")).alias("fallback"), F.min_by(F.struct("source_type", "source_id", "anchor_ref"), "pos").alias("head"))
    # Repair needs nodes and evidence; without them a touched lesson is only pruned.
    there = tables["nodes"].select("lesson").distinct().withColumn("repair", F.lit(True))
    touched = gone.join(head, "lesson", "left").join(there, "lesson", "left").withColumn("fallback", F.when(F.col("repair"), F.col("fallback"))).drop("repair")

    pruned = lambda c: F.filter(strings(c), lambda r: ~F.array_contains("dropped", r))

    def mended(refs: Column) -> Column:
        return F.when((F.size(refs) == 0) & F.col("fallback").isNotNull(), F.array("fallback")).otherwise(refs)

    def apply(df: DataFrame, repair: bool, vanish: bool) -> DataFrame:
        met = df.join(touched.select("lesson", "dropped", "fallback"), "lesson", "left")
        hit = F.col("dropped").isNotNull()
        if vanish:
            met = met.where(~(hit & (F.size(strings("source_refs")) > 0) & (F.size(pruned("source_refs")) == 0)) | ~hit)
        fix = mended if repair else (lambda c: c)
        met = met.withColumn("source_refs", F.when(hit, fix(pruned("source_refs"))).otherwise(F.col("source_refs")))
        if "sections" in df.columns:
            whole = F.transform("sections", lambda s: s.withField("source_refs", fix(F.filter(strings(s["source_refs"]), lambda r: ~F.array_contains("dropped", r)))))
            met = met.withColumn("sections", F.when(hit, whole).otherwise(F.col("sections")))
        return met.select(*df.columns)

    out = {t: apply(tables[t], repair=t != "mentions", vanish=t in ("edges", "mentions")) for t in TABLES if t != "evidence"}
    said = out["mentions"].where(F.size("source_refs") > 0).select("lesson", F.col("target_id").alias("id"))
    bare = tables["nodes"].select("lesson", "id", "pos").join(said, ["lesson", "id"], "left_anti").join(touched.where("fallback IS NOT NULL"), "lesson")
    name = either(F.substring(F.regexp_replace("id", r"[^A-Za-z0-9_.:-]+", "-"), 1, 96), F.lit("node"))
    more = bare.select(
        "lesson", (F.col("pos") + (1 << 30)).alias("pos"), F.lit(0).alias("k"), F.concat(F.lit("mention:image-filter-backfill:"), name).alias("id"), F.col("head.source_type"), F.col("head.source_id"), F.col("head.anchor_ref"),
        F.lit("node").alias("target_type"), F.col("id").alias("target_id"), F.lit("mentions").alias("role"), F.array("fallback").alias("source_refs"), F.lit(0.68).alias("confidence"),
    )
    out |= {"evidence": left, "mentions": out["mentions"].unionByName(more)}
    return out | {"issues": tables["issues"].unionByName(issues) if "issues" in tables else issues}
