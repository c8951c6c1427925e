"""Entity resolution and canonical merge."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quern import schemas as S
from quern.functions import text as X
from quern.functions import vectors as V
from quern.functions.similarity import best_ratio, merge_json_udf, term_similarity_udf
from quern.operators import graph as G


def terms_of(name: str | Column = "name", aliases: str | Column = "aliases") -> Column:
    """M6: the set of normalised terms of a node: its name and aliases."""
    every = F.concat(F.array(X.col(name)), F.coalesce(X.col(aliases), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, X.normalize_term), lambda t: t.isNotNull() & (t != "")))


def match_score(lexical: Column, semantic: Column, embedding: Column, subkind_match: Column, threshold: float = S.EMBEDDING_THRESHOLD) -> Column:
    """M7: weighted score, subkind penalty, floors for (nearly) equal terms or keys and for strong embeddings; at most 1."""
    w = S.LEXICAL_WEIGHT * lexical + S.SEMANTIC_WEIGHT * semantic + S.EMBEDDING_WEIGHT * embedding
    same = (lexical >= 0.98) | (semantic >= 1)
    w = F.when(~subkind_match & ~same, w * S.SUBKIND_PENALTY).otherwise(w)
    w = F.when(same, F.greatest(w, F.lit(S.EXACT_FLOOR))).otherwise(w)
    w = F.when((embedding >= threshold) & (lexical >= S.EMBEDDING_LEXICAL), F.greatest(w, F.lit(S.EMBEDDING_FLOOR))).otherwise(w)
    return F.least(w, F.lit(1.0))


def score_pairs(staged: DataFrame, canonical: DataFrame, pairs: DataFrame) -> DataFrame:
    """M5-M7 for given (raw_id, id) pairs. Both sides: id columns, kind, subkind, name, aliases, semantic_key, embedding."""
    pre = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    j = pairs.join(pre(staged, "s"), F.col("raw_id") == F.col("s_raw_id")).join(pre(canonical, "c"), F.col("id") == F.col("c_id"))
    a, b = X.subkind_code("s_subkind"), X.subkind_code("c_subkind")
    lexical = term_similarity_udf(terms_of("s_name", "s_aliases"), terms_of("c_name", "c_aliases"))
    semantic = F.when((F.col("s_semantic_key") != "") & (F.col("s_semantic_key") == F.col("c_semantic_key")), 1.0).otherwise(0.0)
    j = j.where("s_kind = c_kind").withColumn("lexical", lexical).withColumn("semantic", semantic).withColumn("embedding", V.cosine("s_embedding", "c_embedding"))
    ok = a.isNull() | b.isNull() | (a == b)
    return j.select("raw_id", "id", "lexical", "semantic", "embedding", match_score(F.col("lexical"), F.col("semantic"), F.col("embedding"), ok).alias("score"))


#: Characters of a term gram, vectors of a tile side, and rows that a call of the fold's task gets on average.
GRAM, TILE, GROUP = 5, 4096, 1000


def near_candidates(terms: DataFrame) -> DataFrame:
    """Pairs (kind, a, b, d_a, d_b), with repeats, among which are all pairs of distinct long terms (kind, t) with a ratio of 0.98.

    A ratio of 0.98 leaves at most 2 % of both lengths unmatched, so at most d = 4n / 98 insertions and deletions separate a
    term of n characters from the other. They spoil at most ``GRAM`` * d of its distinct grams; the first ``GRAM`` * d + 1 of
    both terms in one common order therefore share one. No pair is lost; terms under 25 characters must be equal. The order
    begins with the grams of the fewest terms, so what many terms have in common brings no pairs. Grams are their hashes.
    """
    n = F.char_length("t")
    t = terms.select("kind", "t", (4 * n / 98).cast("int").alias("d")).where("d >= 1")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.xxhash64(F.substring("t", i, F.lit(GRAM)))))
    t = t.select("kind", "t", "d", F.explode(grams).alias("g"))
    t = t.join(t.groupBy("kind", "g").agg(F.count("*").alias("n")), ["kind", "g"]).groupBy("kind", "t", "d").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("g"))
    t = t.select("kind", "t", "d", F.explode(F.slice("g", F.lit(1), GRAM * F.col("d") + 1)).alias("g")).where("g.n > 1").select("kind", "t", "d", "g.g")
    a, b = (t.select("kind", "g", F.col("t").alias(c), F.col("d").alias(f"d_{c}")) for c in "ab")
    return a.join(b, ["kind", "g"]).where("a < b")


def near_terms(terms: DataFrame) -> DataFrame:
    """Pairs (kind, a, b) of distinct long terms (kind, t) that can have a ratio of 0.98."""
    near = "abs(char_length(a) - char_length(b)) <= least(d_a, d_b) AND levenshtein(a, b) <= least(d_a, d_b)"
    return near_candidates(terms).where(near).select("kind", "a", "b").distinct()


def _tile_roots(sig: list, staged: np.ndarray, side: np.ndarray, terms: list, x: np.ndarray, threshold: float, block: int = 1024) -> dict[int, int]:
    """Union-find roots of rows of one tile that have a partner with an embedding floor; at least one of a pair is staged."""
    root = list(range(len(sig)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    own = bool((side == 2).all())
    left, right = (np.arange(len(sig)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    touched = set()
    for i in range(0, len(left), block):
        for j in range(i if own else 0, len(right), block):
            a, b = left[i : i + block], right[j : j + block]
            u, v = np.nonzero(unit[a] @ unit[b].T >= threshold - 1e-9)
            for p, q in zip(a[u].tolist(), b[v].tolist(), strict=True):
                if p == q or not (staged[p] or staged[q]) or find(p) == find(q):
                    continue
                if best_ratio(terms[p], terms[q], S.CONTAINMENT) >= S.EMBEDDING_LEXICAL or best_ratio(terms[q], terms[p], S.CONTAINMENT) >= S.EMBEDDING_LEXICAL:
                    root[find(p)] = find(q)
                    touched |= {p, q}
    return {p: find(p) for p in touched}


def embedding_links(rows: DataFrame, threshold: float = S.EMBEDDING_THRESHOLD, tile: int = TILE) -> DataFrame:
    """Edges (a, b) of signatures that an embedding floor can join: all pairs within a kind, in tiles of two groups of rows.

    rows: sig, kind, staged, terms, embedding. A tile compares blocks of unit vectors by matrix products, checks the lexical
    condition of what passes, and returns one edge per joined row, never its pairs. The products are quadratic in the
    distinct rows of a kind; the work is dealt in tiles that fit a task.
    """
    fine = (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & (V.norm("embedding") > 0)
    e = rows.where(F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("embedding"))
    sizes = e.groupBy("kind", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("groups"))
    e = e.join(sizes, ["kind", "dim"]).withColumn("g", F.pmod(F.xxhash64("sig"), F.col("groups")).cast("int"))
    e = e.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    side = F.when(F.col("g") == F.col("h"), 2).when(F.col("g") > F.col("h"), 1).otherwise(0)
    e = e.select("kind", "dim", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), "sig", "staged", side.alias("side"), "terms", "embedding")

    def run(t: pa.Table) -> pa.Table:
        x = np.array(t.column("embedding").to_pylist(), float)
        sig = t.column("sig").to_pylist()
        got = _tile_roots(sig, t.column("staged").to_numpy(), t.column("side").to_numpy(), t.column("terms").to_pylist(), x, threshold)
        return pa.table({"a": pa.array([sig[p] for p in got], pa.string()), "b": pa.array([sig[q] for q in got.values()], pa.string())})

    return e.groupBy("kind", "dim", "i", "j").applyInArrow(run, "a string, b string")


def link_components(rows: DataFrame) -> DataFrame:
    """(sig, component): signatures that a score of the review threshold or more can join, directly or through others.

    Under the default weights a pair reaches 0.74 only through an equal term or a ratio of 0.98, an equal semantic key, or
    an embedding floor: 0.45 * 0.98 + 0.20 stays below. Equal terms and keys meet in a node of the link graph, so a popular
    one costs an edge per signature and never a pair. rows: sig, kind, staged, terms, semantic_key, embedding, one per sig.
    """
    t = rows.select("sig", "kind", F.explode("terms").alias("t"))
    node = lambda mark, *c: F.concat_ws("|", F.lit(mark), *c)
    edges = t.select(node("r", "sig").alias("from_id"), node("t", "kind", "t").alias("to_id"))
    edges = edges.union(rows.where("semantic_key <> ''").select(node("r", "sig"), node("s", "kind", "semantic_key")))
    edges = edges.union(near_terms(t.select("kind", "t").distinct()).select(node("t", "kind", "a"), node("t", "kind", "b")))
    edges = edges.union(embedding_links(rows).select(node("r", "a"), node("r", "b")))
    comp = G.components(edges).where(F.startswith("id", F.lit("r|"))).select(F.substring("id", 3, 1 << 20).alias("sig"), "component")
    return rows.select("sig").join(comp, "sig", "left").withColumn("component", F.coalesce("component", "sig"))


def _cosine(a, b) -> float:
    if a is None or b is None or len(a) == 0 or len(a) != len(b):
        return 0.0
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0


def _score(s: dict, c: dict, threshold: float, lexical: Callable = best_ratio) -> float:
    lexical = lexical(s["terms"], c["terms"], S.CONTAINMENT)
    semantic = 1.0 if s["semantic_key"] and s["semantic_key"] == c["semantic_key"] else 0.0
    embedding = _cosine(s["embedding"], c["embedding"])
    w = S.LEXICAL_WEIGHT * lexical + S.SEMANTIC_WEIGHT * semantic + S.EMBEDDING_WEIGHT * embedding
    same = lexical >= 0.98 or semantic >= 1
    if s["code"] and c["code"] and s["code"] != c["code"] and not same:
        w *= S.SUBKIND_PENALTY
    if same:
        w = max(w, S.EXACT_FLOOR)
    if embedding >= threshold and lexical >= S.EMBEDDING_LEXICAL:
        w = max(w, S.EMBEDDING_FLOOR)
    return min(w, 1.0)


class Bounds:
    """Per row of a group: upper bounds of its scores with all rows, from cheap measures; exact scores are asked of few pairs.

    The ratio of two terms of p and q characters is at most 1 - x / (p + q), where x sums the differences of their counts of
    characters (in ``BINS`` classes). A term in another gives ``CONTAINMENT``, so no lexical bound is lower. Cosines by matrix
    products get a margin; floors are the constants that scores take, so a bound that equals a floor is exact.
    """

    BINS, MARGIN = 64, 1e-9

    def __init__(self, rows: list[dict], threshold: float):
        self.threshold, n = threshold, len(rows)
        terms = [(i, t) for i, r in enumerate(rows) for t in r["terms"] if t]
        self.owner = np.array([i for i, _ in terms], int)
        self.of = np.searchsorted(self.owner, np.arange(n + 1))
        self.counts = np.zeros((len(terms), self.BINS), np.int32)
        for j, (_, t) in enumerate(terms):
            np.add.at(self.counts[j], np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % self.BINS, 1)
        self.length = self.counts.sum(axis=1)
        keys: dict[str, int] = {}
        self.key = np.array([keys.setdefault(r["semantic_key"], len(keys)) if r["semantic_key"] else -1 - i for i, r in enumerate(rows)], int)
        self.unit: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.dim = [0 if r["embedding"] is None or any(x is None or x != x or abs(x) == float("inf") for x in r["embedding"]) else len(r["embedding"]) for r in rows]
        for d in set(self.dim) - {0}:
            at = np.flatnonzero(np.array(self.dim) == d)
            x = np.array([rows[i]["embedding"] for i in at], float)
            size = np.sqrt((x * x).sum(axis=1))
            self.unit[d] = at, x / np.where(size > 0, size, 1)[:, None]
        # Embeddings that no product tells anything of may have any cosine.
        self.odd = np.array([r["embedding"] is not None and len(r["embedding"]) > 0 and d == 0 for r, d in zip(rows, self.dim, strict=True)], bool)
        self.n = n

    def of_row(self, i: int) -> np.ndarray:
        ratio = np.zeros(self.n)
        for j in range(self.of[i], self.of[i + 1]):
            apart = np.abs(self.counts - self.counts[j]).sum(axis=1)
            np.maximum.at(ratio, self.owner, 1 - apart / (self.length + self.length[j]))
        ratio += self.MARGIN
        cosine = self.odd.astype(float)
        if self.odd[i]:
            cosine[:] = 1
        elif d := self.dim[i]:
            at, unit = self.unit[d]
            cosine[at] = unit @ unit[np.searchsorted(at, i)] + self.MARGIN
        same_key = self.key == self.key[i]
        if self.key[i] < 0:
            same_key[:] = False
        w = S.LEXICAL_WEIGHT * np.maximum(np.minimum(ratio, 1), S.CONTAINMENT) + S.SEMANTIC_WEIGHT * same_key + S.EMBEDDING_WEIGHT * np.maximum(cosine, 0) + self.MARGIN
        w = np.where((ratio >= 0.98) | same_key, np.maximum(w, S.EXACT_FLOOR), w)
        return np.minimum(np.where(cosine >= self.threshold, np.maximum(w, S.EMBEDDING_FLOOR), w), 1.0)


def fold(pdf: pd.DataFrame, match: float = S.MATCH_THRESHOLD, review: float = S.REVIEW_THRESHOLD, threshold: float = S.EMBEDDING_THRESHOLD) -> pd.DataFrame:
    """M8 on one group of distinct signatures: staged ones in order of their first rows; the first best candidate wins.

    Only the first row of a signature can become a candidate: a later one scores that row, or what it matched, over the threshold.
    So ``first`` rows are the outcomes of first rows, the others say what later rows get: from each place on where a better
    candidate has come, that candidate. A score under ``review`` is reported as zero: rows that cannot reach it are never compared.
    """
    rows = pdf.to_dict("records")
    for r in rows:
        r["terms"] = tuple(r["terms"]) if r["terms"] is not None else ()
    lexical = lru_cache(1 << 18)(best_ratio)
    bounds = Bounds(rows, threshold) if len(rows) > 1 else None
    for i, r in enumerate(rows):
        r["i"] = i
    held = sorted((r for r in rows if not r["staged"]), key=lambda r: r["row"])
    place = [r["i"] for r in held]
    out, again = [], []

    def best_of(s: dict, start: int, best: float = 0.0) -> Iterator[tuple[float, dict]]:
        if start == len(held):
            return
        bound = bounds.of_row(s["i"])[place[start:]]
        # What stays below every threshold is no candidate; of the others only those that can be better are scored.
        for k in np.flatnonzero((bound > best) & (bound >= min(match, review))).tolist():
            if bound[k] > best and (score := _score(s, held[start + k], threshold, lexical)) > best:
                best = score
                yield best, held[start + k]

    for s in sorted((r for r in rows if r["staged"]), key=lambda r: (r["created_at"], r["row"])):
        best, c = max(best_of(s, 0), key=lambda x: x[0], default=(0.0, None))
        at = (s["sig"], s["created_at"], s["row"])
        if c is not None and best >= match:
            out.append((*at, True, c["canonical_id"], "matched", best))
            out.append((*at, False, c["canonical_id"], "matched", best))
            if s["n"] > 1:
                again.append((s, len(held), best))
            continue
        held.append({**s, "canonical_id": s["new_id"]})
        place.append(s["i"])
        out.append((*at, True, s["new_id"], "review" if best >= review else "created", best if best >= review else 0.0))
        out.append((*at, False, s["new_id"], "matched", _score(s, s, threshold, lexical)))
    for s, start, best in again:
        out += [(s["sig"], c["created_at"], c["row"], False, c["canonical_id"], "matched", score) for score, c in best_of(s, start, best)]
    return pd.DataFrame(out, columns=["sig", "since_at", "since_row", "first", "canonical_id", "resolution", "score"])


def resolve(staged: DataFrame, canonical: DataFrame) -> DataFrame:
    """M8: raw_id, canonical_id, resolution (matched, created, review), score, for all staged rows.

    The result is that of one ordered fold over each kind (created_at, then raw_id), but only rows that can reach the review
    threshold together meet: they are linked through terms, keys and embeddings (``link_components``), and the fold runs inside
    each component, on distinct signatures only. All other rows, however many share a hub's signature, get their outcome by a
    join on the signature: the best candidate there was at their place. Rows without a term and a key match nothing.
    """
    cols = ["kind", "subkind", "name", "aliases", "semantic_key", "embedding"]
    s = staged.select(F.col("raw_id").alias("row"), F.lit(True).alias("staged"), "created_at", *cols, X.canonical_node_id("kind", "name", "subkind").alias("new_id"), F.lit("").alias("canonical_id"))
    c = canonical.select(F.col("id").alias("row"), F.lit(False).alias("staged"), F.lit("").alias("created_at"), *cols, F.lit("").alias("new_id"), F.col("id").alias("canonical_id"))
    rows = s.unionByName(c).withColumn("terms", terms_of()).withColumn("semantic_key", F.coalesce("semantic_key", F.lit(""))).withColumn("code", X.subkind_code("subkind"))
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("bare", (F.coalesce(F.size("terms"), F.lit(0)) <= 0) & (F.col("semantic_key") == ""))
    rows = rows.withColumn("sig", F.sha2(F.to_json(F.struct("kind", "terms", "semantic_key", "code", "embedding")), 256))
    fields = ["kind", "terms", "semantic_key", "code", "embedding", "new_id", "canonical_id"]
    one = rows.where("NOT bare").groupBy("sig", "staged").agg(F.min(F.struct("created_at", "row")).alias("at"), F.min_by(F.struct(*fields), F.struct("created_at", "row")).alias("r"), F.count("*").alias("n"))
    one = G.cut(one.select("sig", "staged", "at.created_at", "at.row", "n", "r.*"))
    comp = link_components(one.groupBy("sig").agg(F.max("staged").alias("staged"), *(F.first(k).alias(k) for k in ("kind", "terms", "semantic_key", "embedding"))))
    schema = "sig string, since_at string, since_row string, first boolean, canonical_id string, resolution string, score double"
    # Most components are single rows: a task gets some hundred components at once, whole ones, and folds each by itself.
    groups = -(-one.count() // GROUP) or 1
    told = one.drop("kind").join(comp, "sig").groupBy(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("group"))
    told = told.applyInPandas(lambda pdf: pd.concat([fold(part.drop(columns="component")) for _, part in pdf.groupby("component")]), schema)
    told = told.groupBy("sig").agg(
        F.max(F.when(F.col("first"), F.struct("since_at", "since_row", "canonical_id", "resolution", "score"))).alias("head"),
        F.array_sort(F.collect_list(F.when(~F.col("first"), F.struct("since_at", "since_row", "canonical_id", "resolution", "score")))).alias("later"),
    )
    got = rows.where("staged").select("sig", "created_at", "row", "new_id", "bare").join(told, "sig", "left")
    place = F.struct(F.col("created_at").alias("since_at"), F.col("row").alias("since_row"))
    before = F.filter("later", lambda e: F.struct(e["since_at"].alias("since_at"), e["since_row"].alias("since_row")) < place)
    own = F.when(F.col("row") == F.col("head.since_row"), F.col("head")).otherwise(F.get(before, F.size(before) - 1))
    fresh = F.struct(F.col("created_at").alias("since_at"), F.col("row").alias("since_row"), F.col("new_id").alias("canonical_id"), F.lit("created").alias("resolution"), F.lit(0.0).alias("score"))
    got = got.withColumn("o", F.when(F.col("bare"), fresh).otherwise(own))
    return got.select(F.col("row").alias("raw_id"), "o.canonical_id", "o.resolution", "o.score")


def existing_only(staged: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M9: (matches, errors) for rows that name their canonical node: unknown names are errors."""
    c = canonical.select(F.col("id").alias("canonical_id"))
    named = staged.select("raw_id", F.trim("existing_canonical_node_id").alias("canonical_id"))
    ok = named.join(c, "canonical_id", "left_semi").select("raw_id", "canonical_id", F.lit("matched").alias("resolution"), F.lit(1.0).alias("score"))
    return ok, named.join(c, "canonical_id", "left_anti").select("raw_id", "canonical_id", F.lit("unknown canonical node").alias("message"))


def merge_payloads(pairs: DataFrame) -> DataFrame:
    """Existing (e_*) and staged (s_*) payload columns merged: shorter name, texts, arrays, JSON, first filled scalars."""
    first = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), F.col(b))
    return pairs.select(
        "id", F.when(F.char_length("e_name") <= F.char_length("s_name"), F.col("e_name")).otherwise(F.col("s_name")).alias("name"), F.col("e_kind").alias("kind"),
        X.primary_subkind("e_subkind", "s_subkind").alias("subkind"), X.merge_text("e_definition", "s_definition").alias("definition"),
        X.unique_strings("e_aliases", "s_aliases", F.array("e_name", "s_name")).alias("aliases"), X.unique_strings("e_tags", "s_tags").alias("tags"),
        merge_json_udf("e_properties", "s_properties").alias("properties"), F.coalesce(first("e_scope", "s_scope"), F.lit("domain-specific")).alias("scope"), first("e_created_at", "s_created_at").alias("created_at"),
        F.lit("active").alias("status"),
    )


def subkind_classes(df: DataFrame) -> DataFrame:
    """The code of a subkind and the raw label that it stands for (null if they are the same)."""
    code = X.subkind_code("subkind")
    raw = F.trim("subkind")
    return df.withColumn("subkind_code", code).withColumn("raw_subkind", F.when((raw != "") & ~raw.eqNullSafe(code), raw))


def remap_refs(df: DataFrame, key: str, refs: str, table: DataFrame) -> DataFrame:
    """References through (raw_id, canonical_id), trimmed, distinct, in order; unknown ones stay."""
    r = df.select(key, F.posexplode(refs).alias("pos", "ref")).withColumn("ref", F.trim("ref")).where("ref <> ''")
    r = r.join(table.select(F.col("raw_id").alias("ref"), "canonical_id"), "ref", "left").withColumn("ref", F.coalesce("canonical_id", "ref"))
    g = r.groupBy(key).agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("pos", "ref")))["ref"]).alias(refs))
    return df.drop(refs).join(g, key, "left").withColumn(refs, F.coalesce(refs, F.array().cast("array<string>")))


def merge_edges(edges: DataFrame, table: DataFrame) -> DataFrame:
    """Staged edges with both ends through the node map; those with an unmapped end are dropped; id is a stable hash."""
    a = table.select(F.col("raw_id").alias("from_raw"), F.col("canonical_id").alias("from_id"))
    b = table.select(F.col("raw_id").alias("to_raw"), F.col("canonical_id").alias("to_id"))
    e = edges.join(a, "from_raw").join(b, "to_raw")
    return e.select(F.concat(F.lit("edge:"), X.stable_suffix("from_id", "type", "to_id")).alias("id"), "from_id", "to_id", "type", "raw_edge_id")


def evidence_ids(evidence: DataFrame) -> DataFrame:
    """Stable ids of staged evidence."""
    return evidence.withColumn("id", F.concat(F.lit("evidence:auto-"), X.stable_suffix("lesson_run_id", "raw_evidence_id", "anchor_ref", "excerpt")))


def merge_profiles(staged: DataFrame, existing: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per (node, domain) united stages and references, references of known evidence only."""
    both = existing.select("node_id", "domain", "school_stages", "source_refs", F.lit(0).alias("o")).unionByName(staged.select("node_id", "domain", "school_stages", "source_refs", F.lit(1).alias("o")))
    known = both.select("node_id", "domain", "o", F.posexplode_outer("source_refs").alias("pos", "ref")).join(evidence.select(F.col("id").alias("ref"), F.lit(True).alias("ok")), "ref", "left")
    refs = known.where("ok").groupBy("node_id", "domain").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("o", "pos", "ref")))["ref"]).alias("source_refs"))
    st = both.groupBy("node_id", "domain").agg(X.unique_strings(F.flatten(F.array_sort(F.collect_list(F.struct("o", "school_stages")))["school_stages"])).alias("school_stages"))
    return st.join(refs, ["node_id", "domain"], "left").withColumn("source_refs", F.coalesce("source_refs", F.array().cast("array<string>")))


def merge_mentions(mentions: DataFrame, table: DataFrame) -> DataFrame:
    """Mentions of mapped nodes with stable ids; those without a mapped target are dropped."""
    m = mentions.join(table.select(F.col("raw_id").alias("target_raw_id"), F.col("canonical_id").alias("target_id")), "target_raw_id")
    return m.select(F.concat(F.lit("mention:auto-"), X.stable_suffix("lesson_run_id", "raw_mention_id", F.lit("node"), "target_id")).alias("id"), "target_id", "raw_mention_id")


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Counts per resolution."""
    return resolved.groupBy("resolution").agg(F.count("*").alias("n"))


def normalize_staged_nodes(raw: DataFrame) -> DataFrame:
    """Staged nodes with synonyms (id, raw_node_id), defaults, enum filters; the first row of an id stays."""
    rid = F.coalesce(F.when(F.trim("raw_node_id") != "", F.trim("raw_node_id")), F.trim("id"))
    n = raw.withColumn("raw_node_id", rid).where(F.coalesce("raw_node_id", F.lit("")) != "")
    modes = F.filter(F.coalesce("learning_mode", F.array().cast("array<string>")), lambda m: m.isin(*S.LEARNING_MODES))
    implied = (
        F.when(F.col("kind") == "method", F.array(F.lit("procedural"))).when(F.col("kind").isin("representation", "property"), F.array(F.lit("factual"), F.lit("conceptual")))
        .when(F.col("kind").isin("entity", "event", "resource"), F.array(F.lit("factual"))).otherwise(F.array(F.lit("conceptual")))
    )
    n = n.withColumn("learning_mode", F.when(F.size(modes) > 0, F.array_distinct(modes)).otherwise(implied))
    n = n.withColumn("scope", F.when(F.trim("scope") != "", F.trim("scope")).otherwise("domain-specific"))
    keep = n.groupBy("raw_node_id").agg(F.min("pos").alias("pos"))
    return n.join(keep, ["raw_node_id", "pos"], "left_semi")


def _pick(df: DataFrame, *names: str, default: str | float | None = None) -> Column:
    """The first filled one of the columns that the table has (empty text and the number zero are not), else ``default``."""
    blank = lambda n: F.coalesce(F.col(n), F.lit(0)) == 0 if isinstance(df.schema[n].dataType, NumericType) else F.coalesce(F.col(n), F.lit("")) == ""
    filled = [F.when(~blank(n), F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*filled, F.lit(default).cast("string"))


def _text(df: DataFrame, *names: str, default: str = "") -> Column:
    return F.trim(_pick(df, *names, default=default))


def _strings(df: DataFrame, name: str) -> Column:
    return X.unique_strings(name) if name in df.columns else F.array().cast("array<string>")


def _members(df: DataFrame, name: str, known: Sequence[str]) -> Column:
    """The distinct values of an enumeration."""
    return F.filter(_strings(df, name), lambda v: v.isin(*known))


def _first_rows(df: DataFrame, key: str) -> DataFrame:
    """The first row (by ``pos``) of each key."""
    return df.join(df.groupBy(key).agg(F.min("pos").alias("pos")), [key, "pos"], "left_semi")


#: Words for edges without a direction.
UNDIRECTED = ("undirected", "bidirectional", "bi-directional", "two_way", "two-way", "mutual")


def normalize_staged_edges(raw: DataFrame) -> DataFrame:
    """Staged edges: synonyms (id, raw_edge_id; type, edge_type; from, to), direction words, defaults, first row of an id.

    ``error`` names what makes a row invalid (null: valid); callers refuse a lesson that has one. Columns that the table
    lacks count as empty.
    """
    both = F.when(F.lower(_text(raw, "directionality")).isin(*UNDIRECTED), "undirected").otherwise("directed")
    e = raw.select(
        "pos", _text(raw, "id", "raw_edge_id").alias("raw_edge_id"), _text(raw, "type", "edge_type").alias("type"), _text(raw, "from", "from_raw_node_id").alias("from_raw_node_id"),
        _text(raw, "to", "to_raw_node_id").alias("to_raw_node_id"), both.alias("directionality"), _pick(raw, "confidence", default=0.8).cast("double").alias("confidence"),
        _strings(raw, "source_refs").alias("source_refs"), _pick(raw, "status", default="draft").alias("status"), _text(raw, "notes").alias("notes"),
    )
    bad = F.when(F.col("raw_edge_id") == "", "missing id").when(~F.col("type").isin(*S.EDGE_TYPES), "unknown type")
    return _first_rows(e.withColumn("error", bad), "raw_edge_id")


def normalize_staged_profiles(raw: DataFrame) -> DataFrame:
    """Staged domain profiles: synonyms, known stages and roles only; ``error`` for missing ids and unknown domains."""
    p = raw.select(
        _text(raw, "id", "raw_profile_id").alias("raw_profile_id"), _text(raw, "node_id", "raw_node_id").alias("raw_node_id"), _text(raw, "domain").alias("domain"),
        _members(raw, "school_stages", S.SCHOOL_STAGES).alias("school_stages"), _members(raw, "curriculum_roles", S.CURRICULUM_ROLES).alias("curriculum_roles"),
        _strings(raw, "source_refs").alias("source_refs"), _pick(raw, "status", default="draft").alias("status"), _text(raw, "notes").alias("notes"),
    )
    bad = F.when((F.col("raw_profile_id") == "") | (F.col("raw_node_id") == ""), "missing id").when(~F.col("domain").isin(*S.DOMAINS), "unknown domain")
    return p.withColumn("error", bad)


def normalize_staged_mentions(raw: DataFrame, book: str, anchor: str) -> DataFrame:
    """Staged mentions with their lesson's book and anchor as defaults; the first row of an id."""
    m = raw.select(
        "pos", _text(raw, "id", "raw_mention_id").alias("raw_mention_id"), _pick(raw, "source_type", default="textbook").alias("source_type"), _pick(raw, "source_id", default=book).alias("source_id"),
        _pick(raw, "anchor_ref", default=anchor).alias("anchor_ref"), _pick(raw, "target_type", default="node").alias("target_type"), _text(raw, "target_id", "target_raw_id").alias("target_raw_id"),
        _pick(raw, "role", default="mentions").alias("role"), _strings(raw, "source_refs").alias("source_refs"), _pick(raw, "confidence", default=0.8).cast("double").alias("confidence"),
    )
    return _first_rows(m.withColumn("error", F.when(F.col("raw_mention_id") == "", "missing id")), "raw_mention_id")


def normalize_staged_evidence(raw: DataFrame, book: str, anchor: str) -> DataFrame:
    """Staged evidence with defaults; claims are trimmed, empty ones dropped, repeated ones kept."""
    claims = F.filter(F.transform("normalized_claims", lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != "")) if "normalized_claims" in raw.columns else F.array().cast("array<string>")
    page = lambda c: (F.col(c) if c in raw.columns else F.lit(None)).cast("int").alias(c)
    e = raw.select(
        _text(raw, "id", "raw_evidence_id").alias("raw_evidence_id"), _pick(raw, "source_type", default="textbook").alias("source_type"), _pick(raw, "source_id", default=book).alias("source_id"),
        _pick(raw, "anchor_ref", default=anchor).alias("anchor_ref"), _pick(raw, "source_path", default="").alias("source_path"), page("page_start"), page("page_end"), _text(raw, "excerpt").alias("excerpt"),
        _text(raw, "locator").alias("locator"), _pick(raw, "modality", default="text").alias("modality"), _pick(raw, "extraction_method", default="ocr").alias("extraction_method"),
        F.coalesce(claims, F.array().cast("array<string>")).alias("normalized_claims"),
    )
    return e.withColumn("error", F.when(F.col("raw_evidence_id") == "", "missing id"))


def normalize_staged_cards(raw: DataFrame) -> DataFrame:
    """Staged node cards: sections with default id and type, trimmed content and references; ``error`` for missing ids.

    sections: array of id, title, section_type, content, source_refs.
    """
    filled = lambda c, d: F.when(F.coalesce(c, F.lit("")) != "", F.trim(c)).otherwise(d)
    lines = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    one = lambda s: F.struct(
        filled(s["id"], F.lit("section")).alias("id"), F.trim(F.coalesce(s["title"], F.lit(""))).alias("title"), filled(s["section_type"], F.lit("other")).alias("section_type"),
        lines(s["content"]).alias("content"), X.unique_strings(s["source_refs"]).alias("source_refs"),
    )
    c = raw.select(
        _text(raw, "id", "raw_card_id").alias("raw_card_id"), _text(raw, "node_id", "raw_node_id").alias("raw_node_id"), _text(raw, "title").alias("title"), _text(raw, "summary").alias("summary"),
        _strings(raw, "source_refs").alias("source_refs"), F.transform(F.filter("sections", lambda s: s.isNotNull()), one).alias("sections"), _pick(raw, "status", default="draft").alias("status"),
    )
    return c.withColumn("error", F.when((F.col("raw_card_id") == "") | (F.col("raw_node_id") == ""), "missing id"))


def merge_cards(cards: DataFrame, nodes: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards of mapped nodes with references of canonical evidence, evidence links of the cards and of their sections).

    cards: raw_card_id, raw_node_id, title, summary, source_refs, sections; ``nodes`` and ``evidence``: raw_id, canonical_id.
    Links: owner_type, owner_id, evidence_id, ordinal; a section's owner is card:section, section-<number> without an id.
    Unknown references stay, as in M13.
    """
    held = cards.join(nodes.select(F.col("raw_id").alias("raw_node_id"), F.col("canonical_id").alias("node_id")), "raw_node_id")
    held = remap_refs(held, "raw_card_id", "source_refs", evidence)
    s = held.select("raw_card_id", F.posexplode("sections").alias("n", "s"))
    s = s.withColumn("section_id", F.when(F.coalesce(F.trim("s.id"), F.lit("")) != "", F.trim("s.id")).otherwise(F.concat(F.lit("section-"), "n")))
    s = remap_refs(s.select("raw_card_id", "n", "s", "section_id", F.struct("raw_card_id", "n").alias("k"), F.col("s.source_refs").alias("refs")), "k", "refs", evidence)
    fixed = s.groupBy("raw_card_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("s").withField("source_refs", F.col("refs")).alias("s"))))["s"].alias("sections"))
    out = held.drop("sections").join(fixed, "raw_card_id", "left")
    links = evidence_links(held.select(F.lit("node_card").alias("owner_type"), F.col("raw_card_id").alias("owner_id"), F.col("source_refs").alias("refs")))
    return out, links.unionByName(evidence_links(s.select(F.lit("node_card_section").alias("owner_type"), F.concat_ws(":", "raw_card_id", "section_id").alias("owner_id"), "refs")))


def evidence_links(owners: DataFrame) -> DataFrame:
    """Evidence links with ordinals from 1 of (owner_type, owner_id, refs)."""
    e = owners.select("owner_type", "owner_id", F.posexplode("refs").alias("pos", "evidence_id"))
    return e.select("owner_type", "owner_id", "evidence_id", (F.col("pos") + 1).alias("ordinal"))


def repair_mentions(nodes: DataFrame, refs: DataFrame, mentions: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with references filled where none was valid, new mentions for unmentioned nodes with references; confidence 0.8).

    refs: (raw_id, pos, ref) gathered from all artefacts.
    """
    ok = refs.join(evidence.select(F.col("id").alias("ref")), "ref", "left_semi")
    per = ok.groupBy("raw_id", "ref").agg(F.min("pos").alias("pos")).groupBy("raw_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref")))["ref"].alias("found"))
    own = nodes.select("raw_id", F.explode("source_refs").alias("ref")).join(evidence.select(F.col("id").alias("ref")), "ref", "left_semi").select("raw_id").distinct()
    n = nodes.join(per, "raw_id", "left").join(own.withColumn("has", F.lit(True)), "raw_id", "left")
    fixed = n.withColumn("source_refs", F.when(F.col("has").isNull() & F.col("found").isNotNull(), F.col("found")).otherwise(F.col("source_refs")))
    new = n.where("found is not null").join(mentions.select(F.col("target_id").alias("raw_id")).distinct(), "raw_id", "left_anti")
    new = new.select(F.concat(F.lit("mention:auto:"), "raw_id").alias("id"), F.col("raw_id").alias("target_id"), F.col("found").alias("source_refs"), F.lit(0.8).alias("confidence"))
    return fixed.drop("found", "has"), new


def first_json_object(text: str | None) -> str | None:
    """The first JSON object in a model's answer: a fenced block, else the first balanced braces that parse."""
    if not text:
        return None
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in [*fenced, text]:
        at = part.find("{")
        while at >= 0:
            depth, quoted, skip = 0, False, False
            for i in range(at, len(part)):
                c = part[i]
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = c == "\\", c != '"'
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        try:
                            return json.dumps(json.loads(part[at : i + 1]), ensure_ascii=False)
                        except ValueError:
                            break
            at = part.find("{", at + 1)
    return None


def parse_answers(df: DataFrame, column: str) -> DataFrame:
    """M23 over a column, Arrow-batched."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(json=p[column].map(first_json_object))

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("json", T.StringType())]))


def strict_bundle(edges: DataFrame, nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges with known ends, type and anchor, once per (from, to, type, anchor)."""
    e = edges.where(F.col("type").isin(*S.EDGE_TYPES))
    e = e.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi").join(anchors.select("anchor"), "anchor", "left_semi")
    return e.groupBy("from_id", "to_id", "type", "anchor").agg(F.min("id").alias("id"))


def assemble_artifacts(nodes: DataFrame, evidence: DataFrame, cards: DataFrame) -> DataFrame:
    """Nodes with evidence (first excerpt as definition where none is given) and a card flag."""
    first = evidence.groupBy("node_id").agg(F.min(F.struct("id", "excerpt")).alias("f"), F.count("*").alias("n"))
    j = nodes.join(first.withColumnRenamed("node_id", "id"), "id", "left").join(cards.select(F.col("node_id").alias("id"), F.lit(True).alias("has_card")).distinct(), "id", "left")
    return j.select("id", F.coalesce(F.when(F.trim("definition") != "", F.col("definition")), X.excerpt("f.excerpt", 180), F.lit("")).alias("definition"), F.coalesce("n", F.lit(0)).alias("n_evidence"), F.coalesce("has_card", F.lit(False)).alias("has_card"))


def drop_evidence(df: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """References without dropped evidence ids; a row that loses all keeps an empty array."""
    r = df.select(key, F.posexplode("source_refs").alias("pos", "ref")).join(dropped.select(F.col("id").alias("ref")), "ref", "left_anti")
    g = r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ref")))["ref"].alias("kept"))
    return df.join(g, key, "left").withColumn("source_refs", F.coalesce("kept", F.array().cast("array<string>"))).drop("kept")


def keep_image(label: str | Column) -> Column:
    """Keep relevant and uncertain images, drop the rest."""
    return X.col(label).isin("relevant", "uncertain", "core", "supporting")


def cache_key(*parts: str | Column) -> Column:
    """Cache key of a decision: sha256 over its inputs."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(X.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def with_template(nodes: DataFrame, templates: DataFrame, default: str) -> DataFrame:
    """The template of a node's subject, else the default one: a join with a small configuration table."""
    t = templates.select(F.col("subject"), F.col("template").alias("own"))
    return nodes.join(t, "subject", "left").withColumn("template", F.coalesce("own", F.lit(default))).drop("own")


def lesson_hash(text: str) -> str:
    """Driver-side form of ``stable_suffix`` for one value."""
    return hashlib.sha1(text.encode()).hexdigest()[:12]
