"""Operators against plain versions and beyond the sizes where they once stopped."""

import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions.similarity import best_ratio, dice, dice_column
from quern.operators import cluster as C
from quern.operators import graph as G
from quern.operators import normalize as N
from quern.operators import outline as O
from quern.operators import resolve as M
from quern.sources import services as V

NODE = "id string, kind string, subkind string, name string, aliases array<string>, semantic_key string, embedding array<double>"


# --- M8 against one fold over each kind ------------------------------------------------------------------------------


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    na, nb = (sum(x * x for x in v) ** 0.5 for v in (a, b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0


def plain_score(s, c):
    lex = best_ratio(s["terms"], c["terms"], S.CONTAINMENT)
    sem = float(bool(s["key"]) and s["key"] == c["key"])
    emb = cosine(s["embedding"], c["embedding"])
    w = 0.45 * lex + 0.35 * sem + 0.2 * emb
    same = lex >= 0.98 or sem == 1
    if s["code"] and c["code"] and s["code"] != c["code"] and not same:
        w *= 0.85
    return min(1.0, max(w, 0.94 if same else 0.0, 0.9 if emb >= 0.92 and lex >= 0.65 else 0.0))


def plain_resolve(staged, canonical):
    out, held = {}, {}
    for c in sorted(canonical, key=lambda r: r["id"]):
        held.setdefault(c["kind"], []).append((c, c["id"]))
    for s in sorted(staged, key=lambda r: (r["created_at"], r["id"])):
        best, at = 0.0, None
        for c, name in held.get(s["kind"], []):
            if (x := plain_score(s, c)) > best:
                best, at = x, name
        if best >= 0.88:
            out[s["id"]] = (at, "matched", round(best, 9))
        else:
            held.setdefault(s["kind"], []).append((s, None))
            held[s["kind"]][-1] = (s, s["new"])
            out[s["id"]] = (s["new"], "review" if best >= 0.74 else "created", round(best, 9) if best >= 0.74 else 0.0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_equals_one_fold_over_each_kind(spark, seed):
    rng = random.Random(seed)
    bases = ["kinetic energy", "potential energy", "water cycle", "photosynthesis in green plants and other organisms", "a law of motion and of the forces that act on bodies"]

    def name():
        n = rng.choice(bases)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 6])):
            i = rng.randrange(len(n))
            n = rng.choice([n[:i] + n[i + 1 :], n[:i] + rng.choice("xyz") + n[i:], n + "s", n.upper()])
        return n

    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    vector = lambda: [x + rng.gauss(0, rng.choice([0.05, 0.3])) for x in rng.choice(centres)] if rng.random() < 0.7 else rng.choice([None, [], [0.0] * 8])
    rows = [
        {"id": f"r{i:03}", "kind": rng.choice(["concept", "rule"]), "subkind": rng.choice(["", "wave", "light"]), "name": name(), "aliases": [name()] if rng.random() < 0.3 else [],
         "key": rng.choice(["", "", "", "k1", "k2"]), "embedding": vector(), "created_at": str(rng.randint(1, 9))}
        for i in range(120)
    ]
    for r in rows:
        r["terms"] = list(dict.fromkeys(re.sub(r"\s+", " ", t).strip().lower() for t in [r["name"], *r["aliases"]]))
        r["code"] = r["subkind"] or None
    canonical, staged = rows[:40], rows[40:]
    cols = ["kind", "subkind", "name", "aliases", "key", "embedding"]
    c = spark.createDataFrame([(r["id"], *(r[k] for k in cols)) for r in canonical], NODE)
    s = spark.createDataFrame([(r["id"], *(r[k] for k in cols), r["created_at"]) for r in staged], NODE.replace("id string", "raw_id string", 1) + ", created_at string")
    from quern.functions.text import canonical_node_id

    new = {r.raw_id: r.n for r in s.select("raw_id", canonical_node_id("kind", "name", "subkind").alias("n")).collect()}
    for r in staged:
        r["new"] = new[r["id"]]
    got = {r.raw_id: (r.canonical_id, r.resolution, round(r.score, 9)) for r in M.resolve(s, c).collect()}
    assert got == plain_resolve(staged, canonical)


def test_a_match_that_only_an_embedding_carries(spark):
    c = spark.createDataFrame([("c1", "concept", "", "kinetic energies", [], "", [1.0, 0.0])], NODE)
    s = spark.createDataFrame([("r1", "concept", "", "kinetic energy", [], "", [1.0, 0.0], "1")], NODE.replace("id string", "raw_id string", 1) + ", created_at string")
    r = M.resolve(s, c).first()
    assert (r.canonical_id, r.resolution, round(r.score, 6)) == ("c1", "matched", 0.9)


def test_near_terms_lose_no_pair(spark):
    rng = random.Random(3)
    terms = set()
    for n in (26, 40, 60, 120):
        base = "".join(rng.choice("abcdef") for _ in range(n))
        for _ in range(12):
            t = base
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(t))
                t = t[:i] + t[i + 1 :] if rng.random() < 0.5 else t[:i] + rng.choice("ab") + t[i:]
            terms.add(t)
    got = {(r.a, r.b) for r in M.near_terms(spark.createDataFrame([("k", t) for t in terms], "kind string, t string")).collect()}
    want = {(a, b) for a in terms for b in terms if a < b and max(best_ratio([a], [b], 0), best_ratio([b], [a], 0)) >= 0.98}
    assert want and want <= got


# --- graphs ----------------------------------------------------------------------------------------------------------


def test_cycles_of_long_chains(spark):
    chain = [(f"n{i:05}", f"n{i + 1:05}") for i in range(2000)]
    e = lambda rows: spark.createDataFrame(rows, "from_id string, to_id string")
    assert G.on_cycles(e(chain)).count() == 0
    ring = [*chain[:50], ("n00050", "n00010"), ("x", "n00000"), ("n00050", "y"), ("z", "z")]
    assert sorted(r.id for r in G.on_cycles(e(ring)).collect()) == [*(f"n{i:05}" for i in range(10, 51)), "z"]


def peeled(edges):
    edges = set(edges)
    while True:
        kept = {(a, b) for a, b in edges if any(y == a for _, y in edges) and any(x == b for x, _ in edges)}
        if kept == edges:
            return sorted({v for e in edges for v in e})
        edges = kept


@pytest.mark.parametrize("seed", range(4))
def test_cycles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(str(rng.randrange(14)), str(rng.randrange(14))) for _ in range(rng.choice([8, 14, 18]))]
    got = sorted(r.id for r in G.on_cycles(spark.createDataFrame(edges, "from_id string, to_id string")).collect())
    assert got == peeled(edges)


# --- profiles, trees, alignment, hints -------------------------------------------------------------------------------


def test_profiles_of_a_whole_group_are_merged(spark):
    rows = [("n", "physics", f"2024-0{i}", f"p{i}", "active", f'{{"k{i}": {i}, "tags": ["t{i % 3}"], "first": "{"" if i == 1 else i}"}}') for i in range(1, 6)]
    rows.append(("n", "physics", "2023", "gone", "deprecated", '{"dead": 1}'))
    df = spark.createDataFrame(rows, "node_id string, domain string, created_at string, id string, status string, properties string")
    import json

    got = json.loads(N.merge_profile_properties(df).first().properties)
    assert {f"k{i}": i for i in range(1, 6)}.items() <= got.items() and got["tags"] == ["t1", "t2", "t0"] and "dead" not in got and got["first"] == "2\n\n3\n\n4\n\n5"


def test_trees_of_depth_forty(spark):
    items = [(1, f"i{d}", f"i{d - 1}" if d else None, d, "theme" if d == 1 else "topic", d + 1 if d == 40 else None, d) for d in range(41)]
    items += [(1, "loop", "loop2", 90, "topic", 99, 1), (1, "loop2", "loop", 91, "topic", 99, 1)]
    df = spark.createDataFrame(items, "book_id long, id string, parent_id string, pos int, kind string, md_start int, depth int")
    flat = {r.id: r.depth for r in O.flatten(df.where("id NOT LIKE 'loop%'")).collect()}
    assert flat == {f"i{d}": d for d in range(41)}
    assert {r.id: r.theme for r in O.nearest(df, "theme").collect()}["i40"] == "i1"
    starts = {r.id: r.md_start for r in O.parent_starts(df).collect()}
    assert starts["i0"] == starts["i40"] == 41
    last = spark.createDataFrame([(1, 500)], "book_id long, last int")
    two = [(1, f"a{d}", d, d, d + 10) for d in range(20)] + [(1, "b", 20, 15, 100)]
    ends = {r.id: r.md_end for r in O.hierarchical_ends(spark.createDataFrame(two, "book_id long, id string, pos int, depth int, md_start int"), last).collect()}
    assert ends["a19"] == ends["a15"] == 99 and ends["a14"] == 500


def test_alignment_keeps_fixed_lines(spark):
    md = spark.createDataFrame([(1, 'intro\n# Alpha\nx\n<!-- LESSON_START id="b" -->\n# Beta\ny\n# Gamma')], "book_id long, md string")
    items = spark.createDataFrame([(1, 1, "a", "Alpha", "", 1, None, None), (1, 2, "b", "Beta", "", 1, None, None), (1, 3, "c", "Gamma", "", 1, None, None), (1, 4, "d", "Alpha", "", 1, 2, 3)],
                                  "book_id long, pos int, id string, title string, label string, level int, md_start int, md_end int")
    got = {r.id: (r.line, r.match_type, r.confidence, r.status) for r in O.align_outlines(O.fixed_lines(items, md), O.headings(md)).collect()}
    # The last item's fixed line lies before that of b, so it takes part in the alignment after b and finds nothing there.
    assert got["a"] == (2, "exact", 0.99, "matched") and got["b"] == (4, "marker", 1.0, "matched") and got["c"] == (7, "exact", 0.99, "matched") and got["d"][3] == "unmatched"


def plain_hints(text):
    """Line by line, with the open block and the open table as state."""
    out, rows, block = [], [], None
    table = lambda: out.append(("table", None, "\n".join(rows[:12]))) if len(rows) > 1 else None
    for n, line in enumerate((x.strip() for x in text.split("\n")), 1):
        if block is not None:
            if line:
                block.append(line)
                if line.startswith("$$"):
                    out.append(("equation", f"line:{n}", "\n".join(block)))
                    block = None
            continue
        image, inline = re.search(r"!\[[^\]]*\]\([^)]+\)", line), re.search(r"(?<!\$)\$[^$]+\$(?!\$)", line)
        if not line.startswith("$$") and not inline and not image and line[:1] == "|" == line[-1:]:
            rows.append(line)
            continue
        table()
        rows = []
        if line.startswith("$$") and not (len(line) > 2 and line.endswith("$$")):
            block = [line]
        elif line.startswith("$$") or inline:
            out.append(("equation", f"line:{n}", line))
        elif image:
            out.append(("image", f"line:{n}", line))
    table()
    if block:
        out.append(("equation", "markdown-equation-unclosed", "\n".join(block)))
    return [(i, k, at or f"markdown-table-{i + 1}", x) for i, (k, at, x) in enumerate(out)][:20]


def test_hints_equal_the_line_by_line_reading(spark):
    rng = random.Random(5)
    words = ["", " ", "| a | b |", "|", "|x|", "$$", "$$ z $$", "$$ open", "text", "in $y$ line", "![alt](p.png)", "| $q$ |", "end $$", "| ![i](j) |", "$$$$"]
    texts = ["\n".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(150)] + ["| a |\n| b |", "\n".join(["$x$"] * 30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "book_id long, md string")
    got = {}
    for r in O.hints(df).collect():
        got.setdefault(r.book_id, []).append((r.position, r.modality, r.locator, r.excerpt))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_hints(t), t


def test_dice_as_an_expression(spark):
    rng = random.Random(6)
    rows = [tuple("".join(rng.choice("abé") for _ in range(rng.randint(0, 8))) for _ in range(2)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", dice_column(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == pytest.approx(dice(r.a, r.b)) for r in got)


# --- services and versions -------------------------------------------------------------------------------------------


def test_failed_calls_are_repeated_and_faults_are_raised():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise ConnectionError("down")
        return [[1.0, 2.0] for _ in texts]

    assert V.embed_batch(["a", ""], flaky, 2, wait=0.01) == [[1.0, 2.0], []] and calls == [1, 1, 1]
    with pytest.raises(TypeError):
        V.embed_batch(["a"], lambda t: t + 1, 2)
    done = threading.Event()
    assert V.embed_batch(["a"], lambda t: done.wait(5) or [[1.0]], 1, tries=2, timeout=0.05, wait=0.01) == [[]]
    done.set()


def test_two_writers_of_one_version(spark, tmp_path):
    df, root = spark.range(3).toDF("id"), str(tmp_path)
    v = V.Versions(spark, root, "nodes")
    assert v.publish(df) == 1
    seen = v.last()
    assert v.publish(df.limit(2), after=seen) == 2
    with pytest.raises(RuntimeError, match="another writer"):
        v.publish(df.limit(1), after=seen)
    assert v.read().count() == 2 and v.read(1).count() == 3 and v.publish(df.limit(1)) == 3


# --- vectors ---------------------------------------------------------------------------------------------------------


def test_kmeans_and_layout(spark):
    rng = random.Random(7)
    rows = [(f"v{i}", [10.0 * (i % 3) + rng.gauss(0, 0.1), -10.0 * (i % 3) + rng.gauss(0, 0.1), 1.0 * (i % 3 == 1) * 9]) for i in range(45)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    groups = {}
    for r in C.kmeans(df).collect():
        groups.setdefault(r.label, set()).add(int(r.id[1:]) % 3)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2]]
    x = np.array([v for _, v in rows])
    x = x - x.mean(axis=0)
    want = np.abs(x @ np.linalg.svd(x, full_matrices=False)[2][:2].T)
    for r in C.pca_layout(df).collect():
        assert np.allclose(np.abs([r.x, r.y]), want[int(r.id[1:])], atol=1e-6)


def test_ends_of_any_level_and_of_long_books(spark):
    """Levels over six end like others, and a book of 20,000 rows takes one pass (a frame that looks ahead would be quadratic)."""
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(1, 10), rng.choice([None, i * 2, i * 2]), 7) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "book_id int, line int, level int, page int, next int")
    got = {(r.book_id, r.line): r.end for r in O.range_ends(df).collect()}
    for k, i, level, page, _ in rows:
        after = next((p for b, j, x, p, _ in rows if b == k and j > i and x <= level and p is not None), None)
        assert got[k, i] == (None if after is None else after - 1 if page is None else max(page, after - 1))
    long = spark.range(20_000).selectExpr("1 AS book_id", "id AS line", "cast(id % 9 + 1 AS int) AS level", "id AS page")
    assert O.range_ends(long).agg({"end": "sum"}).first()[0] > 0


def test_terms_that_share_much_make_few_candidates(spark):
    """Terms with a long common start meet by what they do not share; pairs that are nearly equal are found all the same."""
    rng = random.Random(5)
    terms = ["abcdefgh" * 8 + "".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(1500)]
    terms += [t[:70] + t[71:] for t in terms[:20]]
    df = spark.createDataFrame([("k", t) for t in terms], "kind string, t string")
    assert M.near_candidates(df).count() < 10 * len(terms)
    assert {(r.a, r.b) for r in M.near_terms(df).collect()} == {tuple(sorted((t, t[:70] + t[71:]))) for t in terms[:20]}


def test_fold_scores_few_pairs(monkeypatch):
    """A component whose rows all reach each other: bounds leave few pairs to score, and the outcome is that of all pairs."""
    rng = random.Random(6)
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows = []
    for i in range(150):
        name = "abcdefgh" * 8 + "".join(rng.choice("0123456789abcdef") for _ in range(32)) if i % 10 else f"term {i % 7}"
        e = [x + rng.gauss(0, 0.25) for x in base] if i % 9 else rng.choice([None, [], [0.0] * 8, [1.0, 2.0], [float("nan")] * 8])
        rows.append({"sig": f"s{i:03}", "staged": i >= 20, "created_at": str(i % 5), "row": f"r{i:03}", "n": 1, "terms": [name] if i % 40 else [], "semantic_key": f"k{i % 4}" if i % 12 == 5 else "", "code": None, "embedding": e, "new_id": f"n{i}", "canonical_id": "" if i >= 20 else f"c{i}"})
    calls = []
    plain = M._score
    monkeypatch.setattr(M, "_score", lambda s, c, *a: calls.append(1) or plain(s, c, *a))
    got = M.fold(M.pd.DataFrame(rows))
    few = len(calls)
    monkeypatch.setattr(M.Bounds, "of_row", lambda self, i: M.np.ones(self.n))
    calls.clear()
    want = M.fold(M.pd.DataFrame(rows))
    assert got.equals(want) and few < 8 * len(rows) < len(calls)
    assert {"created", "matched"} <= set(got.resolution)
