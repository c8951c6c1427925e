"""Known answers for graph, retrieval, resolution, normalisation and clustering."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import similarity as Y
from quern.functions import text as X
from quern.functions import vectors as V
from quern.operators import cluster as C
from quern.operators import filters, quality
from quern.operators import graph as G
from quern.operators import normalize as N
from quern.operators import resolve as M
from quern.operators import retrieval as R

EDGE = "id string, type string, from_id string, to_id string, status string"


def test_stable_ids(spark):
    row = spark.range(1).select(X.stable_suffix(F.lit("struct:chem-grade8:lesson:1-1-1"), F.lit("water cycle")).alias("q"), X.canonical_node_id(F.lit("concept"), F.lit(" Water  Cycle "), F.lit(None).cast("string")).alias("n")).first()
    assert row.q == "94b78fee86e9" and row.n == "concept:auto-" + M.lesson_hash("concept||water cycle")


def test_text_functions(spark):
    df = spark.createDataFrame([(" a", ["x ", "", None, "y"], ["y", "z"])], "s string, a array<string>, b array<string>")
    r = df.select(X.unique_strings("a", "b", F.lit(None).cast("array<string>")).alias("u"), X.merge_text("s", F.lit("a "), F.lit("b")).alias("m"), X.normalize_term(F.lit("　A\u00a0 B\t")).alias("n"), X.excerpt(F.lit("a  b\n c"), 3).alias("e")).first()
    assert r.u == ["x", "y", "z"] and r.m == "a\n\nb" and r.n.strip("　 ") == "a b" and r.e == "a b..."
    assert X.like_pattern(r"a%_\ b") == r"%a\%\_\\ b%"
    codes = [r.c for r in spark.createDataFrame([("物理定律",), ("Circuit Model",), ("!",), (None,)], "s string").select(X.subkind_code("s").alias("c")).collect()]
    assert codes == ["physical_law", "circuit_model", None, None]
    prim = spark.createDataFrame([("definition", "物理量"), ("circuit", "definition"), ("", "theory")], "a string, b string").select(X.primary_subkind("a", "b").alias("p")).collect()
    assert [r.p for r in prim] == ["physical_quantity", "circuit", "theory"]


def test_lexical_similarity():
    assert Y.best_ratio(["water cycle"], ["water-cycle"], 0.96) == pytest.approx(0.9090909090909091)
    assert Y.best_ratio(["water"], ["water cycle"], 0.96) == 0.96 and Y.best_ratio(["氧气"], ["氧气的性质"], 0.96) == 0.96
    assert Y.best_ratio([], ["a"], 0.96) == 0 and Y.best_ratio(["a" * 50], ["a" * 51], 0.96) > 0.98


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", max_size=8), st.text("ab ", max_size=8))
def test_similarities_are_symmetric_and_bounded(a, b):
    assert 0 <= Y.dice(a, b) == Y.dice(b, a) <= 1
    assert Y.best_ratio([a], [a], 0.96) == (1.0 if a else 0.0)


def test_json_merge():
    assert Y.merge_json({"a": "", "b": {"x": 1}, "c": ["1"], "d": "p", "e": 1}, {"a": 5, "b": {"y": 2}, "c": ["2", "1"], "d": "q", "e": 2, "f": 3}) == {"a": 5, "b": {"x": 1, "y": 2}, "c": ["1", "2"], "d": "p\n\nq", "e": 1, "f": 3}


def test_match_scores(spark):
    s = "raw_id string, kind string, subkind string, name string, aliases array<string>, semantic_key string, embedding array<double>"
    staged = spark.createDataFrame([("r1", "concept", "wave", "Water cycle", [], "", [1.0, 0.0]), ("r2", "rule", "", "water cycle", [], "", None), ("r3", "concept", "", "water", [], "", [1.0, 0.0])], s)
    canon = spark.createDataFrame([("c1", "concept", "light", "water cycle", ["水循环"], "", [1.0, 0.0])], s.replace("raw_id", "id"))
    pairs = spark.createDataFrame([("r1", "c1"), ("r2", "c1"), ("r3", "c1")], "raw_id string, id string")
    got = {r.raw_id: round(r.score, 6) for r in M.score_pairs(staged, canon, pairs).collect()}
    assert got == {"r1": 0.94, "r3": 0.9}  # r2 has another kind and scores nothing


def test_resolution_fold(spark):
    s = "raw_id string, kind string, subkind string, name string, aliases array<string>, semantic_key string, embedding array<double>, created_at string"
    rows = [("r1", "concept", "", "Osmosis", [], "", None, "1"), ("r2", "concept", "", "osmosis", [], "", None, "2"), ("r3", "rule", "", "Osmosis", [], "", None, "3"), ("r4", "concept", "", "H2O cycle", ["water cycle"], "", None, "4"), ("r5", "concept", "", "zz", [], "k", None, "5"), ("r6", "concept", "", "yy", [], "k", None, "6")]
    canon = spark.createDataFrame([("concept:wc", "concept", "", "Water Cycle", [], "", None)], s.replace("raw_id", "id").replace(", created_at string", ""))
    got = {r.raw_id: (r.canonical_id, r.resolution) for r in M.resolve(spark.createDataFrame(rows, s), canon).collect()}
    one = "concept:auto-" + M.lesson_hash("concept||osmosis")
    assert got["r1"] == (one, "created") and got["r2"] == (one, "matched") and got["r3"][1] == "created" and got["r4"] == ("concept:wc", "matched")
    assert got["r5"][1] == "created" and got["r6"] == (got["r5"][0], "matched")


def test_json_answers():
    assert M.first_json_object('say ```json\n{"a": "}"}\n``` end') == '{"a": "}"}'
    assert M.first_json_object('x {bad {"b": 1} tail') == '{"b": 1}' and M.first_json_object("none") is None


def test_candidate_merge(spark):
    rows = [("n1", "Water", 100.0, "local", 1), ("n1", "Water", 80.0, "vector", 3), ("n2", "Atom", 85.0, "local", 2), ("n2", "Atom", 90.0, "vector", 4), ("n3", "Atom", 85.0, "local", 5)]
    df = spark.createDataFrame(rows, "node_id string, name string, score double, method string, pos int")
    assert [(r.node_id, r.score, r.method) for r in R.merge_candidates(df, 9).collect()] == [("n1", 108.0, "local+vector"), ("n2", 90.0, "vector"), ("n3", 85.0, "local")]


def test_search_terms():
    assert R.search_terms("  ") == [] and R.search_terms("water cycle") == ["water cycle", "water", "cycle"]
    t = R.search_terms("水循环x")
    assert t[:2] == ["水循环x", "水循环"] and "循环" in t and len(R.search_terms("天" * 60)) <= 40


def test_rrf_and_modes(spark):
    t = spark.createDataFrame([("a", 1, ["name"]), ("b", 2, ["alias"])], "id string, rank int, reasons array<string>")
    v = spark.createDataFrame([("b", 1, ["embedding"], 0.9), ("c", 2, ["embedding"], 0.8)], "id string, rank int, reasons array<string>, similarity double")
    got = R.rrf(t, v, 5).collect()
    assert [r.id for r in got] == ["b", "a", "c"] and got[0].score == pytest.approx(1 / 62 + 1 / 61) and got[0].reasons == ["alias", "embedding"]


def test_read_queries(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query_text": "a", "query_id": "1"}\n{"query_text": " "}\n')
    (tmp_path / "q.txt").write_text("x\n\ny\n")
    assert [r.query_text for r in R.read_queries(spark, str(tmp_path / "q.jsonl")).collect()] == ["a"]
    assert [r.query_text for r in R.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["x", "y"] and R.read_queries(spark, values=["z"]).count() == 1
    with pytest.raises(ValueError):
        R.read_queries(spark)


def test_integrity(spark):
    nodes = spark.createDataFrame([("a", "A", "concept", None), ("b", "B", "entity", None), ("old", "O", "concept", "deprecated")], "id string, name string, kind string, status string")
    edges = spark.createDataFrame([("e1", "is_a", "a", "b", None), ("e2", "is_a", "b", "a", None)], EDGE)
    got = G.check_integrity(nodes, edges)
    assert got == {"cycles": [["a", "b", "a"]], "directed_cycle_warnings": [], "isolated_nodes": 0, "disconnected_components": 0}
    uses = edges.withColumn("type", F.lit("uses"))
    got = G.check_integrity(nodes, uses)
    assert got["cycles"] == [] and got["directed_cycle_warnings"] == [["a", "b", "a"]]
    lone = spark.createDataFrame([("e1", "related_to", "a", "a", None), ("e2", "related_to", "b", "b", "deprecated")], EDGE)
    assert [r.id for r in G.isolated(nodes, lone).collect()] == ["b"]


def test_components(spark):
    chain = [(f"a{i}", "related_to", f"n{i}", f"n{i + 1}", None) for i in range(5)] + [(f"b{i}", "related_to", f"n{i + 6}", f"n{i + 7}", None) for i in range(5)]
    edges = spark.createDataFrame(chain, EDGE)
    got = sorted((r.size, r.sample_nodes) for r in G.weak_components(edges).collect())
    assert got == [(6, ["n0", "n1", "n2"]), (6, ["n10", "n11", "n6"])]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(14)], "id string")
    r = G.graph_stats(nodes, edges).first()
    assert (r.isolated, r.components) == (2, 4)
    assert G.components(edges.limit(0)).count() == 0 and G.on_cycles(edges).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20))
def test_components_equal_union_find(pairs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    root = {i: i for p in pairs for i in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(f"{a:02d}", f"{b:02d}") for a, b in pairs], "from_id string, to_id string")
    got = {r.id: r.component for r in G.components(df).collect()}
    touched = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {f"{i:02d}": f"{find(i):02d}" for i in touched}


def test_communities_are_deterministic(spark):
    pts = [("a", [1.0, 0, 0, 0]), ("b", [0.99, 0.01, 0, 0]), ("c", [0, 1.0, 0, 0]), ("d", [0.01, 0.99, 0, 0]), ("e", [0, 0, 1.0, 0]), ("f", [0, 0.01, 0.99, 0]), ("g", [0, 0, 0, 1.0]), ("h", [0.01, 0, 0, 0.99]), ("z", [0.0, 0, 0, 0]), ("y", [1.0])]
    sch = "id string, embedding array<double>"
    mk = lambda p: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in p], sch)
    one = {r.id: r.community for r in C.spherical_kmeans(mk(pts)).collect()}
    two = {r.id: r.community for r in C.spherical_kmeans(mk(pts[::-1])).collect()}
    assert one == two == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2, "f": 2, "g": 3, "h": 3}
    assert C.community_count(2) == 1 and C.community_count(7) == 3 and C.community_count(5000) == 12 and C.cluster_count(9) is None and C.cluster_count(500) == 12


def test_vectors(spark):
    df = spark.createDataFrame([("[1, 0]", [1.0, 0.0]), ("[]", []), ("oops", None), ('["a"]', [0.0, 0.0])], "t string, v array<double>")
    got = [(r.p, r.c) for r in df.select(V.parse_embedding("t").alias("p"), V.cosine("v", F.array(F.lit(2.0), F.lit(0.0))).alias("c")).collect()]
    assert got == [([1.0, 0.0], 1.0), (None, 0.0), (None, 0.0), (None, 0.0)]


def test_edges_profiles_cards(spark):
    e = spark.createDataFrame([("1", "uses", "a", "b", None, "2020"), ("2", "uses", "a", "b", None, "2019"), ("3", "uses", "a", "b", "deprecated", "2018"), ("4", "uses", "b", "a", None, "2021")], EDGE + ", created_at string").withColumn("directionality", F.lit("undirected"))
    assert [(r.id, r.kept_id) for r in N.edge_duplicates(e).collect()] == [("1", "2")]
    assert [r.id for r in N.undirected_edge_duplicates(e.na.fill("active")).orderBy("id").collect()] == ["1", "4"]
    c = spark.createDataFrame([("n", [("", " ", "", ["a ", " "], ["e"]), ("s", "t", "x", ["b"], [])])], "node_id string, sections array<struct<id:string,title:string,section_type:string,content:array<string>,source_refs:array<string>>>")
    r = N.card_sections(c).first()
    assert r.modified and [tuple(s)[:4] for s in r.sections] == [("section-0", " ", "other", ["a"]), ("s", "t", "x", ["b"])]
    t = spark.createDataFrame([("n", "Water", [" water", "H2O", None], ["tag", "TAG "], None), ("o", "x", [], [], "deprecated")], "id string, name string, aliases array<string>, tags array<string>, status string")
    assert sorted((r.term, r.term_type) for r in N.node_terms(t).collect()) == [(" water", "alias"), ("H2O", "alias"), ("Water", "canonical"), ("tag", "tag")]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "id int, v string")
    assert sorted(N.upsert(old, new, ["id"], do_nothing=True).collect()) == [(1, "a"), (2, "b"), (3, None)]


def test_null_status_is_active_and_hidden_images(spark):
    df = spark.createDataFrame([("image", '{"image_relevance":{"keep":false}}'), ("image", '{"image_relevance":{"review_status":"pending"}}'), ("image", '{"image_relevance":{"relevance":"uncertain","review_status":"approved"}}'), ("image", "{}"), ("text", '{"image_relevance":{"keep":false}}'), (None, None)], "modality string, properties string")
    assert [r.h for r in df.select(filters.hidden_image().alias("h")).collect()] == [True, True, False, False, False, False]
    n = spark.createDataFrame([(None,), ("deprecated",), ("active",)], "status string")
    assert N.active(n).count() == 2


def test_admission(spark):
    n = spark.createDataFrame([("l", "1", "力"), ("l", "2", "第3章 运动"), ("l", "3", "选择题 一"), ("l", "4", "速度"), ("m", "5", "Chapter 1")], "lesson string, raw_node_id string, name string")
    e = spark.createDataFrame([("l", "4", "1")], "lesson string, from_id string, to_id string")
    got = sorted((r.raw_node_id, r.warning) for r in quality.admission_warnings(n, e).collect())
    assert got == [("1", "name is too short"), ("2", "has no staged relations"), ("2", "looks like a heading"), ("3", "has no staged relations"), ("3", "looks like an assessment label"), ("5", "looks like a heading")]
