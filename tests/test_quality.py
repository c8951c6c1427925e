"""Digests of ordered groups that never meet in memory, and references and ends that are unknown."""

import hashlib
import random

from quern.operators import quality as Q
from quern.plans import load


def test_digests_of_ordered_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", "水"]), rng.choice(["", "k", "k1", "é", "~", None, "long" * 40]), f"m{rng.randrange(30)}") for _ in range(3000)] + [("one", "row", "i", "m")]
    df = spark.createDataFrame(rows, "c string, r string, id string, message string").repartition(7)
    want = {}
    for c, r, i, m in sorted(rows, key=lambda x: ((x[2] is not None), (x[2] or "").encode(), x[3].encode())):
        want.setdefault((c, r), []).append((i or "") + m)
    held = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        for size, parts in (("10000", "4"), ("7", "13")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {(x.c, x.r): (x.n, x.digest) for x in Q.ordered_digests(df, ["c", "r"], ["id", "message"]).collect()}
            assert got == {k: (len(v), hashlib.md5("".join(v).encode()).hexdigest()) for k, v in want.items()}
        assert Q.ordered_digests(df.where("false"), ["c", "r"], ["id", "message"]).collect() == []
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_query_gathers_no_group(spark):
    plan = load().QUERIES["q1_strict_qa"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_unknown_references_and_ends(spark, monkeypatch):
    ref = "source_refs array<string>"
    empty = lambda s: spark.createDataFrame([], s)
    nodes = spark.createDataFrame([("n1", "n", "concept", "d")], "id string, name string, kind string, definition string")
    edges = spark.createDataFrame([("e1", "n1", None, "t", "directed", ["d1", "d9"]), ("e2", "n2", "n1", "t", "directed", ["", None, "d9"]), ("e3", None, "n2", "t", "directed", None)], f"id string, from_id string, to_id string, type string, directionality string, {ref}")
    evidence = spark.createDataFrame([("d1",)], "id string")
    rest = [empty(f"id string, node_id string, domain string, school_stages array<string>, curriculum_roles array<string>, {ref}"), empty(f"id string, target_id string, {ref}")]
    cards = empty(f"node_id string, summary string, {ref}, sections array<struct<id:string,section_type:string,source_refs:array<string>>>")
    got = []
    for few in (Q.FEW, -1):
        monkeypatch.setattr(Q, "FEW", few)
        issues = Q.strict_qa(nodes, edges, *rest, evidence, cards, empty(f"node_id string, content string, {ref}")).where("category = 'edge' AND (message LIKE 'Missing%' OR message LIKE '%empty%')")
        got.append(sorted((r.id, r.message) for r in issues.collect()))
    assert got[0] == got[1] == [
        ("e1", "Missing evidence d9"), ("e1", "Missing target node"), ("e2", "Invalid empty evidence reference"), ("e2", "Invalid empty evidence reference"), ("e2", "Missing evidence d9"),
        ("e2", "Missing source node"), ("e3", "Missing evidence source references"), ("e3", "Missing source node"), ("e3", "Missing target node"),
    ]
