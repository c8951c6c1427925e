"""Units: counts and first children of all nodes against the nested rows, and what the query over all nodes moves."""

import random

from quern.operators import units as U
from quern.plans import load

SF = "/root/testdata/sf0.001"


def _tables(spark, seed):
    rng = random.Random(seed)
    ids, docs = [f"n{i}" for i in range(12)], [f"d{i}" for i in range(9)]
    some = lambda: rng.choices([*docs, "gone", None], k=rng.randrange(4))
    node, status = (lambda: rng.choice([*ids, "other", None])), (lambda: rng.choice(["active", "deprecated", None]))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    hidden = '{"image_relevance":{"keep":false}}'
    return {
        "nodes": frame([(i,) for i in ids], "id string"),
        "edges": frame([(f"e{i}", rng.choice("ab"), node(), node(), status(), some()) for i in range(40)], "id string, type string, from_id string, to_id string, status string, source_refs array<string>"),
        "profiles": frame([(f"p{i}", node(), rng.choice("xyz"), status(), some()) for i in range(20)], "id string, node_id string, domain string, status string, source_refs array<string>"),
        "mentions": frame([(f"m{i}", node(), "s", "a", rng.choice(["core", None]), some()) for i in range(20)], "id string, target_id string, source_id string, anchor_ref string, role string, source_refs array<string>"),
        "evidence": frame([(d, rng.choice(["s", "t", None]), "a", f"text of {d}", rng.choice(["text", "image"]), rng.choice([hidden, "{}"])) for d in docs], "id string, source_id string, anchor_ref string, excerpt string, modality string, properties string"),
        "cards": frame([(i, f"sum {i}", some(), [(some(),)]) for i in ids[::2]], "node_id string, summary string, source_refs array<string>, sections array<struct<source_refs:array<string>>>"),
        "bodies": frame([(i, rng.choice([" ", "body"]), some()) for i in ids[::3]], "node_id string, content string, source_refs array<string>"),
    }


def test_counts_are_those_of_the_nested_units(spark):
    for seed in range(3):
        t = _tables(spark, seed)
        closure = U.evidence_closure(t["nodes"], t["evidence"], t["mentions"], seed == 2, **{k: t[k] for k in ("profiles", "edges", "cards", "bodies")})
        assert closure.count() == closure.distinct().count()
        args = [t[k] for k in ("nodes", "edges", "profiles", "mentions")] + [closure] + [t[k] for k in ("evidence", "cards", "bodies")]
        places = {"outgoing": ("type", "edge_id"), "incoming": ("type", "edge_id"), "profiles": ("domain", "profile_id"), "mentions": ("mention_id",), "evidence": ("source_id", "anchor_ref", "evidence_id")}
        want, seen = {}, 0
        for r in U.units(*args).collect():
            want[r["id"]] = {n: (len(r[n] or []), tuple(r[n][0][p] for p in place) if r[n] else None) for n, place in places.items()} | {"rest": (r["card"], r["body"])}
            seen += sum(len(r[n] or []) for n in places)
        got = {r["id"]: {n: (r[f"n_{n}"], tuple(r[f"first_{n}"]) if r[f"first_{n}"] else None) for n in places} | {"rest": (r["card"], r["body"])} for r in U.unit_counts(*args).collect()}
        assert got == want and seen > 50


def test_query_moves_no_texts_and_gathers_no_lists(spark):
    plan = load().QUERIES["j2_units"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "excerpt" not in plan


def test_closure_is_dealt_once_by_node(spark):
    """The distinct rows of the closure come after its join with the nodes, and need no exchange of their own."""
    t = _tables(spark, 0)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = U.evidence_closure(t["nodes"], t["evidence"], t["mentions"], False, **{k: t[k] for k in ("profiles", "edges", "cards", "bodies")})
        plan = c._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "hashpartitioning(node_id#" in plan and not [x for x in plan.split("hashpartitioning(")[1:] if x.startswith("node_id#") and "evidence_id#" in x.split(")")[0]]
