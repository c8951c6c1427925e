"""The merge of staged lessons against a plain fold, lesson by lesson and row by row."""

import hashlib
import random
import re

import pytest
from test_limits import NODE, plain_score

from quern.operators import lessons as L
from quern.operators import resolve as M

STAGED = NODE.replace("id string", "lesson string, pos int, raw_id string", 1) + ", existing_id string"
SCHEMAS = {
    "lessons": "lesson string, ordinal int",
    "nodes": STAGED,
    "evidence": "lesson string, pos int, raw_id string, anchor_ref string, excerpt string",
    "edges": "lesson string, pos int, raw_from string, raw_to string, type string, source_refs array<string>",
    "profiles": "lesson string, pos int, raw_node_id string, domain string, school_stages array<string>, curriculum_roles array<string>, source_refs array<string>",
    "mentions": "lesson string, pos int, raw_id string, target_type string, target_raw string, source_refs array<string>",
    "cards": "lesson string, pos int, raw_id string, raw_node_id string, source_refs array<string>, sections array<struct<id:string,source_refs:array<string>>>",
    "canonical": NODE,
    "old_profiles": "id string, school_stages array<string>, curriculum_roles array<string>, source_refs array<string>",
    "old_evidence": "id string",
}


def sha(*parts):
    return hashlib.sha1("||".join(parts).encode()).hexdigest()[:12]


def unique(*lists):
    return list(dict.fromkeys(x.strip() for xs in lists for x in xs or [] if x and x.strip()))


def side(name, aliases, key, subkind, embedding, kind):
    terms = list(dict.fromkeys(re.sub(r"\s+", " ", t).strip().lower() for t in [name, *aliases]))
    return {"terms": terms, "key": key, "code": subkind or None, "embedding": embedding, "kind": kind}


def fold(data):
    """All lessons in order; every rule as a loop."""
    held = [(side(n, a, k, s, e, kind), i) for i, kind, s, n, a, k, e in sorted(data["canonical"])]
    profiles = {i: (unique(a), unique(b), unique(c)) for i, a, b, c in data["old_profiles"]}
    known, out, stats, errors = {i for (i,) in data["old_evidence"]}, {t: [] for t in ("node_map", "edges", "mentions", "cards")}, {}, set()
    mine = lambda t, lesson: sorted((r for r in data[t] if r[0] == lesson), key=lambda r: r[1])
    for lesson, _ in sorted(data["lessons"], key=lambda r: r[1]):
        st, names, ev, links = dict.fromkeys(L.STATS, 0), {}, {}, 0
        for _, pos, raw, kind, sub, name, aliases, key, emb, existing in mine("nodes", lesson):
            if existing:
                if not any(i == existing for _, i in held):
                    errors.add((lesson, raw, existing))
                    continue
                got = (existing, "matched", 1.0)
            else:
                s, best, at = side(name, aliases, key, sub, emb, kind), 0.0, None
                for c, i in held:
                    if c["kind"] == kind and (x := plain_score(s, c)) > best:
                        best, at = x, i
                if best >= 0.88:
                    got = (at, "matched", best)
                else:
                    prefix = f"{kind}/{sub}" if sub else kind
                    new = f"{prefix}:auto-{sha(prefix, re.sub(r'\s+', ' ', name).strip().lower())}"
                    held.append((s, new))
                    got = (new, "review" if best >= 0.74 else "created", best if best >= 0.74 else 0.0)
            names[raw] = got[0]
            st[f"nodes_{got[1]}"] += 1
            out["node_map"].append((lesson, pos, raw, got[0], got[1], round(got[2], 9)))
        for _, _, raw, anchor, excerpt in mine("evidence", lesson):
            ev[raw] = "evidence:auto-" + sha(lesson, raw, anchor, excerpt)
            known.add(ev[raw])
            st["evidence_upserted"] += 1
        remap = lambda refs, ev=ev: unique([ev.get(r.strip(), r.strip()) for r in refs or [] if r])
        for _, pos, a, b, kind, refs in mine("edges", lesson):
            if a in names and b in names:
                out["edges"].append((lesson, pos, "edge:auto-" + sha(names[a], kind, names[b]), names[a], names[b], remap(refs)))
                st["edges_upserted"] += 1
                links += len(remap(refs))
        after = dict(profiles)
        for _, _, raw, domain, stages, roles, refs in mine("profiles", lesson):
            if raw in names and domain:
                i = "domain-profile:auto-" + sha(names[raw], domain)
                was = profiles.get(i, ([], [], []))
                after[i] = (unique(was[0], stages), unique(was[1], roles), [r for r in unique(was[2], remap(refs)) if r in known])
                st["domain_profiles_upserted"] += 1
                links += len(after[i][2])
        profiles = after
        for _, pos, raw, kind, target, refs in mine("mentions", lesson):
            t = names.get(target, target)
            out["mentions"].append((lesson, pos, "mention:auto-" + sha(lesson, raw, kind, t), t, remap(refs)))
            st["mentions_upserted"] += 1
            links += len(remap(refs))
        for _, pos, raw, node, refs, sections in mine("cards", lesson):
            if node in names:
                parts = [(i, remap(r)) for i, r in sections or []]
                out["cards"].append((lesson, pos, raw, names[node], remap(refs), parts))
                st["node_cards_upserted"] += 1
                links += len(remap(refs)) + sum(len(r) for _, r in parts)
        stats[lesson] = st | {"evidence_links_upserted": links}
    return out, profiles, stats, errors


def data(rng, n=14):
    bases = ["kinetic energy", "potential energy", "water cycle", "photosynthesis in green plants and other organisms"]

    def name():
        x = rng.choice(bases)
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            i = rng.randrange(len(x))
            x = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice("xyz") + x[i:], x + "s"])
        return x

    vectors = [[1.0, 0.1, 0.0], [0.9, 0.2, 0.1], [0.0, 1.0, 0.3]]
    node = lambda: (rng.choice(["concept", "rule"]), rng.choice(["", "wave"]), name(), [name()] if rng.random() < 0.2 else [], rng.choice(["", "", "k1"]), rng.choice([None, *vectors]))
    names = [f"r{i}" for i in range(5)]
    refs = lambda: rng.choice([None, [], ["e0", " e1", "e0", None, ""], ["e2", "old1"], ["old2", "later"], ["e1", "nowhere"]])
    d = {t: [] for t in SCHEMAS}
    d["canonical"] = [(f"c{i}", *node()) for i in range(4)]
    d["old_evidence"] = [("old1",), ("old2",)]
    order = rng.sample(range(n), n)
    for k in range(n):
        lesson = f"run{k}"
        d["lessons"].append((lesson, order[k]))
        for pos in range(rng.choice([0, 3, 6])):
            d["nodes"].append((lesson, pos, rng.choice(names), *node(), rng.choice([None, None, None, "", "c1", "nothing", f"concept:auto-{sha('concept', bases[0])}"])))
            d["evidence"].append((lesson, pos, f"e{rng.randrange(3)}", "a", rng.choice(["x", "y"])))
            d["edges"].append((lesson, pos, rng.choice(names), rng.choice(names), "uses", refs()))
            d["profiles"].append((lesson, pos, rng.choice(names[:2]), rng.choice(["physics", "physics", "law", "", None]), rng.choice([None, ["higher"], ["primary", " higher"]]), rng.choice([["core"], []]), refs()))
            d["mentions"].append((lesson, pos, f"m{pos}", "node", rng.choice([*names, "zz"]), refs()))
            d["cards"].append((lesson, pos, f"card{pos}", rng.choice(names), refs(), rng.choice([None, [], [("s", refs()), ("t", ["e0", "e1"])]])))
    d["old_profiles"] = [("domain-profile:auto-" + sha("c1", "physics"), ["old"], ["support"], ["old1", "gone", "old2"]), ("untouched", ["a"], [], ["gone"])]
    d["nodes"].append(("unlisted", 0, "r0", *node(), None))
    return d


@pytest.mark.parametrize("seed", [1, 5])
def test_equals_the_sequential_fold(spark, seed):
    d = data(random.Random(seed))
    got = L.merge_lessons(**{t: spark.createDataFrame(rows, SCHEMAS[t]).repartition(2) for t, rows in d.items()})
    want, profiles, stats, errors = fold(d)
    rows = lambda t, *cols: sorted(tuple(r[c] for c in cols) for r in got[t].collect())
    assert sorted((r.lesson, r.pos, r.raw_id, r.canonical_id, r.resolution, round(r.score, 9)) for r in got["node_map"].collect()) == sorted(want["node_map"])
    assert {(r.lesson, r.raw_id, r.existing_id) for r in got["errors"].collect()} == errors
    assert rows("edges", "lesson", "pos", "id", "from_id", "to_id", "source_refs") == sorted(want["edges"])
    assert rows("mentions", "lesson", "pos", "id", "target_id", "source_refs") == sorted(want["mentions"])
    assert sorted((r.lesson, r.pos, r.id, r.node_id, r.source_refs, [(s.id, s.source_refs) for s in r.sections]) for r in got["cards"].collect()) == sorted(want["cards"])
    merged = {r.id: (r.school_stages, r.curriculum_roles, r.source_refs) for r in got["profiles"].collect()}
    assert merged == {i: p if i != "untouched" else (["a"], [], ["gone"]) for i, p in profiles.items()}
    assert {r.lesson: {s: r[s] for s in L.STATS} for r in got["stats"].collect()} == stats
    total = L.total_stats(got["stats"]).first()
    assert total.merged == len(stats) and all(total[s] == sum(x[s] for x in stats.values()) for s in L.STATS)


def test_empty(spark):
    none = {t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()}
    got = L.merge_lessons(**none)
    assert all(df.collect() == [] for df in got.values()) and L.total_stats(got["stats"]).first().merged == 0


def test_a_hub_name_is_folded_once(spark):
    """100,000 rows of one name in one kind reach the fold as one signature."""
    seen = spark.sparkContext.accumulator(0)
    plain = M.fold

    def counted(pdf, *a):
        seen.add(len(pdf))
        return plain(pdf, *a)

    M.fold = counted
    try:
        rows = spark.range(100_000).selectExpr("concat('r', lpad(id, 8, '0')) AS raw_id", "'concept' AS kind", "'' AS subkind", "if(id % 2 = 0, 'Energy', ' energy ') AS name", "array() AS aliases", "'' AS semantic_key", "cast(NULL AS array<double>) AS embedding", "'1' AS created_at")
        rows = rows.withColumn("aliases", rows.aliases.cast("array<string>"))
        got = M.resolve(rows, rows.limit(0).withColumnRenamed("raw_id", "id").drop("created_at"))
        assert {(r.resolution, r["count"]) for r in got.groupBy("resolution").count().collect()} == {("created", 1), ("matched", 99_999)}
    finally:
        M.fold = plain
    assert 1 <= seen.value <= 4
