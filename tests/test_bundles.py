"""Bundle assembly and image filter against a plain sequential reading of each lesson, on random bundles and known ones."""

import hashlib
import random
import re

import pytest

from quern import schemas as S
from quern.operators import bundles as B

LESSONS = "lesson string, book_id string, anchor_ref string, title string, source_id string, source_path string, page_start int, page_end int, subject string, school_stage string, grade_band string, content_role string, extraction_policy string, disposition string, md string"
NODES = "lesson string, pos int, id string, name string, title string, label string, term string, kind string, subkind string, definition string, scope string, notes string, aliases array<string>, domains array<string>, knowledge_form array<string>, learning_mode array<string>, tags array<string>"
UNITS = "lesson string, pos int, anchor string, excerpt string, locator string, modality string, node_ids array<string>"
EDGES = "lesson string, pos int, from_key string, to_key string, type string, evidence_anchor string, directionality string, confidence double, notes string"
PROFILES = "lesson string, pos int, node_id string, domain string, school_stages array<string>, curriculum_roles array<string>"
CARDS = "lesson string, pos int, node_id string, evidence_anchor string, summary string, definition string, essence string, key_points array<string>, example string, application string, misconception string"
HINTS = "lesson string, pos int, excerpt string, locator string, modality string"
SCHEMAS = {"lessons": LESSONS, "nodes": NODES, "units": UNITS, "edges": EDGES, "profiles": PROFILES, "cards": CARDS, "hints": HINTS}


def st(x):
    return (x or "").strip()


def sts(x):
    return [st(v) for v in x or [] if st(v)]


def norm(x):
    return re.sub(r"\s+", " ", st(x).lower())


def sha(*parts):
    return hashlib.sha1("||".join(parts).encode()).hexdigest()[:12]


def token(x):
    return re.sub(r"^[._-]+|[._-]+$", "", re.sub("-{2,}", "-", re.sub(r"[^\w.-]+", "-", st(x)))) or "item"


def read(lesson, rows):
    """One lesson after the rules, row by row."""
    out, issues, book, no = {t: [] for t in B.TABLES}, [], token(lesson["book_id"]), lesson["disposition"] == "no_knowledge"
    names = {}
    for r in rows["nodes"]:
        i, own, d = st(r["id"]), st(r["name"]), st(r["definition"])
        clause = st(re.split("[。；;，,：:\n]", d)[0])
        words = st(re.sub("[_-]+", " ", re.sub(B.ID_PREFIX.replace("(?i)", ""), "", i, flags=re.I)))
        name = own or st(r["title"]) or st(r["label"]) or st(r["term"]) or (sts(r["aliases"]) or [""])[0] or st(clause[:32]) or words
        if not i or not name:
            issues.append(f'Dropped model node with missing id/name: {{"id":"{i}","name":"{own}"}}')
            continue
        issues += [f"Backfilled missing name for model node {i}."] * (not own) + [f"Backfilled empty definition for model node {i}."] * (not d)
        if i not in names:
            names[i] = name
            out["nodes"].append({"id": i, "name": name, "definition": d or name, "aliases": sts(r["aliases"]), "domains": sts(r["domains"]) or ["general"], "source_refs": []})
    anchors = {}
    for n, r in enumerate(rows["units"], 1):
        if st(r["anchor"]) and st(r["excerpt"]):
            anchors[st(r["anchor"])] = f"evidence:{book}:{n}"
            out["evidence"].append({"id": anchors[st(r["anchor"])], "excerpt": st(r["excerpt"]), "modality": r["modality"] or "text"})
    texts = {e["id"]: e["excerpt"] for e in out["evidence"]}
    start = len(out["evidence"]) + 1
    out["evidence"] += [{"id": f"evidence:{book}:hint:{start + n}", "excerpt": st(r["excerpt"]), "modality": r["modality"]} for n, r in enumerate(rows["hints"]) if st(r["excerpt"]) and not no]
    if not no and out["nodes"] and not out["evidence"]:
        flat = re.sub(r"\s+", " ", st(lesson["md"]))
        text = (flat if len(flat) <= 600 else flat[:599].rstrip() + "…") or st(lesson["title"]) or lesson["anchor_ref"]
        out["evidence"].append({"id": f"evidence:{book}:backfill:1", "excerpt": text, "modality": "text"})
    first = {}
    for n, r in enumerate(rows["units"], 1):
        for i in sts(r["node_ids"]):
            if st(r["anchor"]) in anchors and i in names:
                first.setdefault(i, anchors[st(r["anchor"])])
                out["mentions"].append({"id": f"mention:{book}:{token(i)}:{n}", "target_id": i, "role": "defines" if n == 1 else "focuses_on", "source_refs": [anchors[st(r["anchor"])]]})
    keys = {}
    for n in out["nodes"]:
        for w in (n["id"], n["name"], *n["aliases"]):
            keys[w] = keys[norm(w)] = n["id"]
    lost = 0
    for r in rows["edges"]:
        a, b = (keys.get(st(r[k])) or keys.get(norm(r[k])) for k in ("from_key", "to_key"))
        if not a or not b or st(r["type"]) not in S.EDGE_TYPES:
            lost += 1
            continue
        ev = anchors.get(st(r["evidence_anchor"]))
        out["edges"].append({"id": "edge:auto-" + sha(a, st(r["type"]), b), "from_id": a, "to_id": b, "confidence": r["confidence"] or 0.8, "source_refs": [ev] if ev else []})
    issues += [f"Dropped {lost} edges that could not be resolved to valid node ids or relation types."] * (lost > 0)
    refs = lambda i: [first[i]] if i in first else []
    for r in rows["profiles"]:
        i, d = st(r["node_id"]), st(r["domain"])
        if i in names and d in S.DOMAINS:
            out["profiles"].append({"id": "domain-profile:auto-" + sha(i, d), "school_stages": list(dict.fromkeys([lesson["school_stage"], *sts(r["school_stages"])])), "curriculum_roles": sts(r["curriculum_roles"]) or ["core"], "source_refs": refs(i), "backfilled": False, "node_id": i})
    have = {p["node_id"] for p in out["profiles"]}
    for n in out["nodes"]:
        if n["id"] not in have:
            default = lesson["subject"] if lesson["subject"] in S.DOMAINS else "general"
            valid = [d for d in n["domains"] if d in S.DOMAINS]
            d = default if default in valid or not valid else valid[0]
            out["profiles"].append({"id": "domain-profile:auto-" + sha(n["id"], d), "school_stages": [lesson["school_stage"]], "curriculum_roles": ["core"], "source_refs": refs(n["id"]), "backfilled": True, "node_id": n["id"]})
    by = {n["id"]: n for n in out["nodes"]}
    for r in rows["cards"]:
        if (n := by.get(st(r["node_id"]))) is not None:
            ev = anchors.get(st(r["evidence_anchor"]))
            e = [ev] if ev else []
            content = [[st(r["definition"]) or texts.get(ev, "")], [st(r["essence"])], sts(r["key_points"]), [st(r["example"])], [st(r["application"])], [st(r["misconception"])]]
            out["cards"].append({"node_id": n["id"], "title": n["name"], "summary": st(r["summary"]) or n["definition"], "sections": [(c, e) for c in content], "source_refs": e})
    have = {c["node_id"] for c in out["cards"]}
    for n in out["nodes"]:
        if n["id"] not in have:
            content = [[n["definition"]]] * 3 + [[n["name"]], [lesson["title"] or ""], [B.MISCONCEPTION]]
            out["cards"].append({"node_id": n["id"], "title": n["name"], "summary": n["definition"], "sections": [(c, refs(n["id"])) for c in content], "source_refs": refs(n["id"])})
    return out, issues


def screen(tables, decisions):
    """The image filter, row by row."""
    out = {t: [dict(r) for r in rows] for t, rows in tables.items()}
    gone = {e["id"] for e in out["evidence"] if e["modality"].lower() == "image" and decisions.get(e["id"]) is False}
    out["evidence"] = [e for e in out["evidence"] if e["id"] not in gone]
    if not gone:
        return out
    fallback = next((e["id"] for e in out["evidence"] if e["modality"].lower() != "image"), out["evidence"][0]["id"] if out["evidence"] else None) if out["nodes"] else None
    cut = lambda refs: [r for r in refs if r not in gone]
    mend = lambda refs: refs or ([fallback] if fallback else [])
    for t in ("edges", "mentions"):
        out[t] = [r for r in out[t] if not r["source_refs"] or cut(r["source_refs"])]
    for t in ("nodes", "edges", "mentions", "profiles", "cards"):
        for r in out[t]:
            r["source_refs"] = cut(r["source_refs"]) if t == "mentions" else mend(cut(r["source_refs"]))
    for c in out["cards"]:
        c["sections"] = [(text, mend(cut(refs))) for text, refs in c["sections"]]
    told = {m["target_id"] for m in out["mentions"] if m["source_refs"]}
    if fallback:
        out["mentions"] += [{"id": "mention:image-filter-backfill:" + (re.sub(r"[^A-Za-z0-9_.:-]+", "-", n["id"])[:96] or "node"), "target_id": n["id"], "role": "mentions", "source_refs": [fallback]} for n in out["nodes"] if n["id"] not in told]
    return out


def bundle(rng, k):
    text = lambda *more: rng.choice([None, "", "  ", "Alpha beta", "gamma; delta", "x, y", "长文本。第二句", *more])
    ids = ["n:one_two", "concept-Three", "4", "e:5", " n:6 ", None, "", "n:one_two"]
    keys = ["n:one_two", "ALPHA  beta", "alias A", "ALIAS a", "4", "nothing", None, "e:5"]
    lists = lambda *xs: rng.choice([None, [], [" ", None], list(xs), [xs[0]]])
    anchors = ["a1", "a2", " a3 ", "", None]
    rows = {
        "nodes": [{"id": rng.choice(ids), "name": text(), "title": text(), "label": text() if rng.random() < 0.3 else None, "term": None, "kind": "concept", "definition": text("d" * 50), "aliases": lists("alias A", " 4"), "domains": lists("physics", "odd"), "knowledge_form": None, "learning_mode": [" "], "tags": None} for _ in range(rng.randrange(6))],
        "units": [{"anchor": rng.choice(anchors), "excerpt": text(), "locator": " l ", "modality": rng.choice([None, "image", "Image", "text", "image"]), "node_ids": lists("n:one_two", "4", "4", "zz")} for _ in range(rng.randrange(5))],
        "edges": [{"from_key": rng.choice(keys), "to_key": rng.choice(keys), "type": rng.choice(["uses", "is_a", "odd"]), "evidence_anchor": rng.choice(anchors), "directionality": None, "confidence": rng.choice([None, 0.0, 0.5])} for _ in range(rng.randrange(6))],
        "profiles": [{"node_id": rng.choice(ids), "domain": rng.choice(["physics", "law", "odd", None]), "school_stages": lists("higher", "primary"), "curriculum_roles": lists("support")} for _ in range(rng.randrange(4))],
        "cards": [{"node_id": rng.choice(ids), "evidence_anchor": rng.choice(anchors), "summary": text(), "definition": text(), "essence": text(), "key_points": lists(" p", "q"), "example": text(), "application": None, "misconception": text()} for _ in range(rng.randrange(4))],
        "hints": [{"excerpt": text(), "locator": "line:3", "modality": rng.choice(["table", "image"])} for _ in range(rng.choice([0, 0, 2]))],
    }
    lesson = {"lesson": f"run:{k}", "book_id": rng.choice(["Book 1!", "b__2", None, "..."]), "anchor_ref": f"a{k}", "title": text(), "source_id": "s", "subject": rng.choice(["physics", "cooking"]), "school_stage": "higher", "disposition": rng.choice(["no_knowledge", None, "extracted", "odd"]), "md": text("word " * 300)}
    return lesson, rows


def frames(spark, bundles):
    rows = {t: [] for t in SCHEMAS}
    for lesson, r in bundles:
        rows["lessons"].append(lesson)
        for t, part in r.items():
            rows[t] += [{"lesson": lesson["lesson"], "pos": n, **x} for n, x in enumerate(part, 1)]
    full = lambda schema, x: tuple(x.get(c.split()[0]) for c in schema.split(", "))
    return {t: spark.createDataFrame([full(SCHEMAS[t], x) for x in part], SCHEMAS[t]).repartition(3) for t, part in rows.items()}


def plain(tables):
    """Rows as (lesson, repr of the compared columns), sorted."""
    out = {}
    for t, df in tables.items():
        rows = []
        for r in df.collect():
            d = r.asDict(recursive=True)
            if t == "cards":
                d["sections"] = [(s["content"], s["source_refs"]) for s in d["sections"]]
            rows.append(d)
        out[t] = rows
    return out


def compare(got, want, t):
    cols = sorted({c for rows in want.values() for r in rows[t] for c in r})
    pick = lambda r: repr([r[c] for c in cols])
    assert sorted((r["lesson"], pick(r)) for r in got[t]) == sorted((k, pick(r)) for k, rows in want.items() for r in rows[t]), t


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(7)
    bundles = [bundle(rng, k) for k in range(250)] + [(dict.fromkeys(c.split()[0] for c in LESSONS.split(", ")) | {"lesson": "run:none", "book_id": "b", "school_stage": "higher"}, {t: [] for t in SCHEMAS if t != "lessons"})]
    tables = {t: df.cache() for t, df in B.assemble(**frames(spark, bundles)).items()}
    return bundles, tables, {lesson["lesson"]: read(lesson, rows) for lesson, rows in bundles}


def test_assembly_equals_a_sequential_reading(made):
    bundles, tables, want = made
    got = plain({t: tables[t] for t in B.TABLES})
    for t in B.TABLES:
        compare(got, {k: v[0] for k, v in want.items()}, t)
    issues = {}
    for r in sorted(tables["issues"].collect(), key=lambda r: (r.lesson, r.part, r.pos, r.k)):
        issues.setdefault(r.lesson, []).append(r.issue)
    assert issues == {k: v[1] for k, v in want.items() if v[1]}
    counts = {r.lesson: [r[f"n_{t}"] for t in B.TABLES] for r in tables["counts"].collect()}
    assert counts == {k: [len(v[0][t]) for t in B.TABLES] for k, v in want.items()}
    order = sorted(((r.lesson, r.pos), r.id) for r in tables["evidence"].collect())
    assert [i for _, i in order] == [e["id"] for k in sorted(want) for e in want[k][0]["evidence"]]


def test_every_fallback_is_met(made):
    _, tables, want = made
    every = [x for v in want.values() for x in v[1]]
    assert {x.split(" ")[0] + x.split(" ")[1] for x in every} >= {"Droppedmodel", "Backfilledmissing", "Backfilledempty"}
    ids = [e["id"] for v in want.values() for e in v[0]["evidence"]]
    assert any(":hint:" in i for i in ids) and any(":backfill:" in i for i in ids)
    assert {r.backfilled for r in tables["profiles"].collect()} == {r.backfilled for r in tables["cards"].collect()} == {True, False}


def test_filter_equals_a_sequential_reading_and_leaves_no_dangling_reference(spark, made):
    bundles, tables, want = made
    rng = random.Random(3)
    said = {(k, e["id"]): rng.choice([True, False, False]) for k, v in want.items() for e in v[0]["evidence"] if rng.random() < 0.9}
    decisions = spark.createDataFrame([(k, i, keep, "relevant" if keep else "decorative", "why") for (k, i), keep in said.items()], "lesson string, id string, keep boolean, relevance string, reason string")
    out = B.filter_images(tables, decisions)
    got = plain({t: out[t] for t in B.TABLES})
    after = {k: screen(v[0], {i: keep for (x, i), keep in said.items() if x == k}) for k, v in want.items()}
    for t in B.TABLES:
        compare(got, after, t)
    lost = {(k, e["id"]) for k, v in want.items() for e in v[0]["evidence"]} - {(r["lesson"], r["id"]) for r in got["evidence"]}
    assert lost
    refs = {(r["lesson"], x) for t in B.TABLES if t != "evidence" for r in got[t] for x in [*r["source_refs"], *(y for s in r.get("sections") or [] for y in s[1])]}
    assert not refs & lost
    again = plain({t: df for t, df in B.filter_images(out | {"evidence": out["evidence"].drop("image_relevance")}, decisions).items() if t in B.TABLES})
    for t in B.TABLES:
        assert sorted(map(repr, again[t])) == sorted(map(repr, got[t])), t


def test_empty_tables(spark):
    none = {t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()}
    out = B.assemble(**none)
    assert all(df.collect() == [] for df in out.values())
    assert all(df.collect() == [] for df in B.filter_images(out, spark.createDataFrame([], "lesson string, id string, keep boolean, relevance string, reason string")).values())
