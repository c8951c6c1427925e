import random

from quern.llm import license_scan as L


def brute(text, templates):
    import re

    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = {}
    for size, group in L.classes(templates).items():
        grams = [" ".join(words[i : i + L.K]) for i in range(len(words) - L.K + 1)]
        for at in range(0, len(grams), size):
            held = set(grams[at : at + 2 * size + 1])
            for name, tw in group.items():
                t = set(L.shingles_of(tw))
                share = len(t & held) / len(t)
                if share >= L.LEAST:
                    best = out.get(name, (0, at))
                    out[name] = (max(best[0], share), min(best[1], at))
    return out


def test_against_all_windows(spark):
    rng = random.Random(9)
    noise = [w for t in L.TEMPLATES.values() for w in L.words_of(t)] + ["alpha", "beta", "gamma"] * 20
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choice(noise) for _ in range(rng.randint(0, 30))))
            words = rng.choice(list(L.TEMPLATES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = "ZZ"
            parts.append(rng.choice([" ", "\n", " -- "]).join(words).upper())
        rows.append((i, " ".join(parts), "x"))
    rows += [(500, None, ""), (501, "", ""), (502, "licensed under", ""), (None, "Released under the MIT License.", ""), (3, rows[3][1], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): (r.containment, r.first_word) for r in L.license_scan(df).collect()}
    want = {(i, name): v for i, text, _ in rows for name, v in brute(text, L.TEMPLATES).items()}
    assert got == want and len(got) > 50
    assert L.license_scan(df.limit(0)).count() == 0 and L.license_scan(df, {}).count() == 0


def test_band_settings_and_anchors():
    for size in L.classes(L.TEMPLATES):
        n = L.band_count(L.least_jaccard(size))
        assert (1 - L.least_jaccard(size)) ** n <= L.MISS
    for t in L.TEMPLATES.values():
        words = L.words_of(t)
        every, marks = L.shingles_of(words), L.anchors(words)
        assert sum(not marks & set(s.split()) for s in every) < L.LEAST * len(every)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = L.license_scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
