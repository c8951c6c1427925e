import random
import re
from collections import Counter, defaultdict

import duckdb

from quern.llm import source_audit as S

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, number long, m long"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, least=10, top=10):
    occurs, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall(lower(text or ""))
        occurs[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (x, s), c in occurs.items() if x == lang}
        total = {t: sum(c[t] for c in own.values()) for t in kept}
        p = lambda c, v=len(kept): {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * v) for t in kept}
        q = p(total)
        ps = {s: p(c) for s, c in own.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(ps[s][t], q[t]), t) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)}
    return out


def result(df):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force_with_odd_rows_and_many_sources(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["É", "ß", "ÀB", "漢字", "a" * 5000]
    rows = []
    for i in range(900):
        text = " ".join(rng.choice(words[: 5 + i % 80]) + rng.choice([",", "1", "\n", "-", "\x00"]) for _ in range(rng.randrange(25)))
        rows.append((text if i % 50 else None, rng.choice(["en", "de", None]), f"s{rng.randrange(70)}" if i % 3 else rng.choice(["hot", None, ""])))
    rows += [("THE same row", "en", "hot")] * 40 + [("7 8 9 !", "xx", "a"), (None, "xx", "b"), ("rare", "yy", "a"), ("word " * 200_000, "en", "long")]
    df = spark.createDataFrame([(None if i % 7 == 0 else i, *r, 1, 1) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    got = result(S.divergence(df))
    want = brute(rows)
    assert got == want
    assert max(len({x[1] for x in want if x[0] == lang}) for lang in ("en", "de")) > S.TILE
    assert {x[4] for x in got if x[0] == "xx"} == {0} and not [x for x in got if x[0] == "yy"]


def test_small_tables_and_flushes(spark, monkeypatch):
    rows = [(f"alpha beta alpha gamma{'' if i % 2 else ' delta delta'}", "en", f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame([(i, *r, 0, 0) for i, r in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(S, "ENTRIES", 2)
    monkeypatch.setattr(S, "ROWS", 1)
    assert result(S.divergence(df)) == brute(rows)
    assert result(S.divergence(df, least=1, top=1)) == brute(rows, 1, 1)
    assert S.divergence(df.limit(0)).collect() == []


def test_histogram_adds_up(spark):
    rows = [(f"a{'a' * (i % 5)} b c {'d ' * (i % 4)}", "en", f"s{i % 4}") for i in range(80)]
    df = spark.createDataFrame([(i, *r, 0, 0) for i, r in enumerate(rows)], SCHEMA)
    kept = S.kept_terms(df, 2).cache()
    langs = kept.groupBy("lang").agg(S.F.count_if("lead").alias("v"))
    groups = spark.createDataFrame([("en", f"s{i}", i) for i in range(5)], "lang string, source string, number long")
    v = langs.first()["v"]
    cells = S.joint_histograms(kept, groups, langs).groupBy("a", "b").agg(S.F.sum("m").alias("m")).collect()
    assert len(cells) == 10 and {r["m"] for r in cells} == {v}


def test_query_against_oracle(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = con.sql(S.ORACLE)
    cols = want.columns
    assert cols == ["lang", "source", "part", "item", "value", "rank"]
    assert result(S.op13_source_divergence(spark, at)) == set(want.fetchall())
