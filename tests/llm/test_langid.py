import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import langid as L


def test_held_out_accuracy_and_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs)
    rows = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang == r.lang_pred for r in held) / len(held)
    assert right > 0.97, right
    assert all(0 <= r.score <= 1 for r in rows)
    blind = L.identify(docs.withColumn("lang", F.lit(None).cast("string")), model).collect()
    assert {(r.doc_id, r.lang_pred) for r in blind} == {(r.doc_id, r.lang_pred) for r in rows}


def test_backoff_and_edge_rows(spark):
    rows = [(i, t, lang, 1.0) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 40)]
    edge = [(1000, None, "en", 0.0), (1001, "", "en", 0.0), (1002, "123 ²³ ?!", None, 0.0), (1003, "chatte", None, 0.0), (1004, "语言", None, 0.0), (None, "the cat", "en", 0.0), (1003, "chatte", None, 0.0), (1005, "the " * 70000 + "x" * 500, None, 0.0)]
    df = spark.createDataFrame(rows + edge, "doc_id long, text string, lang string, score double")
    model = L.fit(df)
    assert model.langs == ["en", "fr"] and "chatte" not in model.words
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "fr" and got[1005].lang_pred == "en" and got[1004].score == 0.5 and got[None].held_out is False
    assert model.unseen("语") is None
    kept = L.keep_identified(df, model, least=0.6)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.where("doc_id is null or doc_id >= 1000").collect()) == [0, 1003, 1003, 1005]
    none = L.fit(df.limit(0))
    assert L.identify(df.limit(0), none).count() == 0
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}


def test_long_runs_are_fitted_and_scored_whole(spark):
    run = lambda end: "xy" * 30 + end * 30  # noqa: E731 - the first 60 letters say nothing
    rows = [(i, run(end), lang) for i, (end, lang) in enumerate([("abc", "en"), ("def", "fr")] * 40)] + [(500, run("def") + "xy", None), (501, run("abc") + "xy", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert not model.words and {"abc", "def"} <= set(model.grams[3][0])
    got = {r.doc_id: r.lang_pred for r in L.identify(df, model).collect()}
    assert got[500] == "fr" and got[501] == "en" and all(got[i] == lang for i, _, lang in rows[:80])
    scorer = L.Scorer(model)
    assert scorer.predict("xy" * 100_000 + "def" * 100_000)[0] == "fr" and not set(scorer) - set(model.words)


def test_more_than_two_hundred_languages_are_all_kept(spark, monkeypatch):
    rng = random.Random(1)
    own = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4)] for k in range(300)}
    rows = [(i, " ".join(rng.choices(own[lang], k=12)), lang) for i, lang in enumerate(list(own) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert model.langs == sorted(own)
    got = L.identify(df, model).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) > 0.99 * len(got)
    monkeypatch.setattr(L, "CELLS", 300 * 300 * 2)  # two entries a language
    small = L.fit(df)
    assert small.langs == sorted(own) and len(small.words) <= 600 and len({r.lang_pred for r in L.identify(df, small).collect()}) > 250


def plain_scores(model, text):
    """Brute force: word log frequencies by the model's tables, n-grams from the longest known down, summed word by word."""
    total = np.zeros(len(model.langs))
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in model.words:
            total += model.word_table[model.words[w]]
            continue
        for k in (5, 4, 3, 2, 1):
            padded = w if k == 1 else f"^{w}$"
            index, table = model.grams[k]
            known = {g for g in (padded[i : i + k] for i in range(len(padded) - k + 1)) if g in index}
            if known:
                total += np.mean([table[index[g]] for g in known], axis=0)
                break
    return total


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(docs.where("doc_id % 3 = 0"))
    for r in L.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = plain_scores(model, r.text)
        p = np.exp(want - want.max())
        assert r.lang_pred == model.langs[int(np.argmax(want))] and abs(r.score - (p / p.sum()).max()) < 1e-3
