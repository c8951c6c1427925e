import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string, score double, toxic int", "doc_id long, toxic int, text string"


def auc(scores, y):
    rank = np.empty(len(scores))
    rank[np.argsort(scores, kind="stable")] = np.arange(1, len(scores) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy_on_all_languages(spark):
    at = "/root/testdata/sf0.1"
    got = T.op11_toxicity(spark, at)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    scores, y = np.array([r.score for r in held]), np.array([r.toxic for r in held])
    hit, wrong = ((scores >= 0.5) & (y == 1)).sum() / y.sum(), ((scores >= 0.5) & (y == 0)).sum() / (y == 0).sum()
    assert auc(scores, y) > 0.97 and hit > 0.88 and wrong < 0.02, (auc(scores, y), hit, wrong)


def test_risk_and_gradients_against_differences():
    """Brute force: the estimator from its definition, the gradient by finite differences, on both sides of the correction."""
    rng = np.random.default_rng(1)
    loss = lambda z, y: np.log1p(np.exp(-y * z))
    sides = set()
    for prior in (0.1, 0.3, 0.8):
        for shift in (-3, 0, 3):
            zp, zu = rng.normal(1 + shift, 1, 7), rng.normal(-shift, 1, 11)
            parts = T.risk_parts(zp, zu, prior)
            assert np.allclose(parts, (prior * loss(zp, 1).mean(), loss(zu, -1).mean() - prior * loss(zp, -1).mean()))
            sides.add(parts[1] < 0)
            risk = lambda a, b: -T.risk_parts(a, b, prior)[1] if parts[1] < 0 else sum(T.risk_parts(a, b, prior))  # noqa: E731, B023
            for x, g, k in ((zp, 0, 0), (zu, 1, 1)):
                for i in range(len(x)):
                    up, down = x.copy(), x.copy()
                    up[i] += 1e-5
                    down[i] -= 1e-5
                    args = [(up, zu), (down, zu)] if k == 0 else [(zp, up), (zp, down)]
                    assert abs((risk(*args[0]) - risk(*args[1])) / 2e-5 - T.margin_gradients(zp, zu, prior)[g][i]) < 1e-6
    assert sides == {True, False}


def test_recovers_clean_documents_without_negatives():
    """Unlabelled data holds 30 % toxic documents; with the prior the classifier still parts the two, as with full labels."""
    rng = np.random.default_rng(4)
    make = lambda toxic: np.flatnonzero(rng.random(20) < np.where(np.arange(20) < 5, 0.7 if toxic else 0.05, 0.3))
    p, y = [make(True) for _ in range(300)], rng.random(3000) < 0.3
    u = [make(t) for t in y]
    w = T.train(p, u, 20, 0.3)
    z = np.array([w[d].sum() + w[-1] for d in u])
    assert ((z >= 0) == y).mean() > 0.95
    low = T.train(p, u, 20, 0.02)
    assert (np.array([low[d].sum() + low[-1] for d in u]) >= 0).mean() < (z >= 0).mean()


def corpus():
    rng = np.random.default_rng(9)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in ("aba", "ono", "ili") for c in "rstk"]
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 7 == 0
        text = " ".join([*rng.choice(words, 30), *([f"zwuk{'xyz'[i % 3]}{rng.choice(words)}"] * toxic)])
        docs.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return docs, labels


def test_rules_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "baba zwukxbabar"), (5000, None), (5001, ""), (5002, "bonos"), (5002, "bonos"), (5003, "zwukq" * 30_000), (5004, "dabar " * 200_000 + "zwukybabar"), (5005, "é" * 300_000 + " 1 2 3")]
    df = spark.createDataFrame([(*d, 0.5, 1) for d in docs + odd], DOCS)
    marks = spark.createDataFrame([(*x, "") for x in labels + [(None, 1), (5001, None), (99_999, 1), (0, 0)]], LABELS)
    model = T.fit(df, marks)
    assert "<zwuk" in model[0] and 0 < len(model[0]) <= T.FEATURES
    got = sorted(T.toxicity(df, model).collect(), key=str)
    assert len(got) == len(docs + odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == (i % 7 == 0) for i in range(1500))
    assert by[None].held_out is False and by[None].predicted == 1 and by[5003].predicted == 1 and by[5004].predicted == 1
    assert by[5000].score == by[5001].score == by[5005].score and by[5000].predicted == 0
    finder = T.Finder(*model)
    for i, text in docs[:50] + odd:  # brute force: every feature of every word looked for
        have = {f for w in T.words_of(text) for f in T.features_of(w)}
        z = sum(x for f, x in zip(model[0], model[1], strict=False) if f in have) + model[1][-1]
        assert abs(finder.score(text) - 1 / (1 + np.exp(-min(max(z, -30), 30)))) < 1e-9
    hidden = marks.withColumn("toxic", F.when(T.learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert np.array_equal(T.fit(df, hidden)[1], model[1])  # held-out labels change nothing


def test_without_positives_and_empty(spark):
    docs, labels = corpus()
    df, marks = spark.createDataFrame([(*d, 0.5, 1) for d in docs[:60]], DOCS), spark.createDataFrame([(*x, "") for x in labels], LABELS)
    none = T.fit(df, marks.where("toxic = 0"))
    assert none == ([], None) and {(r.score, r.predicted) for r in T.toxicity(df, none).collect()} == {(0.0, 0)}
    assert T.fit(df, marks.limit(0)) == ([], None) and T.fit(df.limit(0), marks) == ([], None)
    assert T.toxicity(df.limit(0), none).collect() == []


def test_long_words_lose_no_gram():
    word = "".join(chr(97 + i * i % 26) for i in range(1000))
    want = {w for k in T.ORDERS for i in range(1003 - k) for w in [f"<{word}>"[i : i + k]]}
    assert want <= {f for w in T.words_of(word) for f in T.features_of(w)}
