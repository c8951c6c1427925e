import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from quern.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, query int, score long, rank int"


def found(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Every document scored for every query."""
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := found(t))]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for i, text in items:
        scores = []
        for d, c, x in held:
            m = 100 - 50 + (50 * x * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(found(text)) if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def result(df):
    assert df.columns[1:] == ["rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(n=700, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "漢字", "x9", "ß"]
    docs = [(i * 7 % 1009, " ".join(rng.choice(words[: 3 + i % 60]) for _ in range(rng.choice([1, 3, 20, 60])))) for i in range(n)]
    docs += [(2000 + i, "w1 w2 W3! same-row") for i in range(80)]  # ties, more than k
    docs += [(3000, None), (3001, ""), (3002, " \x00.!"), (None, "w1 w2 only_null"), (3003, "w1 " * 200_000 + "w5"), (2000, "w1 w2 W3! same-row")]
    return docs


ITEMS = [(1, "w1 w2 w3"), (2, "W1, w1 É x9 missing"), (3, None), (4, "..."), (5, " ".join(f"w{i}" for i in range(60))), (5, "漢字 only_null"), (6, "nowhere"), (None, "w7 w8")]


def test_against_brute_force(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert result(X.ranked(df, items)) == brute(docs, ITEMS, 50)
    monkeypatch.setattr(X, "CELLS", 64 * 20)  # many shards
    monkeypatch.setattr(X, "STRIDE", 2)
    assert result(X.ranked(df, items, k=7, block=40)) == brute(docs, ITEMS, 7)  # several blocks of queries
    assert X.ranked(df.limit(0), items).collect() == [] and X.ranked(df, items.limit(0)).collect() == []


def test_stops_early_and_never_too_early():
    rng = np.random.default_rng(2)
    size, n, k = 30, 400, 10
    lengths = rng.integers(1, 12, n)
    terms = np.concatenate([rng.choice(size, x, replace=False) for x in lengths])
    tfs = rng.geometric(0.4, len(terms))
    shard = X.Shard(np.arange(n), rng.integers(50, 400, n), lengths, terms, tfs, size)
    fewer = 0
    for _ in range(60):
        numbers = rng.choice(size, rng.integers(1, 8), replace=False)
        weights = rng.integers(0, 5000, len(numbers))
        (scores, ids), looked = shard.search(numbers, weights, (np.zeros(0, np.int64), np.zeros(0, np.int64)), k, stride=4)
        every = shard.forward[:, numbers].astype(np.int64) @ weights
        want = sorted((-s, i) for i, s in enumerate(every.tolist()) if s > 0)[:k]
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
        fewer += looked < (every > 0).sum()
    assert fewer > 20


def test_query_against_oracle(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    assert result(X.op12_lexical_search(spark, at)) == sorted(con.sql(X.ORACLE).fetchall(), key=str)
