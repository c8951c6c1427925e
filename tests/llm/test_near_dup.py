import random

import numpy as np
from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from quern.llm import near_dup
from quern.llm.simhash import fingerprint


def brute_sets(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_groups(texts):
    sets, root = {i: brute_sets(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {x: a if r == b else r for x, r in root.items()}
    return root


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([3, 5, 12, 60, 120]))] + common * (i % 3 == 0) for i in range(14)]
    texts = {}
    for i in range(160):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = word()
        texts[i] = " ".join(t)
    return texts | {200: "", 201: None, 202: "A b", 203: "a\nB"}


def test_groups_against_all_pairs(spark):
    texts = corpus()
    want = brute_groups(texts)
    assert len(set(want.values())) < len(set(texts.values())) - 10
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for hot, sample in ((256, 20_000), (3, 20_000), (3, 1)):
        got = {r.doc_id: r.component_id for r in near_dup.near_groups(docs, hot=hot, sample=sample).collect()}
        assert got == want, (hot, sample)


def test_the_stage_drops_near_copies_beyond_two_bits(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near, far = list(words), list(words)
    for i in (20, 90, 150):
        near[i] = "other"
    for i in range(0, 200, 20):
        far[i] = "other"
    texts = [" ".join(x) for x in (words, near, far)]
    assert bin(fingerprint(texts[0].encode()) ^ fingerprint(texts[1].encode())).count("1") > 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(STAGES)["simhash_dedup"](spark, docs, "").collect()) == [0, 2]


def test_bitmaps_never_pass_over_a_similar_pair(spark):
    rng = random.Random(7)
    rows = []
    for i, n in enumerate([1, 5, 63, 64, 65, 130, 500, 520, 700, 3000, 9000]):
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a[: n - n // 10] + [rng.getrandbits(64) for _ in range(n // 10)]
        c = a + [rng.getrandbits(64) for _ in range(n // 4)]
        for x, y in ((a, b), (a, c), (c, a), (a, a)):
            assert 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})
            left, right = (near_dup.parity_bits(np.array(v, np.uint64)).view(np.int64).tolist() for v in (x, y))
            rows.append((i, len(x), len(y), left, right))
    pairs = spark.createDataFrame(rows, "i int, n_a int, n_b int, bits_a array<long>, bits_b array<long>")
    short = pairs
    for s in "ab":
        short = short.withColumn(f"bits_{s}", F.expr(near_dup.SHORT_BITS.replace("bits", f"bits_{s}")))
    test = near_dup.near_bits(near_dup.NUM, near_dup.DEN)
    assert pairs.where(test).count() == short.where(test).count() == len(rows)
    assert short.selectExpr("max(greatest(size(bits_a), size(bits_b)))").first()[0] == 8


def test_the_second_pass_joins_only_what_simhash_left(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{rng.randrange(9000)}" for _ in range(1000)]
    far = list(words)
    for i in range(0, 1000, 100):
        far[i] = "other"
    texts = {0: words, 1: [*words, "end"], 2: [*words, "fin"], 3: far, 4: [*far, "end"], 5: [f"v{i}" for i in range(50)]}
    texts = {i: " ".join(t) for i, t in texts.items()}
    key = {near_dup.set_key(near_dup.shingles(t.encode())): i for i, t in texts.items()}
    bits = lambda a, b: bin(fingerprint(texts[a].encode(), 5) ^ fingerprint(texts[b].encode(), 5)).count("1")
    near = {(a, b) for a in texts for b in texts if a < b and bits(a, b) <= 2}
    assert near == {(0, 1), (0, 2), (1, 2), (3, 4)}
    calls, real = [], near_dup.verified

    def spied(pairs, *args):
        calls.append({tuple(sorted((key[r.a], key[r.b]))) for r in pairs.collect()})
        return real(pairs, *args)

    monkeypatch.setattr(near_dup, "verified", spied)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for hot in (256, 1):
        calls.clear()
        got = {r.doc_id: r.component_id for r in near_dup.near_groups(docs, hot=hot).collect()}
        assert got == brute_groups(texts) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}
        assert calls[0] and calls[0] <= near
        rest = set().union(*calls[1:])
        assert rest and rest <= {(a, b) for a in (0, 1, 2) for b in (3, 4)}, hot
