import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.common import components


def brute_fp(text, k=3):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(items, near):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def signed(x):
    return int(np.uint64(x).view(np.int64)) if x >= 0 else x


def test_fingerprint_is_the_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(rng.choice(["Ab", "cÉ", "d", "e\tf"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_fp(text)
    assert simhash.fingerprint(None) == 0


def test_links_with_and_without_hot_buckets(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = set()
    for _ in range(400):
        x = rng.choice(seeds)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(signed(x))
    fps = sorted(fps)
    want = brute_roots(fps, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for hot in (256, 3):
        got = {r.node: r.root for r in components(simhash.links(df, hot=hot)).collect()}
        assert {x: got.get(x, x) for x in fps} == want


def test_every_allocation_meets_the_pigeonhole_sum():
    rng = np.random.default_rng(3)
    fp = rng.integers(-(2**63), 2**63, 500)
    bits = simhash.bits_of(fp)
    both = bits.T.astype(float) @ bits
    for m in (2, 3, 4):
        parts = simhash.group_bits(500, both, m)
        assert sorted(sum(parts, [])) == list(range(64))
        plan = simhash.Plan(parts, 500, 2)
        assert (plan.allocate(bits).sum(axis=1) == 2 - m + 1).all()


def test_groups_nulls_repeats_and_dedup(spark):
    rows = [(3, "a b c d", "x"), (1, "A  b\nc d", "y"), (1, "A  b\nc d", "y"), (7, None, "z"), (8, "", None), (None, "q r s", "n"), (None, None, "n"), (9, "other words here now", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.simhash_groups(docs.select("doc_id", "text"))
    out = sorted((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0) for r in got.collect())
    assert out == sorted([(False, 3, False, 1), (False, 1, False, 1), (False, 1, False, 1), (False, 7, False, 7), (False, 8, False, 7), (True, 0, True, 0), (True, 0, False, 7), (False, 9, False, 9)])
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.fp) for r in kept.collect()) == [(0, "n"), (0, "n"), (1, "y"), (7, "z"), (9, "w")]
    empty = simhash.simhash_groups(docs.limit(0))
    assert empty.count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    from quern.llm.catalog import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    fp = {i: brute_fp(t) for i, t in docs.items()}
    want = brute_roots(sorted(docs), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, d).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in docs}
    assert F is not None
