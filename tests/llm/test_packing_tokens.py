import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing, token_count, vocab

TEXTS = [
    None, "", " ", "a", "It's  a\n\n test\t of 'll spaces \n", "été naïve Σας ΑΣ ſK", "x" * 5000, "<|endoftext|>", "a<|endoftext|> b<|startoftext|>c",
    "tab\x0b\x0c\x1c\x1f\x85\xa0 end  ", "日本語 テキスト 12345 ١٢", "word " * 1500, "é ́x", "a\r\n b\r\n  c", "\U0001f600\U0001f3fd ok!!!",
]


def test_ids_and_counts_are_the_library_s():
    texts = [t or "" for t in TEXTS]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    held = vocab.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = vocab.byte_ranks(held)
    assert len(ranks) == 50256 and vocab.byte_ranks(vocab.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))) is None
    rng = random.Random(3)
    odd = "".join(chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0xFEFF, 0x301, 0x660, 0xB2])
    many = texts + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for coder in (vocab.ByteIds(held, ranks), vocab.ByteIds(held, None)):
        for x in many:
            assert np.frombuffer(coder.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
    path = public_tokenizers.path("word_bpe_49k.json")
    w, text = Tokenizer.from_file(path), vocab.read_tokenizer(path)
    c = vocab.WordCounter(text, vocab.packed({b"the": 1, b"hello": 1}))
    for x in texts:
        assert c.count(x.encode()) == len(w.encode(x, add_special_tokens=False).ids), x


def test_cache_generations_keep_results():
    g = vocab.Generations(lambda k: k * 2, size=3, fixed={"z": "Z"})
    assert [g[k] for k in "abcdeabcdez"] == [k * 2 for k in "abcdeabcde"] + ["Z"]
    assert len(g) <= 4 and len(g.old) <= 4


def test_token_counts(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "a b", 1)], "doc_id long, text string, n_tokens int")
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts(df, path).collect()}
    for i, x in enumerate(TEXTS):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 1000)
    assert got[None].n_tokens == 2 and token_counts(df.limit(0), path).count() == 0


def token_counts(df, path):
    return token_count.token_counts(df, path, limit=1000)


def test_tier_one_is_the_sample_s_frequent_words(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(50)] + ["x" * 200, "\u65e5\u672c"]
    texts = [" ".join(rng.choice(words[: 2 + i % 52]) for _ in range(30)) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = Counter(w.encode() for t in texts for w in t.split() if len(w.encode()) <= vocab.LONGEST)
    got = token_count.frequent_words(df, sample=1000, entries=10)
    assert sorted(n[w] for w in got) == sorted(sorted(n.values())[-10:])
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert token_count.frequent_lengths(df, open(path).read(), 1000, 10) == {w: len(t.encode(w.decode(), add_special_tokens=False).ids) for w in got}
    share = sum(n[w] for w in got) / sum(len(x.split()) for x in texts)
    assert token_count.hit_rate(df, path, 1000, 10) == pytest.approx(share)
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    for entries in (1, 1000):
        assert {r.doc_id: r.n_tokens for r in token_count.token_counts(df, path, entries=entries, sample=20).collect()} == want


def test_tokenizers_that_keep_white_space_are_refused(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="white space"):
        token_count.token_counts(df, public_tokenizers.path("byte_bpe_50k.json"))


def check_places(rows, size):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(seqs)


def test_plan_covers_and_is_tight():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 500, 20000):
        counts = np.zeros(1025, np.int64)
        for x in rng.integers(1, 1025, n):
            counts[x] += 1
        cfg, total = packing.plan(counts)
        held = Counter()
        for c, k in cfg:
            assert sum(a * b for a, b in c.items()) <= 1024 and k > 0
            for a, b in c.items():
                held[a] += b * k
        assert held == Counter({i: int(v) for i, v in enumerate(counts) if v})
        bound = -(-int((counts * np.arange(1025)).sum()) // 1024)
        assert total <= bound * 1.006 + 7
    only = np.zeros(1025, np.int64)
    only[600] = 1000
    assert packing.plan(only)[1] == 1000


def test_packed_documents(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] * 2 + [(None, "q", 2)], "doc_id long, text string, length int").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(df, path).collect()
    check_places(rows, 1024)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece), []).append(r)
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        at = 0
        for k in range(-(-len(ids) // 1024)):
            for r in got[i, k]:
                assert r.start == at and np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[at : at + r.length]
            assert len(got[i, k]) == 2 and (k == 0 or got[i, k][0].length == 1024)
            at += got[i, k][0].length
        assert at == len(ids)
    digest = packing.packed_digest(df, path)
    crc = {(r.doc_id, r.piece): zlib.crc32(bytes(r.ids)) for r in rows}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in digest.collect()} == crc
    assert packing.packed_digest(df.limit(0), path).count() == 0


def least_bins(lengths, size):
    """The exact optimum by trying all assignments of pieces in decreasing order, with pruning."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, size - lengths[i]])

    go(0, [])
    return best


def test_plan_against_the_exact_optimum_on_small_histograms():
    rng = random.Random(9)
    over = 0
    for _ in range(120):
        size = rng.choice([10, 16, 30])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(lengths, minlength=size + 1)
        total, want = packing.plan(counts, size)[1], least_bins(lengths, size)
        assert want <= total <= want + 1
        over += total - want
    assert over <= 4


def test_the_fractional_program_is_feasible_and_tight():
    rng = np.random.default_rng(2)
    for n, spread in ((300, 1.0), (5000, 0.3), (200_000, 0.6)):
        counts = np.bincount(np.clip((rng.random(n) ** (1 / spread) * 1023).astype(int) + 1, 1, 1023), minlength=1025)
        used, low = packing.fractional(counts, 1024)
        covered = np.zeros(1025)
        for items, k in used.items():
            assert k > 0 and sum(a * b for a, b in items) <= 1024
            for a, b in items:
                covered[a] += b * k
        assert low >= 1 and (covered >= counts - 1e-6 * counts.max()).all()
        cfg, program = packing.rounded(counts, used, 1024)
        total, bound = sum(k for _, k in cfg), int((counts * np.arange(1025)).sum()) / 1024
        if (counts[513:].sum()) <= bound:  # otherwise the long pieces alone need more
            assert sum(used.values()) <= 1.06 * bound + 5 and total <= 1.006 * bound + 7
        assert program >= 0.9 * total


def test_packing_keeps_columns_that_clash(spark):
    df = spark.createDataFrame([(i, 1 + i * 7 % 10, "x", i, 0.5) for i in range(40)], "offset int, length long, sequence_id string, quern_rank int, before double")
    got = packing.pack(df, 10).collect()
    assert sorted(r.quern_rank for r in got) == list(range(40)) and {r.before for r in got} == {0.5}
    assert set(got[0].asDict()) == {"offset", "length", "sequence_id", "quern_rank", "before"}
    check_places(got, 10)


@pytest.mark.parametrize("run", [" ", "\n", " \n", "a", "‍\U0001f469", "1", "!"])
@pytest.mark.parametrize("front", ["", "some words before "])
def test_very_long_runs(run, front):
    path = public_tokenizers.path("byte_bpe_50k.json")
    held = vocab.read_tokenizer(path)
    text = front + run * (1_000_000 // len(run))
    got = np.frombuffer(vocab.ByteIds(held, vocab.byte_ranks(held)).ids(text), "<u4")
    assert got.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
