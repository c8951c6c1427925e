import random

import numpy as np

from quern.llm import decontaminate as D


def brute(item, doc):
    """Fewest edits between all of item and any part of doc."""
    row = [0] * (len(doc) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(doc, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edit(rng, s, n):
    s = bytearray(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        what = rng.random()
        if what < 0.4:
            s[i] = rng.choice(b"abcdexyz ")
        elif what < 0.7:
            del s[i]
        else:
            s.insert(i, rng.choice(b"abcdexyz "))
    return bytes(s)


def test_finds_exactly_what_is_within_the_budget():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(40)]
    text = lambda n: b" ".join(rng.choice(words) for _ in range(n))
    items = [(i, D.normal(text(rng.choice([3, 8, 25, 40])).decode())) for i in range(12)]
    docs = []
    for _ in range(60):
        part = edit(rng, rng.choice(items)[1], rng.choice([0, 2, 6, 12, 25]))
        docs.append(text(rng.randint(0, 30)) + rng.choice([b" ", b". ", b""]) + part + b" " + text(rng.randint(0, 10)))
    index = D.Items(items)
    docs += [b"", b"  .. ", b"abc"]
    raw = np.concatenate([np.frombuffer(d + b"\0", np.uint8) for d in docs])
    starts = np.cumsum([0] + [len(d) + 1 for d in docs[:-1]])
    got = {(d, i): e for d, i, _, _, e in index.find(raw, starts)}
    budget = {key: int(k) for (key, _), k in zip(index.text, index.k, strict=True)}
    for d, doc in enumerate(docs):
        flat = D.squeeze(np.frombuffer(doc, np.uint8))[0].tobytes() if doc else b""
        for key, item in index.text:
            n = brute(item, flat)
            assert ((d, key) in got) == (n <= budget[key]), (d, key, n, budget[key])
            if n <= budget[key]:
                assert got[d, key] == n
    assert len(got) > 30


def test_spans_nulls_short_items_and_empty_tables(spark):
    passage = "The Quick brown fox -- jumps over the lazy dog, again and again, until évening."
    docs = spark.createDataFrame([(1, "x. " + passage.upper().replace("AGAIN,", "AGA1N") + " tail", 3), (2, None, 1), (3, "", 1), (None, passage, 0), (None, "clean", 0), (4, "a tiny one", 1), (5, "atiny", 2), (1, "x. " + passage, 3)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, passage, "e"), (8, None, ""), (9, "", ""), (10, "Tiny", "")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id or 0, r.item_id, r.edits) for r in D.contaminated(docs, bench).collect())
    assert got == [(0, 7, 0), (1, 7, 0), (1, 7, 1), (4, 10, 0)]
    row = next(r for r in D.contaminated(docs, bench).collect() if r.doc_id == 1 and r.edits == 0)
    assert ("x. " + passage.lower()).encode()[row.start : row.end] == passage.lower().encode()[:-1]
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "clean"), (2, ""), (3, ""), (5, "atiny")]
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_long_items_are_cut(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(300))
    assert all(len(s) <= D.SEGMENT for s in D.segments(long)) and len(D.segments(long)) > 4
    docs = spark.createDataFrame([(1, "so " + long[500:1500] + " it"), (2, long), (3, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", long)], "item_id string, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()) == [(1, "q"), (2, "q")]
