"""Components of many small graphs at once, and review counts by known answers."""

import random

from quern.operators import quality as Q


def roots(nodes, edges):
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in edges:
        if a in at and b in at:
            at[find(a)] = find(b)
    return len({find(n) for n in at})


def test_components_of_many_lessons(spark):
    rng = random.Random(6)
    nodes, edges = [], []
    for k in range(200):
        n = rng.choice([0, 1, 5, 40])
        nodes += [(k, rng.choice(["", " "]) + f"n{i}") for i in range(n)] + [(k, " ")] * (k % 3 == 0)
        edges += [(k, f"n{rng.randrange(n + 2)} ", f"n{rng.randrange(n + 2)}") for _ in range(n // 2)]
    edges += [(0, "n1", "n1"), (999, "n1", "n2")]
    got = {r.lesson: r.components for r in Q.lesson_components(spark.createDataFrame(nodes, "lesson int, id string"), spark.createDataFrame(edges, "lesson int, from_id string, to_id string")).collect()}
    want = {}
    for k in {k for k, i in nodes if i.strip()}:
        want[k] = roots({i.strip() for b, i in nodes if b == k and i.strip()}, [(a.strip(), c.strip()) for b, a, c in edges if b == k])
    assert got == want


def test_pending_images(spark):
    rows = [("image", '{"image_relevance":{"review_status":"pending"}}', True), (" Image ", '{"image_relevance":{"relevance":"uncertain"}}', True), ("image", '{"image_relevance":{"review_status":"approved","relevance":"uncertain"}}', False),
            ("text", '{"image_relevance":{"review_status":"pending"}}', False), ("image", "{}", False), ("image", "oops", False), ("image", None, False), (None, None, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, modality string, properties string, want boolean")
    assert all(r.got == r.want for r in df.select("want", Q.pending_image().alias("got")).collect())
