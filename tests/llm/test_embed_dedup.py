import numpy as np

from quern.llm import embed_dedup as E


def brute(rows, threshold=0.95):
    ok = [r for r in rows if r[1] is not None and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(np.array(r[1], float))]
    n = len(ok)
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = np.array(ok[i][1], float), np.array(ok[j][1], float)
            links[i, j] = i != j and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([comp[i], *(comp[j] for j in np.flatnonzero(links[i]))])
            if low < comp[i]:
                comp[i], changed = low, True
    least = {c: min((ok[i][0] for i in range(n) if comp[i] == c and ok[i][0] is not None), default=None) for c in set(comp)}
    out = [(ok[i][0], int(links[i].sum()), least[comp[i]]) for i in range(n)]
    out += [(r[0], 0, r[0]) for r in rows if not any(r is o for o in ok)]
    return sorted(((v, k, c, v is not None and v == c) for v, k, c in out), key=str)


def test_against_brute_force_with_small_tiles(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 12))
    rows = []
    for i in range(150):
        x = base[i % 20] + rng.normal(size=12) * rng.choice([0, 0.05, 0.3])
        rows.append((1000 - i, [float(np.float32(v)) for v in x]))
    rows += [(2001, None), (2002, [0.0] * 12), (2003, [float("nan")] + [1.0] * 11), (2004, [None] + [1.0] * 11), (2005, [float("inf")] * 12), (2006, []), (2007, [1.0, 2.0]), (2008, [2.0, 4.0]), (None, list(rows[0][1])), rows[3], (-1, [0.0, 1.0]), (5000, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for tile in (8192, 40):
        got = sorted((tuple(r) for r in E.embedding_groups(df, tile=tile).collect()), key=str)
        assert got == brute(rows)
    assert E.embedding_groups(df.limit(0)).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64)) * rng.choice([1e-6, 1, 1e6], size=(400, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, size, err = E.quantise(x)
    about = E.product(q, q) * s[:, None] * s[None, :]
    assert (np.abs(about - x @ x.T) <= err[:, None] + size[:, None] * err[None, :] + 1e-6).all()
    long = rng.integers(-127, 128, (3, 5000)).astype(np.int8)
    assert (E.product(long, long) == long.astype(np.int64) @ long.astype(np.int64).T).all()


def test_vectors_of_any_finite_scale_and_further_columns(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(v) for v in base[i % 6] + rng.normal(size=8) * 0.08]) for i in range(40)]
    plain = {r[0]: tuple(r) for r in E.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert any(r[1] for r in plain.values())
    for scale in (1e200, 1e-170, 1e-310):
        if scale > 1e-300:
            big = [(i, [v * scale for v in x], "k", i) for i, x in rows]
        else:  # subnormal numbers keep few bits: whole multiples of the smallest one
            big = [(i, [round(v * 1e6) * 5e-324 for v in x], "k", i) for i, x in rows]
        df = spark.createDataFrame(big, "vec_id long, embedding array<double>, key string, cls int")
        got = {r[0]: tuple(r) for r in E.embedding_groups(df, tile=7).collect()}
        assert got == plain, scale


def test_sure_and_open_pairs_agree_with_exact_products():
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(8, 64)), 12, axis=0) + rng.normal(size=(96, 64)) * rng.choice([0.05, 0.2, 0.24], size=(96, 1))
    q, s, size, err = E.quantise(E.units(x))
    cls, one, side = np.arange(96), np.ones(96, np.int64), np.full(96, 2)
    first = E.tile_links(cls, one, side, q, s, size, err, 0.95)
    second = E.tile_links(cls, one, side, q, s, size, err, 0.95, x)
    n = np.zeros(96, np.int64)
    for t in (first, second):
        n[t["cls"]] += t["linked"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (n == ((unit @ unit.T >= 0.95).sum(axis=1) - 1)).all()
    assert first["open"].any() and second["linked"].sum() > 0 and first["linked"].sum() > second["linked"].sum()
