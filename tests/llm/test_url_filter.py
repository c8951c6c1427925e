import random
import re

import pytest

from quern.llm import url_filter as U

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower(s):
    return "".join(chr(ord(c) + 32) if c in UPPER else c for c in s)


def brute(url, strict, soft, limit, rules):
    """Every term by a regular expression of its own; every rule tried on every url."""
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = lower(m[1]), m[2]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    hit = lambda t: url is not None and re.search(rf"(?<![a-z0-9]){re.escape(lower(t))}(?![a-z0-9])", lower(url)) is not None
    s, w = {lower(t) for t in strict if hit(t)}, {lower(t): x for t, x in soft.items() if hit(t) and lower(t) not in map(lower, strict)}
    best = max(fit, default=None)
    verdict = best[3] if best else "block" if s or sum(w.values()) >= limit - 1e-12 else "allow"
    return host, path, best and best[2], verdict, ",".join(sorted(s | set(w)))


ODD = [
    None, "", "casino", "no-scheme.example.com/en/7", "http://", "://x", "HTTP://Sub.EXAMPLE.com/en/7?casino", "https://example.com/en/7", "https://example.com/en/8", "http://notexample.com/en/7",
    "http://a.net/de/8", "http://example.net/de/8/x", "http://b.org/es/", "http://b.org/es", "http://x.io/CASINO-royale", "http://x.io/casinos", "http://x.io/free?win=1#bet", "http://x.io/free/free",
    "http://x.io/cheap%20pills", "ftp://u:p@host:80?q#f", "http://é.com/casino\u0130", "http://x.io/" + "a/" * 30_000 + "porn", "a://b://c.com/x", "http://com/en/", "\n://h\n/p",
]


def test_odd_rows_ties_repeats_and_clashing_columns(spark):
    rows = [(i, u, "keep", "old") for i, u in enumerate(ODD)] + [(1, ODD[7], "again", "old"), (1, ODD[7], "again", "old"), (None, ODD[7], None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, extra string, verdict string")
    got = U.url_filter(df)
    assert got.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict", "terms"]
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(rows)
    for _, url, _, *rest in out:
        assert tuple(rest) == brute(url, U.STRICT_TERMS, U.SOFT_TERMS, U.SOFT_LIMIT, U.RULES), url
    assert U.url_filter(df.limit(0)).collect() == []


def test_rules_of_equal_length_and_weights(spark):
    rules = [("b.com", "/x", "block"), ("com", "/x/bb", "allow"), ("a.b.com", "", "allow")]
    soft, urls = {"ab": 0.75, "cd": 1.25, "cd-ef": 0.25, "EF": 0.5}, ["http://b.com/x/bb", "http://a.b.com/x", "http://q.io/ab/cd", "http://q.io/ab/ef", "http://q.io/cd-ef", "http://q.io/CD-EF/ab", "http://q.io/zz"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict, r.terms) for r in U.url_filter(df, strict=("ZZ",), soft=soft, soft_limit=2.0, rules=rules).collect()}
    assert got == {u: brute(u, ("ZZ",), soft, 2.0, rules) for u in urls}
    assert [got[u][3] for u in urls] == ["allow", "allow", "block", "allow", "block", "block", "block"]


def test_a_vocabulary_table_of_real_size(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(3000)})
    strict = words[::9]
    soft = {w: rng.choice([0.25, 0.5, 1.0]) for w in words if w not in strict}
    table = spark.createDataFrame([(w, "strict", None) for w in strict] + [(w, "soft", x) for w, x in soft.items()], "term string, kind string, weight double")
    assert U.vocabulary(table) == (tuple(sorted(strict)), soft)
    urls = ["http://h.io/" + rng.choice(["-", "/", "."]).join(rng.choice(words) if rng.random() < 0.3 else rng.choice(words) + "z" for _ in range(6)) for _ in range(150)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    s, w = U.vocabulary(table)
    got = {r.url: (r.host, r.path, r.rule, r.verdict, r.terms) for r in U.url_filter(df, strict=s, soft=w).collect()}
    for u in urls:
        assert got[u] == brute(u, s, w, U.SOFT_LIMIT, U.RULES)
    assert {v[3] for v in got.values()} == {"allow", "block"}
    with pytest.raises(ValueError):
        U.url_filter(df, strict=[str(i) for i in range(U.MAX_TERMS + 1)])
