"""Image recovery against a plain scan of every book's lines."""

import random
import re
from urllib.parse import unquote

from quern.operators import images as I
from quern.plans import load

EVIDENCE = "book_id long, id string, path string, locator string, excerpt string, extra int"
MD_IMAGE, TAG = re.compile(r"!\[([^\]]*)\]\(([^)\n]+)\)"), re.compile(r"""<img\b[^>]*\bsrc=["']([^"']+)["'][^>]*>""", re.I)


def base(p):
    return ([x for x in p.strip().replace("\\", "/").split("/") if x] or [""])[-1]


def markup(v):
    return (m[2].strip() if (m := MD_IMAGE.search(v)) else "") or (m[1].strip() if (m := TAG.search(v)) else "")


def clean(line):
    line = re.sub(r"!\[([^\]]*)\]\(([^)]+)\)", lambda m: f"[图片：{m[1].strip() or base(m[2])}]", line)
    line = TAG.sub(lambda m: f"[图片：{base(m[1])}]", line)
    return re.sub(r"\s+", " ", re.sub(r"^#{1,6}\s+", "", line)).strip()


def scan(row, lines, assets, window=16):
    """(raw path, source line, image path) by loops over all lines."""
    path, locator, excerpt = (x or "" for x in row)
    like = lambda v: markup(v) or (v if re.search(r"\.(png|jpe?g|webp|gif|bmp|svg)(\?.*)?$", v, re.I) else "")
    raw = path.strip() or like(locator) or like(excerpt)
    if re.match("https?://", raw, re.I) or raw in assets:
        return raw, None, raw
    candidates = [c for p in (raw, markup(excerpt)) if p for c in (p, unquote(p), base(p)) if c]
    at = next((n for n, x in enumerate(lines, 1) if any(c in x for c in candidates)), None)
    text = clean(excerpt)
    if at is None and len(text) >= 8:
        plain = re.sub(r"\s+", " ", re.sub(r"\[图片：[^\]]+\]", " ", text)).strip()
        parts = [s.strip()[:80] for s in [*re.split("[。！？；]", plain), plain] if len(s.strip()) >= 12]
        for needle in [text, *parts]:
            at = at or next((n for n, x in enumerate(lines, 1) if needle in clean(x)), None)
    if at is None and (m := re.search(r"line:(\d+)", locator, re.I)):
        at = int(m[1])
    if at is None or not 1 <= at <= len(lines):
        return raw, None, None
    before = next((p for n in range(at, max(0, at - window - 1), -1) if (p := markup(lines[n - 1]))), None)
    after = next((p for n in range(at + 1, min(len(lines), at + window) + 1) if (p := markup(lines[n - 1]))), None)
    return raw, at, before or after


def book(rng, size):
    words = ["energy", "wave", "figure", "the", "水的循环过程", "力", "a", "bb"]
    out = []
    for _ in range(size):
        kind = rng.random()
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(8)))
        image = f"img/{rng.choice('abc')}/f{rng.randrange(9)}.png"
        out.append(f"![{rng.choice(['', ' ', ' alt text '])}]({image})" if kind < 0.08 else f'<p><img width=3 src="{image}"> {text}</p>' if kind < 0.12 else f"## {text}" if kind < 0.2 else text + rng.choice(["", "。再来一句话说明这件事情。", "\t  x"]))
    return out


def test_equals_a_scan_of_all_lines(spark):
    rng = random.Random(11)
    books = {k: book(rng, rng.choice([0, 1, 30, 120])) for k in range(30)}
    assets = {(k, "known.png") for k in range(0, 30, 2)}
    rows = []
    for k, text in books.items():
        for i in range(25):
            line = rng.choice(text) if text else "nothing here"
            path = rng.choice([None, "", "", " f3.png ", "img/a/f1.png", "known.png", "https://x/y.png", "no%20such%2Fimg/b/f2.png", "x", "zz\\f4.png", "100% odd %zz", "a+b.png"])
            locator = rng.choice([None, "", f"line:{rng.randrange(140)}", "LINE:7", "![](img/c/f5.png)", "line:99999999999999", "pic.JPG?x=1"])
            excerpt = rng.choice([None, "", line, line[3:], f"prefix。{line}", f"{line}！ {line[:9]} other words", f"![]({'img/b/f' + str(rng.randrange(12)) + '.png'}) {line}"])
            rows.append((k, f"e{i}", path, locator, excerpt, 1))
    rows.append((99, "e0", None, "line:1", "a book without text", 1))
    got = I.recover_images(spark.createDataFrame(rows, EVIDENCE).repartition(4), spark.createDataFrame([(k, "\n".join(v)) for k, v in books.items()], "book_id long, md string"), spark.createDataFrame(sorted(assets), "book_id long, path string"))
    have = {(r.book_id, r.id): (r.raw_path, r.source_line, r.image_path) for r in got.collect()}
    # A book without text is one empty line.
    want = {(k, i): scan(x, books.get(k, []) or ([""] if k in books else []), {a for b, a in assets if b == k}) for k, i, *x, _ in rows}
    assert len(have) == len(rows)
    assert {k: (v, want[k]) for k, v in have.items() if v != want[k]} == {}
    assert sum(v[2] is not None and v[1] is not None for v in want.values()) > 150


def test_empty(spark):
    none = lambda s: spark.createDataFrame([], s)
    assert I.recover_images(none(EVIDENCE), none("book_id long, md string"), none("book_id long, path string")).collect() == []


def test_first_lines_of_long_texts():
    """The index of grams gives the first hit, as a search from the start does."""
    rng = random.Random(3)
    for _ in range(40):
        text = ["".join(rng.choice("ab水\t") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 60))]
        short, long = I.Lines(text), I.Lines(text, small=0)
        for _ in range(60):
            line = rng.choice(text)
            i = rng.randrange(len(line) + 1)
            needle = rng.choice([line, line[i:], line[i : i + 3], line[i : i + 12] + "b", "a\nb", "", "zz"])
            want = next((n for n, x in enumerate(text, 1) if needle in x), None) if needle else None
            assert short.first(needle) == long.first(needle) == want, (text, needle)
    assert I.Lines([]).first("a") is None and I.Lines([], 0).first("a") is None and I.Lines([""], 0).first("a") is None
    same = ["x" * 40] * 20_000 + ["y" + "x" * 39]
    assert [I.Lines(same).first(n) for n in ("x" * 40, "yx", "x" * 41)] == [1, 20_001, None]


def test_rows_of_no_book_and_rows_with_one_id(spark):
    rows = [(None, "e0", "https://x/y.png", None, None, 1), (None, "e1", None, "line:1", "no book", 2), (1, "e2", None, "line:1", None, 3), (1, "e2", None, "line:2", None, 4), (1, "e3", "HTTP://x/z", None, None, 5)]
    got = I.recover_images(spark.createDataFrame(rows, EVIDENCE), spark.createDataFrame([(1, "![](a.png)\ntext"), (2, None)], "book_id long, md string"), spark.createDataFrame([], "book_id long, path string"))
    assert sorted((r.extra, r.source_line, r.image_path) for r in got.collect()) == [(1, None, "https://x/y.png"), (2, None, None), (3, 1, "a.png"), (4, 2, "a.png"), (5, None, "HTTP://x/z")]


def test_evidence_is_dealt_once_and_no_grams_are(spark):
    """One exchange a table, both by the book; lines are not multiplied by their grams."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = load().QUERIES["d38_recovered_images"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("hashpartitioning(book_id#") == plan.count("hashpartitioning(") == 2
