import base64
import hashlib

import pytest

from quern.llm import warc as W

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 700),
    (6, "u", "in WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nfalse\r\n\r\n and WARC/1.0\r\n twice"), (7, "u", "WARC/1.0\r\n" * 400),
    (8, "u", "WARC/1.0\r\n" * 400), (9, "u", "\r\n\r\n"), (10, "u", "x" * 5000), (-3, "u", "x" * 5000), (11, "u", "\r\n\r\nWARC/1.0\r\n"), (None, "u", "<p>one</p>"), (None, "u", "only"),
]


def brute(pages):
    groups, out = {}, []
    for i, _, html in pages:
        groups.setdefault(html or "", []).append(i)
    for i, _, html in pages:
        first = min((x for x in groups[html or ""] if x is not None), default=None)
        data = (html or "").encode()
        kind = "response" if i == first else "revisit"
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first if kind == "revisit" else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [300, 1 << 27])
def test_round_trip_with_magic_in_payloads(spark, split):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        assert sorted((tuple(r) for r in W.warc_round_trip(df).collect()), key=str) == brute(PAGES)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_archive_text_least_size_and_empty(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:5], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    W.write_warc(df.coalesce(1), path, least=1)
    (file,) = (tmp_path / "w").glob("part-*")
    data = file.read_bytes()
    assert data.startswith(b"WARC/1.0\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
    assert b"WARC-Target-URI: http://a/2%0D%0AX:%20y\r\n" in data and data.count(b"WARC-Type: revisit") == 1
    rows = W.read_warc(spark, path).collect()
    assert len(rows) == 5 and all(r.stated == r.digest for r in rows if r.kind == "response")
    assert W.warc_round_trip(df.limit(0)).count() == 0
