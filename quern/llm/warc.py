"""WARC archives: writing with revisit records, and splittable reading by boundary-chain verification.

Writing. Records are serialised as strings (payloads are UTF-8) and written by Spark's text sink with the record separator
as line end, so archives go to any file system that Spark knows, one file per task. Of records with equal payloads of at
least ``least`` bytes, that with the smallest id is a response, the others are revisit records without a payload that
refer to it; equality is by SHA-1 and length.

Reading. Spark splits the files at the record magic, which payloads may contain as well. Tasks turn each piece into a
candidate (offset, successor) from its own header, and follow the chains inside their split down to the first offset
outside it. Entries of splits are then linked by pointer jumping (each round doubles the reach), from offset 0 of
every file; a split's records are those on the chain from its entry. Candidates that no chain reaches are magic inside
payloads: their bytes belong to the record before. Records that lie in one piece, which all do but those with magic inside,
are digested where they are read and move no payload; only the pieces of the others are put together again.

Defined results: null html is an empty payload; a null url has no target header; white space and control characters in a
url are percent-encoded. Rows that share the smallest id of a payload are all responses; null ids come last, and are all
responses if there is no other. Repeated rows give repeated records. An empty table gives an empty archive and result.
Further columns of the pages are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, drop_scratch, limit_batches, scratch, shared_dir

MAGIC, BREAK = "WARC/1.0\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
ROUNDS = 40
#: Rows (about 80 bytes each) up to which the table of shared payloads is broadcast; beyond that the join shuffles.
BROADCAST = 200_000


def tag_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to for every row of page_id, url, html."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("hex", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    first = (
        p.where(F.col("n") >= least).groupBy("hex", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("k"))
        .where("k > 1").select(F.col("hex").alias("h"), F.col("n").alias("m"), "first", F.lit(True).alias("shared"))
    )
    # The table of shared payloads is written first: if it is small it is broadcast, so payloads are not shuffled at all.
    first = scratch(first, "warc")
    if first.count() <= BROADCAST:
        first = F.broadcast(first)
    j = p.join(first, (p["hex"] == first["h"]) & (p["n"] == first["m"]), "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return j.select(
        "page_id", "url", "payload", "hex",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_text(tagged: DataFrame) -> DataFrame:
    """One string column: the record without its closing line breaks."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page, url, payload, digest, kind, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
            block = HTTP + (payload if kind == "response" else "")
            head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {DATE}"]
            if url is not None:
                safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                head.append(f"WARC-Target-URI: {safe}")
            head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
            if kind == "revisit":
                head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
            head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
            out.append(MAGIC + "\r\n".join(head) + BREAK + block)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return arrow_map(tagged.select("page_id", "url", "payload", "hex", "record_type", "refers_to"), run, "value string", 256)


def write_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write page_id, url, html as WARC files under ``path``."""
    record_text(tag_revisits(pages, least)).write.option("lineSep", BREAK).text(path)


# --- reading -------------------------------------------------------------------------------------------------------


def parse(piece: bytes) -> dict | None:
    """Header fields of the record that begins in ``piece`` (the bytes after its magic), or None if there is no header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        k, mark, v = line.partition(b":")
        if not mark:
            return None
        fields[k.strip().lower()] = v.strip()
    n = fields.get(b"content-length", b"")
    if not n.isdigit() or b"warc-type" not in fields:
        return None
    return {"head": end + 4, "n": int(n), "fields": fields}


def payload_of(block: bytes, fields: dict) -> bytes:
    """The payload of a block: what follows the HTTP header, or all of it in other records."""
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else b""
    return block


CANDIDATE = (
    "file string, block long, piece long, at long, size long, succ long, exit long, whole boolean, id string, uri string, kind string,"
    " refers string, stated string, payload_bytes long, digest string"
)


def describe(body: bytes, got: dict) -> tuple:
    f = got["fields"]
    block = body[got["head"] : got["head"] + got["n"]]
    load = payload_of(block, f)
    word = lambda k: f[k].decode(errors="replace") if k in f else None
    return (word(b"warc-record-id"), word(b"warc-target-uri"), word(b"warc-type"), word(b"warc-refers-to"), (word(b"warc-payload-digest") or "").removeprefix("sha1:") or None, len(load), base64.b32encode(hashlib.sha1(load).digest()).decode())


def pieces(spark, path: str) -> DataFrame:
    """file, block (start of the split), value (bytes after a magic, up to the next one), in reading order."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("block"), F.col("value").cast("binary").alias("value"))


def candidates(spark, path: str) -> DataFrame:
    """Candidates with offsets relative to the first piece of their split (``at``; ``succ`` and ``exit`` likewise).

    ``whole``: the record ends in its own piece. ``exit``: the first offset outside the split on the candidate's chain;
    null where the chain breaks inside it.
    """

    def flush(rows, end):
        """Chains inside one split, from its end: exit = succ if that lies outside, else the exit of the candidate there."""
        exits: dict[int, int | None] = {}
        for r in reversed(rows):
            succ = r[5]
            exits[r[3]] = None if succ is None else succ if succ >= end - len(MAGIC) else exits.get(succ)
        return [(*r[:6], exits[r[3]], *r[6:]) for r in rows]

    def run(batches):
        names = [x.strip().split()[0] for x in CANDIDATE.split(",")]
        now, rows, at, k = None, [], 0, 0

        def out(full):
            cols = list(zip(*full)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        types = [pa.string(), *[pa.int64()] * 6, pa.bool_(), *[pa.string()] * 5, pa.int64(), pa.string()]
        for b in batches:
            files, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, value in enumerate(b.column(2)):
                if (files[i], blocks[i]) != now:
                    if rows:
                        yield out(flush(rows, at))
                    now, rows, at, k = (files[i], blocks[i]), [], 0, 0
                body = value.as_py()
                got = parse(body)
                # The piece's magic starts len(MAGIC) bytes before it; the first piece of a file has none before it.
                succ = at + got["head"] + got["n"] + len(BREAK) if got else None
                whole = bool(got) and got["head"] + got["n"] + len(BREAK) <= len(body)
                what = describe(body, got) if got else (None,) * 7
                rows.append((*now, k, at - len(MAGIC), len(body), succ, whole, *what))
                at, k = at + len(body) + len(MAGIC), k + 1
        if rows:
            yield out(flush(rows, at))

    return pieces(spark, path).mapInArrow(run, CANDIDATE)


def reachable(found: DataFrame) -> DataFrame:
    """Candidates (absolute offsets) that the chain from offset 0 of their file reaches."""
    spans = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("span"))
    before = F.sum("span").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("base", F.coalesce(before, F.lit(0))).drop("span")
    held = found.join(spans, ["file", "block"])
    for c in ("at", "succ", "exit"):
        held = held.withColumn(c, F.col(c) + F.col("base"))
    held = scratch(held.drop("base"), "warc")
    # Pointer jumping over candidates: after round r a pointer spans 2**r splits. A reached candidate hands its pointer's
    # target on; all candidates double their pointers.
    hop = held.where("exit is not null").select("file", "at", F.col("exit").alias("to"))
    reach = scratch(held.where("at = 0").select("file", "at"), "warc")
    n = reach.count()
    for _ in range(ROUNDS):
        more = reach.join(hop, ["file", "at"]).select("file", F.col("to").alias("at")).join(held.select("file", "at"), ["file", "at"], "left_semi")
        nxt = scratch(reach.union(more).distinct(), "warc")
        m = nxt.count()
        drop_scratch(reach)
        reach = nxt
        if m == n:
            break
        n = m
        ahead = hop.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        hop = scratch(hop.join(ahead, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "warc")
    else:
        raise RuntimeError("the chains of splits did not settle")
    entries = held.join(reach, ["file", "at"], "left_semi").select("file", "block", F.col("at").alias("entry"))

    def walk(table: pa.Table) -> pa.Table:
        p = table.sort_by("at")
        at, succ, entry = (p.column(c).to_pylist() for c in ("at", "succ", "entry"))
        place, keep, i = {a: j for j, a in enumerate(at)}, [], entry[0]
        while i in place:
            keep.append(place[i])
            i = succ[place[i]]
        return p.select(["file", "at"]).take(pa.array(keep, pa.int64()))

    # A split has one entry at most: chains that meet stay together, and offset 0 is the only start.
    chains = held.select("file", "block", "at", "succ").join(entries, ["file", "block"]).groupBy("file", "block").applyInArrow(walk, "file string, at long")
    out = held.join(chains.withColumn("on_chain", F.lit(True)), ["file", "at"], "left")
    return scratch(out.withColumn("on_chain", F.coalesce("on_chain", F.lit(False))), "warc")


def read_warc(spark, path: str) -> DataFrame:
    """file, offset, id, uri, kind, refers, stated (digest in the header), payload_bytes, digest (computed) of every record."""
    limit_batches(spark)
    found = scratch(candidates(spark, path), "warc")
    held = reachable(found)
    drop_scratch(found)
    names = ["id", "uri", "kind", "refers", "stated", "payload_bytes", "digest"]
    records = held.where("on_chain").select("file", F.col("at").alias("offset"), "whole", *names)
    done = records.where("whole").drop("whole")
    if not records.where("not whole").take(1):
        return done
    # Pieces of broken records: from the record's own to the last before its successor.
    broken = held.where("on_chain").groupBy("file", "block").agg(F.max(F.struct("at", "succ", "whole")).alias("b"))
    broken = broken.where("not b.whole").select("file", F.col("b.at").alias("offset"), F.col("b.succ").alias("succ"))
    last = F.last(F.when(F.col("on_chain"), F.struct("at", "whole")), ignorenulls=True)
    owner = last.over(Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    # Within a split the owner is the last record before a piece; pieces before the first record of a split belong to the
    # record that runs into it: the last one of an earlier split, one per split.
    parts = held.select("file", "block", "piece", "at", owner.alias("o"))
    inside = parts.where("o is not null and not o.whole").select("file", "block", "piece", "at", F.col("o.at").alias("offset"))
    run_in = parts.where("o is null").select("file", "block", "piece", "at")
    run_in = run_in.join(broken, "file").where("at > offset and at < succ").select("file", "block", "piece", "at", "offset")
    wanted = scratch(inside.union(run_in).distinct(), "warc")

    def number(batches):
        now, k = None, 0
        for b in batches:
            ks = []
            for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now, k = ((f, s), 0) if (f, s) != now else (now, k + 1)
                ks.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ks, pa.int64())], ["file", "block", "value", "piece"])

    numbered = pieces(spark, path).mapInArrow(number, "file string, block long, value binary, piece long")
    bodies = numbered.join(wanted, ["file", "block", "piece"]).groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    kinds = "file string, offset long, id string, uri string, kind string, refers string, stated string, payload_bytes long, digest string"

    def rejoin(batches):
        for b in batches:
            rows = []
            for f, o, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body = MAGIC.encode().join(bytes(p["value"]) for p in parts)
                rows.append((f, o, *describe(body, parse(body))))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["file", "offset", *names]), preserve_index=False, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), *((n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names)]))

    return done.select("file", "offset", *names).union(bodies.mapInArrow(rejoin, kinds).select("file", "offset", *names))


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, resolve revisits."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/quern/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least)
    got = scratch(read_warc(spark, path), "warc")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    ident = lambda c: F.when(number(c) != "", number(c).cast("long"))
    rows = got.select(ident("id").alias("page_id"), "payload_bytes", F.coalesce("stated", "digest").alias("payload_digest"), "digest", F.col("kind").alias("record_type"), ident("refers").alias("refers_to"))
    full = rows.where("record_type = 'response'").groupBy("page_id", "digest").agg(F.max("payload_bytes").alias("full"))
    full = full.select(F.col("page_id").alias("rid"), F.col("digest").alias("rdigest"), "full")
    j = rows.join(full, (rows["refers_to"] == full["rid"]) & (rows["payload_digest"] == full["rdigest"]), "left")
    n = F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("payload_bytes"))
    digest = F.when(F.col("record_type") == "revisit", F.col("rdigest")).otherwise(F.col("digest"))
    return j.select("page_id", n.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY payload) AS first,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}',
      ((('0x' || substr(h, 5 * (i // 4)::BIGINT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""
