"""Benchmark decontamination by the q-gram lemma: shared q-grams in diagonal bands, then banded alignment.

Texts are lower-cased, and every run of ASCII white space and punctuation counts as one blank. An item (a benchmark
passage; those of over ``SEGMENT`` bytes are cut into segments, each an item of its own) is found in a document if some
part of the document is within k = floor(``RATE`` * m) edits of it, m being its length in UTF-8 bytes.

Lemma: k edits spoil at most k*q of the m - q + 1 q-grams, the others occur in the document, and their diagonals (place in
the document minus place in the item) differ by at most k. So bands of 2*(k+1) diagonals that start every k+1 diagonals
contain, for some band, at least m - q + 1 - k*q hits (pairs of equal q-grams on the band). Bands under that bound are
dropped without loss; the others are verified by an alignment restricted to their diagonals. Where the bound
would be below one, k is lowered to the largest value that keeps it (short items); items under q bytes must occur exactly,
between blanks or ends.

The benchmark is the stated query set: it goes to the workers in blocks of at most ``BLOCK`` bytes, one pass over the
documents per block, whatever its size. Documents are never shuffled. Results are one row per document and item.

Defined results: null and empty documents contain nothing, null and empty items are found nowhere. Repeated documents and
null ids are judged row by row. Empty tables give an empty result. Documents keep only the id here; ``decontaminate``
keeps all columns of the documents that stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import limit_batches, merge_splits, worker_state

Q, RATE, SEGMENT, BLOCK = 8, 0.1, 400, 4 << 20
#: Places worked on at once.
WINDOW = 1 << 18
_CLASS = np.full(256, 32, np.uint8)
_CLASS[48:58] = np.arange(48, 58)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_HASH = np.uint64(0x9E3779B97F4A7C15)
_BITS = 21


def squeeze(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with single blanks, their places in ``raw``)."""
    c = _CLASS[raw]
    blank = c == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    if len(keep):
        keep[0] = True
    at = np.flatnonzero(keep)
    return c[at], at


def normal(text: str) -> bytes:
    return squeeze(np.frombuffer(pc.utf8_lower(pa.scalar(text)).as_py().encode(), np.uint8))[0].tobytes().strip(b" ")


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """The q-grams (q <= 8) of a byte array as integers."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.append(x, np.zeros(8, np.uint8))
    view = np.ndarray((n,), "<u8", padded.tobytes(), 0, (1,))
    return view & np.uint64((1 << (8 * q)) - 1) if q < 8 else view.copy()


def banded_distance(item: bytes, doc: bytes, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of all of ``item`` with a part of ``doc`` on diagonals low..high.

    Free ends in the document; None if it takes more than k edits. One row per byte of the item, one cell per diagonal.
    """
    width, d = high - low + 1, np.frombuffer(doc, np.uint8)
    far = len(item) + len(doc) + 1
    place = low + np.arange(width)  # the number of document bytes before the cell, in row 0
    cost = np.where((place >= 0) & (place <= len(d)), 0, far)
    begin = place.copy()
    steps = np.arange(width)
    for i, c in enumerate(item, 1):
        place = place + 1
        ok = (place >= 1) & (place <= len(d))
        same = np.zeros(width, bool)
        same[ok] = d[place[ok] - 1] == c
        new = np.where(ok, cost + ~same, far)  # match or replace
        first = begin.copy()
        drop = np.append(cost[1:] + 1, far)  # a byte of the item is missing in the document
        better = drop < new
        new = np.where(better, drop, new)
        first = np.where(better, np.append(begin[1:], 0), first)
        new = np.where((place >= 0) & (place <= len(d)), new, far)
        run = new - steps  # a byte of the document is extra: from the left, one edit each
        best = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == best, steps, 0))
        cost, begin = best + steps, first[source]
        cost = np.where((place >= 0) & (place <= len(d)), cost, far)
        if cost.min() > k:
            return None
    j = int(np.argmin(cost))
    return (int(cost[j]), int(begin[j]), int(place[j])) if cost[j] <= k else None


class Items:
    """A block of items with the index of their q-grams."""

    def __init__(self, items: list[tuple], q: int = Q, rate: float = RATE):
        self.q, self.keys, self.text, self.short = q, [], [], []
        for key, text in items:
            (self.short if len(text) < q else self.text).append((key, text))
        m = np.array([len(t) for _, t in self.text], np.int64)
        self.k = np.minimum((rate * m).astype(np.int64), (m - q) // q)
        self.bound = m - q + 1 - self.k * q
        code = [grams(np.frombuffer(t, np.uint8), q) for _, t in self.text]
        owner = np.repeat(np.arange(len(code)), [len(c) for c in code])
        place = np.concatenate([np.arange(len(c)) for c in code]) if code else np.zeros(0, np.int64)
        code = np.concatenate(code) if code else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.code, self.first, self.n = np.unique(code[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.code * _HASH) >> np.uint64(64 - _BITS)] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x, number of the q-gram) of all q-grams of x that some item has."""
        out = []
        for i in range(0, max(len(x) - self.q + 1, 0), WINDOW):
            g = grams(x[i : i + WINDOW + self.q - 1], self.q)
            at = np.flatnonzero(self.seen[(g * _HASH) >> np.uint64(64 - _BITS)])
            g = g[at]
            j = np.minimum(np.searchsorted(self.code, g), max(len(self.code) - 1, 0))
            true = self.code[j] == g if len(self.code) else np.zeros(len(g), bool)
            out.append((at[true] + i, j[true]))
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(2))

    def bands(self, x: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, lowest, highest diagonal) of the regions that meet the bound; neighbours are merged.

        ``doc_of``: start places of the documents that x is made of.
        """
        at, gram = self.hits(x)
        doc = np.searchsorted(doc_of, at, side="right") - 1
        edge = np.append(doc_of[1:], len(x))
        at_ok = at + self.q <= edge[doc]
        at, gram, doc = at[at_ok], gram[at_ok], doc[at_ok]
        # A document takes part only if it has enough hits for the lowest bound.
        enough = np.bincount(doc, minlength=len(doc_of)) >= (self.bound.min() if len(self.bound) else 1)
        at, gram, doc = at[enough[doc]], gram[enough[doc]], doc[enough[doc]]
        held, begin = [], 0
        while begin < len(at):  # documents are not split: their hits are counted together
            end = begin + 1 + np.searchsorted(np.cumsum(self.n[gram[begin : begin + (WINDOW >> 2)]]), WINDOW)
            end = min(end, len(at))
            if end < len(at) and doc[end] == doc[end - 1]:
                end = int(np.searchsorted(doc, doc[end - 1], side="right"))
            held.append((begin, end))
            begin = end
        for begin, end in held:
            yield from self._regions(at[begin:end], gram[begin:end], doc[begin:end], doc_of)

    def _regions(self, at, gram, doc, doc_of):
        n = self.n[gram]
        rows = np.repeat(np.arange(len(at)), n)
        entry = np.repeat(self.first[gram], n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        item, place = self.owner[entry], self.place[entry]
        own = doc[rows]
        diagonal = at[rows] - doc_of[own] - place
        step = self.k[item] + 1
        band = np.floor_divide(diagonal, step)
        # (document, item) pairs without enough hits in all cannot have a band with enough.
        pair = own * len(self.text) + item
        u, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        fit = (count >= self.bound[u % len(self.text)])[inverse]
        pair, band = pair[fit], band[fit]
        # A band covers steps b and b+1. Hits are counted, of which there are at least as many as places of the item.
        half = np.int64(1) << 31
        code, count = np.unique(np.concatenate([pair << 32 | (band + half), pair << 32 | (band - 1 + half)]), return_counts=True)
        pair, band = code >> 32, (code & np.int64(0xFFFFFFFF)) - half
        good = count >= self.bound[pair % len(self.text)]
        last = None
        for p, b in zip(pair[good].tolist(), band[good].tolist(), strict=True):
            k = int(self.k[p % len(self.text)])
            low, high = b * (k + 1) - k, (b + 2) * (k + 1) - 1 + k
            if last and last[0] == p and low <= last[2]:
                last[2] = high
            else:
                if last:
                    yield divmod(last[0], len(self.text)) + (last[1], last[2])
                last = [p, low, high]
        if last:
            yield divmod(last[0], len(self.text)) + (last[1], last[2])

    def find(self, raw: np.ndarray, starts: np.ndarray) -> list[tuple]:
        """(document, item key, start, end, edits): the best region per document and item, in bytes of the document."""
        x, at = squeeze(raw)
        cut = np.searchsorted(at, starts)  # a blank that runs over a border is kept by the earlier text
        best: dict[tuple, tuple] = {}
        edge = np.append(cut[1:], len(x))
        for d, i, low, high in self.bands(x, cut):
            key, text = self.text[i]
            k = int(self.k[i])
            lo, hi = max(low, 0), min(high + len(text), int(edge[d] - cut[d]))
            part = x[cut[d] + lo : cut[d] + hi].tobytes()
            p = part.find(text)
            found = (0, p, p + len(text)) if p >= 0 else banded_distance(text, part, low - lo, high - lo, k)
            if found:
                edits, s, e = found
                begin = int(at[cut[d] + lo + s] - starts[d])
                stop = int(at[min(cut[d] + lo + e - 1, len(at) - 1)] - starts[d]) + 1
                row = (edits, begin, stop)
                if (d, key) not in best or row < best[d, key]:
                    best[d, key] = row
        if self.short:
            for d in range(len(starts)):
                padded = b" " + x[cut[d] : edge[d]].tobytes() + b" "
                for key, text in self.short:
                    p = padded.find(b" " + text + b" ") if text else -1
                    if p >= 0:
                        best[d, key] = (0, int(at[cut[d] + p] - starts[d]), int(at[cut[d] + p + len(text) - 1] - starts[d]) + 1)
        return [(d, key, s, e, edits) for (d, key), (edits, s, e) in sorted(best.items(), key=lambda r: (r[0][0], str(r[0][1])))]


def segments(text: str | None, size: int = SEGMENT) -> list[bytes]:
    """The normal form in pieces of about equal length, none over ``size`` bytes."""
    whole = normal(text or "")
    n = -(-len(whole) // size)
    return [whole[len(whole) * i // n : len(whole) * (i + 1) // n].strip(b" ") for i in range(n)]


def blocks(benchmark: DataFrame, key: str, text: str, limit: int = BLOCK) -> Iterator[list[tuple]]:
    """The items in blocks of at most about ``limit`` bytes, read one partition at a time."""
    held, size = [], 0
    for r in benchmark.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        for s in segments(r[1]):
            if s:
                held.append((r[0], s))
                size += len(s)
                if size >= limit:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, key: str = "item_id") -> DataFrame:
    """doc_id, item_id, start, end (bytes of the lower-cased text), edits: one row per document row and item found."""
    spark = docs.sparkSession
    limit_batches(spark)
    kind = benchmark.schema[key].dataType
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField(key, kind), *(T.StructField(n, T.LongType()) for n in ("start", "end", "edits"))])
    parts = []
    for block in blocks(benchmark, key, "text"):
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, block, q, rate))

        def run(batches, held=held):
            items = worker_state(held, Items)
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    c = b.slice(i, 512)
                    yield found_in(c, items, schema)

        parts.append(merge_splits(docs.select("doc_id", "text")).mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    if len(parts) > 1:  # segments of one item may lie in different blocks
        out = out.groupBy("doc_id", key).agg(F.min(F.struct("edits", "start", "end")).alias("m")).select("doc_id", key, "m.start", "m.end", "m.edits")
    return out


def found_in(b: pa.RecordBatch, items: Items, schema: T.StructType) -> pa.RecordBatch:
    low = pc.utf8_lower(pc.fill_null(b.column(1), "")).cast(pa.large_binary())
    ends = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    # A zero byte between texts counts as a blank, so that nothing runs over a border.
    n = len(low)
    raw = np.zeros(len(data) + n, np.uint8)
    starts = ends[:-1] - ends[0] + np.arange(n)
    raw[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(ends))] = data
    # Every text begins with its own place: a blank first byte is kept by squeeze only if the one before is none.
    rows = items.find(raw, starts)
    cols = list(zip(*rows)) or [()] * 5
    ids = b.column(0).take(pa.array(cols[0], pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array(cols[1], to_arrow_type(schema[1].dataType)), *(pa.array(c, pa.int64()) for c in cols[2:])], schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which an item is found; those without an id are judged too and kept or dropped."""
    spark = docs.sparkSession
    limit_batches(spark)
    fields, out = list(docs.columns), merge_splits(docs)
    text_at = fields.index("text")
    small = T.StructType([T.StructField("d", T.LongType()), T.StructField("i", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("start", "end", "edits"))])
    for block in blocks(benchmark, "item_id", "text"):
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, [(0, t) for _, t in block], options.get("q", Q), options.get("rate", RATE)))

        def run(batches, held=held):
            items = worker_state(held, Items)
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    c = b.slice(i, 512)
                    numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(c.num_rows)), c.column(text_at)], ["d", "text"])
                    keep = np.ones(c.num_rows, bool)
                    keep[found_in(numbered, items, small).column(0).to_numpy()] = False
                    yield c.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
