"""Best-fit packing by the configuration linear program over the length histogram.

Documents become token ids plus an end id. Only those longer than a sequence are cut, from the end, into full pieces; the
first piece may be shorter. Packing depends on lengths alone, so the driver plans with the histogram (at most ``size``
counts, whatever the corpus): a configuration is a multiset of lengths that fits one sequence, and the program minimises
the number of configurations that cover all pieces. It is solved by multiplicative weights: the price of a length falls
exponentially with the share of its demand that is covered, a knapsack dynamic program finds the best filling of every
capacity at these prices, and each of the ``BATCH`` lengths covered least is used with the best filling of its rest, ``STEP`` of
the scarcest demand in it at a time. Rounds end when every length is covered, so the fractional solution is feasible; it needs about
1 % more sequences than the total length asks for at least.

The uses are rounded in order by their running sum, those with the longest pieces first, against the counts that remain: a configuration whose pieces have run out
in part keeps what is there, and is completed best fit (lengths that fill it as far as a bounded subset sum can). What
the program leaves by rounding is packed the same way, the longest piece first.

The plan is a table of rank ranges (length, from rank, per sequence, first sequence, offset), bounded by the number of
configurations. Pieces get their rank within their length from counts by task and length, then look up their place in
the broadcast plan. Nothing is grouped by length, so a length that a third of all pieces have is no hot key.

Defined results: null text packs as empty (its end id alone). Null ids and repeated rows are packed row by row. An empty
table gives an empty result. Further columns of the pieces are passed through; ``sequence_id`` and ``offset`` replace
columns of these names.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import arrow_map, scratch, worker_state
from quern.llm.vocab import ByteIds, byte_ranks, read_tokenizer

SIZE, END = 1024, 2
BATCH, STEP, ETA = 64, 0.01, 8.0


# --- the plan ------------------------------------------------------------------------------------------------------


def fillings(value: np.ndarray, size: int) -> np.ndarray:
    """Unbounded knapsack for every capacity: the length to take first (0: leave a place free) for the highest sum of values."""
    best, take = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        v = best[:c][::-1] + value[1 : c + 1]
        i = int(np.argmax(v))
        if v[i] > best[c - 1]:
            best[c], take[c] = v[i], i + 1
        else:
            best[c] = best[c - 1]
    return take


def configuration(take: np.ndarray, capacity: int) -> Counter:
    """The multiset of lengths of the best filling of a capacity."""
    out: Counter = Counter()
    while capacity:
        if x := int(take[capacity]):
            out[x] += 1
        capacity -= x or 1
    return out


def fractional(counts: np.ndarray, size: int, step: float = STEP, batch: int = BATCH) -> tuple[Counter, float]:
    """Multiplicative weights on the covering program: (configuration (item tuple) -> times used, least share covered).

    Prices are divided by the demand, so a unit of price is a share of a length's whole demand. Every round covers the
    least covered lengths further, so the rounds are bounded by lengths / (step * batch) and some.
    """
    used: Counter = Counter()
    there = np.flatnonzero(counts)
    need, covered = np.maximum(counts, 1).astype(float), np.zeros(size + 1)
    area = np.where(counts > 0, np.arange(size + 1) / size, 0.0)  # a length's price at equal weights: its part of a sequence
    while (low := (covered[there] / need[there]).min()) < 1:
        share = covered / need
        take = fillings(np.where(share < 1, area * np.exp(-ETA * np.minimum(share - low, 40)), 0.0), size)
        for x in there[np.argsort(share[there], kind="stable")][:batch].tolist():
            if share[x] >= 1:
                break
            c = configuration(take, size - x) + Counter({x: 1})
            k = step * min(need[y] / n for y, n in c.items())
            used[tuple(sorted(c.items(), reverse=True))] += k
            for y, n in c.items():
                covered[y] += n * k
    return used, float(low)


def fill(left: np.ndarray, size: int, base: Counter | None = None) -> Counter:
    """``base`` (or the longest piece left) with the bounded subset of the rest that fills the sequence best."""
    items = np.flatnonzero(left)
    out = Counter(base) if base else Counter({int(items[-1]): 1})
    room = size - sum(a * b for a, b in out.items())
    greedy, gap = Counter(), room
    for x in items[::-1].tolist():
        k = min(gap // x, int(left[x]) - out[x])
        if k > 0:
            greedy[x], gap = k, gap - x * k
    if not gap:
        return out + greedy
    reach, how = 1, {}
    mask = (1 << (room + 1)) - 1
    for x in items[::-1].tolist():
        k, step = min(room // x, int(left[x]) - out[x]), 1
        while k > 0 and not reach >> room & 1:
            n = min(step, k)
            new = (reach << (x * n)) & mask & ~reach
            if new:
                how.setdefault(len(how), (x, n, new))
                reach |= new
            k, step = k - n, step * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for x, n, new in reversed(list(how.values())):
        if at and new >> at & 1:
            out[x] += n
            at -= x * n
    return out


def rounded(counts: np.ndarray, used: Counter, size: int) -> tuple[list[tuple[Counter, int]], int]:
    """(configurations with their numbers of sequences, how many of these sequences come from the program)."""
    left, out = counts.copy(), []

    def use(c: Counter, most: int) -> int:
        k = min(most, *(int(left[a]) // b for a, b in c.items()))
        out.append((c, k))
        for a, b in c.items():
            left[a] -= b * k
        return k

    total = 0.0
    for items, times in sorted(used.items(), key=lambda x: (-x[0][0][0], -x[1], x[0])):
        want, total = int(total + times + 1e-9) - int(total + 1e-9), total + times
        while want > 0:
            part = Counter({a: n for a, b in items if (n := min(b, int(left[a])))})
            if not part:
                break
            full = sum(part.values()) == sum(b for _, b in items) and sum(a * b for a, b in items) == size
            want -= use(part if full else fill(left, size, part), want if full else 1)
    program = sum(k for _, k in out)
    while left.any():
        use(fill(left, size), int(left.max()))
    return out, program


def plan(counts: np.ndarray, size: int = SIZE, step: float = STEP) -> tuple[list[tuple[Counter, int]], int]:
    """counts[l] pieces of each length to (configurations with their numbers of sequences, sequences in all)."""
    rest = counts.astype(np.int64).copy()
    out = [(Counter({size: 1}), int(rest[size]))] if rest[size] else []
    rest[size] = 0
    if rest.any():
        out += rounded(rest, fractional(rest, size, step)[0], size)[0]
    return out, sum(k for _, k in out)


def runs(configurations: list[tuple[Counter, int]], size: int = SIZE) -> dict[str, np.ndarray]:
    """The plan as rank ranges, sorted by (length, first rank)."""
    rank, base, rows = Counter(), 0, []
    for c, k in configurations:
        offset = 0
        for x, n in sorted(c.items(), reverse=True):
            rows.append((x, rank[x], n, base, offset))
            rank[x] += n * k
            offset += x * n
        base += k
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": cols[:, 0] << 44 | cols[:, 1], "first": cols[:, 1], "each": cols[:, 2], "base": cols[:, 3], "offset": cols[:, 4]}


# --- pieces and places ---------------------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (binary, little-endian unsigned 32-bit) of every piece of every document."""
    held = read_tokenizer(path)
    state = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, held, byte_ranks(held)))
    tail = np.array([end], "<u4").tobytes()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        coder = worker_state(state, ByteIds)
        doc, piece, start, length, ids = [], [], [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = coder.ids(t.as_py() or "") + tail
            n = len(data) // 4
            at, k = 0, 0
            while at < n:
                m = (n % size or size) if at == 0 else size
                doc.append(d), piece.append(k), start.append(at), length.append(m), ids.append(data[4 * at : 4 * (at + m)])
                at, k = at + m, k + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
            ["doc_id", "piece", "start", "length", "ids"],
        )

    return arrow_map(docs.select("doc_id", text), run, "doc_id long, piece int, start long, length long, ids binary", 128, stateful=True)


def pack(pieces: DataFrame, size: int = SIZE, step: float = STEP) -> DataFrame:
    """``pieces`` (any table with ``length`` from 1 to ``size``) with sequence_id and offset."""
    pieces = pieces.drop("sequence_id", "offset")
    fields = list(pieces.columns)
    task_name, rank_name = "quern_task", "quern_rank"
    while {task_name, rank_name} & set(fields):
        task_name, rank_name = task_name + "_", rank_name + "_"
    at = fields.index("length")

    def rank(batches):
        seen, task = np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            x = b.column(at).to_numpy(zero_copy_only=False)
            if len(x) and (x.min() < 1 or x.max() > size):
                raise ValueError("a piece is empty or longer than a sequence")
            order = np.argsort(x, kind="stable")
            s = x[order]
            new = np.append(True, s[1:] != s[:-1])[: len(s)]
            where = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0)) if len(s) else s
            local = np.empty(len(s), np.int64)
            local[order] = where
            local += seen[x]
            np.add.at(seen, x, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), task)), pa.array(local)], [*fields, task_name, rank_name])

    schema = T.StructType([*pieces.schema.fields, T.StructField(task_name, T.LongType()), T.StructField(rank_name, T.LongType())])
    ranked = scratch(pieces.mapInArrow(rank, schema), "pieces")
    by_task = ranked.groupBy("length", task_name).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy(task_name).rowsBetween(Window.unboundedPreceding, -1))
    by_task = scratch(by_task.withColumn("before", F.coalesce(before, F.lit(0))), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    places = runs(plan(counts, size, step)[0], size)
    held = pieces.sparkSession.sparkContext.broadcast(places)
    before = by_task.select(F.col("length").alias("own_length"), F.col(task_name).alias("own_task"), F.col("before").alias("own_before"))
    joined = ranked.alias("p").join(before.alias("b"), F.expr(f"p.length = b.own_length AND p.{task_name} = b.own_task"))
    joined = joined.select(*[F.col(f"p.`{c}`") for c in fields], (F.col("b.own_before") + F.col(f"p.{rank_name}")).alias(rank_name))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        p = held.value
        x, r = b.column(at).to_numpy(zero_copy_only=False), b.column(len(fields)).to_numpy(zero_copy_only=False)
        i = np.searchsorted(p["key"], x << 44 | r, side="right") - 1
        d = r - p["first"][i]
        return pa.RecordBatch.from_arrays(
            [*b.columns[:-1], pa.array(p["base"][i] + d // p["each"][i]), pa.array(p["offset"][i] + d % p["each"][i] * x)], [*fields, "sequence_id", "offset"]
        )

    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return arrow_map(joined, place, out, 1 << 16)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Documents to packed pieces with their token ids (binary)."""
    return pack(token_pieces(docs, path, size, end), size)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_digest(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def packed_digest(docs: DataFrame, path: str) -> DataFrame:
    """``pack_documents`` with a checksum of the ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids."""
    return pack_documents(docs, path).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")
