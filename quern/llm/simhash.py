"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words are runs of bytes other than ASCII white space, shingles of ``k`` words (repeats
included; fewer words: the whole sequence), XXH64 with seed 42, bit set where more than half of the hashes have it.

Links: distinct fingerprints that differ in at most ``TAU`` bits. The 64 bits are grouped into m partitions so that
correlated bits share one (correlations over all distinct fingerprints). Each fingerprint x gets thresholds t_1..t_m by
dynamic programming, t_1 + .. + t_m = TAU - m + 1 and t_i >= -1 (-1: skip that partition), which minimise the
estimated number of candidates plus probes. By the generalised pigeonhole principle every y within TAU bits of x differs
from x by at most t_i in some partition i, so probing each partition i with all values within t_i bits finds y. Found
pairs are verified with the whole fingerprints. m is 2, 3 or 4, whichever costs least at the number of fingerprints seen.

Hot buckets: a (partition, value) with more than ``HOT`` fingerprints is not paired. All fingerprints that are stored in
it or probe it go to an exact linear form instead: each emits itself and its 64 one-bit neighbours as keys; fingerprints
with a common key differ in at most two bits, and two within two bits share a key. A key holds 65 fingerprints at most.

Defined results: null or empty text, or text without words, has fingerprint zero and links like any other. A null doc_id
keeps its row; it takes part in links, but never names a component (component_id is null if no member has an id).
Repeated rows give repeated results. An empty table gives an empty result. Only the needed columns are read, so
further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import arrow_map, components, drop_scratch, scratch

TAU, HOT, BITS = 2, 256, 64
#: Hashes whose bits are counted at once; longer texts are summed piece by piece.
PIECE = 1 << 16


def bit_votes(h: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, counted piece by piece."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), PIECE):
        ones += np.unpackbits(h[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """The SimHash of one text as an unsigned 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, PIECE):
        part = words[i : i + PIECE + k - 1]
        grams = zip(*(part[j:] for j in range(k)), strict=False) if len(words) >= k else [part]
        ones += bit_votes(np.fromiter((digest(b" ".join(g), 42) for g in grams), np.uint64))
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3, text: str = "text") -> DataFrame:
    """``docs`` (doc_id and the text) to doc_id, fp (the fingerprint as a signed long)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        col = b.column(1).cast(pa.large_binary())
        fps = np.array([fingerprint(x.as_py(), k) for x in col], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return arrow_map(docs.select("doc_id", text), run, "doc_id long, fp long", 256)


# --- partitions and thresholds -------------------------------------------------------------------------------------


def bit_moments(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(number, 64x64 counts of fingerprints with bits i and j set): summed by Spark, at most 4,096 rows collected."""

    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            for i in range(0, b.num_rows, 1 << 16):
                x = bits_of(b.column(0).slice(i, 1 << 16).to_numpy(zero_copy_only=False)).astype(np.float32)
                total += np.rint(x.T @ x).astype(np.int64)
                n += len(x)
        yield pa.RecordBatch.from_pydict({"ij": np.append(np.arange(BITS * BITS), -1), "c": np.append(total.ravel(), n)})

    rows = distinct.select("fp").mapInArrow(run, "ij long, c long").groupBy("ij").agg(F.sum("c").alias("c")).collect()
    got = {r["ij"]: r["c"] for r in rows}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m lists of bits: a partition starts with the most correlated free pair and takes the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, -1)
    free, out = set(range(BITS)), []
    for width in [BITS // m + (i < BITS % m) for i in range(m)]:
        order = sorted(free)
        c = corr[np.ix_(order, order)]
        part = [order[i] for i in np.unravel_index(np.argmax(c), c.shape)][:width] if len(order) > 1 else order[:1]
        while len(part) < width:
            rest = sorted(free - set(part))
            part.append(rest[int(np.argmax(corr[np.ix_(rest, part)].mean(axis=1)))])
        free -= set(part)
        out.append(sorted(part))
    return out


def choose_m(n: int) -> int:
    """The number of partitions with the lowest cost (rows to probe and store, and expected candidates) for n fingerprints."""
    probes = {2: 2 + 33, 3: 3 + 3, 4: 4 + 3}
    found = {2: 34 * n / 2**32, 3: 3 * n / 2**21, 4: 3 * n / 2**16}
    return min(probes, key=lambda m: (8 * probes[m] + found[m], m))


class Plan:
    """Partitions, histograms of their halves, and the threshold vectors to choose from."""

    def __init__(self, parts: list[list[int]], n: int, tau: int):
        self.parts, self.n, self.tau = parts, n, tau
        self.halves = [[p] if len(p) <= 16 else [p[: len(p) // 2], p[len(p) // 2 :]] for p in parts]
        self.hist: list[list[np.ndarray]] = [[np.zeros(1 << len(h), np.int64) for h in hs] for hs in self.halves]

    @staticmethod
    def pick(bits: np.ndarray, positions: list[int]) -> np.ndarray:
        weight = np.left_shift(np.int64(1), np.arange(len(positions), dtype=np.int64))
        return bits[:, positions].astype(np.int64) @ weight

    def estimates(self, bits: np.ndarray) -> np.ndarray:
        """cost[i, t+1, x]: estimated candidates plus probes of partition i at threshold t for fingerprint x."""
        cost = np.zeros((len(self.parts), self.tau + 2, len(bits)))
        for i, hs in enumerate(self.halves):
            near = []
            for h, hist in zip(hs, self.hist[i], strict=True):
                v = self.pick(bits, h)
                c0 = hist[v].astype(float)
                c1 = sum(hist[v ^ (1 << j)] for j in range(len(h))).astype(float)
                near.append((c0, c1))
            if len(near) == 1:
                at0, at1 = near[0]
            else:
                (a0, a1), (b0, b1) = near
                at0, at1 = a0 * b0 / max(self.n, 1), (a1 * b0 + a0 * b1) / max(self.n, 1)
            w = len(self.parts[i])
            cost[i, 1] = at0 + 8
            cost[i, 2] = at0 + at1 + 8 * (1 + w)
            for t in range(2, self.tau + 1):
                cost[i, t + 1] = cost[i, t] * w / t
        return cost

    def allocate(self, bits: np.ndarray) -> np.ndarray:
        """Thresholds [x, i] by dynamic programming over the partitions; they sum to tau - m + 1."""
        cost, m = self.estimates(bits), len(self.parts)
        room = self.tau + 1  # the sum of t_i + 1
        best = np.full((room + 1, len(bits)), np.inf)
        best[0] = 0
        back = np.zeros((m, room + 1, len(bits)), np.int8)
        for i in range(m):
            nxt = np.full_like(best, np.inf)
            for s in range(room + 1):
                for t in range(min(s, self.tau + 1) + 1):
                    c = best[s - t] + cost[i, t]
                    better = c < nxt[s]
                    nxt[s][better], back[i, s][better] = c[better], t
            best = nxt
        at, out = np.full(len(bits), room), np.zeros((len(bits), m), np.int8)
        for i in reversed(range(m)):
            t = back[i, at, np.arange(len(bits))]
            out[:, i], at = t - 1, at - t
        return out


@lru_cache(maxsize=64)
def ball(width: int, t: int) -> np.ndarray:
    """All masks of ``width`` bits with at most t ones."""
    masks = [0]
    if t >= 1:
        masks += [1 << i for i in range(width)]
    if t >= 2:
        masks += [1 << i | 1 << j for i in range(width) for j in range(i)]
    return np.array(masks, np.int64)


def histograms(distinct: DataFrame, plan: Plan) -> None:
    """Fill the plan's histograms from all distinct fingerprints; at most 8 x 65,536 counts reach the driver."""
    halves = plan.halves

    def run(batches):
        held = [[np.zeros(1 << len(h), np.int64) for h in hs] for hs in halves]
        for b in batches:
            for i in range(0, b.num_rows, 1 << 16):
                bits = bits_of(b.column(0).slice(i, 1 << 16).to_numpy(zero_copy_only=False))
                for k, hs in enumerate(halves):
                    for j, h in enumerate(hs):
                        held[k][j] += np.bincount(Plan.pick(bits, h), minlength=1 << len(h))
        for k, hs in enumerate(halves):
            for j in range(len(hs)):
                v = np.flatnonzero(held[k][j])
                yield pa.RecordBatch.from_pydict({"h": np.full(len(v), 2 * k + j), "v": v, "c": held[k][j][v]})

    got = distinct.select("fp").mapInArrow(run, "h long, v long, c long").groupBy("h", "v").agg(F.sum("c").alias("c")).toArrow()
    h, v, c = (got.column(x).to_numpy() for x in ("h", "v", "c"))
    for k, hs in enumerate(halves):
        for j in range(len(hs)):
            at = h == 2 * k + j
            plan.hist[k][j][v[at]] = c[at]


def probes(distinct: DataFrame, plan: Plan) -> DataFrame:
    """Rows (part, key, fp, stored): one stored row per partition, and the probes by each fingerprint's thresholds."""
    held = distinct.sparkSession.sparkContext.broadcast(plan)  # bounded: 8 histograms of at most 65,536 counts

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = held.value
        fp = b.column(0).to_numpy(zero_copy_only=False)
        bits = bits_of(fp)
        given = p.allocate(bits)
        out = []
        for i, positions in enumerate(p.parts):
            v = Plan.pick(bits, positions)
            out.append((np.full(len(v), i), v, fp, np.ones(len(v), bool)))
            for t in range(p.tau + 1):
                at = np.flatnonzero(given[:, i] == t)
                masks = ball(len(positions), t)
                keys = (v[at][:, None] ^ masks[None, :]).ravel()
                out.append((np.full(len(keys), i), keys, np.repeat(fp[at], len(masks)), np.zeros(len(keys), bool)))
        part, key, own, stored = (np.concatenate([x[k] for x in out]) for k in range(4))
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key), pa.array(own), pa.array(stored)], ["part", "key", "fp", "stored"])

    return arrow_map(distinct.select("fp"), run, "part int, key long, fp long, stored boolean", 8192)


def links(distinct: DataFrame, tau: int = TAU, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of different fingerprints within ``tau`` bits whose components are those of all such pairs."""
    if tau != 2:
        raise ValueError("the exact form for hot buckets is for two bits")
    n, both = bit_moments(distinct)
    plan = Plan(group_bits(n, both, choose_m(n)), n, tau)
    histograms(distinct, plan)
    rows = scratch(probes(distinct, plan), "gph")
    full = rows.where("stored").groupBy("part", "key").count().where(F.col("count") > hot).select("part", "key", F.lit(True).alias("hot"))
    marked = scratch(rows.join(full, ["part", "key"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "gph")
    drop_scratch(rows)
    cold = marked.where("not hot")
    probe = cold.where("not stored").select("part", "key", F.col("fp").alias("a"))
    kept = cold.where("stored").select("part", "key", F.col("fp").alias("b"))
    found = probe.join(kept, ["part", "key"]).where("a <> b").where(f"bit_count(a ^ b) <= {tau}").select("a", "b")
    star = (
        marked.where("hot").select("fp").distinct()
        .select("fp", F.expr("explode(transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i))))").alias("key"))
        .groupBy("key").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("near"))
        .where("size(near) > 1").select("a", F.explode("near").alias("b")).where("a <> b")
    )
    return found.union(star)


def simhash_groups(docs: DataFrame, k: int = 3, tau: int = TAU, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) and root (smallest fp so) for every row of ``docs``."""
    fps = scratch(fingerprints(docs, k), "fps")
    distinct = scratch(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    root = components(links(distinct, tau, hot))
    rooted = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch(rooted, "fps")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, groups: DataFrame, hashed: Callable[[bytes | None], int]) -> DataFrame:
    """``docs`` without all but one document of each group; the kept one is that with the smallest doc_id.

    ``groups``: as ``simhash_groups``; ``hashed`` gives the fp of a text as a signed integer.
    Rows that repeat a doc_id are told apart by their groups: of those that repeat the kept document of a group one stays.
    Documents without an id are never dropped.
    """
    groups = scratch(groups, "groups")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias("gone"))
    ids = scratch(ids.where("doc_id is not null and (n > 1 or gone)"), "groups")
    plain = docs.join(ids.select("doc_id"), "doc_id", "left_anti")
    again = docs.join(ids.where("n > 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    fields = list(docs.columns)
    at = fields.index("text")
    own, group = "quern_fp", "quern_group"
    while {own, group} & set(fields):
        own, group = own + "_", group + "_"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([hashed(x.as_py()) for x in b.column(at).cast(pa.large_binary())], pa.int64())
        return pa.RecordBatch.from_arrays([*b.columns, fps], [*fields, own])

    schema = T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())])
    kept = groups.where("doc_id = component_id").select("doc_id", F.col("fp").alias(own), F.col("root").alias(group)).distinct()
    one = arrow_map(again, run, schema, 256).join(kept, ["doc_id", own])
    return plain.select(*fields).unionByName(one.dropDuplicates([group]).select(*fields))


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but one document of each group of ``simhash_groups``; see ``keep_one``."""
    k = options.get("k", 3)
    return keep_one(docs, simhash_groups(docs, **options), lambda x: int(np.uint64(fingerprint(x, k)).view(np.int64)))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
