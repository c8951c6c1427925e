"""Near-duplicates by similarity of word shingles: SimHash candidates first, then the rest exactly.

A text's set: A-Z lower-cased, words are runs of bytes other than ASCII white space, distinct XXH64 hashes of its shingles of
``k`` words (fewer words: the whole sequence; no words: the empty set). Texts are linked if their sets are equal or
their similarity is at least ``NUM / DEN``.

First pass: the SimHash fingerprints of the same shingles are grouped and probed as in ``simhash``; the pairs found are
verified with the whole sets, and their components are formed. 64 bits cannot find every pair: at a similarity of 0.8
fingerprints differ by about ten bits, and no choice of partitions is selective at that distance. So a second pass joins what
the first one left, and passes over every pair inside one of its components:

All shingles have one order: by their count in a bounded sample of texts, then by hash. Sets of n with similarity t
or more share one of their first n - ceil(t n) + 1 shingles, whatever the order is, so only those are joined: the sample
decides the work, never the result. Pairs that pass the bounds of size and position meet as bitmaps of about n bits first (each
bit the parity of the hashes that fall on it): sets differ in at least as many hashes as their bitmaps do in bits, so pairs
with too many are passed over without loss. The others are verified with the whole sets.

Crowds: where more than ``HOT`` sets share a shingle, each is first compared with one of them, the centre. A centre is as good as
drawn for each shingle (the key nearest to the shingle by exclusive or), so a set that is in many crowds meets many different
ones, and large groups of near copies become few components. After the components of all links so far, shingles whose sets all
lie in one component are done; of the others only pairs of different components are compared, by short bitmaps before they become rows. No pair that could join two
components is left out.

Defined results: as in ``simhash``: null and empty texts are equal, a null doc_id takes part in links, but never names a
component, repeated rows give repeated results, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, components, drop_scratch, scratch
from quern.llm.simhash import bit_votes, keep_one
from quern.llm.simhash import links as simhash_links

K, NUM, DEN, HOT = 5, 4, 5, 8
#: Texts whose shingles are counted for the order; counts kept. Both only decide the work.
SAMPLE, COUNTS = 20_000, 500_000


def hashes(text: bytes | None, k: int = K) -> np.ndarray:
    """The hashes of all shingles of a text, repeats kept."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[j:] for j in range(k)), strict=False) if len(words) >= k else [words]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(g), 42) for g in grams), np.uint64)


def shingles(text: bytes | None, k: int = K) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(hashes(text, k))


def set_key(own: np.ndarray) -> int:
    """One signed long for a set; zero for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64)) if len(own) else 0


def parity_bits(own: np.ndarray) -> np.ndarray:
    """A bitmap as longs, a power of two of them with at least a bit per hash: the parity of the hashes on each bit."""
    words = 1 << max(0, -(-len(own) // 64) - 1).bit_length()
    odd = np.bincount((own % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint64).view(np.int64)))


def sample_counts(docs: DataFrame, k: int, sample: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of those that are frequent in about ``sample`` texts."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x.as_py(), k) for x in b.column(0).cast(pa.large_binary())]
        return pa.RecordBatch.from_arrays([lists_of(sets).flatten()], ["h"])

    part = docs.select(text).where(F.rand(7) < min(1.0, sample / max(docs.count(), 1)))
    top = arrow_map(part, run, "h long", 256).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COUNTS).toArrow()
    h, c = top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("count").to_numpy()
    at = np.argsort(h)
    return h[at], c[at]


def prefixes(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """``docs`` to doc_id, fp (the key of the set), sim (its SimHash), n (its size), bits, prefix (first shingles in the common order)."""
    held = docs.sparkSession.sparkContext.broadcast(sample_counts(docs, k, sample, text))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        common, counts = held.value
        keys, sims, sizes, bits, first = [], [], [], [], []
        for x in b.column(1).cast(pa.large_binary()):
            every = hashes(x.as_py(), k)
            own = np.unique(every)
            n = len(own)
            seen = np.zeros(n, np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                seen = np.where(common[at] == own, counts[at], 0)
            keys.append(set_key(own))
            sims.append(int(np.packbits(bit_votes(every) * 2 > len(every), bitorder="little").view(np.int64)[0]))
            sizes.append(n)
            bits.append(parity_bits(own))
            first.append(own[np.lexsort((own, seen))[: n - -(-num * n // den) + 1]])
        return pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(sims, pa.int64()), pa.array(sizes, pa.int32()), lists_of(bits), lists_of(first)],
            ["doc_id", "fp", "sim", "n", "bits", "prefix"],
        )

    return arrow_map(docs.select("doc_id", text), run, "doc_id long, fp long, sim long, n int, bits array<long>, prefix array<long>", 256)


def near_bits(num: int, den: int) -> str:
    """The test of n_a, bits_a and n_b, bits_b that every similar pair passes; a bitmap twice as long is folded to the other's length."""
    half = "cast(size({0}) / 2 as int)"
    fold = "if(size({0}) > size({1}), zip_with(slice({0}, 1, " + half + "), slice({0}, " + half + " + 1, " + half + "), (x, y) -> x ^ y), {0})"
    a, b = fold.format("bits_a", "bits_b"), fold.format("bits_b", "bits_a")
    return f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) * {num + den} <= (n_a + n_b) * {den - num}"


#: A bitmap folded to at most eight longs, so that a long text's many crowd rows stay small; ``near_bits`` holds for it too.
SHORT_BITS = "if(size(bits) <= 8, bits, transform(sequence(0, 7), i -> aggregate(sequence(i, size(bits) - 1, 8), 0L, (s, j) -> s ^ bits[j])))"


def possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of keys that sizes and bitmaps leave possible."""
    left, right = (sets.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    j = pairs.join(left, "a").join(right, "b").where(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}")
    return j.where(near_bits(num, den)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, firsts: DataFrame, k: int, num: int, den: int, text: str) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets are similar; the texts of their sets are read once more."""
    pairs = scratch(possible(pairs, sets, num, den), "near")
    keys = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    keys = scratch(firsts.join(keys, "fp").select("fp", "first"), "near")
    own = docs.select("doc_id", text).join(keys.select(F.col("first").alias("own_id")).distinct(), F.expr("doc_id <=> own_id"), "left_semi")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x.as_py(), k) for x in b.column(0).cast(pa.large_binary())]
        return pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), lists_of(sets)], ["fp", "own"])

    whole = arrow_map(own.select(text), run, "fp long, own array<long>", 256).join(keys.select("fp"), "fp", "left_semi")
    whole = scratch(whole.dropDuplicates(["fp"]), "near")
    left, right = (whole.select(F.col("fp").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.expr("cast(size(array_intersect(own_a, own_b)) as long)"))
    out = scratch(both.where(f"{den} * both >= {num} * (size(own_a) + size(own_b) - both)").select("a", "b"), "near")
    drop_scratch(pairs, keys, whole)
    return out


def sim_pairs(sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of keys with near fingerprints: those of one fingerprint with its smallest, and the smallest ones."""
    one = scratch(sets.groupBy("sim").agg(F.min("fp").alias("least")), "near")
    same = sets.join(one, "sim").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    near = simhash_links(one.select(F.col("sim").alias("fp")))
    near = near.join(one.toDF("a", "fp_a"), "a").join(one.toDF("b", "fp_b"), "b").select("fp_a", "fp_b")
    return same.union(near)


def links(docs: DataFrame, held: DataFrame, k: int = K, num: int = NUM, den: int = DEN, hot: int = HOT, text: str = "text") -> DataFrame:
    """Pairs (a, b) of keys whose components are those of all pairs of similar sets. ``held``: the table of ``prefixes``.

    Written tables, ``held`` too, are removed as soon as nothing reads them any more.
    """
    firsts = scratch(held.groupBy("fp").agg(F.min("doc_id").alias("first")), "near")
    sets = scratch(held.select("fp", "sim", "n", "bits", "prefix").dropDuplicates(["fp"]), "near")
    drop_scratch(held)

    def similar(pairs: DataFrame) -> DataFrame:
        return verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), docs, sets, firsts, k, num, den, text)

    by_sim = similar(sim_pairs(sets))
    joined = scratch(components(by_sim).withColumnRenamed("node", "fp"), "near")
    posts = sets.select("fp", "n", F.posexplode("prefix").alias("pos", "h"))
    centre = F.min(F.col("fp").bitwiseXOR(F.col("h"))).bitwiseXOR(F.col("h")).alias("centre")
    shared = posts.groupBy("h").agg(F.count("*").alias("c"), centre).where("c > 1")
    shared = scratch(shared.join(joined.toDF("centre", "centre_root"), "centre", "left"), "near")
    rows = scratch(posts.join(shared, "h"), "near")
    drop_scratch(shared)
    alike = f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}"
    rest = f"(1 + least(n_a - pos_a - 1, n_b - pos_b - 1)) * {num + den} >= {num} * (n_a + n_b)"

    def pairs(of: DataFrame, also: str) -> DataFrame:
        left, right = (of.select("h", *[F.col(c).alias(f"{c}_{s}") for c in of.columns if c != "h"]) for s in "ab")
        return left.join(right, "h").where(f"fp_a < fp_b and coalesce(root_a, fp_a) <> coalesce(root_b, fp_b) and {alike} and {rest} and {also}").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()

    rooted = rows.join(joined, "fp", "left")  # a root is null for a set that SimHash links with none
    cold = pairs(rooted.where(f"c <= {hot}"), "true")
    star = rooted.where(f"c > {hot} and coalesce(root, fp) <> coalesce(centre_root, centre)").select(F.col("centre").alias("a"), F.col("fp").alias("b"))
    found = by_sim.union(similar(cold.union(star)))
    crowd = scratch(rows.where(f"c > {hot}").join(components(found).withColumnRenamed("node", "fp"), "fp", "left").select("h", "fp", "n", "pos", F.coalesce("root", "fp").alias("root")), "near")
    drop_scratch(rows, joined)
    mixed = crowd.groupBy("h").agg((F.min("root") < F.max("root")).alias("open")).where("open").select("h")
    open_crowd = scratch(crowd.join(mixed, "h", "left_semi"), "near")
    drop_scratch(crowd)
    if not open_crowd.isEmpty():
        short = open_crowd.join(sets.select("fp", F.expr(SHORT_BITS).alias("bits")), "fp")
        found = found.union(similar(pairs(short, near_bits(num, den))))
    drop_scratch(open_crowd, sets, firsts)
    return found


def near_groups(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) and root (smallest fp so) for every row of ``docs``."""
    held = scratch(prefixes(docs, k, num, den, sample), "prefixes")
    ids = scratch(held.select("doc_id", "fp"), "prefixes")
    root = components(links(docs, held, k, num, den, hot)).withColumnRenamed("node", "fp")
    distinct = ids.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = scratch(distinct.join(root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "near")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return ids.join(rooted.join(least, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", "root")


def near_dedup(docs: DataFrame, k: int = K, **options) -> DataFrame:
    """``docs`` without all but one document of each group; as ``simhash.simhash_dedup``."""
    return keep_one(docs, near_groups(docs, k, **options), lambda x: set_key(shingles(x, k)))
