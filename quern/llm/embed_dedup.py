"""Embedding near-duplicates: int8 tile products with per-vector error bounds, verified in double precision.

Equal vectors are first merged into one class with its row count, so a vector that many rows share costs one row. Every
distinct unit vector x is quantised once to s*q with q in -127..127, and e = |x - s*q| is measured exactly. For unit vectors
|x.y - (s*q).(t*r)| <= e_x + |s*q|*e_y: a pair whose quantised product plus that bound stays under the threshold is no
link, one whose product minus the bound reaches it is one, and only pairs between are open.

The classes are dealt into groups of at most about ``TILE`` rows, each pair of groups is one tile, and a task computes one
tile at a time. First pass: tiles get the int8 rows with their scale and bound (about 110 bytes for 64 dimensions), count
the sure links and name the rows with open pairs. Second pass: only those rows go to their tiles again, now with the original
vectors, and the open pairs alone are computed in double precision. Products of int8 values are summed in float32, which is exact
for up to 1,040 dimensions (127*127*1040 < 2**24); longer vectors are multiplied in slices and added up in double precision.

A tile returns one row per vector that has a link there: the number of rows it links to, and the smallest vector of its
component inside the tile. So links are counted, never listed, and the output of a tile is at most its own rows.

Cost: with n distinct vectors the products number n*n/2, the method's own growth (each is 64 one-byte operations for
64-dimensional vectors); the first pass shuffles n rows of 110 bytes for each group, at 1e8 vectors 3,052 times, about 34 TB.
Tiles are independent tasks, so more machines shorten it.

Defined results: null and zero vectors and those with null or non-finite components link with nothing (n_links 0,
component_id = vec_id, kept true). Finite vectors of any scale are compared: each is first multiplied by a power of two that
brings its largest component near one. Vectors of different lengths do not link. A null vec_id keeps its row and counts as
a link of others, but never names a component; its kept is false. Repeated rows (even of one vec_id) count as separate
vectors. An empty table gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, components, drop_scratch, scratch

THRESHOLD, TILE, BLOCK, SLICE = 0.95, 32_768, 1024, 1024
#: At least so many groups, that is 78 tiles, so that small inputs are shared out too.
GROUPS = 12


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component lies between a half and one: no bit is changed by it."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    y = scaled(x)
    return y / np.sqrt((y * y).sum(axis=1))[:, None]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows x to (q int8, scale, |s*q|, e) with e >= |x - s*q| row by row."""
    s = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / s[:, None]).astype(np.int8)
    back = q * s[:, None]
    slack = 1e-12
    return q, s, np.sqrt((back * back).sum(axis=1)) + slack, np.sqrt(((x - back) ** 2).sum(axis=1)) + slack


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products a @ b.T of int8 values (in any type)."""
    if a.shape[1] <= SLICE:
        return a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], SLICE):
        out += a[:, i : i + SLICE].astype(np.float32) @ b[:, i : i + SLICE].astype(np.float32).T
    return out


def smallest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Label propagation with pointer jumping over pairs (a, b) of positions; root: positions so far."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new


def tile_links(cls: np.ndarray, n_rows: np.ndarray, side: np.ndarray, q: np.ndarray, s: np.ndarray, size: np.ndarray, err: np.ndarray, threshold: float, x: np.ndarray | None = None) -> pd.DataFrame:
    """One tile: classes with side 0 against those with side 1, or those with side 2 among themselves.

    Returns cls, linked (rows of other classes linked in this tile), root (smallest class joined to it here) and open, for
    classes with a link or an open pair. Without ``x`` the sure pairs count; with the original vectors the open ones do.
    """
    order = np.argsort(cls, kind="stable")
    cls, n_rows, side, s, size, err = (v[order] for v in (cls, n_rows, side, s, size, err))
    q = q[order].astype(np.float32)
    if x is not None:
        x = scaled(x[order].astype(np.float64))
        norm = np.sqrt((x * x).sum(axis=1))
    own = bool(len(side)) and side[0] == 2
    left = np.flatnonzero(side == (2 if own else 0))
    right = left if own else np.flatnonzero(side == 1)
    linked, root, doubt = np.zeros(len(cls), np.int64), np.arange(len(cls)), np.zeros(len(cls), bool)
    for i in range(0, len(left), BLOCK):
        a = left[i : i + BLOCK]
        for j in range(i if own else 0, len(right), BLOCK):
            b = right[j : j + BLOCK]
            about = product(q[a], q[b]) * s[a][:, None] * s[b][None, :]
            bound = err[a][:, None] + size[a][:, None] * err[b][None, :] + 1e-6
            maybe, sure = about + bound >= threshold, about - bound >= threshold
            if own and i == j:
                maybe &= np.triu(np.ones(maybe.shape, bool), 1)
            u, v = np.nonzero(maybe & ~sure)
            if x is None:
                doubt[a[u]] = doubt[b[v]] = True
                u, v = np.nonzero(maybe & sure)
            for k in range(0, len(u), 1 << 16):
                p, r = a[u[k : k + (1 << 16)]], b[v[k : k + (1 << 16)]]
                if x is not None:
                    true = np.einsum("ij,ij->i", x[p], x[r]) / (norm[p] * norm[r]) >= threshold
                    p, r = p[true], r[true]
                if len(p):
                    np.add.at(linked, p, n_rows[r])
                    np.add.at(linked, r, n_rows[p])
                    root = smallest(len(cls), p, r, root)
    at = np.flatnonzero((linked > 0) | doubt)
    return pd.DataFrame({"cls": cls[at], "linked": linked[at], "root": cls[root[at]], "open": doubt[at]})


def rows_of(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """A list column (of one length) as a matrix; the length of every list is checked by the caller's grouping."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = x.chunks if isinstance(x, pa.ChunkedArray) else [x]
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in parts]) if parts else np.zeros(0)
    return flat.reshape(n, -1)


def quantised(classes: DataFrame) -> DataFrame:
    """``classes`` (cls, n_rows, dim, key) to cls, n_rows, dim, q (int8 values as bytes), s, size, err."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        dims = b.column(2).to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            q, s, size, err = quantise(units(rows_of(b.column(3).take(pa.array(at)), len(at)).astype(np.float64)))
            parts.append((b.column(0).to_numpy()[at], b.column(1).to_numpy()[at], dims[at], [r.tobytes() for r in q], s, size, err))
        cols = [np.concatenate([p[k] for p in parts]) if k != 3 else [r for p in parts for r in p[3]] for k in range(7)] if parts else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.float64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["cls", "n_rows", "dim", "q", "s", "size", "err"])

    return arrow_map(classes.select("cls", "n_rows", "dim", "key"), run, "cls long, n_rows long, dim int, q binary, s double, size double, err double", 8192)


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vectors`` (vec_id, embedding) to vec_id, n_links, component_id, kept; one row per input row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    bad = F.col("embedding").isNull() | (F.size("embedding") == 0) | F.exists(
        "embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    )
    fine = ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("embedding", lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    zero = F.lit(0.0).cast(vectors.schema["embedding"].dataType.elementType)
    rows = rows.withColumn("key", F.when(fine, F.transform("embedding", lambda c: c + zero)))  # -0.0 becomes 0.0
    classes = (
        rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n_rows"), F.min("vec_id").alias("first"))
        .withColumn("dim", F.size("key"))
    )
    # A class is named by a dense number in no particular order; its table is written, so the numbers hold.
    classes = scratch(classes.withColumn("cls", F.monotonically_increasing_id()), "cls")
    int8 = scratch(quantised(classes), "int8")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # one row per vector length
    groups = {d: max(GROUPS, math.ceil(n / tile)) for d, n in sizes.items()}
    count = F.element_at(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]), F.col("dim")) if groups else F.lit(1)
    fields = ["cls", "n_rows", "q", "s", "size", "err"]
    dealt = int8.withColumn("groups", count).withColumn("g", F.pmod(F.xxhash64("cls"), F.col("groups")).cast("int"))
    dealt = dealt.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    side = F.when(F.col("g") == F.col("h"), 2).when(F.col("g") > F.col("h"), 1).otherwise(0)
    dealt = dealt.select("dim", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), side.alias("side"), *fields)
    at, tiles = ["dim", "i", "j"], max(1, min(sum(n * (n + 1) // 2 for n in groups.values()), 20_000))
    result = "dim int, i int, j int, cls long, linked long, root long, open boolean"

    def run(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(table.num_rows, -1)
        x = rows_of(table.column("key"), table.num_rows) if "key" in table.column_names else None
        out = tile_links(col("cls"), col("n_rows"), col("side"), q, col("s"), col("size"), col("err"), threshold, x)
        place = {c: np.full(len(out), col(c)[0], np.int32) for c in at}
        return pa.Table.from_pandas(out.assign(**place)[[*at, "cls", "linked", "root", "open"]], preserve_index=False)

    sure = scratch(dealt.repartition(tiles, *at).groupBy(*at).applyInArrow(run, result), "tiles")
    again = dealt.join(sure.where("open").select(*at, "cls"), [*at, "cls"], "left_semi").join(classes.select("cls", "key"), "cls")
    rest = scratch(again.repartition(tiles, *at).groupBy(*at).applyInArrow(run, result), "tiles")
    found = sure.union(rest).where("linked > 0").select("cls", "linked", "root")
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("cls", "key", "n_rows", "first")
        .join(found.groupBy("cls").agg(F.sum("linked").alias("linked")), "cls", "left")
        .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    named = scratch(named, "cls")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("key", (F.coalesce("linked", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), "component_id")
    linked = rows.where("key is not null").join(named, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    drop_scratch(classes, int8, sure, rest)
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(a.n) * sqrt(b.n)) >= 0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.root),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON node = vec_id"""
