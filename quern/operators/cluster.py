"""Vectors, clustering and text features."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import vectors as V
from quern.operators.graph import cut


def community_count(n: int) -> int:
    """V2: round(sqrt(n)) for fewer than 8 points (at least 1), else round(sqrt(n/8)) between 4 and 12."""
    half_up = lambda x: math.floor(x + 0.5)
    return max(1, half_up(math.sqrt(n))) if n < 8 else min(12, max(4, half_up(math.sqrt(n / 8))))


def _similarities(centroids: Sequence[Sequence[float]]) -> Column:
    """Dot products with all centroids: at most a dozen vectors as one folded literal."""
    held = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    return F.transform(held, lambda c: V.dot("v", c))


def _nearest(centroids: Sequence[Sequence[float]]) -> Column:
    """The first centroid with the highest dot product."""
    sims = _similarities(centroids)
    return (F.array_position(sims, F.array_max(sims)) - 1).cast("int").alias("label")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _farthest(points: DataFrame, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """Per batch the point whose best similarity to the centroids is lowest (ties: the smaller id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids).T
        for b in batches:
            if b.num_rows:
                best, ids = (_matrix(b) @ c).max(axis=1), b.column(0).to_pylist()
                i = min(np.flatnonzero(best == best.min()).tolist(), key=lambda j: ids[j])
                yield pa.RecordBatch.from_pydict({"id": [ids[i]], "best": [float(best[i])], "v": [_matrix(b)[i].tolist()]})

    return points.select("id", "v").mapInArrow(run, "id string, best double, v array<double>")


def _sums(points: DataFrame, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """Per task the sums of the vectors nearest to each centroid, by dimension: at most 12 times the dimensions rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids)
        total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                label = (x @ c.T).argmax(axis=1)
                np.add.at(total, label, x)
                n += np.bincount(label, minlength=len(c))
        rows, cols = np.nonzero(np.repeat(n[:, None] > 0, c.shape[1], axis=1))
        yield pa.RecordBatch.from_pydict({"label": rows.astype(np.int32), "d": cols.astype(np.int32), "s": total[rows, cols], "n": n[rows]})

    return points.select("id", "v").mapInArrow(run, "label int, d int, s double, n long")


def spherical_kmeans(points: DataFrame, rounds: int = 12, count: int | None = None) -> DataFrame:
    """V3: deterministic communities over (id, embedding): id, community. Points of other lengths than the first id's are left out.

    Start: the smallest id's vector, then again and again the point whose best similarity to the chosen ones is lowest
    (ties: the smaller id). Each round is one aggregation by (label, dimension); centroids (at most 12 short vectors) are the
    only thing on the driver. Labels are numbered by their smallest member.
    """
    p = points.select(F.col("id").cast("string").alias("id"), V.unit("embedding").alias("v")).where("v is not null")
    first = p.orderBy("id").limit(1).collect()
    if not first:
        return points.select("id", F.lit(0).alias("community")).limit(0)
    dim = len(first[0]["v"])
    p = cut(p.where(F.size("v") == dim))
    k = count or community_count(p.count())
    centroids = [list(first[0]["v"])]
    while len(centroids) < k:
        centroids.append(list(_farthest(p, centroids).orderBy("best", "id").limit(1).collect()[0]["v"]))
    for _ in range(rounds):
        sums = _sums(p, centroids).groupBy("label", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        mean = {}
        for r in sums:
            mean.setdefault(r["label"], [0.0] * dim)[r["d"]] = r["s"] / r["n"]
        new = [list(c) for c in centroids]
        for label, m in mean.items():
            size = math.sqrt(sum(x * x for x in m)) or 1.0
            new[label] = [x / size for x in m]
        done = new == centroids
        centroids = new
        if done:
            break
    out = p.select("id", _nearest(centroids))
    low = out.groupBy("label").agg(F.min("id").alias("low"))
    low = low.withColumn("community", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("low")) - 1)
    return out.join(F.broadcast(low.select("label", "community")), "label").select("id", "community")


def cluster_count(n: int) -> int | None:
    """V4: clamp(n // 15, 2, 12); None (no clustering) for fewer than 10 points."""
    return None if n < 10 else max(2, min(12, n // 15))


def kmeans(points: DataFrame, seed: int = 42, rounds: int = 300, starts: int = 10) -> DataFrame:
    """V4: k-means++ by the ML library from several starts, the one of least inertia kept: id, label.

    Its random numbers are its own, so labels differ from other programs'.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k = cluster_count(points.count())
    if k is None:
        return points.select("id", F.lit(0).alias("label"))
    df = points.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    df = cut(df)
    fits = (KMeans(k=k, seed=seed + i, maxIter=rounds).fit(df) for i in range(starts))
    model = min(fits, key=lambda m: m.summary.trainingCost)
    return model.transform(df).select("id", F.col("prediction").alias("label"))


def pca_layout(points: DataFrame) -> DataFrame:
    """V5: the first two principal components of the centred vectors: id, x, y (signs are arbitrary)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = points.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    df = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(df).transform(df)
    out = PCA(k=2, inputCol="centred", outputCol="pc").fit(df).transform(df)
    a = vector_to_array("pc")
    return out.select("id", a[0].alias("x"), a[1].alias("y"))


def write_layout(nodes: DataFrame, labels: DataFrame, layout: DataFrame) -> DataFrame:
    """V6: nodes with label and place written into their properties (a map)."""
    j = nodes.join(labels, "id").join(layout, "id")
    return j.withColumn("properties", F.map_concat(F.col("properties"), F.create_map(F.lit("cluster"), F.col("label").cast("string"), F.lit("x"), F.round("x", 4).cast("string"), F.lit("y"), F.round("y", 4).cast("string"))))


def embedding_text(*parts: str | Column) -> Column:
    """V7: filled parts on lines of their own."""
    return F.array_join(F.filter(F.array(*[F.trim(X.col(p)) for p in parts]), lambda x: x.isNotNull() & (x != "")), "\n")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """V7: batch numbers of at most ``size`` rows inside each partition; no total order is needed to send batches."""
    n = F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy(key))
    return df.withColumn("part", F.spark_partition_id()).withColumn("n", n).select(*df.columns, "part", F.floor((F.col("n") - 1) / size).alias("batch"))


def unit_text(name: Column, definition: Column, sections: Column, body: Column, excerpts: Column, body_chars: int = 5000, n_sections: int = 8, section_chars: int = 1200, n_excerpts: int = 12, excerpt_chars: int = 900) -> Column:
    """V8: a unit as text for embedding: capped parts, white space collapsed. sections and excerpts are arrays of texts."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    cut = lambda c, n: F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)
    some = lambda a, n, m: F.array_join(F.filter(F.transform(F.slice(a, 1, n), lambda x: cut(flat(x), m)), lambda x: x != ""), "\n")
    none = F.array().cast("array<string>")
    return embedding_text(flat(name), flat(definition), some(F.coalesce(sections, none), n_sections, section_chars), cut(flat(body), body_chars), some(F.coalesce(excerpts, none), n_excerpts, excerpt_chars))


def stale(units: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """V9: units whose text hash or model differs from what is stored (or that are not stored): id, hash."""
    u = units.select("id", F.sha2("text", 256).alias("hash"))
    j = u.join(stored.select("id", F.col("hash").alias("old_hash"), F.col("model").alias("old_model")), "id", "left")
    return j.where(~(F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("old_model").eqNullSafe(F.lit(model)))).select("id", "hash")


def phyllotaxis(members: DataFrame, gap: float = 24.0) -> DataFrame:
    """Places of the members of each community on a sunflower spiral: id, x, y by their rank."""
    n = F.row_number().over(Window.partitionBy("community").orderBy("id")) - 1
    angle = F.col("n") * (math.pi * (3 - math.sqrt(5)))
    r = F.lit(gap) * F.sqrt("n")
    return members.withColumn("n", n).select("id", "community", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


def radial(neighbours: DataFrame, n: int, radius: float = 220.0) -> DataFrame:
    """Neighbours (id, rank from 0) evenly on a circle."""
    angle = F.col("rank") * (2 * math.pi / max(1, n)) - math.pi / 2
    return neighbours.select("id", (F.lit(radius) * F.cos(angle)).alias("x"), (F.lit(radius) * F.sin(angle)).alias("y"))
