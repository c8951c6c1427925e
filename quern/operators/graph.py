"""Graph analytics (G1-G7, J14-J16): isolation, degrees, components, cycles, communities, label choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern import schemas as S
from quern.operators.normalize import active
from quern.shared import drop_scratch, scratch


def ends(edges: DataFrame) -> DataFrame:
    """All endpoints (id), repeats kept; self-loops give two."""
    return edges.select(F.col("from_id").alias("id")).union(edges.select(F.col("to_id").alias("id")))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: active nodes without any active edge; a self-loop connects, and so do edges to unknown nodes."""
    return active(nodes).join(ends(active(edges)).distinct(), "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends per node."""
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder."""
    return scratch(df, "graph")


def components(edges: DataFrame) -> DataFrame:
    """Weakly connected components over (from_id, to_id): id, component (its smallest id), for nodes with an edge to another.

    Alternating large-star and small-star rounds: each halves the distance to the roots; hubs are skewed join keys that
    AQE splits, no neighbour list is ever collected. One small table is written per round and the one before removed. The
    rounds end when nothing changes; every round lowers the sum of the roots or ends.
    """
    e = cut(edges.where("from_id <> to_id").select(F.greatest("from_id", "to_id").alias("u"), F.least("from_id", "to_id").alias("v")).distinct())
    mark = None
    while True:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = cut(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct())
        drop_scratch(e)
        e = nxt
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        mark = now


def weak_components(edges: DataFrame, least: int = 6, sample: int = 3) -> DataFrame:
    """Components of active edges with at least ``least`` nodes, and only if there is more than one; with sample nodes."""
    act = active(edges)
    comp = components(act)
    lone = ends(act).distinct().join(comp, "id", "left_anti").select("id", F.col("id").alias("component"))
    comp = comp.unionByName(lone)
    big = comp.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    first = comp.join(big, "component").withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy("id"))).where(F.col("k") <= sample)
    first = first.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("sample_nodes"))
    n = big.agg(F.count("*").alias("n_large"))
    return big.join(first, "component").crossJoin(F.broadcast(n)).where("n_large > 1").drop("n_large")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: isolated nodes and components (lone nodes count) over edges with both ends among the nodes."""
    ids = nodes.select(F.trim("id").alias("id")).where("id <> ''").distinct()
    e = edges.select(F.trim("from_id").alias("from_id"), F.trim("to_id").alias("to_id"))
    e = e.join(ids, F.col("from_id") == ids["id"], "left_semi").join(ids, F.col("to_id") == ids["id"], "left_semi")
    touched = ends(e).distinct()
    alone = ids.join(touched, "id", "left_anti").agg(F.count("*").alias("isolated"))
    comp = components(e)
    n = comp.agg(F.countDistinct("component").alias("k"), F.count("*").alias("inside"))
    total = ids.agg(F.count("*").alias("total"))
    return alone.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(total)).select("isolated", (F.col("k") + F.col("total") - F.col("inside")).alias("components"))


def on_cycles(edges: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """G2, existence: the nodes on cycles and on paths between cycles; empty if and only if there is no cycle.

    Each round peels nodes without an in-edge or an out-edge, then contracts inner nodes of chains (one edge in, one out, no
    two neighbours at once), so that a long chain takes a number of rounds that grows with the logarithm of its length. The
    rounds end when nothing changes. A contracted node belongs to the result exactly if both its neighbours do.
    """
    e = active(edges) if "status" in edges.columns else edges
    if types is not None:
        e = e.where(F.col("type").isin(*types))
    e = cut(e.select("from_id", "to_id").distinct())
    n, bent, turn = e.count(), [], 0
    while n:
        kept = e
        for _ in range(2):
            kept = kept.join(kept.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").join(kept.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi")
        kept = cut(kept.select("from_id", "to_id"))
        drop_scratch(e)
        into = kept.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n_in"), F.min("from_id").alias("before")).where("n_in = 1")
        out = kept.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n_out"), F.min("to_id").alias("after")).where("n_out = 1")
        rank = F.struct(F.xxhash64("id", F.lit(turn)), "id")
        inner = into.join(out, "id").where("before <> id AND after <> id").select("id", "before", "after", rank.alias("rank"))
        ranks = inner.select("id", "rank")
        near = inner.join(ranks.toDF("before", "rank_before"), "before", "left").join(ranks.toDF("after", "rank_after"), "after", "left")
        lone = (F.col("rank_before").isNull() | (F.col("rank") < F.col("rank_before"))) & (F.col("rank_after").isNull() | (F.col("rank") < F.col("rank_after")))
        gone = cut(near.where(lone).select("id", "before", "after"))
        m, k = kept.count(), gone.count()
        if k:
            bent.append(gone)
            ids = gone.select("id")
            rest = kept.join(ids.toDF("from_id"), "from_id", "left_anti").join(ids.toDF("to_id"), "to_id", "left_anti").select("from_id", "to_id")
            e = cut(rest.union(gone.select("before", "after")).distinct())
            drop_scratch(kept)
        else:
            e = kept
        if not k and m == n:
            break
        n, turn = e.count() if k else m, turn + 1
    left = ends(e).distinct()
    for gone in reversed(bent):
        back = gone.join(left.toDF("before"), "before", "left_semi").join(left.toDF("after"), "after", "left_semi").select("id")
        left = cut(left.union(back))
    return left


def back_edge_cycles(edges: list[tuple[str, str]]) -> list[list[str]]:
    """G2, listing: the cycles that a depth-first walk in edge order closes. For small hierarchies on the driver; no recursion."""
    targets: dict[str, list[str]] = {}
    for a, b in edges:
        targets.setdefault(a, []).append(b)
    state, out = {}, []
    for root in list(targets):
        if root in state:
            continue
        path, walk = [root], [iter(targets[root])]
        state[root] = len(path)
        while walk:
            nxt = next(walk[-1], None)
            if nxt is None:
                state[path.pop()] = 0
                walk.pop()
            elif nxt not in state:
                path.append(nxt)
                state[nxt] = len(path)
                walk.append(iter(targets.get(nxt, ())))
            elif state[nxt]:
                out.append([*path[state[nxt] - 1 :], nxt])
    return out


def check_integrity(nodes: DataFrame, edges: DataFrame, limit: int = 1_000_000) -> dict:
    """G1-G3 as one report. Cycle listing runs on the driver, and only on the peeled remainder of at most ``limit`` edges."""
    act = active(edges)

    def cycles(types: Sequence[str]) -> list[list[str]]:
        left = on_cycles(act, types)
        e = act.where(F.col("type").isin(*types)).join(left, F.col("from_id") == left["id"], "left_semi").join(left, F.col("to_id") == left["id"], "left_semi")
        rows = e.select("from_id", "to_id").orderBy("id").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError("too many edges on cycles to list them")
        return back_edge_cycles([(r[0], r[1]) for r in rows])

    hard = cycles(S.HIERARCHICAL_EDGE_TYPES)
    soft = [c for c in cycles([t for t in S.EDGE_TYPES if t not in S.CYCLE_FREE_CHECK_SKIPS]) if c not in hard]
    weak = weak_components(act).count()
    return {"cycles": hard, "directed_cycle_warnings": soft, "isolated_nodes": isolated(nodes, edges).count(), "disconnected_components": weak}


#: Edge types that form topology communities.
COMMUNITY_EDGE_TYPES = ("related_to", "same_as", "about", "causes", "affects", "uses", "produces", "represents", "has_property")


def communities(nodes: DataFrame, edges: DataFrame, types: Sequence[str] = COMMUNITY_EDGE_TYPES) -> DataFrame:
    """Given communities (community_id) if any node has one, else components of two or more nodes; ids are dense by smallest member."""
    if "community_id" in nodes.columns and nodes.where("community_id is not null").take(1):
        return nodes.where("community_id is not null").select("id", "community_id")
    ids = nodes.select("id")
    e = edges.where(F.col("type").isin(*types)).join(ids, F.col("from_id") == ids["id"], "left_semi").join(ids, F.col("to_id") == ids["id"], "left_semi")
    comp = components(e)
    roots = comp.select("component").distinct()
    return comp.join(dense_ids(roots, "component", "community_id"), "component").select("id", "community_id")


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Numbers 0.. in key order without one task for all rows: range partitions, counts per partition, offsets."""
    s = cut(df.orderBy(key).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy(key)
    sizes = s.groupBy("part").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("base"))
    return s.withColumn("n", F.row_number().over(w) - 1).join(before, "part").select(key, (F.col("n") + F.col("base")).alias(name))


def community_info(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per community its size and dominant type (most frequent, ties by type), largest first."""
    j = members.join(nodes.select("id", "type"), "id").groupBy("community_id", "type").agg(F.count("*").alias("n"))
    g = j.groupBy("community_id").agg(F.sum("n").alias("node_count"), F.min(F.struct((-F.col("n")).alias("neg"), "type")).alias("b"))
    return g.select("community_id", "node_count", F.col("b.type").alias("dominant_type")).orderBy(F.desc("node_count"), "community_id")


def label_ids(nodes: DataFrame, members: DataFrame, n_nodes: int) -> DataFrame:
    """Nodes to label: all of up to 36; else the best of each community, then the best overall up to min(42, max(18, round(2.5*sqrt(n)))).

    Best: backbone first, then degree, then id. nodes: id, layer, degree.
    """
    if n_nodes <= 36:
        return nodes.select("id")
    limit = min(42, max(18, int(2.5 * n_nodes**0.5 + 0.5)))
    key = F.struct((F.col("layer") != "backbone").alias("a"), (-F.col("degree")).alias("b"), "id")
    first = nodes.join(members, "id").groupBy("community_id").agg(F.min(key).alias("k")).select(F.col("k.id").alias("id"))
    rest = nodes.select(key.alias("k")).select("k.id", "k").join(first, "id", "left_anti")
    return first.union(rest.orderBy("k").limit(max(0, limit - first.count())).select("id"))


def prepare_graph(nodes: DataFrame, edges: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both known ends, nodes with degree and books; support nodes take on the books of their backbone neighbours."""
    ids = nodes.select("id")
    e = edges.join(ids, F.col("from_id") == ids["id"], "left_semi").join(ids, F.col("to_id") == ids["id"], "left_semi")
    books = mentions.groupBy(F.col("target_id").alias("id")).agg(F.collect_set("source_id").alias("books"))
    n = nodes.join(degrees(e), "id", "left").join(books, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    n = n.withColumn("books", F.coalesce("books", F.array().cast("array<string>")))
    back = n.where("layer = 'backbone'").select("id", F.explode("books").alias("book"))
    both = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(e.select(F.col("to_id"), F.col("from_id"))).distinct()
    more = both.join(back, both["a"] == back["id"]).select(F.col("b").alias("id"), "book").distinct().groupBy("id").agg(F.collect_set("book").alias("near"))
    n = n.join(more, "id", "left")
    scope = F.when((F.col("layer") == "support") & F.col("near").isNotNull(), F.array_union("books", "near")).otherwise(F.col("books"))
    return n.withColumn("books", F.array_sort(scope)).drop("near"), e


def radial_neighbours(edges: DataFrame, degree: DataFrame, of: str, limit: int = 18) -> DataFrame:
    """The first distinct neighbours of a node by edge layer (backbone first), their degree, edge id; top-k of one row each."""
    other = F.when(F.col("from_id") == of, F.col("to_id")).otherwise(F.col("from_id"))
    e = edges.where((F.col("from_id") == of) | (F.col("to_id") == of)).select("id", other.alias("neighbour"), (F.col("layer") != "backbone").alias("support"))
    e = e.join(degree.select(F.col("id").alias("neighbour"), "degree"), "neighbour")
    first = e.groupBy("neighbour").agg(F.min(F.struct("support", (-F.col("degree")).alias("neg"), "id")).alias("k"))
    return first.orderBy("k").limit(limit).select("neighbour", F.col("k.id").alias("edge_id"), (-F.col("k.neg")).alias("degree"))
