"""Row predicates and display projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import col


def _json(properties: str | Column, path: str) -> Column:
    return F.get_json_object(col(properties), f"$.{path}")


def hidden_image(modality: str | Column = "modality", properties: str | Column = "properties") -> Column:
    """an image whose relevance says keep=false, rejected, pending, or uncertain without a review. Never null."""
    status = F.coalesce(F.trim(_json(properties, "image_relevance.review_status")), F.lit(""))
    keep = F.coalesce(_json(properties, "image_relevance.keep"), F.lit(""))
    label = F.coalesce(F.trim(_json(properties, "image_relevance.relevance")), F.lit(""))
    bad = (keep == "false") | status.isin("rejected", "pending") | ((status == "") & (label == "uncertain"))
    return F.coalesce((F.lower(col(modality)) == "image") & bad, F.lit(False))


def pending_image(modality: str | Column = "modality", properties: str | Column = "properties") -> Column:
    """an image that waits for a review: pending, or uncertain without a status."""
    status = F.coalesce(F.trim(_json(properties, "image_relevance.review_status")), F.lit(""))
    label = F.coalesce(F.trim(_json(properties, "image_relevance.relevance")), F.lit(""))
    return F.coalesce((F.lower(col(modality)) == "image") & ((status == "pending") | ((status == "") & (label == "uncertain"))), F.lit(False))


def review_queue(evidence: DataFrame, limit: int = 500) -> DataFrame:
    """pending images, newest first."""
    return evidence.where(pending_image()).orderBy(F.desc("created_at"), "id").limit(limit)


def quality_evidence(properties: str | Column = "properties") -> Column:
    """neither synthetic nor excluded for quality."""
    flag = lambda k: F.coalesce(_json(properties, k) == "true", F.lit(False))
    return ~(flag("synthetic") | flag("quality_excluded"))


def with_valid_ref(rows: DataFrame, key: str, refs: str, valid: DataFrame, id_column: str = "id") -> DataFrame:
    """keys of rows with at least one reference in ``valid``: explode, semi-join, distinct."""
    r = rows.select(key, F.explode(refs).alias("ref"))
    return r.join(valid.select(F.col(id_column).alias("ref")), "ref", "left_semi").select(key).distinct()


def layer(properties: str | Column = "properties") -> Column:
    """node_layer, else layer, else an empty text."""
    return F.coalesce(_json(properties, "node_layer"), _json(properties, "layer"), F.lit(""))


def resolve_layer(kind: str | Column, subkind: str | Column, explicit: str | Column) -> Column:
    """the explicit layer if valid; backbone for concepts, rules, processes, substances and particles; else support."""
    rule = col(kind).isin("concept", "rule", "process") | ((col(kind) == "entity") & col(subkind).isin("substance", "particle"))
    return F.when(col(explicit).isin("backbone", "support"), col(explicit)).when(F.coalesce(rule, F.lit(False)), "backbone").otherwise("support")


#: Display types of subkinds and kinds.
SUBKIND_TYPES = {
    "substance": "substance", "experiment": "experiment", "symbol": "symbol", "formula": "symbol", "equation": "symbol", "model": "representation",
    "diagram": "representation", "table": "representation", "equipment": "entity", "apparatus": "entity", "molecule": "entity", "particle": "entity", "procedure": "method",
}
KIND_TYPES = ("property", "concept", "entity", "method", "process", "rule", "representation", "event", "resource")


def display_type(kind: str | Column, subkind: str | Column, node_type: Column | None = None, template: Column | None = None, subkinds: Mapping[str, str] = SUBKIND_TYPES, kinds: Sequence[str] = KIND_TYPES) -> Column:
    """F8: template key, node type, type of the subkind, the kind if it is a type, subkind, kind, ``other``."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    by_sub = F.element_at(F.create_map(*[F.lit(x) for kv in subkinds.items() for x in kv]), col(subkind))
    first = [filled(c) for c in (template, node_type) if c is not None]
    return F.coalesce(*first, by_sub, F.when(col(kind).isin(*kinds), col(kind)), filled(col(subkind)), filled(col(kind)), F.lit("other"))


def visible_nodes(nodes: DataFrame, edges: DataFrame, types: Sequence[str], book: str | None = None, focus: str | None = None, expanded: str | None = None) -> DataFrame:
    """nodes of the chosen types (and book); with ``expanded`` only backbone nodes and its support neighbours; with ``focus`` its 1-hop neighbours.

    nodes: id, type, layer, books; edges: from_id, to_id, expands.
    """
    n = nodes.where(F.col("type").isin(*types))
    if book:
        n = n.where(F.array_contains("books", book))
    if expanded:
        near = neighbours(edges.where("expands"), expanded)
        n = n.join(near.withColumn("near", F.lit(True)), "id", "left")
        n = n.where((F.col("layer") == "backbone") | F.coalesce("near", F.lit(False)) | (F.col("id") == F.lit(focus or ""))).drop("near")
    if focus:
        n = n.join(neighbours(edges, focus).union(n.sparkSession.createDataFrame([(focus,)], "id string")), "id", "left_semi")
    return n


def neighbours(edges: DataFrame, of: str) -> DataFrame:
    """Distinct other ends of a node's edges."""
    out = edges.where(F.col("from_id") == of).select(F.col("to_id").alias("id"))
    return out.union(edges.where(F.col("to_id") == of).select(F.col("from_id").alias("id"))).distinct()


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids, F.col("from_id") == ids["id"], "left_semi").join(ids, F.col("to_id") == ids["id"], "left_semi")


def client_search(nodes: DataFrame, term: str, hits: DataFrame | None = None) -> DataFrame:
    """server hits by score if there are any, else a substring search ordered by degree and name."""
    if hits is not None:
        return nodes.join(hits.select("id", "score"), "id").orderBy(F.desc("score"), "name", "id")
    text = F.lower(F.concat_ws(" ", "id", "name", "definition", "aliases"))
    return nodes.where(F.contains(text, F.lit(term.lower()))).orderBy(F.desc("degree"), "name", "id")


def optional_filters(df: DataFrame, **wanted: Sequence | None) -> DataFrame:
    """``column IN values`` for every argument that is given and not empty."""
    for c, values in wanted.items():
        if values:
            df = df.where(F.col(c).isin(*values))
    return df


def missing_embeddings(nodes: DataFrame) -> DataFrame:
    """nodes without a vector, by id."""
    return nodes.where(F.col("embedding").isNull() & (F.col("status") != "deprecated"))
