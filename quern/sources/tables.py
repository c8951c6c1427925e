"""Sources and sinks (S1-S24): dataset scans, lookups, content lists, exports, versioned writes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.filters import hidden_image, induced_edges
from quern.operators.normalize import active

EXPORT_LIMIT = 512 << 20


def resolve_dataset(datasets: DataFrame, key: str) -> DataFrame:
    """The dataset with an id or name, the active one first: at most one row."""
    return datasets.where((F.col("id") == key) | (F.col("name") == key)).orderBy(F.desc("is_active"), "id").limit(1)


def scan(spark: SparkSession, path: str, dataset: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A table of a dataset. Tables are partitioned by dataset_id, so the filter prunes partitions."""
    df = spark.read.parquet(path)
    if dataset is not None:
        df = df.where(F.col("dataset_id") == dataset)
    return df.select(*columns) if columns else df


def visible(evidence: DataFrame) -> DataFrame:
    """Evidence without hidden images."""
    return evidence.where(~hidden_image())


def lookup(df: DataFrame, **keys) -> DataFrame:
    """S3: one row by its key."""
    for c, v in keys.items():
        df = df.where(F.col(c) == v)
    return df.limit(1)


def node_body(bodies: DataFrame, node: str) -> DataFrame:
    """S3: a node's body that is active, filled and no fallback from its card."""
    b = active(bodies).where((F.col("node_id") == node) & (F.trim("content") != ""))
    return b.where(~F.col("generated_from").eqNullSafe("node_card_fallback")).limit(1) if "generated_from" in b.columns else b.limit(1)


def import_assets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file with its file name; the schema is given, nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


BLOCK = "struct<type:string,page_idx:int,bbox:array<double>,text:string,content:string,title:string,table_body:string,latex:string,img_path:string,caption:string,footnote:string,text_level:int>"


def content_blocks(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Normalised blocks of OCR content lists: version 2 is an array of pages of blocks, version 1 a flat list with page_idx.

    Text is the first filled of the text-like fields; bounding boxes are clamped to 0..1000, title levels to 1..6.
    """
    kind = f"array<array<{BLOCK}>>" if version == 2 else f"array<{BLOCK}>"
    raw = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", kind).alias("j"))
    if version == 2:
        b = raw.select("file", F.posexplode("j").alias("page_index", "p")).select("file", "page_index", F.posexplode("p").alias("order_index", "b"))
    else:
        b = raw.select("file", F.posexplode("j").alias("order_index", "b")).select("file", F.coalesce("b.page_idx", F.lit(0)).alias("page_index"), "order_index", "b")
    return b.select("file", "page_index", "order_index", *normal_block(F.col("b")))


def normal_block(b: Column) -> list[Column]:
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    text = F.coalesce(*[filled(b[c]) for c in ("text", "content", "title", "table_body", "latex", "caption", "footnote")], F.lit(""))
    box = F.when(F.size(b["bbox"]) == 4, F.transform(b["bbox"], lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), x))))
    level = F.when(b["text_level"].isNotNull(), F.greatest(F.lit(1), F.least(F.lit(6), b["text_level"])))
    return [F.coalesce(b["type"], F.lit("text")).alias("type"), text.alias("text"), box.alias("bbox"), level.alias("level"), b["img_path"].alias("image_path")]


def blocks_markdown(blocks: DataFrame) -> DataFrame:
    """Markdown of a content list: headings by level, images as markup, other blocks as paragraphs, in order."""
    line = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(F.col("image_path").isNotNull(), F.concat(F.lit("!["), "text", F.lit("]("), "image_path", F.lit(")"))).otherwise(F.col("text"))
    rows = blocks.withColumn("line", line).where("line <> ''").groupBy("file")
    return rows.agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_index", "order_index", "line")))["line"], "\n\n").alias("md"))


def safe_member(name: str) -> bool:
    """Whether an archive member stays inside its target folder."""
    parts = re.split(r"[\\/]+", name)
    return bool(name) and not name.startswith(("/", "\\")) and not re.match(r"^[A-Za-z]:", name) and ".." not in parts and "\0" not in name


def pair_bundles(files: DataFrame) -> DataFrame:
    """PDF files with the OCR bundle of the same stem in the same folder, and a hash of path and size. files: path, length."""
    f = files.withColumn("stem", F.regexp_replace(F.lower("path"), r"(_content_list(_v2)?)?\.[a-z0-9]+$", ""))
    pdf = f.where(F.lower("path").rlike(r"\.pdf$")).select("stem", F.col("path").alias("pdf"), F.sha2(F.concat_ws("\n", "path", F.col("length").cast("string")), 256).alias("key"))
    ocr = f.where(F.lower("path").rlike(r"_content_list(_v2)?\.json$")).groupBy("stem").agg(F.max("path").alias("bundle"))
    return pdf.join(ocr, "stem", "left").drop("stem")


def replace_partition(new: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of ``key`` that ``new`` has, keep the others (dynamic overwrite)."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def export_json(df: DataFrame, limit: int = EXPORT_LIMIT) -> DataFrame:
    """Rows as JSON text; refuses more than ``limit`` bytes, measured in the same snapshot by one aggregate."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("n")).first()["n"]
    if size > limit:
        raise ValueError(f"export of {size} bytes exceeds {limit}")
    return rows


def artifact(nodes: DataFrame, edges: DataFrame, profiles: DataFrame) -> dict[str, DataFrame]:
    """Active nodes, active edges with both ends among them, profiles of exported nodes."""
    n = active(nodes)
    return {"nodes": n, "edges": induced_edges(active(edges), n), "profiles": active(profiles).join(n.select(F.col("id").alias("node_id")), "node_id", "left_semi")}


def checksums(df: DataFrame, key: str) -> DataFrame:
    """sha256 of every row as JSON with sorted keys."""
    return df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("sha256"))


def verify_artifact(parts: dict[str, DataFrame], counts: dict[str, int], units: DataFrame) -> DataFrame:
    """Problems of an export: counts, repeated ids, dangling ends, nodes without exactly one unit, local paths."""
    n, e = parts["nodes"], parts["edges"]
    say = lambda df, key, text: df.select(F.lit(text).alias("problem"), F.col(key).cast("string").alias("id"))
    out = []
    for name, want in counts.items():
        got = parts[name].agg(F.count("*").alias("n"))
        out.append(say(got.where(F.col("n") != want), "n", f"{name}: count differs from {want}"))
    out.append(say(n.groupBy("id").count().where("count > 1"), "id", "repeated id"))
    for c in ("from_id", "to_id"):
        out.append(say(e.join(n.select(F.col("id").alias(c)), c, "left_anti"), "id", f"dangling {c}"))
    u = units.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("k"))
    j = n.select("id", F.lit(True).alias("node")).join(u, "id", "full_outer")
    out.append(say(j.where("node is null or coalesce(k, 0) <> 1"), "id", "not exactly one unit"))
    leak = F.to_json(F.struct(*n.columns)).rlike(r"(/Users/|/home/|[A-Z]:\\\\)")
    out.append(say(n.where(leak), "id", "local path"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def admin_page(df: DataFrame, search: str, sort: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows whose JSON holds the text (case-insensitive), by a known column; limit 1..200."""
    if sort not in df.columns:
        raise ValueError(f"unknown column {sort}")
    rows = df.where(F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lower(F.lit(search)))) if search else df
    return rows.orderBy(sort, *[c for c in df.columns if c != sort]).offset(max(0, offset)).limit(max(1, min(200, limit)))


def table_metadata(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """Column types, key flags and order of tables, from their schemas."""
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, f.name in keys.get(t, ()), i) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, is_key boolean, position int")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact row counts of tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.union(one)
    return out


def update_rows(df: DataFrame, keys: dict, patch: dict, editable: Sequence[str], key_columns: Sequence[str] | None = None) -> DataFrame:
    """A copy of the table with typed changes to the row of a key; unknown or fixed columns are refused.

    ``key_columns``: the table's whole key; then ``keys`` must name each of them and nothing else.
    """
    if key_columns is not None and set(keys) != set(key_columns):
        raise ValueError(f"not the whole key {list(key_columns)}: {list(keys)}")
    if bad := [c for c in patch if c not in editable or c in keys]:
        raise ValueError(f"not editable: {bad}")
    hit = F.lit(True)
    for c, v in keys.items():
        hit = hit & F.col(c).eqNullSafe(F.lit(v))
    return df.select(*[F.when(hit, F.lit(patch[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in patch else F.col(c) for c in df.columns])


def artifact_bundle(nodes: DataFrame, edges: DataFrame, profiles: DataFrame) -> DataFrame:
    """Counts of a static snapshot as metadata: one row."""
    c = lambda df, n: df.agg(F.count("*").alias(n))
    return c(nodes, "nodes").crossJoin(c(edges, "edges")).crossJoin(c(profiles, "profiles"))


def source_catalogue(datasets: DataFrame, books: DataFrame, profiles: DataFrame) -> DataFrame:
    """Datasets with book and profile counts; without any active one the first id counts as active."""
    b = books.groupBy("dataset").agg(F.countDistinct("book").alias("n_books"))
    p = profiles.groupBy("dataset").agg(F.count("*").alias("n_profiles"))
    head = datasets.agg(F.max("is_active").alias("any_active"), F.min("dataset").alias("first"))
    j = datasets.join(b, "dataset", "left").join(p, "dataset", "left").na.fill(0).crossJoin(F.broadcast(head))
    return j.select("dataset", "n_books", "n_profiles", (F.col("is_active") | (~F.col("any_active") & (F.col("dataset") == F.col("first")))).alias("active"))


def reader_books(blocks: DataFrame, aliases: DataFrame) -> DataFrame:
    """Page counts per book (last page + 1), legacy roots renamed to their canonical book."""
    b = blocks.join(aliases, "root", "left").withColumn("book", F.coalesce("book", "root"))
    return b.groupBy("book").agg((F.max("page_index") + 1).alias("n_pages"), F.count("*").alias("n_blocks"))


def outline_catalogue(items: DataFrame, updated: Column) -> DataFrame:
    """One catalogue row per outline with its item and chunk counts and last update."""
    return items.groupBy("book").agg(F.count("*").alias("n_items"), F.count_if(F.col("kind") == "chunk").alias("n_chunks"), F.max(updated).alias("updated_at"))
