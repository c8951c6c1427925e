"""Graph-shaped views of the driver's tables. Every derivation is arithmetic, so that an SQL oracle can repeat it.

``Views(spark, dir)`` gives lazy DataFrames; ``SQL`` gives the same views as DuckDB CTEs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_docs(self) -> int:
        return self.table("documents").count()

    @cached_property
    def n_parts(self) -> int:
        return self.table("part").count()

    @cached_property
    def nodes(self) -> DataFrame:
        d = self.n_docs
        return self.table("part").selectExpr(
            "concat('part:', p_partkey) AS id", "p_name AS name", "p_type AS kind", "p_brand AS subkind",
            "concat_ws(' ', p_name, p_brand, p_type) AS definition", "if(p_partkey % 17 = 0, 'deprecated', 'active') AS status",
            "lpad(p_partkey, 10, '0') AS created_at", "split(p_name, ' ') AS aliases", "array(p_brand) AS tags",
            f"array(concat('doc:', p_partkey * 7 % {d}), concat('doc:', (p_partkey * 13 + 1) % {d})) AS source_refs", "p_partkey AS key",
        )

    @cached_property
    def edges(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id", "concat('part:', l_partkey) AS from_id",
            "concat('supp:', l_suppkey) AS to_id", "l_returnflag AS type", "if(l_linestatus = 'F', 'directed', 'undirected') AS directionality",
            "if(l_linenumber = 7, 'deprecated', 'active') AS status", "date_format(l_shipdate, 'yyyy-MM-dd') AS created_at",
            f"array(concat('doc:', l_orderkey % {self.n_docs})) AS source_refs",
        )

    @cached_property
    def links(self) -> DataFrame:
        """Part to next part of the same order where both have one brand: many small components."""
        kin = self.table("part").selectExpr("p_partkey", "p_brand AS kin")
        pairs = self.spark.sql(
            "SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM {li}", li=self.table("lineitem")
        ).where("b IS NOT NULL")
        x, y = kin.toDF("a", "ka"), kin.toDF("b", "kb")
        return pairs.join(x, "a").join(y, "b").where("ka = kb").selectExpr("concat('part:', a) AS from_id", "concat('part:', b) AS to_id")

    @cached_property
    def all_links(self) -> DataFrame:
        """Part to next part of the same order, for all orders."""
        return self.spark.sql(
            """SELECT concat('part:', a) AS from_id, concat('part:', b) AS to_id FROM (
                 SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM {li}) WHERE b IS NOT NULL""",
            li=self.table("lineitem"),
        )

    @cached_property
    def evidence(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "concat('doc:', doc_id) AS id", "source AS source_id", "concat(lang, ':', doc_id div 10) AS anchor_ref", "text AS excerpt", "if(doc_id % 10 = 0, 'image', 'text') AS modality",
            """concat('{"image_relevance":{"keep":', if(doc_id % 20 = 0, 'false', 'true'),
               if(doc_id % 30 = 10, ',"review_status":"pending"', if(doc_id % 70 = 0, ',"review_status":"rejected"', '')), if(doc_id % 50 = 30, ',"relevance":"uncertain"', ''), '}',
               if(doc_id % 29 = 0, ',"synthetic":true', ''), if(doc_id % 31 = 0, ',"quality_excluded":true', ''), '}') AS properties""",
            "cast(doc_id % 50 + 1 AS int) AS page_start", "cast(if(doc_id % 3 = 0, null, doc_id % 50 + 1 + doc_id % 4) AS int) AS page_end", "doc_id AS key",
        )

    @cached_property
    def mentions(self) -> DataFrame:
        p = self.n_parts
        return self.table("labels").join(self.table("documents").select("doc_id", "source", "lang"), "doc_id").selectExpr(
            "concat('ment:', doc_id) AS id", "source AS source_id", "concat(lang, ':', doc_id div 10) AS anchor_ref", f"concat('part:', doc_id % {p}) AS target_id",
            "if(quality = 1, 'core', 'support') AS role", "array(concat('doc:', doc_id)) AS source_refs",
        )

    @cached_property
    def profiles(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "concat('prof:', o_orderkey) AS id", f"concat('part:', o_custkey % {self.n_parts}) AS node_id", "o_orderpriority AS domain",
            "array(o_orderstatus) AS school_stages", "array(o_orderpriority, o_orderstatus) AS curriculum_roles",
            f"array(concat('doc:', o_orderkey % {self.n_docs})) AS source_refs", "if(o_orderkey % 19 = 0, 'deprecated', 'active') AS status",
            "date_format(o_orderdate, 'yyyy-MM-dd') AS created_at",
        )

    @cached_property
    def cards(self) -> DataFrame:
        """Cards with 0 to 6 sections; every third section lacks its references."""
        kinds = "array('definition', 'essence', 'key_points', 'example', 'application', 'misconception')"
        return self.table("part").where("p_partkey % 4 <> 3").selectExpr(
            "concat('part:', p_partkey) AS node_id", "if(p_partkey % 9 = 0, '', p_name) AS summary", f"array(concat('doc:', p_partkey * 3 % {self.n_docs})) AS source_refs",
            f"""transform(slice({kinds}, 1, cast(p_size % 7 AS int)), (k, i) -> named_struct('id', if(i % 2 = 0, k, ''), 'title', if(i % 3 = 1, ' ', concat(' ', upper(k))),
                'section_type', if(i = 4, '', k), 'content', array(p_brand, ' ', concat(' ', p_name)),
                'source_refs', if(i % 3 = 2, array(), array(concat('doc:', (p_partkey * 5 + i) % {self.n_docs}))))) AS sections""",
        )

    @cached_property
    def bodies(self) -> DataFrame:
        return self.table("part").where("p_partkey % 5 = 0").selectExpr(
            "concat('part:', p_partkey) AS node_id", "if(p_partkey % 15 = 0, ' ', concat('# ', p_name, '\n', p_type)) AS content",
            f"if(p_partkey % 10 = 0, array(), array(concat('doc:', p_partkey * 11 % {self.n_docs}))) AS source_refs",
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.concat(F.lit("part:"), "vec_id").alias("id"), "vec_id", "embedding", "label")

    @cached_property
    def markdown(self) -> DataFrame:
        """book_id, md: the article of every page as markdown; a bold start of a paragraph becomes a second-level heading."""
        md = F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)
        for pattern, text in (("<h1>", "\n# "), ("<p><b>", "\n## "), ("</h1>|</?p>|<br>", "\n"), ("<[^>]*>", "")):
            md = F.regexp_replace(md, pattern, text)
        return self.table("pages").select(F.col("page_id").alias("book_id"), md.alias("md"))

    @cached_property
    def headings(self) -> DataFrame:
        """book_id, line, level, text of all markdown headings."""
        from quern.operators.outline import headings

        return headings(self.markdown)


#: The same views for DuckDB.
SQL = {
    "nodes": """nodes AS (SELECT 'part:' || p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS subkind, concat_ws(' ', p_name, p_brand, p_type) AS definition,
  CASE WHEN p_partkey % 17 = 0 THEN 'deprecated' ELSE 'active' END AS status, lpad(p_partkey::VARCHAR, 10, '0') AS created_at,
  string_split(p_name, ' ') AS aliases, [p_brand] AS tags, ['doc:' || p_partkey * 7 % d, 'doc:' || (p_partkey * 13 + 1) % d] AS source_refs, p_partkey AS key
  FROM part, (SELECT count(*) AS d FROM documents))""",
    "edges": """edges AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, 'part:' || l_partkey AS from_id, 'supp:' || l_suppkey AS to_id,
  l_returnflag AS type, CASE WHEN l_linestatus = 'F' THEN 'directed' ELSE 'undirected' END AS directionality,
  CASE WHEN l_linenumber = 7 THEN 'deprecated' ELSE 'active' END AS status, strftime(l_shipdate, '%Y-%m-%d') AS created_at, ['doc:' || l_orderkey % d] AS source_refs
  FROM lineitem, (SELECT count(*) AS d FROM documents))""",
    "links": """links AS (SELECT 'part:' || a AS from_id, 'part:' || b AS to_id FROM (
  SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b
  WHERE x.p_brand = y.p_brand)""",
    "evidence": """evidence AS (SELECT 'doc:' || doc_id AS id, source AS source_id, lang || ':' || doc_id // 10 AS anchor_ref, text AS excerpt, CASE WHEN doc_id % 10 = 0 THEN 'image' ELSE 'text' END AS modality,
  CASE WHEN doc_id % 20 = 0 THEN false ELSE true END AS keep, CASE WHEN doc_id % 30 = 10 THEN 'pending' WHEN doc_id % 70 = 0 THEN 'rejected' END AS review,
  doc_id % 50 = 30 AS uncertain, doc_id % 29 = 0 AS synthetic, doc_id % 31 = 0 AS quality_excluded,
  (doc_id % 50 + 1)::INT AS page_start, (CASE WHEN doc_id % 3 <> 0 THEN doc_id % 50 + 1 + doc_id % 4 END)::INT AS page_end, doc_id AS key FROM documents)""",
    "mentions": """mentions AS (SELECT 'ment:' || l.doc_id AS id, source AS source_id, lang || ':' || l.doc_id // 10 AS anchor_ref, 'part:' || l.doc_id % p AS target_id,
  CASE WHEN quality = 1 THEN 'core' ELSE 'support' END AS role, ['doc:' || l.doc_id] AS source_refs
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id, (SELECT count(*) AS p FROM part))""",
    "profiles": """profiles AS (SELECT 'prof:' || o_orderkey AS id, 'part:' || o_custkey % p AS node_id, o_orderpriority AS domain, [o_orderstatus] AS school_stages,
  [o_orderpriority, o_orderstatus] AS curriculum_roles, ['doc:' || o_orderkey % d] AS source_refs,
  CASE WHEN o_orderkey % 19 = 0 THEN 'deprecated' ELSE 'active' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS created_at
  FROM orders, (SELECT count(*) AS p FROM part), (SELECT count(*) AS d FROM documents))""",
    "cards": """cards AS (SELECT 'part:' || p_partkey AS node_id, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END AS summary, ['doc:' || p_partkey * 3 % d] AS source_refs,
  p_size % 7 AS n_sections, p_partkey AS key, p_brand, p_name, d FROM part, (SELECT count(*) AS d FROM documents) WHERE p_partkey % 4 <> 3),
sections AS (SELECT node_id, i, CASE WHEN i % 2 = 0 THEN k ELSE '' END AS id, CASE WHEN i % 3 = 1 THEN ' ' ELSE ' ' || upper(k) END AS title,
  CASE WHEN i = 4 THEN '' ELSE k END AS section_type, [p_brand, ' ', ' ' || p_name] AS content,
  CASE WHEN i % 3 = 2 THEN []::VARCHAR[] ELSE ['doc:' || (key * 5 + i) % d] END AS source_refs
  FROM (SELECT *, unnest(range(0, n_sections)) AS i FROM cards), LATERAL (SELECT (['definition', 'essence', 'key_points', 'example', 'application', 'misconception'])[(i + 1)::INT] AS k))""",
    "bodies": """bodies AS (SELECT 'part:' || p_partkey AS node_id, CASE WHEN p_partkey % 15 = 0 THEN ' ' ELSE '# ' || p_name || chr(10) || p_type END AS content,
  CASE WHEN p_partkey % 10 = 0 THEN []::VARCHAR[] ELSE ['doc:' || p_partkey * 11 % d] END AS source_refs FROM part, (SELECT count(*) AS d FROM documents) WHERE p_partkey % 5 = 0)""",
    "vectors": """vectors AS (SELECT 'part:' || vec_id AS id, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)""",
    "markdown": """markdown AS (SELECT page_id AS book_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1),
  '<h1>', chr(10) || '# ', 'g'), '<p><b>', chr(10) || '## ', 'g'), '</h1>|</?p>|<br>', chr(10), 'g'), '<[^>]*>', '', 'g') AS md FROM pages),
md_lines AS (SELECT book_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1)::INT AS n FROM markdown),
headings AS (SELECT book_id, n AS line, length(regexp_extract(line, '^(#{1,6})\\s+(.+)', 1))::INT AS level, trim(regexp_extract(line, '^(#{1,6})\\s+(.+)', 2)) AS text FROM md_lines WHERE regexp_matches(line, '^(#{1,6})\\s+(.+)'))""",
}


def ctes(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
