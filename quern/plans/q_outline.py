"""Document structuring queries over the pages' markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.similarity import character_similarity
from quern.operators import outline as O
from quern.plans.catalog import register
from quern.sources.views import Views, ctes

_MD = ctes("markdown")


@register("d3_headings", f"{_MD} SELECT book_id, line, level, text FROM headings")
def d3(spark, d):
    return Views(spark, d).headings


_TREE = f"""{_MD}, t AS (SELECT *, (SELECT max(line) FROM headings p WHERE p.book_id = h.book_id AND p.line < h.line AND p.level < h.level) AS parent_line FROM headings h),
s AS (SELECT *, row_number() OVER (PARTITION BY book_id, parent_line ORDER BY line) AS number FROM t),
r AS (SELECT book_id, line, text, level, parent_line, number::VARCHAR AS order_path, 1 AS depth FROM s WHERE parent_line IS NULL UNION ALL
  SELECT s.book_id, s.line, s.text, s.level, s.parent_line, r.order_path || '.' || s.number, r.depth + 1 FROM s JOIN r ON s.book_id = r.book_id AND s.parent_line = r.line),
k AS (SELECT *, CASE WHEN (book_id, line) NOT IN (SELECT book_id, parent_line FROM s WHERE parent_line IS NOT NULL) THEN 'lesson' WHEN depth = 1 THEN 'theme' ELSE 'topic' END AS kind FROM r)"""


@register("d13_heading_tree", f"{_TREE} SELECT book_id, line, order_path, parent_line, depth, kind FROM k")
def d13(spark, d):
    return O.heading_tree(Views(spark, d).headings)


def _items(v: Views):
    h = v.headings
    t = O.heading_tree(h).join(h, ["book_id", "line"])
    ident = lambda c: F.concat(F.lit("struct:"), "book_id", F.lit(":h:"), c)
    return t.select("book_id", ident("line").alias("id"), F.when(F.col("parent_line").isNotNull(), ident("parent_line")).alias("parent_id"), "kind", F.col("text").alias("title"), "level", "depth", "order_path", F.col("line").alias("md_start"), F.col("line").alias("pos"), F.lit("").alias("label"))


_ITEMS = f"{_TREE}, items AS (SELECT book_id, 'struct:' || book_id || ':h:' || line AS id, 'struct:' || book_id || ':h:' || parent_line AS parent_id, kind, text AS title, level, depth, order_path, line AS md_start FROM k)"


@register("d1_flatten", f"{_ITEMS} SELECT id, depth - 1 AS depth, row_number() OVER (PARTITION BY book_id ORDER BY depth, CASE WHEN depth = 1 THEN md_start ELSE split_part(parent_id, ':', 4)::INT END, md_start)::INT AS place FROM items")
def d1(spark, d):
    return O.flatten(_items(Views(spark, d)).select("book_id", "id", "parent_id", "pos")).select("id", "depth", "place")


@register("d2_anchors", f"""{_ITEMS}, a AS (SELECT 'h:' || md_start AS anchor FROM items UNION SELECT id FROM items UNION SELECT 'h-none'), v AS (SELECT id, unnest(['h:' || md_start, 'h-' || md_start, md_start::VARCHAR]) AS anchor FROM items)
SELECT a.anchor, CASE WHEN a.anchor IN (SELECT id FROM items) THEN a.anchor WHEN count(DISTINCT v.id) = 1 THEN min(v.id) END AS id, CASE WHEN a.anchor IN (SELECT id FROM items) THEN 1 ELSE count(DISTINCT v.id) END::BIGINT AS n FROM a LEFT JOIN v USING (anchor) GROUP BY a.anchor""")
def d2(spark, d):
    i = _items(Views(spark, d))
    q = i.select(F.concat(F.lit("h:"), "md_start").alias("anchor")).union(i.select("id")).union(spark.createDataFrame([("h-none",)], "anchor string")).distinct()
    return O.resolve_anchors(q, i).withColumn("n", F.col("n").cast("long"))


@register("d4_content_roles", """SELECT role, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'summary' WHEN t IN ('复习题', '第1节 练习') THEN 'assessment' WHEN t IN ('本章小结', '复习') THEN 'summary' WHEN t = '参考文献' THEN 'excluded' ELSE 'knowledge' END AS role
FROM (SELECT o_orderkey, (['复习题', '第1节 练习', '本章小结', '复习', '参考文献', '速度'])[(o_orderkey % 6 + 1)::INT] AS t FROM orders)) GROUP BY 1""")
def d4(spark, d):
    t = Views(spark, d).table("orders").selectExpr("element_at(array('复习题', '第1节 练习', '本章小结', '复习', '参考文献', '速度'), cast(o_orderkey % 6 + 1 AS int)) AS t", "if(o_orderkey % 7 = 0, 'summary', 'odd') AS e")
    return t.groupBy(X.content_role("t", F.lit(""), "e").alias("role")).agg(F.count("*").alias("n"))


@register("d5_d12_spans", """WITH e AS (SELECT l_orderkey AS book_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line, (l_partkey % 3 + 1)::INT AS level, (l_linenumber * 10)::INT AS page FROM lineitem),
f AS (SELECT *, (SELECT arg_min(page, line) FROM e n WHERE n.book_id = e.book_id AND n.line > e.line AND n.level <= e.level) AS nxt FROM e)
SELECT book_id, line::INT AS line, CASE WHEN nxt IS NOT NULL THEN greatest(page, nxt - 1) END::INT AS "end", CASE WHEN nxt IS NOT NULL THEN greatest(page, nxt - 1) - page + 1 ELSE 0 END::INT AS pages FROM f""")
def d5(spark, d):
    li = spark.sql("SELECT l_orderkey AS book_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line, cast(l_partkey % 3 + 1 AS int) AS level, l_linenumber * 10 AS page FROM {t}", t=Views(spark, d).table("lineitem"))
    e = O.range_ends(li).withColumn("end", F.when(F.col("end").isNotNull(), F.col("end")))
    return e.select("book_id", "line", "end", O.span("page", "end").alias("pages"))


@register("d6_nearest_theme", f"""{_ITEMS}, a AS (SELECT book_id, id, parent_id AS anc, 1 AS dist FROM items WHERE parent_id IS NOT NULL UNION ALL SELECT a.book_id, a.id, i.parent_id, dist + 1 FROM a JOIN items i ON i.id = a.anc WHERE i.parent_id IS NOT NULL)
SELECT i.id, (SELECT arg_min(anc, dist) FROM a JOIN items t ON t.id = a.anc WHERE a.id = i.id AND t.kind = 'theme') AS theme FROM items i""")
def d6(spark, d):
    return O.nearest(_items(Views(spark, d)), "theme").select("id", "theme")


def _leaves(v: Views):
    """Leaves of a book: its second-level headings in runs up to the next one, 40 lines to a markdown line."""
    i = _items(v).where("kind = 'lesson'")
    nxt = F.lead("md_start").over(O.Window.partitionBy("book_id").orderBy("md_start"))
    return i.select("book_id", "id", F.when(F.col("md_start") % 5 == 0, "activity").otherwise("lesson").alias("kind"), "title", (F.col("md_start") * 10).alias("md_start"), (F.coalesce(nxt, F.col("md_start") + 4) * 10 - 1).alias("md_end"), F.col("parent_id").alias("topic"), F.lit("c").alias("chapter"))


@register("d9_chunk_plan")
def d9(spark, d):
    v = Views(spark, d)
    return O.chunk_plan(_leaves(v), v.headings.withColumn("line", F.col("line") * 10))


@register("d9_chunk_sizes")
def d9b(spark, d):
    v = Views(spark, d)
    return O.chunk_sizes(O.chunk_plan(_leaves(v), v.headings.withColumn("line", F.col("line") * 10)))




@register("d10_page_interpolation", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_linenumber + floor((l_partkey % 100) / 100 * l_quantity + 0.5))::INT AS page FROM lineitem")
def d10(spark, d):
    li = Views(spark, d).table("lineitem")
    page = O.interpolate_page(F.col("l_partkey") % 100, F.lit(0), F.lit(100), F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", page.alias("page"))


@register("d11_toc_entries", """WITH c AS (SELECT conv_id AS book_id, turn AS line FROM conversations) SELECT book_id, line, CASE line % 4 WHEN 0 THEN 'theme' WHEN 3 THEN 'boundary' ELSE 'lesson' END AS kind,
CASE line % 4 WHEN 0 THEN (line // 4 + 1)::VARCHAR WHEN 1 THEN (line // 4 + 1) || '.12' WHEN 2 THEN '9.' || line ELSE (line // 4 + 1)::VARCHAR END AS order_path, CASE line % 4 WHEN 0 THEN '运动' WHEN 1 THEN '速度' WHEN 2 THEN 'Speed' ELSE '本章小结' END AS title, (line * 3)::INT AS page FROM c""")
def d11(spark, d):
    t = Views(spark, d).table("conversations").selectExpr(
        "conv_id AS book_id", "turn AS line",
        "case turn % 4 when 0 then concat('第', turn div 4 + 1, '章 运动 …… ', turn * 3) when 1 then concat('第十二节  速度......', turn * 3) when 2 then concat('9.', turn, ' Speed ---- ', turn * 3) else concat('本章小结 / ', turn * 3) end AS text",
    )
    return O.toc_entries(t)


@register("d14_alignment")
def d14(spark, d):
    v = Views(spark, d)
    items = _items(v).withColumn("title", F.regexp_replace("title", "[&%$*#]+|&amp;", "")).select("book_id", "pos", "id", "title", "label", "level")
    return O.align_outlines(items, v.headings)


@register("d16_character_similarity", """WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part), g AS (SELECT p_partkey, a, b, list_transform(range(1, length(a)), lambda i: substr(a, i, 2)) AS x, list_transform(range(1, length(b)), lambda i: substr(b, i, 2)) AS y FROM p WHERE b IS NOT NULL),
u AS (SELECT p_partkey, unnest(x) AS g, 1 AS l, 0 AS r FROM g UNION ALL SELECT p_partkey, unnest(y), 0, 1 FROM g), c AS (SELECT p_partkey, sum(m) AS o FROM (SELECT p_partkey, least(sum(l), sum(r)) AS m FROM u GROUP BY p_partkey, g) GROUP BY 1)
SELECT p_partkey, round(CASE WHEN a = b THEN 1 ELSE greatest(1 - levenshtein(a, b) / greatest(length(a), length(b)), 2 * o / (len(x) + len(y))) END, 6)::DOUBLE AS similarity FROM g JOIN c USING (p_partkey)""")
def d16(spark, d):
    p = Views(spark, d).table("part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(character_similarity(F.col("p_name"), F.col("b")), 6).alias("similarity"))


@register("d17_heading_forms", f"""{_MD} SELECT book_id, line, regexp_replace(regexp_replace(lower(text), '[#*_`~\\[\\]().,，。:：;；!?！？/\\\\|"《》“”‘’、-]+', ' ', 'g'), '\\s+', '', 'g') AS norm FROM headings""")
def d17(spark, d):
    return Views(spark, d).headings.select("book_id", "line", O.heading_norm("text").alias("norm"))


@register("d19_ranges", f"""{_ITEMS}, ls AS (SELECT book_id, max(n) AS last FROM md_lines GROUP BY 1) SELECT id, md_start, greatest(md_start, coalesce((SELECT min(md_start) FROM items n WHERE n.book_id = i.book_id AND n.md_start > i.md_start AND n.depth <= i.depth) - 1, last))::INT AS md_end FROM items i JOIN ls USING (book_id)""")
def d19(spark, d):
    v = Views(spark, d)
    last = O.lines(v.markdown).groupBy("book_id").agg(F.max("line").alias("last"))
    starts = O.parent_starts(_items(v).withColumn("md_start", F.when(F.col("kind") == "lesson", F.col("md_start"))))
    same = O.hierarchical_ends(_items(v), last).select("id", "md_start", F.col("md_end").cast("int").alias("md_end"))
    return same.join(starts.select("id"), "id", "left_semi")


@register("d20_combined_headings", f"""{_MD}, h AS (SELECT book_id, line, level, CASE WHEN line % 3 = 0 THEN '1.' || line ELSE text END AS text FROM headings), f AS (SELECT *, line % 3 = 0 AS alone, lead(line) OVER w AS nl, lead(text) OVER w AS nt, lead(line % 3 = 0) OVER w AS no FROM h WINDOW w AS (PARTITION BY book_id ORDER BY line)),
g AS (SELECT *, coalesce(alone AND NOT no AND nl - line <= 4, false) AS pair FROM f), e AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY book_id ORDER BY line), false) AS eaten FROM g) SELECT book_id, line, level, CASE WHEN pair THEN text || ' ' || nt ELSE text END AS text FROM e WHERE NOT eaten""")
def d20(spark, d):
    h = Views(spark, d).headings.withColumn("text", F.when(F.col("line") % 3 == 0, F.concat(F.lit("1."), "line")).otherwise(F.col("text")))
    return O.combine_split_headings(h, 4)


@register("d21_body_headings", f"{_MD}, h AS (SELECT book_id, line, CASE WHEN line = 2 THEN 'Contents' WHEN line >= 20 AND line % 4 = 0 THEN 'Appendix A' ELSE text END AS text FROM headings) SELECT book_id, line FROM h WHERE line > coalesce((SELECT min(line) FROM h t WHERE t.book_id = h.book_id AND text = 'Contents'), 0) AND line < coalesce((SELECT max(line) FROM h a WHERE a.book_id = h.book_id AND text = 'Appendix A'), 99999)")
def d21(spark, d):
    h = Views(spark, d).headings
    h = h.withColumn("text", F.when(F.col("line") == 2, "Contents").when((F.col("line") >= 20) & (F.col("line") % 4 == 0), "Appendix A").otherwise(F.col("text")))
    return O.body_headings(h).select("book_id", "line")


@register("d22_preview", f"{_ITEMS} SELECT id, row_number() OVER (PARTITION BY book_id ORDER BY md_start)::INT AS place, md_start % 4 = 0 AS needs_review, count(*) FILTER (kind = 'lesson') OVER (PARTITION BY book_id) AS n_lesson FROM items")
def d22(spark, d):
    i = _items(Views(spark, d)).withColumn("status", F.when(F.col("pos") % 4 == 0, "warning").otherwise("matched")).withColumn("path", F.transform(F.split("order_path", r"\."), lambda x: x.cast("int")))
    return O.preview(i).select("id", "place", "needs_review", "n_lesson")


@register("d23_fingerprints", """SELECT n_regionkey AS book_id, sha256('[' || string_agg('{"id":"n' || n_nationkey || '","title":"' || n_name || '"}', ',' ORDER BY 'n' || n_nationkey) || ']') AS fingerprint FROM nation GROUP BY 1""")
def d23(spark, d):
    return O.fingerprint(Views(spark, d).table("nation").selectExpr("n_regionkey AS book_id", "concat('n', n_nationkey) AS id", "n_name AS title"))


@register("d24_chunk_previews", f"""{_MD}, c AS (SELECT book_id, line AS s, line + 6 AS e FROM headings) SELECT c.book_id, s AS start, substr(trim(regexp_replace(string_agg(l.line, chr(10) ORDER BY n), '\\s+', ' ', 'g')), 1, 360) AS preview FROM c JOIN md_lines l ON l.book_id = c.book_id AND n BETWEEN s AND e GROUP BY ALL""")
def d24(spark, d):
    v = Views(spark, d)
    c = v.headings.select("book_id", F.col("line").alias("start"), (F.col("line") + 6).alias("end"))
    return O.chunk_previews(c, v.markdown).select("book_id", "start", "preview")


@register("d25_evidence_hints", """SELECT conv_id AS book_id, 0 AS position, 'table' AS modality, 'markdown-table-1' AS locator FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, 1, 'equation', 'line:6' FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, 2, 'image', 'line:7' FROM conversations WHERE turn = 0""")
def d25(spark, d):
    c = Views(spark, d).table("conversations").where("turn = 0")
    md = c.select(F.col("conv_id").alias("book_id"), F.concat(F.lit("| a |\n| b |\n"), F.regexp_replace("text", r"[\n$|]", " "), F.lit("\n\n$$\nx=1 $$\n![i](a.png)")).alias("md"))
    md = md.withColumn("md", F.regexp_replace("md", r"\$\$\nx=1 \$\$", "one\n\\$x=1\\$"))
    return O.hints(md).select("book_id", "position", "modality", "locator")


@register("d26_retrieval_queries", f"""{_MD}, q AS (SELECT book_id, 0 AS n, trim('Title ' || book_id) AS q FROM markdown UNION ALL SELECT book_id, n, trim(regexp_replace(trim(line), '^#+', '')) FROM md_lines WHERE trim(line) <> '' AND trim(line) NOT LIKE '!%' AND trim(line) NOT LIKE '|%' AND (trim(line) LIKE '#%' OR (length(trim(line)) <= 40 AND NOT regexp_matches(trim(line), '[。.!?？]$')))),
f AS (SELECT book_id, q, min(n) AS n FROM q WHERE q <> '' GROUP BY ALL) SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY n, q)::INT AS rank, q AS query FROM f QUALIFY rank <= 6""")
def d26(spark, d):
    v = Views(spark, d)
    return O.retrieval_queries(v.markdown, v.markdown.select("book_id", F.concat(F.lit("Title "), "book_id").alias("title")))


@register("d27_excerpts", "SELECT doc_id, CASE WHEN length(f) > 100 THEN rtrim(substr(f, 1, 100)) || '...' ELSE f END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def d27(spark, d):
    return Views(spark, d).table("documents").select("doc_id", X.excerpt("text", 100).alias("excerpt"))


_NORM = "regexp_replace({}, '[\\s\\p{{P}}\\p{{S}}]+', '', 'g')"


@register("d28_evidence_match", f"""WITH b AS (SELECT conv_id AS book_id, turn AS page_index, conv_id || ':' || turn AS block_id, lower({_NORM.format('text')}) AS c, 'P/' || turn || '.PNG' AS img FROM conversations),
e AS (SELECT conv_id AS book_id, 'e' || turn AS id, CASE turn % 3 WHEN 0 THEN lower({_NORM.format('text')}) WHEN 1 THEN 'more' || lower({_NORM.format('text')}) ELSE lower({_NORM.format('reverse(text)')}) END AS q, CASE WHEN turn % 5 = 4 THEN turn || '.png' ELSE '' END AS asset, turn % 2 + 1 AS page_start FROM conversations),
s AS (SELECT e.book_id, id, page_index, block_id, CASE WHEN asset <> '' AND asset = lower(split_part(img, '/', 2)) THEN 1.0 WHEN length(q) >= 6 AND length(c) >= 4 AND (contains(c, q) OR contains(q, c)) THEN least(0.99, least(length(q), length(c)) / greatest(length(q), length(c)) + 0.5)
  WHEN length(q) >= 12 AND length(c) >= 4 AND contains(c, substr(q, 1, 64)) THEN 0.72 WHEN page_start - 1 = page_index THEN 0.35 ELSE 0 END::DOUBLE AS s FROM e JOIN b USING (book_id)),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY book_id, id ORDER BY s DESC, page_index, block_id) = 1)
SELECT book_id, id, round(s, 2) AS confidence, CASE WHEN s = 1 THEN 'asset' WHEN s > 0.35 THEN 'text' WHEN s = 0.35 THEN 'page' ELSE 'none' END AS kind, CASE WHEN s > 0 THEN page_index END AS page_index, CASE WHEN s > 0.35 THEN block_id END AS block_id FROM m""")
def d28(spark, d):
    c = Views(spark, d).table("conversations")
    b = c.selectExpr("conv_id AS book_id", "turn AS page_index", "concat(conv_id, ':', turn) AS block_id", "text", "concat('P/', turn, '.PNG') AS image_path")
    e = c.selectExpr("conv_id AS book_id", "concat('e', turn) AS id", "case turn % 3 when 0 then text when 1 then concat('More ', text) else reverse(text) end AS excerpt", "if(turn % 5 = 4, concat('x/', turn, '.png'), '') AS asset", "turn % 2 + 1 AS page_start")
    return O.match_evidence(b, e)


@register("d29_tree_rows", """SELECT 'r' || r_regionkey AS path, r_name AS title, r_name AS title_path, '1' AS order_path, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::INT AS n_children FROM region UNION ALL
SELECT 'r' || n_regionkey, n_name, r_name || ' / ' || n_name, '1.' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 0 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def d29(spark, d):
    t = Views(spark, d).table
    kids = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("title")))).alias("child_nodes"))
    b = t("region").join(kids, "r_regionkey").select(F.concat(F.lit("r"), "r_regionkey").alias("path"), F.to_json(F.array(F.struct(F.col("r_name").alias("title"), "child_nodes"))).alias("tree_json"))
    return O.tree_rows(b)


@register("d32_mapped_headings", f"{_MD} SELECT book_id, line + 1 AS scan_line, line FROM headings")
def d32(spark, d):
    h = Views(spark, d).headings
    return O.map_headings(h.withColumn("line", F.col("line") + 1).withColumn("text", F.concat(F.lit("**"), "text", F.lit(" **"))), h)


@register("d33_outline_source", f"{_MD} SELECT book_id, CASE WHEN book_id % 5 = 0 THEN 'enrich' WHEN book_id IN (SELECT book_id FROM headings WHERE level = 2) THEN 'markdown' ELSE 'none' END AS source FROM markdown")
def d33(spark, d):
    v = Views(spark, d)
    books = v.markdown.select("book_id")
    return O.outline_source(books, books.where("book_id % 5 = 0"), v.headings.where("level = 2"))


@register("d35_lessons", f"""{_MD}, h AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY line) AS k FROM headings WHERE level <= 2 QUALIFY k <= 20), n AS (SELECT book_id, max(n) AS last FROM md_lines GROUP BY 1)
SELECT book_id, line AS md_start, greatest(line, coalesce(lead(line) OVER (PARTITION BY book_id ORDER BY line), last + 1) - 1)::INT AS md_end, text AS title FROM h JOIN n USING (book_id)""")
def d35(spark, d):
    return O.lessons(Views(spark, d).markdown).select("book_id", "md_start", "md_end", "title")


@register("d36_book_titles", f"""{_MD}, l AS (SELECT book_id, n, trim(regexp_replace(regexp_replace(regexp_replace(trim(line), '^#{{1,6}}\\s+', ''), '[A-Z]{{2,}}(?:\\s+[A-Z]{{2,}})*', '', 'g'), '\\s+', ' ', 'g')) AS t FROM md_lines WHERE n < 91),
f AS (SELECT book_id, t, min(n) AS n FROM l WHERE t <> '' AND length(t) <= 32 AND regexp_matches(t, '[éèàêç]') GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n) AS k FROM f QUALIFY k <= 4)
SELECT m.book_id, coalesce(string_agg(t, ' ' ORDER BY k), m.book_id::VARCHAR) AS title FROM markdown m LEFT JOIN k USING (book_id) GROUP BY m.book_id""")
def d36(spark, d):
    return O.book_titles(Views(spark, d).markdown, keep="[éèàêç]")


@register("d37_heading_paths", f"""{_MD}, a AS (SELECT book_id, n AS line FROM md_lines WHERE contains(line, '&amp;')), p AS (SELECT a.*, (SELECT max(h.line) FROM headings h WHERE h.book_id = a.book_id AND level = 1 AND h.line <= a.line) AS l1, (SELECT max(h.line) FROM headings h WHERE h.book_id = a.book_id AND level = 2 AND h.line <= a.line) AS l2 FROM a)
SELECT p.book_id, p.line, concat_ws(' > ', x.text, CASE WHEN l2 > coalesce(l1, 0) THEN y.text END) AS path FROM p LEFT JOIN headings x ON x.book_id = p.book_id AND x.line = l1 LEFT JOIN headings y ON y.book_id = p.book_id AND y.line = l2""")
def d37(spark, d):
    v = Views(spark, d)
    at = O.lines(v.markdown).where("contains(text, '&amp;')").select("book_id", "line")
    return O.heading_paths(v.markdown, at).select("book_id", "line", "path")


@register("d38_image_paths", "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'own.png' WHEN 1 THEN 'img/' || doc_id || '.png' WHEN 2 THEN 'a/b.jpg' END AS image_path FROM documents")
def d38(spark, d):
    e = Views(spark, d).table("documents").selectExpr("doc_id AS id", "if(doc_id % 4 = 0, 'own.png', ' ') AS path", "if(doc_id % 4 = 1, concat('see ![x](img/', doc_id, '.png)'), '') AS locator", "if(doc_id % 4 = 2, 'file a/b.jpg here', 'none') AS excerpt")
    return O.image_paths(e).select("id", "image_path")


@register("d39_filtered_tree", f"""{_ITEMS}, hit AS (SELECT id FROM items WHERE contains(lower(title), 'the')), u AS (SELECT id FROM hit UNION SELECT i.parent_id FROM u JOIN items i ON i.id = u.id WHERE i.parent_id IS NOT NULL) SELECT id FROM u""")
def d39(spark, d):
    return O.filter_tree(_items(Views(spark, d)), "The").select("id")


@register("d40_page_windows", "SELECT c_custkey, greatest(c_custkey % 9 - 2, 0) AS first, least(c_custkey % 9 + 2, 9) AS last FROM customer")
def d40(spark, d):
    w = O.page_window(F.col("c_custkey") % 9, F.lit(10).cast("long"))
    return Views(spark, d).table("customer").select("c_custkey", F.array_min(w).alias("first"), F.array_max(w).alias("last"))


@register("d40_nearest_page", "SELECT conv_id AS book_id, arg_min(turn, (abs(turn * 100 + 50 - 260), turn)) AS page FROM conversations GROUP BY 1")
def d40b(spark, d):
    p = Views(spark, d).table("conversations").selectExpr("conv_id AS book_id", "turn AS page", "turn * 100 AS top", "turn * 100 + 100 AS bottom")
    return O.nearest_page(p, 260.0)
