"""Image recovery: the markdown of every page, with an image before each second-level heading; every line gives an evidence row."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import images as I
from quern.operators import outline as O
from quern.plans.catalog import register
from quern.sources.views import Views, ctes


@register("d38_recovered_images", f"""{ctes('markdown')}, md AS (SELECT book_id, replace(md, chr(10) || '## ', chr(10) || '![](img/p' || book_id || '.png)' || chr(10) || '## ') AS md FROM markdown),
ls AS (SELECT book_id, unnest(string_split(md, chr(10))) AS raw, generate_subscripts(string_split(md, chr(10)), 1)::INT AS line FROM md),
c AS (SELECT *, CASE WHEN raw LIKE '![](%' THEN '[图片：p' || book_id || '.png]' ELSE trim(regexp_replace(regexp_replace(raw, '^#{{1,6}}\\s+', ''), '\\s+', ' ', 'g')) END AS clean, raw LIKE '![](%' AS image FROM ls),
e AS (SELECT book_id, line, clean, image, CASE WHEN image THEN 'img/p' || book_id || '.png' WHEN line % 3 = 0 THEN 'fig-' || line || '.png' ELSE '' END AS raw_path FROM c),
texts AS (SELECT book_id, clean, min(line) AS line FROM (SELECT x.book_id, x.clean, y.line FROM (SELECT DISTINCT book_id, clean FROM c WHERE length(clean) >= 8) x JOIN c y ON y.book_id = x.book_id AND contains(y.clean, x.clean)) GROUP BY ALL),
s AS (SELECT e.*, CASE WHEN image THEN (SELECT min(line) FROM c WHERE c.book_id = e.book_id AND c.image) ELSE coalesce(t.line, e.line) END AS source_line FROM e LEFT JOIN texts t ON t.book_id = e.book_id AND t.clean = e.clean),
n AS (SELECT book_id, line, max(CASE WHEN image THEN line END) OVER (PARTITION BY book_id ORDER BY line) AS b, min(CASE WHEN image THEN line END) OVER (PARTITION BY book_id ORDER BY line DESC) AS a FROM c)
SELECT s.book_id, s.line, s.raw_path, s.source_line, CASE WHEN s.source_line - n.b <= 16 OR n.a - s.source_line <= 16 THEN 'img/p' || s.book_id || '.png' END AS image_path FROM s JOIN n ON n.book_id = s.book_id AND n.line = s.source_line""")
def d38_recovered(spark, d):
    md = Views(spark, d).markdown.withColumn("md", F.expr("replace(md, '\n## ', concat('\n![](img/p', book_id, '.png)\n## '))"))
    rows = O.lines(md).selectExpr("book_id", "cast(line AS string) AS id", "line", "if(line % 3 = 0 AND text NOT LIKE '![](%', concat('fig-', line, '.png'), '') AS path", "concat('line:', line) AS locator", "text AS excerpt")
    none = md.select("book_id", F.lit("").alias("path")).where("path <> ''")
    return I.recover_images(rows, md, none).select("book_id", "line", "raw_path", "source_line", "image_path")
