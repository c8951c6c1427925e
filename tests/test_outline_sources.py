"""Known answers for document structuring, sources, lineage and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import lineage as L
from quern.operators import outline as O
from quern.sources import tables as T


def leaf(i, start, end, kind="lesson", title="t"):
    return O.Leaf(i, kind, title, start, end, O.role_of(title), "t", "c")


def test_small_lessons_merge():
    g = O.group_small([leaf("a", 1, 50), leaf("b", 51, 60, "activity"), leaf("c", 61, 120), leaf("d", 121, 400), leaf("e", 401, 410, "activity"), leaf("f", 411, 800), leaf("g", 801, 810, "activity")], 150, 300)
    assert [[x.id for x in m] for m in g] == [["a", "b", "c"], ["d", "e"], ["f"], ["g"]]
    g = O.group_small([leaf("a", 1, 50), leaf("b", 51, 60, title="练习"), leaf("c", 61, 70, title="练习")], 150, 300)
    assert [[x.id for x in m] for m in g] == [["a"], ["b", "c"]]


def test_large_lessons_split_at_headings():
    heads = [(100, "one"), (200, "two"), (300, "three"), (395, "tiny")]
    c = O.split_large(leaf("a", 1, 400), heads, 250, 300)
    assert [(x.start, x.end) for x in c] == [(1, 299), (300, 400)] and all(x.sources == ["a"] for x in c)
    c = O.split_large(leaf("a", 1, 250), [(200, "本章小结")], 250, 300)
    assert [(x.start, x.end, x.role) for x in c] == [(1, 199, "knowledge"), (200, 250, "summary")]
    assert len(O.split_large(leaf("a", 1, 900), [], 250, 300)) == 1


def test_plan_covers_all_leaves_once():
    leaves = [leaf(str(i), 1 + 70 * i, 70 * (i + 1)) for i in range(9)] + [leaf("x", 640, 1400), leaf("ex", 1401, 1500, title="参考文献")]
    plan = O.plan_book(leaves, [(700 + 90 * i, f"h{i}") for i in range(7)])
    named = {s for c in plan for s in c.sources}
    assert named == {x.id for x in leaves} - {"ex"}
    assert [c.start for c in plan] == sorted(c.start for c in plan) and plan[-1].end == 1400


def test_heading_match_and_alignment():
    assert O.heading_match("速度", "", 2, "速度", 2) == (0.99, "exact")
    assert O.heading_match("1.2 速度和加速度", "", 2, "1.2 速度与加速度", 2)[1] == "number_and_title"
    assert O.heading_match("1.2 速度", "", 2, "3.4 力学", 2) is None
    assert O.heading_match("匀速直线运动", "", 2, "匀速直线运动规律", 2)[1] == "containment"
    items = [{"id": "a", "title": "力", "level": 1}, {"id": "b", "title": "速度", "level": 1}, {"id": "c", "title": "加速度", "level": 1}]
    heads = [{"line": 1, "text": "速度", "level": 1}, {"line": 5, "text": "力", "level": 1}, {"line": 9, "text": "加速度", "level": 1}]
    assert [(r[0], r[1]) for r in O.align(items, heads)] in ([("b", 1), ("c", 9)], [("a", 5), ("c", 9)])


def test_edit_distance_equals_the_table():
    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert O._edit(a, b) == row[-1]


def test_evidence_hints(spark):
    text = "| a | b |\n|---|---|\n| 1 | 2 |\n\n$$\nx = 1\n$$\ninline $y$ here\n![alt](p.png)\n| lone |\nend\n$$ z $$\n$$\nopen"
    got = [(h.modality, h.locator) for h in O.hints(spark.createDataFrame([(1, text)], "book_id long, md string")).orderBy("position").collect()]
    assert got == [("table", "markdown-table-1"), ("equation", "line:7"), ("equation", "line:8"), ("image", "line:9"), ("equation", "line:12"), ("equation", "markdown-equation-unclosed")]


def test_chinese_numbers_and_toc(spark):
    df = spark.createDataFrame([("十",), ("十二",), ("二十",), ("三十五",), ("7",), ("两",), ("百",)], "s string")
    assert [r.n for r in df.select(O.chinese_number("s").alias("n")).collect()] == [10, 12, 20, 35, 7, 2, None]
    toc = spark.createDataFrame([(1, 1, "目 录"), (1, 2, "第一章 运动 ...... 3"), (1, 3, "第2节 速度……9"), (1, 4, "1.3 Speed --- 12"), (1, 5, "本章小结 / 20"), (1, 6, "42")], "book_id long, line int, text string")
    got = [(r.kind, r.order_path, r.title, r.page) for r in O.toc_entries(toc).orderBy("line").collect()]
    assert got == [("theme", "1", "运动", 3), ("lesson", "1.2", "速度", 9), ("lesson", "1.3", "Speed", 12), ("boundary", "1", "本章小结", 20)]


def test_tree_helpers(spark):
    tree = json.dumps([{"title": "A", "child_nodes": [{"title": "B"}, {"title": "C", "child_nodes": [{"title": "D"}]}]}])
    assert O.flatten_tree(tree) == [("A", "A", "1", 2), ("B", "A / B", "1.1", 0), ("C", "A / C", "1.2", 1), ("D", "A / C / D", "1.2.1", 0)] and O.flatten_tree(None) == []
    md = spark.createDataFrame([(1, "# 1.1 Alpha\ntext\n![x](y)\n## Sub\nmore\n# 1.2 Beta\nlast"), (2, "# One\na\n## Two\nb"), (3, "no heading")], "book_id long, md string")
    got = sorted((r.book_id, r.md_start, r.md_end, r.preview) for r in O.lessons(md).collect())
    assert got == [(1, 1, 5, "1.1 Alpha text Sub more"), (1, 6, 7, "1.2 Beta last"), (2, 1, 2, "One a"), (2, 3, 4, "Two b")]


def test_content_lists(spark, tmp_path):
    (tmp_path / "a_v2.json").write_text(json.dumps([[{"type": "title", "text": "T", "text_level": 9, "bbox": [-5, 0, 2000, 10]}, {"type": "image", "img_path": "i.png", "caption": "c"}], [{"type": "text", "content": "body", "bbox": [1]}]]))
    (tmp_path / "b.json").write_text(json.dumps([{"text": "x", "page_idx": 3}, {"latex": "y"}]))
    two = T.content_blocks(spark, str(tmp_path / "a_v2.json"), 2)
    rows = [(r.page_index, r.order_index, r.text, r.level, r.bbox) for r in two.orderBy("page_index", "order_index").collect()]
    assert rows == [(0, 0, "T", 6, [0.0, 0.0, 1000.0, 10.0]), (0, 1, "c", None, None), (1, 0, "body", None, None)]
    assert T.blocks_markdown(two).first().md == "###### T\n\n![c](i.png)\n\nbody"
    assert [(r.page_index, r.text) for r in T.content_blocks(spark, str(tmp_path / "b.json"), 1).orderBy("order_index").collect()] == [(3, "x"), (0, "y")]


def test_guards_and_pairs(spark):
    assert T.safe_member("a/b.png") and not any(T.safe_member(x) for x in ("../x", "/etc/x", "C:\\x", "a/../../b", "", "a\\..\\b"))
    f = spark.createDataFrame([("d/Book.pdf", 5), ("d/book_content_list_v2.json", 7), ("d/other.pdf", 1)], "path string, length long")
    assert sorted((r.pdf, r.bundle) for r in T.pair_bundles(f).collect()) == [("d/Book.pdf", "d/book_content_list_v2.json"), ("d/other.pdf", None)]
    with pytest.raises(ValueError):
        T.export_json(f, 10)
    with pytest.raises(ValueError):
        T.update_rows(f, {"path": "x"}, {"path": "y"}, ["path", "length"])


def test_partition_replacement_and_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    T.replace_partition(spark.createDataFrame([("d1", 1), ("d2", 2)], "dataset_id string, v int"), path, "dataset_id")
    T.replace_partition(spark.createDataFrame([("d2", 9)], "dataset_id string, v int"), path, "dataset_id")
    assert sorted((r.dataset_id, r.v) for r in spark.read.parquet(path).collect()) == [("d1", 1), ("d2", 9)]
    scan = T.scan(spark, path, "d1", ["v"])
    assert [r.v for r in scan.collect()] == [1] and "PartitionFilters: [isnotnull(dataset_id" in scan._jdf.queryExecution().executedPlan().toString()


def test_imports_metadata_datasets(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"book_id": "b",\n "items": [1, 2]}')
    r = T.import_assets(spark, str(tmp_path / "o.json"), "book_id string, items array<int>").first()
    assert (r.book_id, r.items, r.file) == ("b", [1, 2], "o.json")
    d = spark.createDataFrame([("1", "x", False), ("2", "x", True)], "id string, name string, is_active boolean")
    assert T.resolve_dataset(d, "x").first().id == "2" and T.lookup(d, id="1").first().name == "x"
    m = T.table_metadata(spark, {"d": d}, {"d": ["id"]}).collect()
    assert [(r.column, r.type, r.is_key) for r in m] == [("id", "string", True), ("name", "string", False), ("is_active", "boolean", False)]
    assert T.artifact_bundle(d, d, d).first().asDict() == {"nodes": 2, "edges": 2, "profiles": 2}
    assert T.outline_catalogue(d.selectExpr("'b' AS book", "'chunk' AS kind", "id"), F.col("id")).first().asDict() == {"book": "b", "n_items": 2, "n_chunks": 2, "updated_at": "2"}
    assert L.stages_to_run(["a", "b", "c"], "b") == ["b", "c"] and L.stages_to_run(["a", "b", "c"], only=["c", "a"]) == ["a", "c"]


def test_stream_equals_batch(spark, tmp_path):
    from quern.streaming import progress as P

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    q = P.run_to_table(P.latest_states(P.read_events(spark, str(tmp_path / "e"), e.schema)), "latest_states", "complete", str(tmp_path / "c1"))
    q.awaitTermination()
    got = {r.user_id: (r.event_type, r.n) for r in spark.table("latest_states").collect()}
    want = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"), F.count("*").alias("n")).collect()
    assert got == {r.user_id: (r.m.event_type, r.n) for r in want}
    q = P.run_to_table(P.windowed_counts(P.read_events(spark, str(tmp_path / "e"), e.schema)), "windowed", "complete", str(tmp_path / "c2"))
    q.awaitTermination()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == e.count()


def lengths(texts):
    if any(t == "boom" for t in texts):
        raise ConnectionError("service down")
    return [[float(len(t)), 1.0, 2.0] for t in texts]


def test_embedding_service():
    from quern.sources import services as V

    assert V.embed_batch(["ab", " ", "c"], lengths, 2) == [[2.0, 1.0], [], [1.0, 1.0]]
    assert V.embed_batch(["boom", "x"], lengths, 2, wait=0.01) == [[], []] and V.embed_batch(["x"], lengths, 9) == [[]]


def test_embedding_frame_archives_and_publishing(spark, tmp_path):
    import io
    import zipfile

    from quern.sources import services as V

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, t string")
    got = {r.id: r.embedding for r in V.embed(df, "t", lambda ts: [[float(len(t)), 0.0] for t in ts], dimensions=2).collect()}
    assert got == {1: [3.0, 0.0], 2: [], 3: []}

    def archive(*names):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n in names:
                z.writestr(n, n)
        return b.getvalue()

    ok = spark.createDataFrame([("a.zip", archive("x/1.md", "2.png"))], "path string, content binary")
    assert sorted((r.member, bytes(r.content)) for r in V.archive_members(ok).collect()) == [("2.png", b"2.png"), ("x/1.md", b"x/1.md")]
    with pytest.raises(Exception, match="unsafe"):
        V.archive_members(spark.createDataFrame([("b.zip", archive("../evil"))], "path string, content binary")).collect()
    root = str(tmp_path / "pub")
    V.publish(df, root, "nodes")
    assert V.published(spark, root, "nodes").count() == 3
    V.publish(df.limit(1), root, "nodes")
    assert V.published(spark, root, "nodes").count() == 1
