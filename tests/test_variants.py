import json

from pyspark.sql import functions as F

from quern.functions import variants as V

ROWS = [
    ('{"a":1,"classifications":{"subkinds":[" x ","y","x",null],"other":true}}', "Physical Law"), ('{"classifications":"bad","k":[1,{"b":2.5}]}', "物理定律"),
    ("[1]", "definition"), ("oops", "???"), (None, None), ("{}", " "), ('{"classifications":{"raw_subkinds":"no array","subkinds":["physical_law"]}}', "physical_law"),
]


def unique(*lists):
    return list(dict.fromkeys(x.strip() for xs in lists for x in xs if x and x.strip()))


def plain(text, codes, raw):
    try:
        v = json.loads(text or "null")
    except ValueError:
        v = None
    v = v if isinstance(v, dict) else {}
    inner = v.get("classifications") if isinstance(v.get("classifications"), dict) else {}
    held = lambda k: inner[k] if isinstance(inner.get(k), list) else []
    codes, raw = unique(held("subkinds"), codes), unique(held("raw_subkinds"), raw)
    if not codes and not raw:
        return v
    return v | {"classifications": inner | ({"subkinds": codes} if codes else {}) | ({"raw_subkinds": raw} if raw else {})}


def test_classifications(spark):
    df = spark.createDataFrame(ROWS, "p string, s string")
    code = {"Physical Law": "physical_law", "物理定律": "physical_law", "definition": "definition", "physical_law": "physical_law"}
    for r in df.select("p", "s", V.add_classification("p", "s").alias("one"), V.merge_classifications("p", F.array("s", F.lit("wave kind"), F.lit(None).cast("string")), F.array(F.lit(" label "))).alias("many")).collect():
        own = [code[r.s]] if r.s in code else []
        label = [r.s] if (r.s or "").strip() and own != [r.s] else []
        assert json.loads(r.one) == plain(r.p, own, label)
        assert json.loads(r.many) == plain(r.p, [*own, "wave_kind"], ["label"])


def test_set_contain_each_gather(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":[1,2],"c":null}'), (2, '{"a":2}'), (3, "bad"), (4, None), (5, "[]")], "id int, j string").withColumn("v", V.parse("j"))
    put = {r.id: json.loads(r.x) for r in df.select("id", V.text_of(V.put(F.col("v"), a=F.parse_json(F.lit("7")), z=F.parse_json(F.lit('{"q":[]}')), n=F.lit(None).cast("variant"))).alias("x")).collect()}
    assert put == {1: {"a": 7, "b": [1, 2], "c": None, "z": {"q": []}}, 2: {"a": 7, "z": {"q": []}}, **{i: {"a": 7, "z": {"q": []}} for i in (3, 4, 5)}}
    has = {r.id: (r.x, r.y, r.e) for r in df.select("id", V.contains(F.col("v"), F.parse_json(F.lit('{"b":[1,2]}'))).alias("x"), V.contains(F.col("v"), F.parse_json(F.lit('{"a":1,"b":[1,2]}'))).alias("y"), V.contains(F.col("v"), F.parse_json(F.lit("{}"))).alias("e")).collect()}
    assert has == {1: (True, True, True), **{i: (False, False, True) for i in (2, 3, 4, 5)}}
    rows = V.each(df.select("id", "v"), "v")
    assert sorted((r.id, r.key, r.x) for r in rows.select("id", "key", F.to_json("value").alias("x")).collect()) == [(1, "a", "1"), (1, "b", "[1,2]"), (1, "c", "null"), (2, "a", "2")]
    back = {r.k: json.loads(r.x) for r in V.gather(rows.withColumn("k", F.lit(0)), "k", "key", "value", "id").select("k", F.to_json("object").alias("x")).collect()}
    assert back == {0: {"a": 2, "b": [1, 2], "c": None}}
