import re

from corpus_pipeline import STAGES, run
from quern.llm import decontaminate as D
from quern.llm import langid, secret_scan
from quern.llm.vocab import ByteIds, read_tokenizer

SF = "/root/testdata/sf0.001"


def brute_groups(texts):
    """The smallest id that each text reaches by pairs whose sets of five-word shingles are alike by 0.8 or more."""
    sets, root = {}, {i: i for i in texts}
    for i, text in texts.items():
        words = text.lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return root


def test_stages_against_brute_force(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [D.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    at, kept = docs, set(rows)
    for name, stage in STAGES:
        out = stage(spark, at, SF)
        if name == "best_fit_packing":
            break
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            scorer = langid.Scorer(langid.fit(at))
            want = {i for i in kept if scorer.predict(rows[i].text)[0] != "und" and scorer.predict(rows[i].text)[1] >= langid.LEAST}
            assert len(want) > 0.95 * len(kept)
        elif name == "simhash_dedup":
            root = brute_groups({i: rows[i].text for i in kept})
            want = {i for i in kept if root[i] == i}
            assert len(want) < len(kept)
        elif name == "decontaminate":
            want = {i for i in kept if not any(b in D.normal(rows[i].text) for b in bench)}
            assert len(want) < len(kept)
        else:
            want = kept
            assert {i: r.text for i, r in got.items()} == {i: secret_scan.redact_text(rows[i].text) for i in kept}
            assert all(r.n_chars == len(r.text) for r in got.values()) and not any(re.search("[0-9a-f]{24}", r.text) for r in got.values())
        assert set(got) == want, name
        at, kept = out, want
    ids = ByteIds(read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), None)
    n = {r.doc_id: len(ids.ids(r.text)) // 4 + 1 for r in at.collect()}
    pieces = out.collect()
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == n
    fill = {}
    for r in pieces:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= sum(n.values()) / 1024 * 1.02 + 3
    assert run(spark, SF).count() == len(pieces)


ODD = "doc_id long, text string, lang string, source string, n_chars long, quern_fp long, fp string, component_id int, spans string, piece int, length string, key int"


def odd_rows():
    words = "the quick brown fox jumps over the lazy dog and then it sleeps under the old tree near the river".split()
    text = " ".join(words * 3)
    base = [(i, f"{text} {words[i % 7]} {words[i % 5]}" + " tail" * i, "en", "s", 1) for i in range(12)]
    base += [(20, None, None, None, None), (21, "", "en", None, 0), (22, "1234 !!", None, "s", 1), (None, text, "en", "s", 1), (None, text, "en", "s", 1), (3, base[3][1], "en", "s", 1), (3, base[3][1], "en", "s", 1)]
    base += [(30, "word " * 60000, "en", "s", 300000), (31, f'{text} password = "hunter2secret99"', "en", "s", 1), (3, "another text with the same id that says quite other things about boats and sails", "en", "s", 1)]
    return [(*r, 7, "f", 1, "x", 2, "l", 3) for r in base]


def test_stages_on_odd_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    at = docs
    for name, stage in STAGES:
        out = stage(spark, at, SF)
        got = out.collect()
        if name == "best_fit_packing":
            assert {r.doc_id for r in got} == {r.doc_id for r in at.collect()} and all(0 <= r.offset and r.offset + r.length <= 1024 for r in got)
            break
        assert out.columns == docs.columns, name
        ids = sorted((r.doc_id for r in got if r.doc_id is not None))
        if name == "language_id":
            assert not {20, 21, 22} & set(ids) and ids.count(3) == 4 and sum(r.doc_id is None for r in got) == 2
        if name == "simhash_dedup":
            assert sum(r.doc_id is None for r in got) == 2 and any("boats" in r.text for r in got)
            assert len({r.text for r in got if r.doc_id is not None}) == len(ids)
        if name == "secret_scan":
            assert not any("hunter2" in r.text for r in got) and all(r.n_chars == len(r.text) for r in got)
        at = spark.createDataFrame([tuple(r) for r in got], docs.schema)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, ODD).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"] and out.count() == 0


def test_no_learned_language_keeps_texts(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == [] and [r.doc_id for r in langid.keep_identified(docs, model).collect()] == [1]
