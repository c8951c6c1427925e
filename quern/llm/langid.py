"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in every language. An unseen word falls back to its character
n-grams, with ``^`` and ``$`` at its ends: those of five characters if the model knows any, else of four, and so on to
single characters; known n-grams of that length are averaged. A text's scores are summed over all its words; its language
is the one with the highest sum, its score that language's share after a softmax.

The model is fitted on a bounded sample: about ``SAMPLE`` documents of each language, chosen by a hash of the id, and
keeps at most ``ENTRIES`` words in all and ``GRAMS`` n-grams of each length and language, so it can be broadcast. All
languages are kept: where they are many, each keeps fewer entries, so that no table has over ``CELLS`` cells (down to one entry
each, at about 4,400 languages; beyond, tables grow with the square of the languages).
Everything else covers all documents: every whole text is scored, in one map without a shuffle. Runs of more than
``LONGEST`` letters, as in scripts without spaces, are no entries of the word table; they are fitted and scored by the
n-grams of the whole run.

Defined results: a text that is null or has no letter, or any text if no language was learned, gives ``und`` with score 0.
Words without a known part score nothing. Ties go to the language that sorts first. A null doc_id is never learned from
and counts as not held out. Repeated rows are scored row by row; an empty table gives an empty result. ``identify``
reads only the id and the text; ``keep_identified`` keeps all columns.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import arrow_map, limit_batches, worker_state

#: Documents of a language to learn from; words kept in all; n-grams kept per length and language; cells of a table (rows x languages).
SAMPLE, ENTRIES, GRAMS, CELLS = 3000, 100_000, 10_000, 20_000_000
ORDERS = (5, 4, 3, 2, 1)
WORD = re.compile(r"[^\W\d_]+")
LONGEST, SPACE, CHUNK = 40, 60_000, 1 << 13
LEAST = 0.5


def learnable() -> F.Column:
    """Rows to learn from: crc32 of the id's text is not 2 modulo 4."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2


def grams_of(word: str, k: int, start: int = 0, stop: int | None = None):
    """The n-grams of length k of a word, ``^`` and ``$`` at its ends except for single characters."""
    padded = word if k == 1 else f"^{word}$"
    last = len(padded) - k + 1
    return (padded[i : i + k] for i in range(start, last if stop is None else min(stop, last)))


def entries_of(langs: int) -> int:
    """Words (and n-grams of a length) kept of each language: fewer, the more languages there are, but all languages stay."""
    return max(1, min(ENTRIES // max(langs, 1), CELLS // max(langs * langs, 1)))


def word_counts(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[tuple[str, str, int]], list[tuple[str, str, int]]]:
    """(languages, rows of language, word, count of the sample, the same of n-grams of words over ``LONGEST``); all bounded.

    A word over ``LONGEST`` letters is a run without spaces: it gives all its n-grams and no entry in the table of words.
    """
    limit_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable())
    sizes = {r["lang"]: r["size"] for r in rows.groupBy("lang").agg(F.count("*").alias("size")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], [], []
    counted = docs.sparkSession.createDataFrame([*sizes.items()], "lang string, size long")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(counted), "lang").where(draw < F.lit(float(sample)) / F.col("size")).select("lang", "text")

    def flushed(held: dict):
        flat = [(lang, k, w, n) for (lang, k), c in held.items() for w, n in c.items()]
        held.clear()
        for i in range(0, len(flat), 50_000):
            langs, ks, words, ns = zip(*flat[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ks, pa.int32()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["lang", "k", "word", "n"])

    def count(batches):
        held: dict[tuple[str, int], Counter] = {}  # k is 0 for words
        runs: dict[tuple[str, int], Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = WORD.findall(text.as_py().lower())
                held.setdefault((lang, 0), Counter()).update(w for w in words if len(w) <= LONGEST)
                for w in words:
                    if len(w) <= LONGEST:
                        continue
                    for k in ORDERS:
                        for i in range(0, len(w) + 2, SPACE):
                            runs.setdefault((lang, k), Counter()).update(grams_of(w, k, i, i + SPACE))
                            if sum(map(len, runs.values())) > 4 * SPACE:
                                yield from flushed(runs)
        yield from flushed(held)
        yield from flushed(runs)

    counts = chosen.mapInArrow(count, "lang string, k int, word string, n long").groupBy("lang", "k", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "k").orderBy(F.desc("n"), "word"))
    most = entries_of(len(langs))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("k") == 0, most).otherwise(min(GRAMS, most)))
    got = top.select("lang", "k", "word", "n").toArrow()
    flat = list(zip(*(got.column(c).to_pylist() for c in ("lang", "k", "word", "n")), strict=True))
    return langs, [(lang, w, n) for lang, k, w, n in flat if k == 0], [(lang, w, n) for lang, k, w, n in flat if k]


class Model:
    """Log frequencies of words and n-grams per language."""

    def __init__(self, langs: list[str], counts: list[tuple[str, str, int]], runs: list[tuple[str, str, int]] = (), grams: int = GRAMS):
        self.langs, grams = langs, min(grams, entries_of(len(langs)))
        at = {x: i for i, x in enumerate(langs)}
        self.words, self.word_table = self.table(((at[lang], w, n) for lang, w, n in counts))
        parts = {k: Counter() for k in ORDERS}
        for lang, w, n in counts:
            for k in ORDERS:
                c = parts[k]
                for g in grams_of(w, k):
                    c[at[lang], g] += n
        for lang, g, n in runs:
            parts[len(g)][at[lang], g] += n
        self.grams = {}
        for k in ORDERS:
            rows, kept = Counter(), []
            for (lang, g), n in sorted(parts[k].items(), key=lambda x: (-x[1], x[0])):
                if rows[lang] < grams:
                    rows[lang] += 1
                    kept.append((lang, g, n))
            self.grams[k] = self.table(kept)

    def table(self, rows) -> tuple[dict[str, int], np.ndarray]:
        index: dict[str, int] = {}
        cells = [(index.setdefault(w, len(index)), lang, n) for lang, w, n in rows]
        m = np.zeros((len(index), len(self.langs)), np.float64)
        for i, lang, n in cells:
            m[i, lang] += n
        return index, np.log((m + 0.5) / (m.sum(axis=0) + 0.5 * max(len(index), 1))).astype(np.float32)

    def unseen(self, word: str) -> np.ndarray | None:
        for k in ORDERS:
            index, table = self.grams[k]
            known = [index[g] for g in set(grams_of(word, k)) if g in index]
            if known:
                return table[known].mean(axis=0)
        return None


class Scorer(dict):
    """word -> row of ``table``; rows after the known words hold unseen ones until the space is full."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.known = model, len(model.words)
        space = max(2 * CHUNK, min(SPACE, CELLS // max(len(model.langs), 1)))
        self.table = np.zeros((self.known + 1 + space, max(len(model.langs), 1)), np.float32)
        if self.known:
            self.table[: self.known] = model.word_table
        self.next = self.known + 1

    def __missing__(self, word: str) -> int:
        got, at = self.model.unseen(word), self.known
        if got is not None:
            at = self.next
            self.table[at] = got
            self.next += 1
        if len(word) <= LONGEST:  # longer ones hardly come again
            self[word] = at
        return at

    def scores(self, text: str) -> np.ndarray | None:
        words = WORD.findall(text.lower())
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return None
        total = np.zeros(len(self.model.langs))
        for i in range(0, len(words), CHUNK):
            if self.next + CHUNK > len(self.table) or len(self) > 2 * SPACE + self.known:
                self.clear()
                self.update(self.model.words)
                self.next = self.known + 1
            part = words[i : i + CHUNK]
            total += self.table[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        total = self.scores(text) if text else None
        if total is None:
            return "und", 0.0
        p = np.exp(total - total.max())
        i = int(np.argmax(total))
        return self.model.langs[i], float(p[i] / p.sum())

    def keeps(self, text: str | None, least: float) -> bool:
        if not self.model.langs:
            return any(c.isalpha() for c in text or "")
        lang, score = self.predict(text)
        return lang != "und" and score >= least


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    return Model(*word_counts(docs.select("doc_id", "text", "lang"), sample))


def _broadcast(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` to doc_id, held_out, lang_pred, score."""
    held = _broadcast(docs, model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        scorer = worker_state(held, Scorer)
        got = [scorer.predict(t.as_py()) for t in b.column(2)]
        langs, scores = zip(*got) if got else ((), ())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "text")
    return arrow_map(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double", 256, stateful=True)


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """``docs`` without those whose language is ``und`` or scores under ``least``.

    If no language was learned there is nothing to compare with: then all texts with a letter stay.
    """
    held, at, names = _broadcast(docs, model), docs.columns.index("text"), list(docs.columns)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        scorer = worker_state(held, Scorer)
        keep = [scorer.keeps(t.as_py(), least) for t in b.column(at)]
        return pa.RecordBatch.from_arrays(b.columns, names).filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, T.StructType(docs.schema.fields), 256, stateful=True)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
