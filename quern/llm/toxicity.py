"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train linear numpy classifiers. The risk of a decision function is estimated
without any negative example: with the class prior pi, the share of toxic documents, it is pi times the loss of the
confirmed documents as toxic, plus the loss of unlabelled text as clean less pi times the loss of the confirmed documents
as clean. The second part estimates the loss over clean text, which cannot be negative; where it falls below zero the
classifier fits the sample, and its steps go up that part instead (the non-negative correction).

A document's features are those of its distinct words (runs of letters, lower-cased): the word and its n-grams of ``ORDERS`` characters,
``<`` and ``>`` at its ends. Of all features those are kept that the confirmed documents have at least ``LIFT`` times as
often as unlabelled text, by ``Z`` standard errors; each counts once a document, so long documents do not add up noise.

The fit reads a bounded sample: the ``POSITIVES`` confirmed documents and about ``UNLABELLED`` documents drawn by a hash of
the id, of near copies (one sketch of word pairs) one each; at most ``FEATURES`` features. The prior is counted over all labels. ``MEMBERS`` classifiers
are trained in as many tasks, each on the confirmed documents and all but one fold of the unlabelled ones; their margins are
averaged. The scoring is one map over all whole texts.

Defined results: null and empty texts have no feature, so they score the classifiers' offset. Without any confirmed document (or
text of one) every score is 0. Labels count row by row in the prior; a document with any label 1 is confirmed. A null doc_id is
never learned from and counts as not held out. Repeated rows are scored row by row; an empty table gives an empty result. Words of
over ``LONGEST`` letters are read in overlapping parts, so no n-gram is lost. Scoring reads only the id and the text.
"""

from __future__ import annotations

import re
import uuid
import zlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, limit_batches, release_state, scratch, worker_state

POSITIVES, UNLABELLED, FEATURES, MEMBERS = 10_000, 40_000, 20_000, 4
ORDERS, LIFT, Z = (3, 4, 5, 6), 2.0, 5.0
STEPS, RATE, RIDGE = 200, 0.05, 1e-4
WORD = re.compile(r"[^\W\d_]+")
LONGEST, ENTRIES = 64, 300_000


def learnable() -> F.Column:
    """Rows to learn from: crc32 of the id's text is not 0 modulo 5."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


# --- features ------------------------------------------------------------------------------------------------------


def words_of(text: str | None) -> list[str]:
    """The words in text order, with their ends marked; long ones in parts that share ``max(ORDERS) - 1`` characters."""
    out, step = [], LONGEST - max(ORDERS) + 1
    for w in WORD.findall((text or "").lower()):
        if len(w) <= LONGEST:
            out.append(f"<{w}>")
        else:
            w = f"<{w}>"
            out += [w[i : i + LONGEST] for i in range(0, len(w) - max(ORDERS) + 1, step)]
    return out


def features_of(word: str) -> set[str]:
    return {word, *(word[i : i + k] for k in ORDERS for i in range(len(word) - k + 1))}


def sketch(words: list[str]) -> int:
    """The least hash of the pairs of neighbouring words: texts alike by their pairs share it as often as they are alike."""
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or words
    return min((zlib.crc32(p.encode()) for p in pairs), default=0)


def draw(salt: str) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def training_sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """positive, fold, words (distinct), of the sample; a confirmed document may be in the unlabelled part too."""
    confirmed = labels.where((F.col("toxic") == 1) & learnable()).select("doc_id").distinct()
    ids = confirmed.orderBy(draw("confirmed"), "doc_id").limit(positives).withColumn("confirmed", F.lit(True))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & learnable())
    share = min(1.0, unlabelled / max(docs.select("doc_id").where(learnable()).count(), 1))
    kinds = F.filter(F.array(F.when(F.col("confirmed"), True), F.when(draw("unlabelled") < share, False)), lambda x: x.isNotNull())
    # At most ``positives`` ids are broadcast, so no text is shuffled.
    chosen = rows.join(F.broadcast(ids), "doc_id", "left").withColumn("kinds", kinds).where(F.size("kinds") > 0)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [words_of(t.as_py()) for t in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(w) for w in found], pa.int64()), pa.array([sorted(set(w)) for w in found], pa.list_(pa.string())), b.column(2)], ["doc_id", "sketch", "words", "kinds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = arrow_map(chosen.select("doc_id", "text", "kinds"), run, f"doc_id {kind}, sketch long, words array<string>, kinds array<boolean>", 256)
    one = sample.select(F.explode("kinds").alias("positive"), "doc_id", "sketch", "words").groupBy("positive", "sketch").agg(F.min_by("words", "doc_id").alias("words"))
    return one.select("positive", F.pmod(F.xxhash64("sketch"), F.lit(MEMBERS)).cast("int").alias("fold"), "words")


def choose_features(sample: DataFrame, positives: int, unlabelled: int, most: int) -> list[str]:
    """The features that confirmed documents have significantly more often; at most ``most``, the surest first."""

    def run(batches):
        release_state()
        held: dict[str, list[int]] = {}

        def flushed():
            keys, values = list(held), list(held.values())
            for i in range(0, len(keys), 50_000):
                u, p = zip(*values[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000], pa.string()), pa.array(u, pa.int64()), pa.array(p, pa.int64())], ["feature", "u", "p"])
            held.clear()

        for b in batches:
            for word, u, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for f in features_of(word):
                    if (c := held.get(f)) is None:
                        held[f] = [u, p]
                    else:
                        c[0] += u
                        c[1] += p
                if len(held) > ENTRIES:
                    yield from flushed()
        yield from flushed()

    words = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(~F.col("positive")).alias("u"), F.count_if("positive").alias("p"))
    counts = words.mapInArrow(run, "feature string, u long, p long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    ratio = F.expr(f"((p + 0.5) / {positives + 1}) / ((u + 0.5) / {unlabelled + 1})")
    z = F.log(ratio) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))
    return [r[0] for r in counts.where((ratio >= LIFT) & (z >= Z)).orderBy(z.desc(), "feature").limit(most).select("feature").collect()]


class Finder:
    """Words to the numbers of the kept features, by one automaton over all of them; no feature crosses words, as none holds ``><``."""

    def __init__(self, features: list[str], weights: np.ndarray | None = None):
        self.weights, self.automaton = weights, ahocorasick.Automaton() if features else None
        for i, f in enumerate(features):
            self.automaton.add_word(f, i)
        if features:
            self.automaton.make_automaton()

    def find(self, words) -> list[int]:
        return sorted({i for _, i in self.automaton.iter("".join(words))}) if self.automaton else []

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return float(sigmoid(self.weights[self.find(set(words_of(text)))].sum() + self.weights[-1]))


# --- the classifiers -----------------------------------------------------------------------------------------------


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk_parts(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk at the margins of confirmed and unlabelled documents: toxic, and clean by subtraction."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def margin_gradients(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The step's gradient by margin: that of the whole risk, or up the clean part where that is below zero."""
    if risk_parts(zp, zu, prior)[1] < 0:
        return prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)
    return np.full(len(zp), -prior / len(zp)), sigmoid(zu) / len(zu)


def train(p: list[np.ndarray], u: list[np.ndarray], size: int, prior: float, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """Weights of ``size`` features and the offset, by Adam over the whole sample. p, u: each document's features."""
    ip, iu = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (p, u))
    rp, ru = (np.repeat(np.arange(len(x)), [len(d) for d in x]) for x in (p, u))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        zp, zu = (w[-1] + np.bincount(r, w[i], minlength=len(x)) for r, i, x in ((rp, ip, p), (ru, iu, u)))
        gp, gu = margin_gradients(zp, zu, prior)
        g = np.bincount(ip, gp[rp], minlength=size + 1) + np.bincount(iu, gu[ru], minlength=size + 1) + ridge * w
        g[-1] = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def class_prior(labels: DataFrame) -> float:
    """The share of label 1 among all labels that may be learned from."""
    share = labels.where(F.col("toxic").isNotNull() & learnable()).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    return min(max(share or 0.0, 1e-4), 0.9)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most: int = FEATURES) -> tuple[list[str], np.ndarray | None]:
    """(features, weights with the offset last; None without any confirmed document). ``prior``: counted if not given."""
    limit_batches(docs.sparkSession)
    prior = class_prior(labels) if prior is None else prior
    sample = scratch(training_sample(docs, labels, positives, unlabelled), "toxicity")
    n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if not n.get(True) or not n.get(False):
        return [], None
    features = choose_features(sample, n[True], n[False], most)
    size = len(features)
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, features))

    def found(b: pa.RecordBatch) -> pa.RecordBatch:
        finder = worker_state(held, Finder)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([finder.find(w.as_py()) for w in b.column(2)], pa.list_(pa.int32()))], ["positive", "fold", "found"])

    def member(part: pd.DataFrame) -> pd.DataFrame:
        w = train([*part.found[part.positive]], [*part.found[~part.positive]], size, prior)
        return pd.DataFrame({"feature": np.arange(size + 1), "weight": w})

    rows = arrow_map(sample, found, "positive boolean, fold int, found array<int>", 256, stateful=True)
    folds = F.explode(F.filter(F.sequence(F.lit(0), F.lit(MEMBERS - 1)), lambda k: F.col("positive") | (F.col("fold") != k)))
    trained = rows.withColumn("member", folds).groupBy("member").applyInPandas(member, "feature int, weight double")
    weights = np.zeros(size + 1)
    for r in trained.groupBy("feature").agg(F.avg("weight").alias("weight")).collect():  # at most FEATURES + 1 rows
        weights[r["feature"]] = r["weight"]
    return features, weights


def toxicity(docs: DataFrame, model: tuple[list[str], np.ndarray | None]) -> DataFrame:
    """``docs`` to doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *model))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        finder = worker_state(held, Finder)
        scores = np.array([finder.score(t.as_py()) for t in b.column(2)], np.float64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "text")
    return arrow_map(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int", 256, stateful=True)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
