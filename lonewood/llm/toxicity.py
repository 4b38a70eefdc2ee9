"""Toxicity by multiple-instance learning: sentence scores joined by a leaky noisy-or.

A document is a bag of sentences.  The probability that sentence s is toxic is
p_s = sigmoid(b + sum of the weights of its features); a document is toxic unless no
sentence is: 1 - (1 - leak) * prod(1 - p_s).  Only documents have labels, so the weights
come from the likelihood of those; the sentences with a high p_s are then the offending
ones.  Features are words and their first and last 3 to 6 letters, so inflected forms of
one stem share weights.  Sentences without any feature of the model have p_s = 0.

Training takes a bounded sample: ``MAX_TRAIN`` labelled documents, drawn by a hash of the
id, and ``MAX_FEATURES`` features.  Everything else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, shuffle_partitions, staged, tidy

MAX_TRAIN = 20_000
MAX_FEATURES = 8192
MIN_DOCS = 3
MIN_G = 18.0
STEPS = 400
RATE = 0.1
RIDGE = 2e-4
OFFENDING = 0.3
THRESHOLD = 0.3
CACHE = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    n = len(word)
    return [f"={word}"] + [f"^{word[:k]}" for k in range(3, 7) if n > k] + [f"${word[-k:]}" for k in range(3, 7) if n > k]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Model:
    """Weights of the selected features, the intercept and the leak."""

    def __init__(self, features: list[str], weights: np.ndarray, intercept: float, leak: float):
        self.features, self.weights, self.intercept, self.leak = features, weights, intercept, leak
        self.number = {f: i for i, f in enumerate(features)}
        self.words: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.features, self.weights, self.intercept, self.leak

    def __setstate__(self, state):
        self.__init__(*state)

    def numbers(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            found = self.words[word] = tuple(self.number[f] for f in features_of(word) if f in self.number)
        return found

    def sentences(self, text: str) -> Iterator[tuple[int, int, set[int]]]:
        """(begin, end, features) of the sentences that have any."""
        known, numbers = self.words.get, self.numbers
        for m in _SENTENCE.finditer(text):
            found: set[int] = set()
            for w in _WORD.findall(m[0].lower()):
                f = known(w)
                if f is None:
                    f = numbers(w)
                if f:
                    found.update(f)
            if found:
                yield m.start(), m.end(), found

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, offending sentences: begin, end and p_s)."""
        clean, offending = 1.0 - self.leak, []
        for a, b, f in self.sentences(text):
            p = 1.0 / (1.0 + np.exp(-(self.intercept + float(self.weights[sorted(f)].sum()))))
            clean *= 1.0 - p
            if p >= OFFENDING:
                offending.append((a, b, float(p)))
        return float(min(1.0, max(0.0, 1.0 - clean))), offending


def fit_noisy_or(label: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int,
                 steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> tuple[np.ndarray, float, float]:
    """Weights, intercept and leak of greatest likelihood (with a ridge), by Adam.  ``doc``:
    the document of each sentence; ``sentence`` and ``feature``: the sentences' features."""
    n, m = len(label), len(doc)
    y = label.astype(np.float64)
    theta = np.concatenate([np.zeros(n_features), [-3.0, -4.0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, b, c = theta[:-2], theta[-2], theta[-1]
        z = b + np.bincount(sentence, w[feature], m) if m else np.zeros(0)
        log_clean = -np.logaddexp(0, c) - np.bincount(doc, np.logaddexp(0, z), n)
        toxic = -np.expm1(log_clean)
        # d(-log likelihood) / d(-log clean): 1 for label 0, -clean / toxic for label 1
        g = np.where(y > 0, -np.exp(log_clean) / np.maximum(toxic, 1e-12), 1.0) / max(n, 1)
        gz = g[doc] / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(feature, gz[sentence], n_features) + ridge * w, [gz.sum(), g.sum() / (1 + np.exp(-c))]])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1])))


def _found(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label, name = [], []
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            mine = {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}
            name += mine
            label += [y] * len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(name, pa.string())], names=["label", "feature"])


def _bags(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            label, sizes, ids = [], [], []
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = [sorted(f) for _, _, f in model.sentences(text)]
                label.append(y)
                sizes.append([len(x) for x in s])
                ids.append([i for x in s for i in x])
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(sizes, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))], names=["label", "sizes", "ids"])

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_train: int = MAX_TRAIN,
          max_features: int = MAX_FEATURES) -> Model:
    """Learns from at most ``max_train`` labelled documents that are not held out.  Null labels
    and ids are left out; of several labels of one id the largest holds."""
    spark = ready(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(max_train)  # max_train rows of two numbers: small enough to broadcast
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = staged(d.join(F.broadcast(drawn), "id").select("label", "text"), "toxicity").repartition(shuffle_partitions(spark))
    sizes = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, t = sizes["n"] or 0, sizes["toxic"] or 0
    if not 0 < t < n:  # one label only: its share is all there is to learn
        return Model([], np.zeros(0), 0.0, (t + 0.5) / (n + 1.0))
    seen = sample.mapInArrow(tidy(_found), "label int, feature string").groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("a"))

    def cell(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    a, m = F.col("a").cast("double"), F.col("n").cast("double")
    g = 2 * (cell(a, m * t / n) + cell(m - a, m * (n - t) / n) + cell(t - a, (n - m) * t / n) + cell(n - t - m + a, (n - m) * (n - t) / n))
    chosen = seen.where((m >= MIN_DOCS) & (a / m > t / n)).withColumn("g", g).where(F.col("g") >= MIN_G).orderBy(F.desc("g"), "feature").limit(max_features)
    model = Model([r["feature"] for r in chosen.collect()], np.zeros(0), 0.0, 0.0)
    bags = sample.mapInArrow(tidy(_bags(spark.sparkContext.broadcast(model))), "label int, sizes array<int>, ids array<int>").toArrow()
    sizes, ids = bags.column("sizes").combine_chunks(), bags.column("ids").combine_chunks()
    per = sizes.flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), sizes.value_lengths().to_numpy())
    w, b, leak = fit_noisy_or(bags.column("label").to_numpy(), doc, np.repeat(np.arange(len(per)), per), ids.flatten().to_numpy().astype(np.int64), len(model.features))
    return Model(model.features, w, b, leak)


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` and a struct ``toxicity``: score and offending (begin, end and score of the
    sentences with p_s >= ``OFFENDING``; places count code points).

    Null and empty texts have no sentences: their score is the leak.  Repeated rows have the
    same score.  An empty table gives an empty result."""
    if "toxicity" in docs.columns:
        raise ValueError("the input has a column named toxicity")
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    @F.arrow_udf("struct<score: double, offending: array<struct<begin: int, end: int, score: double>>>")
    def of(column: pa.Array) -> pa.Array:
        m, scores, spans = shared.value, [], []
        for t in column.to_pylist():
            s, found = m.score(t or "")
            scores.append(s)
            spans.append([{"begin": a, "end": b, "score": p} for a, b, p in found])
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["score", "offending"])

    return docs.withColumn("toxicity", of(F.col(text)))
