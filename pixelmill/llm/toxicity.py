"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of letters, digits and bytes beyond ASCII.  A document's features are the distinct hashes of
its words, word pairs, pairs with one word skipped, and beginnings of words (4 to 8 bytes, for languages that compound).
Per-coordinate learning rates and an L1 term leave few weights, which are broadcast; what a document holds besides them
does not count.  Scores need one pass over the texts and no shuffle.

Training takes at most ``max_rows`` labelled documents (documented bound; those with the least hash of their doc_id) in one
task, one row of each: of rows with one doc_id the one with the least hash of its text.  So the bound holds for rows too, and
the weights do not depend on the order or number of partitions.  Labels, languages, sources and ids are no inputs of a score.

A null or empty text has the score of the bias alone.  A doc_id with several labels counts as toxic if at least half of
them do; null labels and null ids do not count.  Without any label every score is that of an untrained model, 0.5, and so
predicted 1; :func:`not_toxic` then rejects nothing.  Repeated rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import textbits as tb
from pixelmill.llm.common import pieces, text_function

U = np.uint64
BITS = 20
_SEP = tb.separators(bytes(i for i in range(128) if chr(i) not in string.ascii_letters + string.digits))
_PREFIXES = range(4, 9)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts of a column and for each the number of its text, in no order and with repeats."""
    data, offs = tb.raw(column)
    h, s, e, upto = tb.words(data, offs, _SEP)
    doc = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    hashes, docs = [h], [doc]
    for gap, seed in ((1, 1), (2, 2)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = tb.mix(h[:-gap] * U(0x9E3779B97F4A7C15) + h[gap:] * U(0xC2B2AE3D27D4EB4F) + U(seed))
            hashes.append(pair[same])
            docs.append(doc[gap:][same])
    length, start = e - s, np.zeros(len(s), U)
    up, _ = tb._powers(16)
    for j in range(max(_PREFIXES)):
        at = np.minimum(s + j, max(0, len(data) - 1))
        if len(s):
            start = start + tb._BYTE_LOWER[data[at]] * up[j]
        if j + 1 in _PREFIXES:
            long = length > j + 1
            hashes.append(tb.mix(start[long] + U(j + 1)))
            docs.append(doc[long])
    return (np.concatenate(hashes) >> U(64 - BITS)).astype(np.int64), np.concatenate(docs)


class Ftrl:
    """FTRL-proximal updates on one document at a time."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0) -> dict[int, float]:
    """Weights by feature number; the bias has the number 2**20.  Rows of held-out documents are not used."""
    folded = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = folded.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first")).select("doc_id", "label", "first.text")

    def fit(batches):
        seen: dict[int, tuple[np.ndarray, int]] = {}
        for whole in batches:
            for batch in pieces(whole, "text"):
                at, doc = features(batch.column("text"))
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
                ids, ys = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
                for i in range(batch.num_rows):
                    own = np.unique(at[order[cuts[i] : cuts[i + 1]]])
                    seen[ids[i]] = (np.append(own, 1 << BITS).astype(np.int32), ys[i])
        model = Ftrl(alpha, beta, l1, l2)
        keys = sorted(seen, key=lambda k: int(tb.mix(np.array([k], np.int64).view(U))[0]))
        for _ in range(epochs):
            for k in keys:
                model.learn(*seen[k])
        used = np.flatnonzero(model.n)
        w = model.weights(used)
        yield pa.RecordBatch.from_arrays([pa.array(used[w != 0].astype(np.int64)), pa.array(w[w != 0])], names=["at", "weight"])

    return {r[0]: r[1] for r in one.repartition(1).mapInArrow(fit, "at long, weight double").collect()}


def held_out(column: str):
    """Whether crc32 of the id as text leaves 0 modulo 5; false for a null."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 0, F.lit(False))


def classifier(spark: SparkSession, weights: dict[int, float]) -> Callable[[Column], Column]:
    """The score of a column of texts.  ``weights`` is small by the L1 term and the training bound; it is broadcast."""
    numbers = np.fromiter(sorted(weights), np.int64, len(weights))
    values = np.fromiter((weights[i] for i in sorted(weights)), np.float64, len(weights))
    sent = spark.sparkContext.broadcast((numbers, values))

    def make():
        table = np.zeros((1 << BITS) + 1)
        table[sent.value[0]] = sent.value[1]

        def scores(texts: pa.Array) -> pa.Array:
            at, doc = features(texts)
            hit = table[at] != 0
            pairs = np.unique(doc[hit] * (1 << BITS) + at[hit])
            total = np.bincount(pairs >> BITS, weights=table[pairs & ((1 << BITS) - 1)], minlength=len(texts)) + table[1 << BITS]
            return pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))

        return scores

    return text_function(make, "double")


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **training) -> DataFrame:
    """``keep`` (doc_id by default), score and predicted (1 if score >= 0.5) of each row, by a model trained on ``labels``.

    The operator's columns take the place of kept ones of the same name.
    """
    score = classifier(docs.sparkSession, train(docs, labels, **training))
    kept = [F.col(c) for c in keep or ["doc_id"] if c not in ("score", "predicted")]
    return docs.select(*kept, score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns; all rows if there is no label."""
    weights = train(docs, labels, **training)
    if not weights:
        return docs
    return docs.where(classifier(docs.sparkSession, weights)(F.col("text")) < 0.5)
