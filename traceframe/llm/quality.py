"""Quality score: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Words are runs of letters and digits, or runs of other signs; a word equal to the one before it counts as
one fixed mark, so that repetition is the same feature whatever is repeated. Runs of one to three words are hashed to
2^18 weights; a text's features are its n-gram counts over the square root of their sum, so the
score is a sparse dot product.

Training takes at most ``most_rows`` labelled rows, those with the smallest hash of their id: a documented bound on the
classifier's fitting. They are dealt over ``shards``; each shard runs follow-the-regularised-leader updates on its rows
and the shards' weights are averaged.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import U64, as_bytes, fold, hashed, in_slices, mixed, texts, word_hashes

DIMENSIONS = 1 << 18
WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
REPEATED = U64(0x5151)


def features(raw: bytes, cache, orders: int = 3) -> np.ndarray:
    """Hashed n-grams of a text, each as often as it occurs."""
    h = hashed(WORD.findall(raw), cache)
    if len(h) > 1:
        again = h[1:] == h[:-1]
        h[1:][again] = REPEATED
    parts = []
    for n in range(1, orders + 1):
        if len(h) >= n:
            x = np.full(len(h) - n + 1, n, dtype=U64)
            for k in range(n):
                x = mixed(x ^ h[k : len(h) - n + 1 + k])
            parts.append((x >> U64(46)).astype(np.int64))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


class Ftrl:
    """FTRL-proximal with one learning rate per weight; weights are lazily made from z and n."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # The last place is the bias, which is not regularised away by l1.
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == DIMENSIONS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(v: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, v))))


def train(
    labelled: DataFrame, most_rows: int = 20_000, shards: int = 8, passes: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1
) -> np.ndarray:
    """Weights (the last is the bias) from rows (doc_id, text, label); zeros where there are no rows.

    Null labels are left out; a null text is empty. The driver gets at most 2^18 + 1 weights.
    """
    spark = labelled.sparkSession
    rows = labelled.where("label is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    order = F.xxhash64(F.lit(7), "doc_id")
    dealt = rows.withColumn("_h", order).withColumn("_shard", F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(shards)))

    def learn(pdf):
        model, cache = Ftrl(alpha, beta, l1, l2), word_hashes()
        pdf = pdf.sort_values(["_h", "text"], kind="stable")
        items = []
        for text, label in zip(pdf["text"], pdf["label"]):
            at, counts = np.unique(features(text.encode(), cache), return_counts=True)
            x = np.append(counts / math.sqrt(counts.sum()) if len(at) else [], 1.0)
            items.append((np.append(at, DIMENSIONS).astype(np.int64), x, int(label)))
        for _ in range(passes):
            for item in items:
                model.learn(*item)
        w = model.weights(np.arange(DIMENSIONS + 1))
        seen = np.flatnonzero(w)
        return pd.DataFrame({"at": seen, "w": w[seen]})

    # Of the bound's rows only ids and hashes are sorted; their texts are read afterwards.
    limit = rows.select(order.alias("h")).orderBy("h").limit(most_rows).agg(F.max("h"), F.count("*")).first()
    out = np.zeros(DIMENSIONS + 1)
    if not limit[1]:
        return out
    dealt = dealt.where(F.col("_h") <= limit[0])
    used = dealt.select("_shard").distinct().count()
    table = dealt.groupBy("_shard").applyInPandas(learn, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toPandas()
    out[table["at"].to_numpy()] = table["w"].to_numpy() / used
    return out


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row; a null or empty text gets the score of the bias alone."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def predict(batches):
        cache, w = word_hashes(), shared.value
        for part in in_slices(batches):
            values = []
            for raw in as_bytes(part.column(1)):
                at = features(raw, cache)
                values.append(sigmoid(float(w[at].sum()) / math.sqrt(max(1, len(at))) + float(w[-1])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rows = texts(docs, "doc_id").mapInArrow(predict, f"doc_id {kind}, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, text, label) of the labelled rows outside the held-out fold."""
    marks = labels.where((fold("doc_id", folds) != held) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    return docs.select("doc_id", "text").join(marks, "doc_id")
