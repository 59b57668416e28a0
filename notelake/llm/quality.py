"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are the 1- and 2-grams of runs of letters, digits or signs, hashed into 2**BITS slots, square-rooted and scaled
to length 1. FTRL-proximal runs over a bounded sample of labelled texts in one task of bounded size; its L1 term leaves
few weights, which are broadcast. Scoring is a sparse dot product of every whole text.

Defined results: null or empty text - score of the bias alone; null doc_id - fold of the empty text; no usable labels -
every score 0.5; texts of any length are read whole; repeated rows score alike; a score at the cutoff is good; extra columns
do not matter; empty table - empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns, gram_hashes, raw, word_hashes
from .samples import fold, labelled

BITS = 20
SAME = np.uint64(0x5A5A5A5A5A5A5A5A)  # the 2-gram of a word and itself, whatever the word
TOKEN = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^a-z0-9\x80-\xff\x00-\x20]+")


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a whole text."""
    tokens = TOKEN.findall(text.lower()) if text else []
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    h = word_hashes(tokens)
    same = np.full(np.count_nonzero(h[1:] == h[:-1]), SAME)
    slots, counts = np.unique(np.concatenate((gram_hashes(h, 1), gram_hashes(h, 2), same)) >> np.uint64(64 - BITS), return_counts=True)
    values = np.sqrt(counts)
    return slots.astype(np.int64), values / np.sqrt(counts.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int = 7) -> dict[int, float]:
    """Weights by FTRL-proximal (McMahan et al., 2013); slot 2**BITS is the bias."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, 2**BITS), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    at = np.arange(2**BITS + 1)
    w = weights(at)
    return {int(i): float(w[i]) for i in np.flatnonzero(w)}


def train(sample: DataFrame, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5) -> np.ndarray:
    """float64[2**BITS + 1] of weights from (text, y). Features are made where the texts are; one task trains."""

    def vectors(batches):
        for batch in batches:
            found = [features(t) for t in raw(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float64())), batch.column(1)], names=["slots", "vals", "y"])

    def fit(table):
        rows = [(np.asarray(s.values), np.asarray(v.values), y.as_py()) for s, v, y in zip(table.column("slots"), table.column("vals"), table.column("y"), strict=True)]
        rows.sort(key=lambda r: (len(r[0]), r[0].tobytes(), r[2]))  # whatever order the rows came in
        w = ftrl(rows, epochs, alpha, beta, l1, l2)
        return pa.table({"slot": pa.array(list(w), pa.int64()), "w": pa.array(list(w.values()), pa.float64())})

    made = sample.mapInArrow(vectors, "slots array<long>, vals array<double>, y int")
    out = np.zeros(2**BITS + 1)
    for row in made.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fit, "slot long, w double").collect():  # at most 2**BITS + 1
        out[row["slot"]] = row["w"]
    return out


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, out_of: int = 2, bound: int = 8000, cutoff: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    held = fold("doc_id", parts) == out_of
    weights = docs.sparkSession.sparkContext.broadcast(train(labelled(bounded(docs), labels, label, ~held, bound)))  # 8 MB

    @F.arrow_udf("double")
    def dots(texts: pa.Array) -> pa.Array:
        w, out = weights.value, []
        for text in raw(texts):
            at, x = features(text)
            out.append(1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30))))
        return pa.array(out, pa.float64())

    scored = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), dots("text").alias("score"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
