"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, toxic and ordinary, are estimated from labelled texts. Pairs back off to continuation counts of words,
words to those of their stems (the first STEM bytes), and stems to one shared distribution: document counts over all
documents. An expression that both classes together show too rarely, which follows the size of the sample up to RARE
times, has no class count of its own: both models read it from what it backs off to, in the end from the shared counts,
where it speaks for neither. The difference of the log-likelihoods, length-normalised, of the
whole text and of its worst window, and its strongly toxic part (words beyond one nat), go through a logistic curve,
which is fitted on a fifth of the sample that the counts do not see.

Defined results: null or empty text - all differences 0; null doc_id - fold of the empty text; no usable labels of both
classes - every score 0.27, not toxic; texts of any length are read whole; repeated rows score alike; a score at the cutoff
is toxic; extra columns do not matter; empty table - empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns, cut, raw, word_hashes
from .counting import bucket_counts
from .samples import fold, labelled

BITS = 20
DISCOUNT = 0.75
RARE = 32  # of a word or pair, at most; this, RARE_STEM and TEXTS by cross-validation inside the rows that may be learned from
RARE_STEM = 48
TEXTS = 64  # counted texts for each time: a sample of n shows an expression n / TEXTS times before it speaks for itself, twice at least
STEM = 5  # bytes
WINDOW = 6
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")


def tokens(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of a whole text and of their stems."""
    words = TOKEN.findall(text.lower()) if text else []
    top = np.uint64(64 - BITS)
    return (word_hashes(words) >> top).astype(np.int64), (word_hashes([w[:STEM] for w in words]) >> top).astype(np.int64)


def known(text: bytes) -> np.ndarray:
    """Hashes for the shared counts: each word of a text once, and the stems of these words in a half of their own."""
    words = list(set(TOKEN.findall(text.lower())))
    return np.concatenate((word_hashes(words) >> np.uint64(1), (word_hashes([w[:STEM] for w in words]) >> np.uint64(1)) | np.uint64(2**63)))


def discounted(c: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Kneser-Ney: counts less DISCOUNT, and the mass so freed dealt out by the backoff."""
    total = max(c.sum(), 1)
    return np.maximum(c - DISCOUNT, 0) / total + DISCOUNT * max((c > 0).sum(), 1) / total * back


#: without labels of both classes nothing is toxic
UNTRAINED = np.array([-1.0, 0, 0, 0, 0])


class Model:
    """Log ratios of words and stems (by bucket; NaN: ask the stem) and of frequent pairs (by key, sorted), and the curve."""

    def __init__(self, words: np.ndarray, stems: np.ndarray, pairs: np.ndarray, pair_ratios: np.ndarray):
        self.words, self.stems, self.pairs, self.pair_ratios, self.curve = words, stems, pairs, pair_ratios, UNTRAINED

    def differences(self, text: bytes | None) -> tuple[float, float, float, float]:
        """Length-normalised, of the worst window and of the whole text; and the toxic evidence, in all and per word."""
        t, s = tokens(text)
        if not len(t):
            return 0.0, 0.0, 0.0, 0.0
        r = self.words[t].astype(np.float64)
        r = np.where(np.isnan(r), self.stems[s], r)
        if len(self.pairs) and len(t) > 1:
            key = (t[:-1] << BITS) | t[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            seen = self.pairs[at] == key
            r[1:][seen] = self.pair_ratios[at[seen]]
        sums = np.concatenate(([0.0], np.cumsum(r)))
        n = min(WINDOW, len(r))
        strong = float(np.maximum(r - 1, 0).sum())
        return float((sums[n:] - sums[:-n]).max()) / WINDOW, float(sums[-1]) / len(r), float(np.log1p(strong)), float(np.log1p(100 * strong / len(r)))

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve @ (1.0, *self.differences(text)), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method on a few columns."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def thresholds(texts: int) -> tuple[int, int]:
    """Occurrences from which words and pairs, and stems, are read from the classes' counts."""
    rare = max(2, texts // TEXTS)
    return min(RARE, rare), min(RARE_STEM, rare * 3 // 2)


def train(docs: DataFrame, sample: DataFrame) -> Model:
    """sample: (text, y), bounded. All that comes to the driver is bounded by the sample or by 2**BITS."""
    sample = cut(sample)
    # the curve is fitted on texts that the counts have not seen
    apart = sample.where(F.pmod(F.xxhash64("text"), F.lit(5)) == 0)
    sample = sample.where(F.pmod(F.xxhash64("text"), F.lit(5)) > 0)
    rare, rare_stem = thresholds(sample.count())
    seen = bucket_counts(columns(docs, "text"), known, BITS + 1) + 1
    of_word, of_stem = seen[: 2**BITS].astype(float), seen[2**BITS :].astype(float)

    def pairs(batches):
        for batch in batches:
            found = [(*tokens(t), y) for t, y in zip(raw(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
            for y in (0, 1):
                some = [(np.append(t[0], (t[:-1] << BITS) | t[1:]), s) for t, s, label in found if label == y and len(t)]
                if some:
                    key, at, n = np.unique(np.concatenate([k for k, _ in some]), return_index=True, return_counts=True)
                    stem = np.concatenate([s for _, s in some])[at]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(stem), pa.array(n * (y == 0)), pa.array(n * (y == 1))], names=["key", "s", "n0", "n1"])

    counts = sample.mapInArrow(pairs, "key long, s long, n0 long, n1 long").groupBy("key").agg(F.min("s").alias("s"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = cut(counts.select(F.shiftrightunsigned("key", BITS).alias("v"), F.col("key").bitwiseAND(2**BITS - 1).alias("w"), "s", "key", "n0", "n1"))
    types = [F.count_if(F.col(f"n{c}") > 0).alias(f"t{c}") for c in (0, 1)]
    words = counts.groupBy("w").agg(F.min("s").alias("s"), *types).toPandas()
    w, s = words["w"].to_numpy(np.int64), words["s"].to_numpy(np.int64)
    c = [words[f"t{k}"].to_numpy(float) for k in (0, 1)]
    if not c[0].sum() or not c[1].sum():
        return Model(np.zeros(2**BITS, np.float32), np.zeros(2**BITS, np.float32), np.zeros(0, np.int64), np.zeros(0))
    of = [np.bincount(s, x, 2**BITS) for x in c]
    share = of_stem / of_stem.sum()
    stem = [discounted(x, share) for x in of]
    stems = np.where(of[0] + of[1] >= rare_stem, np.log(stem[1] / stem[0]), 0).astype(np.float32)
    word = [discounted(x, p[s] * np.minimum(of_word[w] / of_stem[s], 1)) for x, p in zip(c, stem, strict=True)]
    table = np.full(2**BITS, np.nan, np.float32)
    often = c[0] + c[1] >= rare
    table[w[often]] = np.log(word[1] / word[0])[often]
    context = counts.groupBy("v").agg(*types, F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
    both = counts.where(f"n0 + n1 >= {rare} and key >= {2**BITS}").select("v", "w", "key", "n0", "n1").join(context, "v").toPandas().sort_values("key")
    back, q = np.zeros(2**BITS), []
    for k in (0, 1):
        back[w] = word[k]
        n, total, kinds = (both[f"{x}{k}"].to_numpy(float) for x in "nst")
        b = back[both["w"].to_numpy(np.int64)]
        q.append(np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * b) / np.maximum(total, 1), b))
    model = Model(table, stems, both["key"].to_numpy(np.int64), np.log(q[1] / q[0]))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            found = np.array([held.value.differences(t) for t in raw(batch.column(0))]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found.T), batch.column(1)], names=["a", "b", "c", "d", "y"])

    fit = apart.mapInArrow(measure, "a double, b double, c double, d double, y int").toPandas().sort_values(["a", "b", "c", "d", "y"])
    if fit["y"].nunique() == 2:
        model.curve = logistic(np.column_stack((np.ones(len(fit)), fit[["a", "b", "c", "d"]])), fit["y"].to_numpy(float))
    return model


def judge(docs: DataFrame, labels: DataFrame, label: str, parts: int, out_of: int, bound: int):
    """A function of a text column: the scores by a model trained on docs. Only texts go to Python and only numbers come back."""
    held = fold("doc_id", parts) == out_of
    model = docs.sparkSession.sparkContext.broadcast(train(bounded(docs), labelled(docs, labels, label, ~held, bound)))

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([model.value.score(t) for t in raw(texts)], pa.float64())

    return scores


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, out_of: int = 0, bound: int = 20000, cutoff: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    scored = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), judge(docs, labels, label, parts, out_of, bound)("text").alias("score"))
    return scored.select("doc_id", (fold("doc_id", parts) == out_of).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def passing(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, out_of: int = 0, bound: int = 20000, cutoff: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the cutoff."""
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index('text')}")
    return flat.where(judge(docs, labels, label, parts, out_of, bound)(text) < cutoff).toDF(*docs.columns)
