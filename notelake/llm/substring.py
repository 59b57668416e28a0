"""Substring dedup over prefix-partitioned suffix trees.

A repeat of `span` words is a node of the corpus' suffix tree at string depth `span` or below. The tree is never held as
a whole. Suffixes are grouped by a short prefix first and by a longer one only where the group has more than one suffix:

1. Every window of `span` words elects one of its `seed`-word grams (the smallest hash), so equal windows elect equal
   grams at equal offsets. The elected gram is the short prefix: it groups the suffixes that start in the windows it
   stands for. Groups with one member have no inner node and end here; that is nearly all of a corpus.
2. In the others the prefix grows to all words of the windows that the gram stands for. Suffixes that still agree are
   below a deep inner node: all but the first (by document, then position) are repeats.
3. Where a group has several such branches, their first suffixes are compared at `span` words: the groups that this
   prefix makes are the inner nodes at that depth, and all their members but the first are repeats. Adjacent repeats make
   maximal spans.

Groups shrink before they are dealt: a task forwards one suffix for each branch it holds, BRANCHES at most for a short
prefix (what is beyond goes to step 3 at once), and settles its other copies itself, so that a passage in a third of all
documents is a few rows a task.

Defined results: null or blank text - no words, nothing removed; null doc_id - before every other id; rows that repeat
both id and text are one document (they lose the same words); equal ids with other texts are told apart, and ordered, by all
64 bits of a text hash; texts of any length are read whole; extra columns do not matter; empty table - empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, bounded, columns, gram_hashes, id_key, mix, raw, word_hashes

SEED = 6
BUFFER = 4_000_000  # suffixes or windows a task holds before it forwards them
BRANCHES = 8  # longer prefixes of one short prefix that a task forwards
#: what is known of a suffix: a repeat; to be compared by windows; still open; open, and its prefix has other branches
REPEAT, CHECK, OPEN, CROWDED = 0, 1, 2, 3


def elect(h: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first start, number of starts) of each run of windows that elect the same gram."""
    grams = gram_hashes(h, seed)
    wide = span - seed + 1
    if len(grams) < wide:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    chosen = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1) + np.arange(len(grams) - wide + 1)
    starts = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    return grams[chosen[starts]], starts.astype(np.int32), np.diff(np.append(starts, len(chosen))).astype(np.int32)


def window_hashes(h: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes (64 and 32 bits) of the windows at the given starts."""
    one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for i in range(span):
        x = h[starts + i]
        one = one * np.uint64(0x9E3779B97F4A7C15) + x
        two = (two ^ (x >> np.uint64(17))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(one), mix(two) >> np.uint64(33)


def stretch_hashes(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of stretches of words, by differences of a running polynomial."""
    one, base = np.ones(1, np.uint64), 0x9E3779B97F4A7C15
    power = np.cumprod(np.concatenate((one, np.full(len(h), base, np.uint64))))
    inverse = np.cumprod(np.concatenate((one, np.full(len(h), pow(base, -1, 2**64), np.uint64))))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h) * power[:-1])))
    return mix((run[starts + lengths] - run[starts]) * inverse[starts] + lengths.astype(np.uint64))


def places(runs: pa.ListScalar) -> np.ndarray:
    """Sorted distinct starts of a list of (start, n) runs; a repeated row may list a run twice."""
    if not runs.is_valid or not len(runs.values):
        return np.zeros(0, np.int64)
    begin, count = (np.asarray(runs.values.field(i), np.int64) for i in (0, 1))
    return np.unique(np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))


def covered(n: int, starts: np.ndarray, span: int) -> np.ndarray:
    """Flags of the words under windows at starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + span, n), -1)
    return np.cumsum(step[:n]) > 0


def repeated_starts(docs: DataFrame, span: int, seed: int, carry: bool) -> DataFrame:
    """docs as (k, text, starts, repeats, -, rest): windows that also begin earlier begin at starts and in the runs of repeats."""
    own = columns(bounded(docs), "doc_id", "text", carry=carry)
    texts = own.select(id_key().alias("k"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text", F.col("rest") if carry else F.lit(None).cast("boolean").alias("rest"))

    def suffixes(batches):
        def forward(held):
            if not held:
                return
            key, reach, k, th, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((start, th, k, reach, key))
            key, reach, k, th, start, count = (x[by] for x in (key, reach, k, th, start, count))
            group = np.concatenate(([True], key[1:] != key[:-1]))
            branch = group | np.concatenate(([True], reach[1:] != reach[:-1]))
            own = branch | np.concatenate(([True], (k[1:] != k[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1])))  # else the same place in a repeated row
            nth = np.cumsum(branch) - np.repeat(np.cumsum(branch)[group], np.diff(np.append(np.flatnonzero(group), len(key))))
            crowd = np.repeat(np.maximum.reduceat(nth, np.flatnonzero(group)) >= BRANCHES, np.diff(np.append(np.flatnonzero(group), len(key))))
            kind = np.where(~branch, REPEAT, np.where(nth >= BRANCHES, CHECK, np.where(crowd, CROWDED, OPEN))).astype(np.int8)
            spread = np.where((kind == REPEAT) | (kind == CHECK), mix(key + np.arange(len(key), dtype=np.uint64)), key)  # settled rows go anywhere
            back = np.argsort(by)  # rows of a document stay together, which packs well
            back = back[own[back]]
            yield pa.RecordBatch.from_arrays([pa.array(x[back]) for x in (spread.view(np.int64), reach.view(np.int64), kind, k, th, start, count)], names=["key", "reach", "kind", "k", "th", "start", "n"])

        held, size = [], 0
        for batch in batches:
            for k, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                words = text.split() if text else []
                if len(words) < span:
                    continue
                h = word_hashes(words)
                key, start, count = elect(h, span, seed)
                held.append((key, stretch_hashes(h, start, count + span - 1), np.full(len(key), k, np.int64), np.full(len(key), th, np.int64), start, count))
                size += len(key)
                if size > BUFFER:
                    yield from forward(held)
                    held, size = [], 0
        yield from forward(held)

    found = texts.select("k", "th", "text").mapInArrow(suffixes, "key long, reach long, kind tinyint, k long, th long, start int, n int")
    group, place = Window.partitionBy("key"), F.struct("k", "th", "start")
    settled = F.col("kind").isin(REPEAT, CHECK)
    branches = (F.min("reach").over(group) != F.max("reach").over(group)) | (F.max(F.col("kind") == CROWDED).over(group))
    # by key first: the second window is then dealt already
    found = found.withColumn("branches", branches).withColumn("first", F.min(place).over(Window.partitionBy("key", "reach")))
    state = F.when(settled, F.col("kind")).when(place != F.col("first"), REPEAT).when(F.col("branches"), CHECK)
    state = found.select("k", "th", "start", "n", state.alias("kind")).where("kind is not null")
    runs = [F.collect_list(F.when(F.col("kind") == kind, F.struct("start", "n"))).alias(name) for kind, name in ((CHECK, "runs"), (REPEAT, "repeats"))]
    alive = state.groupBy("k", "th").agg(*runs)

    def windows(batches):
        def forward(held):
            if not held:
                return
            one, two, k, th, start = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((start, th, k, two, one))
            one, two, k, th, start = one[by], two[by], k[by], th[by], start[by]
            new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            own = new | np.concatenate(([True], (k[1:] != k[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1])))  # else the same place in a repeated row
            one, two, k, th, start, new = one[own], two[own], k[own], th[own], start[own], new[own]
            by, first = np.arange(len(one)), np.zeros(len(one), bool)
            first[by[new]] = True
            spread = np.where(first, one, mix(one + np.arange(len(one), dtype=np.uint64)))
            two = np.where(first, two.astype(np.int64), -1).astype(np.int32)  # -1: a repeat already
            yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.array(two), pa.array(k), pa.array(th), pa.array(start)], names=["one", "two", "k", "th", "start"])

        held, size = [], 0
        for batch in batches:
            for k, th, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3), strict=True):
                at = places(runs)
                if not len(at):
                    continue
                one, two = window_hashes(word_hashes(text.split()), at, span)
                held.append((one, two, np.full(len(at), k, np.int64), np.full(len(at), th, np.int64), at.astype(np.int32)))
                size += len(at)
                if size > BUFFER // 2:
                    yield from forward(held)
                    held, size = [], 0
        yield from forward(held)

    inner = texts.join(alive, ["k", "th"]).select("k", "th", "text", "runs", "repeats", "rest").mapInArrow(windows, "one long, two int, k long, th long, start int")
    first = F.min(F.struct("k", "th", "start")).over(Window.partitionBy("one", "two"))
    again = inner.withColumn("first", first).where((F.col("two") < 0) | (F.struct("k", "th", "start") != F.col("first")))
    # all columns go on, so that the dealt texts and runs are read twice and not made twice
    marks = again.groupBy("k", "th").agg(F.collect_list("start").alias("starts"))
    return texts.join(alive, ["k", "th"], "left").join(marks, ["k", "th"], "left").select("k", "text", "starts", "repeats", "runs", "rest")


def remove_repeats(docs: DataFrame, span: int = 20, seed: int = SEED, carry: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (the text, or its kept words joined by one space), rest (all columns, if carried)."""
    both = repeated_starts(docs, span, seed, carry)

    def strip(batches):
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for text, starts, runs in zip(raw(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                words, kept = text.split() if text else [], text
                at = np.concatenate((np.asarray(starts.values if starts.is_valid else [], np.int64), places(runs)))
                gone = covered(len(words), at, span) if len(at) else np.zeros(len(words), bool)
                if gone.any():
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept = b" ".join(words)
                out["n_words"].append(len(gone))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
                out["kept"].append(kept)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            done = [pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *done[:3], done[3].cast(pa.string()), batch.column(5)], names=["k", *out, "rest"])

    done = both.mapInArrow(strip, f"k long, n_words long, n_removed long, kept_sha256 string, kept string, rest {both.schema['rest'].dataType.simpleString()}")
    return done.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept", "rest")


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20),
    windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM starts),
    again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS nth FROM windows) WHERE nth > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM again),
    lists AS (SELECT doc_id, list(i ORDER BY i) AS gone FROM gone GROUP BY doc_id),
    kept AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
        CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS k
        FROM words LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
