"""Phrase collocations by generalised suffix automata.

A shard, the next words of a partition, gets one automaton a language: substrings of at most DEPTH words, built a length at a time
in arrays, each with its number of end positions and the link to the substring that lacks its first word. Substrings that a link
joins and that end at equal positions are one state, named by its longest member; states are enumerated, each giving its count
to its members. Counts are reduced over all shards by the phrase itself.

What cannot be frequent is left out before it is shuffled, and nothing else: a phrase has no more occurrences than any part of it.
Words are counted first, then by hash (equal hashes only add) the pairs of frequent words, then the triples of frequent pairs, up to
one word less than DEPTH; the last pass builds automata of the runs whose parts are all frequent. What is frequent comes back as a
bitmap of 2**BITS bits a length, a fixed size (8 MB) whatever the corpus: bits that parts share let more through to the exact
counts, never less.

Subsumption follows the links too: a phrase with a longer one that occurs nearly as often has, by the same measure, one that is
just one word longer, before (its link leads to the phrase) or behind.

Defined results: null lang is `und`; null, empty and blank texts count nothing; a phrase of ties is ordered by its bytes; a text of
any length is read whole; repeated rows count each; a language without candidates gives no rows; extra columns do not matter;
empty table - empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, columns, cut, gram_hashes, raw

BITS = 26
NAME = 44  # bits of a hash by which runs are counted
CHUNKS = 256
SHARD = 2**21  # words
SALTS = 64
NAMED = np.uint64(2**64 - 2 ** (64 - NAME))
BREAK = b"\n"
#: A-Z become a-z, signs and line ends break, a tab separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words, with BREAK between pieces and after the last; some entries are empty."""
    found = text.translate(FOLD).replace(BREAK, b" \n ").split(b" ")
    found.append(BREAK)
    return found


def named(words: list[bytes], lang: str) -> np.ndarray:
    """Hashes of words of a language."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(xxhash.xxh32_intdigest(lang))), np.uint64, len(words))


class Automaton:
    """Substrings of 1 to depth words of a sequence; reach[i] is the length of the longest one wanted that starts at i.

    By length m (list index m - 1): counts (end positions), first (place of one occurrence), links (the substring of m - 1 words
    that ends alike; none for one word), and inner: whether it shares the state of a longer substring.
    """

    def __init__(self, ids: np.ndarray, reach: np.ndarray, depth: int):
        below = np.zeros(len(ids), np.int64)
        base = int(ids.max(initial=0)) + 1
        self.counts, self.first, self.links, self.inner = [], [], [], []
        for m in range(1, depth + 1):
            at = np.flatnonzero(reach >= m)
            _, first, own, counts = np.unique(below[at] * base + ids[at + m - 1], return_index=True, return_inverse=True, return_counts=True)
            links = below[at[first] + 1] if m > 1 else np.zeros(len(counts), np.int64)
            if m > 1:
                self.inner[-1][links[counts == self.counts[-1][links]]] = True
            self.counts.append(counts)
            self.first.append(at[first])
            self.links.append(links)
            self.inner.append(np.zeros(len(counts), bool))
            below = np.zeros(len(ids), np.int64)
            below[at] = own

    def states(self, least: int = 1) -> Iterator[tuple[int, int, int, int]]:
        """(first, longest, shortest, count): a place where the longest member starts, and the lengths, from `least` words on."""
        for m in range(len(self.counts), least - 1, -1):
            own = np.flatnonzero(~self.inner[m - 1])
            shortest, down = np.full(len(own), m), own
            for k in range(m - 1, least - 1, -1):
                down = self.links[k][down]
                shortest[(shortest == k + 1) & self.inner[k - 1][down] & (self.counts[k - 1][down] == self.counts[m - 1][own])] = k
            yield from zip(self.first[m - 1][own].tolist(), repeat(m), shortest.tolist(), self.counts[m - 1][own].tolist())


def _rows(lang: list, phrase: list, words: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(words, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "words", "n"])


def _texts(batches) -> Iterator[tuple[str, list[bytes]]]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            yield lang, tokens(text)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, words, n) of every word; a null phrase has the number of all words."""

    def run(batches):
        held, kinds = defaultdict(Counter), 0

        def out():
            for lang, counts in held.items():
                for blank in (BREAK, b""):
                    counts.pop(blank, None)
                yield _rows([lang] * (len(counts) + 1), [None, *counts], [1] * (len(counts) + 1), [sum(counts.values()), *counts.values()])
            held.clear()

        for lang, found in _texts(batches):
            own = held[lang]
            kinds -= len(own)
            own.update(found)
            kinds += len(own)
            if kinds > SHARD // 4:
                yield from out()
                kinds = 0
        yield from out()

    return docs.mapInArrow(run, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def bitmap(hashes: DataFrame) -> np.ndarray:
    """uint8[2**BITS / 8]: the bits that the hashes of the one column h name, by their top BITS bits. CHUNKS rows of a fixed size come to the driver."""
    size = 2**BITS // 8 // CHUNKS

    def mark(batches):
        bits = np.zeros(2**BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - BITS)] = True
        packed = np.packbits(bits).reshape(CHUNKS, size)
        own = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([packed[i].tobytes() for i in own], pa.binary())], names=["chunk", "bits"])

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.uint8)
        for x in pdf["bits"]:
            total |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [total.tobytes()]})

    out = np.zeros((CHUNKS, size), np.uint8)
    for row in hashes.mapInArrow(mark, "chunk long, bits binary").groupBy("chunk").applyInPandas(either, "chunk long, bits binary").collect():
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def word_hashes(words: DataFrame) -> DataFrame:
    """(h) of each word."""

    def run(batches):
        for batch in batches:
            h = [xxhash.xxh3_64_intdigest(w, xxhash.xxh32_intdigest(lang)) for lang, w in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], names=["h"])

    return words.select("lang", "phrase").mapInArrow(run, "h long")


def _allowed(h: np.ndarray, parts: list) -> np.ndarray:
    """Whether the run of len(parts) + 1 words at each place may be frequent: whether all its parts are; parts[i] has runs of i + 1 words."""
    ok = _set(parts[0].value, h)
    for m, bits in enumerate(parts, 1):
        if m > 1:
            at = np.flatnonzero(ok)
            ok[at] = _set(bits.value, gram_hashes(h, m)[at] & NAMED)
        ok = ok[:-1] & ok[1:]
    return ok


def frequent_runs(docs: DataFrame, parts: list, least: int) -> DataFrame:
    """(h) of each run of len(parts) + 1 words whose hash occurs `least` times or more; parts are bitmaps of the shorter frequent runs."""

    def run(batches):
        held, n = [], 0

        def out():
            h, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            for i in range(0, len(h), 2**18):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 2**18].view(np.int64)), pa.array(counts[i : i + 2**18].astype(np.int32))], names=["h", "n"])

        for lang, found in _texts(batches):
            h = named(list(filter(None, found)), lang)
            own = gram_hashes(h, len(parts) + 1)[_allowed(h, parts)] & NAMED
            held.append(own)
            n += len(own)
            if n > SHARD:
                yield from out()
                held, n = [], 0
        yield from out()

    return docs.mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def phrase_counts(docs: DataFrame, parts: list, depth: int) -> DataFrame:
    """(lang, phrase, words, n) of phrases of 2 to depth words whose parts may all be frequent."""

    def run(batches):
        held, n = defaultdict(lambda: ([], [])), 0

        def out():
            for lang, (kept, reach) in held.items():
                ids: dict[bytes, int] = {}
                own = Automaton(np.fromiter((ids.setdefault(w, len(ids)) for w in kept), np.int64, len(kept)), np.concatenate(reach), depth)
                phrase, length, count = [], [], []
                for first, longest, shortest, times in own.states(2):
                    for m in range(shortest, longest + 1):
                        phrase.append(b" ".join(kept[first + longest - m : first + longest]))
                        length.append(m)
                        count.append(times)
                    if len(phrase) > 2**16:
                        yield _rows([lang] * len(phrase), phrase, length, count)
                        phrase, length, count = [], [], []
                yield _rows([lang] * len(phrase), phrase, length, count)

        for lang, found in _texts(batches):
            found = list(filter(None, found))
            h = named(found, lang)
            reach = np.zeros(len(found), np.int8)
            for m in range(2, depth + 1):
                ok = np.flatnonzero(_allowed(h, parts[: m - 1]))
                if m < depth:
                    ok = ok[_set(parts[m - 1].value, gram_hashes(h, m)[ok] & NAMED)]
                reach[ok] = m
            if not reach.any():
                continue
            wanted = reach > 0
            for m in range(2, depth + 1):
                wanted[np.flatnonzero(reach >= m) + m - 1] = True
            at = np.flatnonzero(wanted)
            kept, own = held[lang]
            kept.extend([found[i] for i in at])
            own.append(np.maximum(reach[at], 1))
            n += len(at)
            if n > SHARD // 2:
                yield from out()
                held.clear()
                n = 0
        yield from out()

    return docs.mapInArrow(run, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, least: int = 30, depth: int = 4) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of 1 to depth words that occur `least` times or more; a null phrase has all words of a language."""
    own = columns(docs, "lang", "text").where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    own = bounded(own)
    send = docs.sparkSession.sparkContext.broadcast
    enough = F.col("n") >= least
    words = cut(word_counts(own).where(enough | F.col("phrase").isNull()))
    parts = [send(bitmap(word_hashes(words.where("phrase is not null"))))]
    while len(parts) < depth - 1:
        parts.append(send(bitmap(frequent_runs(own, parts, least))))
    return cut(words.unionByName(phrase_counts(own, parts, depth).where(enough)))


def collocations(docs: DataFrame, least: int = 30, depth: int = 4, scale: int = 2000000, percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, by their weakest cut."""
    found = frequent(docs, least, depth)
    counts = found.where("phrase is not null").select("lang", "phrase", "n")
    own = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("ws"))
    part = lambda start, length: F.concat_ws(" ", F.slice("ws", start, length))
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    exact = F.expr(f"cast(cast(a as decimal(20, 0)) * {scale} div cast(l + r as decimal(20, 0)) as long)")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    # one word longer, in front (a suffix link) or behind
    longer = own.where("words > 2")
    longer = longer.select("lang", part(F.lit(2), F.col("words") - 1).alias("phrase"), "a").unionByName(longer.select("lang", part(F.lit(1), F.col("words") - 1).alias("phrase"), "a"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * percent))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each part of a language first, so that no task sorts a whole language
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(found.where("phrase is null").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of collocations() with its defaults, over documents.
ORACLE = r"""
WITH lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS n FROM (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
    FROM lists, (VALUES (1), (2), (3), (4)) t(m)) GROUP BY ALL HAVING count(*) >= 30),
own AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
cuts AS (SELECT lang, m, phrase, a, ws, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest FROM own, (VALUES (1), (2), (3)) t(k) WHERE k < m),
scored AS (SELECT c.*, l.n AS l, r.n AS r, (2000000::HUGEINT * a // (l.n + r.n))::BIGINT AS score FROM cuts c
    JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT o.lang, array_to_string(o.ws[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM own o, (VALUES (2), (3)) t(s), (VALUES (1), (2), (3)) u(i) WHERE s < o.m AND i + s - 1 <= o.m GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN inside i USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
