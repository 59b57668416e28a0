"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its word shingles. Under a global order of shingles two sets with Jaccard >= t share a token
among their first ``|x| - ceil(t |x|) + 1``; this holds for every order. Orders put frequent shingles last (counts of
all documents, in buckets) and break ties by differently mixed hashes. Candidates must share prefix tokens under all of
ORDERS before an exact intersection decides.

Prefix tokens alone would also route the documents to where they meet, but passages that a few documents share then chain
most of a corpus together (measured: one family of most documents, 12 x the input on disk). Documents are therefore
routed by whole parts of their sets (Arasu et al., 2006): sets that differ in at most H tokens agree in one of H + 1 parts at
least, so that every linked pair shares a part, and parts of dissimilar sets seldom agree. Sets that share a part become candidates when the L1 distance of their
token histograms, a lower bound of the size of their symmetric difference, allows a link; without this test parts of a
few tokens, as thresholds like 0.8 make them, chain documents with a common passage. Candidates form families; a family is cut into blocks of bounded size, and each pair of blocks is filtered and verified in one task.
Equal sets form one class and only class representatives are compared.

Defined results: null or blank text - no shingles, linked with nothing; null doc_id - counted but not linked, null
component; rows that repeat a doc_id are one document to the links; texts of any length are read whole; sets of equal size
and similarity need no order; extra columns do not matter; empty table - empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, columns, cut, gram_hashes, mix, raw, word_hashes
from .components import components
from .counting import Tally, total

BITS = 20
BLOCK = 512  # documents of a family that meet in one task, and half of the largest task
BUCKETS = 256  # of a histogram
PACK = 2_048  # rows of small groups that are compared in one task: as many as a pair of blocks has
SMALL = 32  # documents of a group whose pairs are compared with those of other groups, an array at a time
PAIRS = 4_096  # pairs of an array: 2 MB of histograms a side
RECENT = 200_000  # sets that a task remembers, so as not to deal their copies again
ORDERS = (np.uint64(0x1B873593A5A5A5A5), np.uint64(0x85EBCA6B9E3779B1), np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(text: bytes | None, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a whole text; fewer words make one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(n, len(words))))


def fingerprint(tokens: np.ndarray) -> int:
    """Of a whole set, 0 if empty."""
    return int(np.bitwise_xor.reduce(mix(tokens + np.uint64(1))).astype(np.int64)) if len(tokens) else 0


def histogram(tokens: np.ndarray) -> bytes:
    """Tokens a bucket, 255 at most: cutting the counts only lowers their L1 distance, which stays a lower bound."""
    return np.minimum(np.bincount((mix(tokens ^ ORDERS[0]) >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def near(counts: np.ndarray, sizes: np.ndarray, percent: int):
    """Pairs (i, js) whose histograms (int16 rows) allow a link: |x - y| + |y - x| <= (100 - t) / (100 + t) * (|x| + |y|)."""
    for i in range(len(sizes) - 1):
        apart = np.abs(counts[i + 1 :] - counts[i]).sum(axis=1, dtype=np.int64)
        yield i, i + 1 + np.flatnonzero((100 + percent) * apart <= (100 - percent) * (sizes[i] + sizes[i + 1 :]))


def near_small(counts: np.ndarray, sizes: np.ndarray, by: np.ndarray, edges: np.ndarray, percent: int):
    """near() for all groups by[edges[k] : edges[k + 1]] of at most SMALL rows together: arrays (i, j) of rows, PAIRS pairs at a time."""
    length = np.diff(edges)
    left = np.repeat(np.where(length <= SMALL, edges[1:], 0), length) - np.arange(len(by))  # rows of the group from here on
    for apart in range(1, int(left.max(initial=0))):
        first = np.flatnonzero(left > apart)
        i, j = by[first], by[first + apart]
        most = (100 - percent) * (sizes[i] + sizes[j])
        fit = (100 + percent) * np.abs(sizes[i] - sizes[j]) <= most
        i, j, most = i[fit], j[fit], most[fit]
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            linked = (100 + percent) * np.abs(counts[a] - counts[b]).sum(axis=1, dtype=np.int64) <= most[at : at + PAIRS]
            yield a[linked], b[linked]


def prefix(tokens: np.ndarray, rarity: np.ndarray, order: np.uint64, percent: int) -> np.ndarray:
    """The tokens that come first in a global order, as many as the threshold asks for."""
    n = len(tokens)
    size = n - (percent * n + 99) // 100 + 1
    if size >= n:
        return tokens
    place = (rarity[(tokens >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(tokens ^ order) >> np.uint64(8))
    return tokens[np.argpartition(place, size - 1)[:size]]


def intervals(percent: int, top: int = 10**9) -> np.ndarray:
    """Upper ends of size classes such that linked sets lie in one or in two adjacent classes."""
    ends, low = [], 1
    while low <= top:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return np.array(ends, np.int64)


def parts(tokens: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the parts of a set: linked sets have one in common at least.

    For its own size class and the next the set is dealt by hash into H + 1 + E parts, H the most tokens that linked sets
    of these sizes differ in. At least 1 + E parts agree; sets that agree in empty parts only have more than E of them, and
    such sets send keys for their empty parts too.
    """
    out = []
    own = int(np.searchsorted(ends, len(tokens)))
    value = mix(tokens + np.uint64(0x51ED270B))
    for tag in (own, own + 1):
        k = (100 - percent) * 2 * int(ends[tag]) // (100 + percent) + 1
        spare = 0 if k == 1 else 1 + k // 50
        k += spare
        part = (mix(tokens ^ (np.uint64((int(ORDERS[1]) * (2 * tag + 1)) % 2**64))) % np.uint64(k)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        part = part[by]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums, which = np.add.reduceat(value[by], first), part[first]
        if k - len(which) > spare:
            none = np.setdiff1d(np.arange(k), which)
            sums, which = np.concatenate((sums, np.zeros(len(none), np.uint64))), np.concatenate((which, none))
        out.append(mix(sums + mix(which.astype(np.uint64) + np.uint64((int(ORDERS[2]) * tag) % 2**64))))
    return np.concatenate(out)


def shared(lists: list[np.ndarray], n: int) -> np.ndarray:
    """n x n flags: which of the lists have a token in common."""
    met = np.zeros((n, n), bool)
    owner = np.repeat(np.arange(n), [len(x) for x in lists])
    tokens = np.concatenate(lists) if n else np.zeros(0, np.uint64)
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    edges = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True])))
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if end - start > 1:
            rows = owner[start:end]
            met[rows[:, None], rows[None, :]] = True
    return met


def verify(sets: list[np.ndarray], blocks: np.ndarray, rarity: np.ndarray, percent: int, across: bool):
    """Pairs (i, j) of linked sets; across: only pairs of different blocks. No pair row leaves the task unless linked."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    met = np.triu(100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes), 1)
    if across:
        met &= blocks[:, None] != blocks[None, :]
    for order in ORDERS:
        met &= shared([prefix(x, rarity, order, percent) for x in sets], n)
    for i, j in zip(*np.nonzero(met), strict=True):
        both = np.concatenate((sets[i], sets[j]))
        both.sort()
        inter = int(np.count_nonzero(both[1:] == both[:-1]))
        if 100 * inter >= percent * (len(both) - inter):
            yield int(i), int(j)


def _forest(pairs: Iterable[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """As few of the pairs as connect what all of them connect; pairs are read once and not held."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for i, j in pairs:
        a, b = top(i), top(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def jaccard_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, class_id (smallest id with the same set), n_links (other documents linked), text_hash."""
    spark = docs.sparkSession
    texts = columns(bounded(docs), "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def sketch(batches):
        tally = Tally(BITS)
        for batch in batches:
            found = [shingles(t, n) for t in raw(batch.column(1))]
            tally.add(found)
            h1 = [fingerprint(s) for s in found]
            h2 = [int(mix(s ^ ORDERS[2]).sum().astype(np.int64)) if len(s) else 0 for s in found]
            sizes, counts = pa.array([len(s) for s in found], pa.int64()), pa.array([histogram(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), counts, pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.int32())], names=names)
        # the task's counts of buckets follow its sketches, so that texts are not read a second time for them
        chunk, part, counts = tally.rows()
        none = pa.nulls(len(chunk), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, counts, chunk, part], names=names)

    names = ["doc_id", "text_hash", "n_shingles", "h1", "h2", "counts", "chunk", "part"]
    made = cut(texts.mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, counts binary, chunk int, part int"))
    seen = total(made.where("chunk is not null").select("chunk", "part", "counts"), BITS)
    rare = spark.sparkContext.broadcast(np.floor(np.log2(np.maximum(seen, 1))).astype(np.uint8))  # 1 MB
    sets = made.where("chunk is null").drop("chunk", "part")
    classes = cut(sets.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.countDistinct("doc_id").alias("class_n"), F.min("counts").alias("counts")))
    linked = _links(texts, classes, rare, n, percent)
    groups = components(linked.where("b is not null"))
    degrees = linked.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("far"))
    labels = classes.drop("counts").join(groups, classes.class_id == groups.vertex, "left").drop("vertex")
    labels = cut(labels.join(degrees, "class_id", "left"))
    # hot classes: both sides are exchanged for this join alone, so that a skewed class can be split; documents without shingles stay out of it
    none = [F.lit(None).cast("long").alias(x) for x in ("class_id", "class_n", "component", "far")]
    out = sets.where("n_shingles > 0").join(labels, ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", "text_hash", "class_id", "class_n", "component", "far")
    out = out.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", "text_hash", *none))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.coalesce(F.coalesce("far", F.lit(0)) + F.col("class_n") - 1, F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
    )


def _links(texts: DataFrame, classes: DataFrame, rare, n: int, percent: int) -> DataFrame:
    """(a, b, -) links that connect what all links connect, and (a, null, n) with the documents linked to a's class."""
    ends = intervals(percent)

    def deal(batches):
        """(key, h1) of the parts of the sets, a batch for a batch of texts. Sets seen lately are skipped: distinct() sees to the rest."""
        seen = set()
        for batch in batches:
            keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                s = shingles(text, n) if doc is not None else ()
                h = fingerprint(s) if len(s) else 0
                if len(s) and h not in seen:
                    seen.add(h)
                    keys.append(parts(s, ends, percent))
                    owners.append(np.full(len(keys[-1]), h, np.int64))
            if len(seen) > RECENT:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "h1"])

    of_key = Window.partitionBy("key")
    dealt = texts.mapInArrow(deal, "key long, h1 long")
    met = dealt.withColumn("low", F.min("h1").over(of_key)).withColumn("high", F.max("h1").over(of_key)).where("low <> high").select("key", "h1")
    met = cut(met.distinct())
    # near copies agree in nearly all their parts: of the keys with the very same members (by two hashes) one is enough
    group = met.groupBy("key").agg(F.count("*").alias("many"), *[F.bit_xor(F.xxhash64("h1", F.lit(i))).alias(f"x{i}") for i in (1, 2)])
    group = cut(group.groupBy("many", "x1", "x2").agg(F.min("key").alias("key")).select("key", "many", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")))
    packs = (group.agg(F.sum("many")).first()[0] or 0) // PACK + 1
    met = met.join(group.drop("many"), "key").join(classes.select("h1", "class_id", "n_shingles", "counts"), "h1")
    met = met.withColumn("block", F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("blocks")).cast("int"))
    packed = F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("key"), F.lit(packs)).cast("string")))
    met = met.withColumn("tasks", F.when(F.col("blocks") == 1, packed).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws(":", F.lit("f"), F.col("key").cast("string"), F.least(F.col("block"), j).cast("string"), F.greatest(F.col("block"), j).cast("string")))))

    def candidates(_task, table):
        """As few candidate pairs as connect what all candidate pairs of the task connect."""
        table = table.combine_chunks()
        key, ids, sizes = (table.column(c).to_numpy() for c in ("key", "class_id", "n_shingles"))
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
        by = np.lexsort((ids, key))
        edges = np.flatnonzero(np.concatenate(([True], key[by][1:] != key[by][:-1], [True])))
        names, place = np.unique(ids, return_inverse=True)

        def pairs():
            for i, j in near_small(counts, sizes, by, edges, percent):
                yield from zip(place[i].tolist(), place[j].tolist(), strict=True)
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if end - start <= SMALL:
                    continue
                own = by[start:end]
                for i, js in near(counts[own], sizes[own], percent):
                    at = int(place[own[i]])
                    yield from ((at, j) for j in place[own[js]].tolist())

        tree = _forest(pairs(), len(names))
        return pa.table({"doc_id": pa.array([int(names[i]) for i, _ in tree], pa.int64()), "head": pa.array([int(names[j]) for _, j in tree], pa.int64())})

    held_keys = met.select(F.explode("tasks").alias("task"), "key", "class_id", "n_shingles", "counts")
    shares = held_keys.groupBy("task").applyInArrow(candidates, "doc_id long, head long")
    families = components(shares, "doc_id", "head")
    sizes = families.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = cut(families.join(sizes, "component").select(F.col("vertex").alias("doc_id"), "component", "blocks"))
    bins = member.where("blocks = 1").count() // (BLOCK // 2) + 1
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    alone = F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(bins)).cast("string")))
    name = lambda j: F.concat_ws(":", F.lit("f"), F.col("component").cast("string"), F.least(F.col("block"), j).cast("string"), F.greatest(F.col("block"), j).cast("string"))
    member = member.withColumn("block", block)
    member = member.withColumn("tasks", F.when(F.col("blocks") == 1, alone).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), name)))
    member = member.join(classes.select(F.col("class_id").alias("doc_id"), "class_n", "h1"), "doc_id").select("doc_id", "block", "tasks", "class_n", "h1")

    def gather(batches):
        for batch in batches:
            found = [shingles(t, n) for t in raw(batch.column(0))]
            keep = [bool(len(s)) and fingerprint(s) == h for s, h in zip(found, batch.column(5).to_pylist(), strict=True)]
            rest = batch.select(["doc_id", "block", "tasks", "class_n"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([s.astype(np.int64) for s, k in zip(found, keep, strict=True) if k], pa.list_(pa.int64()))], names=["doc_id", "block", "tasks", "class_n", "tokens"])

    text_of = texts.join(member, "doc_id").select("text", "doc_id", "block", "tasks", "class_n", "h1")
    held = text_of.mapInArrow(gather, "doc_id long, block int, tasks array<string>, class_n long, tokens array<long>")
    held = held.select(F.explode("tasks").alias("task"), "doc_id", "block", "class_n", "tokens")

    def compare(key, table):
        table = table.combine_chunks()
        ids, blocks, weight = (table.column(c).to_numpy() for c in ("doc_id", "block", "class_n"))
        lists = table.column("tokens").combine_chunks()
        flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        found = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        name = key[0].as_py().split(":")
        degree = np.zeros(len(ids), np.int64)

        def pairs():
            for i, j in verify(found, blocks, rare.value, percent, name[0] == "f" and name[2] != name[3]):
                degree[i] += weight[j]
                degree[j] += weight[i]
                yield i, j

        tree = _forest(pairs(), len(ids))
        some = np.flatnonzero(degree)
        a = [int(ids[i]) for i, _ in tree] + [int(x) for x in ids[some]]
        b = [int(ids[j]) for _, j in tree] + [None] * len(some)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([0] * len(tree) + [int(x) for x in degree[some]], pa.int64())})

    return cut(held.groupBy("task").applyInArrow(compare, "a long, b long, n long"))


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
    sized AS (SELECT doc_id, len(s)::BIGINT AS n, s FROM sets),
    grams AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    both_ways AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
    reach AS (SELECT doc_id AS v, doc_id AS r FROM sized UNION SELECT e.y, r FROM reach JOIN both_ways e ON e.x = v),
    comps AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
    links AS (SELECT x, count(*) AS n_links FROM both_ways GROUP BY x),
    same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN n = 0 THEN 'id ' || doc_id ELSE list_sort(s)::VARCHAR END) AS class_id FROM sized)
SELECT s.doc_id, s.n AS n_shingles, component_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM sized s JOIN comps ON comps.v = s.doc_id JOIN same USING (doc_id) LEFT JOIN links ON links.x = s.doc_id
"""
