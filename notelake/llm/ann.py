"""Approximate nearest neighbours over a robust-pruned directed graph per shard.

Equal vectors form one class, which is indexed once and answers with its smallest ids. Classes are dealt to shards of
bounded size by hash. In each shard a graph grows from random edges: greedy searches from the nearest of the shard's
entries (its medoid and vectors far apart) propose neighbours, relaxed distance pruning (alpha) keeps diverse ones, and
back edges are pruned alike (Subramanya et al., 2019). What no edge leads to gets one from a near vector that has one to
spare, or becomes an entry. A beam search in every shard, wider in larger ones, answers each block of queries; the few
hits are ranked by exact distances. Distances are double throughout, of vectors scaled by a power of two.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without id, take no
part; rows that repeat id and vector count once; a query's own id is never a hit, copies of it under other ids are;
vectors of another length are out of reach; equal distances go to the smaller id; extra columns do not matter; empty table -
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, cut

SHARD = 200_000  # classes of a shard at most, or about so
LEAST = 8  # shards, if there are 2,048 classes for each
BLOCK = 256  # queries that advance together
ASKED = 8192  # queries of a task
DEGREE = 24
SPARE = 8  # further edges of a vector, to those that nothing else leads to
BEAM = 64
WIDEN = 2048  # vectors of a shard from which on the beam grows, with the square root of their number
ALPHA = 1.2
MEASURED = 4_000_000  # distances within pools held at a time


def beam_search(vectors: np.ndarray, norms: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of each query's beam, nearest first; all queries advance together. graph: -1 is no edge.

    Every query is measured against all entries and sets out from the nearest of them.
    """
    n, q = len(vectors), len(queries)
    beam = min(beam, n)
    qn = np.einsum("ij,ij->i", queries, queries)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf)
    far = qn[:, None] + norms[entries] - 2 * queries @ vectors[entries].T
    near = np.argsort(far, axis=1, kind="stable")[:, : max(1, beam // 2)]
    ids[:, : near.shape[1]] = entries[near]
    dist[:, : near.shape[1]] = np.take_along_axis(far, near, 1)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    seen[rows[:, None], entries[near]] = True
    while True:
        open_ = np.where(done | (ids < 0), np.inf, dist)
        pick = open_.argmin(axis=1)
        live = np.flatnonzero(np.isfinite(open_[rows, pick]))
        if not len(live):
            return ids, dist
        done[live, pick[live]] = True
        next_ = graph[ids[live, pick[live]]]
        fresh = (next_ >= 0) & ~seen[live[:, None], np.maximum(next_, 0)]
        r, c = np.nonzero(fresh)
        to = next_[r, c]
        seen[live[r], to] = True
        d = np.full(next_.shape, np.inf)
        d[r, c] = qn[live[r]] + norms[to] - 2 * np.einsum("ij,ij->i", queries[live[r]], vectors[to])
        all_d = np.concatenate((dist[live], d), axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, keep, 1)
        ids[live] = np.where(np.isfinite(dist[live]), np.take_along_axis(np.concatenate((ids[live], next_), axis=1), keep, 1), -1)
        done[live] = np.take_along_axis(np.concatenate((done[live], np.zeros(next_.shape, bool)), axis=1), keep, 1)


def robust_prune(vectors: np.ndarray, norms: np.ndarray, nodes: np.ndarray, pool: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Per node at most `degree` of its pool (-1: none): the nearest first, dropping what a kept one reaches at 1/alpha of the way."""
    if len(nodes) > 1 and pool.size * pool.shape[1] > MEASURED:
        half = len(nodes) // 2
        return np.concatenate([robust_prune(vectors, norms, nodes[x], pool[x], alpha, degree) for x in (slice(half), slice(half, None))])
    pool = np.where(pool == nodes[:, None], -1, pool)
    at = np.maximum(pool, 0)
    d = norms[nodes][:, None] + norms[at] - 2 * np.einsum("ij,ikj->ik", vectors[nodes], vectors[at])
    d = np.where(pool < 0, np.inf, np.maximum(d, 0))
    by = np.argsort(d, axis=1, kind="stable")
    pool, d, at = (np.take_along_axis(x, by, 1) for x in (pool, d, at))
    own = norms[at]
    apart = own[:, :, None] + own[:, None, :] - 2 * (vectors[at] @ vectors[at].transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        j = d.argmin(axis=1)
        ok = np.isfinite(d[rows, j])
        if not ok.any():
            break
        star = pool[rows, j]
        out[ok, k] = star[ok]
        d = np.where((alpha * alpha * apart[rows, j] <= d) | (pool == star[:, None]), np.inf, d)
    return out


def scaled(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors by the power of two that brings `top`, the largest component, to about 1: squares cannot overflow, and no bit is lost."""
    return np.ldexp(vectors, -int(np.frexp(top)[1]))


def spread_out(vectors: np.ndarray, norms: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Entries: the medoid, then ever the vector farthest from those chosen, some 4 * sqrt(n) in all; of many vectors a random part is looked at."""
    n = len(vectors)
    many = min(n, int(4 * np.sqrt(n)) + 1)
    start = int((norms - 2 * vectors @ vectors.mean(axis=0)).argmin())
    some = np.unique(np.append(rng.permutation(n)[: 16 * many], start))
    part, own = vectors[some], norms[some]
    chosen, gap = [int(np.searchsorted(some, start))], np.full(len(some), np.inf)
    while True:
        last = chosen[-1]
        gap = np.minimum(gap, own + own[last] - 2 * part @ part[last])
        gap[last] = -np.inf
        if len(chosen) == many:
            return some[chosen]
        chosen.append(int(gap.argmax()))


def reachable(graph: np.ndarray, entries: np.ndarray, seen: np.ndarray) -> None:
    """Marks in `seen` what the graph leads to from entries."""
    front = entries
    seen[front] = True
    while len(front):
        front = np.unique(graph[front])
        front = front[front >= 0]
        front = front[~seen[front]]
        seen[front] = True


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) over scaled vectors; deterministic. From the entries the graph leads to every vector."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    entries = spread_out(vectors, norms, rng)
    graph = np.full((n, degree), -1, np.int64)
    first = min(degree // 2, n - 1)
    if first > 0:
        graph[:, :first] = (np.arange(n)[:, None] + 1 + np.argsort(rng.random((n, max(1, min(n - 1, 64)))), axis=1)[:, :first] * max(1, (n - 1) // 64)) % n
        graph[:, :first] = np.where(graph[:, :first] == np.arange(n)[:, None], -1, graph[:, :first])
    for batch in np.array_split(rng.permutation(n), max(1, n // BLOCK)):
        found, _ = beam_search(vectors, norms, graph, entries, vectors[batch], beam)
        graph[batch] = robust_prune(vectors, norms, batch, np.concatenate((found, graph[batch]), axis=1), alpha, degree)
        into, back = graph[batch].ravel(), np.repeat(batch, degree)
        into, back = into[into >= 0], back[into >= 0]
        by = np.argsort(into, kind="stable")
        into, back = into[by], back[by]
        heads, begin, count = np.unique(into, return_index=True, return_counts=True)
        for lo in range(0, len(heads), BLOCK):
            h, b, c = heads[lo : lo + BLOCK], begin[lo : lo + BLOCK], count[lo : lo + BLOCK]
            extra = np.full((len(h), c.max()), -1, np.int64)
            inside = np.arange(c.max())[None, :] < c[:, None]
            extra[inside] = back[np.concatenate([np.arange(x, x + y) for x, y in zip(b, c, strict=True)])]
            extra = np.where((extra[:, :, None] == graph[h][:, None, :]).any(axis=2), -1, extra)
            graph[h] = robust_prune(vectors, norms, h, np.concatenate((graph[h], extra), axis=1), alpha, degree)
    seen, spare, more = np.zeros(n, bool), np.full((n, SPARE), -1, np.int64), []
    reachable(graph, entries, seen)
    for node in np.flatnonzero(~seen).tolist():
        if seen[node]:
            continue
        for near in graph[node][graph[node] >= 0].tolist():  # the nearest first
            if seen[near] and spare[near, -1] < 0:
                spare[near, (spare[near] >= 0).sum()] = node
                break
        else:
            more.append(node)
        reachable(graph, np.array([node]), seen)
    return np.concatenate((graph, spare), axis=1), np.append(entries, np.array(more, np.int64))


def width(n: int, beam: int = BEAM) -> int:
    """The beam of a query in a shard of n vectors."""
    return max(beam, int(beam * np.sqrt(n / WIDEN)))


def search(rows: DataFrame, every: int = 100, k: int = 10, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """Per query (rows whose vec_id is divisible by `every`): query_id, rank, vec_id, score of its k nearest found."""
    v = columns(rows, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(sound)
    v = v.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct()  # -0.0 is 0.0
    # equal vectors: the k + 1 smallest ids of a class are all that any query can be given
    first = v.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    classes = cut(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.xxhash64("v", F.col("ids")[0])))
    many = classes.count()
    shards = max(many // shard + 1, min(LEAST, many // 2048))
    deal = F.pmod("class", F.lit(shards)).cast("int")

    def graphs(key, table):
        lists = table.column("v").combine_chunks()
        order = np.argsort(table.column("class").to_numpy())
        vectors = lists.values.to_numpy().reshape(len(order), -1)[order]
        graph, entries = build(scaled(vectors, np.abs(vectors).max()))
        return pa.table({"shard": [key[0].as_py()], "dim": [key[1].as_py()], "entries": [entries.tobytes()], "class": [table.column("class").to_numpy()[order].tobytes()], "vectors": [vectors.tobytes()], "graph": [graph.astype(np.int32).tobytes()]}, schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("entries", pa.binary()), ("class", pa.binary()), ("vectors", pa.binary()), ("graph", pa.binary())]))

    index = classes.select(deal.alias("shard"), F.size("v").alias("dim"), "class", "v").groupBy("shard", "dim").applyInArrow(graphs, "shard int, dim int, entries binary, class binary, vectors binary, graph binary")
    index = cut(index)
    asked = cut(v.where(F.col("vec_id") % every == 0).groupBy("v").agg(F.collect_set("vec_id").alias("query_ids")).withColumn("query", F.xxhash64("v")).select("query", "v", F.explode("query_ids").alias("query_id")))
    once = asked.select("query", "v").distinct()
    blocks = once.count() // ASKED + 1  # each block travels to every shard, and every shard to each block
    once = once.withColumn("block", F.pmod("query", F.lit(blocks)).cast("int")).select("query", "v", F.size("v").alias("dim"), "block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def hits(key, left, right):
        out = {"query": [], "class": [], "d": []}
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            vectors = np.frombuffer(right.column("vectors")[0].as_py()).reshape(-1, dim)
            graph = np.frombuffer(right.column("graph")[0].as_py(), np.int32).reshape(len(vectors), -1).astype(np.int64)
            names = np.frombuffer(right.column("class")[0].as_py(), np.int64)
            queries = left.column("v").combine_chunks().values.to_numpy().reshape(-1, dim)
            entries = np.frombuffer(right.column("entries")[0].as_py(), np.int64)
            top = max(np.abs(vectors).max(), np.abs(queries).max())
            small, near_to = scaled(vectors, top), scaled(queries, top)
            norms = np.einsum("ij,ij->i", small, small)
            query = left.column("query").to_pylist()
            for lo in range(0, len(queries), BLOCK):
                found, _ = beam_search(small, norms, graph, entries, near_to[lo : lo + BLOCK], width(len(vectors), beam))
                d2 = np.concatenate([((small[np.maximum(row, 0)] - x) ** 2).sum(axis=1)[None, :] for row, x in zip(found, near_to[lo : lo + BLOCK], strict=True)])
                near = np.argsort(np.where(found < 0, np.inf, d2), axis=1, kind="stable")[:, : k + 1]
                for q, row, d in zip(query[lo : lo + BLOCK], np.take_along_axis(found, near, 1), np.take_along_axis(d2, near, 1), strict=True):
                    ok = row >= 0
                    out["query"] += [q] * int(ok.sum())
                    out["class"] += names[row[ok]].tolist()
                    out["d"] += np.ldexp(np.sqrt(d[ok]), int(np.frexp(top)[1])).tolist()  # comparable between shards
        return pa.table({"query": pa.array(out["query"], pa.int64()), "class": pa.array(out["class"], pa.int64()), "d": pa.array(out["d"], pa.float64())})

    found = once.groupBy("shard", "dim", "block").cogroup(copies.groupBy("shard", "dim", "block")).applyInArrow(hits, "query long, class long, d double")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("d", "class"))).where(F.col("nth") <= k + 1)
    near = best.select("query", "class").join(classes.select("class", "ids", F.col("v").alias("w")), "class").join(asked.select("query", "query_id", "v"), "query")
    # the exact measure, added up in the order of the components
    exact = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = near.select("query_id", exact.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, min(sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
