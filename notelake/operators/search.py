"""Exact filtered vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, similarity
from ..sources.shared import cut

SLICE, BLOCK = 8_192, 4_096  # notes and queries, about, that meet in one task
ASKED = 256  # queries of a matrix product: 16 MB of products
PAIRS = 1 << 16  # pairs whose cosines are taken exactly together
MARGIN = 1e-9


def nearest(notes: DataFrame, query: list[float], k: int = 5, where: Column | None = None, id_col: str = "item_id", vector: str = "embedding") -> DataFrame:
    """k nearest by cosine after the filter, which reaches the scan; ties by id. One TakeOrderedAndProject, no shuffle of vectors."""
    rows = notes if where is None else notes.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    cos = cosine(vector, q)
    return rows.withColumn("cosine", cos).where("cosine is not null").withColumn("similarity", similarity(F.col("cosine"))).orderBy(F.desc("cosine"), id_col).limit(k)


def _matrix(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each length of the vectors; those null or with a null component are left out."""
    rows = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(rows)
    if flat.null_count:
        length[np.unique(pc.list_parent_indices(rows).to_numpy()[pc.is_null(flat).to_numpy(zero_copy_only=False)])] = -1
    out = []
    for n in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == n)
        own = rows if len(at) == len(rows) else rows.take(pa.array(at))
        out.append((at, pc.list_flatten(own).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)))
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in array order as functions.vectors does, so that equal vectors have equal products."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _best(asked: pa.ChunkedArray, held: pa.ChunkedArray, ids: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, note row, cosine, whether it is null): the k of each query, cosines that are null last.

    A matrix product finds, with a margin far above its error, what can be among the k; their cosines are then taken exactly.
    """
    n = len(held)
    place = np.empty(n, np.int64)
    place[pc.sort_indices(ids.combine_chunks()).to_numpy()] = np.arange(n)
    found = []
    notes = {m.shape[1]: (at, m, np.sqrt(_in_order(m, m))) for at, m in _matrix(held)}
    known = []
    for rows, vectors in _matrix(asked):
        if vectors.shape[1] not in notes:
            continue
        at, m, norms = notes[vectors.shape[1]]
        own = np.sqrt(_in_order(vectors, vectors))
        for start in range(0, len(rows), ASKED):
            some, size = vectors[start : start + ASKED], own[start : start + ASKED]
            with np.errstate(all="ignore"):
                near = (some @ m.T) / (size[:, None] * norms)
            near[~np.isfinite(near)] = np.inf  # judged exactly
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(some), -np.inf)
            # what is not finite must not push others out
            odd = np.isinf(near).any(axis=1)
            least[odd] = -np.inf
            i, j = np.nonzero(near >= least[:, None] - MARGIN)
            for part in range(0, len(i), PAIRS):
                a, b = i[part : part + PAIRS], j[part : part + PAIRS]
                with np.errstate(all="ignore"):
                    both = size[a] * norms[b]
                    cos = _in_order(some[a], m[b]) / both
                null = ~((both > 0) | np.isnan(both))
                known.append((rows[start + a], at[b], cos, null))
    q, j, cos, null = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
    q, j, cos, null = q[~null], j[~null], cos[~null], null[~null]
    few = np.bincount(q, minlength=len(asked)) < k  # of those, notes without a cosine follow
    for row in np.flatnonzero(few).tolist():
        rest = np.setdiff1d(np.arange(n), j[q == row])
        rest = rest[np.argsort(place[rest])][:k]
        found.append((np.full(len(rest), row), rest, np.zeros(len(rest)), np.ones(len(rest), bool)))
    q, j, cos, null = (np.concatenate(x) for x in zip((q, j, cos, null), *found, strict=True))
    key = np.where(null, -np.inf, np.where(np.isnan(cos), np.inf, cos))
    by = np.lexsort((place[j], -key, q))
    q = q[by]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    by = by[nth < k]
    return q[nth < k], j[by], cos[by], null[by]


def nearest_many(notes: DataFrame, queries: DataFrame, k: int, partition: str, id_col: str = "item_id", vector: str = "embedding") -> DataFrame:
    """(query_id, partition, id, cosine, rank): k nearest in the same partition for each query (query_id, partition, query_vector).

    Exact: every pair is measured, SLICE notes and BLOCK queries a task. Work grows with queries times notes; a task's memory does not.
    """
    p = F.col(partition)
    sizes = notes.groupBy(partition).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    blocks = queries.groupBy(partition).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    plan = cut(sizes.join(blocks, partition))  # a row a partition
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = notes.where(p.isNotNull()).select(partition, id_col, vector).join(plan, partition)
    left = left.withColumn("slice", F.pmod(F.xxhash64(id_col), F.col("slices")).cast("int")).withColumn("block", each("blocks")).select(partition, "block", "slice", id_col, vector)
    right = queries.where(p.isNotNull()).select("query_id", partition, "query_vector").join(plan, partition)
    right = right.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("slice", each("slices")).select(p.alias("own"), "block", "slice", "query_id", "query_vector")
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (notes, partition), (notes, id_col))}

    def measure(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(held) or not len(asked):
            q = j = np.zeros(0, np.int64)
            cos, null = np.zeros(0), np.zeros(0, bool)
        else:
            q, j, cos, null = _best(asked.column("query_vector"), held.column(vector), held.column(id_col), k)
        return pa.table({"query_id": asked.column("query_id").take(pa.array(q, pa.int64())), partition: held.column(partition).take(pa.array(j, pa.int64())), id_col: held.column(id_col).take(pa.array(j, pa.int64())), "cosine": pa.array(cos, pa.float64(), mask=null)})

    found = left.groupBy(partition, "block", "slice").cogroup(right.groupBy("own", "block", "slice")).applyInArrow(measure, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def without_deleted(notes: DataFrame, deleted: DataFrame, id_col: str = "item_id") -> DataFrame:
    return notes.join(deleted, id_col, "left_anti")


def selectivity(notes: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """total, rows each filter and all of them keep, and the reduction in per cent, in one pass."""
    every = None
    for f in filters.values():
        every = f if every is None else every & f
    out = notes.agg(F.count("*").alias("total"), *[F.count_if(f).alias(f"n_{n}") for n, f in filters.items()], F.count_if(every).alias("filtered"))
    return out.withColumn("reduction", F.when(F.col("total") > 0, F.round(100.0 * (F.col("total") - F.col("filtered")) / F.col("total"), 6)).otherwise(0.0))
