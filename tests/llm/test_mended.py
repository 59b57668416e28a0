"""Cases that earlier versions of the corpus operators got wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import ann, substring


def test_repeats_of_one_id_are_told_apart_by_whole_hashes(spark):
    """Two texts of one id whose hashes share their first 31 bits: only the one that begins earlier elsewhere loses words."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda j: F.concat(F.lit("w"), F.col("id"), F.lit("x"), j)), " ")
    texts = spark.range(200000).select(words.alias("text")).withColumn("h", F.shiftright(F.xxhash64("text"), 33))
    pair = texts.groupBy("h").agg(F.sort_array(F.collect_list("text")).alias("t")).where("size(t) > 1").orderBy("h").first()["t"]
    docs = spark.createDataFrame([(1, pair[0]), (5, pair[0]), (5, pair[1])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(docs).collect()) == [(1, 0), (5, 0), (5, 26)]
    # without ids texts are ordered by hash: one of the two that begin alike stays whole, and so does the other text
    docs = spark.createDataFrame([(None, pair[0] + " z"), (None, pair[0]), (None, pair[1])], "doc_id long, text string")
    got = {r["kept"]: r["n_removed"] for r in substring.remove_repeats(docs).collect()}
    assert got[pair[1]] == 0 and sorted(got.values()) == [0, 0, 26]


def near(v, every=100, k=10):
    """Brute force in double precision."""
    out = set()
    for q in range(0, len(v), every):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        out |= {(q, int(i)) for i in [x for x in np.lexsort((np.arange(len(v)), d)) if x != q][:k]}
    return out


def found(spark, v, **how):
    rows = ann.search(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>"), **how).collect()
    return {(r["query_id"], r["vec_id"]) for r in rows}


@pytest.mark.parametrize("times", [1.0, 1e20, 1e-30])
def test_nearest_in_tight_clusters_of_any_magnitude(spark, times):
    rng = np.random.default_rng(5)
    v = times * (rng.normal(size=(100, 1, 32)) + 1e-3 * rng.normal(size=(100, 20, 32))).reshape(-1, 32)
    got, want = found(spark, v), near(v)
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_nearest_in_small_tables_are_all(spark):
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 12):
        v = (rng.normal(size=(3, 1, 8)) + 1e-6 * rng.normal(size=(3, 4, 8))).reshape(-1, 8)[:n]
        v[0, 0] = 1e20 if n == 7 else v[0, 0]
        assert found(spark, v, every=5) == near(v, every=5)


def test_every_vector_can_be_reached():
    rng = np.random.default_rng(7)
    tables = [(rng.normal(size=(3, 1, 8)) + 1e-6 * rng.normal(size=(3, 4, 8))).reshape(-1, 8) for _ in range(30)]
    tables += [rng.normal(size=(3000, 48)), (rng.normal(size=(300, 1, 16)) + 1e-5 * rng.normal(size=(300, 10, 16))).reshape(-1, 16), rng.normal(size=(1, 4))]
    for v in tables:
        graph, entries = ann.build(ann.scaled(v, np.abs(v).max()))
        assert graph.shape[1] == ann.DEGREE + ann.SPARE and len(set(entries.tolist())) == len(entries)
        todo, reached = set(entries.tolist()), set()
        while todo:
            node = todo.pop()
            reached.add(node)
            todo |= {int(x) for x in graph[node] if x >= 0} - reached
        assert len(reached) == len(v)


def test_recall_in_one_large_graph():
    """20,000 vectors of 24 dimensions in one shard: the beam grows with it."""
    v = np.random.default_rng(8).normal(size=(20000, 24))
    graph, entries = ann.build(v)
    asked, norms = v[::100], np.einsum("ij,ij->i", v, v)
    ids, _ = ann.beam_search(v, norms, graph, entries, asked, ann.width(len(v)))
    want = np.argsort(norms[None, :] - 2 * asked @ v.T, axis=1)[:, :11]
    assert np.mean([len(set(a[:11]) & set(b)) / 11 for a, b in zip(ids.tolist(), want.tolist(), strict=True)]) >= 0.9
