"""Shared pieces: lineage cuts, word hashing on raw bytes, and Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and \\x09-\\x0D; bytes.split() splits on exactly those.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = -(2**63)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder of spark.checkpoint.dir.

    Where none is set a local master gets a folder under the warehouse; a cluster has to name one that all its machines share.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint()


def bounded(df: DataFrame, rows: int = 1000, size: int = 2**23) -> DataFrame:
    """df, in a session whose Arrow batches hold at most so many rows and about so many bytes; smaller settings stay."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = int(conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b"))
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


def columns(df: DataFrame, *names: str, carry: bool = False) -> DataFrame:
    """The first column of exactly each name, found by its place, so that others (`Text` beside `text`) cannot interfere.

    carry: also `rest`, a struct of all columns, for restored().
    """
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    own = [F.col(f"c{df.columns.index(n)}").alias(n) for n in names]
    return flat.select(*own, *([F.struct(*flat.columns).alias("rest")] if carry else []))


def restored(df: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of `like` out of `rest`, those in `new` (by name, the first of it) replaced."""
    at = {like.columns.index(n): value for n, value in new.items()}
    return df.select(*[at.get(i, F.col(f"rest.c{i}")).alias(f"c{i}") for i in range(len(like.columns))]).toDF(*like.columns)


def id_key(col: str = "doc_id") -> Column:
    """doc_id for sorting and joining; null counts as the smallest id."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null, in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def raw(column: pa.Array) -> list:
    """Values of a string column as UTF-8 bytes (None stays None)."""
    return column.cast(pa.large_binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values of h (len(h) - n + 1 results)."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return mix(out)
