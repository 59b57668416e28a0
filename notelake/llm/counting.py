"""Document counts of hashed tokens in a fixed number of buckets, over all documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CHUNKS = 256
FAN_IN = 256


class Tally:
    """A task's counts of hashed tokens in 2**bits buckets, as rows that total() adds up. A token's bucket is the top `bits` bits of its hash."""

    def __init__(self, bits: int):
        self.shift, self.counts = np.uint64(64 - bits), np.zeros(2**bits, np.int64)

    def add(self, found: list[np.ndarray]) -> None:
        if found:
            self.counts += np.bincount((np.concatenate(found) >> self.shift).astype(np.int64), minlength=len(self.counts))

    def rows(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        """chunk, part and counts; none if nothing was counted."""
        parts = [zlib.compress(x.tobytes(), 1) for x in self.counts.astype(np.uint32).reshape(CHUNKS, -1)] if self.counts.any() else []
        part = TaskContext.get().partitionId() // FAN_IN
        return pa.array(range(len(parts)), pa.int32()), pa.array([part] * len(parts), pa.int32()), pa.array(parts, pa.binary())


def total(parts: DataFrame, bits: int) -> np.ndarray:
    """int64[2**bits]: the sum of the tallies in parts (chunk int, part int, counts binary).

    Arrays are summed FAN_IN at a time on the executors, and the driver receives 2**bits numbers whatever the input.
    """
    size, schema = 2**bits // CHUNKS, "chunk int, part int, counts binary"

    def fold(kind):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(size, np.int64)
            for x in pdf["counts"]:
                out += np.frombuffer(zlib.decompress(x), kind)
            return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [0], "counts": [zlib.compress(out.tobytes(), 1)]})

        return run

    parts = parts.groupBy("chunk", "part").applyInPandas(fold(np.uint32), schema)
    parts = parts.groupBy("chunk").applyInPandas(fold(np.int64), schema)
    out = np.zeros((CHUNKS, size), np.int64)
    for row in parts.collect():  # CHUNKS rows of a fixed size
        out[row["chunk"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return out.reshape(-1)


def bucket_counts(docs: DataFrame, tokens: Callable[[bytes], np.ndarray], bits: int = 20) -> np.ndarray:
    """int64[2**bits]: sum over the rows of docs (one column, text) of how often tokens(text) falls in each bucket. Null texts count nothing."""

    def add(batches):
        tally = Tally(bits)
        for batch in batches:
            tally.add([tokens(t) for t in batch.column(0).cast(pa.large_binary()).to_pylist() if t])
        yield pa.RecordBatch.from_arrays(list(tally.rows()), names=["chunk", "part", "counts"])

    return total(docs.mapInArrow(add, "chunk int, part int, counts binary"), bits)
