"""The extraction log as a stream: the state of each item in the state store, its changes merged into a bucketed table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.buckets import Buckets
from ..sources.files import LOG

VALUES = ("book_title", "author_first_name", "author_last_name", "section", "content", "source_file", "date_read")
STATE = "gone_name string, gone_pos long, last_name string, last_pos long, " + ", ".join(f"{v} string" for v in VALUES)
CHANGE = "item_id string, operation string, name string, pos long, " + ", ".join(f"{v} string" for v in VALUES)
COLUMNS = ("item_id", "operation", "name", "pos", *VALUES)


def _place(name, pos) -> tuple[str, int]:
    """A place in the log; what is not known comes before all."""
    return ("", -1) if name is None or pos is None else (name, int(pos))


def latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a batch only what can matter: each item's last upsert and last delete, so that a hot item is two rows a batch."""
    for batch in batches:
        df = batch.to_pandas()
        df["ends"] = df["operation"] == "delete"
        kept = df.sort_values(["name", "pos"]).groupby(["item_id", "ends"], sort=False).tail(1)
        yield pa.RecordBatch.from_pandas(kept[list(COLUMNS)], schema=batch.schema, preserve_index=False)


def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One item: its last delete and last upsert by place in the log, and the upsert's values. A delete stays as a tombstone, so
    that an upsert from before it, in a file that comes late, cannot bring the item back. Yields the item's row if it changed."""
    held = state.get if state.exists else (None, None, None, None, *[None] * len(VALUES))
    gone, last, values = _place(*held[:2]), _place(*held[2:4]), tuple(held[4:])
    was = (last > gone, last, values)
    for df in rows:
        for row in df[["operation", "name", "pos", *VALUES]].itertuples(index=False, name=None):
            at = _place(row[1], row[2])
            if row[0] == "delete":
                gone = max(gone, at)
            elif at > last:
                last, values = at, tuple(None if x is None or x != x else x for x in row[3:])
    state.update((gone[0] or None, gone[1], last[0] or None, last[1], *values))
    now = (last > gone, last, values)
    if now != was:
        yield pd.DataFrame([(key[0], "upsert" if now[0] else "delete", *(last if now[0] else gone), *values)], columns=list(COLUMNS))


def changes(rows: DataFrame) -> DataFrame:
    """(item_id, operation, name, pos, values) of items whose state a batch of the streamed log changes."""
    rows = rows.where("item_id is not null").select(*[F.col(c).cast("long") if c == "pos" else F.col(c) for c in COLUMNS])
    return rows.mapInArrow(latest, CHANGE).groupBy("item_id").applyInPandasWithState(step, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)


def streamed(spark: SparkSession, directory: str, files: int = 1) -> DataFrame:
    """The log's files as they come, `files` a batch: name, pos and item columns."""
    raw = spark.readStream.schema(LOG).options(multiLine=True, pathGlobFilter="extraction_*.json", maxFilesPerTrigger=files).json(directory)
    return raw.select(F.col("_metadata.file_name").alias("name"), F.posexplode("items").alias("pos", "item")).select("name", "pos", "item.*")


def table(spark: SparkSession, root: str, buckets: int = 64) -> Buckets:
    return Buckets(spark, root, "item_id", buckets)


def drain(changed: DataFrame, to: Buckets, checkpoint: str, keep: int = 2) -> None:
    """Merge all that a stream of changes has now.

    A batch writes the buckets of the items that it changes. A batch that was committed and is run again after a crash writes
    nothing; one that was not is merged again from the same state.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            to.merge(batch, ["name", "pos", *VALUES], batch=n)
        finally:
            batch.unpersist()
        to.expire(keep)

    changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run(spark: SparkSession, directory: str, to: Buckets, checkpoint: str, files: int = 1, keep: int = 2) -> None:
    """Apply all new files of the log; each consumer has its own table and checkpoint."""
    drain(changes(streamed(spark, directory, files)), to, checkpoint, keep)


def windowed_counts(events: DataFrame, ts: str, late: str, width: str, key: str) -> DataFrame:
    """Counts a window and key of a stream or table, with rows later than `late` dropped on streams."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
