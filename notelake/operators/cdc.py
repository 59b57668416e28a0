"""Change data capture: set differences and replay of an add/update/delete log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame, key: str, values: list[str], seq: str | None = None) -> DataFrame:
    """(key, values, operation) of what changed: one full outer join. Of rows that repeat a key the last by seq counts, or, without seq,
    the one with the greatest values."""

    def last(df: DataFrame) -> DataFrame:
        held = F.struct(*values)
        return df.groupBy(key).agg((F.max(held) if seq is None else F.max_by(held, F.struct(seq, held))).alias("l")).select(key, "l.*")

    p = last(previous).select(F.col(key), *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("was"))
    n = last(current).select(F.col(key), *values, F.lit(True).alias("is"))
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.col(f"old_{v}"))
    op = F.when(F.col("was").isNull(), "add").when(F.col("is").isNull(), "delete").when(changed, "update")
    out = p.join(n, key, "full_outer").withColumn("operation", op).where("operation is not null")
    return out.select(key, *[F.when(F.col("operation") == "delete", F.col(f"old_{v}")).otherwise(F.col(v)).alias(v) for v in values], "operation")


def replay(log: DataFrame, key: str, seq: list[str], operation: str, values: list[str]) -> DataFrame:
    """The state after the log: per key the last upsert's values after its last delete, and the place it keeps.

    One shuffle on the key; aggregates combine before it, so a key with very many changes is one row a task.
    """
    at: Column = F.struct(*seq)
    upsert = F.col(operation).isin("add", "update")
    # each key's first upsert after its last delete sets its place: the suffix minimum is found with two aggregates
    gone = log.where(F.col(operation) == "delete").groupBy(key).agg(F.max(at).alias("gone"))
    alive = log.where(upsert).withColumn("at", at).join(gone, key, "left").where(F.col("gone").isNull() | (F.col("at") > F.col("gone")))
    return alive.groupBy(key).agg(*[F.max_by(v, "at").alias(v) for v in values], F.min("at").alias("place"), F.max("at").alias("changed"))


def tail(log: DataFrame, name: str, commit: str, checkpoint: str) -> DataFrame:
    """Rows of the files after the first whose commit is the checkpoint; none without such a file."""
    start = log.where(F.col(commit) == checkpoint).agg(F.min(name).alias("start"))
    return log.join(F.broadcast(start), F.col(name) > F.col("start")).where(F.col(commit) != checkpoint).drop("start")  # one row


def merge(current: DataFrame, changes: DataFrame, key: str, values: list[str], keep_old: bool = False) -> DataFrame:
    """Upsert and delete by a full outer join; keep_old: a null in the change leaves the old value."""
    new = changes.select(key, *[F.col(v).alias(f"new_{v}") for v in values], F.col("operation"))
    out = current.select(key, *values).join(new, key, "full_outer").where(F.coalesce(F.col("operation") != "delete", F.lit(True)))
    pick = lambda v: F.when(F.col("operation").isNull(), F.col(v)).otherwise(F.coalesce(F.col(f"new_{v}"), F.col(v)) if keep_old else F.col(f"new_{v}"))
    return out.select(key, *[pick(v).alias(v) for v in values])


def orphans_removed(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Rows of parents that some child refers to."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_semi")
