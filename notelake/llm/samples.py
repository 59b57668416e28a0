"""A bounded sample of labelled texts to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """(text, y): at most `bound` distinct labelled texts, chosen by hash of the text; usable filters on doc_id.

    Rows without id, text or label are left out; of several labels the largest holds; equal texts count once.
    """
    mark = columns(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    mark = mark.where(usable).groupBy("doc_id").agg(F.max("y").alias("y"))
    text = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    keyed = text.select("doc_id", F.xxhash64("text").alias("th")).join(mark, "doc_id")
    chosen = keyed.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")).orderBy(F.xxhash64("th"), "th").limit(bound)
    # at most `bound` ids
    return text.join(F.broadcast(chosen.select("doc_id", "th", "y")), "doc_id").where(F.xxhash64("text") == F.col("th")).dropDuplicates(["doc_id"]).select("text", "y")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(parts))
