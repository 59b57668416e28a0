"""A corpus pipeline of five stages, each one operator over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) with docs in the columns of documents, and others if there are, and, but for the
last, returns all of them. Nulls in any column are kept; a null doc_id is an id of its own to every stage; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm import mixing, ngram_join, pieces, substring, toxicity
from notelake.llm.common import WORD, columns, cut, restored

#: No SQL: the first stage trains a model.
ORACLE_SQL = None
BUCKETS = 4096


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models call toxic go."""
    return toxicity.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words a shingle, similarity 0.8) the row with the smallest id stays, once.

    Rows that share an id and differ in text are judged by their own texts. Rows without id or without words are in no group: all stay.
    """
    rows = columns(docs, "doc_id", "text", carry=True).withColumns({"id": F.col("doc_id").cast("long"), "th": F.xxhash64("text")})
    alone = F.col("id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    rows = rows.withColumn("alone", alone).drop("doc_id")
    texts = rows.where("not alone").select("id", "th", "text")
    own = texts.select("id", "th").distinct()
    if own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        named, names = texts.select(F.col("id").alias("doc_id"), "text"), own.withColumn("doc_id", F.col("id"))
    else:  # ids that different texts share: texts are numbered, in buckets, and go by their numbers
        bucket = own.withColumn("bucket", F.pmod(F.xxhash64("id", "th"), F.lit(BUCKETS)))
        starts = bucket.groupBy("bucket").agg(F.count("*").alias("n"))
        starts = starts.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        nth = F.row_number().over(Window.partitionBy("bucket").orderBy("id", "th"))
        names = cut(bucket.withColumn("nth", nth).join(F.broadcast(starts), "bucket").select("id", "th", (F.col("start") + F.col("nth")).alias("doc_id")))  # a row a bucket
        named = texts.join(names, ["id", "th"]).select("doc_id", "text")
    groups = ngram_join.jaccard_groups(named, n=5, percent=80)
    # the least id of a group, whatever number its text goes by: both ways of naming keep the same rows
    heads = groups.select("doc_id", "component_id").join(names, "doc_id").groupBy("component_id").agg(F.min(F.struct("id", "th")).alias("head")).select("head.id", "head.th")
    once = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.xxhash64("rest")))
    first = rows.where("not alone").join(heads, ["id", "th"]).withColumn("nth", once).where("nth = 1")
    return restored(rows.where("alone").select("rest").unionByName(first.select("rest")), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a window of 20 words that begins earlier elsewhere go; texts without such words stay as they are."""
    done = substring.remove_repeats(docs, span=20, carry=True)
    return restored(done, docs, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    return mixing.emit(docs, weights=(3, 1, 2), share=1.5, most=2)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece sequences; lossless says that they decode to the text."""
    out = pieces.encode(docs, seed=1, digest=True, rest=("source", "lang"))
    return out.select("doc_id", "source", "lang", "n_pieces", "pieces_crc32", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix),
    ("pieces", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i + 1 < len(STAGES) else docs
    return docs
