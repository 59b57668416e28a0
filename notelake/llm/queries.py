"""The queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, media, mixing, ngram_join, pieces, pii, quality, resampling, sharding, substring, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), shards=40)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"), n=3, percent=90).drop("text_hash")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_counts(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), span=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images: every embedding is drawn as one, and those whose id is divisible by 50, cropped and regraded, are the queries, with
    some of the others cropped and turned by a quarter, or cropped and enlarged twofold. A query bears the id of its original."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = media.pictures(rows.where("id % 50 = 0"), crop=(3, 5), gain=0.8, offset=20)
    asked = asked.union(media.pictures(rows.where("id % 500 = 10"), crop=(3, 5), turns=1)).union(media.pictures(rows.where("id % 500 = 20"), crop=(3, 5), times=2))
    return media.by_image(media.copies(asked, media.pictures(rows)))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), seed=1, digest=True)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=30, depth=4, scale=2000000, percent=80, top=2000)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), lo=1, hi=1, buckets=10000, least=20, percent=10, seed=2024)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_media_copies": op8_media_copies,
    "op9_pieces": op9_pieces,
    "op10_nearest": op10_nearest,
    "op11_collocations": op11_collocations,
    "op12_pii": op12_pii,
    "op13_resampling": op13_resampling,
}
ORACLES = {"op1_sharding": sharding.oracle(40), "op2_ngram_jaccard": ngram_join.ORACLE, "op3_mixing": mixing.ORACLE, "op4_substring_dedup": substring.ORACLE, "op10_nearest": ann.ORACLE, "op11_collocations": collocations.ORACLE, "op13_resampling": resampling.ORACLE}
