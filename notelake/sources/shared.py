"""The folder that the driver and all executors share, and lineage cuts in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; a local master without that setting gets one below the warehouse."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    root = root if ":" in root or spark.conf.get("spark.hadoop.fs.defaultFS", "file:///") != "file:///" else f"file://{root}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written and read again: what follows neither repeats its work nor carries its plan."""
    at = folder(df.sparkSession, "cut")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
