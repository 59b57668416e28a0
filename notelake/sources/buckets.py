"""Snapshot tables in hash buckets: a commit writes the buckets that change, and a pointer names the version of each."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .files import put
from .tables import Snapshots

BUCKET = "_bucket"


def _kinds(schema: str | None) -> list[tuple[str, str]]:
    """Names and types, whatever may be null."""
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromJson(json.loads(schema))] if schema else []


class Buckets(Snapshots):
    """A table as <root>/v=<n>/_bucket=<k>/: a version holds only the buckets that its commit wrote.

    A pointer lists, for every bucket that has rows, the version that wrote it, its rows and the sum of their hashes. What a
    commit writes follows what it changes, whatever the size of the table; what the driver holds is one entry a bucket. The rest
    is as in Snapshots: the highest whole pointer holds, a run that dies leaves the old one current, a batch counts once.
    The number of buckets is set by the first commit. A bucket is read and written by one task a file: choose it so that a bucket
    is some hundred megabytes.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        super().__init__(spark, root)
        self.key, self.buckets = key, buckets

    def _manifest(self, version: int | None = None) -> dict:
        """The pointer's whole content; version 0 and no parts before the first commit."""
        for n in [version] if version else self._pointers():
            try:
                held = json.loads(self.spark.read.text(f"{self.root}/_pointers/{n:012d}", wholetext=True).first()[0])
                return {"version": n, "batch": held["batch"], "info": held["info"], "schema": held["schema"], "buckets": held["buckets"], "parts": {int(k): v for k, v in held["parts"].items()}}
            except (ValueError, TypeError, KeyError):  # a writer died over it
                continue
        return {"version": 0, "batch": -1, "info": {}, "schema": None, "buckets": self.buckets, "parts": {}}

    def state(self) -> dict:
        held = self._manifest()
        return {k: held[k] for k in ("version", "batch", "info")}

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _rows(self, held: dict, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/v={v}/{BUCKET}={k}" for k, (v, _, _) in held["parts"].items() if only is None or k in only]
        schema = StructType.fromJson(json.loads(held["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        held = self._manifest(version)
        return self._rows(held) if held["version"] else None

    def _write(self, held: dict, changed: DataFrame, gone: list[int], batch: int, info: dict | None, schema: str) -> int:
        """changed: all rows of the buckets to write, with their bucket; gone: buckets that are left without rows."""
        version = max([0, *self._pointers()]) + 1
        out = f"{self.root}/v={version}"
        changed.repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(out)
        # sums over what was written, so that they hold whatever the plan would give when run again
        parts = {k: v for k, v in held["parts"].items() if k not in gone}
        fs, at = self._fs(), self._path(f"v={version}")
        if any(s.isDirectory() for s in fs.listStatus(at)):
            written = self.spark.read.schema(StructType.fromJson(json.loads(schema)).add(BUCKET, IntegerType())).parquet(out)
            for k, n, total in self._sums(written).collect():  # a row a bucket
                parts[k] = [version, n, str(total)]
        body = {"batch": max(batch, held["batch"]), "info": held["info"] if info is None else info, "schema": schema, "buckets": held["buckets"], "parts": parts}
        put(self.spark, f"{self.root}/_pointers/{version:012d}", json.dumps(body))
        return version

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        """(bucket, rows, sum of the hashes of rows)."""
        own = [F.to_json(c) if rows.schema[c].dataType.typeName() == "map" else F.col(f"`{c}`") for c in rows.columns if c != BUCKET]
        return rows.groupBy(BUCKET).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*own).cast("decimal(20, 0)")).alias("total"))

    def commit(self, df: DataFrame, batch: int = -1, info: dict | None = None) -> int:
        """df is the whole table; only buckets whose rows differ from the current version's are written."""
        held = self._manifest()
        if batch >= 0 and batch <= held["batch"]:
            return held["version"]
        schema = df.schema.json()
        rows = df.withColumn(BUCKET, self.bucket(held["buckets"]))
        if not held["version"]:
            return self._write(held, rows, [], batch, info, schema)
        sums = {k: [n, str(total)] for k, n, total in self._sums(rows).collect()}  # a row a bucket
        same = [k for k, (_, n, total) in held["parts"].items() if sums.get(k) == [n, total]] if _kinds(schema) == _kinds(held["schema"]) else []
        gone = [k for k in held["parts"] if k not in sums]
        if not gone and len(same) == len(sums) and info is None and batch < 0:
            return held["version"]
        return self._write(held, rows.where(~F.col(BUCKET).isin(same)) if same else rows, gone, batch, info, schema)

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: int = -1, info: dict | None = None) -> int:
        """change() turns the rows of the buckets that hold any of keys into their new rows; no other bucket is read or written.

        change() may add rows of those keys only, and has to keep the columns.
        """
        held = self._manifest()
        if batch >= 0 and batch <= held["batch"]:
            return held["version"]
        n = held["buckets"]
        touched = sorted(r[0] for r in keys.select(self.bucket(n).alias("b")).distinct().collect())  # at most a row a bucket
        old = self._rows(held, touched)
        new = change(old).select(*old.columns).withColumn(BUCKET, self.bucket(n))
        outside = F.raise_error(F.concat(F.lit("key outside the buckets that are rewritten: "), F.col(self.key).cast("string"))).cast("boolean")
        new = new.where(F.when(F.col(BUCKET).isin(touched), True).otherwise(outside)) if touched else new.limit(0)
        return self._write(held, new, touched, batch, info, held["schema"])

    def merge(self, changes: DataFrame, values: list[str], operation: str = "operation", batch: int = -1, info: dict | None = None) -> int:
        """Upserts and deletes, one row a key: rows of keys in changes are replaced, or go where the operation is `delete`."""
        if self._manifest()["version"] == 0:
            return self.commit(changes.where(F.col(operation) != "delete").select(self.key, *values), batch, info)
        new = changes.where(F.col(operation) != "delete").select(self.key, *values)
        return self.rewrite(changes.select(self.key), lambda old: old.join(changes.select(self.key), self.key, "left_anti").unionByName(new), batch, info)

    def expire(self, keep: int = 2) -> list[int]:
        """Deletes pointers before the last `keep` whole ones, and what only they name. Returns the numbers of the pointers that went."""
        whole = []
        for n in self._pointers():
            held = self._manifest(n)
            if held["version"] == n:
                whole.append(held)
        kept, old = whole[:keep], whole[keep:]
        if not old:
            return []
        named = {(v, k) for held in kept for k, (v, _, _) in held["parts"].items()}
        fs = self._fs()
        newest = max(h["version"] for h in old)
        for h in old:
            fs.delete(self._path(f"_pointers/{h['version']:012d}"), False)
        for status in fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("v=") and int(name[2:]) <= newest:
                parts = [s.getPath() for s in fs.listStatus(status.getPath()) if s.isDirectory()]
                dead = [p for p in parts if (int(name[2:]), int(p.getName().partition("=")[2])) not in named]
                for p in parts if len(dead) == len(parts) else dead:
                    fs.delete(p, True)
                if len(dead) == len(parts):
                    fs.delete(status.getPath(), True)
        return sorted(h["version"] for h in old)
