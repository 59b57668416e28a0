"""Versioned tables on Parquet: each version is a directory, a pointer names the current one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .files import put


class Snapshots:
    """A table as <root>/v=<n>/ and <root>/_pointers/<n>: a commit writes the new version, then one small file that names it.

    The highest pointer that reads as a whole document holds. Nothing that it names is ever deleted or overwritten, so a run
    that dies at any point leaves the old version current; a batch id that was committed is not applied again. Pointers are
    written by Hadoop's file systems, so any store that Spark reaches will do. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _pointers(self) -> list[int]:
        """Numbers of all pointers, written whole or not, largest first."""
        fs, at = self._fs(), self._path("_pointers")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def state(self) -> dict:
        for n in self._pointers():
            try:
                held = json.loads(self.spark.read.text(f"{self.root}/_pointers/{n:012d}", wholetext=True).first()[0])
                return {"version": n, "batch": held["batch"], "info": held["info"]}
            except (ValueError, TypeError, KeyError):  # a writer died over it
                continue
        return {"version": 0, "batch": -1, "info": {}}

    def read(self, version: int | None = None) -> DataFrame | None:
        """The current version, or a given one; none before the first commit."""
        version = self.state()["version"] if version is None else version
        return self.spark.read.parquet(f"{self.root}/v={version}") if version else None

    def commit(self, df: DataFrame, batch: int = -1, info: dict | None = None) -> int:
        """The new version; info (the last one's, if not given) is kept beside it."""
        now = self.state()
        if batch >= 0 and batch <= now["batch"]:
            return now["version"]
        version = max([0, *self._pointers()]) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")
        put(self.spark, f"{self.root}/_pointers/{version:012d}", json.dumps({"batch": max(batch, now["batch"]), "info": now["info"] if info is None else info}))
        return version

    def drop(self) -> None:
        self._fs().delete(self._path(""), True)


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(table, column, type, nullable) of the snapshot tables below a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []
    rows = [(n, f.name, f.dataType.simpleString(), f.nullable) for n in names if (t := Snapshots(spark, f"{root}/{n}").read()) is not None for f in t.schema]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")


class Database:
    """Tables in Spark's own catalog: create, append, delete, drop, list and describe them by name."""

    def __init__(self, spark: SparkSession, name: str, location: str | None = None):
        self.spark, self.name = spark, name
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`" + (f" LOCATION '{location}'" if location else ""))

    def _of(self, table: str) -> str:
        return f"`{self.name}`.`{table}`"

    def create(self, table: str, df: DataFrame, replace: bool = False) -> bool:
        """Whether the table was made: one that exists stays as it is, unless it is to be replaced."""
        if self.exists(table) and not replace:
            return False
        df.write.mode("overwrite").saveAsTable(self._of(table))
        return True

    def append(self, table: str, df: DataFrame) -> None:
        """Columns go by name; a table without one of them, or of another type, refuses the rows."""
        self.spark.table(self._of(table))  # an unknown table fails here, it is not made
        df.write.mode("append").saveAsTable(self._of(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._of(table))

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self._of(table))

    def drop(self, table: str) -> bool:
        """Whether there was one."""
        there = self.exists(table)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._of(table)}")
        return there

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(f"`{self.name}`") if not t.isTemporary)

    def columns(self) -> DataFrame:
        """(table, position from 1, column, type, nullable) of all tables: what the catalog holds, no data is read."""
        rows = [(t, i, c.name, c.dataType, c.nullable) for t in self.tables() for i, c in enumerate(self.spark.catalog.listColumns(self._of(t)), 1)]
        return self.spark.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean")

    def clear(self) -> None:
        """Drops the database and all its tables."""
        self.spark.sql(f"DROP DATABASE IF EXISTS `{self.name}` CASCADE")


def migration_name(stem: str) -> tuple[int, str] | None:
    """(version, name) of ``001_some_name``; None for any other."""
    number, _, name = stem.partition("_")
    return (int(number), name) if name and number.isdecimal() else None


def migration_stem(version: int, name: str) -> str:
    return f"{version:03d}_{name.lower().replace(' ', '_').replace('-', '_')}"


def migrate(spark: SparkSession, table: Snapshots, migrations: dict[int, tuple[str, object]]) -> list[int]:
    """Run migrations above the highest recorded version in order; one that fails is not recorded and stops the rest."""
    done = table.read()
    have = done.agg({"version": "max"}).first()[0] if done is not None else 0
    ran = []
    for version in sorted(v for v in migrations if v > (have or 0)):
        name, step = migrations[version]
        step(spark)
        row = spark.createDataFrame([(version, name)], "version int, name string")
        done = table.read()
        table.commit(row if done is None else done.unionByName(row))
        ran.append(version)
    return ran
