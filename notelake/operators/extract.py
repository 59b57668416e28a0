"""From a git repository of notes to files of the change log: full, or what changed since the last file."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, git
from . import cdc, markdown

ITEM = ("item_id", "operation", "book_title", "author_first_name", "author_last_name", "section", "content", "source_file", "date_read")


def items(texts: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Items with ids of (path, content): one row an item, in reading order by seq (path, book_no, place, item_no)."""
    parsed = markdown.items(markdown.lines(texts))
    first, last = markdown.author_of_file(F.regexp_replace("path", r"\.[^.]*$", ""))
    rows = markdown.extracted(parsed, first, last)
    rows = rows.withColumn("date_read", F.lit(None).cast("string")) if dates is None else rows.join(F.broadcast(dates), ["path", "title"], "left")  # a row a title
    seq = F.struct("path", "book_no", "place", "item_no").alias("seq")
    return rows.select(seq, "item_id", F.col("title").alias("book_title"), "author_first_name", "author_last_name", "section", "content", F.col("path").alias("source_file"), "date_read")


def log_file(at: datetime, commit: str) -> str:
    return f"extraction_{at:%Y%m%d_%H%M%S}_{commit[:7]}.json"


def previous_commit(spark: SparkSession, index_dir: str) -> str | None:
    """The commit of the last log file; none without files, or if it does not read as one."""
    names = sorted(p.name for p in Path(index_dir).glob("extraction_*.json"))
    if not names:
        return None
    meta = spark.read.schema(files.LOG).option("multiLine", True).json(f"{index_dir}/{names[-1]}")
    row = meta.select("extraction_metadata.git_commit_hash").first()
    return row[0] if row else None


def changes(spark: SparkSession, repo: Path, folder: str, old: str, new: str) -> DataFrame | None:
    """Operations on items between two commits: sets of items compared by id; none if no file changed."""
    names = [(p, s) for p, s in git.changed(repo, old, new) if p.startswith(folder) and "/" not in p[len(folder) :]]
    if not names:
        return None
    short = lambda p: p[len(folder) :]
    now = items(git.texts(spark, [(short(p), git.content(repo, new, p)) for p, s in names if s != "D"]))
    was = items(git.texts(spark, [(short(p), git.content(repo, old, p)) for p, s in names if s != "A"]))
    values = [c for c in now.columns if c not in ("item_id", "seq")] + ["seq"]
    # an id is made of all that a text holds, so equal ids are equal but for the file and place
    out = cdc.diff(was.drop("date_read").withColumn("date_read", F.lit(None).cast("string")), now, "item_id", [v for v in values if v not in ("seq", "source_file")], "seq")
    where = now.select("item_id", "source_file", "seq").unionByName(was.select("item_id", "source_file", "seq")).groupBy("item_id").agg(F.min("source_file").alias("source_file"), F.min("seq").alias("seq"))
    order = F.struct((F.col("operation") == "delete").alias("late"), "seq")
    return out.join(where, "item_id").withColumn("seq", order)


def run(spark: SparkSession, notes_dir: str, index_dir: str, git_dir: str | None = None, full: bool = False, at: datetime | None = None) -> str | None:
    """Write the next file of the log and return its path; None if there is nothing to write.

    A full run needs an index directory without log files; without a previous file every run is full.
    """
    notes, repo = Path(notes_dir).resolve(), Path(git_dir).resolve() if git_dir else git.root(notes_dir)
    if repo is None or not (repo / ".git").exists():
        raise ValueError("a git repository is needed")
    old = None if full else previous_commit(spark, index_dir)
    commit, at = git.head(repo), at or datetime.now()
    folder = "" if notes == repo else f"{notes.relative_to(repo)}/"
    if old is None:
        if list(Path(index_dir).glob("extraction_*.json")):
            raise ValueError(f"{index_dir} has log files already; a full extraction needs an empty directory")
        texts = files.markdown(spark, f"file://{notes}")
        if texts.isEmpty():
            return None
        own = items(texts)
        titles = own.select(F.col("source_file").alias("path"), F.col("book_title").alias("title"))
        rows = items(texts, git.dates(spark, repo, titles, folder)).withColumn("operation", F.lit("add"))
    else:
        rows = changes(spark, repo, folder, old, commit)
        if rows is None:
            return None
    meta = {"timestamp": at.isoformat(), "git_commit_hash": commit, "git_commit_timestamp": git.commit_time(repo, commit), "extraction_type": "full" if old is None else "incremental", "previous_commit_hash": old, "notes_directory": str(notes)}
    path = f"{Path(index_dir).resolve()}/{log_file(at, commit)}"
    files.write_log(rows.select("seq", *ITEM), meta, f"file://{path}")
    return path
