"""The relational model from the log: full load, incremental load, orphan sweep.

Tables are DataFrames in a dict: authors, books, book_authors, notes, and whatever enrichment has added (book_subjects,
subjects). A load returns new DataFrames; who stores them commits all or none (see sources.tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def keyed(items: DataFrame) -> DataFrame:
    """Items of the log with author, author_id and book_id."""
    author = T.display_name("author_first_name", "author_last_name")
    named = items.withColumn("author", author)
    return named.withColumns({"author_id": T.slug("author"), "book_id": T.book_id("book_title", "author")})


def unique_notes(notes: DataFrame) -> DataFrame:
    """notes, whose plan fails if an item_id comes twice."""
    n = F.count("*").over(Window.partitionBy("item_id"))
    ok = F.when(n > 1, F.raise_error(F.concat(F.lit("item_id comes twice: "), "item_id"))).otherwise(F.lit(True))
    return notes.withColumn("_once", ok.cast("boolean")).where("_once").drop("_once")


def _first(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Per key the values of its first row by place."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*values), "place").alias("f")).select(key, "f.*")


def numbered(rows: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """rows with idx, 0 and on in the order of place (name, pos): files are counted first, so that no task numbers all."""
    files = rows.groupBy(F.col("place.name").alias("file")).agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("place.name").orderBy("place.pos")) - 1
    out = rows.withColumn("nth", nth).join(files, F.col("place.name") == F.col("file"))
    base = F.lit(0)
    if start is not None:
        out, base = out.join(F.broadcast(start.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("base"))), how="cross"), F.col("base")  # one row
    return out.withColumn("idx", (F.col("start") + F.col("nth") + base).cast("long")).drop("nth", "file", "start", "base")


def full(items: DataFrame) -> dict[str, DataFrame]:
    """Tables of a replayed log (cdc.replay's rows: item columns and place). In a run the first row of an author or book wins."""
    rows = keyed(items)
    names = _first(rows, "author", ["author_id", "author_first_name", "author_last_name"]).join(rows.groupBy("author").agg(F.min("place").alias("place")), "author")
    authors = _first(names, "author_id", ["author", "author_first_name", "author_last_name"])
    books = _first(rows, "book_id", ["book_title", "date_read", "author_id"])
    notes = numbered(rows).select("item_id", "book_id", "section", F.col("content").alias("excerpt"), "idx")
    return {
        "authors": authors.select("author_id", F.col("author").alias("name"), "author_first_name", "author_last_name"),
        "books": books.select("book_id", F.col("book_title").alias("title"), "date_read"),
        "book_authors": books.select("book_id", "author_id"),
        "notes": unique_notes(notes),
    }


def _added(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and rows of new whose key it has not."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def incremental(tables: dict[str, DataFrame], tail: DataFrame) -> dict[str, DataFrame]:
    """The tables after the log's new files (name, pos, operation, item columns), orphans swept.

    Authors and books that exist stay as they are. An update of an item that does not exist does nothing but name its book; an
    added item gets the next index in log order; adding an item that exists fails.
    """
    rows = keyed(tail).withColumn("place", F.struct("name", "pos"))
    upserts = rows.where("operation in ('add', 'update')")
    when = lambda op: F.max(F.when(F.col("operation") == op, F.col("place")))
    last = rows.groupBy("item_id").agg(
        when("delete").alias("gone"),
        when("add").alias("added"),
        F.min_by("operation", "place").alias("first_op"),
        F.max_by("operation", "place").alias("last_op"),
        F.max_by(F.struct("book_id", "section", "content"), F.when(F.col("operation") != "delete", F.col("place"))).alias("v"),
    )
    notes = tables["notes"]
    both = notes.join(last, "item_id", "full_outer")
    was, touched = F.col("idx").isNotNull(), F.col("last_op").isNotNull()
    clash = was & (F.col("first_op") == "add")
    stays = was & F.col("gone").isNull()
    fresh = F.col("added").isNotNull() & (F.col("gone").isNull() | (F.col("added") > F.col("gone")))
    both = both.where(F.when(clash, F.raise_error(F.concat(F.lit("item_id comes twice: "), "item_id")).cast("boolean")).otherwise(True))
    both = both.where(~touched | ((F.col("last_op") != "delete") & (stays | fresh)))
    pick = lambda new, old: F.when(touched, F.col(f"v.{new}")).otherwise(F.col(old)).alias(old)
    kept = both.select("item_id", pick("book_id", "book_id"), pick("section", "section"), pick("content", "excerpt"), F.when(stays, F.col("idx")).alias("idx"), F.col("added").alias("place"))
    new = numbered(kept.where("idx is null").drop("idx"), notes)
    out = dict(tables)
    out["notes"] = kept.where("idx is not null").drop("place").unionByName(new.drop("place"))
    one = _first(upserts, "author", ["author_id", "author_first_name", "author_last_name"]).select("author_id", F.col("author").alias("name"), "author_first_name", "author_last_name")
    out["authors"] = _added(tables["authors"], one.join(tables["authors"].select("name"), "name", "left_anti").dropDuplicates(["author_id"]), ["author_id"])
    out["books"] = _added(tables["books"], _first(upserts, "book_id", ["book_title"]).select("book_id", F.col("book_title").alias("title")), ["book_id"])
    out["book_authors"] = _added(tables["book_authors"], upserts.select("book_id", "author_id").distinct(), ["book_id", "author_id"])
    return swept(out)


def swept(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Books without notes go, then links of books that went, then authors and subjects without links: five semi joins in this order."""
    out = dict(tables)
    keep = lambda name, by, key: out[name].join(out[by].select(key).distinct(), key, "left_semi")
    out["books"] = keep("books", "notes", "book_id")
    if "book_subjects" in out:
        out["book_subjects"] = keep("book_subjects", "books", "book_id")
    out["book_authors"] = keep("book_authors", "books", "book_id")
    out["authors"] = keep("authors", "book_authors", "author_id")
    if "subjects" in out and "book_subjects" in out:
        out["subjects"] = keep("subjects", "book_subjects", "subject_id")
    return out


def upserted(old: DataFrame, rows: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """old (key, values) with every key of rows set to its last row's values by order."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("l")).select(key, "l.*")
    return old.select(key, *values).join(last.select(key), key, "left_anti").unionByName(last)


def books_over_runs(old: DataFrame, rows: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Books (book_id, title, date_read) after several runs: in a run a book's first row counts, over runs the last title and the last
    date that is one; a date that a run does not have leaves the old one."""
    first = rows.groupBy("book_id", run).agg(F.min_by(F.struct("title", "date_read"), F.struct(*order)).alias("f"))
    dated = F.when(F.col("f.date_read").isNotNull(), F.col(run))
    new = first.groupBy("book_id").agg(F.max_by("f.title", run).alias("new_title"), F.max_by("f.date_read", dated).alias("new_date"))
    both = old.join(new, "book_id", "full_outer")
    return both.select("book_id", F.coalesce("new_title", "title").alias("title"), F.coalesce("new_date", "date_read").alias("date_read"))


def authors_found(old: DataFrame, wanted: DataFrame) -> DataFrame:
    """Authors (author_id, name, external_id) with all of wanted (external_id, name) in them.

    An external id that is known is that author, whatever the name. Any other goes by the slug of its name: an author with that id
    gets the external id, in place of one it may have; without such an author one is made. Of names that share a slug the least
    external id counts.
    """
    new = wanted.join(old.where("external_id is not null").select("external_id"), "external_id", "left_anti")
    new = new.groupBy(T.slug("name").alias("author_id")).agg(F.min(F.struct("external_id", "name")).alias("n"))
    both = old.join(new, "author_id", "full_outer")
    return both.select("author_id", F.coalesce("name", "n.name").alias("name"), F.coalesce("n.external_id", "external_id").alias("external_id"))
