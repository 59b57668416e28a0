"""Markdown notes as rows: lines to items, by windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import item_id, pystrip

#: Names that head a section even as a title.
SECTIONS = ("excerpts", "ideas", "images", "notes", "representations", "same time", "terms", "threads", "themes")


def lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line_no from 1, line)."""
    split = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(content), "\n")).alias("n", "line"))
    return split.select("path", (F.col("n") + 1).alias("line_no"), "line")


def author_of_file(stem: Column) -> tuple[Column, Column]:
    """(first, last) from ``last__first``; without one double underscore all tokens are the last name."""
    halves = F.split(stem, "__")
    nice = lambda x: F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))
    two = F.size(halves) == 2
    return F.when(two, nice(halves[1])).otherwise(""), F.when(two, nice(halves[0])).otherwise(nice(stem))


def items(rows: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(path, book_no, title, section, item_no, content) in reading order, from (path, line_no, line)."""
    by = Window.partitionBy("path").orderBy("line_no")
    rest = pystrip(F.expr("substring(line, 3)"))
    top = F.col("line").startswith("# ")
    named = F.lower(rest).isin(*sections)
    df = rows.withColumns({"is_title": top & ~named, "is_header": top | F.col("line").startswith("## ")})
    head = F.when(top, F.lower(rest)).otherwise(F.lower(pystrip(F.expr("substring(line, 4)"))))
    df = df.withColumns(
        {
            "book_no": F.sum(F.col("is_title").cast("int")).over(by),
            "header_no": F.sum(F.col("is_header").cast("int")).over(by),
            "title": F.last(F.when(F.col("is_title"), rest), ignorenulls=True).over(by),
            "section": F.last(F.when(F.col("is_header"), F.struct(F.when(~F.col("is_title"), head).alias("name"))), ignorenulls=True).over(by)["name"],
        }
    )
    text = pystrip("line")
    df = df.where(~F.col("is_header") & (F.col("book_no") > 0) & (F.col("section") != "") & (text != ""))
    part = Window.partitionBy("path", "header_no").orderBy("line_no")
    new = ~F.col("line").startswith("    ") | (F.row_number().over(part) == 1)
    df = df.withColumn("pystripped", text).withColumn("is_new", new).withColumn("text", F.when(F.col("is_new") & F.col("pystripped").startswith("- "), F.expr("substring(pystripped, 3)")).otherwise(F.col("pystripped")))
    df = df.withColumn("item_no", F.sum(F.col("is_new").cast("int")).over(part))
    same = Window.partitionBy("path", "book_no", "section")
    df = df.withColumns({"kept": F.max("header_no").over(same), "place": F.min("header_no").over(same)}).where("header_no = kept")
    out = df.groupBy("path", "book_no", "title", "section", "place", "item_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return out.select("path", "book_no", "title", "section", "place", "item_no", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content"))


def extracted(parsed: DataFrame, first: Column, last: Column) -> DataFrame:
    """Items with their ids."""
    return parsed.withColumns({"author_first_name": first, "author_last_name": last}).withColumn("item_id", item_id("title", "author_last_name", "author_first_name", "section", "content"))


def diagnostics(rows: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(path, line_no, kind, name): sections of a book without items, which are dropped, and books without sections that have any, which are kept."""
    by = Window.partitionBy("path").orderBy("line_no")
    line, rest = F.col("line"), pystrip(F.expr("substring(line, 3)"))
    top = line.startswith("# ")
    title = top & ~F.lower(rest).isin(*sections)
    name = F.when(top, rest).otherwise(pystrip(F.expr("substring(line, 4)")))
    head = F.when(top | line.startswith("## "), F.struct(title.alias("title"), name.alias("name"), F.col("line_no").alias("at")))
    df = rows.withColumn("head", head).withColumn("under", F.last("head", ignorenulls=True).over(by)).withColumn("book_no", F.sum(F.coalesce(F.col("head.title"), F.lit(False)).cast("int")).over(by))
    item = F.col("head").isNull() & (pystrip("line") != "")
    parts = df.where("book_no > 0").groupBy("path", "book_no", "under").agg(F.max(item).alias("any"))
    empty = parts.where("not any and not under.title and under.name <> ''").select("path", F.col("under.at").alias("line_no"), F.lit("section").alias("kind"), F.col("under.name").alias("name"))
    full = F.col("any") & ~F.col("under.title") & (F.col("under.name") != "")
    books = parts.groupBy("path", "book_no").agg(F.max(full).alias("any"), F.min(F.when(F.col("under.title"), F.struct("under.at", "under.name"))).alias("b")).where("not any")
    return empty.unionByName(books.select("path", F.col("b.at").alias("line_no"), F.lit("book").alias("kind"), F.col("b.name").alias("name")))
