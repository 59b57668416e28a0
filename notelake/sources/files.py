"""Sources and sinks: markdown directories, extraction logs, indexes, reports and tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "struct<item_id:string,operation:string,book_title:string,author_first_name:string,author_last_name:string,section:string,content:string,source_file:string,date_read:string>"
LOG = f"extraction_metadata struct<timestamp:string,git_commit_hash:string,git_commit_timestamp:string,extraction_type:string,previous_commit_hash:string,notes_directory:string>, items array<{ITEM}>"


def markdown(spark: SparkSession, directory: str) -> DataFrame:
    """(path, content) of the *.md files of a directory, not of those below it."""
    return spark.read.text(directory, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("content"))


def log_name(name: Column) -> tuple[Column, Column]:
    """(timestamp, commit) of ``extraction_yyyyMMdd_HHmmss_hash.json``; nulls for any other name."""
    parts = F.split(F.regexp_replace(name, r"\.json$", ""), "_")
    at = F.when(F.size(parts) == 4, F.try_to_timestamp(F.concat_ws("_", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))), F.lit("yyyyMMdd_HHmmss")))
    return at, F.when(at.isNotNull(), F.get(parts, F.lit(3)))


HEAD, OPEN, CLOSE = '{"extraction_metadata": ', ', "items": [', "]}"
LARGE = 2**25


def log(spark: SparkSession, directory: str, large: int = LARGE) -> DataFrame:
    """(name, commit, pos, item columns) of all extraction logs; a malformed file fails the read.

    A file of `large` bytes or more with an item a line, as write_log makes them, is read in splits by many tasks; a file of any other
    layout is parsed whole by one task, which holds it.
    """
    lined, rest = _layouts(spark, directory, large)
    if not lined:
        return _whole(spark, [directory])
    rows = _by_line(spark, lined)
    return rows.unionByName(_whole(spark, rest)) if rest else rows


def _layouts(spark: SparkSession, directory: str, large: int) -> tuple[list[str], list[str]]:
    """Paths of the large logs that begin with a line of metadata and have an item, or the end, in the next; and of all others."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(directory, "extraction_*.json")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    lined, rest = [], []
    for s in fs.globStatus(at) or []:
        first = second = None
        if s.getLen() >= large and not s.getPath().getName().endswith((".gz", ".bz2")):
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(s.getPath()), "UTF-8"))
            first, second = lines.readLine(), lines.readLine()  # metadata and an item
            lines.close()
        own = first is not None and second is not None and first.startswith(HEAD) and first.endswith(OPEN) and (second == "" or second.startswith("{") and second.rstrip(",").endswith("}"))
        (lined if own else rest).append(s.getPath().toString())
    return lined, rest


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.schema(LOG).options(multiLine=True, mode="FAILFAST", pathGlobFilter="extraction_*.json").json(paths)
    rows = raw.select(F.col("_metadata.file_name").alias("name"), F.col("extraction_metadata.git_commit_hash").alias("commit"), F.posexplode("items").alias("pos", "item"))
    return rows.select("name", "commit", "pos", "item.*")


def _by_line(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Items by line: a line's number is its place in its split and the lines of the splits before; each file's first, last and other lines are checked."""
    text = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = text.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max(F.when(F.col("value").startswith(HEAD), F.col("value"))).alias("head"))
    own = Window.partitionBy("path")  # a row a split
    before = F.coalesce(F.sum("n").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "block", "least", before.alias("before"), F.sum("n").over(own).alias("lines"), F.first("head").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("head"))
    meta = F.from_json(F.concat("head", F.lit(CLOSE)), LOG, {"mode": "FAILFAST"})
    splits = splits.withColumn("commit", meta["extraction_metadata"]["git_commit_hash"]).drop("head")
    rows = text.join(F.broadcast(splits), ["path", "block"])  # a row a split
    rows = rows.withColumn("nth", F.col("before") + F.col("id") - F.col("least"))
    last, value = F.col("lines") - 1, F.col("value")
    none = (value == "") & (F.col("nth") == 1) & (last == 2)
    comma = value.endswith(",") == (F.col("nth") < last - 1)
    fits = F.when(F.col("nth") == 0, value.startswith(HEAD) & value.endswith(OPEN)).when(F.col("nth") == last, value == CLOSE).otherwise(none | value.startswith("{") & comma)
    broken = F.raise_error(F.concat(F.lit("malformed extraction log "), F.col("path"), F.lit(", line "), (F.col("nth") + 1).cast("string"))).cast("boolean")
    rows = rows.where(F.when(fits, (F.col("nth") > 0) & (F.col("nth") < last) & ~none).otherwise(broken))
    item = F.from_json(F.regexp_replace("value", ",$", ""), ITEM, {"mode": "FAILFAST"})
    return rows.select("name", "commit", (F.col("nth") - 1).cast("int").alias("pos"), item.alias("item")).select("name", "commit", "pos", "item.*")


def latest(rows: DataFrame) -> DataFrame:
    """Rows of the last file by name."""
    return rows.join(F.broadcast(rows.agg(F.max("name").alias("name"))), "name", "left_semi")  # one row


def write_document(rows: DataFrame, order: list[str], path: str, head: str, tail: str) -> None:
    """One file: head, the values of column j in order, separated by commas, and tail.

    Tasks sort and write a range of rows each, so no row, task or driver variable ever holds the document; the parts are then copied
    one after the other, a buffer at a time, into a hidden file that gets its name when it is whole. A run that dies leaves hidden
    files only, which the next run over the same path replaces.
    """
    spark, sep = rows.sparkSession, ",\n"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts, whole = (jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{kind}-{at.getName()}") for kind in ("parts", "whole"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("j").write.mode("overwrite").option("lineSep", sep).text(parts.toString())
    held = [(s.getPath(), s.getLen()) for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
    held.sort(key=lambda x: int(x[0].getName().split("-")[1]))
    out = fs.create(whole, True)
    out.write(bytearray(head.encode()))
    for i, (part, length) in enumerate(held, 1):
        own = fs.open(part)
        jvm.org.apache.commons.io.IOUtils.copyLarge(own, out, 0, length - (len(sep) if i == len(held) else 0))
        own.close()
    out.write(bytearray(tail.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(whole, at):
        raise OSError(f"{path} cannot be written")
    fs.delete(parts, True)


def write_log(items: DataFrame, metadata: dict[str, str | None], path: str) -> None:
    """One JSON document of the run's items, in (seq) order; refuses an existing path."""
    at = items.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(items.sparkSession._jsc.hadoopConfiguration()).exists(at):
        raise FileExistsError(path)
    rows = items.select("seq", F.to_json(F.struct(*[c for c in items.columns if c != "seq"]), {"ignoreNullFields": "false"}).alias("j"))
    write_document(rows, ["seq"], path, f'{{"extraction_metadata": {json.dumps(metadata, ensure_ascii=False)}, "items": [\n', "\n]}\n")


def book_index(spark: SparkSession, path: str) -> DataFrame:
    """Items of a book-centric index: books[].sections{}[]."""
    schema = "books array<struct<title:string,author_first_name:string,author_last_name:string,date_read:string,sections:map<string,array<string>>>>"
    books = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("books"))
    sections = books.select("title", "author_first_name", "author_last_name", "date_read", F.explode("sections").alias("section", "texts"))
    return sections.select("title", "author_first_name", "author_last_name", "date_read", "section", F.explode("texts").alias("content"))


def export(df: DataFrame, path: str, kind: str) -> None:
    writer = df.write.mode("errorifexists")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def issue_report(issues: DataFrame) -> DataFrame:
    """(file, issues as JSON): one row a file with issues, in the fields of the JSON report."""
    row = F.struct(F.col("line_no").alias("line"), "rule_no", "severity", "rule_id", "message", "context", "suggestion")
    kept = F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(*[x[n].alias(n) for n in ("line", "severity", "rule_id", "message", "context", "suggestion")]))
    return issues.groupBy("file").agg(F.to_json(kept, {"ignoreNullFields": "false"}).alias("issues"))


def write_report(issues: DataFrame, path: str) -> None:
    """The JSON report as one document, files in order."""
    name = F.regexp_extract(F.to_json(F.struct("file")), r"(?s)^\{(.*)\}$", 1)
    rows = issue_report(issues).select("file", F.concat(F.lit("{"), name, F.lit(', "issues": '), "issues", F.lit("}")).alias("j"))
    write_document(rows, ["file"], path, '{"files": [\n', "\n]}\n")


def console_report(issues: DataFrame, show_info: bool = True) -> DataFrame:
    """(file, line_no, rule_no, text) of the issues to show."""
    sign = F.when(F.col("severity") == "error", "x").when(F.col("severity") == "warning", "!").otherwise("i")
    text = F.concat(F.lit("  "), sign, F.lit(" Line "), F.col("line_no").cast("string"), F.lit(": "), "message", F.lit("\n      "), "context", F.when(F.col("suggestion") != "", F.concat(F.lit("\n      Suggestion: "), "suggestion")).otherwise(""))
    shown = issues if show_info else issues.where("severity <> 'info'")
    return shown.select("file", "line_no", "rule_no", text.alias("text"))


def totals(issues: DataFrame) -> DataFrame:
    """errors, warnings, infos (hidden ones too) and the exit code, 1 with any error."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"), F.when(n("error") > 0, 1).otherwise(0).alias("exit_code"))


def report_source(spark: SparkSession, path: str, notes_dir: str = "") -> DataFrame:
    """Issues with a suggestion from a JSON report; relative files are below notes_dir."""
    issue = "struct<line:long,severity:string,rule_id:string,message:string,context:string,suggestion:string>"
    rows = spark.read.schema(f"files array<struct<file:string,issues:array<{issue}>>>").option("multiLine", True).json(path).select(F.inline("files"))
    rows = rows.select("file", F.posexplode("issues").alias("rule_no", "i")).where("i.suggestion <> ''")
    full = F.when(F.col("file").startswith("/") | F.lit(not notes_dir), F.col("file")).otherwise(F.concat(F.lit(notes_dir.rstrip("/") + "/"), "file"))
    return rows.select(full.alias("file"), F.col("i.line").alias("line_no"), "i.severity", "i.rule_id", "i.message", "i.context", "i.suggestion", "rule_no")


def write_patterns(patterns: DataFrame, path: str) -> None:
    """Learned patterns as one document, type by type, commonest first."""
    out: dict[str, list] = {}
    for r in patterns.orderBy("pattern_type", F.desc("frequency"), "key").toLocalIterator():
        out.setdefault(r["pattern_type"], []).append({"value": r["value"], "frequency": r["frequency"], "confidence": r["confidence"], "examples": r["examples"]})
    put(patterns.sparkSession, path, json.dumps(out, indent=2, ensure_ascii=False))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern_type, key, value, frequency, examples, confidence) of a document of patterns."""
    one = "array<struct<value:string,frequency:long,confidence:double,examples:array<string>>>"
    body = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{one}>")).alias("pattern_type", "p"))
    return body.select("pattern_type", F.inline("p")).select("pattern_type", F.when(F.col("pattern_type") == "section_name", F.lower("value")).otherwise(F.col("value")).alias("key"), "value", "frequency", "examples", "confidence")


def write_book_index(items: DataFrame, path: str, notes_dir: str, at: str) -> None:
    """The book-centric document: books by date read, undated ones last. items: title, names, date_read, source_file, section, place, item_no, content."""
    book = ["title", "author_first_name", "author_last_name", "date_read", "source_file"]
    sections = items.groupBy(*book, "section").agg(F.min("place").alias("place"), F.transform(F.sort_array(F.collect_list(F.struct("item_no", "content"))), lambda x: x["content"]).alias("texts"))
    books = sections.groupBy(*book).agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("place", "section", "texts"))), lambda x: F.struct(x["section"], x["texts"]))).alias("sections"))
    order = [F.col("date_read").isNull().alias("undated"), "date_read", "source_file", "title"]
    rows = books.select(*order, F.to_json(F.struct(*book, "sections"), {"ignoreNullFields": "false"}).alias("j"))
    total = items.select(*book).distinct().count()
    write_document(rows, ["undated", "date_read", "source_file", "title"], path, f'{{"generated_at": {json.dumps(at)}, "notes_directory": {json.dumps(notes_dir)}, "total_books": {total}, "books": [\n', "\n]}\n")


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
