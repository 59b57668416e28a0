"""Commands: extract, load-db, normalize, search, enrich-db; each returns its exit code.

python -m notelake.cli extract readings --notes-dir notes --index-dir index
"""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cdc, enrich_flow, extract, load, markdown, quality_rules, vector_store
from .sources import files
from .sources.buckets import Buckets

#: Tables and the column that deals their rows to buckets.
TABLES = {"authors": "author_id", "books": "book_id", "book_authors": "book_id", "notes": "item_id"}


def _spark() -> SparkSession:
    return SparkSession.builder.appName("notelake").getOrCreate()


def _fail(message: str) -> int:
    print(f"Error: {message}", file=sys.stderr)
    return 1


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = markdown.lines(files.markdown(spark, f"file://{Path(folder).resolve()}"))
    return rows.select(F.col("path").alias("file"), "line_no", "line")


def readings(spark: SparkSession, a: argparse.Namespace) -> int:
    for folder in (a.notes_dir, a.git_dir):
        if folder and not Path(folder).is_dir():
            return _fail(f"{folder} is not a directory")
    try:
        path = extract.run(spark, a.notes_dir, a.index_dir, a.git_dir, a.full)
    except ValueError as e:
        return _fail(str(e))
    print(path or "nothing to extract")
    return 0


def load_db(spark: SparkSession, a: argparse.Namespace) -> int:
    """One table of buckets each; a load writes the buckets that change. `books` commits last and names the checkpoint and the versions
    of the others, so that all or none count; versions that neither it nor the load before it names go."""
    if not Path(a.index_dir).is_dir():
        return _fail(f"index directory not found: {a.index_dir}")
    log = files.log(spark, f"file://{Path(a.index_dir).resolve()}")
    held = {n: Buckets(spark, f"{a.database}/{n}", key) for n, key in TABLES.items()}
    there = held["books"].state()
    if a.incremental:
        if not there["version"]:
            return _fail("no database; run a full load first")
        tail = cdc.tail(log, "name", "commit", there["info"]["checkpoint"])
        if tail.isEmpty():
            return 0
        tables = load.incremental({n: t.read(there["info"]["versions"].get(n)) for n, t in held.items()}, tail)
    else:
        if there["version"] and not a.force:
            return _fail("the database exists; use --force to overwrite it or --incremental to update it")
        state = cdc.replay(log, "item_id", ["name", "pos"], "operation", ["book_title", "author_first_name", "author_last_name", "section", "content", "date_read"])
        if state.isEmpty():
            return _fail("no items in the log")
        tables = load.full(state)
    last = log.agg(F.max_by("commit", "name")).first()[0]
    versions = {n: held[n].commit(tables[n]) for n in ("authors", "book_authors", "notes")}
    held["books"].commit(tables["books"], info={"checkpoint": last, "versions": versions})
    for t in held.values():
        t.expire()
    print(json.dumps({n: t.read().count() for n, t in held.items()}))
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    if not Path(a.notes_dir).is_dir():
        return _fail(f"{a.notes_dir} is not a directory")
    learned = files.read_patterns(spark, f"file://{Path(a.patterns).resolve()}") if a.use_patterns and a.patterns and Path(a.patterns).exists() else None
    issues = quality_rules.validate(_lines(spark, a.notes_dir), learned)
    if a.format == "json":
        if a.output:
            files.write_report(issues, f"file://{Path(a.output).resolve()}")
        else:
            for r in files.issue_report(issues).orderBy("file").toLocalIterator():
                print(json.dumps({"file": r["file"], "issues": json.loads(r["issues"])}, ensure_ascii=False))
        return 0
    total = files.totals(issues).first()
    shown, now = [], None
    for r in files.console_report(issues, a.show_info).orderBy("file", "line_no", "rule_no").toLocalIterator():
        shown += [f"\n{r['file']}:"] if r["file"] != now else []
        now = r["file"]
        shown.append(r["text"])
    shown.append(f"Total: {total['errors']} errors, {total['warnings']} warnings, {total['infos']} info")
    print("\n".join(shown))
    if a.output:
        Path(a.output).write_text("\n".join(shown) + "\n", encoding="utf-8")
    return total["exit_code"]


def learn(spark: SparkSession, a: argparse.Namespace) -> int:
    if not Path(a.notes_dir).is_dir():
        return _fail(f"{a.notes_dir} is not a directory")
    files.write_patterns(quality_rules.learn(_lines(spark, a.notes_dir)), f"file://{Path(a.output).resolve()}")
    return 0


def fix(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write the fixed files and print the counts; without --yes each suggestion is asked for, and q ends; --dry-run writes nothing."""
    if not Path(a.validation).exists() or not Path(a.notes_dir).is_dir():
        return _fail("the report or the notes directory is missing")
    issues = files.report_source(spark, f"file://{Path(a.validation).resolve()}")
    counts = {"skipped": 0}
    if not a.yes:
        kept = []
        for r in issues.orderBy("file", "line_no", "rule_no").toLocalIterator():
            print(f"{r['file']}:{r['line_no']} {r['message']}\n  {r['context']}\n  {r['suggestion']}")
            said = input("Apply this fix? [y/n/q] ").strip().lower()
            if said == "q":
                break
            if said == "y":
                kept.append(tuple(r))
            else:
                counts["skipped"] += 1
        issues = spark.createDataFrame(kept, issues.schema)
    rows = _lines(spark, a.notes_dir)
    done = quality_rules.fix_counts(rows, issues, a.dry_run).first().asDict()
    if not a.dry_run:
        fixed = quality_rules.fix(rows, issues)
        touched = fixed.where("fixed").select("file").distinct()
        whole = fixed.join(touched, "file", "left_semi").groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
        # all files are made before any is replaced; the driver holds one at a time
        with tempfile.TemporaryDirectory(prefix=".fixed-", dir=a.notes_dir) as made:
            whole.write.mode("overwrite").parquet(f"file://{Path(made).resolve()}/files")
            for r in spark.read.parquet(f"file://{Path(made).resolve()}/files").toLocalIterator():
                Path(a.notes_dir, r["file"]).write_text(r["text"], encoding="utf-8", newline="")
    done["skipped"] = counts["skipped"]
    print(json.dumps({**done, "total": done["total"] + counts["skipped"]}))
    return 1 if done["failed"] else 0


def search(spark: SparkSession, a: argparse.Namespace) -> int:
    """build, query, stats."""
    table = vector_store.store(spark, a.vector_store)
    info = table.state()["info"]
    model = vector_store.HashEmbedder(int(str(info.get("dimension", a.dimension))))
    if a.action == "build":
        if not Path(a.index_dir).is_dir():
            return _fail(f"index directory not found: {a.index_dir}")
        if a.incremental and not info:
            return _fail("no vector store; build it without --incremental first")
        log = files.log(spark, f"file://{Path(a.index_dir).resolve()}")
        vector_store.update(table, log, model) if a.incremental else vector_store.build(table, log, model, a.index_dir)
        table.expire()
        return 0
    if not info:
        return _fail("no vector store; build it first")
    rows = table.read()
    if a.action == "stats":
        print(json.dumps({**info, **vector_store.stats(rows).first().asDict()}))
        return 0
    asked = [float(x) for x in model.encode([a.query])[0]]
    found = vector_store.find(rows, asked, a.top_k, a.author, a.section)
    if a.format == "json":
        print(json.dumps([r.asDict() for r in found.collect()], indent=2, ensure_ascii=False))  # top_k rows
    else:
        print("\n".join(vector_store.console(found)) or "No results found.")
    return 0


def enrich_db(spark: SparkSession, a: argparse.Namespace) -> int:
    """enrich from recorded answers (key, body by book_id), status, export."""
    held = Buckets(spark, f"{a.database}/books", TABLES["books"])
    books = held.read()
    if books is None:
        return _fail("no database; load it first")
    for f in (*enrich_flow.BOOK_FIELDS, "openlibrary_id", "wikidata_id"):
        books = books if f in books.columns else books.withColumn(f, F.lit(None).cast("int" if f in ("publication_year", "page_count") else "string"))
    if a.action == "enrich":
        read = lambda p: spark.read.parquet(p).withColumnRenamed("key", "book_id")
        found = [("openlibrary", enrich_flow.enrich.library_book(read(a.library)))] if a.library else []
        found += [("wikidata", enrich_flow.book_entity(read(a.entities)))] if a.entities else []
        found = [(s, r) for s, r in found if s in a.sources.split(",")]
        if not found:
            return _fail("no source has answers")
        links, names = (Buckets(spark, f"{a.database}/{n}", TABLES[n]).read() for n in ("book_authors", "authors"))
        work = enrich_flow.book_worklist(books, links, names, a.limit)
        found = [(s, r.join(work.where("author is not null").select("book_id"), "book_id", "left_semi")) for s, r in found]
        done = enrich_flow.outcomes(work, "book_id", [r for _, r in found], "author").first().asDict()
        held.commit(enrich_flow.merged(books, "book_id", found, (*enrich_flow.BOOK_FIELDS, "openlibrary_id", "wikidata_id")))
        print(json.dumps(done))
        return 0
    if a.action == "status":
        print(json.dumps(enrich_flow.enrich.coverage(books, ["isbn_13", "publication_year"]).first().asDict()))
        return 0
    files.export(books, f"file://{Path(a.output).resolve()}", a.format)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="notelake", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def sub(group, name: str, run, *options: tuple[str, dict]) -> None:
        p = group.add_parser(name)
        for flag, how in options:
            p.add_argument(*flag.split("|"), **how)
        p.set_defaults(run=run, action=name)

    need, flag = {"required": True}, {"action": "store_true"}
    group = lambda name: commands.add_parser(name).add_subparsers(dest="sub", required=True)
    sub(group("extract"), "readings", readings, ("--notes-dir", need), ("--git-dir", {}), ("--index-dir", {"default": "data/index"}), ("--full", flag))
    sub(group("load-db"), "load", load_db, ("--index-dir|-i", need), ("--database", {"default": "data/db"}), ("--incremental", flag), ("--force", flag))
    g = group("normalize")
    sub(g, "validate", validate, ("--notes-dir", need), ("--patterns", {}), ("--use-patterns", flag), ("--format", {"choices": ["console", "json"], "default": "console"}), ("--output", {}), ("--show-info", {"action": argparse.BooleanOptionalAction, "default": True}))
    sub(g, "learn", learn, ("--notes-dir", need), ("--output", {"default": "patterns.json"}))
    sub(g, "fix", fix, ("--validation", need), ("--notes-dir", need), ("-y|--yes", flag), ("--dry-run", flag))
    g, store = group("search"), ("--vector-store|-v", {"default": "data/vectors"})
    sub(g, "build", search, ("--index-dir|-i", need), ("--output|-o", {"dest": "vector_store", "required": True}), ("--incremental", flag), ("--dimension", {"type": int, "default": 384}))
    sub(g, "query", search, ("query", {}), store, ("--top-k|-k", {"type": int, "default": 5}), ("--author|-a", {}), ("--section|-s", {}), ("--format|-f", {"choices": ["console", "json"], "default": "console"}), ("--dimension", {"type": int, "default": 384}))
    sub(g, "stats", search, store, ("--dimension", {"type": int, "default": 384}))
    g, base = group("enrich-db"), ("--database", {"default": "data/db"})
    sub(g, "enrich", enrich_db, base, ("--sources", {"default": "openlibrary,wikidata"}), ("--limit", {"type": int}), ("--library", {}), ("--entities", {}))
    sub(g, "status", enrich_db, base)
    sub(g, "export", enrich_db, base, ("--output", need), ("--format", {"choices": ["csv", "json"], "default": "csv"}))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    return a.run(spark or _spark(), a)


if __name__ == "__main__":
    sys.exit(main())
