"""Operators of the core library against goldens, a plain fold and DuckDB."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from notelake import catalog
from notelake.functions import text as T
from notelake.operators import cdc, enrich, markdown, quality_rules
from notelake.sources import files
from notelake.sources.tables import Snapshots, migrate
from notelake.streaming import apply

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_identifiers(spark):
    assert one(spark, T.slug(F.lit("The Émile  Zola: J'accuse!"))) == "the-émile-zola-jaccuse"
    assert one(spark, T.slug(F.lit("a\tb"))) == "ab"
    assert one(spark, T.book_id(F.lit(""), F.lit(""))) == "_"
    assert one(spark, T.display_name(F.lit(None).cast("string"), F.lit(""))) == "Unknown"
    assert one(spark, T.item_id(F.lit("t"), F.lit("l"))).startswith("sha256:")
    assert one(spark, T.pystrip(F.lit("  a \x1c　"))) == "a"
    assert one(spark, T.claim_year(F.lit("-0400-01-01"))) is None
    assert one(spark, T.year_in(F.lit("c. 1984, repr. 2001"))) == 1984
    assert one(spark, T.title_variants(F.lit("A: B"))) == ["A: B", "A"]


def test_replay_is_the_fold(spark):
    rng = random.Random(3)
    rows = [(f"f{i // 10:03d}", i % 10, f"k{rng.randrange(6)}", rng.choice(["add", "update", "delete"]), i) for i in range(300)]
    log = spark.createDataFrame(rows, "name string, pos int, item_id string, operation string, v int")
    state = {}
    for _, _, k, op, v in rows:
        state.pop(k, None) if op == "delete" else state.__setitem__(k, v)
    got = cdc.replay(log, "item_id", ["name", "pos"], "operation", ["v"]).orderBy("place").collect()
    assert [(r["item_id"], r["v"]) for r in got] == list(state.items())
    assert cdc.replay(log.limit(0), "item_id", ["name", "pos"], "operation", ["v"]).count() == 0


def fold(lines):
    out, title, section, current, book = [], None, None, {}, 0
    for line in [*lines, "# end"]:
        top = line.startswith("# ")
        name = line[2:].strip()
        if top and name.lower() not in markdown.SECTIONS or line == "# end":
            out += [(book, title, s, x) for s, items in current.items() for x in items]
            title, section, current, book, items = name, None, {}, book + 1, None
        elif top or line.startswith("## "):
            section, items = (name if top else line[3:].strip()).lower(), []
            fresh = True
        elif title and section and line.strip():
            text = line.strip()
            if line.startswith("    ") and items:
                items[-1] += "\n" + text
            else:
                items.append(text[2:] if text.startswith("- ") else text)
            if fresh:
                current[section], fresh = items, False
    return out


def test_markdown_is_the_fold(spark):
    rng = random.Random(5)
    shapes = ["# A", "# B", "# Notes", "## Ideas", "## x", "- a", "b", "    c", "    - d", "", "  ", "### q", "  - e", "## "]
    notes = {f"n{i}.md": [rng.choice(shapes) for _ in range(30)] for i in range(40)}
    df = markdown.lines(spark.createDataFrame([(k, "\n".join(v)) for k, v in notes.items()], "path string, content string"))
    got = markdown.items(df).orderBy("path", "book_no", "place", "item_no").collect()
    want = [(p, t, s, x) for p in sorted(notes) for _, t, s, x in fold(notes[p])]
    assert [(r["path"], r["title"], r["section"], r["content"]) for r in got] == want


def test_rules_and_fix(spark):
    lines = ["# Book", "## Noets", "- a (p.3) (p.4)", "* b", "  - c", "#d", "### e", "# Notes", "## Ideas"]
    rows = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    issues = quality_rules.validate(rows)
    found = {(r["line_no"], r["rule_id"]): r["suggestion"] for r in issues.collect()}
    assert found[2, "SECTION_002"] == "## notes"
    assert found[3, "CITATION_001"] == "- a (p. 3) (p. 3)"
    assert found[4, "LIST_001"] == "- b" and found[5, "LIST_002"] == "- c"
    assert found[6, "HEADER_002"] == "# d" and (7, "HEADER_001") in found and found[8, "HEADER_003"] is None and (8, "CONTENT_001") in found and (9, "CONTENT_001") in found
    fixed = {r["line_no"]: r["line"] for r in quality_rules.fix(rows, issues).collect()}
    assert fixed[4] == "- b" and fixed[1] == "# Book"


def duck(sql):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    r = db.execute(sql)
    names = [d[0] for d in r.description]
    return sorted(repr(sorted(zip(names, row, strict=True))) for row in r.fetchall())


def rows_of(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


def test_learns_citation_formats(spark):
    lines = ["## A", "- x (p. 1) (p. 2)", "## a", "y (see 3) (no)", "- (p. 1)"] + [f"({i})" for i in range(10, 20)]
    rows = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    got = {(r["pattern_type"], r["value"]): (r["frequency"], r["confidence"]) for r in quality_rules.learn(rows).collect()}
    assert got["citation_format", "(p. 1)"] == (2, 2 / 14)
    assert len(got) == 11 and sum(k == "section_name" for k, _ in got) == 1
    assert rows_of(catalog.QUERIES["VAL-LRN-ALL"](spark, SF)) == duck(catalog.ORACLES["VAL-LRN-ALL"])


def test_titles_are_whole_lines(spark):
    first = "A first line that is far longer than thirty characters (p. 12)"
    texts = spark.createDataFrame([(1, first + "\nx\nsome words")], "doc_id long, text string")
    assert catalog._rows(texts).where("line_no = 1").first()["line"] == "# " + first
    got = {r["title"] for r in catalog.QUERIES["PAR-04"](spark, SF).collect()}
    assert max(map(len, got)) > 30


@pytest.mark.parametrize("name", ["VAL-H1", "VAL-H3", "VAL-B2", "PAR-05", "VAL-C1", "VAL-L2"])
def test_whole_lines_keep_to_the_sql(spark, name):
    assert rows_of(catalog.QUERIES[name](spark, SF)) == duck(catalog.ORACLES[name])


def test_numbers_all_new_books(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = catalog.QUERIES["WIN-02-ALL"](spark, sf)
    assert got.where("book_id > 500").count() > 0
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    assert sorted((r["book_id"], r["next"]) for r in got.collect()) == sorted(db.execute(catalog.ORACLES["WIN-02-ALL"]).fetchall())


def test_enrichment(spark):
    book = '{"key":"/works/OL1W","isbn":["123","9781234567890"],"first_publish_year":1950,"edition":{"languages":[{"key":"/languages/eng"}],"publishers":["P"],"number_of_pages":0},"number_of_pages_median":90,"description":{"value":"d"},"subject":["b","a"," "],"subjects":["a"]}'
    r = enrich.library_book(spark.createDataFrame([(book,)], "body string")).first()
    assert (r["isbn"], r["publication_year"], r["publisher"], r["page_count"], r["language"], r["description"], r["work_id"], r["subjects"]) == ("9781234567890", 1950, "P", 90, "eng", "d", "OL1W", ["a", "b"])
    entity = '{"claims":{"P136":[{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}},{"mainsnak":{}}],"P577":[{"mainsnak":{"datavalue":{"value":{"time":"+1951-01-01T00:00:00Z"}}}}]}}'
    r = enrich.claims(spark.createDataFrame([(entity,)], "body string"), {"genres": "P136", "published": "P577"}).first()
    assert r["genres"] == ["Q5"] and r["published"] == ["+1951-01-01T00:00:00Z"]
    rows = spark.createDataFrame([("Q1",), ("Q2",), ("Quakers",), (None,)], "g string")
    labels = spark.createDataFrame([("Q1", "one")], "qid string, label string")
    assert sorted(str(r["g"]) for r in enrich.resolve(rows, "g", labels).collect()) == ["None", "Q2", "Quakers", "one"]


def test_log_files_stream_and_snapshots(spark, tmp_path):
    items = spark.createDataFrame([(0, "a", "add", "T", "F", "L", "notes", "x", "f", None), (1, "b", "add", "T", "F", "L", "notes", "y", "f", None)], "seq int, item_id string, operation string, book_title string, author_first_name string, author_last_name string, section string, content string, source_file string, date_read string")
    logs = tmp_path / "logs"
    logs.mkdir()

    def put(df, stamp):
        path = f"file://{logs}/extraction_2024010{stamp}_000000_abcdef{stamp}.json"
        files.write_log(df, {"git_commit_hash": stamp}, path)
        with pytest.raises(FileExistsError):
            files.write_log(df, {"git_commit_hash": stamp}, path)

    put(items, "1")
    table = apply.table(spark, f"file://{tmp_path}/table", 8)
    apply.run(spark, str(logs), table, f"file://{tmp_path}/cp")
    put(items.where("seq = 0").withColumns({"operation": F.lit("delete")}), "2")
    apply.run(spark, str(logs), table, f"file://{tmp_path}/cp")
    assert [r["item_id"] for r in table.read().collect()] == ["b"]
    version = table.state()["version"]
    apply.run(spark, str(logs), table, f"file://{tmp_path}/cp")
    assert table.state()["version"] == version
    log = files.log(spark, str(logs))
    batch = cdc.replay(log, "item_id", ["name", "pos"], "operation", ["content"]).collect()
    assert [r["item_id"] for r in batch] == ["b"]
    assert files.latest(log).select("operation").first()[0] == "delete"
    assert cdc.tail(log, "name", "commit", "1").count() == 1 and cdc.tail(log, "name", "commit", "zz").count() == 0


def test_migrations(spark, tmp_path):
    table, ran = Snapshots(spark, f"file://{tmp_path}/schema"), []
    steps = {2: ("b", lambda s: ran.append(2)), 1: ("a", lambda s: ran.append(1))}
    assert migrate(spark, table, steps) == [1, 2] and migrate(spark, table, steps) == [] and ran == [1, 2]

    def fails(s):
        raise ValueError

    with pytest.raises(ValueError):
        migrate(spark, table, steps | {3: ("c", fails)})
    assert migrate(spark, table, steps) == []


def test_plans(spark):
    plan = lambda n: catalog.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("SRT-01")
    assert "LeftAnti" in plan("JOI-09")
    assert "PushedFilters: [IsNotNull(s_suppkey), EqualTo(s_suppkey,7)]" in plan("FLT-01")


@pytest.mark.parametrize("name", ["CDC-06", "CDC-03", "VEC-04", "JOI-05", "JOI-14", "WIN-01", "AGG-08", "VAL-C2", "GRA-05", "PAR-07", "VAL-P1", "VAL-P2", "DML-07", "VEC-09", "ENR-07"])
def test_oracle(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got = catalog.QUERIES[name](spark, SF)
    want = db.execute(catalog.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]
    rows = sorted((tuple(repr(r[names.index(c)]) for c in order) for r in want.fetchall()))
    assert sorted(tuple(repr(r[c]) for c in order) for r in got.collect()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
