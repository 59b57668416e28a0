"""Rules, loads, snapshots, the vector store, git capture and commands against plain Python and scenarios."""

import difflib
import json
import random
import re
import subprocess

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from notelake import cli
from notelake.operators import cdc, enrich, enrich_flow, extract, graph, load, markdown, quality_rules, search, vector_store
from notelake.sources import files, git
from notelake.sources.buckets import Buckets
from notelake.sources.tables import Database, Snapshots, catalog, migration_name, migration_stem
from notelake.streaming import apply

ITEM = "item_id string, operation string, book_title string, author_first_name string, author_last_name string, section string, content string, source_file string, date_read string"


def plain(lines):
    """(line, rule, context, suggestion) by the rules' own words, line by line."""
    out, section, items, head, book = [], None, [], None, None

    def hollow():
        if head and head[1] and not head[2]:
            out.append((head[0], "CONTENT_001", f"## {head[1]}", "Add content to the section or remove it"))

    def hollow_book():
        if book and book[1] and not book[2]:
            out.append((book[0], "CONTENT_002", f"# {book[1]}", "Add sections with content to the book"))

    def uncited():
        has = [bool(re.search(r"\(p\.\s+\d+\)", x)) for _, x in items]
        for i in range(1, len(items)):
            if not has[i] and has[i - 1] and any(has[i:]):
                out.append((items[i][0], "CITATION_002", items[i][1].strip(), None))

    for n, line in enumerate(lines, 1):
        s = line.strip()
        if line.startswith("# ") and line[2:].strip().lower() in markdown.SECTIONS:
            out.append((n, "HEADER_003", s, None))
        if line.startswith("###"):
            out.append((n, "HEADER_001", s, "Use ## for sections within books"))
        if re.match(r"#{1,2}[^\s#]", line):
            out.append((n, "HEADER_002", s, re.sub(r"^(#{1,2})", r"\1 ", line).strip()))
        m = re.match(r"##\s+(.+)$", line)
        if m:
            name = m[1].strip()
            near = difflib.get_close_matches(name.lower(), markdown.SECTIONS, n=3, cutoff=0.7)
            if name.lower() in markdown.SECTIONS:
                out += [(n, "SECTION_001", s, f"## {name.lower()}")] if name != name.lower() else []
            elif near:
                out.append((n, "SECTION_002", s, f"## {near[0]}"))
        if line.startswith("## "):
            if section:
                uncited()
            section, items = s, []
        elif s.startswith("- ") and not line.startswith("    "):
            items.append((n, line))
            for p, _ in quality_rules.MALFORMED:
                if hit := re.search(p, line):
                    out.append((n, "CITATION_001", s, re.sub(p, f"(p. {re.search(r'[0-9]+', hit[0])[0]})", line).strip()))
        if re.match(r"\s*[*+]\s", line):
            out.append((n, "LIST_001", s, re.sub(r"^(\s*)[*+]", r"\1-", line).strip()))
        m = re.match(r"( *)-\s", line)
        if m and len(m[1]) % 4:
            out.append((n, "LIST_002", line.rstrip(), (" " * (len(m[1]) // 4 * 4) + line.lstrip()).rstrip()))
        top = line.startswith("# ")
        if top and line[2:].strip().lower() not in markdown.SECTIONS:
            hollow()
            hollow_book()
            book, head = [n, line[2:].strip(), False], None
        elif top or line.startswith("## "):
            hollow()
            head = [n, (line[2:] if top else line[3:]).strip(), False]
        elif book and book[1] and head and head[1] and s and not s.startswith("#"):
            head[2] = book[2] = True
    if section:
        uncited()
    hollow()
    hollow_book()
    return out


def test_rules_are_plain(spark):
    rng = random.Random(8)
    shapes = ["# A", "# B ", "# Notes", "# ", "## Ideas", "## notes", "##  Themse", "##\tterms", "## ", "##x", "#y", "### z", "- a", "- b (p. 3)", "- c (p.4) (p.5)", "  - d (pg. 7)", " - e (page 9) (p, 1)", "    - f (p.2)", "* g", "  + h", "", "   ", "text", "- (p 12)", "-", "## Same Time"]
    notes = {f"n{i}.md": [rng.choice(shapes) for _ in range(40)] for i in range(60)}
    notes["b2.md"] = ["# A", "stray", "# B", "## Y", "- item"]
    notes["b1.md"] = ["# A", "## X", "# B", "stray"]
    rows = spark.createDataFrame([(f, n, x) for f, lines in notes.items() for n, x in enumerate(lines, 1)], "file string, line_no long, line string")
    found = quality_rules.validate(rows).collect()
    assert sorted(((r["file"], r["line_no"], r["rule_id"], r["context"], r["suggestion"]) for r in found), key=repr) == sorted(((f, *x) for f, lines in notes.items() for x in plain(lines)), key=repr)
    assert all(r["message"] for r in found)
    # fixes: suggestion after suggestion, each if the line still is its context
    want, applied, total = {f: list(x) for f, x in notes.items()}, 0, 0
    for r in sorted(found, key=lambda r: (r["file"], r["line_no"], r["rule_no"])):
        if r["suggestion"]:
            total += 1
            at = want[r["file"]]
            if at[r["line_no"] - 1].strip() == r["context"].strip():
                at[r["line_no"] - 1] = r["suggestion"]
                applied += 1
    issues = quality_rules.validate(rows)
    got = {(r["file"], r["line_no"]): r["line"] for r in quality_rules.fix(rows, issues).collect()}
    assert got == {(f, i): x for f, lines in want.items() for i, x in enumerate(lines, 1)}
    assert applied < total and sum(want[f] != notes[f] for f in notes) > 50
    assert quality_rules.fix_counts(rows, issues).first().asDict() == {"total": total, "applied": applied, "skipped": 0, "failed": total - applied}
    # each rule alone finds what all together find
    every = sorted(map(repr, (tuple(r) for r in found)))
    alone = [tuple(r) for rule in {r["rule_id"] for r in found} for r in quality_rules.of_rule(rows, rule).collect()]
    assert sorted(map(repr, alone)) == every
    plan = quality_rules.validate(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1
    s = {r["file"]: r for r in quality_rules.summary(issues).collect()}
    assert s["b2.md"]["has_errors"] and not s["b2.md"]["is_clean"]


def test_fixes_fold_keep_endings_and_run_dry(spark):
    rows = spark.createDataFrame([("f", 1, "* a (p.3)\r"), ("f", 2, "x"), ("f", 3, None)], "file string, line_no long, line string")
    say = lambda n, rule, context, new: ("f", n, "error", "R", "m", context, new, rule)
    issues = spark.createDataFrame(
        [say(1, 2, "- a (p.3)", "- a (p. 3)"), say(1, 1, "* a (p.3) ", "- a (p.3)"), say(1, 3, "* a (p.3)", "no more"), say(2, 1, "other", "y"), say(2, 2, "x", None), say(2, 3, "x", ""), say(3, 1, "", "z"), say(9, 1, "x", "far")],
        "file string, line_no long, severity string, rule_id string, message string, context string, suggestion string, rule_no int",
    )
    assert [(r["line"], r["fixed"]) for r in quality_rules.fix(rows, issues).orderBy("line_no").collect()] == [("- a (p. 3)\r", True), ("x", False), (None, False)]
    assert tuple(quality_rules.fix_counts(rows, issues).first()) == (6, 2, 0, 4)
    # in a dry run nothing is written, so each suggestion meets the line as it is
    assert [r["line"] for r in quality_rules.fix(rows, issues, dry_run=True).orderBy("line_no").collect()] == ["* a (p.3)\r", "x", None]
    assert tuple(quality_rules.fix_counts(rows, issues, dry_run=True).first()) == (6, 2, 0, 4)


def test_patterns_and_reports(spark, tmp_path):
    lines = ["# A", "## Ideas", "- x (p. 1)", "## Ideas", "## ideas", "## Odd"]
    rows = spark.createDataFrame([("f.md", i + 1, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    learned = quality_rules.learn(rows)
    files.write_patterns(learned, f"file://{tmp_path}/p.json")
    again = files.read_patterns(spark, f"file://{tmp_path}/p.json")
    key = lambda df: sorted((r["pattern_type"], r["key"], r["value"], r["frequency"], round(r["confidence"], 9), tuple(r["examples"])) for r in df.collect())
    assert key(learned) == key(again) and ("section_name", "ideas", "Ideas", 3, 0.75, ("Ideas", "ideas")) in key(again)
    new = spark.createDataFrame([("g.md", 1, "## IDEAS"), ("g.md", 2, "## Else"), ("g.md", 3, "## Odd")], "file string, line_no long, line string")
    found = {(r["line_no"], r["rule_id"]): r["suggestion"] for r in quality_rules.validate(new, again).where("rule_id like 'PATTERN%'").collect()}
    assert found == {(1, "PATTERN_001"): "## Ideas", (2, "PATTERN_002"): None}
    issues = quality_rules.validate(rows)
    files.write_report(issues, f"file://{tmp_path}/r.json")
    held = json.loads((tmp_path / "r.json").read_text())
    assert [f["file"] for f in held["files"]] == ["f.md"] and list(held["files"][0]["issues"][0]) == ["line", "severity", "rule_id", "message", "context", "suggestion"]
    back = files.report_source(spark, f"file://{tmp_path}/r.json", "/notes").collect()
    assert {r["file"] for r in back} == {"/notes/f.md"} and all(r["suggestion"] for r in back)
    total = files.totals(issues).first()
    assert total["exit_code"] == int(total["errors"] > 0)
    assert files.console_report(issues, show_info=False).count() == issues.where("severity <> 'info'").count()


def test_diff_takes_the_last(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, seq int")
    out = cdc.diff(rows(("a", 1, 1), ("a", 9, 0), ("b", 2, 0)), rows(("a", 5, 0), ("a", 1, 2), ("c", 3, 0)), "k", ["v"], "seq")
    assert sorted((r["k"], r["v"], r["operation"]) for r in out.collect()) == [("b", 2, "delete"), ("c", 3, "add")]


def test_snapshots_survive_crashes(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t")
    one = spark.range(3)
    assert t.read() is None and t.commit(one, info={"x": 1}) == 1
    # died while writing data; died while writing the pointer
    (tmp_path / "t" / "v=2").mkdir()
    (tmp_path / "t" / "_pointers" / "000000000002").write_text('{"batch": 3, "in')
    assert t.read().count() == 3 and t.state() == {"version": 1, "batch": -1, "info": {"x": 1}}
    assert t.commit(spark.range(5), batch=7) == 3 and t.read().count() == 5 and t.state()["info"] == {"x": 1}
    assert t.commit(spark.range(9), batch=7) == 3 and t.read().count() == 5 and t.read(1).count() == 3
    assert [tuple(r)[:3] for r in catalog(spark, f"file://{tmp_path}").collect()] == [("t", "id", "bigint")]
    t.drop()
    assert t.read() is None
    assert migration_name("012_add_x") == (12, "add_x") and migration_name("x_y") is None and migration_name("12") is None and migration_stem(3, "Add new-Col") == "003_add_new_col"


def items(spark, *rows):
    return spark.createDataFrame([(n, p, c, i, op, t, f, a, s, x, "f.md", None) for n, p, c, i, op, t, f, a, s, x in rows], f"name string, pos int, commit string, {ITEM}")


def test_loads(spark):
    log = items(spark, ("f1", 0, "c1", "i1", "add", "Wrong", "Jane", "Doe", "notes", "x"), ("f1", 1, "c1", "i2", "add", "Wrong", "Jane", "Doe", "notes", "y"), ("f1", 2, "c1", "i3", "add", "Other", "", "Poe", "ideas", "z"))
    state = cdc.replay(log, "item_id", ["name", "pos"], "operation", ["book_title", "author_first_name", "author_last_name", "section", "content", "date_read"])
    t = load.full(state)
    get = lambda t, n, *cols: sorted(tuple(r) for r in t[n].select(*cols).collect())
    assert get(t, "authors", "author_id", "name") == [("jane-doe", "Jane Doe"), ("poe", "Poe")]
    assert get(t, "notes", "item_id", "idx", "excerpt") == [("i1", 0, "x"), ("i2", 1, "y"), ("i3", 2, "z")]
    old = get(t, "books", "book_id")[1][0]
    t["book_subjects"] = spark.createDataFrame([(old, "s1"), (get(t, "books", "book_id")[0][0], "s2")], "book_id string, subject_id string")
    t["subjects"] = spark.createDataFrame([("s1",), ("s2",)], "subject_id string")
    tail = items(spark, ("f2", 0, "c2", "i1", "update", "Right", "Jane", "Doe", "notes", "x"), ("f2", 1, "c2", "i2", "update", "Right", "Jane", "Doe", "notes", "y2"), ("f2", 2, "c2", "i3", "delete", "Other", "", "Poe", "ideas", "z"), ("f2", 3, "c2", "i4", "add", "Right", "Jane", "Doe", "ideas", "new"), ("f2", 4, "c2", "i9", "update", "Ghost", "No", "One", "ideas", "gone"))
    n = load.incremental(t, tail)
    assert get(n, "notes", "item_id", "idx", "excerpt", "section") == [("i1", 0, "x", "notes"), ("i2", 1, "y2", "notes"), ("i4", 3, "new", "ideas")]
    assert [r["title"] for r in n["books"].collect()] == ["Right"] and get(n, "authors", "author_id") == [("jane-doe",)]
    assert n["book_subjects"].count() == 0 and n["subjects"].count() == 0 and n["book_authors"].count() == 1
    with pytest.raises(Exception, match="item_id comes twice"):
        load.incremental(t, items(spark, ("f3", 0, "c3", "i1", "add", "Right", "Jane", "Doe", "notes", "x")))["notes"].collect()
    with pytest.raises(Exception, match="item_id comes twice"):
        load.unique_notes(t["notes"].unionByName(t["notes"])).collect()


def test_vector_store(spark, tmp_path):
    model = vector_store.HashEmbedder(32)
    table = vector_store.store(spark, f"file://{tmp_path}/vectors")
    one = items(spark, ("f1", 0, "c1", "i1", "add", "T", "Jane", "Doe", "notes", "red apples"), ("f1", 1, "c1", "i2", "add", "T", "Jane", "Doe", "ideas", "blue sky"), ("f1", 2, "c1", "i3", "add", "U", "", "Poe", "notes", "  "))
    with pytest.raises(ValueError):
        vector_store.update(table, one, model)
    vector_store.build(table, one, model)
    rows = table.read()
    assert rows.count() == 2 and all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 for r in rows.collect())
    two = one.unionByName(items(spark, ("f2", 0, "c2", "i1", "update", "T", "Jane", "Doe", "notes", "green apples"), ("f2", 1, "c2", "i2", "delete", "T", "Jane", "Doe", "ideas", "blue sky"), ("f2", 2, "c2", "i4", "add", "U", "", "Poe", "notes", "grey clouds")))
    vector_store.update(table, two, model)
    s = vector_store.stats(table.read()).first()
    assert (s["total_notes"], s["active_notes"], s["unique_authors"]) == (4, 2, 2) and table.state()["info"]["checkpoint"] == "c2"
    version = table.state()["version"]
    assert vector_store.update(table, two, model) == version
    asked = [float(x) for x in model.encode(["apples green"])[0]]
    found = vector_store.find(table.read(), asked, 5)
    assert [r["text"] for r in found.collect()] == ["green apples", "grey clouds"] and abs(found.first()["similarity"] - 1) < 1e-6
    assert vector_store.find(table.read(), asked, 5, author="Jane").count() == 0
    assert vector_store.console(found)[0] == "1. [100.0%] T"
    assert search.nearest(table.read().where("not deleted"), asked, 1, id_col="item_id", vector="vector").first()["item_id"] == "i1"


def test_notes_whose_words_cancel_out_stay_in_the_store(spark, tmp_path):
    model = vector_store.HashEmbedder(384)
    assert not model.encode(["note word302"]).any()  # one slot, two signs
    table = vector_store.store(spark, f"file://{tmp_path}/vectors")
    log = items(spark, ("f1", 0, "c1", "i1", "add", "T", "Jane", "Doe", "notes", "note word302"), ("f1", 1, "c1", "i2", "add", "T", "Jane", "Doe", "notes", "note red"))
    vector_store.build(table, log, model)
    assert {r["item_id"]: r["vector"] is None for r in table.read().collect()} == {"i1": True, "i2": False}
    vector_store.update(table, log.unionByName(items(spark, ("f2", 0, "c2", "i2", "update", "T", "Jane", "Doe", "notes", "note word302"))), model)
    assert sorted((r["item_id"], r["text"], r["deleted"]) for r in table.read().collect()) == [("i1", "note word302", False), ("i2", "note red", True), ("i2", "note word302", False)]
    assert vector_store.find(table.read(), [float(x) for x in model.encode(["red"])[0]], 5).count() == 0
    assert vector_store.stats(table.read()).first()["active_notes"] == 2


def test_embedding_holds_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")

        class Most(vector_store.HashEmbedder):
            def encode(self, texts):
                import inspect

                held = [len(f.frame.f_locals["pandas_batch"]) for f in inspect.stack() if "pandas_batch" in f.frame.f_locals]
                return np.full((len(texts), self.dimension), max(held), np.float32)

        rows = spark.range(0, 5000, 1, 1).select(F.col("id").cast("string").alias("text"))
        top = rows.select(vector_store.embedded(F.col("text"), lambda: Most(2))[0].alias("n")).agg(F.max("n")).first()[0]
        assert int(spark.conf.get(key)) == 256 and 0 < top <= 256
    finally:
        spark.conf.set(key, was)


def test_large_logs_are_read_by_many_tasks(spark, tmp_path):
    odd = ["a\nb", "x,", ",", "", None, "\u2028 }", '"]}', "\r\n", "{", "}"]
    rows = spark.createDataFrame([(i, str(i), "add", "T", "", "P", "notes", f"{odd[i % len(odd)]} {i}" if odd[i % len(odd)] is not None else None, "f.md", None) for i in range(4000)], "seq long, " + ITEM)
    files.write_log(rows.repartition(3), {"git_commit_hash": "abc"}, f"file://{tmp_path}/extraction_20240101_000000_abc.json")
    files.write_log(rows.where("seq < 5"), {"git_commit_hash": None}, f"file://{tmp_path}/extraction_20240102_000000_def.json")
    files.write_log(rows.limit(0), {"git_commit_hash": "x"}, f"file://{tmp_path}/extraction_20240103_000000_x.json")
    (tmp_path / "extraction_20240104_000000_p.json").write_text(json.dumps({"extraction_metadata": {"git_commit_hash": "p"}, "items": [{"item_id": "1"}, {"item_id": "2"}]}, indent=2))
    read = lambda **x: sorted(map(str, files.log(spark, f"file://{tmp_path}", **x).collect()))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        assert read(large=1) == read() and len(read()) == 4007
        big = files.log(spark, f"file://{tmp_path}", large=10_000)
        assert big.where("commit = 'abc'").select(F.spark_partition_id()).distinct().count() > 4
        path = tmp_path / "extraction_20240101_000000_abc.json"
        whole = path.read_text()
        (tmp_path / f".{path.name}.crc").unlink()
        for cut in (whole[: len(whole) // 2], whole[:-3], whole.replace("},\n", "}\n", 1), whole.replace('"item_id":"7"', '"item_id":7"', 1)):
            path.write_text(cut)
            with pytest.raises(Exception, match=r"(?i)malformed"):
                read(large=1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_nearest_many_as_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6)).astype(np.float32)
    v[::7] = v[3]  # copies: ties by id, over slices
    v[5] = 0
    rows = [(i, v[i].tolist() if i not in (11, 12) else None if i == 11 else [1.0, None, 2.0, 0.0, 0.0, 1.0], [0, 0, 1, None][i % 4] if i < 290 else 9) for i in range(292)]
    notes = spark.createDataFrame(rows, "item_id long, embedding array<float>, label int")
    asked = notes.where("item_id % 3 = 0 or item_id in (5, 11, 290)").select(F.col("item_id").alias("query_id"), "label", F.col("embedding").alias("query_vector"))
    cos = search.cosine("embedding", "query_vector")
    ranked = notes.join(asked, "label").withColumn("c", cos).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "item_id"))).where("rank <= 4")
    want = sorted(tuple(r) for r in ranked.select("query_id", "rank", "item_id", F.col("c").cast("string")).fillna("").collect())
    get = lambda: search.nearest_many(notes, asked, 4, "label")
    for slice_, block in ((8192, 4096), (40, 20)):
        monkeypatch.setattr(search, "SLICE", slice_)
        monkeypatch.setattr(search, "BLOCK", block)
        assert sorted(tuple(r) for r in get().select("query_id", "rank", "item_id", F.col("cosine").cast("string")).fillna("").collect()) == want
    assert "HigherOrder" not in (plan := get()._jdf.queryExecution().toString()) and "zip_with" not in plan  # pairs do not become rows


def test_git_log_and_commands(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "notes").mkdir(parents=True)
    put = lambda name, text: (repo / "notes" / name).write_text(text)

    def commit(word):
        git.git(repo, "add", "-A")
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", word], check=True)

    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    put("doe__jane.md", "# Book\n## Notes\n- one\n- two (p.3)\n")
    put("poe.md", "# Tale\n## Ideas\n- old\n")
    commit("a")
    index, base, vectors = tmp_path / "index", tmp_path / "db", tmp_path / "vec"
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("extract", "readings", "--notes-dir", repo / "notes", "--index-dir", index) == 0
    assert len(list(index.glob("extraction_*.json"))) == 1
    assert run("extract", "readings", "--notes-dir", repo / "notes", "--index-dir", index, "--full") == 1
    assert run("load-db", "load", "--index-dir", index, "--database", base, "--incremental") == 1
    assert run("load-db", "load", "--index-dir", index, "--database", base) == 0 and run("load-db", "load", "--index-dir", index, "--database", base) == 1
    assert run("search", "build", "-i", index, "-o", vectors, "--dimension", "64") == 0
    log = files.log(spark, f"file://{index}")
    assert log.where("date_read is not null and operation = 'add'").count() == 3
    assert run("extract", "readings", "--notes-dir", repo / "notes", "--index-dir", index) == 0 and len(list(index.glob("*.json"))) == 1
    put("doe__jane.md", "# Book\n## Notes\n- one\n- three\n")
    (repo / "notes" / "poe.md").unlink()
    put("roe.md", "# New\n## Ideas\n- fresh\n    more\n")
    commit("b")
    assert sorted(git.changed(repo, "HEAD~1", "HEAD")) == [("notes/doe__jane.md", "M"), ("notes/poe.md", "D"), ("notes/roe.md", "A")]
    at = git.datetime(2099, 1, 1)
    assert extract.run(spark, str(repo / "notes"), str(index), at=at).endswith(f"extraction_20990101_000000_{git.head(repo)[:7]}.json")
    log = files.log(spark, f"file://{index}")
    new = sorted((r["operation"], r["content"]) for r in log.where("name like 'extraction_2099%'").collect())
    assert new == [("add", "fresh\nmore"), ("add", "three"), ("delete", "old"), ("delete", "two (p.3)")]
    assert run("load-db", "load", "--index-dir", index, "--database", base, "--incremental") == 0
    assert sorted(r["excerpt"] for r in Buckets(spark, f"{base}/notes", "item_id").read().collect()) == ["fresh\nmore", "one", "three"]
    assert sorted(r["name"] for r in Buckets(spark, f"{base}/authors", "author_id").read().collect()) == ["Jane Doe", "Roe"]
    assert run("search", "build", "-i", index, "-o", vectors, "--incremental") == 0
    assert run("search", "query", "three", "-v", vectors, "--format", "json") == 0 and run("search", "stats", "-v", vectors) == 0
    assert run("search", "query", "x", "-v", tmp_path / "none") == 1
    # validation, learning, fixing
    put("bad__b.md", "# T\n## Notes\n* star\n- x (p.9)\n")
    report = tmp_path / "r.json"
    assert run("normalize", "validate", "--notes-dir", repo / "notes") == 1
    assert run("normalize", "validate", "--notes-dir", repo / "notes", "--format", "json", "--output", report) == 0
    assert run("normalize", "learn", "--notes-dir", repo / "notes", "--output", tmp_path / "p.json") == 0
    assert run("normalize", "fix", "--validation", report, "--notes-dir", repo / "notes", "-y") == 0
    assert (repo / "notes" / "bad__b.md").read_text() == "# T\n## notes\n- star\n- x (p. 9)\n"
    # enrichment from recorded answers
    books = Buckets(spark, f"{base}/books", "book_id").read()
    key = books.where("title = 'Book'").first()["book_id"]
    spark.createDataFrame([(key, '{"key":"/works/OL1W","isbn":["9781234567890"],"first_publish_year":1950}')], "key string, body string").write.parquet(f"{tmp_path}/lib")
    assert run("enrich-db", "enrich", "--database", base, "--library", f"{tmp_path}/lib") == 0 and run("enrich-db", "status", "--database", base) == 0
    assert Buckets(spark, f"{base}/books", "book_id").read().where("isbn_13 = '9781234567890' and publication_year = 1950").count() == 1
    assert run("enrich-db", "export", "--database", base, "--output", tmp_path / "out") == 0 and run("enrich-db", "export", "--database", base, "--output", tmp_path / "outj", "--format", "json") == 0
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).count() == 2
    # the book-centric document and back
    parsed = extract.items(files.markdown(spark, f"file://{repo}/notes")).select(F.col("book_title").alias("title"), "author_first_name", "author_last_name", F.when(F.col("book_title") == "T", "2020-01-01").alias("date_read"), "source_file", "section", "seq.place", "seq.item_no", "content")
    files.write_book_index(parsed, f"file://{tmp_path}/books.json", "notes", "2024-01-01T00:00:00")
    held = json.loads((tmp_path / "books.json").read_text())
    assert held["total_books"] == 3 and held["books"][0]["title"] == "T" and held["books"][1]["date_read"] is None
    assert files.book_index(spark, f"file://{tmp_path}/books.json").count() == parsed.count()


def test_documents_are_written_in_parts(spark, tmp_path):
    rows = spark.range(3000).select((F.lit(2999) - F.col("id")).cast("int").alias("seq"), F.concat(F.lit('é "'), "id").alias("item_id"), F.lit(None).cast("string").alias("date_read")).repartition(7)
    path = tmp_path / "extraction_20240101_000000_abc.json"
    (tmp_path / "_parts-extraction_20240101_000000_abc.json").mkdir()  # a run that died
    files.write_log(rows, {"git_commit_hash": "abc", "previous_commit_hash": None}, f"file://{path}")
    held = json.loads(path.read_text())
    assert held["extraction_metadata"] == {"git_commit_hash": "abc", "previous_commit_hash": None}
    assert [i["item_id"] for i in held["items"]] == [f'é "{2999 - n}' for n in range(3000)] and held["items"][0]["date_read"] is None
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == [path.name]
    assert files.log(spark, f"file://{tmp_path}").where("item_id is not null and commit = 'abc'").count() == 3000
    with pytest.raises(FileExistsError):
        files.write_log(rows, {}, f"file://{path}")
    files.write_log(rows.limit(0), {}, f"file://{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == {"extraction_metadata": {}, "items": []}
    issues = spark.createDataFrame([(f'{n % 300:03d} "x" é.md', n, "error", "R", "m", "c", None, 0) for n in range(900)], "file string, line_no long, severity string, rule_id string, message string, context string, suggestion string, rule_no int")
    for some, n in ((issues, 300), (issues.limit(0), 0)):  # the second replaces the first
        files.write_report(some, f"file://{tmp_path}/r.json")
        held = json.loads((tmp_path / "r.json").read_text())["files"]
        assert [f["file"] for f in held] == [f'{i:03d} "x" é.md' for i in range(n)] and all(len(f["issues"]) == 3 for f in held)


class Asked:
    """A source that notes in a file what it is asked, knows nothing of keys that end in 7, and fails while `down` is there."""

    def __init__(self, folder):
        self.folder = folder

    def fetch(self, keys):
        if (self.folder / "down").exists() and "k120" in keys:
            raise OSError("no route")
        with open(self.folder / "asked", "a") as f:
            f.write("".join(k + "\n" for k in keys))
        return [(k, f"label of {k}") for k in keys if not k.endswith("7")]


def test_lookups_resume_and_ask_once(spark, tmp_path):
    cache = enrich_flow.answers(spark, f"file://{tmp_path}/cache", 8)
    keys = spark.createDataFrame([(f"k{i % 130:03d}",) for i in range(400)] + [(None,)], "id string")
    ask = lambda **how: enrich_flow.fetch(spark, Asked(tmp_path), keys, cache, 60000, batch=10, sleep=lambda s: None, **how)
    (tmp_path / "down").touch()
    with pytest.raises(OSError, match="no route"):
        ask(lanes=4)
    told = (tmp_path / "asked").read_text().split()
    assert len(told) == len(set(told)) == 120 and cache.read().count() == 120  # what others answered is kept
    (tmp_path / "down").unlink()
    got = {r["key"]: r["body"] for r in ask().collect()}
    assert got == {f"k{i:03d}": f"label of k{i:03d}" for i in range(130) if i % 10 != 7}
    told = (tmp_path / "asked").read_text().split()
    assert len(told) == len(set(told)) == 130
    assert len(ask().collect()) == 117 and (tmp_path / "asked").read_text().split() == told
    rows = spark.createDataFrame([(1, "Q1", ["Q2", "x", "Q17"]), (2, None, None)], "id int, place string, movements array<string>")
    named = enrich_flow.resolved(rows, ["place", "movements"], "id", Asked(tmp_path), cache, 60000, sleep=lambda s: None)
    assert {r["id"]: (r["place"], r["movements"]) for r in named.collect()} == {1: ("label of Q1", ["label of Q2", "x", "Q17"]), 2: (None, None)}


def test_enrichment_flow(spark):
    now = [0.0]
    bucket = enrich_flow.TokenBucket(60, 2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    at = []
    for _ in range(5):
        bucket.take()
        at.append(round(now[0], 6))
    now[0] += 100  # no more than a burst is saved up
    for _ in range(3):
        bucket.take()
        at.append(round(now[0], 6))
    assert at == [0, 0, 1, 2, 3, 103, 103, 104]
    with pytest.raises(OSError):
        enrich_flow.retried(lambda: (_ for _ in ()).throw(OSError()), sleep=lambda s: None)()
    rows = spark.createDataFrame([(1, "Q1", ["Q2", "Quakers"]), (2, None, None)], "id int, place string, movements array<string>")
    labels = spark.createDataFrame([("Q1", "one"), ("Q2", "two")], "qid string, label string")
    got = {r["id"]: (r["place"], r["movements"]) for r in enrich_flow.labelled(rows, ["place", "movements"], labels, "id").collect()}
    assert got == {1: ("one", ["two", "Quakers"]), 2: (None, None)}


def test_two_consumers_and_a_late_file(spark, tmp_path):
    (tmp_path / "log").mkdir()

    def put(stamp, *ops):
        body = [dict(zip([c.split()[0] for c in ITEM.split(", ")], (i, op, "T", "F", "L", "s", x, "f", None), strict=True)) for i, op, x in ops]
        (tmp_path / "log" / f"extraction_{stamp}_000000_abc.json").write_text(json.dumps({"extraction_metadata": {"git_commit_hash": stamp}, "items": body}))

    a, b = (apply.table(spark, f"file://{tmp_path}/{n}", 8) for n in "ab")
    put("20240102", ("x", "update", "new"), ("y", "add", "1"))
    apply.run(spark, str(tmp_path / "log"), a, f"file://{tmp_path}/ca")
    put("20240101", ("x", "add", "old"), ("z", "add", "2"))  # arrives late
    apply.run(spark, str(tmp_path / "log"), a, f"file://{tmp_path}/ca")
    apply.run(spark, str(tmp_path / "log"), b, f"file://{tmp_path}/cb")
    state = lambda t: sorted((r["item_id"], r["content"]) for r in t.read().collect())
    assert state(a) == state(b) == [("x", "new"), ("y", "1"), ("z", "2")]
    counts = apply.windowed_counts(spark.createDataFrame([("2024-01-01 00:00:10", "k"), ("2024-01-01 00:00:50", "k"), ("2024-01-01 00:01:10", "k")], "t string, k string").withColumn("t", F.to_timestamp("t")), "t", "1 minute", "1 minute", "k")
    assert sorted(r["n"] for r in counts.collect()) == [1, 2]


def size(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_buckets_write_what_changes(spark, tmp_path):
    t = Buckets(spark, f"file://{tmp_path}/t", "k", 16)
    rows = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"), F.array("id").alias("l"))
    assert t.read() is None and t.commit(rows, info={"x": 1}) == 1 and t.read().count() == 4000
    # the same rows, dealt and ordered otherwise: nothing is written
    assert t.commit(rows.repartition(7).orderBy(F.desc("v"))) == 1
    whole = size(tmp_path / "t" / "v=1")
    changed = rows.withColumn("v", F.when(F.col("k") == "k7", F.lit(-1)).otherwise(F.col("v")))
    assert t.commit(changed) == 2 and 0 < size(tmp_path / "t" / "v=2") < whole / 8
    ops = spark.createDataFrame([("k7", 70, [7], "update"), ("new", 1, None, "add"), ("k8", None, None, "delete")], "k string, v long, l array<long>, operation string")
    assert t.merge(ops, ["v", "l"], batch=5) == 3 and 0 < size(tmp_path / "t" / "v=3") < whole / 4
    assert t.merge(ops, ["v", "l"], batch=5) == 3 and t.state() == {"version": 3, "batch": 5, "info": {"x": 1}}
    got = {r["k"]: (r["v"], r["l"]) for r in t.read().collect()}
    assert len(got) == 4000 and got["k7"] == (70, [7]) and got["new"] == (1, None) and "k8" not in got and got["k9"] == (9, [9])
    # died while writing data, and over a pointer
    (tmp_path / "t" / "v=4" / "_bucket=1").mkdir(parents=True)
    (tmp_path / "t" / "_pointers" / "000000000004").write_text('{"batch": 9, "in')
    assert t.state()["version"] == 3 and t.read().count() == 4000 and t.read(1).count() == 4000
    with pytest.raises(Exception, match="outside the buckets"):
        t.rewrite(ops.where("k = 'k7'").select("k"), lambda old: old.unionByName(rows))
    # old versions go, and with them the buckets that no kept version names
    before = size(tmp_path / "t")
    assert t.expire(1) == [1, 2] and size(tmp_path / "t") < before and t.read().count() == 4000 and {r["k"]: (r["v"], r["l"]) for r in t.read().collect()} == got
    assert t.commit(rows.limit(0)) > 4 and t.read().count() == 0 and t.read().columns == ["k", "v", "l"]


def test_stream_is_the_replay(spark, tmp_path):
    """Files out of order, repeated operations, a batch run again: the table is the replay of the log, and a batch writes what it changes."""
    rng = random.Random(11)
    names = [c.split()[0] for c in ITEM.split(", ")]
    folder = tmp_path / "log"
    folder.mkdir()
    ops = {n: [(f"i{rng.randrange(40)}", rng.choice(["add", "update", "update", "delete"]), f"{n}-{j}") for j in range(25)] for n in range(12)}
    ops[12] = [("hot", "update", str(j)) for j in range(3000)] + [("i1", "delete", "")]
    to, order = apply.table(spark, f"file://{tmp_path}/t", 32), list(ops)
    rng.shuffle(order)
    for some in (order[:5], order[5:9], order[9:]):
        for n in some:
            body = [dict(zip(names, (i, op, "T", "F", "L", None, x, "f", None), strict=True)) for i, op, x in ops[n]]
            (folder / f"extraction_202401{n + 1:02d}_000000_abc.json").write_text(json.dumps({"extraction_metadata": {"git_commit_hash": str(n)}, "items": body}))
        apply.run(spark, str(folder), to, f"file://{tmp_path}/c", files=3)
        log = files.log(spark, str(folder))
        want = {r["item_id"]: r["content"] for r in cdc.replay(log, "item_id", ["name", "pos"], "operation", ["content"]).collect()}
        assert {r["item_id"]: r["content"] for r in to.read().collect()} == want
    # a file of one item, then the same operations once more
    held = to.state()["version"]
    body = [dict(zip(names, ("i2", "update", "T", "F", "L", None, "last", "f", None), strict=True))]
    (folder / "extraction_20240301_000000_abc.json").write_text(json.dumps({"extraction_metadata": {}, "items": body}))
    apply.run(spark, str(folder), to, f"file://{tmp_path}/c")
    assert to.read().where("item_id = 'i2'").first()["content"] == "last"
    new = tmp_path / "t" / f"v={to.state()['version']}"
    assert to.state()["version"] == held + 1 and len(list(new.glob("_bucket=*"))) == 1
    # the checkpoint is lost after the commit: the same batch numbers come again and change nothing
    rows = {tuple(r) for r in to.read().collect()}
    assert to.merge(spark.createDataFrame([("i2", "delete", "x", 1, *[None] * 7)], apply.CHANGE), ["name", "pos", *apply.VALUES], batch=to.state()["batch"]) == held + 1
    assert {tuple(r) for r in to.read().collect()} == rows


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.reach(edges, 1, 3).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_embeddings_do_not_depend_on_batches(spark):
    texts = [("a b", 0), (None, 1), ("", 2), *((f"word{i} and {i % 7}", i) for i in range(3, 40))]
    rows = spark.createDataFrame(texts, "text string, id int")
    model = vector_store.HashEmbedder(16)
    want = {i: model.encode([t or ""])[0].tolist() for t, i in texts}
    for parts, batch in ((1, 256), (7, 3), (3, 1)):
        got = rows.repartition(parts).select("id", vector_store.embedded(F.col("text"), lambda: vector_store.HashEmbedder(16), batch).alias("v"))
        assert {r["id"]: r["v"] for r in got.collect()} == want

    class Short(vector_store.HashEmbedder):
        def encode(self, texts):
            return super().encode(texts)[:, :-1]

    with pytest.raises(Exception, match="made"):
        rows.select(vector_store.embedded(F.col("text"), Short(16))).collect()


def test_hops_end_in_cycles_and_plans_stay_small(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 0), (2, 2), (None, 3), (3, None)], "src long, dst long")
    got = graph.reach(edges, 0, 50)
    assert sorted(tuple(r) for r in got.collect()) == [(i, i) for i in range(7)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_upserts_keep_their_order(spark):
    old = spark.createDataFrame([("a", "A", "2020"), ("b", "B", None)], "book_id string, title string, date_read string")
    rows = spark.createDataFrame([("a", "run1-first", None, 1, 0), ("a", "run1-later", "1999", 1, 1), ("b", "x", "2021", 1, 2), ("b", "y", None, 2, 0), ("b", "z", "2022", 2, 1), ("c", "new", None, 2, 2)], "book_id string, title string, date_read string, run int, n int")
    assert sorted(tuple(r) for r in load.books_over_runs(old, rows, "run", ["n"]).collect()) == [("a", "run1-first", "2020"), ("b", "y", "2021"), ("c", "new", None)]
    names = spark.createDataFrame([("n", "1", 1), ("n", "3", 3), ("n", "2", 2)], "name string, v string, at int")
    assert [tuple(r) for r in load.upserted(names.limit(0).select("name", "v"), names, "name", ["v"], ["at"]).collect()] == [("n", "3")]
    known = spark.createDataFrame([("jane-doe", "Jane Doe", None), ("x", "Old Name", "Q1"), ("poe", "Poe", "Q9")], "author_id string, name string, external_id string")
    wanted = spark.createDataFrame([("Q1", "Another Name"), ("Q2", "Jane Doe"), ("Q3", "Poe"), ("Q4", "Fresh One")], "external_id string, name string")
    assert sorted(tuple(r) for r in load.authors_found(known, wanted).collect()) == [("fresh-one", "Fresh One", "Q4"), ("jane-doe", "Jane Doe", "Q2"), ("poe", "Poe", "Q3"), ("x", "Old Name", "Q1")]


def test_database(spark, tmp_path):
    base = Database(spark, "some_notes", f"file://{tmp_path}/db")
    rows = spark.createDataFrame([(1, "a")], "n long, t string")
    assert base.create("one", rows) and not base.create("one", rows.limit(0)) and base.read("one").count() == 1 and base.tables() == ["one"]
    base.append("one", rows.select("t", "n"))
    assert [tuple(r) for r in base.read("one").collect()] == [(1, "a")] * 2 and (tmp_path / "db" / "one").exists()
    with pytest.raises(Exception):
        base.append("one", rows.withColumn("x", F.lit(1)))
    with pytest.raises(Exception):
        base.append("two", rows)
    assert base.create("one", rows.select("t"), replace=True) and [tuple(r) for r in base.columns().collect()] == [("one", 1, "t", "string", True)]
    assert base.drop("one") and not base.drop("one") and not base.exists("one") and base.columns().count() == 0
    base.clear()
    assert not spark.catalog.databaseExists("some_notes")
