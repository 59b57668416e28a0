"""Validation rules over lines (file, line_no, line) -> issues.

Rules that need one line only are one pass: an array of what each finds, exploded. Rules that need a section or book read
counts of headers from one window a file. An issue is (file, line_no, severity, rule_id, message, context, suggestion, rule_no);
rule_no orders the issues of a line. Null lines are no lines.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import SPACE, pystrip
from .markdown import SECTIONS

#: Malformed page citations, and what is said of them.
MALFORMED = (
    (r"\(p\.(\d+)\)", "Missing space after 'p.'"),
    (r"\(p\s(\d+\))", "Missing period after 'p'"),
    (r"\(pg\.\s*\d+\)", "Use 'p.' instead of 'pg.'"),
    (r"\(page\s+\d+\)", "Use 'p.' instead of 'page'"),
    (r"\(p\,\s*\d+\)", "Use 'p.' instead of 'p,'"),
)
#: A citation of any format.
CITATION = r"\([^)]*\d+[^)]*\)"
ISSUE = ("file", "line_no", "severity", "rule_id", "message", "context", "suggestion", "rule_no")
KINDS = ("error", "warning", "info")


def _java(pattern: str) -> str:
    """White space and digits of any script, as in the rules' own terms."""
    return pattern.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")


def _found(when: Column, severity: str, rule: str, number: int, message: Column | str, context: Column, suggestion: Column | str | None = None) -> Column:
    lit = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id"), lit(message).alias("message"), context.alias("context"), lit(suggestion).cast("string").alias("suggestion"), F.lit(number).alias("rule_no")))


def _local() -> list[Column]:
    """What the rules that need one line only find in `line`."""
    line, bare = F.col("line"), pystrip("line")
    title, name = pystrip(F.expr("substring(line, 3)")), pystrip(F.regexp_extract("line", f"(?s)^##{SPACE}+(.+)$", 1))
    known = F.lower(name).isin(*SECTIONS)
    say = lambda *x: F.concat(*[F.lit(s) if isinstance(s, str) else s for s in x])
    out = [
        _found(line.startswith("# ") & F.lower(title).isin(*SECTIONS), "error", "HEADER_003", 0, say("Book title '", title, "' is a canonical section name and should not be used as a book title"), bare),
        _found(line.startswith("###"), "error", "HEADER_001", 1, "Headers deeper than level 2 are not supported", bare, "Use ## for sections within books"),
        _found(line.rlike(r"^#{1,2}[^#" + SPACE[1:]), "error", "HEADER_002", 2, "Missing space after # in header", bare, pystrip(F.regexp_replace("line", r"^(#{1,2})", "$1 "))),
        _found(known & (name != F.lower(name)), "warning", "SECTION_001", 3, say("Inconsistent capitalization for section '", name, "'. Expected: '", F.lower(name), "'"), bare, say("## ", F.lower(name))),
    ]
    item = bare.startswith("- ") & ~line.startswith("    ")
    for i, (pattern, fault) in enumerate(MALFORMED):
        p = _java(pattern)
        number = F.regexp_extract(F.regexp_extract("line", p, 0), r"\p{Nd}+", 0)
        fixed = pystrip(F.regexp_replace(line, F.lit(p), say("(p. ", number, ")")))
        out.append(_found(item & line.rlike(p), "error", "CITATION_001", 5 + i, f"Malformed page citation: {fault}", bare, fixed))
    indent = F.length(F.regexp_extract("line", f"^( *)-{SPACE}", 1))
    right = F.regexp_replace(line, f"{SPACE}+$", "")
    moved = F.concat(F.repeat(F.lit(" "), (F.floor(indent / 4) * 4).cast("int")), F.ltrim(right))
    out.append(_found(line.rlike(f"^{SPACE}*[*+]{SPACE}"), "warning", "LIST_001", 11, "Use '-' for list items instead of '*' or '+'", bare, F.regexp_replace(bare, r"^[*+]", "-")))
    out.append(_found(line.rlike(f"^ *-{SPACE}") & (indent % 4 != 0), "warning", "LIST_002", 12, say("List item indentation should be a multiple of 4 spaces (found ", indent.cast("string"), " spaces)"), right, moved))
    return out


@F.pandas_udf(ArrayType(StringType()))
def close_matches(names: pd.Series) -> pd.Series:
    near = {n: difflib.get_close_matches(n, SECTIONS, n=3, cutoff=0.7) for n in names.dropna().unique()}
    return names.map(lambda n: near.get(n))


def _issues(df: DataFrame, found: Column) -> DataFrame:
    return df.select("file", "line_no", found.alias("i")).where("i is not null").select("file", "line_no", "i.*").select(*ISSUE)


def _unknown(rows: DataFrame) -> DataFrame:
    """SECTION_002. Names are few: the fuzzy match runs on distinct ones."""
    name = pystrip(F.regexp_extract("line", f"(?s)^##{SPACE}+(.+)$", 1))
    named = rows.withColumn("name", name).where((F.col("name") != "") & ~F.lower("name").isin(*SECTIONS))
    near = named.select(F.lower("name").alias("low")).distinct().withColumn("near", close_matches("low")).where(F.size("near") > 0)
    both = named.join(near, F.lower("name") == F.col("low"))
    message = F.concat(F.lit("Unusual section name '"), "name", F.lit("'. Did you mean: "), F.array_join("near", ", "), F.lit("?"))
    return _issues(both, _found(F.lit(True), "info", "SECTION_002", 4, message, pystrip("line"), F.concat(F.lit("## "), F.col("near")[0])))


def _placed(rows: DataFrame) -> DataFrame:
    """Lines with their section (by `## ` alone), header and book; all from one sort of each file."""
    by = Window.partitionBy("file").orderBy("line_no")
    line = F.col("line")
    rest, low = pystrip(F.expr("substring(line, 3)")), line.startswith("## ")
    top = line.startswith("# ")
    title = top & ~F.lower(rest).isin(*SECTIONS)
    head = F.when(title, F.struct(F.lit(True).alias("is_title"), rest.alias("name"))).when(top | low, F.struct(F.lit(False).alias("is_title"), F.when(top, rest).otherwise(pystrip(F.expr("substring(line, 4)"))).alias("name")))
    df = rows.where("line is not null").withColumn("head", head)
    df = df.withColumns({"part": F.sum(low.cast("int")).over(by), "head_no": F.sum(F.col("head").isNotNull().cast("int")).over(by), "book_no": F.sum(F.coalesce(F.col("head.is_title"), F.lit(False)).cast("int")).over(by), "under": F.last("head", ignorenulls=True).over(by)})
    return df.withColumn("title", F.last(F.when(F.col("head.is_title"), F.col("head.name")), ignorenulls=True).over(by)).withColumn("header", F.last(F.when(low, pystrip("line")), ignorenulls=True).over(by))


def _uncited(placed: DataFrame) -> DataFrame:
    """CITATION_002: items without a citation between cited ones of their section."""
    bare = pystrip("line")
    item = bare.startswith("- ") & ~F.col("line").startswith("    ")
    cited = F.col("line").rlike(_java(r"\(p\.\s+(\d+)\)"))
    own = Window.partitionBy("file", "part").orderBy("line_no")
    df = placed.where(item & (F.col("part") > 0)).withColumn("cited", cited)
    df = df.withColumns({"before": F.lag("cited").over(own), "later": F.max("cited").over(own.rowsBetween(1, Window.unboundedFollowing))})
    message = F.concat(F.lit("Missing page citation after item with citation in section '"), "header", F.lit("'"))
    return _issues(df.where(~F.col("cited") & F.col("before") & F.col("later")), _found(F.lit(True), "warning", "CITATION_002", 10, message, bare))


def _hollow(placed: DataFrame) -> DataFrame:
    """CONTENT_001 and CONTENT_002: sections, and books, without a line of content below a named section of a named book."""
    bare = pystrip("line")
    counts = F.col("head").isNull() & (F.col("title") != "") & ~F.col("under.is_title") & (F.col("under.name") != "") & (bare != "") & ~bare.startswith("#")
    df = placed.withColumn("content", F.coalesce(counts, F.lit(False)))
    start = F.min(F.when(F.col("head").isNotNull(), F.struct("line_no", "head.is_title", "head.name"))).alias("start")
    parts = df.where("head_no > 0").groupBy("file", "book_no", "head_no").agg(F.max("content").alias("content"), start)
    section = parts.where("not content and not start.is_title and start.name <> ''").select("file", "start.line_no", F.col("start.name").alias("name"))
    books = parts.where("book_no > 0").groupBy("file", "book_no").agg(F.max("content").alias("content"), F.min(F.when(F.col("start.is_title"), F.struct("start.line_no", "start.name"))).alias("start"))
    book = books.where("not content and start.name <> ''").select("file", "start.line_no", F.col("start.name").alias("name"))
    one = _issues(section, _found(F.lit(True), "error", "CONTENT_001", 13, F.concat(F.lit('Section "'), "name", F.lit('" has no content')), F.concat(F.lit("## "), "name"), "Add content to the section or remove it"))
    return one.unionByName(_issues(book, _found(F.lit(True), "error", "CONTENT_002", 14, F.concat(F.lit('Book "'), "name", F.lit('" has no sections with content')), F.concat(F.lit("# "), "name"), "Add sections with content to the book")))


def _unlike(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """PATTERN_001 and PATTERN_002: section names that differ from the learned ones (pattern_type, value). Sizes decide how patterns are joined."""
    learned = patterns.where("pattern_type = 'section_name'").select(F.lower("value").alias("key"), "value").groupBy("key").agg(F.max("value").alias("value"))
    named = rows.where(F.col("line").startswith("## ")).withColumn("name", pystrip(F.expr("substring(line, 4)")))
    both = named.join(learned, F.lower("name") == F.col("key"), "left")
    other = F.concat(F.lit("Section capitalization differs from learned pattern. Expected: '"), "value", F.lit("', Found: '"), "name", F.lit("'"))
    unknown = F.concat(F.lit("Section name '"), "name", F.lit("' not found in learned patterns"))
    differs = _found(F.col("value").isNotNull() & (F.col("name") != F.col("value")), "warning", "PATTERN_001", 15, other, pystrip("line"), F.concat(F.lit("## "), "value"))
    return _issues(both, F.coalesce(differs, _found(F.col("value").isNull(), "info", "PATTERN_002", 15, unknown, pystrip("line"))))


def local(rows: DataFrame) -> DataFrame:
    """Issues of the rules that need one line only, in one pass."""
    return rows.where("line is not null").select("file", "line_no", F.explode(F.filter(F.array(*_local()), lambda x: x.isNotNull())).alias("i")).select("file", "line_no", "i.*").select(*ISSUE)


def _heads(rows: DataFrame) -> DataFrame:
    """A row for each header of a file, with what its lines say; the lines before the first header are one too (head_no 0).

    found: issues of single lines, names of unknown sections among them; lacking: items without a citation after one with, each with
    the number of cited items up to it; cited: that number at the end; text: whether a line of content follows; start: the header.
    Lines go through one exchange and one sort; from here on a row is a header.
    """
    by = Window.partitionBy("file").orderBy("line_no")
    line, bare = F.col("line"), F.col("bare")
    low, top = line.startswith("## "), line.startswith("# ")
    rest = pystrip(F.expr("substring(line, 3)"))
    title = top & ~F.lower(rest).isin(*SECTIONS)
    head = F.when(top | low, F.struct("line_no", title.alias("is_title"), F.when(top, rest).otherwise(pystrip(F.expr("substring(line, 4)"))).alias("name")))
    df = rows.where("line is not null").select("file", "line_no", "line").withColumn("bare", pystrip("line")).withColumn("head", head)
    item = bare.startswith("- ") & ~line.startswith("    ")
    cited = line.rlike(_java(r"\(p\.\s+(\d+)\)"))
    so_far, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    n = lambda when: F.sum(when.cast("int")).over(so_far)
    df = df.withColumns({"item": item, "is_cited": item & cited, "part": n(low)})
    df = df.withColumns(
        {
            "head_no": n(F.col("head").isNotNull()),
            "book_no": n(F.coalesce(F.col("head.is_title"), F.lit(False))),
            "cited": n(F.col("is_cited")),
            "header": F.last(F.when(low, bare), ignorenulls=True).over(so_far),
            "last": F.last(F.when(F.col("item"), F.struct("part", "is_cited")), ignorenulls=True).over(before),
        }
    )
    name = pystrip(F.regexp_extract("line", f"(?s)^##{SPACE}+(.+)$", 1))
    unknown = _found((name != "") & ~F.lower(name).isin(*SECTIONS), "info", "SECTION_002", 4, name, bare)
    message = F.concat(F.lit("Missing page citation after item with citation in section '"), "header", F.lit("'"))
    after = F.col("item") & ~F.col("is_cited") & (F.col("part") > 0) & (F.col("last.part") == F.col("part")) & F.col("last.is_cited")
    lacking = F.when(after, F.struct("cited", F.struct("line_no", _found(F.lit(True), "warning", "CITATION_002", 10, message, bare).alias("i")).alias("at")))
    own = F.filter(F.array(*_local(), unknown), lambda x: x.isNotNull())
    df = df.select("file", "head_no", "book_no", "part", "head", "cited", lacking.alias("lacking"), F.transform(own, lambda i: F.struct(F.col("line_no"), i.alias("i"))).alias("own"), (F.col("head").isNull() & (bare != "") & ~bare.startswith("#")).alias("text"))
    return df.groupBy("file", "head_no", "book_no", "part").agg(F.flatten(F.collect_list("own")).alias("found"), F.collect_list("lacking").alias("lacking"), F.max("cited").alias("cited"), F.max("text").alias("text"), F.max("head").alias("start"))


def validate(rows: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """All issues; their order is (file, line_no, rule_no). patterns: what learn() returns, for the rules that use it.

    One scan, one exchange and one sort of the lines feed every rule that needs no patterns.
    """
    heads = _heads(rows)
    book, part = Window.partitionBy("file", "book_no"), Window.partitionBy("file", "part")
    is_title, name = F.col("start.is_title"), F.col("start.name")
    heads = heads.withColumn("title", F.max(F.when(is_title, name)).over(book))
    content = F.coalesce(F.col("text") & (F.col("title") != "") & ~is_title & (name != ""), F.lit(False))
    heads = heads.withColumn("content", content).withColumn("full", F.max("content").over(book)).withColumn("all_cited", F.max("cited").over(part))
    cited_later = F.transform(F.filter("lacking", lambda x: x["cited"] < F.col("all_cited")), lambda x: x["at"])
    section = _found(~F.col("content") & ~is_title & (name != ""), "error", "CONTENT_001", 13, F.concat(F.lit('Section "'), name, F.lit('" has no content')), F.concat(F.lit("## "), name), "Add content to the section or remove it")
    whole = _found((F.col("book_no") > 0) & ~F.col("full") & is_title & (name != ""), "error", "CONTENT_002", 14, F.concat(F.lit('Book "'), name, F.lit('" has no sections with content')), F.concat(F.lit("# "), name), "Add sections with content to the book")
    hollow = F.transform(F.filter(F.array(section, whole), lambda x: x.isNotNull()), lambda i: F.struct(F.col("start.line_no").alias("line_no"), i.alias("i")))
    out = heads.select("file", F.explode(F.concat("found", cited_later, hollow)).alias("x")).select("file", "x.line_no", "x.i.*")
    # the names of unknown sections, alone, are held against the known ones
    fuzzy = F.col("rule_id") == "SECTION_002"
    out = out.withColumn("near", close_matches(F.when(fuzzy, F.lower("message")))).where(~fuzzy | (F.size("near") > 0))
    message = F.concat(F.lit("Unusual section name '"), "message", F.lit("'. Did you mean: "), F.array_join("near", ", "), F.lit("?"))
    out = out.withColumns({"message": F.when(fuzzy, message).otherwise(F.col("message")), "suggestion": F.when(fuzzy, F.concat(F.lit("## "), F.get("near", F.lit(0)))).otherwise(F.col("suggestion"))}).select(*ISSUE)
    return out if patterns is None else out.unionByName(_unlike(rows, patterns))


def of_rule(rows: DataFrame, rule: str, patterns: DataFrame | None = None) -> DataFrame:
    """The issues of one rule, by the pass that it needs."""
    kind = rule.partition("_")[0]
    if rule == "SECTION_002":
        found = _unknown(rows)
    elif rule == "CITATION_002":
        found = _uncited(_placed(rows))
    elif kind == "CONTENT":
        found = _hollow(_placed(rows))
    elif kind == "PATTERN":
        found = _unlike(rows, patterns)
    else:
        found = local(rows)
    return found.where(F.col("rule_id") == rule)


def summary(issues: DataFrame) -> DataFrame:
    """Per file with issues: errors, warnings, infos, has_errors, has_warnings, is_clean."""
    counts = issues.groupBy("file").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in KINDS])
    return counts.withColumns({"has_errors": F.col("errors") > 0, "has_warnings": F.col("warnings") > 0, "is_clean": F.col("errors") + F.col("warnings") + F.col("infos") == 0})


def learn(rows: DataFrame) -> DataFrame:
    """Section names by lower-case form: frequency, commonest spelling (ties: first seen), share, up to five spellings as first seen; and the ten
    commonest citation formats (ties: first seen) with their shares of all citations."""
    named = rows.where(F.col("line").startswith("## ")).withColumn("name", pystrip(F.expr("substring(line, 4)")))
    counts = named.groupBy(F.lower("name").alias("key"), "name").agg(F.count("*").alias("n"), F.min(F.struct("file", "line_no")).alias("seen"))
    first = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("seen", "name"))), 1, 5), lambda x: x["name"])  # spellings of one name
    most = F.max("n")
    names = counts.withColumn("top", most.over(Window.partitionBy("key"))).groupBy("key").agg(F.min(F.when(F.col("n") == F.col("top"), F.struct("seen", "name")))["name"].alias("value"), F.sum("n").alias("frequency"), first.alias("examples"))
    cited = rows.select("file", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(CITATION), 0)).alias("pos", "key"))
    formats = cited.groupBy("key").agg(F.count("*").alias("frequency"), F.min(F.struct("file", "line_no", "pos")).alias("seen"))
    formats = formats.select("key", F.col("key").alias("value"), "frequency", F.array("key").alias("examples"), "seen")

    def shared(df: DataFrame, kind: str) -> DataFrame:
        out = df.join(F.broadcast(df.agg(F.sum("frequency").alias("all"))), how="cross")  # one row
        return out.withColumn("pattern_type", F.lit(kind)).withColumn("confidence", F.col("frequency") / F.col("all"))

    order = ["pattern_type", "key", "value", "frequency", "examples", "confidence"]
    top = shared(formats, "citation_format").orderBy(F.desc("frequency"), "seen").limit(10)
    return shared(names, "section_name").select(*order).unionByName(top.select(*order))


def fixes(rows: DataFrame, issues: DataFrame, dry_run: bool = False) -> DataFrame:
    """A row for each line that a suggestion names: file, line_no, line (null where there is no such line), fixed, wanted, applied.

    The suggestions of a line are applied in the order of their rules, each if the line, as those before it left it, still is its
    context (white space at the ends apart); a line keeps its ending. In a dry run each is held against the line as it is, and no
    line changes.
    """
    wanted = issues.where("suggestion is not null and suggestion <> ''").groupBy("file", "line_no").agg(F.sort_array(F.collect_list(F.struct("rule_no", "context", "suggestion"))).alias("steps"))  # a line has a few issues
    both = wanted.join(rows.select("file", "line_no", "line"), ["file", "line_no"], "left")
    ending = F.regexp_extract("line", r"(\r*)$", 1)

    def step(held: Column, x: Column) -> Column:
        fits = F.coalesce(pystrip(held["line"]) == pystrip(x["context"]), F.lit(False))
        made = held["line"] if dry_run else F.when(fits, F.concat(x["suggestion"], ending)).otherwise(held["line"])
        return F.struct(made.alias("line"), (held["n"] + fits.cast("int")).alias("n"))

    done = F.aggregate("steps", F.struct(F.col("line").alias("line"), F.lit(0).alias("n")), step)
    both = both.withColumn("done", done)
    return both.select("file", "line_no", F.col("done.line").alias("line"), ((F.col("done.n") > 0) & F.lit(not dry_run)).alias("fixed"), F.size("steps").alias("wanted"), F.col("done.n").alias("applied"))


def fix(rows: DataFrame, issues: DataFrame, dry_run: bool = False) -> DataFrame:
    """All lines (file, line_no, line, fixed), those changed that fixes() changes."""
    done = fixes(rows, issues, dry_run).where("fixed").select("file", "line_no", F.col("line").alias("new"))
    return rows.join(done, ["file", "line_no"], "left").select("file", "line_no", F.coalesce("new", "line").alias("line"), F.col("new").isNotNull().alias("fixed"))


def fix_counts(rows: DataFrame, issues: DataFrame, dry_run: bool = False) -> DataFrame:
    """total, applied, skipped, failed of a run that says yes to every issue with a suggestion."""
    done = fixes(rows, issues, dry_run).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(y) for x, y in (("wanted", "total"), ("applied", "applied"))])
    return done.select("total", "applied", F.lit(0).cast("long").alias("skipped"), (F.col("total") - F.col("applied")).alias("failed"))
