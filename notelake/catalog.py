"""Registered queries, by operator id, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import cdc, enrich, enrich_flow, graph, load, markdown, quality_rules, search, vector_store
from .plans.views import duck, view
from .sources import files, shared
from .sources.buckets import Buckets
from .sources.tables import Database
from .streaming import apply

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a function of views under an operator id."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return put


c = F.col

# --- change data capture ---------------------------------------------------------------------------------------------

_REPLAY = """WITH gone AS (SELECT item_id, max((ts, pos)) AS gone FROM log WHERE operation = 'delete' GROUP BY item_id),
alive AS (SELECT l.* FROM log l LEFT JOIN gone g ON l.item_id = g.item_id WHERE operation <> 'delete' AND (gone IS NULL OR (l.ts, l.pos) > gone))
"""


@query("CDC-05", "log", sql=_REPLAY + "SELECT item_id, arg_max(value, (ts, pos)) AS value FROM alive GROUP BY item_id")
def _(log):
    return cdc.replay(log, "item_id", ["ts", "pos"], "operation", ["value"]).select("item_id", "value")


@query("CDC-06", "log", sql=_REPLAY + "SELECT item_id, arg_max(value, (ts, pos)) AS value, arg_min(pos, (ts, pos)) AS place FROM alive GROUP BY item_id")
def _(log):
    return cdc.replay(log, "item_id", ["ts", "pos"], "operation", ["value"]).select("item_id", "value", c("place.pos").alias("place"))


_SIDES = """WITH p AS (SELECT user_id AS item_id, max(value) AS v FROM events WHERE event_id % 5 < 3 AND user_id % 10 <> 3 GROUP BY user_id),
n AS (SELECT user_id AS item_id, max(value) AS v FROM events WHERE event_id % 5 > 1 AND user_id % 10 <> 7 GROUP BY user_id),
d AS (SELECT coalesce(n.item_id, p.item_id) AS item_id, coalesce(n.v, p.v) AS v, CASE WHEN p.item_id IS NULL THEN 'add' WHEN n.item_id IS NULL THEN 'delete' WHEN p.v <> n.v THEN 'update' END AS operation
FROM p FULL JOIN n ON p.item_id = n.item_id)
"""


def _sides(events):
    side = lambda f: events.where(f).groupBy(c("user_id").alias("item_id")).agg(F.max("value").alias("v"))
    return side("event_id % 5 < 3 and user_id % 10 <> 3"), side("event_id % 5 > 1 and user_id % 10 <> 7")


@query("CDC-03", "events", sql=_SIDES + "SELECT * FROM d WHERE operation IS NOT NULL")
def _(events):
    return cdc.diff(*_sides(events), "item_id", ["v"])


@query("CDC-04", "events", sql="SELECT user_id AS item_id, max(value) AS v, 'add' AS operation FROM events GROUP BY user_id")
def _(events):
    now = events.groupBy(c("user_id").alias("item_id")).agg(F.max("value").alias("v"))
    return cdc.diff(now.limit(0), now, "item_id", ["v"])


@query("JOI-11", "events", sql=_SIDES + "SELECT operation, count(*) AS n FROM d WHERE operation IS NOT NULL GROUP BY operation")
def _(events):
    return cdc.diff(*_sides(events), "item_id", ["v"]).groupBy("operation").agg(F.count("*").alias("n"))


@query("SET-06", "events", sql=_SIDES + "SELECT item_id, v FROM p WHERE item_id NOT IN (SELECT item_id FROM n)")
def _(events):
    p, n = _sides(events)
    return p.join(n, "item_id", "left_anti")


@query("CDC-08", "texts", sql="SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM texts GROUP BY source, lang")
def _(texts):
    return texts.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SRC-03", "log", sql="SELECT item_id, pos FROM log WHERE day = (SELECT max(day) FROM log )")
def _(log):
    return files.latest(log.withColumn("name", c("day").cast("string"))).select("item_id", "pos")


@query("SRC-04", "log", sql="SELECT item_id, pos FROM log WHERE day > (SELECT min(day) FROM log WHERE pos = 0)")
def _(log):
    start = log.where("pos = 0").agg(F.min("day").cast("string").alias("start"))
    rows = log.withColumn("name", c("day").cast("string"))
    return rows.join(F.broadcast(start), c("name") > c("start")).select("item_id", "pos")  # one row


@query("DML-01", "log", sql="SELECT operation AS key, CASE WHEN operation = 'add' THEN min(day) ELSE max(day) END::VARCHAR AS value FROM log GROUP BY operation")
def _(log):
    # a checkpoint a consumer: that of adds is old, the others are set again or for the first time
    old = log.where("operation in ('add', 'update')").groupBy(c("operation").alias("key")).agg(F.min("day").cast("string").alias("value"))
    new = log.where("operation <> 'add'").groupBy(c("operation").alias("key")).agg(F.max("day").cast("string").alias("value"))
    return cdc.merge(old, new.withColumn("operation", F.lit("update")), "key", ["value"])


@query("DML-02", "authors", "log", sql="SELECT name, coalesce(f, 'old') AS first, coalesce(l, nation::VARCHAR) AS last FROM authors FULL JOIN (SELECT 'Supplier#' || lpad((item_id % 400)::VARCHAR, 9, '0') AS name, arg_max(operation, (ts, pos)) AS f, arg_max(value::VARCHAR, (ts, pos)) AS l FROM log GROUP BY 1) USING (name)")
def _(authors, log):
    old = authors.select("name", F.lit("old").alias("first"), c("nation").cast("string").alias("last"))
    rows = log.select(F.concat(F.lit("Supplier#"), F.lpad((c("item_id") % 400).cast("string"), 9, "0")).alias("name"), c("operation").alias("first"), c("value").cast("string").alias("last"), "ts", "pos")
    return load.upserted(old, rows, "name", ["first", "last"], ["ts", "pos"])


@query(
    "DML-03-DATE",
    "books",
    "reading",
    sql="SELECT book_id, title, coalesce(n, o) AS date_read FROM (SELECT b.book_id, title, (SELECT max(date_read) FROM reading r WHERE r.book_id = b.book_id AND status = 'F') AS n, (SELECT max(date_read) FROM reading r WHERE r.book_id = b.book_id) AS o FROM books b)",
)
def _(books, reading):
    old = books.join(reading.groupBy("book_id").agg(F.max("date_read").alias("date_read")), "book_id", "left")
    new = books.join(reading.where("status = 'F'").groupBy("book_id").agg(F.max("date_read").alias("date_read")), "book_id", "left").withColumn("operation", F.lit("update"))
    return cdc.merge(old, new, "book_id", ["title", "date_read"], keep_old=True)


@query(
    "DML-03",
    "books",
    "log",
    sql="""WITH runs AS (SELECT item_id * 3 AS book_id, day, arg_min((operation || ' ' || pos::VARCHAR, CASE WHEN pos % 3 > 0 THEN pos::VARCHAR END), (ts, pos)) AS f FROM log GROUP BY 1, 2),
    new AS (SELECT book_id, arg_max(f[1], day) AS new_title, arg_max(f[2], day) FILTER (WHERE f[2] IS NOT NULL) AS new_date FROM runs GROUP BY book_id)
    SELECT book_id, coalesce(new_title, title) AS title, coalesce(new_date, CASE WHEN page_count > 0 THEN publisher END) AS date_read FROM books FULL JOIN new USING (book_id)""",
)
def _(books, log):
    # a day of the log is a run; a third of its rows have no date
    rows = log.select((c("item_id") * 3).alias("book_id"), "day", "ts", "pos", F.concat_ws(" ", "operation", c("pos").cast("string")).alias("title"), F.when(c("pos") % 3 > 0, c("pos").cast("string")).alias("date_read"))
    return load.books_over_runs(books.select("book_id", "title", F.when(c("page_count") > 0, c("publisher")).alias("date_read")), rows, "day", ["ts", "pos"])


@query("DML-04", "book_authors", sql="SELECT book_id, author_id FROM book_authors WHERE book_id % 2 = 0 UNION SELECT book_id, author_id FROM book_authors WHERE book_id % 3 = 0")
def _(links):
    have = links.where("book_id % 2 = 0")
    return have.unionByName(links.where("book_id % 3 = 0").join(have, ["book_id", "author_id"], "left_anti"))


ORACLES["JOI-15"] = ORACLES["DML-04"]
QUERIES["JOI-15"] = QUERIES["DML-04"]


@query(
    "DML-06",
    "events",
    sql=_SIDES + "SELECT item_id, CASE WHEN operation IS NULL THEN v ELSE v END AS v FROM d WHERE operation IS NULL OR operation <> 'delete'",
)
def _(events):
    p, n = _sides(events)
    return cdc.merge(p, cdc.diff(p, n, "item_id", ["v"]), "item_id", ["v"])


@query(
    "DML-07",
    "books",
    "book_subjects",
    "book_authors",
    "authors",
    "lineitem",
    sql="""WITH alive AS (SELECT DISTINCT l_partkey AS book_id FROM lineitem WHERE l_quantity > 49), b AS (SELECT book_id FROM books WHERE book_id IN (SELECT book_id FROM alive)),
s AS (SELECT book_id, subject_id FROM book_subjects WHERE book_id IN (SELECT book_id FROM b)), l AS (SELECT book_id, author_id FROM book_authors WHERE book_id IN (SELECT book_id FROM b)),
a AS (SELECT author_id FROM authors WHERE author_id IN (SELECT author_id FROM l)), t AS (SELECT DISTINCT subject_id FROM book_subjects WHERE subject_id IN (SELECT subject_id FROM s))
SELECT 'books' AS name, book_id::VARCHAR AS key FROM b UNION ALL SELECT 'book_subjects', book_id || '/' || subject_id FROM s UNION ALL SELECT 'book_authors', book_id || '/' || author_id FROM l
UNION ALL SELECT 'authors', author_id::VARCHAR FROM a UNION ALL SELECT 'subjects', subject_id FROM t""",
)
def _(books, book_subjects, book_authors, authors, lineitem):
    # books whose notes went, and all that hung on them
    notes = lineitem.where("l_quantity > 49").select(c("l_partkey").alias("book_id"))
    left = load.swept({"books": books, "book_subjects": book_subjects, "book_authors": book_authors, "authors": authors, "notes": notes, "subjects": book_subjects.select("subject_id").distinct()})
    keys = {"books": c("book_id").cast("string"), "book_subjects": F.concat_ws("/", c("book_id").cast("string"), "subject_id"), "book_authors": F.concat_ws("/", c("book_id").cast("string"), c("author_id").cast("string")), "authors": c("author_id").cast("string"), "subjects": c("subject_id")}
    out = None
    for name, key in keys.items():
        rows = left[name].select(F.lit(name).alias("name"), key.alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("JOI-09", "books", "book_authors", sql="SELECT count(*) AS orphans FROM books WHERE book_id NOT IN (SELECT book_id FROM book_authors WHERE author_id % 2 = 0)")
def _(books, links):
    return books.join(links.where("author_id % 2 = 0"), "book_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("DML-08", "books", sql="SELECT book_id, coalesce(CASE WHEN book_id % 2 = 0 THEN book_id END, page_count) AS page_count, title FROM books")
def _(books):
    new = books.select("book_id", F.when(c("book_id") % 2 == 0, c("book_id")).alias("page_count"))
    return enrich.merged(books.select("book_id", "page_count", "title"), new, "book_id", ["page_count"])


@query("DML-09", "lineitem", sql="SELECT l_partkey AS book_id, l_linestatus AS subject_id, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) AS source FROM lineitem GROUP BY 1, 2")
def _(lineitem):
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return lineitem.groupBy(c("l_partkey").alias("book_id"), c("l_linestatus").alias("subject_id")).agg(F.max_by("l_returnflag", at).alias("source"))


@query("DML-10", "books", sql="SELECT 'subject:' || substr(sha256(lower(kind)), 1, 16) AS id, arg_min(kind, book_id) AS name FROM books GROUP BY 1")
def _(books):
    return books.groupBy(T.hashed_id("subject", "kind").alias("id")).agg(F.min_by("kind", "book_id").alias("name"))


@query(
    "DML-11",
    "authors",
    sql="""WITH old AS (SELECT CASE WHEN author_id % 5 = 0 THEN 'other-' || author_id ELSE lower(replace(replace(name, '#', ''), ' ', '-')) END AS author_id, name, CASE WHEN author_id % 3 = 0 THEN 'Q' || author_id END AS external_id FROM authors WHERE author_id % 4 > 0),
    new AS (SELECT lower(replace(replace(name, '#', ''), ' ', '-')) AS author_id, min(('Q' || author_id, name)) AS n FROM authors WHERE author_id % 2 = 0 AND 'Q' || author_id NOT IN (SELECT external_id FROM old WHERE external_id IS NOT NULL) GROUP BY 1)
    SELECT author_id, coalesce(name, n[2]) AS name, coalesce(n[1], external_id) AS external_id FROM old FULL JOIN new USING (author_id)""",
)
def _(authors):
    # a quarter of the authors is new, a fifth has an id that is no slug, a third has its external id already
    ids = authors.withColumn("q", F.concat(F.lit("Q"), "author_id"))
    old = ids.where("author_id % 4 > 0").select(F.when(c("author_id") % 5 == 0, F.concat(F.lit("other-"), "author_id")).otherwise(T.slug("name")).alias("author_id"), "name", F.when(c("author_id") % 3 == 0, c("q")).alias("external_id"))
    return load.authors_found(old, ids.where("author_id % 2 = 0").select(c("q").alias("external_id"), "name"))


@query("DML-12", "influences", sql="SELECT DISTINCT src, dst FROM influences WHERE src = 5 OR dst = 5")
def _(influences):
    return influences.where("src is not null and dst is not null and (src = 5 or dst = 5)").distinct()


@query("DML-13", "books", sql="SELECT 'book' AS entity_type, book_id::VARCHAR AS entity_id, 'publisher' AS field_name, publisher AS new_value, 'library' AS source, 'api' AS method FROM books UNION ALL SELECT 'book', book_id::VARCHAR, 'page_count', page_count::VARCHAR, 'library', 'api' FROM books WHERE page_count IS NOT NULL")
def _(books):
    return enrich.provenance(books, "book_id", "book", ["publisher", "page_count"], "library", "api")


# --- projection, filter ----------------------------------------------------------------------------------------------


@query("FLT-01", "authors", sql="SELECT author_id, name FROM authors WHERE author_id = 7")
def _(authors):
    return authors.where("author_id = 7").select("author_id", "name")


@query("FLT-02", "books", sql="SELECT book_id, title FROM books WHERE title ILIKE '%A%t%'")
def _(books):
    return books.where(c("title").ilike("%A%t%")).select("book_id", "title")


@query("FLT-03", "books", sql="SELECT book_id FROM books WHERE page_count IS NULL")
def _(books):
    return books.where("page_count is null").select("book_id")


@query("FLT-04", "books", sql="SELECT count(*) AS total, count(page_count) AS n_page_count FROM books")
def _(books):
    return books.agg(F.count("*").alias("total"), F.count("page_count").alias("n_page_count"))


@query("FLT-05", "provenance", sql="SELECT id, value FROM provenance WHERE source = 'click' AND entity_id = 3 AND value > 10")
def _(p):
    return p.where((c("source") == "click") & (c("entity_id") == 3) & (c("value") > 10)).select("id", "value")


@query("FLT-06", "provenance", sql="SELECT id FROM provenance WHERE source = 'view'")
def _(p):
    wanted = {"source": "view", "entity_id": ""}
    for name, value in wanted.items():
        p = p.where(c(name) == value) if value else p
    return p.select("id")


@query("FLT-07", "texts", sql="SELECT count(*) AS n FROM texts WHERE length(trim(text)) > 0")
def _(texts):
    return texts.where(F.length(T.pystrip("text")) > 0).agg(F.count("*").alias("n"))


@query("FLT-09", "books", sql="SELECT book_id FROM books WHERE publication_year > 1900 AND publisher = 'Brand#13'")
def _(books):
    return books.sparkSession.sql("SELECT book_id FROM {b} WHERE publication_year > :y AND publisher = :p", args={"y": 1900, "p": "Brand#13"}, b=books)


@query("PRJ-01", "books", sql="SELECT book_id AS id, title, publication_year FROM books")
def _(books):
    return books.select(c("book_id").alias("id"), "title", "publication_year")


@query("PRJ-02", "authors", sql="SELECT author_id, CASE WHEN name IS NULL OR name = '' THEN 'Unknown' ELSE name END AS full_name FROM authors")
def _(authors):
    return authors.select("author_id", T.display_name(F.lit(""), "name").alias("full_name"))


@query("PRJ-04", "notes", sql="SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS n_label, count(*) FILTER (WHERE item_id % 2 = 0) AS n_even, count(*) FILTER (WHERE label = 1 AND item_id % 2 = 0) AS filtered, round(100.0::DOUBLE * (count(*) - count(*) FILTER (WHERE label = 1 AND item_id % 2 = 0)) / count(*), 6) AS reduction FROM notes")
def _(notes):
    return search.selectivity(notes, {"label": c("label") == 1, "even": c("item_id") % 2 == 0})


# --- joins, windows, order, sets -------------------------------------------------------------------------------------


@query("JOI-01", "books", "book_authors", sql="SELECT b.book_id, title FROM books b JOIN book_authors ba ON b.book_id = ba.book_id WHERE author_id = 3")
def _(books, links):
    return books.join(links.where("author_id = 3"), "book_id").select("book_id", "title")


@query("JOI-02", "authors", "influences", sql="SELECT a.author_id, name, 'influencer' AS role FROM authors a JOIN influences ON author_id = src WHERE dst = 5 UNION ALL SELECT a.author_id, name, 'influenced' FROM authors a JOIN influences ON author_id = dst WHERE src = 5")
def _(authors, e):
    one = lambda a, b, role: authors.join(e.where(c(b) == 5), c("author_id") == c(a)).select("author_id", "name", F.lit(role).alias("role"))
    return one("src", "dst", "influencer").unionByName(one("dst", "src", "influenced"))


@query("JOI-03", "book_subjects", sql="SELECT book_id, subject_id, source FROM book_subjects WHERE book_id = 11")
def _(s):
    return s.where("book_id = 11")


_BY_SUBJECT = "SELECT DISTINCT b.book_id, title FROM books b JOIN book_subjects s ON b.book_id = s.book_id WHERE subject_id = 'RF'"


@query("JOI-04", "books", "book_subjects", sql=_BY_SUBJECT)
def _(books, s):
    return books.join(s.where("subject_id = 'RF'"), "book_id", "left_semi").select("book_id", "title")


@query("GRA-04", "books", "book_subjects", sql=_BY_SUBJECT + " ORDER BY title, b.book_id LIMIT 20")
def _(books, s):
    return books.join(s.where("subject_id = 'RF'"), "book_id", "left_semi").orderBy("title", "book_id").limit(20).select("book_id", "title")


@query("JOI-05", "books", "book_subjects", sql="SELECT b.book_id, string_agg(subject_id || '/' || source, ',' ORDER BY subject_id, source) AS subjects FROM books b LEFT JOIN book_subjects s ON b.book_id = s.book_id GROUP BY b.book_id")
def _(books, s):
    both = books.join(s, "book_id", "left").groupBy("book_id").agg(F.sort_array(F.collect_list(F.when(c("subject_id").isNotNull(), F.struct("subject_id", "source")))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: F.concat(x["subject_id"], F.lit("/"), x["source"])), ",")
    return both.select("book_id", F.when(F.size("l") > 0, joined).alias("subjects"))


@query(
    "JOI-06",
    "books",
    "book_authors",
    "authors",
    "book_subjects",
    sql="SELECT b.book_id, title, min(name) AS author, count(DISTINCT subject_id) AS n_subjects FROM books b LEFT JOIN book_authors ba ON b.book_id = ba.book_id LEFT JOIN authors a ON a.author_id = ba.author_id LEFT JOIN book_subjects s ON s.book_id = b.book_id GROUP BY b.book_id, title",
)
def _(books, links, authors, s):
    # each side is reduced to a row a book before it is joined, so that links and subjects do not multiply
    names = links.join(authors, "author_id").groupBy("book_id").agg(F.min("name").alias("author"))
    n = s.groupBy("book_id").agg(F.count_distinct("subject_id").alias("n_subjects"))
    return books.join(names, "book_id", "left").join(n, "book_id", "left").select("book_id", "title", "author", F.coalesce("n_subjects", F.lit(0)).alias("n_subjects"))


QUERIES["AGG-05"], ORACLES["AGG-05"] = QUERIES["JOI-06"], ORACLES["JOI-06"]
QUERIES["ENR-12"], ORACLES["ENR-12"] = QUERIES["JOI-06"], ORACLES["JOI-06"]


@query("JOI-07", "authors", "influences", sql="SELECT a.name AS influencer, b.name AS influenced FROM influences JOIN authors a ON a.author_id = src JOIN authors b ON b.author_id = dst")
def _(authors, e):
    a = authors.select(c("author_id").alias("src"), c("name").alias("influencer"))
    return e.join(a, "src").join(authors.select(c("author_id").alias("dst"), c("name").alias("influenced")), "dst").select("influencer", "influenced")


@query("JOI-08", "lineitem", "books", "authors", sql="SELECT title, name, count(*) AS notes FROM lineitem JOIN books ON book_id = l_partkey JOIN authors ON author_id = l_suppkey WHERE l_quantity > 45 GROUP BY title, name")
def _(lineitem, books, authors):
    rows = lineitem.where("l_quantity > 45").groupBy(c("l_partkey").alias("book_id"), c("l_suppkey").alias("author_id")).agg(F.count("*").alias("n"))
    return rows.join(books, "book_id").join(authors, "author_id").groupBy("title", "name").agg(F.sum("n").alias("notes"))


@query("JOI-10", "nation", "supplier", sql="SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def _(nation, supplier):
    return nation.join(supplier.where("s_acctbal < 0"), c("n_nationkey") == c("s_nationkey"), "left_semi").select("n_name")


@query("JOI-12", "books", "book_authors", "authors", sql="SELECT b.book_id, (SELECT arg_min(name, a.author_id) FROM book_authors ba JOIN authors a ON a.author_id = ba.author_id WHERE ba.book_id = b.book_id) AS author FROM books b")
def _(books, links, authors):
    first = links.join(authors, "author_id").groupBy("book_id").agg(F.min_by("name", "author_id").alias("author"))
    return books.join(first, "book_id", "left").select("book_id", "author")


@query("JOI-13", "supplier", "nation", sql="SELECT s_suppkey AS author_id, coalesce(n_name, 'Q' || s_nationkey) AS country FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20")
def _(supplier, nation):
    labels = nation.where("n_nationkey < 20").select(F.concat(F.lit("Q"), "n_nationkey").alias("qid"), c("n_name").alias("label"))
    rows = supplier.select(c("s_suppkey").alias("author_id"), F.concat(F.lit("Q"), "s_nationkey").alias("country"))
    return enrich.resolve(rows, "country", labels)


QUERIES["SRC-13"], ORACLES["SRC-13"] = QUERIES["JOI-13"], ORACLES["JOI-13"]


_PAIRS = "SELECT a.subject_id AS s1, b.subject_id AS s2, count(*) AS n FROM book_subjects a JOIN book_subjects b ON a.book_id = b.book_id AND a.subject_id < b.subject_id GROUP BY 1, 2"


@query("JOI-14", "book_subjects", sql=_PAIRS)
def _(s):
    # pairs are made inside each book's short list, not by a self-join
    lists = s.groupBy("book_id").agg(F.sort_array(F.collect_set("subject_id")).alias("l"))
    first = lists.select(F.posexplode("l").alias("i", "s1"), "l")
    return first.select("s1", F.explode(F.slice("l", c("i") + 2, F.size("l"))).alias("s2")).groupBy("s1", "s2").agg(F.count("*").alias("n"))


QUERIES["ANA-08"], ORACLES["ANA-08"] = QUERIES["JOI-14"], ORACLES["JOI-14"]


@query("WIN-01", "log", sql=_REPLAY + "SELECT item_id, row_number() OVER (ORDER BY min((ts, pos))) - 1 AS position FROM alive GROUP BY item_id")
def _(log):
    state = cdc.replay(log, "item_id", ["ts", "pos"], "operation", ["value"])
    # numbers by ranges of the order: counts of coarse buckets give each bucket its start, no single task sorts all
    b = state.withColumn("bucket", F.to_date("place.ts"))
    starts = b.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("place")) - 1
    return b.withColumn("nth", nth).join(starts, "bucket").select("item_id", (c("start") + c("nth")).alias("position"))


@query("WIN-02", "books", sql="SELECT book_id, (SELECT max(book_id) FROM books WHERE book_id % 2 = 0) + row_number() OVER (ORDER BY book_id) AS next FROM books WHERE book_id % 2 = 1")
def _(books):
    top = books.where("book_id % 2 = 0").agg(F.max("book_id").alias("top"))
    # all new books, by ranges of the order as in WIN-01
    new = books.where("book_id % 2 = 1").withColumn("bucket", F.floor(c("book_id") / 1000))
    starts = new.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("book_id"))
    return new.withColumn("nth", nth).join(starts, "bucket").join(F.broadcast(top), how="cross").select("book_id", (c("top") + c("start") + c("nth")).alias("next"))


QUERIES["WIN-02-ALL"], ORACLES["WIN-02-ALL"] = QUERIES["WIN-02"], ORACLES["WIN-02"]


@query("WIN-03", "log", sql="WITH w AS (SELECT item_id, pos, operation, lag(operation) OVER (PARTITION BY item_id ORDER BY ts, pos) AS prev, max(CASE WHEN operation = 'add' THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY ts, pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM log ) SELECT item_id, pos FROM w WHERE operation <> 'add' AND prev = 'add' AND later = 1")
def _(log):
    own = Window.partitionBy("item_id").orderBy("ts", "pos")
    hit = c("operation") == "add"
    rows = log.withColumns({"prev": F.lag("operation").over(own), "later": F.max(hit).over(own.rowsBetween(1, Window.unboundedFollowing))})
    return rows.where(~hit & (c("prev") == "add") & c("later")).select("item_id", "pos")


@query("WIN-05", "log", sql="SELECT item_id, pos, sum(CASE WHEN operation = 'add' THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY ts, pos)::BIGINT AS island FROM log")
def _(log):
    own = Window.partitionBy("item_id").orderBy("ts", "pos")
    return log.select("item_id", "pos", F.sum((c("operation") == "add").cast("long")).over(own).alias("island"))


@query("SRT-01", "authors", sql="SELECT author_id, name FROM authors ORDER BY name, author_id LIMIT 10")
def _(authors):
    return authors.orderBy("name", "author_id").limit(10).select("author_id", "name")


@query("GRA-02", "authors", sql="SELECT author_id, name FROM authors WHERE name ILIKE '%00001%' ORDER BY name, author_id LIMIT 10")
def _(authors):
    return authors.where(c("name").ilike("%00001%")).orderBy("name", "author_id").limit(10).select("author_id", "name")


@query("SRT-02", "provenance", sql="SELECT id, source FROM provenance ORDER BY enriched_at DESC, id DESC LIMIT 100")
def _(p):
    return p.orderBy(F.desc("enriched_at"), F.desc("id")).limit(100).select("id", "source")


@query("SRT-03", "books", sql="SELECT book_id FROM books WHERE page_count IS NULL ORDER BY book_id LIMIT 25")
def _(books):
    return books.where("page_count is null").orderBy("book_id").limit(25).select("book_id")


@query("SRT-04", "books", "reading", sql="SELECT book_id, date_read FROM (SELECT b.book_id, max(date_read) AS date_read FROM books b LEFT JOIN reading r ON r.book_id = b.book_id AND status = 'F' GROUP BY b.book_id) ORDER BY date_read NULLS LAST, book_id LIMIT 50")
def _(books, reading):
    read = reading.where("status = 'F'").groupBy("book_id").agg(F.max("date_read").alias("date_read"))
    return books.join(read, "book_id", "left").orderBy(c("date_read").asc_nulls_last(), "book_id").limit(50).select("book_id", "date_read")


@query("SRT-07", "books", sql="SELECT kind, count(*) AS n FROM books GROUP BY kind ORDER BY count(*) DESC, min(book_id) LIMIT 10")
def _(books):
    return books.groupBy("kind").agg(F.count("*").alias("n"), F.min("book_id").alias("seen")).orderBy(F.desc("n"), "seen").limit(10).select("kind", "n")


@query("SET-01", "notes", sql="SELECT item_id FROM notes WHERE label = 1 INTERSECT SELECT item_id FROM notes WHERE item_id % 3 = 0")
def _(notes):
    return notes.where((c("label") == 1) & (c("item_id") % 3 == 0)).select("item_id")


@query("SET-02", "books", sql="SELECT book_id, array_to_string(list_sort(list_distinct(list_filter([publisher, kind, publisher, ''], lambda x: x <> ''))), '|') AS tags FROM books")
def _(books):
    tags = F.array_sort(F.array_distinct(F.filter(F.array("publisher", "kind", "publisher", F.lit("")), lambda x: x != "")))
    return books.select("book_id", F.array_join(tags, "|").alias("tags"))


@query("SET-03", "influences", sql="SELECT src AS a, dst AS b FROM influences UNION ALL SELECT dst, src FROM influences")
def _(e):
    return e.select(c("src").alias("a"), c("dst").alias("b")).unionByName(e.select(c("dst").alias("a"), c("src").alias("b")))


@query("SET-04", "books", sql="SELECT book_id FROM books WHERE publisher = 'Brand#11' OR kind = 'x'")
def _(books):
    return books.where((c("publisher") == "Brand#11") | (c("kind") == "x")).select("book_id")


@query("SET-05", "book_subjects", sql="SELECT DISTINCT subject_id, source FROM book_subjects")
def _(s):
    return s.select("subject_id", "source").distinct()


# --- aggregates and analytics ----------------------------------------------------------------------------------------


@query("AGG-01", "log", sql="SELECT count(*) AS n FROM log")
def _(log):
    return log.agg(F.count("*").alias("n"))


@query("AGG-02", "log", sql="SELECT max(pos) AS top, coalesce(max(pos) FILTER (WHERE pos < 0), 0) AS of_none FROM log")
def _(log):
    return log.agg(F.max("pos").alias("top"), F.coalesce(F.max(F.when(c("pos") < 0, c("pos"))), F.lit(0)).alias("of_none"))


@query("AGG-03", "book_subjects", sql="SELECT count(DISTINCT book_id) AS books, count(DISTINCT subject_id) AS subjects FROM book_subjects")
def _(s):
    return s.agg(F.count_distinct("book_id").alias("books"), F.count_distinct("subject_id").alias("subjects"))


@query("AGG-04", "provenance", sql="SELECT 'source' AS kind, source AS key, count(*) AS n FROM provenance GROUP BY source UNION ALL SELECT 'entity', (entity_id % 7)::VARCHAR, count(*) FROM provenance GROUP BY entity_id % 7")
def _(p):
    # one pass: rows are counted by both keys at once, and the few counts are summed for each
    n = p.groupBy("source", (c("entity_id") % 7).cast("string").alias("entity")).agg(F.count("*").alias("n"))
    keys = F.array(F.struct(F.lit("source").alias("kind"), c("source").alias("key")), F.struct(F.lit("entity").alias("kind"), c("entity").alias("key")))
    return n.select(F.explode(keys).alias("p"), "n").groupBy("p.kind", "p.key").agg(F.sum("n").alias("n"))


@query("AGG-06", "books", sql="SELECT count(*) AS total, count(page_count) AS n_page_count, CASE WHEN count(*) > 0 THEN round_even(count(page_count) * 100.0::DOUBLE / count(*), 1) ELSE 0 END AS pct_page_count FROM books")
def _(books):
    return enrich.coverage(books, ["page_count"])


QUERIES["SCL-28"], ORACLES["SCL-28"] = QUERIES["AGG-06"], ORACLES["AGG-06"]


@query("ENR-03", "documents", "labels", sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(documents, labels):
    return documents.select("doc_id").join(labels, "doc_id", "left_anti")


@query("AGG-07", "book_subjects", sql="SELECT source, string_agg(DISTINCT subject_id, ';' ORDER BY subject_id) AS subjects FROM book_subjects GROUP BY source")
def _(s):
    return s.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("subject_id")), ";").alias("subjects"))


@query("AGG-08", "books", sql="WITH k AS (SELECT lower(title) AS key, CASE WHEN book_id % 3 = 0 THEN upper(title) ELSE title END AS v, count(*) AS n, min(book_id) AS seen FROM books GROUP BY 1, 2) SELECT key, arg_max(v, (n, -seen)) AS value, sum(n)::BIGINT AS frequency, sum(n)::DOUBLE / sum(sum(n)) OVER () AS share, array_to_string(list(v ORDER BY seen)[1:5], '|') AS examples FROM k GROUP BY key")
def _(books):
    v = F.when(c("book_id") % 3 == 0, F.upper("title")).otherwise(c("title"))
    k = books.groupBy(F.lower("title").alias("key"), v.alias("v")).agg(F.count("*").alias("n"), F.min("book_id").alias("seen"))
    # spellings of one name
    shown = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("seen", "v"))), 1, 5), lambda x: x["v"])
    out = k.groupBy("key").agg(F.max_by("v", F.struct("n", -c("seen"))).alias("value"), F.sum("n").alias("frequency"), F.array_join(shown, "|").alias("examples"))
    total = out.agg(F.sum("frequency").alias("all"))  # one row
    return out.join(F.broadcast(total), how="cross").withColumn("share", c("frequency") / c("all")).drop("all")


@query("AGG-09", "log", sql="SELECT count(*) FILTER (WHERE operation = 'add') AS adds, count(*) FILTER (WHERE operation = 'update') AS updates, count(*) FILTER (WHERE operation = 'delete') AS deletes FROM log")
def _(log):
    return log.agg(*[F.count_if(c("operation") == o).alias(f"{o}s") for o in ("add", "update", "delete")])


@query("AGG-11", "notes", sql="SELECT count(*) AS total, count(DISTINCT label) AS labels FROM notes")
def _(notes):
    return notes.agg(F.count("*").alias("total"), F.count_distinct("label").alias("labels"))


@query("AGG-12", "texts", sql="SELECT lang, count(*) AS n FROM texts GROUP BY lang")
def _(texts):
    return texts.groupBy("lang").agg(F.count("*").alias("n"))


@query("AGG-13", "lineitem", "books", sql="SELECT book_id, title, count(*) AS excerpts FROM lineitem JOIN books ON book_id = l_partkey GROUP BY book_id, title ORDER BY count(*) DESC, book_id LIMIT 10")
def _(lineitem, books):
    n = lineitem.groupBy(c("l_partkey").alias("book_id")).agg(F.count("*").alias("excerpts"))
    return n.join(books, "book_id").orderBy(F.desc("excerpts"), "book_id").limit(10).select("book_id", "title", "excerpts")


@query("AGG-14", "provenance", sql="SELECT string_agg(source || '=' || n, ',' ORDER BY source) AS stats FROM (SELECT source, count(*) AS n FROM provenance GROUP BY source)")
def _(p):
    n = p.groupBy("source").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("m"))
    return n.select(F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("stats"))


@query("ANA-01", "influences", "author_ids", sql="SELECT (SELECT count(external_id) FROM author_ids ) AS identified, count(*) AS edges, count(DISTINCT src) AS influencers, count(DISTINCT dst) AS influenced FROM influences")
def _(e, ids):
    edges = e.agg(F.count("*").alias("edges"), F.count_distinct("src").alias("influencers"), F.count_distinct("dst").alias("influenced"))
    return ids.agg(F.count("external_id").alias("identified")).join(edges, how="cross")  # one row each


@query("ANA-02", "influences", sql="SELECT dst AS author_id, count(*) AS n FROM influences GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 10")
def _(e):
    return e.groupBy(c("dst").alias("author_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author_id").limit(10)


@query("ANA-03", "influences", sql="SELECT src, dst FROM influences WHERE src IN (3, 4) OR dst IN (3, 4)")
def _(e):
    return e.where(c("src").isin(3, 4) | c("dst").isin(3, 4))


@query("ANA-04", "authors", sql="SELECT author_id, name, birth_year FROM authors WHERE death_year IS NOT NULL ORDER BY name, author_id LIMIT 50")
def _(authors):
    return authors.where("death_year is not null").orderBy("name", "author_id").limit(50).select("author_id", "name", "birth_year")


@query("ANA-05", "book_subjects", sql="SELECT count(*) AS links, count(DISTINCT subject_id) AS subjects, count(DISTINCT book_id) AS books FROM book_subjects")
def _(s):
    return s.agg(F.count("*").alias("links"), F.count_distinct("subject_id").alias("subjects"), F.count_distinct("book_id").alias("books"))


@query("ANA-06", "book_subjects", sql="SELECT source, subject_id, count(*) AS n FROM book_subjects GROUP BY source, subject_id ORDER BY count(*) DESC, subject_id LIMIT 20")
def _(s):
    return s.groupBy("source", "subject_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject_id").limit(20)


@query("ANA-07", "movements", "author_movements", "book_authors", sql="SELECT m.name, count(DISTINCT book_id) AS books FROM movements m LEFT JOIN author_movements am ON am.movement_id = m.movement_id LEFT JOIN book_authors ba ON ba.author_id = am.author_id GROUP BY m.name")
def _(m, am, ba):
    pairs = am.join(ba, "author_id").select("movement_id", "book_id").distinct().groupBy("movement_id").agg(F.count("*").alias("books"))
    return m.join(pairs, "movement_id", "left").select("name", F.coalesce("books", F.lit(0)).alias("books"))


@query("ANA-09", "authors", "author_movements", "movements", sql="SELECT a.name, m.name AS movement FROM authors a JOIN author_movements am ON am.author_id = a.author_id JOIN movements m ON m.movement_id = am.movement_id WHERE m.name = 'ASIA'")
def _(authors, am, m):
    one = m.where("name = 'ASIA'").select("movement_id", c("name").alias("movement"))
    return authors.join(am.join(one, "movement_id"), "author_id").select("name", "movement")


@query("ANA-09-SUBJECT", "books", "book_subjects", sql="SELECT b.book_id, b.title, s.source FROM books b JOIN book_subjects s ON s.book_id = b.book_id WHERE s.subject_id = 'NF'")
def _(books, subjects):
    return books.join(subjects.where("subject_id = 'NF'").select("book_id", "source"), "book_id").select("book_id", "title", "source")


@query("ANA-09-BOOKS", "books", "book_authors", "author_movements", "movements", sql="SELECT DISTINCT b.book_id, b.title, m.name AS movement FROM books b JOIN book_authors ba ON ba.book_id = b.book_id JOIN author_movements am ON am.author_id = ba.author_id JOIN movements m ON m.movement_id = am.movement_id WHERE m.name = 'ASIA'")
def _(books, links, am, m):
    one = am.join(m.where("name = 'ASIA'").select("movement_id", c("name").alias("movement")), "movement_id").select("author_id", "movement")
    chosen = links.join(one, "author_id").select("book_id", "movement").distinct()  # before the titles are joined: keys alone are exchanged
    return books.select("book_id", "title").join(chosen, "book_id")


@query("ANA-10", "books", "authors", "reading", sql="SELECT (SELECT count(*) FROM books ) AS books, (SELECT count(*) FROM authors ) AS authors, (SELECT count(DISTINCT book_id) FROM reading WHERE date_read IS NOT NULL) AS dated, (SELECT count(DISTINCT book_id) FROM reading WHERE award <> '4-NOT SPECIFIED') AS awarded")
def _(books, authors, reading):
    n = lambda df, k: df.agg(F.count("*").alias(k))
    has = lambda f, k: F.count_distinct(F.when(F.expr(f), c("book_id"))).alias(k)
    read = reading.agg(has("date_read is not null", "dated"), has("award <> '4-NOT SPECIFIED'", "awarded"))
    return n(books, "books").join(n(authors, "authors"), how="cross").join(read, how="cross")  # one row each


@query("ANA-11", "reading", sql="SELECT year(date_read) AS y, quarter(date_read) AS q, month(date_read) AS m, count(*) AS n FROM reading GROUP BY 1, 2, 3")
def _(reading):
    return reading.groupBy(F.year("date_read").alias("y"), F.quarter("date_read").alias("q"), F.month("date_read").alias("m")).agg(F.count("*").alias("n"))


@query("ANA-11-SPEED", "reading", sql="""WITH s AS (SELECT count(date_read) AS n, min(date_read) AS first, max(date_read) AS last FROM reading )
SELECT first, last, last - first AS span_days, n / (year(last) - year(first) + 1) AS a_year, n / (12 * (year(last) - year(first)) + month(last) - month(first) + 1) AS a_month FROM s""")
def _(reading):
    """Reading velocity over the calendar years and months that the dates span; nulls where nothing is dated."""
    s = reading.agg(F.count("date_read").alias("n"), F.min("date_read").alias("first"), F.max("date_read").alias("last"))
    years = F.year("last") - F.year("first")
    months = 12 * years + F.month("last") - F.month("first") + 1
    return s.select("first", "last", F.datediff("last", "first").cast("long").alias("span_days"), (c("n") / (years + 1)).alias("a_year"), (c("n") / months).alias("a_month"))


@query("ANA-12", "authors", sql="SELECT nation, count(*) AS n, avg(death_year - birth_year) AS mean_age, min(death_year - birth_year) AS low, max(death_year - birth_year) AS high FROM authors GROUP BY nation")
def _(authors):
    age = c("death_year") - c("birth_year")
    return authors.groupBy("nation").agg(F.count("*").alias("n"), F.avg(age).alias("mean_age"), F.min(age).alias("low"), F.max(age).alias("high"))


@query("ANA-13", "books", sql="SELECT CASE WHEN publication_year < 1800 THEN 'Pre-1800' WHEN publication_year < 1900 THEN '19th' WHEN publication_year < 2000 THEN '20th' ELSE '21st' END AS century, publication_year // 10 * 10 AS decade, count(*) AS n FROM books GROUP BY 1, 2")
def _(books):
    y = c("publication_year")
    century = F.when(y < 1800, "Pre-1800").when(y < 1900, "19th").when(y < 2000, "20th").otherwise("21st")
    return books.groupBy(century.alias("century"), (F.floor(y / 10) * 10).alias("decade")).agg(F.count("*").alias("n"))


@query("ANA-14", "books", "reading", sql="WITH a AS (SELECT year(date_read) - publication_year AS age FROM reading r JOIN books b ON b.book_id = r.book_id) SELECT CASE WHEN age <= 5 THEN '0-5' WHEN age <= 10 THEN '6-10' WHEN age <= 25 THEN '11-25' WHEN age <= 50 THEN '26-50' WHEN age <= 100 THEN '51-100' ELSE '101+' END AS span, count(*) AS n, avg(age) AS mean_age FROM a GROUP BY 1")
def _(books, reading):
    a = reading.join(books, "book_id").withColumn("age", F.year("date_read") - c("publication_year"))
    span = None
    for top, name in ((5, "0-5"), (10, "6-10"), (25, "11-25"), (50, "26-50"), (100, "51-100")):
        span = F.when(c("age") <= top, name) if span is None else span.when(c("age") <= top, name)
    return a.groupBy(span.otherwise("101+").alias("span")).agg(F.count("*").alias("n"), F.avg("age").alias("mean_age"))


@query("ANA-15", "book_authors", sql="SELECT author_id, count(*) AS books, avg(count(*)) OVER () AS mean_books FROM book_authors GROUP BY author_id")
def _(links):
    n = links.groupBy("author_id").agg(F.count("*").alias("books"))
    return n.join(F.broadcast(n.agg(F.avg("books").alias("mean_books"))), how="cross")  # one row


@query("ANA-16", "reading", sql="SELECT award, count(*) AS n, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM reading GROUP BY award")
def _(reading):
    return reading.groupBy("award").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"))


@query("ANA-17", "reading", sql="WITH d AS (SELECT DISTINCT status, date_read FROM reading ), g AS (SELECT status, date_read - lag(date_read) OVER (PARTITION BY status ORDER BY date_read) AS gap FROM d) SELECT status, max(gap) AS longest FROM g GROUP BY status")
def _(reading):
    d = reading.select("status", "date_read").distinct()
    gap = F.datediff("date_read", F.lag("date_read").over(Window.partitionBy("status").orderBy("date_read")))
    return d.withColumn("gap", gap).groupBy("status").agg(F.max("gap").cast("long").alias("longest"))


@query("ANA-18", "books", sql="SELECT book_id, title FROM books ORDER BY book_id LIMIT 20 OFFSET 40")
def _(books):
    return books.orderBy("book_id").offset(40).limit(20).select("book_id", "title")


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("SCL-01", "books", sql="SELECT book_id, 'sha256:' || sha256(title || '|' || coalesce(publisher, '') || '|' || kind) AS item_id FROM books")
def _(books):
    return books.select("book_id", T.item_id("title", "publisher", "kind").alias("item_id"))


@query("SCL-02", "books", sql="SELECT book_id, book_id % 2 = 0 AS ok FROM books")
def _(books):
    made = F.when(c("book_id") % 2 == 0, T.item_id("title")).otherwise(F.concat(T.item_id("title"), F.lit("x")))
    return books.select("book_id", T.is_item_id(made).alias("ok"))


@query("SCL-03", "books", sql="SELECT book_id, substr(regexp_replace(trim(regexp_replace(lower(title || '_' || publisher), '[^\\p{L}\\p{N} \\-_]', '', 'g')), ' +', '-', 'g'), 1, 100) AS id FROM books")
def _(books):
    return books.select("book_id", T.book_id("title", "publisher").alias("id"))


@query("SCL-04", "authors", sql="SELECT author_id, CASE WHEN author_id % 3 = 0 THEN name WHEN author_id % 3 = 1 THEN 'A ' || name ELSE 'A' END AS name FROM authors")
def _(authors):
    first = F.when(c("author_id") % 3 > 0, "A")
    last = F.when(c("author_id") % 3 < 2, c("name"))
    return authors.select("author_id", T.display_name(first, last).alias("name"))


@query("SCL-05", "books", sql="SELECT book_id, split_part(title, ' ', -1) AS last, CASE WHEN strpos(title, ' ') > 0 THEN regexp_replace(title, ' [^ ]*$', '') END AS first FROM books")
def _(books):
    return books.select("book_id", T.last_token("title").alias("last"), T.first_tokens("title").alias("first"))


@query("SCL-06", "books", sql="SELECT book_id, publication_year::INT AS year FROM books")
def _(books):
    return books.select("book_id", T.year_in(F.concat(F.lit("printed in "), c("publication_year").cast("string"), F.lit("."))).alias("year"))


@query("SCL-07", "books", sql="SELECT book_id, CASE WHEN book_id % 5 > 0 THEN publication_year::INT END AS year FROM books")
def _(books):
    sign = F.when(c("book_id") % 5 == 0, "-0").otherwise("+")
    return books.select("book_id", T.claim_year(F.concat(sign, c("publication_year").cast("string"), F.lit("-01-01T00:00:00Z"))).alias("year"))


@query("SCL-08", "books", sql="SELECT book_id, CASE WHEN book_id % 2 = 0 THEN '9780000000001' WHEN book_id % 3 = 0 THEN '9780000000002' END AS isbn FROM books")
def _(books):
    edition = F.when(c("book_id") % 2 == 0, F.array(F.lit("9780000000001")))
    found = F.when(c("book_id") % 3 == 0, F.array(F.lit("0000000001"), F.lit("9780000000002")))
    return books.select("book_id", T.pick_isbn(edition, found, 13).alias("isbn"))


@query("SCL-09", "books", sql="SELECT book_id, coalesce(nullif(CASE WHEN book_id % 2 = 0 THEN '' ELSE kind END, ''), publisher) AS isbn FROM books")
def _(books):
    return books.select("book_id", F.coalesce(F.nullif(F.when(c("book_id") % 2 == 0, "").otherwise(c("kind")), F.lit("")), c("publisher")).alias("isbn"))


@query("SCL-16", "books", sql="SELECT book_id, 'OL' || book_id || 'W' AS work FROM books")
def _(books):
    return books.select("book_id", T.work_id(F.concat(F.lit("/works/OL"), "book_id", F.lit("W"))).alias("work"))


@query("SCL-17", "books", sql="SELECT book_id, CASE book_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'cs' END AS code FROM books")
def _(books):
    q = F.when(c("book_id") % 3 == 0, "Q1860").when(c("book_id") % 3 == 1, "Q9056").otherwise("Q1")
    return books.select("book_id", T.language_code(q).alias("code"))


@query("SCL-18", "books", sql="SELECT book_id, 'https://en.wikipedia.org/wiki/' || replace(title, ' ', '_') AS url FROM books")
def _(books):
    return books.select("book_id", T.wiki_url("title").alias("url"))


@query("SCL-20", "books", sql="SELECT book_id, title || ': a' || '|' || title AS variants FROM books")
def _(books):
    return books.select("book_id", F.array_join(T.title_variants(F.concat("title", F.lit(": a"))), "|").alias("variants"))


@query("SCL-21", "pages", sql="SELECT page_id, split_part(url, '/', -1) AS last FROM pages")
def _(pages):
    return pages.select("page_id", T.after_slash("url").alias("last"))


@query("SCL-22", "provenance", sql="SELECT id, entity_id::VARCHAR AS v FROM provenance")
def _(p):
    return p.select("id", T.serialised(c("entity_id"), "bigint").alias("v"))


@query("SCL-23", "provenance", sql="SELECT id, (props::JSON ->> 'k')::INT AS k FROM provenance")
def _(p):
    return p.select("id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SCL-27", "books", sql="SELECT book_id FROM books WHERE contains(lower(title), 'red')")
def _(books):
    return books.where(F.lower("title").contains("red")).select("book_id")


# --- vectors ---------------------------------------------------------------------------------------------------------

_COS = "WITH q AS (SELECT embedding AS q FROM notes WHERE item_id = 0), s AS (SELECT item_id, label, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS c FROM notes, q) "


def _nearest(notes, k, where=None):
    one = notes.where("item_id = 0").select(c("embedding").alias("q"))
    rows = notes if where is None else notes.where(where)
    cos = rows.join(F.broadcast(one), how="cross").withColumn("c", V.cosine("embedding", "q"))  # one row
    return cos.orderBy(F.desc("c"), "item_id").limit(k).select("item_id", F.round("c", 6).alias("cosine"), F.round(V.similarity(c("c")), 6).alias("similarity"))


@query("VEC-03", "notes", sql=_COS + "SELECT item_id, round(c, 6) AS cosine, round(1 - 2 * (1 - c) * (1 - c), 6) AS similarity FROM s ORDER BY c DESC, item_id LIMIT 10")
def _(notes):
    return _nearest(notes, 10)


@query("VEC-04", "notes", sql=_COS + "SELECT item_id, round(c, 6) AS cosine, round(1 - 2 * (1 - c) * (1 - c), 6) AS similarity FROM s WHERE label = 3 ORDER BY c DESC, item_id LIMIT 5")
def _(notes):
    return _nearest(notes, 5, c("label") == 3)


def _store(notes):
    """The notes as rows of a vector store, every seventh deleted."""
    names = {"item_id": c("item_id").cast("string"), "text": F.concat(F.lit("note "), "item_id"), "book_title": F.concat(F.lit("B"), c("item_id") % 4), "author": F.concat(F.lit("A"), "label"), "section": F.concat(F.lit("S"), c("item_id") % 3), "source_file": F.lit("f.md"), "date_read": F.lit(None).cast("string")}
    scaled = F.transform("embedding", lambda x: x * (c("item_id") % 5 + 2))
    return notes.select(F.struct(F.lit("f").alias("name"), "item_id").alias("place"), *[e.alias(n) for n, e in names.items()], V.unit(scaled).alias("vector"), (c("item_id") % 7 == 0).alias("deleted"), c("embedding").alias("raw"))


_SIMILAR = _COS.replace("SELECT item_id, label", "SELECT item_id, 'note ' || item_id AS text, 'B' || item_id % 4 AS book_title, 'A' || label AS author, 'S' || item_id % 3 AS section")


def _asked(rows):
    return [float(x) for x in rows.where("item_id = '0'").first()["raw"]]


@query("VEC-09", "notes", sql=_SIMILAR + "SELECT text, round(1 - 2 * (1 - c) * (1 - c), 4) AS similarity, book_title, author, section FROM s WHERE author = 'A3' AND section = 'S1' AND item_id % 7 <> 0 ORDER BY c DESC, item_id LIMIT 5")
def _(notes):
    rows = _store(notes)
    return vector_store.find(rows, _asked(rows), 5, author="A3", section="S1").select("text", F.round("similarity", 4).alias("similarity"), "book_title", "author", "section")


@query("PRJ-03", "notes", sql=_SIMILAR + "SELECT text, round(1 - 2 * (1 - c) * (1 - c), 4) AS similarity, book_title, author, section, 'f.md' AS source_file, NULL::VARCHAR AS date_read FROM s WHERE item_id % 7 <> 0 ORDER BY c DESC, item_id LIMIT 20")
def _(notes):
    rows = _store(notes)
    return vector_store.find(rows, _asked(rows), 20).withColumn("similarity", F.round("similarity", 4))


@query("FLT-08", "notes", sql="SELECT item_id::VARCHAR AS item_id FROM notes WHERE label = 2 AND item_id % 3 = 1 AND item_id % 4 = 2")
def _(notes):
    return vector_store.wanted(_store(notes), "A2", "S1", "B2").select("item_id")


@query("SRT-06", "notes", sql=_COS + "SELECT item_id, round(c, 6) AS cosine FROM s ORDER BY c DESC, item_id LIMIT 25")
def _(notes):
    asked = [float(x) for x in notes.where("item_id = 0").first()["embedding"]]
    return search.nearest(notes, asked, 25).select("item_id", F.round("cosine", 6).alias("cosine"))


@query("VEC-05", "notes", sql=_COS + "SELECT item_id, round(1 - 2 * (1 - c) * (1 - c), 6) AS similarity FROM s")
def _(notes):
    one = notes.where("item_id = 0").select(c("embedding").alias("q"))
    return notes.join(F.broadcast(one), how="cross").select("item_id", F.round(V.similarity(V.cosine("embedding", "q")), 6).alias("similarity"))  # one row


@query("VEC-02", "notes", sql="SELECT item_id::VARCHAR AS item_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS first, round(embedding[64]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS last FROM notes")
def _(notes):
    return _store(notes).select("item_id", F.round(c("vector")[0].cast("double"), 4).alias("first"), F.round(c("vector")[63].cast("double"), 4).alias("last"))


@query("SCL-26", "notes", sql="SELECT item_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * (item_id % 5 + 2), 4) AS norm FROM notes")
def _(notes):
    return notes.select("item_id", F.round(V.norm(F.transform("embedding", lambda x: x * (c("item_id") % 5 + 2))), 4).alias("norm"))


@query("VEC-11", "notes", sql="SELECT count(*) AS total_notes, count(*) FILTER (WHERE item_id % 7 <> 0) AS active_notes, count(DISTINCT label) AS unique_authors, count(DISTINCT item_id % 4) AS unique_books, count(DISTINCT item_id % 3) AS unique_sections FROM notes")
def _(notes):
    return vector_store.stats(_store(notes))


@query("VEC-06", "notes", sql=_COS + "SELECT item_id, round(c, 6) AS cosine FROM s WHERE item_id % 7 <> 0 ORDER BY c DESC, item_id LIMIT 10")
def _(notes):
    live = search.without_deleted(notes, notes.where("item_id % 7 = 0").select("item_id"))
    one = notes.where("item_id = 0").select(c("embedding").alias("q"))
    return live.join(F.broadcast(one), how="cross").withColumn("c", V.cosine("embedding", "q")).orderBy(F.desc("c"), "item_id").limit(10).select("item_id", F.round("c", 6).alias("cosine"))  # one row


@query(
    "VEC-10",
    "notes",
    sql="SELECT query_id, item_id, round(c, 6) AS cosine, rank FROM (SELECT q.item_id AS query_id, n.item_id, c, row_number() OVER (PARTITION BY q.item_id ORDER BY c DESC, n.item_id)::INT AS rank FROM notes q JOIN notes n ON q.label = n.label, LATERAL (SELECT list_cosine_similarity(n.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c) WHERE q.item_id % 50 = 0) WHERE rank <= 3",
)
def _(notes):
    asked = notes.where("item_id % 50 = 0").select(c("item_id").alias("query_id"), "label", c("embedding").alias("query_vector"))
    return search.nearest_many(notes, asked, 3, "label").select("query_id", "item_id", F.round("cosine", 6).alias("cosine"), "rank")


# --- markdown and validation -----------------------------------------------------------------------------------------


def _lines(texts: DataFrame) -> DataFrame:
    """Texts as notes: the first line is a title, every ninth a section, some faulty headers, others items or continuations by length."""
    rows = markdown.lines(texts.select(c("doc_id").cast("string").alias("path"), c("text").alias("content")))
    marked = (
        F.when(c("line_no") == 1, F.concat(F.lit("# "), "line"))
        .when(c("line_no") % 9 == 2, F.concat(F.lit("## Notes"), (c("line_no") % 4).cast("string")))
        .when(c("line_no") % 31 == 5, F.concat(F.lit("### "), "line"))
        .when(c("line_no") % 31 == 6, F.concat(F.lit("#"), "line"))
        .when(c("line_no") % 31 == 7, "# Notes")
        .when(c("line_no") % 31 == 8, "## Ideas")
        .when(F.length("line") % 5 == 0, F.concat(F.lit("    "), "line"))
        .when(F.length("line") % 7 == 0, F.concat(F.lit("  - "), "line"))
        .when(F.length("line") % 11 == 0, F.concat(F.lit("* "), "line"))
        .otherwise(F.concat(F.lit("- "), "line", F.when(F.length("line") % 3 == 0, F.lit(" (p.12)")).when(F.length("line") % 3 == 1, F.lit(" (p. 7)")).otherwise(F.lit(""))))
    )
    return rows.withColumn("line", marked)


_LINES = r"""WITH split AS (SELECT doc_id::VARCHAR AS file, string_split(text, chr(10)) AS l FROM texts ), raw AS (SELECT file, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM split),
lines AS (SELECT file, line_no, CASE WHEN line_no = 1 THEN '# ' || line WHEN line_no % 9 = 2 THEN '## Notes' || line_no % 4 WHEN line_no % 31 = 5 THEN '### ' || line WHEN line_no % 31 = 6 THEN '#' || line
WHEN line_no % 31 = 7 THEN '# Notes' WHEN line_no % 31 = 8 THEN '## Ideas' WHEN length(line) % 5 = 0 THEN '    ' || line WHEN length(line) % 7 = 0 THEN '  - ' || line
WHEN length(line) % 11 = 0 THEN '* ' || line ELSE '- ' || line || CASE length(line) % 3 WHEN 0 THEN ' (p.12)' WHEN 1 THEN ' (p. 7)' ELSE '' END END AS line FROM raw)
"""


def _rows(texts):
    return _lines(texts).select(c("path").alias("file"), c("line_no").cast("long").alias("line_no"), "line")


_SECTIONS = "('excerpts', 'ideas', 'images', 'notes', 'representations', 'same time', 'terms', 'threads', 'themes')"


def _rule(name, rule, sql, *columns):
    """A rule's issues: file, line_no, and the other columns named."""

    @query(name, "texts", sql=_LINES + sql)
    def _(texts):
        return quality_rules.of_rule(_rows(texts), rule).select("file", "line_no", *columns)


_rule("VAL-H1", "HEADER_001", "SELECT file, line_no, trim(line) AS context, 'Use ## for sections within books' AS suggestion FROM lines WHERE line LIKE '###%'", "context", "suggestion")
_rule("VAL-H2", "HEADER_002", r"SELECT file, line_no, trim(regexp_replace(line, '^(#{1,2})', '\1 ')) AS suggestion FROM lines WHERE regexp_matches(line, '^#{1,2}[^\s#]')", "suggestion")
_rule("VAL-H3", "HEADER_003", f"SELECT file, line_no, trim(line) AS context, NULL::VARCHAR AS suggestion FROM lines WHERE line LIKE '# %' AND lower(trim(substr(line, 3))) IN {_SECTIONS}", "context", "suggestion")
_rule("VAL-S1", "SECTION_001", f"SELECT file, line_no, '## ' || lower(trim(substr(line, 4))) AS suggestion FROM lines WHERE line LIKE '## %' AND lower(trim(substr(line, 4))) IN {_SECTIONS} AND trim(substr(line, 4)) <> lower(trim(substr(line, 4)))", "suggestion")
_rule("VAL-S2", "SECTION_002", "SELECT file, line_no, '## notes' AS suggestion FROM lines WHERE line LIKE '## Notes%'", "suggestion")
_rule("VAL-C1", "CITATION_001", r"SELECT file, line_no, trim(regexp_replace(line, '\(p\.\d+\)', '(p. ' || regexp_extract(line, '\(p\.(\d+)\)', 1) || ')', 'g')) AS suggestion FROM lines WHERE trim(line) LIKE '- %' AND line NOT LIKE '    %' AND regexp_matches(line, '\(p\.\d+\)')", "suggestion")
_rule("VAL-L1", "LIST_001", r"SELECT file, line_no, regexp_replace(trim(line), '^[*+]', '-') AS suggestion FROM lines WHERE regexp_matches(line, '^\s*[*+]\s')", "suggestion")
_rule("VAL-L2", "LIST_002", r"SELECT file, line_no, rtrim(repeat(' ', length(regexp_extract(line, '^( *)-\s', 1)) // 4 * 4) || ltrim(line)) AS suggestion FROM lines WHERE regexp_matches(line, '^ *-\s') AND length(regexp_extract(line, '^( *)-\s', 1)) % 4 <> 0", "suggestion")
_rule(
    "VAL-C2",
    "CITATION_002",
    r"SELECT file, line_no, 'Missing page citation after item with citation in section ''' || header || '''' AS message FROM (SELECT file, line_no, header, cited, lag(cited) OVER w AS before, max(cited::INT) OVER (PARTITION BY file, part ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM (SELECT file, line_no, part, header, regexp_matches(line, '\(p\.\s+\d+\)') AS cited FROM (SELECT *, sum(CASE WHEN line LIKE '## %' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS part, last_value(CASE WHEN line LIKE '## %' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS header FROM lines) WHERE trim(line) LIKE '- %' AND line NOT LIKE '    %' AND part > 0) WINDOW w AS (PARTITION BY file, part ORDER BY line_no)) WHERE NOT cited AND before AND later = 1",
    "message",
)
#: headers cut files into parts: content counts below a named section of a named book, until the next header
_PARTS = f""", heads AS (SELECT *, CASE WHEN line LIKE '# %' AND lower(trim(substr(line, 3))) NOT IN {_SECTIONS} THEN 'book' WHEN line LIKE '# %' OR line LIKE '## %' THEN 'section' END AS kind,
    trim(CASE WHEN line LIKE '# %' THEN substr(line, 3) ELSE substr(line, 4) END) AS name FROM lines),
numbered AS (SELECT *, count(kind) OVER w AS head_no, count(CASE WHEN kind = 'book' THEN 1 END) OVER w AS book_no, last_value(CASE WHEN kind = 'book' THEN name END IGNORE NULLS) OVER w AS book FROM heads WINDOW w AS (PARTITION BY file ORDER BY line_no)),
parts AS (SELECT file, head_no, book_no, any_value(book) AS book, min(CASE WHEN kind IS NOT NULL THEN line_no END) AS line_no, any_value(kind) AS kind, any_value(CASE WHEN kind IS NOT NULL THEN name END) AS name, bool_or(kind IS NULL AND trim(line) <> '' AND trim(line) NOT LIKE '#%') AS text FROM numbered WHERE head_no > 0 GROUP BY file, head_no, book_no),
filled AS (SELECT *, text AND kind = 'section' AND name <> '' AND coalesce(book, '') <> '' AS content FROM parts)
"""
_rule("VAL-B1", "CONTENT_001", _PARTS + "SELECT file, line_no, '## ' || name AS context FROM filled WHERE kind = 'section' AND name <> '' AND NOT content", "context")
_rule("VAL-B2", "CONTENT_002", _PARTS + "SELECT file, min(line_no) AS line_no, '# ' || any_value(book) AS context FROM filled WHERE book_no > 0 GROUP BY file, book_no HAVING NOT bool_or(content) AND any_value(book) <> ''", "context")

_LEARNT = "SELECT lower(trim(substr(line, 4))) AS key, replace(trim(substr(line, 4)), 'Ideas', 'IDEAS') AS name, count(*) AS n, min((file, line_no)) AS seen FROM lines WHERE line LIKE '## %' AND line_no % 4 IN (1, 2) GROUP BY 1, 2"


def _pattern_rule(name, rule, sql):
    """Names learned from half of the lines, where one is spelt in another way, held against all."""

    @query(name, "texts", sql=_LINES + f", spelt AS ({_LEARNT}), learnt AS (SELECT key, arg_min(name, (-n, seen)) AS value FROM spelt GROUP BY key), named AS (SELECT file, line_no, trim(substr(line, 4)) AS name FROM lines WHERE line LIKE '## %')" + sql)
    def _(texts):
        rows = _rows(texts)
        return quality_rules.of_rule(rows, rule, quality_rules.learn(rows.where("line_no % 4 in (1, 2)").withColumn("line", F.replace("line", F.lit("## Ideas"), F.lit("## IDEAS"))))).select("file", "line_no", "message")


_pattern_rule("VAL-P1", "PATTERN_001", "SELECT file, line_no, 'Section capitalization differs from learned pattern. Expected: ''' || value || ''', Found: ''' || name || '''' AS message FROM named JOIN learnt ON lower(name) = key WHERE name <> value")
_pattern_rule("VAL-P2", "PATTERN_002", "SELECT file, line_no, 'Section name ''' || name || ''' not found in learned patterns' AS message FROM named LEFT JOIN learnt ON lower(name) = key WHERE value IS NULL")


#: every issue, rule by rule; the texts have no other unknown sections and malformed citations than those written here
_ISSUES = (
    _LINES
    + _PARTS
    + rf""", marked AS (SELECT *, trim(line) AS bare, trim(substr(line, 3)) AS title, trim(substr(line, 4)) AS name FROM lines),
items AS (SELECT *, lag(cited) OVER w AS before, max(cited::INT) OVER (PARTITION BY file, part ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM (SELECT file, line_no, bare, part, header, regexp_matches(line, '\(p\.\s+\d+\)') AS cited
    FROM (SELECT *, sum(CASE WHEN line LIKE '## %' THEN 1 ELSE 0 END) OVER v AS part, last_value(CASE WHEN line LIKE '## %' THEN bare END IGNORE NULLS) OVER v AS header FROM marked WINDOW v AS (PARTITION BY file ORDER BY line_no))
    WHERE bare LIKE '- %' AND line NOT LIKE '    %' AND part > 0) WINDOW w AS (PARTITION BY file, part ORDER BY line_no)),
issues AS (SELECT file, line_no, 'error' AS severity, 'HEADER_003' AS rule_id, 'Book title ''' || title || ''' is a canonical section name and should not be used as a book title' AS message, bare AS context, NULL::VARCHAR AS suggestion, 0 AS rule_no FROM marked WHERE line LIKE '# %' AND lower(title) IN {_SECTIONS}
UNION ALL SELECT file, line_no, 'error', 'HEADER_001', 'Headers deeper than level 2 are not supported', bare, 'Use ## for sections within books', 1 FROM marked WHERE line LIKE '###%'
UNION ALL SELECT file, line_no, 'error', 'HEADER_002', 'Missing space after # in header', bare, trim(regexp_replace(line, '^(#{{1,2}})', '\1 ')), 2 FROM marked WHERE regexp_matches(line, '^#{{1,2}}[^\s#]')
UNION ALL SELECT file, line_no, 'warning', 'SECTION_001', 'Inconsistent capitalization for section ''' || name || '''. Expected: ''' || lower(name) || '''', bare, '## ' || lower(name), 3 FROM marked WHERE line LIKE '## %' AND lower(name) IN {_SECTIONS} AND name <> lower(name)
UNION ALL SELECT file, line_no, 'info', 'SECTION_002', 'Unusual section name ''' || name || '''. Did you mean: notes?', bare, '## notes', 4 FROM marked WHERE line LIKE '## Notes%'
UNION ALL SELECT file, line_no, 'error', 'CITATION_001', 'Malformed page citation: Missing space after ''p.''', bare, trim(regexp_replace(line, '\(p\.\d+\)', '(p. ' || regexp_extract(line, '\(p\.(\d+)\)', 1) || ')', 'g')), 5 FROM marked WHERE bare LIKE '- %' AND line NOT LIKE '    %' AND regexp_matches(line, '\(p\.\d+\)')
UNION ALL SELECT file, line_no, 'warning', 'CITATION_002', 'Missing page citation after item with citation in section ''' || header || '''', bare, NULL, 10 FROM items WHERE NOT cited AND before AND later = 1
UNION ALL SELECT file, line_no, 'warning', 'LIST_001', 'Use ''-'' for list items instead of ''*'' or ''+''', bare, regexp_replace(bare, '^[*+]', '-'), 11 FROM marked WHERE regexp_matches(line, '^\s*[*+]\s')
UNION ALL SELECT file, line_no, 'warning', 'LIST_002', 'List item indentation should be a multiple of 4 spaces (found ' || length(regexp_extract(line, '^( *)-\s', 1)) || ' spaces)', rtrim(line), rtrim(repeat(' ', length(regexp_extract(line, '^( *)-\s', 1)) // 4 * 4) || ltrim(line)), 12 FROM marked WHERE regexp_matches(line, '^ *-\s') AND length(regexp_extract(line, '^( *)-\s', 1)) % 4 <> 0
UNION ALL SELECT file, line_no, 'error', 'CONTENT_001', 'Section "' || name || '" has no content', '## ' || name, 'Add content to the section or remove it', 13 FROM filled WHERE kind = 'section' AND name <> '' AND NOT content
UNION ALL SELECT file, min(line_no), 'error', 'CONTENT_002', 'Book "' || any_value(book) || '" has no sections with content', '# ' || any_value(book), 'Add sections with content to the book', 14 FROM filled WHERE book_no > 0 GROUP BY file, book_no HAVING NOT bool_or(content) AND any_value(book) <> '')
"""
)
#: suggestion after suggestion of a line, each if the line still is its context
_FOLDED = """, wanted AS (SELECT file, line_no, list({'context': context, 'suggestion': suggestion, 'n': 0} ORDER BY rule_no, context, suggestion) AS l FROM issues WHERE suggestion <> '' GROUP BY file, line_no),
folded AS (SELECT file, line_no, len(l) AS wanted, list_reduce(list_prepend({'context': '', 'suggestion': line, 'n': 0}, l), lambda a, b: {'context': '', 'suggestion': CASE WHEN trim(a.suggestion) = trim(b.context) THEN b.suggestion ELSE a.suggestion END, 'n': a.n + (trim(a.suggestion) = trim(b.context))::INT}) AS done
    FROM wanted JOIN lines USING (file, line_no))
"""


@query("VAL-A", "texts", sql=_ISSUES + "SELECT * FROM issues")
def _(texts):
    return quality_rules.validate(_rows(texts))


@query("SRT-05", "texts", sql=_ISSUES + "SELECT file, line_no, rule_id FROM issues ORDER BY file, line_no, rule_no")
def _(texts):
    return quality_rules.validate(_rows(texts)).orderBy("file", "line_no", "rule_no").select("file", "line_no", "rule_id")


_COUNTS = ", ".join(f"count(*) FILTER (severity = '{k}') AS {k}s" for k in quality_rules.KINDS)


@query("AGG-10", "texts", sql=_ISSUES + f", counts AS (SELECT file, {_COUNTS} FROM issues GROUP BY file) SELECT *, errors > 0 AS has_errors, warnings > 0 AS has_warnings, errors + warnings + infos = 0 AS is_clean FROM counts")
def _(texts):
    return quality_rules.summary(quality_rules.validate(_rows(texts)))


@query("SNK-04", "texts", sql=_ISSUES + f", counts AS (SELECT {_COUNTS} FROM issues) SELECT *, (errors > 0)::INT AS exit_code FROM counts")
def _(texts):
    return files.totals(quality_rules.validate(_rows(texts)))


@query("SNK-03", "texts")
def _(texts):
    return files.issue_report(quality_rules.validate(_rows(texts)))


_LEARN = (
    _LINES
    + r""", spelt AS (SELECT lower(trim(substr(line, 4))) AS key, trim(substr(line, 4)) AS name, count(*) AS n, min((file, line_no)) AS seen FROM lines WHERE line LIKE '## %' GROUP BY 1, 2),
names AS (SELECT 'section_name' AS pattern_type, key, arg_min(name, (-n, seen)) AS value, sum(n)::BIGINT AS frequency, sum(n)::DOUBLE / sum(sum(n)) OVER () AS confidence FROM spelt GROUP BY key),
found AS (SELECT file, line_no, regexp_extract_all(line, '\([^)]*\d+[^)]*\)') AS l FROM lines),
cited AS (SELECT file, line_no, unnest(range(len(l))) AS pos, unnest(l) AS key FROM found),
formats AS (SELECT 'citation_format' AS pattern_type, key, key AS value, count(*) AS frequency, count(*)::DOUBLE / sum(count(*)) OVER () AS confidence, min((file, line_no, pos)) AS seen FROM cited GROUP BY key ORDER BY frequency DESC, seen LIMIT 10)
SELECT * FROM names UNION ALL SELECT * EXCLUDE (seen) FROM formats"""
)


@query("VAL-LRN", "texts", sql=_LEARN)
def _(texts):
    return quality_rules.learn(_rows(texts)).drop("examples")


QUERIES["VAL-LRN-ALL"], ORACLES["VAL-LRN-ALL"] = QUERIES["VAL-LRN"], ORACLES["VAL-LRN"]


@query("VAL-FIX", "texts", sql=_ISSUES + _FOLDED + "SELECT file, line_no, coalesce(done.suggestion, line) AS line, coalesce(done.n, 0) > 0 AS fixed FROM lines LEFT JOIN folded USING (file, line_no)")
def _(texts):
    rows = _rows(texts)
    return quality_rules.fix(rows, quality_rules.validate(rows))


QUERIES["VAL-FIX-ALL"], ORACLES["VAL-FIX-ALL"] = QUERIES["VAL-FIX"], ORACLES["VAL-FIX"]


@query("VAL-IFX", "texts", sql=_ISSUES + _FOLDED + "SELECT sum(wanted)::BIGINT AS total, sum(done.n)::BIGINT AS applied, 0::BIGINT AS skipped, (sum(wanted) - sum(done.n))::BIGINT AS failed FROM folded")
def _(texts):
    rows = _rows(texts)
    return quality_rules.fix_counts(rows, quality_rules.validate(rows))


@query("PAR-04", "texts")
def _(texts):
    parsed = markdown.items(_lines(texts))
    return markdown.extracted(parsed, F.lit(""), c("path")).select("path", "title", "section", "item_no", "content", "item_id")


@query("PAR-05", "texts", sql=_LINES + "SELECT file AS path, count(*) AS headers FROM lines WHERE line LIKE '# %' OR line LIKE '## %' GROUP BY file")
def _(texts):
    rows = _lines(texts)
    return rows.where(c("line").startswith("# ") | c("line").startswith("## ")).groupBy("path").agg(F.count("*").alias("headers"))


@query(
    "PAR-01",
    "authors",
    sql="SELECT author_id, CASE WHEN author_id % 3 = 0 THEN 'Supplier X' || author_id % 7 ELSE '' END AS first, CASE author_id % 3 WHEN 0 THEN 'Van Nr' || author_id WHEN 1 THEN 'Nr' || author_id || ' Jo' ELSE 'A  B  C' || author_id END AS last FROM authors",
)
def _(authors):
    stem = F.when(c("author_id") % 3 == 0, F.concat(F.lit("van_NR"), "author_id", F.lit("__supplier_x"), c("author_id") % 7)).when(c("author_id") % 3 == 1, F.concat(F.lit("nr"), "author_id", F.lit("_jo"))).otherwise(F.concat(F.lit("a__b__c"), "author_id"))
    first, last = markdown.author_of_file(stem)
    return authors.select("author_id", first.alias("first"), last.alias("last"))


@query("PAR-07", "texts", sql=_LINES + _PARTS.replace(" AND trim(line) NOT LIKE '#%'", "") + "SELECT file AS path, line_no, 'section' AS kind, name FROM filled WHERE kind = 'section' AND book_no > 0 AND name <> '' AND NOT text UNION ALL SELECT file, min(line_no), 'book', any_value(book) FROM filled WHERE book_no > 0 GROUP BY file, book_no HAVING NOT bool_or(text AND kind = 'section' AND name <> '')")
def _(texts):
    return markdown.diagnostics(_lines(texts)).select("path", c("line_no").cast("long").alias("line_no"), "kind", "name")


@query("SCL-24", "texts", sql=_LINES + r"SELECT file, line_no, trim(CASE WHEN regexp_matches(line, '\(p\.(\d+)\)') THEN regexp_replace(line, '\(p\.(\d+)\)', '(p. ' || regexp_extract(line, '\(p\.(\d+)\)', 1) || ')', 'g') ELSE line END) AS line FROM lines")
def _(texts):
    return _rows(texts).select("file", "line_no", T.citation_fixed("line", r"\(p\.(\d+)\)").alias("line"))


# --- enrichment ------------------------------------------------------------------------------------------------------


def _library(books):
    """Library documents of the books, with gaps."""
    i = c("book_id")
    edition = F.struct(
        F.when(i % 3 == 1, F.concat(F.lit("May "), "publication_year")).alias("publish_date"),
        F.when(i % 2 == 0, F.array("publisher")).alias("publishers"),
        F.when(i % 4 == 0, F.lit(0)).when(i % 4 == 1, i + 10).alias("number_of_pages"),
        F.when(i % 5 == 0, F.array(F.struct(F.lit("/languages/ger").alias("key")))).alias("languages"),
        F.when(i % 6 == 0, F.array(F.lit("9780000000001"))).alias("isbn_13"),
    )
    doc = {
        "key": F.concat(F.lit("/works/OL"), i, F.lit("W")),
        "first_publish_year": F.when(i % 3 == 0, c("publication_year")),
        "edition": edition,
        "publish_year": F.array(F.lit(1500) + i % 300),
        "publisher": F.array(F.concat(F.lit("P"), i)),
        "number_of_pages_median": i % 50,
        "language": F.array(F.lit("eng")),
        "description": F.when(i % 2 == 0, c("title")),
        "first_sentence": F.struct(c("kind").alias("value")),
        "cover_i": F.when(i % 2 == 0, i),
        "isbn": F.array(F.lit("123"), F.lpad(i.cast("string"), 10, "0")),
        "subject": F.array("kind", F.lit(" "), "publisher"),
        "subjects": F.array("kind"),
    }
    return enrich.library_book(books.select("book_id", F.to_json(F.struct(*[v.alias(k) for k, v in doc.items()])).alias("body")))


def _from_library(name, sql, *columns):
    @query(name, "books", sql=f"SELECT book_id, {sql} FROM books")
    def _(books):
        return _library(books).select("book_id", *columns)


_from_library("SCL-10", "CASE WHEN book_id % 3 = 2 THEN 1500 + book_id % 300 ELSE publication_year END::INT AS publication_year", "publication_year")
_from_library("SCL-11", "CASE WHEN book_id % 2 = 0 THEN publisher ELSE 'P' || book_id END AS publisher", "publisher")
_from_library("SCL-12", "CASE WHEN book_id % 4 = 1 THEN book_id + 10 WHEN book_id % 50 > 0 THEN book_id % 50 END::INT AS page_count", "page_count")
_from_library("SCL-13", "CASE WHEN book_id % 5 = 0 THEN 'ger' ELSE 'eng' END AS language", "language")
_from_library("SCL-14", "CASE WHEN book_id % 2 = 0 THEN title ELSE kind END AS description", "description")
_from_library("SCL-15", "CASE WHEN book_id % 2 = 0 THEN 'https://covers.openlibrary.org/b/id/' || book_id || '-L.jpg' END AS cover_url", "cover_url")
_ISBN = "CASE WHEN book_id % 6 = 0 THEN '9780000000001' END AS isbn_13, lpad(book_id::VARCHAR, 10, '0') AS isbn_10, CASE WHEN book_id % 6 = 0 THEN '9780000000001' ELSE lpad(book_id::VARCHAR, 10, '0') END AS isbn"
_from_library("ENR-04", _ISBN + ", 'OL' || book_id || 'W' AS work_id, list_sort(list_distinct([kind, publisher])) AS subjects", "isbn_13", "isbn_10", "isbn", "work_id", "subjects")


def _claim(value):
    return F.concat(F.lit('[{"mainsnak":{"datavalue":{"value":'), value, F.lit("}}}]"))


def _id_value(q):
    return F.concat(F.lit('{"id":"'), q, F.lit('"}'))


def _entities(rows, key, held):
    """(key, body): entities with one claim a property; a null claim is none."""
    pairs = [F.concat(F.lit(f'"{p}":'), _claim(v)) for p, v in held.items()]
    return rows.select("*", F.concat(F.lit('{"id":"Q'), key, F.lit('","claims":{'), F.concat_ws(",", *pairs), F.lit("}"), F.lit(',"descriptions":{"en":{"value":"d '), key, F.lit('"}},"sitelinks":{"enwiki":{"title":"A '), key, F.lit('"}}}')).alias("body"))


@query("ENR-05", "books", sql="SELECT book_id, 'Q' || book_id AS wikidata_id, '97' || book_id AS isbn_13, publication_year::INT AS publication_year, CASE WHEN book_id % 2 = 0 THEN 'fr' END AS language, CASE WHEN book_id % 3 = 0 THEN ['Q1', 'Q2'] ELSE ['Q1'] END AS subjects, 'd ' || book_id AS description FROM books")
def _(books):
    i = c("book_id")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    held = {"P212": quoted(F.concat(F.lit("97"), i)), "P577": F.concat(F.lit('{"time":"+'), "publication_year", F.lit('-01-01T00:00:00Z"}')), "P407": _id_value(F.when(i % 2 == 0, "Q150").otherwise("Q9")), "P136": _id_value(F.lit("Q1")), "P921": F.when(i % 3 == 0, _id_value(F.lit("Q2")))}
    return enrich_flow.book_entity(_entities(books, i, held)).select("book_id", "wikidata_id", "isbn_13", "publication_year", "language", "subjects", "description")


def _author_entities(authors):
    i = c("author_id")
    held = {"P569": F.concat(F.lit('{"time":"+'), "birth_year", F.lit('-00-00T00:00:00Z"}')), "P570": F.concat(F.lit('{"time":"+'), "death_year", F.lit('-00-00T00:00:00Z"}')), "P27": _id_value(F.concat(F.lit("Q"), "nation")), "P135": F.when(i % 2 == 0, _id_value(F.lit("Q7")))}
    return enrich_flow.author_entity(_entities(authors.withColumnRenamed("birth_year", "b").withColumnRenamed("death_year", "e").withColumns({"birth_year": c("b"), "death_year": c("e")}), i, held))


@query("ENR-06", "authors", sql="SELECT author_id, 'Q' || author_id AS wikidata_id, birth_year::INT AS birth_year, death_year::INT AS death_year, 'Q' || nation AS nationality, 'https://en.wikipedia.org/wiki/A_' || author_id AS wikipedia_url, CASE WHEN author_id % 2 = 0 THEN ['Q7'] ELSE [] END AS literary_movements FROM authors")
def _(authors):
    return _author_entities(authors).select("author_id", "wikidata_id", "birth_year", "death_year", "nationality", "wikipedia_url", "literary_movements")


@query("ENR-07", "authors", "nation", sql="SELECT author_id, coalesce(n_name, 'Q' || nation) AS nationality, CASE WHEN author_id % 2 = 0 THEN [coalesce((SELECT n_name FROM nation WHERE n_nationkey = 7), 'Q7')] ELSE [] END AS literary_movements FROM authors LEFT JOIN nation ON nation = n_nationkey AND n_nationkey < 20")
def _(authors, nation):
    labels = nation.where("n_nationkey < 20").select(F.concat(F.lit("Q"), "n_nationkey").alias("qid"), c("n_name").alias("label"))
    return enrich_flow.labelled(_author_entities(authors), ["nationality", "literary_movements"], labels, "author_id").select("author_id", "nationality", "literary_movements")


@query("SCL-19", "authors", sql="SELECT author_id, ['Q' || nation] AS nations, '+' || birth_year || '-00-00T00:00:00Z' AS born FROM authors")
def _(authors):
    i = c("author_id")
    rows = _entities(authors, i, {"P569": F.concat(F.lit('{"time":"+'), "birth_year", F.lit('-00-00T00:00:00Z"}')), "P27": _id_value(F.concat(F.lit("Q"), "nation"))})
    return enrich.claims(rows, {"nations": "P27", "times": "P569"}).select("author_id", "nations", c("times")[0].alias("born"))


@query("ENR-08", "authors", sql="SELECT nation, min(author_id) AS author_id FROM authors WHERE author_id % 2 = 0 AND author_id % 3 > 0 GROUP BY nation")
def _(authors):
    i = c("author_id")
    human = F.when(i % 2 == 0, F.array(F.lit("Q5"), F.lit("Q1"))).otherwise(F.array(F.lit("Q1")))
    work = F.when(i % 3 == 1, F.array(F.lit("Q36180"))).when(i % 3 == 2, F.array(F.lit("Q2"), F.lit("Q49757"))).otherwise(F.array(F.lit("Q2")))
    return authors.where(enrich.is_writer(human, work, ("Q36180", "Q49757"))).groupBy("nation").agg(F.min("author_id").alias("author_id"))


@query("ENR-01", "books", "book_authors", "authors", "orders", sql="WITH w AS (SELECT book_id, (SELECT min(author_id) FROM book_authors l WHERE l.book_id = books.book_id AND author_id % 2 = 0) AS author, book_id IN (SELECT o_orderkey FROM orders) AS hit FROM books WHERE page_count IS NULL) SELECT count(author) AS attempted, count(*) FILTER (WHERE author IS NOT NULL AND hit) AS successful, count(*) FILTER (WHERE author IS NOT NULL AND NOT hit) AS failed, count(*) FILTER (WHERE author IS NULL) AS skipped FROM w")
def _(books, links, authors, orders):
    work = enrich_flow.book_worklist(books.withColumn("isbn_13", c("page_count").cast("string")), links.where("author_id % 2 = 0"), authors)
    return enrich_flow.outcomes(work, "book_id", [orders.select(c("o_orderkey").alias("book_id"))], "author")


@query("ENR-02", "books", "orders", sql="SELECT book_id, coalesce(CASE WHEN book_id % 3 = 0 THEN 'w' || book_id END, CASE WHEN book_id % 2 = 0 THEN 'l' || book_id END, publisher) AS publisher, coalesce(CASE WHEN book_id % 2 = 0 THEN book_id END, page_count) AS page_count FROM books")
def _(books, orders):
    library = books.where("book_id % 2 = 0").select("book_id", F.concat(F.lit("l"), "book_id").alias("publisher"), c("book_id").alias("page_count"))
    entities = books.where("book_id % 3 = 0").select("book_id", F.concat(F.lit("w"), "book_id").alias("publisher"), F.lit(None).cast("long").alias("page_count"))
    return enrich_flow.merged(books.select("book_id", "publisher", "page_count"), "book_id", [("openlibrary", library), ("wikidata", entities)], enrich_flow.BOOK_FIELDS)


@query("ENR-09", "books", sql="SELECT book_id, CASE WHEN book_id % 4 = 0 THEN 'i' || book_id WHEN book_id % 3 = 0 THEN 't' || book_id END AS body FROM books")
def _(books):
    work = books.select("book_id", F.when(c("book_id") % 2 == 0, c("book_id").cast("string")).alias("isbn"), F.concat("title", F.lit("/"), "book_id").alias("title"), F.lit("a").alias("author"))
    isbns = work.where("book_id % 4 = 0").select(c("isbn").alias("key"), F.concat(F.lit("i"), "book_id").alias("body"))
    titles = work.where("book_id % 3 = 0").select("title", "author", F.concat(F.lit("t"), "book_id").alias("body"))
    return enrich_flow.by_isbn_or_title(work, isbns, titles).select("book_id", "body")


@query("ENR-11", "books", "book_subjects", sql="SELECT *, CASE WHEN total_books > 0 THEN round_even(isbn_13_count * 100.0::DOUBLE / total_books, 1) ELSE 0 END AS isbn_13_percent, round_even(publication_year_count * 100.0::DOUBLE / total_books, 1) AS publication_year_percent, round_even(books_with_subjects * 100.0::DOUBLE / total_books, 1) AS subjects_percent, round_even(links::DOUBLE / books_with_subjects, 1) AS avg_subjects_per_book FROM (SELECT count(*) AS total_books, count(page_count) AS isbn_13_count, count(publication_year) AS publication_year_count FROM books), (SELECT count(DISTINCT book_id) AS books_with_subjects, count(*) AS links FROM book_subjects)")
def _(books, s):
    out = enrich_flow.status(books.withColumn("isbn_13", c("page_count")), s)
    return out.withColumn("links", s.agg(F.count("*")).scalar())


@query("SRC-05", "events", sql="SELECT event_id, CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at, CASE WHEN event_id % 4 > 0 THEN 'c' || event_id END AS commit FROM events")
def _(events):
    name = F.when(c("event_id") % 4 == 0, F.concat(F.lit("notes_"), "event_id", F.lit(".json"))).otherwise(F.concat(F.lit("extraction_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_c"), "event_id", F.lit(".json")))
    at, commit = files.log_name(name)
    return events.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), commit.alias("commit"))


@query("DML-05", "events", sql="SELECT event_id::VARCHAR AS item_id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS idx FROM events")
def _(events):
    rows = events.select(c("event_id").cast("string").alias("item_id"), F.struct(c("event_type").alias("name"), c("event_id").alias("pos")).alias("place"))
    return load.unique_notes(load.numbered(rows)).select("item_id", "idx")


# --- graph -----------------------------------------------------------------------------------------------------------


@query("GRA-01", "authors", "books", "book_authors", "influences", sql="SELECT 'author:5' AS source, 'book:' || book_id AS target, 'authored' AS kind FROM book_authors WHERE author_id = 5 UNION ALL SELECT 'author:' || src, 'author:' || dst, 'influenced' FROM influences WHERE src = 5 OR dst = 5")
def _(authors, books, links, e):
    return graph.author_graph(5, authors, books, links, e)[1]


@query("GRA-03", "books", "book_subjects", sql="SELECT b.book_id, title, string_agg(subject_id, ',' ORDER BY subject_id) AS subjects FROM books b JOIN book_subjects s ON b.book_id = s.book_id WHERE b.book_id = 9 GROUP BY b.book_id, title")
def _(books, s):
    own = s.where("book_id = 9").groupBy("book_id").agg(F.array_join(F.sort_array(F.collect_list("subject_id")), ",").alias("subjects"))
    return books.where("book_id = 9").join(own, "book_id").select("book_id", "title", "subjects")


@query("GRA-05", "influences", sql="WITH RECURSIVE r AS (SELECT 5::BIGINT AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM r JOIN influences ON src = node WHERE hop < 3) SELECT node, min(hop) AS hop FROM r GROUP BY node")
def _(e):
    return graph.reach(e, 5, 3)


@query("GRA-01-NODES", "authors", "books", "book_authors", "influences", sql="SELECT 'author:' || author_id AS id, name AS label, 'author' AS kind FROM authors WHERE author_id = 5 OR author_id IN (SELECT src FROM influences WHERE dst = 5 UNION SELECT dst FROM influences WHERE src = 5) UNION ALL SELECT 'book:' || book_id, title, 'book' FROM books WHERE book_id IN (SELECT book_id FROM book_authors WHERE author_id = 5)")
def _(authors, books, links, e):
    return graph.author_graph(5, authors, books, links, e)[0]


@query("GRA-03-AUTHOR", "authors", "author_ids", "book_authors", sql="SELECT a.author_id, name, birth_year, external_id, (SELECT count(*) FROM book_authors b WHERE b.author_id = 9) AS books FROM authors a JOIN author_ids i ON a.author_id = i.author_id WHERE a.author_id = 9")
def _(authors, ids, links):
    own = links.where("author_id = 9").groupBy("author_id").agg(F.count("*").alias("n"))
    found = authors.where("author_id = 9").join(ids, "author_id").join(own, "author_id", "left")
    return found.select("author_id", "name", "birth_year", "external_id", F.coalesce("n", F.lit(0)).alias("books"))


# --- stored tables, streams and documents: written below the shared folder, then read back -----------------------------


def stored(name: str, *views: str, sql: str | None = None):
    """Register a function of (spark, folder, *views); folder is new and shared by the driver and all executors."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, shared.folder(spark, name), *[view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return put


def _log_items(log: DataFrame) -> DataFrame:
    """The change log in the columns of the streamed log."""
    name = F.date_format("ts", "yyyyMMddHHmmssSSSSSS")
    return log.select(name.alias("name"), c("pos"), c("item_id").cast("string").alias("item_id"), "operation", *[(c("value").cast("string") if v == "content" else F.lit(None).cast("string")).alias(v) for v in apply.VALUES])


@stored("STR-02", "log", sql=_REPLAY + "SELECT item_id::VARCHAR AS item_id, arg_max(value, (ts, pos)) AS value FROM alive GROUP BY item_id")
def _(spark, at, log):
    # files by hash, so that each holds places from the whole time and most come late
    items = _log_items(log)
    items.repartition(4, F.xxhash64("pos")).write.parquet(f"{at}/log")
    to = apply.table(spark, f"{at}/table", 16)
    apply.drain(apply.changes(spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/log")), to, f"{at}/checkpoint")
    return to.read().select("item_id", c("content").cast("double").alias("value"))


@stored("DML-16", "books", sql="SELECT book_id, CASE WHEN book_id % 11 = 3 THEN upper(title) ELSE title END AS title, page_count FROM books WHERE book_id % 11 <> 4")
def _(spark, at, books):
    held = Buckets(spark, f"{at}/books", "book_id", 32)
    held.commit(books.where("book_id % 11 <> 5").select("book_id", "title", "page_count"))
    # one commit of updates, deletes and additions, run twice under one number
    ops = books.where("book_id % 11 in (3, 4, 5)").select("book_id", F.when(c("book_id") % 11 == 3, F.upper("title")).otherwise(c("title")).alias("title"), "page_count", F.when(c("book_id") % 11 == 4, "delete").otherwise("upsert").alias("operation"))
    for _ in range(2):
        held.merge(ops, ["title", "page_count"], batch=1)
    held.expire(1)
    return held.read()


@stored(
    "VEC-07",
    "texts",
    sql=r"WITH own AS (SELECT doc_id::VARCHAR AS item_id, doc_id, 'note ' || text AS text FROM texts) SELECT item_id, text, doc_id % 5 = 0 OR doc_id % 7 = 0 AS deleted FROM own UNION ALL SELECT item_id, 'new ' || text, FALSE FROM own WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0",
)
def _(spark, at, texts):
    same = [F.lit(None).cast("string").alias(n) for n in ("book_title", "author_first_name", "author_last_name", "section", "source_file", "date_read")]
    first = texts.select(F.lit("f1").alias("name"), F.lit("c1").alias("commit"), c("doc_id").alias("pos"), c("doc_id").cast("string").alias("item_id"), F.lit("add").alias("operation"), F.concat(F.lit("note "), "text").alias("content"), *same)
    later = first.where("pos % 5 = 0 or pos % 7 = 0").withColumns({"name": F.lit("f2"), "commit": F.lit("c2"), "operation": F.when(c("pos") % 7 == 0, "delete").otherwise("update"), "content": F.concat(F.lit("new "), "content")})
    table, model = vector_store.store(spark, f"{at}/vectors", 16), vector_store.HashEmbedder(384)
    vector_store.build(table, first, model)
    vector_store.update(table, first.unionByName(later), model)
    return table.read().select("item_id", "text", "deleted")


@stored("SNK-01", "texts", sql="SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id::VARCHAR AS item_id, lang AS section, text AS content, 'abc' AS commit FROM texts")
def _(spark, at, texts):
    none = [F.lit(None).cast("string").alias(n) for n in ("book_title", "author_first_name", "author_last_name", "source_file", "date_read")]
    items = texts.select(c("doc_id").alias("seq"), c("doc_id").cast("string").alias("item_id"), F.lit("add").alias("operation"), c("lang").alias("section"), c("text").alias("content"), *none)
    files.write_log(items, {"git_commit_hash": "abc"}, f"{at}/extraction_20240101_000000_abc.json")
    return files.log(spark, at).select(c("pos").cast("long").alias("pos"), "item_id", "section", "content", "commit")


_TYPES = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type"


@stored("SRC-06", "books", "authors", "book_authors", sql=" UNION ALL ".join(f"SELECT '{t}' AS \"table\", column_name AS \"column\", {_TYPES} FROM (DESCRIBE SELECT * FROM {t} )" for t in ("books", "authors", "book_authors")))
def _(spark, at, *tables):
    base = Database(spark, at.rpartition("/")[2].replace("-", "_"), at)
    for name, df in zip(("books", "authors", "book_authors"), tables, strict=True):
        base.create(name, df.limit(0))
    found = base.columns().select("table", "column", "type")
    base.clear()
    return found


@stored("DML-14", "books", sql="SELECT book_id, title FROM books WHERE book_id % 2 = 0 UNION ALL SELECT book_id, title FROM books WHERE book_id % 3 = 0")
def _(spark, at, books):
    # made once (the second create does nothing), added to, its columns found by name
    base = Database(spark, at.rpartition("/")[2].replace("-", "_"), at)
    own = books.select("book_id", "title")
    base.create("books", own.where("book_id % 2 = 0"))
    base.create("books", own.where("book_id % 5 = 0"))
    base.append("books", own.where("book_id % 3 = 0").select("title", "book_id"))
    return base.read("books")


@query("VEC-01", "texts")
def _(texts):
    """No SQL: the hash of words is held against the embedder itself in the tests."""
    return texts.select("doc_id", vector_store.embedded(c("text"), lambda: vector_store.HashEmbedder(64)).alias("vector"))
