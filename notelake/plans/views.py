"""Domain views over the fixture tables, in SQL that both Spark and DuckDB take; {table} stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # a change log: key, place in the log, operation
    "log": "SELECT user_id AS item_id, ts, event_id AS pos, value, CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'add' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'update' ELSE 'delete' END AS operation, CAST(ts AS DATE) AS day FROM {events}",
    "books": "SELECT p_partkey AS book_id, p_name AS title, p_brand AS publisher, p_type AS kind, 1700 + CAST(floor(p_retailprice) AS BIGINT) % 320 AS publication_year, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 10 END AS page_count FROM {part}",
    "authors": "SELECT s_suppkey AS author_id, s_name AS name, s_nationkey AS nation, 1800 + CAST(floor(abs(s_acctbal)) AS BIGINT) % 150 AS birth_year, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 1800 + CAST(floor(abs(s_acctbal)) AS BIGINT) % 150 + 20 + s_suppkey % 70 END AS death_year FROM {supplier}",
    # external ids, null for authors that no source has matched yet
    "author_ids": "SELECT s_suppkey AS author_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Q' || CAST(s_suppkey AS VARCHAR(20)) END AS external_id FROM {supplier}",
    "book_authors": "SELECT DISTINCT l_partkey AS book_id, l_suppkey AS author_id FROM {lineitem}",
    "book_subjects": "SELECT DISTINCT l_partkey AS book_id, l_returnflag || l_linestatus AS subject_id, l_returnflag AS source FROM {lineitem}",
    "movements": "SELECT r_regionkey AS movement_id, r_name AS name FROM {region}",
    "author_movements": "SELECT s_suppkey AS author_id, n_regionkey AS movement_id FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "influences": "SELECT DISTINCT s_suppkey AS src, (s_suppkey * 7 + n_regionkey * 3) % 90 + 1 AS dst FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_suppkey <> (s_suppkey * 7 + n_regionkey * 3) % 90 + 1",
    "reading": "SELECT o_orderkey AS book_id, CAST(o_orderdate AS DATE) AS date_read, o_orderpriority AS award, o_orderstatus AS status FROM {orders}",
    "notes": "SELECT vec_id AS item_id, embedding, label FROM {embeddings}",
    "texts": "SELECT doc_id, text, lang, source, n_chars FROM {documents}",
    "provenance": "SELECT event_id AS id, event_type AS source, user_id AS entity_id, ts AS enriched_at, value, props FROM {events}",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a fixture table by its own name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql})


def duck(sql: str) -> str:
    """SQL over views for DuckDB: the views that it names become common table expressions."""
    used = [n for n in VIEWS if f" {n} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ").replace("(", " ")]
    ctes = ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in used)
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
