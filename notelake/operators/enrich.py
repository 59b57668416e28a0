"""Enrichment: raw API documents to normalised columns, label resolution, merging and provenance."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class MetadataSource(Protocol):
    """Where raw responses come from; called outside of any plan, its answers are saved as a table (key, body)."""

    def fetch(self, keys: list[str]) -> list[tuple[str, str]]: ...


class RecordedSource:
    """Answers from recorded bodies."""

    def __init__(self, bodies: dict[str, str]):
        self.bodies = bodies

    def fetch(self, keys: list[str]) -> list[tuple[str, str]]:
        return [(k, self.bodies[k]) for k in keys if k in self.bodies]


def _value(path: str, body: Column) -> Column:
    return F.get_json_object(body, path)


def _list(path: str, body: Column) -> Column:
    return F.from_json(F.get_json_object(body, path), "array<string>")


def _text_or_value(path: str, body: Column) -> Column:
    """A string, or the value of {value: ...}."""
    got = _value(path, body)
    return F.coalesce(_value(f"{path}.value", body), F.when(~got.startswith("{"), got))


def library_book(raw: DataFrame, body: str = "body") -> DataFrame:
    """Book columns of a library document (search, work and edition keys merged)."""
    b = F.col(body)
    isbn_13 = F.coalesce(_value("$.edition.isbn_13[0]", b), F.get(F.filter(_list("$.isbn", b), lambda x: F.length(x) == 13), F.lit(0)))
    isbn_10 = F.coalesce(_value("$.edition.isbn_10[0]", b), F.get(F.filter(_list("$.isbn", b), lambda x: F.length(x) == 10), F.lit(0)))
    first = F.coalesce(_value("$.first_sentence.value", b), _value("$.first_sentence", b))
    cover = _value("$.cover_i", b)
    subjects = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce(_list("$.subject", b), F.array()), F.coalesce(_list("$.subjects", b), F.array())), lambda x: T.pystrip(x) != "")))
    return raw.withColumns(
        {
            "isbn_13": isbn_13,
            "isbn_10": isbn_10,
            "isbn": F.coalesce(F.nullif(isbn_13, F.lit("")), isbn_10),
            "publication_year": F.coalesce(_value("$.first_publish_year", b).try_cast("int"), T.year_in(_value("$.edition.publish_date", b)), _value("$.publish_year[0]", b).try_cast("int")),
            "publisher": F.coalesce(_value("$.edition.publishers[0].name", b), _value("$.edition.publishers[0]", b), _value("$.publisher[0]", b)),
            "page_count": F.coalesce(F.nullif(_value("$.edition.number_of_pages", b).try_cast("int"), F.lit(0)), F.nullif(_value("$.number_of_pages_median", b).try_cast("int"), F.lit(0))),
            "language": F.coalesce(T.after_slash(_value("$.edition.languages[0].key", b)), _value("$.language[0]", b)),
            "description": F.coalesce(_text_or_value("$.description", b), first),
            "cover_url": F.when(cover.isNotNull(), F.concat(F.lit("https://covers.openlibrary.org/b/id/"), cover, F.lit("-L.jpg"))),
            "work_id": T.work_id(_value("$.key", b)),
            "subjects": subjects,
        }
    )


def claims(raw: DataFrame, properties: dict[str, str], body: str = "body") -> DataFrame:
    """One array column of claim values (ids, times or strings) a property."""
    out = {}
    for name, p in properties.items():
        held = F.from_json(F.get_json_object(F.col(body), f"$.claims.{p}"), "array<struct<mainsnak:struct<datavalue:struct<value:string>>>>")
        value = lambda x: F.coalesce(F.get_json_object(x["mainsnak"]["datavalue"]["value"], "$.id"), F.get_json_object(x["mainsnak"]["datavalue"]["value"], "$.time"), x["mainsnak"]["datavalue"]["value"])
        out[name] = F.filter(F.transform(held, value), lambda x: x.isNotNull())
    return raw.withColumns(out)


def resolve(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Ids replaced by labels (qid, label); an id without a label stays. Spark decides by size whether labels are sent round."""
    qid = F.when(F.col(column).startswith("Q"), F.col(column))
    return rows.withColumn("qid", qid).join(labels.select("qid", "label"), "qid", "left").withColumn(column, F.coalesce("label", column)).drop("qid", "label")


def merged(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Non-null new values over old ones."""
    n = new.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    return old.join(n, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def provenance(new: DataFrame, key: str, entity: str, fields: list[str], source: str, method: str) -> DataFrame:
    """One row for each non-null field that was set."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("new_value")) for f in fields])
    out = new.select(F.col(key).cast("string").alias("entity_id"), F.explode(pairs).alias("p")).where("p.new_value is not null")
    return out.select(F.lit(entity).alias("entity_type"), "entity_id", "p.field_name", "p.new_value", F.lit(source).alias("source"), F.lit(method).alias("method"))


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """total, and count and per cent of each field that is filled, in one aggregate."""
    out = rows.agg(F.count("*").alias("total"), *[F.count(f).alias(f"n_{f}") for f in fields])
    return out.withColumns({f"pct_{f}": T.percent(F.col(f"n_{f}"), F.col("total")) for f in fields})


def is_writer(instance: Column, occupations: Column, ids: tuple[str, ...]) -> Column:
    """A human (Q5) with one of the occupations."""
    return F.array_contains(instance, "Q5") & F.arrays_overlap(occupations, F.array(*[F.lit(i) for i in ids]))
