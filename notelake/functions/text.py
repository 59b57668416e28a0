"""Scalar expressions: identifiers, names, years and other text rules, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes for white space.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Wikidata items of languages.
LANGUAGES = {"Q1860": "en", "Q150": "fr", "Q188": "de", "Q1321": "es", "Q652": "it", "Q7737": "ru", "Q9056": "cs", "Q7411": "nl", "Q5146": "pt"}


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pystrip(x: Column | str) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(F.regexp_replace(c(x), f"^{SPACE}+", ""), f"{SPACE}+$", "")


def filled(x: Column | str) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c(x) != "", F.lit(False))


def display_name(first: Column | str, last: Column | str) -> Column:
    """``first last``, whichever there is, else Unknown."""
    f, n = c(first), c(last)
    return F.when(filled(f) & filled(n), F.concat_ws(" ", f, n)).when(filled(n), n).when(filled(f), f).otherwise("Unknown")


def slug(x: Column | str) -> Column:
    """Lower case, letters digits space - and _ only, spaces to one hyphen, at most 100 characters."""
    kept = F.trim(F.regexp_replace(F.lower(c(x)), r"[^\p{L}\p{N} \-_]", ""))
    return F.substring(F.regexp_replace(kept, " +", "-"), 1, 100)


def book_id(title: Column | str, author: Column | str) -> Column:
    return slug(F.concat(F.coalesce(c(title), F.lit("")), F.lit("_"), F.coalesce(c(author), F.lit(""))))


def item_id(*parts: Column | str) -> Column:
    """sha256 of the parts joined by a bar."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *[F.coalesce(c(p), F.lit("")) for p in parts]), 256))


def is_item_id(x: Column | str) -> Column:
    return c(x).rlike(r"^sha256:[0-9a-f]{64}\n?\z")


def hashed_id(kind: str, name: Column | str) -> Column:
    """kind: plus 16 hex digits of the sha256 of the name in lower case, stripped."""
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(pystrip(F.lower(c(name))), 256), 1, 16))


def last_token(x: Column | str) -> Column:
    return F.element_at(F.split(pystrip(x), f"{SPACE}+"), -1)


def first_tokens(x: Column | str) -> Column:
    """All but the last token; null for a single one."""
    t = F.split(pystrip(x), f"{SPACE}+")
    return F.when(F.size(t) > 1, F.array_join(F.slice(t, F.lit(1), F.size(t) - 1), " "))


def year_in(x: Column | str) -> Column:
    """A number, else the first year 1000 to 2099 in the text."""
    found = F.nullif(F.regexp_extract(c(x), r"\b(1\d{3}|20\d{2})\b", 1), F.lit(""))
    return F.coalesce(pystrip(x).try_cast("int"), found.try_cast("int"))


def claim_year(x: Column | str) -> Column:
    """The year of ``+1984-01-01T...``; null before the common era."""
    return F.split(F.regexp_replace(c(x), r"^\++", ""), "-")[0].try_cast("int")


def after_slash(x: Column | str) -> Column:
    return F.element_at(F.split(c(x), "/"), -1)


def work_id(x: Column | str) -> Column:
    return F.regexp_replace(c(x), "^/works/", "")


def wiki_url(title: Column | str, language: str = "en") -> Column:
    return F.concat(F.lit(f"https://{language}.wikipedia.org/wiki/"), F.replace(c(title), F.lit(" "), F.lit("_")))


def language_code(q: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), c(q))


def title_variants(x: Column | str) -> Column:
    """The title, and what stands before a colon, a dash or a spaced hyphen, without repeats."""
    cuts = [F.when(F.instr(c(x), s) > 0, pystrip(F.split_part(c(x), F.lit(s), F.lit(1)))) for s in (":", "—", " - ")]
    return F.array_distinct(F.array_compact(F.array(c(x), *cuts)))


def percent(n: Column, total: Column, digits: int = 1) -> Column:
    """Half-even per cent, 0 of nothing."""
    return F.when(total > 0, F.bround(n * 100.0 / total, digits)).otherwise(0.0)


def pick_isbn(edition: Column | str, found: Column | str, length: int) -> Column:
    return F.coalesce(F.get(c(edition), F.lit(0)), F.get(F.filter(c(found), lambda x: F.length(x) == length), F.lit(0)))


def citation_fixed(line: Column | str, pattern: str) -> Column:
    """Every match of the pattern becomes the first one's number as ``(p. N)``."""
    n = F.regexp_extract(c(line), pattern, 1)
    return pystrip(F.when(n != "", F.regexp_replace(c(line), F.lit(pattern), F.concat(F.lit("(p. "), n, F.lit(")")))).otherwise(c(line)))


def serialised(x: Column, kind: str) -> Column:
    """JSON for nested values, else a string."""
    return F.to_json(x) if kind.startswith(("struct", "array", "map")) else x.cast("string")
