"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits and cues of identifiers. A parser expands each anchor to
the left and right and validates what it found. Whatever the length of a text, each of its characters is expanded over at most a few
times: an address ends where the one before it ends, and a run of digits and their separators is parsed once, at its first digit.

Base kinds are exactly the leftmost, non-overlapping matches of their patterns, less those that fail their test: email; ip, parts of
at most 255; card, 16 to 19 digits that pass Luhn's test; phone, 8 to 15 digits. The other kinds are what patterns alone miss, and
never replace a base span: account (a cue such as "account no." and an identifier of 5 digits or more that no base span touches),
iban (a cue, a number that passes the mod-97 test), intl (an address with letters beyond ASCII, of which the pattern sees a part or
nothing), masked ("name (at) host (dot) org"), url (an address that names a person's account, by user info, path or query).

Defined results: null and empty text - no spans; ids do not matter, so rows that are null, repeated or tied there are read alike;
texts of any length are read whole; offsets are code points, ends exclusive; a start is read once, by the first cue that fits;
extra columns do not matter; empty table - empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns, restored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "iban", "intl", "masked", "url")
#: The base patterns; the part of an address after its at-sign is DOMAIN.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
#: Numbers joined by dots, read from the left in fours: a search for IP would try a run of digits from each of them.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: All that a number of any kind is made of, after its first digit.
CLUSTER = re.compile(r"[\x20().0-9-]+")
MASKED = re.compile(r"\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[{](?:dot|DOT|Dot)[)\]}]\s?)[A-Za-z0-9-]+)+")
URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
PLACE = re.compile(r"(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#@:\[\]]+)(?::([0-9]{1,5}))?(?=[/?#]|$)")
OWNED = re.compile(r"/[~@][\w.-]+|/(?:users?|u|profiles?|people|members?|accounts?|in)/[\w.-]+|[?&](?:e?mail|user(?:name|_?id)?|uid|account|phone)=[^&#]+", re.I)
IBAN = re.compile(r"[\s:#.-]{0,3}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:\s?(?:number|no|nr|num|id|code)\b\.?)?\s?(?:is\s|[:#=]\s?)?([A-Z]{0,3}-?[0-9](?:[\x20-]?[0-9]){4,18}[A-Z]?)(?![A-Za-z0-9])", re.I)
CUES = ("account", "acct", "konto", "cuenta", "compte", "passport", "passeport", "pasaporte", "reisepass", "social security", "ssn", "tax id", "customer", "patient", "policy")
#: Latin, Greek and Cyrillic letters belong to a local part; letters of scripts without spaces do not, words would run into it.
LETTERS_TO = "԰"


@functools.cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in "@＠":
        found.add_word(word, (at_sign, 1))
    for digit in "0123456789":
        found.add_word(digit, (number, 1))
    found.add_word("://", (scheme, 3))
    for word in ("(at)", "[at]", "{at}"):
        for cased in (word, word.upper()):
            found.add_word(cased, (masked, len(word)))
    for cue, parse in (*((c, account) for c in CUES), ("iban", iban)):
        for cased in (cue, cue.upper(), cue.capitalize()):
            found.add_word(cased, (parse, len(cue)))
    found.make_automaton()
    return found


class Spans:
    """What is found in one text, by kind, and how far its parsers have read."""

    def __init__(self):
        self.of = {k: [] for k in KINDS}
        self.addressed = self.widened = self.numbered = 0

    def add(self, kind: str, start: int, end: int) -> None:
        if not self.of[kind] or self.of[kind][-1][1] <= start:
            self.of[kind].append((start, end))


def luhn(digits: str) -> bool:
    own = [int(d) for d in digits[::-1]]
    return (sum(own[::2]) + sum(d * 2 - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def real_host(host: str) -> bool:
    """Labels of 1 to 63 characters without a hyphen at either end, the last of two letters or more."""
    labels = host.split(".")
    return len(labels) > 1 and len(labels[-1]) > 1 and labels[-1].isalpha() and all(0 < len(x) < 64 and x[0] != "-" != x[-1] for x in labels)


def at_sign(text: str, at: int, end: int, found: Spans) -> None:
    start = at
    while start > found.addressed and text[start - 1] in LOCAL:
        start -= 1
    base = DOMAIN.match(text, end) if start < at and text[at] == "@" else None
    if base:
        found.add("email", start, base.end())
        found.addressed = base.end()
    # the same with letters beyond ASCII
    wide = max(start, min(at, found.widened))
    while wide > found.widened and (text[wide - 1] in LOCAL or "\x80" <= text[wide - 1] < LETTERS_TO and text[wide - 1].isalpha()):
        wide -= 1
    while wide < at and text[wide] in ".-":
        wide += 1
    stop = end
    while stop < len(text) and (text[stop].isalnum() or text[stop] in ".-") and text[stop] < LETTERS_TO:
        stop += 1
    host = text[end:stop].rstrip(".-")
    stop = end + len(host)
    local = text[wide:at]
    if local and not text[wide:stop].isascii() and local[-1] != "." and ".." not in local and real_host(host):
        found.add("intl", wide, stop)
        found.widened = stop


def number(text: str, at: int, end: int, found: Spans) -> None:
    if at < found.numbered:
        return
    start = at - 1 if at and text[at - 1] == "+" else at
    found.numbered = stop = CLUSTER.match(text, at).end()
    if stop - start < 7:
        return
    for m in DOTTED.finditer(text, start, stop):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            size = sum(map(len, own)) + 3
            if all(len(p) < 4 and int(p or 0) < 256 for p in (x.lstrip("0") for x in own)):
                found.of["ip"].append((at, at + size))
            at += size + 1
    for m in CARD.finditer(text, start, stop):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.of["card"].append(m.span())
    for m in PHONE.finditer(text, start, stop):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            found.of["phone"].append(m.span())


def masked(text: str, at: int, end: int, found: Spans) -> None:
    stop = at - 1 if at and text[at - 1] == " " else at
    start, least = stop, found.of["masked"][-1][1] if found.of["masked"] else 0
    while start > least and text[start - 1] in LOCAL:
        start -= 1
    m = MASKED.match(text, end)
    if start < stop and m and re.search(r"[A-Za-z]{2,}$", m.group()):
        found.add("masked", start, m.end())


def scheme(text: str, at: int, end: int, found: Spans) -> None:
    start = at
    while start > max(0, at - 12) and text[start - 1].isalpha() and text[start - 1].isascii():
        start -= 1
    run = URL.match(text, end)
    if start == at or not run:
        return
    address = run.group().rstrip(".,;:!?)]*_")
    m = PLACE.match(address)
    if m and (m[2][0] == "[" or real_host(m[2]) or IP.fullmatch(m[2])) and int(m[3] or 0) < 65536 and (m[1] or OWNED.search(address, m.end())):
        found.add("url", start, end + len(address))


def iban(text: str, at: int, end: int, found: Spans) -> None:
    m = IBAN.match(text, end) if not at or not text[at - 1].isalnum() else None
    if m:
        # the longest part up to the end of a group that passes
        for stop in [m.end(1), *(i for i in range(m.end(1) - 1, m.start(1), -1) if text[i] == " ")]:
            own = text[m.start(1) : stop].replace(" ", "").upper()
            if len(own) >= 15 and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1:
                found.add("iban", m.start(1), stop)
                break


def account(text: str, at: int, end: int, found: Spans) -> None:
    m = ACCOUNT.match(text, end) if not at or not text[at - 1].isalnum() else None
    if m:
        found.add("account", *m.span(1))


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """(start, end) by kind, in order."""
    found = Spans()
    if text:
        for last, (parse, length) in anchors().iter(text):
            parse(text, last + 1 - length, last + 1, found)
        base = [s for k in BASE for s in found.of[k]]
        found.of["account"] = [(s, e) for s, e in found.of["account"] if not any(s < b and a < e for a, b in base)] if found.of["account"] else []
    return found.of


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256 and spans of every row; a span is kind:start:end."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                of = find(text)
                named = [[f"{k}:{s}:{e}" for s, e in of[k]] for k in KINDS]
                base = ",".join(x for k in named[: len(BASE)] for x in k)
                out.append((*map(len, named[: len(BASE)]), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for k in named for x in k)))
            cols = list(zip(*out, strict=True)) or [()] * (len(BASE) + 2)
            kinds = [pa.int64()] * len(BASE) + [pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded(own).mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; where spans of kinds meet, one span of the first kind listed."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t) for t in texts.to_pylist()], pa.string())

    return restored(columns(bounded(docs), "text", carry=True).withColumn("clean", clean("text")), docs, text=F.col("clean"))


def redact(text: str | None) -> str | None:
    if not text:
        return text
    own, out, done = sorted((s, e, i) for i, k in enumerate(KINDS) for s, e in find(text)[k]), [], 0
    merged: list[list[int]] = []
    for s, e, i in own:
        if merged and s < merged[-1][1]:
            merged[-1][1:] = [max(e, merged[-1][1]), min(i, merged[-1][2])]
        else:
            merged.append([s, e, i])
    for s, e, i in merged:
        out += [text[done:s], f"[{KINDS[i].upper()}]"]
        done = e
    return "".join(out) + text[done:]
