"""Collocations, personal data and resampling against brute force, planted cases and awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from notelake.llm import collocations, pieces, pii, queries, resampling

from .test_llm import SF, awkward


def plain_pii(t):
    out = {k: [] for k in pii.BASE}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if 16 <= len(d) <= 19 and sum(v // 10 + v % 10 for v in doubled) % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@pytest.mark.parametrize("alphabet", ["01.", "0129 -", "+1 ().-5", "a@.-b", "a@.-b1 +é", "0123456789. -+@a()", "aé@.b", "aé@.bb-＠"])
def test_base_spans_are_brute_force(alphabet):
    r = random.Random(alphabet)
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        found = pii.find(t)
        assert {k: found[k] for k in pii.BASE} == plain_pii(t), t


def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_pii(texts[r["doc_id"]] or "")
        said = ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in base[k])
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [len(base[k]) for k in pii.BASE]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("mail josé.núñez@exämple.org now", "intl", "josé.núñez@exämple.org"),
        ("write to john.doe (at) example [dot] org.", "masked", "john.doe (at) example [dot] org"),
        ("see https://bob:pw@host.example.com/x, please", "url", "https://bob:pw@host.example.com/x"),
        ("at https://site.example.com/users/bob.", "url", "https://site.example.com/users/bob"),
        ("IBAN: DE89 3704 0044 0532 0130 00 and more", "iban", "DE89 3704 0044 0532 0130 00"),
        ("Account no. 12345-678 is closed", "account", "12345-678"),
        ("ssn 123-45-6789", "account", "123-45-6789"),
    ],
)
def test_added_spans(text, kind, value):
    assert [text[s:e] for s, e in pii.find(text)[kind]] == [value]
    assert value not in pii.redact(text)


@pytest.mark.parametrize("text", ["https://example.com/a/b?c=1", "IBAN DE89 3704 0044 0532 0130 01", "accountable for 12345 things", "x@y", "1.2.3", "card 4111 1111 1111 1112", "version 2.0 (at) noon", "compte 4111111111111111"])
def test_clean_texts(text):
    assert not any(v for k, v in pii.find(text).items() if k != "card")


def test_pii_awkward(spark):
    docs = awkward(spark)
    rows = pii.spans(docs).collect()
    assert len(rows) == docs.count() and {r["spans"] for r in rows} == {""} and {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.spans(docs.limit(0)).count() == 0
    zeros = "0" * 6000 + ".1.1.1 a@b.cc " + "1" * 10**6
    assert pii.find(zeros)["ip"] == [(0, 6006)] and pii.find(zeros)["email"] == [(6007, 6013)]
    cleaned = pii.redacted(spark.createDataFrame([(1, "call +1 (017) 555-7713 or a@b.cc", "x")], "a long, b string, c string").toDF("doc_id", "text", "TEXT"))
    assert cleaned.first()[1] == "call [PHONE] or [EMAIL]" and cleaned.columns == ["doc_id", "text", "TEXT"]


def plain_automaton(sequences, depth):
    """End positions by substring; classes of equal ones."""
    ends = collections.defaultdict(set)
    for n, s in enumerate(sequences):
        for i in range(len(s)):
            for m in range(1, min(depth, len(s) - i) + 1):
                ends[tuple(s[i : i + m])].add((n, i + m))
    classes = collections.defaultdict(list)
    for sub, at in ends.items():
        classes[frozenset(at)].append(sub)
    return {(max(c, key=len), min(map(len, c)), len(at)) for at, c in classes.items()}


@pytest.mark.parametrize("seed", range(20))
def test_automaton_states(seed):
    r = random.Random(seed)
    sequences = [[r.randrange(r.choice((2, 5))) for _ in range(r.randrange(1, 30))] for _ in range(r.randrange(1, 8))]
    flat = [w for s in sequences for w in s]
    reach = [min(4, len(s) - i) for s in sequences for i in range(len(s))]
    own = collocations.Automaton(np.array(flat), np.array(reach), 4)
    states = {(tuple(flat[first : first + longest]), shortest, n) for first, longest, shortest, n in own.states()}
    assert states == plain_automaton(sequences, 4)


def plain_collocations(rows, least, scale=2000000, percent=80, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f[lang].update(tuple(ws[i : i + m]) for m in range(1, 5) for i in range(len(ws) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, k = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p)):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_collocations_random(spark, seed, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 500)
    r = random.Random(seed)
    words = ["a", "B", "ß", "É", "d.e", "f", "g\x0bh", " "]
    rows = [(r.choice(["en", None, "und", "", "fr"]), r.choice([None, "", " \n\t "]) if r.random() < 0.1 else "".join(r.choice(words) + r.choice([" ", "  ", "\t", ", ", "\n", " "]) for _ in range(r.randrange(60)))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(x) for x in collocations.collocations(docs, least=5, top=40).collect())
    assert got == plain_collocations(rows, 5, top=40) and len(got) > 60


def test_collocations_awkward(spark):
    docs = awkward(spark)
    rows = [(r[docs.columns.index("lang")], r[docs.columns.index("text")]) for r in docs.collect()]
    assert sorted(tuple(x) for x in collocations.collocations(docs).collect()) == plain_collocations(rows, 30)
    assert collocations.collocations(docs.limit(0)).count() == 0


def plain_resample(docs, target, least=20, percent=10, seed=2024):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(zlib.crc32(w) % 10000 for w in find(text))
    for text in target:
        t.update(zlib.crc32(w) % 10000 for w in find(text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    rows = []
    for i, text in docs:
        b = [gain(zlib.crc32(w) % 10000) for w in find(text)]
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(b) // len(b) if b else 0
        rows.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    for n, r in enumerate(drawn[: len(drawn) * percent // 100], 1):
        r[4] = n
    return sorted(map(repr, map(tuple, rows)))


def test_resampling_hot_text_and_ties(spark):
    r = random.Random(3)
    hot = " ".join(r.choice("alpha beta gamma Ünder x1 Y2".split()) for _ in range(40))
    docs = [(i, hot) for i in range(400)] + [(i, " ".join(r.choice("alpha delta eps zeta-eta THETA".split()) for _ in range(r.randrange(60)))) for i in range(400, 900)] + [(None, hot)] * 30 + [(7, hot)] * 3 + [(901, None), (902, "")]
    aim = ["alpha delta delta", None, ""]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in aim], "text string"))
    assert sorted(repr(tuple(x)) for x in got.collect()) == plain_resample(docs, aim)


def test_resampling_awkward(spark):
    docs = awkward(spark)
    at = [docs.columns.index("doc_id"), docs.columns.index("text")]
    rows = [(r[at[0]], r[at[1]]) for r in docs.collect()]
    aim = docs.where("1 = 0")
    assert sorted(repr(tuple(x)) for x in resampling.resample(docs, aim, percent=50).collect()) == plain_resample(rows, [], percent=50)
    assert resampling.resample(docs.limit(0), docs).count() == 0


def test_runs_of_several_words():
    words = [b"a", b"bc", b"d"]
    whole = [b"a", b"bc", b"d", b"a bc", b"bc d", b"a bc d"]
    assert resampling.features(words, 1, 3, 1000).tolist() == [zlib.crc32(w) % 1000 for w in whole]
    assert resampling.features(words, 2, 2, 1000).tolist() == [zlib.crc32(w) % 1000 for w in whole[3:5]]
    assert not len(resampling.features([], 1, 2, 1000))


def test_marks_and_private_signs_come_back(spark):
    texts = ["▁", "\U0010fffe", "a▁b \U0010fffe▁\U0010ffff c", "\ue000 ▁▁ \ufffe", "\U0010fffe" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = pieces.encode(docs, seed=1)
    assert {r["doc_id"]: r["text"] for r in pieces.decode(coded).collect()} == dict(enumerate(texts))
    assert all(r["lossless"] for r in pieces.encode(docs, seed=1, digest=True).collect())


def test_the_smallest_id_stays_whatever_else_repeats(spark):
    cp = pytest.importorskip("corpus_pipeline")
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(1, 9)] + [(i, " ".join([*(f"v{j}" for j in range(200)), f"end{i}"])) for i in range(40, 60)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    kept = lambda more: sorted(r["doc_id"] for r in cp.drop_near_copies(spark, spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows + more], shape), SF).collect())
    assert kept([]) == [1, 40]
    # two unrelated texts share an id: what stays of the others is the same
    assert kept([(500, " ".join(f"x{j}" for j in range(50))), (500, " ".join(f"y{j}" for j in range(50)))]) == [1, 40, 500, 500]
