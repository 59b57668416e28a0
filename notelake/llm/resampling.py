"""Importance resampling towards a target distribution of hashed n-grams.

Equal texts are collapsed by grouping on the whole text; features are made and weighed once a text and counted as often as it
occurs. Weights go back to the documents by the text's SHA-256: texts that make up a thousandth of all rows or more, of which
there are a thousand at most, are sent round, so that no key of the remaining join is hot. Then each document adds Gumbel noise
of its own, and a range partition with one count a partition gives the ranks of the highest scores.

Defined results: null text - no features, weight 0, the noise alone; null doc_id - noise of the id `null`, before all ids among
ties; rows that repeat an id share its noise, ties of rows with equal id and score are in no fixed order; empty target - all gains
come from the smoothing; fewer words than `least` - no rank; extra columns do not matter; empty table - empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, columns, cut, raw

#: Bytes of words stay, A-Z become a-z, all other ASCII separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
HOT = 1000  # texts with at least one of so many parts of all rows: at most so many
PLACE = 33  # bits of the place in a partition, in monotonically_increasing_id


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def features(found: list[bytes], lo: int, hi: int, buckets: int) -> np.ndarray:
    """The bucket of every run of lo to hi words: CRC-32 of the words joined by a space, carried on from the run one shorter."""
    crc, out = list(map(zlib.crc32, found)), []
    spaced = [b" " + w for w in found] if hi > 1 else []
    for n in range(1, hi + 1):
        if n > 1:
            crc = list(map(zlib.crc32, spaced[n - 1 :], crc))
        if n >= lo:
            out.append(np.array(crc, np.uint32))
    return np.concatenate(out) % np.uint32(buckets)


def featured(rows: DataFrame, lo: int, hi: int, buckets: int) -> DataFrame:
    """(key, copies, n_words, features) of each different text of rows (text); features are buckets of two or four bytes."""
    kind = np.uint16 if buckets <= 2**16 else np.uint32

    def make(batches):
        for batch in batches:
            found = [words(t) for t in raw(batch.column(1))]
            packed = [features(w, lo, hi, buckets).astype(kind).tobytes() for w in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(len, found), pa.int64()), pa.array(packed, pa.binary())], names=["key", "copies", "n_words", "features"])

    texts = rows.groupBy("text").agg(F.count("*").alias("copies"))
    return bounded(texts.select(F.sha2("text", 256).alias("key"), "text", "copies")).mapInArrow(make, "key string, copies long, n_words long, features binary")


def counts(made: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows by bucket, each text as often as it occurs; `buckets` numbers come to the driver."""
    kind = np.uint16 if buckets <= 2**16 else np.uint32

    def add(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += copies * np.bincount(np.frombuffer(packed, kind), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in made.select("copies", "features").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of smoothed shares, floored, by bucket."""
    all_source, all_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with place, 1, 2, 3... by order (a total order), and total, the number of rows; no task holds more than its range."""
    at = F.monotonically_increasing_id()
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at))
    part = F.shiftright("at", PLACE)
    # one row a partition
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    upto, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    found = dealt.withColumn("part", part).join(F.broadcast(sizes), "part")
    return found.withColumn("place", F.col("before") + F.col("at").bitwiseAND(2**PLACE - 1) + 1).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, lo: int = 1, hi: int = 1, buckets: int = 10000, least: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank (of the drawn share of documents with at least `least` words, else null)."""
    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = cut(featured(own.select("text"), lo, hi, buckets))
    aim = featured(columns(target, "text").select(F.coalesce("text", F.lit("")).alias("text")), lo, hi, buckets)
    held = docs.sparkSession.sparkContext.broadcast(gains(counts(made, buckets), counts(aim, buckets)))
    width = 2 if buckets <= 2**16 else 4

    @F.arrow_udf("long")
    def weigh(packed: pa.Array) -> pa.Array:
        found = [np.frombuffer(p, f"u{width}") for p in packed.to_pylist()]
        return pa.array([int(held.value[x].sum()) // len(x) if len(x) else 0 for x in found], pa.int64())

    weights = made.select("key", "copies", "n_words", (F.length("features") / width).cast("long").alias("n_features"), weigh("features").alias("weight"))
    total = made.agg(F.sum("copies")).first()[0] or 0
    keyed = cut(own.select("doc_id", F.sha2("text", 256).alias("key")))
    hot = F.broadcast(weights.where(F.col("copies") * HOT >= total))
    rest = weights.where(F.col("copies") * HOT < total)
    # a hash join: a sort would bring nothing, and the larger side is dealt in parts where a key is frequent
    back = keyed.join(hot, "key").unionByName(keyed.join(hot.select("key"), "key", "left_anti").join(rest, "key"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut(back.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row")))
    drawn = ranked(scored.where(F.col("n_words") >= least), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row"))
    rank = F.when(F.col("place") <= F.floor(F.col("total") * percent / 100), F.col("place"))
    short = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", rank).unionByName(short, allowMissingColumns=True).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL of resample() with its defaults, over documents and benchmark.
ORACLE = r"""
WITH RECURSIVE table_step AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM table_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS tab FROM table_step WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
occurring AS (SELECT r, unnest(ws) AS w FROM docs),
known AS (SELECT w, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM (SELECT w FROM occurring UNION SELECT w FROM aims)),
named AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT % 10000 AS bucket FROM known, crc_table),
s AS (SELECT bucket, count(*) AS n FROM occurring JOIN named USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aims JOIN named USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM occurring JOIN named USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM docs LEFT JOIN weighed USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= total * 10 // 100 THEN place END AS rank FROM placed"""
