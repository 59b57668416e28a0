"""Mixing sources to target weights, in DataFrame expressions only.

Sizes are summed per source with partial aggregation, targets are found by water filling on the per-source table, and
each document is emitted floor(rate) times plus one Bernoulli copy whose chance is the rate's fraction. The Bernoulli
seed is chosen per source among SEEDS rotations of one hash, by the smallest distance of the source's words from its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, cut, restored, word_count

SEEDS = 64
SPAN = 2**32


def _draw() -> Column:
    """32-bit draw of a document."""
    key = F.concat(F.lit("mix/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Per source: source_size, target, rate. sizes: (source, size) with any number of rows a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (nth + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * most)
    # sources reach their caps in order of cap / weight: the level is set by those before which it stays below that ratio
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0))).withColumn("used", F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    total = F.sum("source_size").over(whole) * F.lit(share)
    per = per.withColumn("level", (total - F.col("capped")) / (F.sum("weight").over(whole) - F.col("used")))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    per = per.withColumn("final", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap").cast("double")))
    per = per.select("source", "source_size", target.alias("target"))
    return per.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, carry: bool = False) -> DataFrame:
    """Every row of docs with doc_id, source, size, source_size, target and copies (times the mix takes it), and rest if it is to be carried.

    A null text has size 0; null is a source of its own, the last; rows that repeat a doc_id share one draw; a source
    without words gets target 0 and no copies; an empty table gives an empty result.
    """
    own = columns(docs, "doc_id", "source", "text", carry=carry).withColumn("size", word_count(F.col("text"))).drop("text")
    narrow = cut(own.select("doc_id", "source", "size"))
    sized = own if carry else narrow.withColumn("rest", F.lit(None))
    plan = targets(narrow, weights, share, most).withColumnRenamed("source", "of")
    plan = cut(plan.withColumn("whole", F.floor("rate")).withColumn("limit", F.floor((F.col("rate") - F.floor("rate")) * SPAN).cast("long")))
    drawn = narrow.where("size > 0").withColumn("draw", _draw()).join(plan, F.col("source").eqNullSafe(F.col("of"))).select("of", "draw", "size", "limit", "whole", "target")
    taken = lambda seed: F.when((F.col("draw") + F.lit(seed * (SPAN // SEEDS))) % SPAN < F.col("limit"), F.col("size")).otherwise(0)
    sums = drawn.groupBy("of").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("base"), *[F.sum(taken(s)).alias(f"s{s}") for s in range(SEEDS)])
    off = [F.struct(F.abs(F.col("base") + F.col(f"s{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)]
    seeds = sums.select(F.col("of").alias("found"), F.array_min(F.array(*off))["seed"].alias("seed"))
    plan = cut(plan.join(seeds, F.col("of").eqNullSafe(F.col("found")), "left").select("of", "source_size", "target", "whole", "limit", F.coalesce("seed", F.lit(0)).alias("seed")))
    rows = sized.withColumn("draw", _draw()).join(plan, F.col("source").eqNullSafe(F.col("of")))
    hit = (F.col("draw") + F.col("seed").cast("long") * F.lit(SPAN // SEEDS)) % SPAN < F.col("limit")
    copies = (F.col("whole") + F.when(hit, 1).otherwise(0)).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "rest")


def emit(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mixed documents, with the columns of docs: each row as often as the mix takes it."""
    mixed = mix_counts(docs, weights, share, most, carry=True)
    return restored(mixed.select(F.explode(F.array_repeat("rest", F.col("copies"))).alias("rest")), docs)


ORACLE = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS draw FROM documents),
    per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT source, source_size, 2 * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM per),
    run AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS used,
        sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM weighed
        WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    levels AS (SELECT *, (total - capped) / (all_weight - used) AS level FROM run),
    final AS (SELECT level AS final FROM levels WHERE level <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
    plan AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT final FROM final), cap::DOUBLE)) AS target FROM levels),
    rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM plan),
    cutoffs AS (SELECT *, floor(rate)::BIGINT AS whole, floor((rate - floor(rate)) * {SPAN})::BIGINT AS lim FROM rated),
    tried AS (SELECT p.source, seed, abs(sum(whole * size) + sum(CASE WHEN (draw + seed * {SPAN // SEEDS}) % {SPAN} < lim THEN size ELSE 0 END) - any_value(target)) AS off
        FROM sized s JOIN cutoffs p ON s.source IS NOT DISTINCT FROM p.source, range({SEEDS}) t(seed) GROUP BY p.source, seed),
    chosen AS (SELECT source, arg_min(seed, (off, seed)) AS seed FROM tried GROUP BY source)
SELECT s.doc_id, s.size, p.source_size, p.target, (s.size * (whole + CASE WHEN (draw + seed * {SPAN // SEEDS}) % {SPAN} < lim THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN cutoffs p ON s.source IS NOT DISTINCT FROM p.source JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source
"""
