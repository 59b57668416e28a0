"""Sharding by a hierarchical weighted hash tree (region, rack, shard), in DataFrame expressions only.

At each level every child draws a straw ``-ln(u) / weight`` from a hash of (row key, child's name) and the shortest
straw wins. A draw depends on that child alone, so a changed weight moves rows only into or out of the subtree that
changed. A shard that is added hangs off the root as a region of its own: rows then move into it and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns

BUCKETS = 64
HEX = 13  # hex digits of a draw: 52 bits fit a double


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, grown: int = 0, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """A tree of `shards` equal shards; each of `grown` more is a region of its own."""
    per_region = per_rack * racks
    tree = [Leaf(f"r{i // per_region}", f"r{i // per_region}k{i % per_region // per_rack}", i) for i in range(shards)]
    return tree + [Leaf(f"g{i}", f"g{i}k0", shards + i) for i in range(grown)]


def _level(node: Column, children: dict[str, dict[str, float]], key: Column) -> Column:
    """The child of a node with the shortest straw; ties go to the smaller name."""
    kids = F.create_map(*[x for n, c in children.items() for x in (F.lit(n), F.array(*[F.struct(F.lit(m).alias("name"), F.lit(float(w)).alias("weight")) for m, w in sorted(c.items())]))])

    def straw(child: Column) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), child["name"])), 1, HEX), 16, 10).cast("double")
        return F.struct((-F.ln((drawn + 0.5) / F.lit(float(16**HEX))) / child["weight"]).alias("straw"), child["name"].alias("name"))

    return F.array_min(F.transform(F.element_at(kids, node), straw))["name"]


def place(df: DataFrame, key: str, tree: list[Leaf], out: str) -> DataFrame:
    """df with the shard of its string column `key`; each level draws for the children of the chosen node only."""
    regions: dict[str, dict[str, float]] = {"": {}}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for x in tree:
        if x.weight > 0:
            regions[""][x.region] = regions[""].get(x.region, 0) + x.weight
            racks.setdefault(x.region, {})[x.rack] = racks.get(x.region, {}).get(x.rack, 0) + x.weight
            shards.setdefault(x.rack, {})[str(x.shard)] = x.weight
    if not regions[""]:
        raise ValueError("no shard has a weight above 0")
    node = F.lit("")
    for level in (regions, racks, shards):
        df = df.withColumn(f"{out}_node", _level(node, level, F.col(key)))
        node = F.col(f"{out}_node")
    return df.withColumn(out, node.cast("int")).drop(f"{out}_node")


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its size, checksum, shard, gapless slot within the shard and shard after growth by one.

    Law ``key``: id and shard count decide. A null id is a key of its own; a null text has size 16 and checksum 0;
    repeated rows each get a slot; an empty table gives an empty result. Slots follow (bucket, id, size, checksum):
    a first pass over the id column alone counts rows per (shard, bucket), so no shard is numbered in a single task.
    """
    small, grown = topology(shards), topology(shards, 1)
    docs = columns(docs, id_col, text_col)
    ids = F.col(id_col).alias("id")
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    bucket = (F.conv(F.substring(F.md5(F.concat(key, F.lit("/slot"))), 1, 2), 16, 10).cast("int") % BUCKETS).alias("bucket")
    text = F.col(text_col)
    placed = docs.select(
        ids,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).cast("long").alias("text_crc32"),
    )
    placed = place(place(placed.withColumn("key", key), "key", small, "shard"), "key", grown, "grown_shard").withColumn("bucket", bucket)
    counts = place(docs.select(ids).withColumn("key", key), "key", small, "shard").groupBy("shard", bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_first(), "size", "text_crc32")
    numbered = placed.withColumn("nth", F.row_number().over(within) - 1)
    # at most shards * BUCKETS rows: small whatever the input
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), "grown_shard"
    )


def oracle(shards: int = 40) -> str:
    """DuckDB SQL for assign() over documents."""

    def straws(tree: str) -> str:
        return f"""
        d_{tree} AS (SELECT DISTINCT k FROM keyed),
        reg_{tree} AS (SELECT k, arg_min(region, (straw, region)) AS region FROM (
            SELECT k, region, -ln((('0x' || substr(md5(k || '/' || region), 1, {HEX}))::BIGINT::DOUBLE + 0.5) / {16**HEX}::DOUBLE) / w AS straw
            FROM d_{tree}, (SELECT region, sum(weight) AS w FROM tree_{tree} GROUP BY region)) GROUP BY k),
        rack_{tree} AS (SELECT k, region, arg_min(rack, (straw, rack)) AS rack FROM (
            SELECT k, region, rack, -ln((('0x' || substr(md5(k || '/' || rack), 1, {HEX}))::BIGINT::DOUBLE + 0.5) / {16**HEX}::DOUBLE) / w AS straw
            FROM reg_{tree} JOIN (SELECT region, rack, sum(weight) AS w FROM tree_{tree} GROUP BY region, rack) USING (region)) GROUP BY k, region),
        leaf_{tree} AS (SELECT k, arg_min(shard, (straw, shard::VARCHAR)) AS shard FROM (
            SELECT k, shard, -ln((('0x' || substr(md5(k || '/' || shard), 1, {HEX}))::BIGINT::DOUBLE + 0.5) / {16**HEX}::DOUBLE) / weight AS straw
            FROM rack_{tree} JOIN tree_{tree} USING (region, rack)) GROUP BY k)"""

    def rows(tree: list[Leaf]) -> str:
        return ", ".join(f"('{x.region}', '{x.rack}', {x.shard}, {x.weight})" for x in tree)

    return f"""
    WITH RECURSIVE table_step AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
        UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM table_step WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY byte) AS tab FROM table_step WHERE k = 8),
    tree_a AS (SELECT * FROM (VALUES {rows(topology(shards))}) t(region, rack, shard, weight)),
    tree_b AS (SELECT * FROM (VALUES {rows(topology(shards, 1))}) t(region, rack, shard, weight)),
    keyed AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(strlen(text), 0) + 16 AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
    {straws("a")}, {straws("b")},
    summed AS (SELECT doc_id, k, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
        lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS text_crc32 FROM keyed, crc_table),
    placed AS (SELECT doc_id, size::BIGINT AS size, text_crc32, a.shard::INT AS shard, b.shard::INT AS grown_shard
        FROM summed JOIN leaf_a a USING (k) JOIN leaf_b b USING (k))
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard, row_number() OVER (PARTITION BY shard
        ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/slot'), 1, 2))::BIGINT % {BUCKETS}, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot FROM placed"""
