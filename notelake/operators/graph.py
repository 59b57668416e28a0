"""Author graph: nodes, edges and hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def author_graph(author: int, authors: DataFrame, books: DataFrame, book_authors: DataFrame, influences: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an author's books and, from depth 1 on, one hop of influence; empty without the author."""
    centre = authors.where(F.col("author_id") == author)
    own = book_authors.where(F.col("author_id") == author).join(centre.select("author_id"), "author_id", "left_semi")
    nodes = centre.select(F.concat(F.lit("author:"), "author_id").alias("id"), F.col("name").alias("label"), F.lit("author").alias("kind"))
    titles = books.join(own.select("book_id"), "book_id", "left_semi")
    nodes = nodes.unionByName(titles.select(F.concat(F.lit("book:"), "book_id").alias("id"), F.col("title").alias("label"), F.lit("book").alias("kind")))
    edges = own.select(F.concat(F.lit("author:"), "author_id").alias("source"), F.concat(F.lit("book:"), "book_id").alias("target"), F.lit("authored").alias("kind"))
    if depth >= 1:
        near = influences.where((F.col("src") == author) | (F.col("dst") == author))
        ids = near.select(F.explode(F.array("src", "dst")).alias("author_id")).distinct()
        nodes = nodes.unionByName(authors.join(ids, "author_id", "left_semi").select(F.concat(F.lit("author:"), "author_id").alias("id"), F.col("name").alias("label"), F.lit("author").alias("kind"))).dropDuplicates(["id"])
        edges = edges.unionByName(near.select(F.concat(F.lit("author:"), "src").alias("source"), F.concat(F.lit("author:"), "dst").alias("target"), F.lit("influenced").alias("kind")))
    return nodes, edges


def reach(influences: DataFrame, start: int, hops: int) -> DataFrame:
    """(node, hop): who is reached from start, at which least number of hops, start included at 0.

    A hop joins its frontier alone, drops who was reached before, and is written, so neither plans nor frontiers grow with the hops
    that came before; cycles end where nobody is new. Null ends are no edges.
    """
    edges = influences.select(F.col("src").cast("long").alias("node"), F.col("dst").cast("long").alias("next")).where("node is not null and next is not null")
    found = front = influences.sparkSession.createDataFrame([(start, 0)], "node long, hop int")
    for hop in range(1, hops + 1):
        new = front.join(edges, "node").select(F.col("next").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        front = cut(new.withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found
