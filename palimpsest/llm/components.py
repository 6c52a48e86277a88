"""Connected components of a table of links, by large and small stars in turn; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b), where root is the smallest node it can reach.

    Links may repeat and go either way; those with a null end or equal ends say nothing. Nodes without links are not
    in the result. A node with very many links is only ever summed up by min(), or joined, where Spark splits it.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _mark(edges)
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        edges = settled(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lower.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of the set of links; rounds end when it stays the same."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first()
    return tuple(row)
