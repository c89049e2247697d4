"""Connected components of any number of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label): each linked node with the smallest node it reaches.

    A large star links each node's larger neighbours to its smallest one; a
    small star links its smaller neighbours and itself to the smallest of them.
    Both keep what is connected; the edges end up as stars around the labels,
    after about log2 of the longest path rounds.  Every round is one written
    table: no link is ever collected, and a lost executor costs tasks of one round.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    while not stars(edges):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        discard(large)
        discard(edges)
        edges = after
    roots = edges.select(b.alias("node"), b.alias("label")).distinct()
    return edges.select(a.alias("node"), b.alias("label")).unionByName(roots)


def stars(edges: DataFrame) -> bool:
    """Whether every node is a root or has one edge, to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()
