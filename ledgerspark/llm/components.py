"""Connected components of a graph whose links may not fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def as_edges(links: DataFrame) -> DataFrame:
    """links (a, b) as (u, v) with u > v; links a = b and nulls go."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """One large-star and one small-star step (Kiveris et al. 2014): each node passes its smallest neighbour on.

    A step is a min per node, combined before the shuffle, and a join back, so a node with very many links is never
    gathered. Minima are written, so that both sides of each join are plain exchanges: the partition of a node with very many
    links can then be split by adaptive execution.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = scratch.keep(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def converge(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Contracts edges until they are stars: each node but the smallest of its component has one edge, to that."""
    seen = None
    while True:
        edges = scratch.keep(contract(edges, scratch))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(u, v) as decimal(20))"))).first()
        if now == seen or not now[0]:
            return edges
        seen = now


def labels(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge to a smaller one: the smallest it has one to."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
