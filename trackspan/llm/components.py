"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..staging import stage


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star step.

    Every node sends its larger neighbours, then its smaller ones and itself, to the least node it knows. Minima are
    combined before the shuffle and joined back as one row per node, so a node with a third of all links is a skewed
    join that adaptive execution can split, never one collected list.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = (both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    large = stage(large, "large-star")
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    return (large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low).distinct())


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: the root is the least node that can be reached.

    Links may repeat, point either way or join a node to itself; null ends are ignored. Each round is a table in the
    shared folder, so its lineage ends there. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        edges = stage(_stars(edges), "stars")
        now = _mark(edges)
        if now == before:
            break
        before = now
    return (edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            .union(edges.select("b", F.col("b")).distinct()))
