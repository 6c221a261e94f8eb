"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import stash, unstash


def _mins(arrows: DataFrame, rows: int | None) -> DataFrame:
    """Smallest neighbour of each node, written down so that the join below may split a node with many links."""
    return stash(arrows.groupBy("u").agg(F.min("v").alias("m")), "cc-mins", rows)


def _flat(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none: trees of depth one."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node that has a link to another.

    Both rounds keep what is connected and make trees flatter; they end when all trees have depth one. Minima are combined
    before they are shuffled, rounds are written to the shared folder (and what a round was made of is deleted), and no
    list of neighbours is ever gathered. Links from a node to itself and repeated links are allowed, null ends are dropped.
    ``rows``: about how many links there are, if that is known.
    """
    known = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = stash(known.distinct(), "cc-links", rows)
    while not _flat(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _mins(both, rows)
        large = stash(both.join(lowest, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v"), "cc-large", rows)
        lower = _mins(large, rows)
        joined = large.join(lower, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        following = stash(small.where("u > v").distinct(), "cc-small", rows)
        unstash(edges, lowest, large, lower)
        edges = following
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
