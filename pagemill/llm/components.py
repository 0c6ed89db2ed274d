"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, salted_join, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of them: the larger ones (``large``), or the smaller ones and the node itself. Edges of a node with many are spread."""
    edges = _both_ways(edges) if large else edges
    least = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree")), "least")
    moved = salted_join(edges, least, "a", "degree", ["b"])
    if large:
        moved = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return written(moved.filter(F.col("a") > F.col("b")).distinct(), "edges", instead_of=least)


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for each node of ``links`` (a, b: long) that is not the least of its component.

    Links may repeat, run either way or join a node to itself. Each round is written to
    the shared folder; rounds grow with the logarithm of the largest component.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")).distinct(), "edges"
    )
    before = None
    while True:
        # every node points at one smaller node and no such node points on: these are stars
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        larger = _star(edges, True)
        discard(edges)
        edges = _star(larger, False)
        discard(larger)
