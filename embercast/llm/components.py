"""Connected components of links, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embercast.llm.arrays import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def _star(pairs: DataFrame, larger: DataFrame) -> DataFrame:
    """Link to the least neighbour (or u itself): each v of ``larger`` (u, v) and, where u isn't least, u."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return larger.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): the smallest node that is reachable, for every node with a link.

    ``links`` has two long columns. Self-links and null ends are ignored, so
    nodes without another link don't appear. Each round keeps one edge set in
    the shared folder; no group of neighbours is ever gathered in one place.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, both.where("v > u").unionByName(edges.select(F.col("a").alias("u"), F.col("a").alias("v"))))
        large = written(large, "large-star")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(down, down.unionByName(large.select(F.col("a").alias("u"), F.col("a").alias("v"))))
        edges = written(small, "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
