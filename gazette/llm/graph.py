"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b bigint); component is the smallest node that
    can be reached. Each step hands a node its smallest neighbour by a partial aggregation and a
    join that AQE can split, so a node with very many edges never meets one task whole. The edges
    are written to the shared folder after each round. Empty edges give an empty result."""
    pairs = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "low")
        # large star: every larger neighbour of n is tied to the smallest of n and its neighbours
        large = both.filter("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "large")
        # small star: n and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        tied = large.join(least, F.col("a") == F.col("n")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(tied.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        # a star forest: each node has one edge, and no centre has an edge of its own
        done = small.groupBy("a").count().filter("count > 1").isEmpty() and small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        pairs = small
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
