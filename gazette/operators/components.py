"""Connected components of an edge table, by contraction: every round hooks each node to its least
neighbour, follows the hooks to their ends and contracts the edges. Rounds grow with the logarithm of the
longest chain; each is written to the shared folder, so plans stay short and lost executors cost one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.session import held


def _ends(hooks: DataFrame) -> DataFrame:
    """node and the end of its chain of hooks (node, to): hooks lead to lesser nodes, so chains end."""
    while True:
        further = hooks.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        hooks = held(hooks.join(further, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "hooks")
        if hooks.filter("moved").isEmpty():
            return hooks.select("node", "to")
        hooks = hooks.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """id and component (its least id) of all nodes of edges (a, b)."""
    edges = held(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = held(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct().withColumn("component", F.col("id")), "labels")
    while not edges.isEmpty():
        ends = held(_ends(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))), "ends")
        moved = ends.withColumnRenamed("node", "component")
        labels = held(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        to = lambda side: edges_at(ends, side)
        edges = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        edges = held(edges.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    return labels


def edges_at(ends: DataFrame, side: str) -> DataFrame:
    return ends.select(F.col("node").alias(side), F.col("to").alias(f"to_{side}"))
