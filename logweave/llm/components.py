"""Connected components of a distributed edge list: alternating large-star and small-star joins.

Each round links every node to the least node near it; the edges never exceed their first number and never leave the
executors. A node with very many edges costs one row per task on its way to its least neighbour, and the join that hands
the least neighbour back splits hot nodes at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.session import materialize


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour (or itself) of each node; ``edges`` hold both directions or one."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component``: the least node reachable, for every node of ``edges(a, b)``; loops and repeats are allowed."""
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(current, label)
    state = _fingerprint(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: greater neighbours of a node move to its least neighbour.
        least = materialize(_least(both), label)
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), label)
        # Small star: a node and its smaller neighbours move to the least of them.
        least = materialize(_least(large), label)
        joined = large.join(least.hint("merge"), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        current = materialize(small.where("a <> b").distinct(), label)
        before, state = state, _fingerprint(current)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes: equal when a round changed nothing."""
    hashed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), hashed).first())
