"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from capital_access.session import settle


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    found = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first()
    return tuple(found)


def _lowest(pairs: DataFrame) -> DataFrame:
    """Per node the least of itself and its neighbours; settled, so that a join with it can split hub nodes."""
    return settle(pairs.groupBy("node").agg(F.min("root").alias("low"))
                  .select("node", F.least("node", "low").alias("low")), "lowest")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): every node of an edge with the least node it can reach.

    Alternating large and small stars: a large star links the greater neighbours
    of a node to its least neighbour, a small star does so with the lesser ones,
    until every edge leads to the root of its component. The number of rounds
    grows with the logarithm of the longest path. Each round is written to the
    shared folder, so it starts from files; per-node least values are reduced
    before their shuffle, and hubs are split by adaptive execution.

    Loops and repeated edges do not matter; edges with a missing end are left
    out; an empty table gives an empty result.
    """
    edges = settle(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        large = settle(
            both.where("root > node").join(_lowest(both), "node")
            .select(F.col("root").alias("node"), F.col("low").alias("root")).where("node != root").distinct(), "large")
        low = _lowest(large)
        edges = settle(
            large.join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root")).where("node != root")
            .unionByName(low.select("node", F.col("low").alias("root"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.unionByName(edges.select(F.col("root").alias("node"), "root").distinct())
