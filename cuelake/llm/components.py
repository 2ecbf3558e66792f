"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, join_facts, shared_table


def components(edges: DataFrame, most: int = 60, hot: int = 20_000) -> DataFrame:
    """Of edges (a, b) of longs: node and root, the least node of its component. Nodes without an edge are not listed.

    Each round is two joins on the nodes with their least neighbour, written to the shared folder; rounds are about the
    logarithm of the longest path. A node with more than `hot` neighbours gets its least one by broadcast, so no task has all edges
    of a star. Edges point to ever smaller nodes and never grow in number. Loops are dropped.
    """
    with Scratch(edges.sparkSession) as scratch:
        now = shared_table(_ordered(edges), "star")
        state = _state(now)
        for _ in range(most):
            # large star: each neighbour above a node goes to that node's least neighbour
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = shared_table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
            joined = join_facts(both.where("b > a"), least, ["a"], "n", 2 * state[0], hot)
            now = shared_table(_ordered(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))), "star")
            # small star: a node's smaller neighbours, and itself, go to the least of them
            least = shared_table(now.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
            joined = join_facts(now, least, ["a"], "n", state[0], hot)
            now = shared_table(_ordered(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))), "star")
            last, state = state, _state(now)
            if state == last:
                scratch.keep(now)
                return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        raise RuntimeError(f"components did not settle in {most} rounds")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
