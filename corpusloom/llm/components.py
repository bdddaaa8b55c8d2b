"""Connected components of an edge table: alternating large-star and small-star rounds, each written to the shared folder.

No link or component reaches the driver; it sees a count and a checksum per round. A node with very many links is pre-aggregated
before the shuffle (min) and its least is written, so that either side of the join has an exchange of its own and Spark can split its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges after the step, and the table of each node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges have a > b. The edges after the step, and the table of each node's least neighbour."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "least")
    moved = edges.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))), least


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the component's least node) for every node that is not its own root. edges: a, b of one comparable type."""
    first = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # Once ahead of the rounds: links of a group that come from many places mostly fall together here, before the larger step doubles them.
    small, least = _small_star(first)
    now, before = written(small.distinct(), "edges"), None
    drop(first, least)
    for _ in range(most_rounds):
        large, least = _large_star(now)
        small, also = _small_star(large.distinct())
        new = written(small.distinct(), "edges")
        drop(now, least, also)
        now = new
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
