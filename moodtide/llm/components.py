"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.llm.scratch import stored


def _state(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges, to see whether a round changed them."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def connected(edges: DataFrame, label: str) -> DataFrame:
    """Nodes of the edges (`a`, `b`) with the smallest node of their component, as `node` and `label`.

    Alternates two steps until nothing changes: all larger neighbours of a node
    are tied to its smallest neighbour, then all smaller ones.  The number of
    rounds grows with the logarithm of the longest chain.  The smallest
    neighbour comes from an aggregate that is combined before its shuffle, and
    goes back by a join that AQE can split, so the many links of a hub
    never meet in one task.  Each round is a written table.
    """
    ordered = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b")
    # Edges run from the larger node `a` to the smaller one `b`.
    now = stored(ordered.select("a", "b").distinct(), f"{label}-edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            now.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        least = both.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
        # Larger neighbours of each node, tied to the smallest.
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        # Smaller neighbours, and the node itself.
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            lowest.select("a", F.col("least").alias("b"))
        )
        now = stored(small.where("a <> b").distinct(), f"{label}-edges")
        before, state = state, _state(now)
        if state == before:
            break
    # Now every edge leads from a node to the smallest of its component.
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
