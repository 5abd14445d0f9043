"""Connected components by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dqengine.llm.common import cut, drop

#: Edges of one file of a table between two steps.
FILE_EDGES = 200_000


def apart(key: Column) -> Column:
    """The key, as an expression that Spark does not take for one that rows are already dealt by.

    A join on it has a shuffle of its own on either side, so that adaptive
    execution can split the rows of a hot key.
    """
    return F.bitwise_not(key)


def _kept(edges: DataFrame, files: int | None) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and digest, taken while they are written."""
    seen = Observation()
    table = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), files)
    return table, (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges (a, b) of any integers -> (node, root): the smallest node of each component.

    Every node of some edge appears once, roots included; no edges give no
    rows. Each step is one group-by with partial sums and one join of which
    Spark can split a hub's edges, so a node with a third of all edges is
    neither gathered in one task nor sent to the driver.
    """
    # a > b always: an edge points from the larger to the smaller node
    edges, seen = _kept(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(apart(F.col("a")).alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, apart(F.col("a")) == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.select(apart(F.col("a")).alias("u"), "m"), apart(F.col("a")) == F.col("u")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before = edges
        edges, now = _kept(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), -(-seen[0] // FILE_EDGES))
        drop(before)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
