"""Cycles of a wait-for graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, scratch


def cycles(waits: DataFrame, hops: int = 64) -> DataFrame:
    """Of waits (a, b: a waits for b) each node on a cycle of at most `hops` (a power of two) hops: (waiter, hops of its shortest).

    The tables double their reach: `near` has the least number of hops, up to k, from one node to
    another, `ends` the nodes exactly k hops away, so six rounds do for 64 hops. A shortest way of
    k + n hops goes through an end k hops away, from which n are the least. The last round asks for
    ways back to the start alone. All is joined and shuffled; no recursion limits the rows.
    """
    if hops < 1 or hops & (hops - 1):
        raise ValueError("hops is a power of two")
    with scratch(waits.sparkSession, ("waits-found",)):
        edges = _pruned(cut(waits.select("a", "b").filter("a is not null and b is not null").distinct(), "waits-edges"), hops)
        ends = edges.select(F.col("a").alias("s"), F.col("b").alias("x"))
        near, k = ends.withColumn("n", F.lit(1)), 1
        found = near.filter("s = x").select("s", "n")
        while k < hops:
            on = near.select(F.col("s").alias("x"), F.col("x").alias("y"), (F.col("n") + k).alias("n"))
            found = found.union(ends.join(on.filter(F.col("n") > k), "x").filter("s = y").select("s", "n"))
            k *= 2
            if k < hops:
                further = ends.join(on, "x").select("s", F.col("y").alias("x"), "n")
                near = cut(near.union(further).groupBy("s", "x").agg(F.min("n").alias("n")), "waits-near")
                on = ends.select(F.col("s").alias("x"), F.col("x").alias("y"))
                ends = cut(ends.join(on, "x").select("s", F.col("y").alias("x")).distinct(), "waits-ends")
        return cut(found.groupBy(F.col("s").alias("waiter")).agg(F.min("n").alias("hops")), "waits-found")


def _pruned(edges: DataFrame, rounds: int) -> DataFrame:
    """edges without some that lie on no cycle: as long as a round takes a tenth of them, those from nodes that nobody waits for and to nodes that wait for nobody go."""
    n = edges.count()
    for _ in range(rounds):
        awaited = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        left = cut(awaited.join(awaited.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "waits-edges")
        before, n, edges = n, left.count(), left
        if 10 * (before - n) < before:
            break
    return edges
