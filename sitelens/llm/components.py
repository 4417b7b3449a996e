"""Connected components by repeated contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an undirected edge list; root is the smallest node reached.

    A round hooks every node to its smallest neighbour (an aggregate with
    partial minima, so a star's centre is no hot spot), follows the hooks one
    step further and puts what they lead to in place of each edge's ends.  Paths
    halve each round and stars collapse in one, so there are about log2 of the
    diameter rounds.  Rounds are written to the shared folder: lineage stays
    short and survives lost executors; all but the result are deleted.  Self loops
    and nulls are dropped; no edges give no rows.
    """
    left = materialise(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        hooked = materialise(_through(near, near), "hooks")
        steps.append(hooked)
        before = left
        ends = left.join(hooked.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(hooked.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = materialise(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a < b").distinct(), "edges")
        remove_table(before)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    remove_table(left)
    roots = steps[-1]
    if len(steps) == 1:
        return roots
    for hooked in reversed(steps[:-1]):
        roots = _through(hooked, roots)
    roots = materialise(roots, "roots")
    for hooked in steps:
        remove_table(hooked)
    return roots


def _through(first: DataFrame, then: DataFrame) -> DataFrame:
    """first's roots, replaced by then's where then knows them."""
    up = then.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return first.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
