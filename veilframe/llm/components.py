"""Connected components of a graph given as edges, by alternating large and small stars.

Each round is two joins on edges and a written table, which takes the place of the one before; the number of rounds grows with the
logarithm of the longest path, and nothing but two numbers a round comes to the driver.

Defined cases: loops, repeated edges and both directions may occur; edges with a null at an end join nothing and are left out; no
edges give no rows; the two columns may have any names, and there are no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import Rolling


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, root): every vertex with an edge to another, except roots, and the least vertex it is connected to.

    edges: two columns of one ordered type; loops, repeats and both directions may occur.
    """
    a, b = edges.columns
    table, seen = Rolling(edges.sparkSession), None
    held = table.put(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        held = table.put(_small_star(_large_star(held)), "edges")
        now = tuple(held.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == seen:
            return held.select("a", F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"no stable components after {rounds} rounds")
