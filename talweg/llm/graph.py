"""Connected components as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm._shared import apart, discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node that it is connected with.

    Large-star and small-star steps by turns, until no edge changes; a step is one aggregation and one join, whatever a node's
    degree, and the edges after each round are written to the shared folder. Loops and repeated edges change nothing.
    """

    def ordered(x: DataFrame) -> DataFrame:
        return x.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    now = stored(ordered(edges), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour b of a goes to the least of a and its neighbours
        large = both.filter("b > a").join(apart(least), "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: a's smaller neighbours, and a, go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(apart(low), "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("v")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        before, now = now, stored(ordered(small), "edges")
        discard(before)
        last, seen = seen, mark(now)
        if seen == last:
            break
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
