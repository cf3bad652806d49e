"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialise


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs to (node, root): root is the least node reachable; isolated nodes are not listed.

    Each round points every node at the least of its neighbours, first on the
    larger and then on the smaller side, until a round changes nothing; the
    number of rounds grows with the logarithm of the longest path. Every round
    is a table of its own, so that a lost executor costs one round; the table
    before it is deleted. Nulls and loops are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a != b").distinct()
    e = materialise(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(e)
        e, mark, old = after, _mark(after), mark
        if mark == old:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
