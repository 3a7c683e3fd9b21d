"""Connected components by alternating stars over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: greater neighbours move to the least of the neighbourhood.
    Small star: the node and its lesser neighbours do."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    least = least.select("n", F.least("n", "m").alias("m"))
    met = both.join(least, F.col("a") == F.col("n"))
    if large:
        moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.where(F.col("n") != F.col("m")).select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least
    node of the component. Repeated edges and loops are allowed.

    Edges are written to the shared folder after each round; rounds grow with
    the logarithm of the size. Stars are summed before shuffling, and the
    joins split hot nodes when adaptive execution is on.
    """
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    current, before = staged(current, "edges"), None
    while True:
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen.n, seen.s) == before or not seen.n:
            break
        before = (seen.n, seen.s)
        current = staged(_star(_star(current, True), False), "edges")
    tops = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        tops.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
