"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamet.llm.shared import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step, on edges (a > b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    leaves = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return leaves.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of any ordered type -> (node, label): label is the least node of the component.

    Nodes without an edge to another node do not appear.  Rounds run until no edge changes; their
    number grows with the logarithm of the longest path.  Each round is written to the shared folder.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        current = stored(_stars(current), "edges")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
