"""Connected components of pixel masks: runs of pixels joined where they touch, by large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filamet.session import cut_lineage

_SHIFT = 1 << 31
#: columns of a tile in which runs of neighbouring rows meet
TILE = 32


def pixel_runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels with ``u``, the id (row * 2**31 + col) of the first pixel of their run in the row, and its last column."""
    keys = list(keys)
    line = Window.partitionBy(*keys, "row").orderBy("col")
    fresh = F.when(F.lag("col").over(line) == F.col("col") - 1, F.lit(None)).otherwise(F.col("col"))
    runs = mask.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).withColumn("_new", fresh)
    start = F.last("_new", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.withColumn("_c0", start).withColumn("u", F.col("row") * _SHIFT + F.col("_c0")).drop("_new")


def run_edges(runs: DataFrame, keys: Sequence[str], *, eight: bool = False) -> DataFrame:
    """Pairs (``u``, ``v``) of runs in neighbouring rows that touch, also across corners if ``eight``.

    ``runs`` has a row per run: ``row``, ``_c0``, ``_c1`` and ``u``.  Runs meet in the tiles they span,
    and a pair is taken in the tile where its overlap begins: a solid area has one edge per row.
    """
    keys, reach = list(keys), 1 if eight else 0
    lo, hi = F.col("_c0") - reach, F.col("_c1") + reach
    tiles = lambda a, b: F.explode(F.sequence(F.floor(a / TILE), F.floor(b / TILE)))
    upper = runs.select(*keys, (F.col("row") + 1).alias("row"), lo.alias("a0"), hi.alias("a1"), "u", tiles(lo, hi).alias("_t"))
    lower = runs.select(*keys, "row", F.col("_c0").alias("b0"), F.col("_c1").alias("b1"), F.col("u").alias("v"), tiles(F.col("_c0"), F.col("_c1")).alias("_t"))
    met = upper.join(lower, [*keys, "row", "_t"]).where((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")))
    return met.where(F.floor(F.greatest("a0", "b0") / TILE) == F.col("_t")).select(*keys, "u", "v")


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*keys, "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    down = edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    leaves = down.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select(*keys, "u", F.col("m").alias("v"))
    return leaves.unionByName(own).where(F.col("u") != F.col("v")).distinct()


def connected_components(mask: DataFrame, keys: Sequence[str], *, eight: bool = False) -> DataFrame:
    """Add ``component``: the smallest pixel id (row * 2**31 + col) of the component.

    Edges join runs of pixels, not pixels.  Rounds run until no edge changes.  Their number grows with the logarithm of the longest path, not
    with the path; every round works on edges spread over the cluster and is checkpointed.
    """
    keys = list(keys)
    pixels = pixel_runs(mask, keys)
    runs = pixels.groupBy(*keys, "row", "u", "_c0").agg(F.max("col").alias("_c1"))
    edges = cut_lineage(run_edges(runs, keys, eight=eight))
    before = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges, keys), keys))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = pixels.select(*keys, "row", "col", "u").join(edges.select(*keys, "u", F.col("v").alias("component")), [*keys, "u"], "left")
    return found.select(*keys, "row", "col", F.coalesce("component", "u").alias("component"))


def drop_small(labels: DataFrame, keys: Sequence[str], min_area: int) -> DataFrame:
    """Keep components with at least ``min_area`` pixels."""
    keys = [*keys, "component"]
    big = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_area).drop("_n")
    return labels.join(big, keys)
