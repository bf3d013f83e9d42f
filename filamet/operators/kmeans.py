"""One-dimensional k-means on log medians, number of clusters by BIC."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet.operators.quantiles import exact_quantiles
from filamet.session import cut_lineage


def _nearest(x: Column, centers: list[float]) -> Column:
    """Index of the nearest centre, the lower index on a tie."""
    best = F.array_min(F.array(*[F.struct(F.abs(x - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)]))
    return best["i"]


def cluster_log_medians(medians: DataFrame, x: str, *, k: int | None = None, max_k: int = 4, max_iter: int = 100) -> DataFrame:
    """Add ``group`` (0 = thinnest) to fiber medians.

    The data stays distributed; one aggregate per Lloyd step returns at most ten sums for all
    candidate k together, and at most ten centres live on the driver.
    """
    data = cut_lineage(medians.where(F.col(x) > 0).withColumn("_v", F.log(F.col(x))))
    n = data.count()
    if n == 0:
        return data.drop("_v").withColumn("group", F.lit(None).cast("int"))
    top = min(max_k, n)
    ks = [max(1, min(k, top))] if k is not None else list(range(1, top + 1))
    probs = sorted({i / (kk + 1) for kk in ks for i in range(1, kk + 1)})
    row = exact_quantiles(data, [], "_v", probs, names=[f"q{i}" for i in range(len(probs))]).first()
    start = {p: row[i] for i, p in enumerate(probs)}
    centers = {kk: [start[i / (kk + 1)] for i in range(1, kk + 1)] for kk in ks}
    open_ks = set(ks)
    for _ in range(max_iter):
        if not open_ks:
            break
        aggs = []
        for kk in sorted(open_ks):
            label = _nearest(F.col("_v"), centers[kk])
            for j in range(kk):
                aggs += [F.count_if(label == j).alias(f"n_{kk}_{j}"), F.sum(F.when(label == j, F.col("_v"))).alias(f"s_{kk}_{j}")]
        got = data.agg(*aggs).first()
        for kk in sorted(open_ks):
            new = [got[f"s_{kk}_{j}"] / got[f"n_{kk}_{j}"] if got[f"n_{kk}_{j}"] else centers[kk][j] for j in range(kk)]
            # same centres mean same labels in the next step
            if new == centers[kk]:
                open_ks.discard(kk)
            centers[kk] = new
    for kk in ks:
        centers[kk] = sorted(centers[kk])
    rss_row = data.agg(*[
        F.sum(F.array_min(F.array(*[F.pow(F.col("_v") - c, F.lit(2.0)) for c in centers[kk]]))).alias(f"r{kk}") for kk in ks
    ]).first()

    def bic(kk: int) -> float:
        return n * math.log(max(rss_row[f"r{kk}"] / n, 1e-12)) + 2 * kk * math.log(max(n, 2)) + 1.5 * kk

    best = min(ks, key=lambda kk: (bic(kk), kk))
    return data.withColumn("group", _nearest(F.col("_v"), centers[best]).cast("int")).drop("_v")
