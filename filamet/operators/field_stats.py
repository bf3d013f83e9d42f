"""Aggregates over field samples: acceptance, medians, flags, refinement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet.operators.distributions import pair_distances
from filamet.operators.groups import attach_row
from filamet.operators.quantiles import multi_quantiles


def usable(x: Column) -> Column:
    """NaN and infinities become null, so aggregates skip them."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def field_statistics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, acceptance shares, medians and P90s per image.

    Columns used: edge_accepted profile_accepted asymmetry imbalance edge_minus_edt coherence.
    """
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if("edge_accepted").alias("edge_accepted_count"), F.count_if("profile_accepted").alias("profile_accepted_count"),
        F.avg(F.col("edge_accepted").cast("double")).alias("edge_acceptance_fraction"), F.avg(F.col("profile_accepted").cast("double")).alias("profile_acceptance_fraction"),
        F.avg(usable(F.col("asymmetry"))).alias("edge_mean_asymmetry"), F.avg("coherence").alias("mean_coherence"),
    )
    q = multi_quantiles(df, keys, {
        ("asymmetry", 0.5): ("edge_median_asymmetry", usable(F.col("asymmetry"))),
        ("imbalance", 0.5): ("median_imbalance", usable(F.col("imbalance"))),
        ("imbalance", 0.9): ("p90_imbalance", usable(F.col("imbalance"))),
        ("edge_minus_edt", 0.5): ("median_edge_minus_edt", usable(F.col("edge_minus_edt"))),
    }, count_first=True)
    return base.join(q, keys, "left")


def flag_counts(df: DataFrame, keys: Sequence[str], flags: str, extra: DataFrame | None = None) -> DataFrame:
    """How often each flag occurs and its share; ``extra`` adds result-level flags (``flag``)."""
    keys = list(keys)
    rows = df.select(*keys, F.explode(flags).alias("flag"))
    if extra is not None:
        rows = rows.unionByName(extra.select(*keys, "flag"))
    counts = rows.groupBy(*keys, "flag").agg(F.count(F.lit(1)).alias("n"))
    # one row per flag name is left per group, a fixed vocabulary
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return counts.join(totals, keys).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def refinement_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage, segments, shifts and acceptance among refined samples.

    Columns used: accepted shift width refined smooth_shift segment_id edge_accepted edge arc_weight.
    """
    keys = list(keys)
    ref, acc = F.col("refined"), F.col("accepted")
    edge_ok = F.col("edge_accepted") & usable(F.col("edge")).isNotNull()
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(acc).alias("accepted_count"), F.count_if(ref).alias("smoothed_count"),
        F.count_distinct(F.when(F.col("segment_id") >= 0, F.col("segment_id"))).alias("segment_count"),
        F.avg(F.when(ref, edge_ok.cast("double"))).alias("edge_acceptance_among_refined"), F.sum("arc_weight").alias("arc_length"),
    )
    q = multi_quantiles(df, keys, {
        ("shift", 0.5): ("median_shift", F.when(acc, F.col("shift"))), ("shift", 0.9): ("p90_shift", F.when(acc, F.col("shift"))),
        ("frac", 0.5): ("median_shift_fraction", F.when(acc, F.col("shift") / F.col("width"))),
        ("smooth", 0.5): ("median_smooth_shift", F.when(ref, F.col("smooth_shift"))), ("smooth", 0.9): ("p90_smooth_shift", F.when(ref, F.col("smooth_shift"))),
    }, count_first=True)
    return base.join(q, keys, "left").withColumns({"coverage": F.col("accepted_count") / F.col("n"), "smooth_coverage": F.col("smoothed_count") / F.col("n")})


# --- fixed values: pairs of estimators compared per image -----------------------------------
W1_PAIRS = {
    "edt_edge_raw": ("edt@edge", "edge@edge"), "edt_edge_refined": ("redt@redge", "redge@redge"),
    "edt_profile_raw": ("edt@profile", "profile@profile"), "edt_profile_refined": ("redt@rprofile", "rprofile@rprofile"),
    "edge_raw_vs_refined": ("edge@edge", "redge@redge"), "profile_raw_vs_refined": ("profile@profile", "rprofile@rprofile"),
    "edge_profile_refined": ("redge@redge", "rprofile@rprofile"),
}


def estimator_distances(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted W1 of the seven estimator pairs, each side masked by an acceptance column.

    Columns: edt edge profile redt redge rprofile, and booleans ``<name>_accepted`` for edge,
    profile, redge and rprofile.  A series ``a@b`` holds ``a`` where ``b`` is accepted.
    """
    keys = list(keys)
    names = sorted({n for p in W1_PAIRS.values() for n in p})
    cells = []
    for n in names:
        value, mask = n.split("@")
        cells.append(F.struct(F.lit(n).alias("series"), F.when(F.col(f"{mask}_accepted"), usable(F.col(value))).alias("value")))
    long = df.withColumn("_p", F.explode(F.array(*cells))).select(*keys, "_p.*", F.lit(1.0).alias("one")).where(F.col("value").isNotNull())
    d = pair_distances(long, keys, "series", names, "value", "one", list(W1_PAIRS.values()), weighted=False)
    label = None
    for name, (a, b) in W1_PAIRS.items():
        hit = (F.col("left") == a) & (F.col("right") == b)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return d.select(*keys, label.alias("pair"), F.col("w1_unweighted").alias("w1"))


def estimator_medians(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median of the six estimators per image, each over the samples it accepts, and the acceptance shares.

    Columns as in :func:`estimator_distances`.  The distance transform has no acceptance of its own.
    """
    keys = list(keys)
    masks = {"edt_raw": ("edt", None), "edt_refined": ("redt", None), "edge_raw": ("edge", "edge"), "edge_refined": ("redge", "redge"), "profile_raw": ("profile", "profile"), "profile_refined": ("rprofile", "rprofile")}
    value = lambda v, m: usable(F.col(v)) if m is None else F.when(F.col(f"{m}_accepted"), usable(F.col(v)))
    q = multi_quantiles(df, keys, {(n, 0.5): (n, value(v, m)) for n, (v, m) in masks.items()}, count_first=True)
    shares = df.groupBy(*keys).agg(*[F.avg(F.col(f"{m}_accepted").cast("double")).alias(f"{n}_acceptance") for n, (_, m) in masks.items() if m])
    return shares.join(q, keys, "left")


def refinement_effect(distances: DataFrame, image: str, pair: str = "pair") -> DataFrame:
    """How many images agree better after refinement, and the median distances."""
    wide = distances.groupBy(image).agg(*[F.max(F.when(F.col(pair) == p, F.col("w1"))).alias(p) for p in ("edt_edge_raw", "edt_edge_refined")])
    both = F.col("edt_edge_raw").isNotNull() & F.col("edt_edge_refined").isNotNull()
    w = wide.withColumn("_ok", both)
    base = w.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("_ok") & (F.col("edt_edge_refined") < F.col("edt_edge_raw"))).alias("improved"))
    q = multi_quantiles(w.where("_ok"), [], {("a", 0.5): ("median_raw", F.col("edt_edge_raw")), ("b", 0.5): ("median_refined", F.col("edt_edge_refined"))})
    return attach_row(base, q)


def truth_error(df: DataFrame, keys: Sequence[str], value: str, truth: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.abs(usable(F.col(value)) - F.col(truth))).alias("mae"))
