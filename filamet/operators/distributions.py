"""Weighted distributions: summaries, histograms, ECDF, distances, consensus and mixtures."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamet.operators.groups import agg, join_groups, list_median
from filamet.operators.ordered import by_size, ordered, with_value_bucket
from filamet.operators.quantiles import exact_quantiles, weighted_quantiles

SUMMARY_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
SUMMARY_NAMES = ["p05", "p25", "p50", "p75", "p95"]


# ---- bins ------------------------------------------------------------------------------------

def edge(lo: Column, hi: Column, bins: Column | int, i: Column) -> Column:
    """Edge ``i`` of ``bins`` equal bins; the last edge is exactly ``hi``."""
    n = F.lit(bins) if isinstance(bins, int) else bins
    return F.when(i >= n, hi).otherwise(i * ((hi - lo) / n) + lo)


BIN_PIECE = 4096


def bin_index(x: Column, lo: Column, hi: Column, bins: Column | int) -> Column:
    """Bin of ``x``: left-closed bins, the last one closed on both sides.

    The division only guesses; comparing with the edges puts values on an edge where they belong.
    """
    n = F.lit(bins) if isinstance(bins, int) else bins
    guess = F.least(n - 1, F.greatest(F.lit(0), F.floor((x - lo) * (n / (hi - lo))))).cast("int")
    down = F.when(x < edge(lo, hi, n, guess), guess - 1).otherwise(guess)
    up = F.when((x >= edge(lo, hi, n, down + 1)) & (down < n - 1), down + 1).otherwise(down)
    return up.cast("int")


def common_edges(df: DataFrame, keys: Sequence[str], x: str, bins: int = 32) -> DataFrame:
    """Pooled range per group: ``lo``, ``hi`` and ``bins``; a degenerate range gets one bin."""
    e = agg(present(df, x), keys, F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    flat = F.abs(F.col("_mn") - F.col("_mx")) <= 1e-8 + 1e-5 * F.abs(F.col("_mx"))
    half = F.greatest(F.abs(F.col("_mn")) * 0.05, F.lit(0.5))
    return e.select(
        *keys,
        F.when(flat, F.col("_mn") - half).otherwise(F.col("_mn")).alias("lo"),
        F.when(flat, F.col("_mn") + half).otherwise(F.col("_mx")).alias("hi"),
        F.when(flat, 1).otherwise(bins).alias("bins"),
    )


def weighted_histogram(
    df: DataFrame, keys: Sequence[str], series: Sequence[str], x: str, w: str, edges: DataFrame,
) -> DataFrame:
    """Histogram and density of each series over the group's common edges, empty bins kept.

    Bins are laid out in pieces of BIN_PIECE that are dealt over the tasks, as outliers can stretch a
    range to any number of bins.
    """
    keys, series = list(keys), list(series)
    rows = join_groups(present(df, x, w), edges, keys)
    counted = rows.groupBy(*keys, *series, bin_index(F.col(x), F.col("lo"), F.col("hi"), F.col("bins")).alias("bin")).agg(
        F.sum(w).alias("h"), F.count(F.lit(1)).alias("n")
    )
    totals = join_groups(counted.groupBy(*keys, *series).agg(F.sum("h").alias("total")), edges, keys)
    pieces = totals.withColumn("_p", F.explode(F.sequence(F.lit(0), F.expr(f"cast((bins - 1) div {BIN_PIECE} as int)")))).repartition(*keys, *series, "_p")
    first = F.col("_p") * BIN_PIECE
    frame = pieces.withColumn("bin", F.explode(F.sequence(first, F.least(first + BIN_PIECE, F.col("bins")) - 1))).drop("_p")
    lo, hi, n, i = F.col("lo"), F.col("hi"), F.col("bins"), F.col("bin")
    return (
        frame.join(counted, [*keys, *series, "bin"], "left")
        .withColumns({
            "h": F.coalesce("h", F.lit(0.0)), "n": F.coalesce("n", F.lit(0)),
            "left_edge": edge(lo, hi, n, i), "right_edge": edge(lo, hi, n, i + 1),
        })
        .withColumn("density", F.when(F.col("total") > 0, F.col("h") / (F.col("total") * (F.col("right_edge") - F.col("left_edge")))))
        .select(*keys, *series, "bin", "left_edge", "right_edge", "h", "n", "density")
    )


def scott_edges(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Automatic bins: Scott width rounded to 1, 2, 3, 5 or 10 times a power of ten."""
    s = agg(present(df, x), keys, F.min(x).alias("_mn"), F.max(x).alias("_mx"), F.stddev_samp(x).alias("_sd"), F.count(x).alias("_n"))
    raw = 3.5 * F.col("_sd") * F.pow(F.col("_n"), F.lit(-1.0 / 3.0))
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.col("_raw"))))
    # nearest choice, the smaller one on a tie
    choice = F.array_min(F.transform(
        F.array(*[F.lit(v) for v in (1.0, 2.0, 3.0, 5.0, 10.0)]),
        lambda k: F.struct(F.abs(k * power - F.col("_raw")).alias("d"), (k * power).alias("v")),
    ))["v"]
    s = s.withColumn("_raw", raw).withColumn("width", F.when(F.col("_mn") < F.col("_mx"), choice).otherwise(F.lit(1.0)))
    first = F.floor(F.col("_mn") / F.col("width"))
    last = F.ceil(F.col("_mx") / F.col("width"))
    flat = F.col("_mn") == F.col("_mx")
    return s.select(
        *keys, "width",
        F.when(flat, F.col("_mn") - 0.5).otherwise(first * F.col("width")).alias("lo"),
        F.when(flat, F.col("_mx") + 0.5).otherwise(last * F.col("width")).alias("hi"),
        F.when(flat, F.lit(1)).otherwise((last - first).cast("int")).alias("bins"),
    )


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose value (and weight, if named) is a finite number: null, NaN and infinity are missing."""
    finite = F.lit(True)
    for c in columns:
        # false for infinity and, as no number is below NaN, for NaN
        finite = finite & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    return df.where(finite)


def known_series(df: DataFrame, series: str, names: Sequence[str]) -> DataFrame:
    """The rows, with an error raised by any series that ``names`` lacks."""
    wrong = F.concat(F.lit("series without a place in the list: "), F.coalesce(F.col(series).cast("string"), F.lit("null")))
    return df.withColumn(series, F.when(F.col(series).isin(*names), F.col(series)).otherwise(F.raise_error(wrong).cast(df.schema[series].dataType)))


EMPTY_OR_INCOMPATIBLE = "EMPTY_OR_INCOMPATIBLE_COMMON_DISTRIBUTION"


def consensus_members(members: DataFrame, samples: DataFrame, keys: Sequence[str], series: str, names: Sequence[str], x: str) -> DataFrame:
    """Which series of a group may enter a consensus: adds ``included`` and ``reason``.

    ``members`` has one row per group and series with ``unit`` and ``estimand``.  The first member in
    the order of ``names`` sets both; others, and members without a value, are excluded.
    """
    keys = list(keys)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(series))
    known = known_series(members, series, names)
    first = known.groupBy(*keys).agg(F.min_by(F.struct("unit", "estimand"), place).alias("_first"))
    filled = present(samples, x).groupBy(*keys, series).agg(F.lit(True).alias("_filled"))
    ok = F.col("_filled").isNotNull() & F.col("unit").eqNullSafe(F.col("_first.unit")) & F.col("estimand").eqNullSafe(F.col("_first.estimand"))
    out = known.join(first, keys).join(filled, [*keys, series], "left").withColumn("included", ok)
    return out.withColumn("reason", F.when(~F.col("included"), F.lit(EMPTY_OR_INCOMPATIBLE))).drop("_first", "_filled")


def require_same(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows, with an error raised by a group whose series differ in one of ``columns`` (unit, estimand)."""
    keys = list(keys)
    mixed = F.lit(False)
    for c in columns:
        mixed = mixed | ~F.min(F.col(c)).eqNullSafe(F.max(F.col(c))) | (F.count(F.col(c)) != F.count(F.lit(1)))
    same = df.groupBy(*keys).agg(F.when(mixed, F.raise_error(F.lit("comparison requires matching unit and estimand")).cast("boolean")).otherwise(F.lit(True)).alias("_same"))
    return df.join(same, keys).where("_same").drop("_same")


# ---- summaries -------------------------------------------------------------------------------

def weighted_moments(df: DataFrame, keys: Sequence[str], x: str, w: str) -> DataFrame:
    """n, weight sum, weighted mean and population SD (two passes, so no cancellation)."""
    keys = list(keys)
    rows = present(df, x, w).select(*keys, x, w)
    base = agg(rows, keys, F.count(x).alias("_n"), F.sum(w).alias("_w"), (F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("_m"))
    off = F.col(x) - F.col("_m")
    return agg(
        join_groups(rows, base, keys), keys,
        F.max("_n").alias("n"), F.max("_w").alias("weight_sum"), F.max("_m").alias("mean"),
        F.sqrt(F.sum(F.col(w) * off * off) / F.max("_w")).alias("std"),
    )


def weighted_summary(df: DataFrame, keys: Sequence[str], x: str, w: str, *, tie: Sequence[str] = ()) -> DataFrame:
    df = present(df, x, w)
    return join_groups(
        weighted_moments(df, keys, x, w),
        weighted_quantiles(df, keys, x, w, SUMMARY_PROBS, tie=tie, names=SUMMARY_NAMES),
        keys,
    )


def ecdf(df: DataFrame, keys: Sequence[str], x: str, w: str, tie: Sequence[str]) -> DataFrame:
    """One ECDF point per sample with a value, ties in ``tie`` order."""
    rows = with_value_bucket(present(df, x, w), keys, x, tie)
    out = ordered(rows, keys, [x, *tie], sums={"_cum": F.col(w)}, totals={"_total": "_cum"})
    return out.withColumn("ecdf", F.col("_cum") / F.col("_total")).drop("_cum", "_total")


# ---- distances -------------------------------------------------------------------------------

def pair_distances(
    df: DataFrame, keys: Sequence[str], series: str, names: Sequence[str], x: str, w: str,
    pairs: Sequence[tuple[str, str]] | None = None, *, weighted: bool = True,
) -> DataFrame:
    """Wasserstein-1 (weighted and plain) and KS (always unweighted) for pairs of series.

    All pairs of a group share one pass of running sums with one weight per series, so no pair
    multiplies the rows.  Samples of a large group fold to one row per value first.  ``names`` is the method list; a series
    outside it is an error.
    """
    keys = list(keys)
    pairs = list(pairs if pairs is not None else combinations(names, 2))
    kinds = ("w", "n") if weighted else ("n",)
    cols = [f"{k}{i}" for i in range(len(names)) for k in kinds]
    known = known_series(present(df, x, w) if weighted else present(df, x), series, names)
    place = (F.array_position(F.array(*[F.lit(m) for m in names]), F.col(series)) - 1).cast("byte")
    rows = known.select(*keys, F.col(x).alias("_x"), place.alias("_i"), *([F.col(w).alias("_w")] if weighted else []))
    part = {f"{k}{i}": F.when(F.col("_i") == i, F.col("_w") if k == "w" else F.lit(1.0)).otherwise(0.0) for i in range(len(names)) for k in kinds}

    def whole(d: DataFrame) -> DataFrame:
        """Rows as they are: equal values share their sums, and the step between them is zero."""
        group = Window.partitionBy(*keys)
        order = group.orderBy("_x")
        upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        sums = [f(v).over(over).alias(f"{c}{k}") for k, v in part.items() for c, over, f in (("c", upto, F.sum), ("t", group, F.sum))]
        return d.select(*keys, "_x", *sums, F.lead("_x").over(order).alias("_nx"))

    def pieces(d: DataFrame) -> DataFrame:
        cells = d.groupBy(*keys, "_x").agg(*[F.sum(v).alias(k) for k, v in part.items()])
        run = ordered(
            with_value_bucket(cells, keys, "_x"), keys, ["_x"],
            sums={f"c{k}": F.col(k) for k in cols}, totals={f"t{k}": f"c{k}" for k in cols}, leads={"_nx": "_x"},
        )
        return run.select(*keys, "_x", *[f"{c}{k}" for k in part for c in "ct"], "_nx")

    run = by_size(rows, keys, whole, pieces)
    step = F.coalesce(F.col("_nx") - F.col("_x"), F.lit(0.0))
    index = {m: i for i, m in enumerate(names)}

    def gap(kind: str, a: str, b: str) -> Column:
        i, j = f"{kind}{index[a]}", f"{kind}{index[b]}"
        ok = (F.col(f"t{i}") > 0) & (F.col(f"t{j}") > 0)
        return F.when(ok, F.abs(F.col(f"c{i}") / F.col(f"t{i}") - F.col(f"c{j}") / F.col(f"t{j}")))

    out = []
    for p, (a, b) in enumerate(pairs):
        out += [
            (F.sum(gap("w", a, b) * step) if weighted else F.lit(None).cast("double")).alias(f"_w{p}"),
            F.sum(gap("n", a, b) * step).alias(f"_u{p}"),
            F.max(gap("n", a, b)).alias(f"_k{p}"),
        ]
    wide = agg(run, keys, *out)
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("left"), F.lit(b).alias("right"),
            F.col(f"_w{p}").alias("w1"), F.col(f"_u{p}").alias("w1_unweighted"), F.col(f"_k{p}").alias("ks"),
        )
        for p, (a, b) in enumerate(pairs)
    ])
    return wide.withColumn("_p", F.explode(rows)).select(*keys, "_p.*")


def agreements(df: DataFrame, keys: Sequence[str], series: str, names: Sequence[str], x: str, w: str, *, tie: Sequence[str] = ()) -> DataFrame:
    """Mean, median, relative median difference, W1 and KS for every pair of series of a group."""
    keys = list(keys)
    df = present(df, x, w)
    means = df.groupBy(*keys, series).agg((F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("mean"))
    medians = weighted_quantiles(df, [*keys, series], x, w, [0.5], tie=tie, names=["median"], count_first=True)
    stats = means.join(medians, [*keys, series])
    left = stats.select(*keys, F.col(series).alias("left"), F.col("mean").alias("_lm"), F.col("median").alias("_ld"))
    right = stats.select(*keys, F.col(series).alias("right"), F.col("mean").alias("_rm"), F.col("median").alias("_rd"))
    # a pair with an empty side stays, without values
    d = pair_distances(df, keys, series, names, x, w)
    return (
        d.join(left, [*keys, "left"], "left").join(right, [*keys, "right"], "left")
        .select(
            *keys, "left", "right",
            (F.col("_lm") - F.col("_rm")).alias("mean_difference"),
            (F.col("_ld") - F.col("_rd")).alias("median_difference"),
            F.when(F.col("_rd") != 0, 100 * (F.col("_ld") - F.col("_rd")) / F.abs("_rd")).alias("relative_median_difference_percent"),
            F.col("w1").alias("wasserstein_1"), F.col("ks").alias("ks_statistic"),
        )
    )


# ---- quantile curves, consensus, mixtures ----------------------------------------------------

def quantile_grid(df: DataFrame, keys: Sequence[str], x: str, w: str, size: int = 101, *, tie: Sequence[str] = ()) -> DataFrame:
    """Weighted quantiles at ``size`` equally spaced levels, one row per level.

    Each folded value emits the levels that fall between the running weight before and after it.
    """
    keys = list(keys)
    names = [f"_t{i}" for i in range(len(tie))]
    rows = present(df, x, w).select(*keys, F.col(x).alias("_x"), F.col(w).alias("_fw"), *[F.col(t).alias(n) for t, n in zip(tie, names, strict=True)])
    ties = [F.col(n) for n in names] or [F.col("_fw")]

    def whole(d: DataFrame) -> DataFrame:
        group = Window.partitionBy(*keys)
        order = group.orderBy("_x", *(ties if len(ties) > 1 else [ties[0].asc_nulls_last()]))
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return d.select(
            *keys, "_x", F.col("_fw").alias("_sw"), "_fw", F.sum("_fw").over(upto).alias("_c"), F.sum("_fw").over(group).alias("_t"),
            F.lag("_x").over(order).alias("_xp"), F.lead("_x").over(order).alias("_xn"))

    def pieces(d: DataFrame) -> DataFrame:
        cells = d.groupBy(*keys, "_x").agg(F.sum("_fw").alias("_sw"), F.min_by("_fw", ties[0] if len(ties) == 1 else F.struct(*ties)).alias("_fw"))
        run = ordered(
            with_value_bucket(cells, keys, "_x"), keys, ["_x"],
            sums={"_c": F.col("_sw")}, totals={"_t": "_c"}, lags={"_xp": "_x"}, leads={"_xn": "_x"},
        )
        return run.select(*keys, "_x", "_sw", "_fw", "_c", "_t", "_xp", "_xn")

    run = by_size(rows, keys, whole, pieces)
    last = size - 1
    cp = F.col("_c") - F.col("_sw")
    lo = F.when(F.col("_xp").isNull(), F.lit(0)).otherwise(F.ceil(cp / F.col("_t") * last) - 1)
    hi = F.when(F.col("_xn").isNull(), F.lit(last)).otherwise(F.ceil(F.col("_c") / F.col("_t") * last))
    emitted = run.withColumn("level", F.explode(F.sequence(F.greatest(F.lit(0), lo).cast("int"), F.least(F.lit(last), hi).cast("int"))))
    t = F.col("level") / last * F.col("_t")
    owns = ((t >= cp) | F.col("_xp").isNull()) & ((t < F.col("_c")) | F.col("_xn").isNull())
    value = F.when((t >= cp + F.col("_fw")) | F.col("_xp").isNull(), F.col("_x")).otherwise(
        F.col("_xp") + (F.col("_x") - F.col("_xp")) * (t - cp) / F.col("_fw")
    )
    return emitted.where(owns).groupBy(*keys, "level").agg(F.max(value).alias("quantile"))


def consensus(df: DataFrame, keys: Sequence[str], series: str, x: str, w: str, size: int = 101, *, tie: Sequence[str] = ()) -> DataFrame:
    """Pointwise median of the methods' quantile curves and the raw MAD around it."""
    keys = list(keys)
    curves = quantile_grid(df, [*keys, series], x, w, size, tie=tie)
    # one value per method and level, so a list holds at most the number of methods
    lists = curves.groupBy(*keys, "level").agg(F.collect_list("quantile").alias("_q")).withColumn("consensus", list_median(F.col("_q")))
    off = F.transform("_q", lambda q: F.abs(q - F.col("consensus")))
    return lists.select(*keys, "level", "consensus", F.size("_q").cast("long").alias("n_methods"), list_median(off).alias("disagreement_mad"))


def mixture(df: DataFrame, image: str, series: str, x: str, w: str) -> DataFrame:
    """Weights rescaled so that every image has mass one per series; images without mass drop."""
    df = present(df, x, w)
    totals = df.groupBy(image, series).agg(F.sum(w).alias("_tw")).where(F.col("_tw") > 0)
    return df.join(totals, [image, series]).withColumn("mix_weight", F.col(w) / F.col("_tw")).drop("_tw")


def mixture_table(df: DataFrame, image: str, series: str, x: str, w: str, *, tie: Sequence[str] = ()) -> DataFrame:
    df = present(df, x, w)
    m = mixture(df, image, series, x, w)
    images = df.groupBy(image, series).agg(F.sum(w).alias("_tw")).where(F.col("_tw") > 0).groupBy(series).agg(F.count(F.lit(1)).alias("images"))
    return weighted_summary(m, [series], x, "mix_weight", tie=tie).join(images, [series]).withColumn("iqr", F.col("p75") - F.col("p25"))


def image_balanced_samples(summaries: DataFrame, image: str, series: str) -> DataFrame:
    """Five stored quantiles per image as samples of weight 1/5; incomplete images drop."""
    complete = summaries.dropna(subset=SUMMARY_NAMES)
    pairs = F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("value")) for n in SUMMARY_NAMES])
    return complete.withColumn("_p", F.explode(pairs)).select(image, series, "_p.level", "_p.value", F.lit(1.0 / len(SUMMARY_NAMES)).alias("weight"))


def range_and_tail(df: DataFrame, keys: Sequence[str], series: str, x: str, w: str, *, exclude: Sequence[str] = (), tie: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Right end of a shared axis (largest weighted P99 times 1.12) and tail ratio P95/median."""
    q = weighted_quantiles(present(df, x, w), [*keys, series], x, w, [0.5, 0.95, 0.99], tie=tie, names=["q50", "q95", "q99"])
    usable = ~F.col(series).isin(list(exclude)) & (F.col("q99") > 0) if exclude else F.col("q99") > 0
    axis = agg(q, keys, (F.max(F.when(usable, F.col("q99"))) * 1.12).alias("x_max"))
    tail = q.select(*keys, series, F.when(F.col("q50") > 0, F.col("q95") / F.col("q50")).alias("tail_ratio"))
    return axis, tail


def measurement_histogram(df: DataFrame, keys: Sequence[str], x: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram of positive values; a constant input gets a range of +-0.5."""
    df = present(df, x)
    e = agg(df, keys, F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    flat = F.col("_mn") == F.col("_mx")
    edges = e.select(
        *keys, F.when(flat, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
        F.when(flat, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"), F.lit(max(1, bins)).alias("bins"),
    )
    return weighted_histogram(df.withColumn("_one", F.lit(1.0)), keys, [], x, "_one", edges).drop("h", "density")


def unweighted_summary(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """n, mean, median, P05 and P95 without weights."""
    df = present(df, x)
    q = exact_quantiles(df, keys, x, [0.05, 0.5, 0.95], names=["p05", "median", "p95"])
    return join_groups(agg(df, keys, F.count(x).alias("n"), F.avg(x).alias("mean")), q, keys)


def mean_and_median(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    df = present(df, x)
    return join_groups(agg(df, keys, F.count(x).alias("n"), F.avg(x).alias("mean")), exact_quantiles(df, keys, x, [0.5], names=["median"]), keys)
