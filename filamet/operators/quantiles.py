"""Exact quantiles of groups of any size, without sorting a whole large group.

Groups of up to ROWS_PER_BUCKET rows are windowed whole, after one shuffle, where a caller lets them be
counted first (``count_first``).  For others and larger ones pass 1 counts each group per value bucket (map-side combine).  The bucket counts say which
bucket holds each wanted rank or cumulative weight; pass 2 keeps only the rows of those
buckets, folds equal values, and looks up the answer there.  The count reads the input once more,
so it is for inputs that are cheap to read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamet.operators.ordered import PER_OCTAVE, by_size, log_bucket


def q_name(q: float) -> str:
    return f"q{q:g}".replace(".", "_")


def _bucket_edges(rows: DataFrame, keys: list[str], measure: Column) -> DataFrame:
    """One row per (group, bucket): its total and the running total before it."""
    per_bucket = rows.groupBy(*keys, "__b").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(measure).alias("__s"), F.max("__x").alias("__hi")
    )
    across = Window.partitionBy(*keys).orderBy("__b")
    upto = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per_bucket.select(
        *keys,
        "__b",
        "__s",
        F.sum("__s").over(upto).alias("__e"),
        F.lag("__hi").over(across).alias("__prev"),
        F.lead("__b").over(across).isNull().alias("__final"),
        F.sum("__s").over(whole).alias("__total"),
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: Sequence[float],
    *,
    names: Sequence[str] | None = None,
    per_octave: int = PER_OCTAVE,
    count_first: bool = False,
    few: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles (``numpy.quantile`` default) per group; null and NaN ignored.

    ``few`` says that the number of groups is fixed, whatever the rows: the buckets hit are broadcast.
    """
    keys = list(keys)
    names = list(names or [q_name(q) for q in probs])
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, x.cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    if count_first:
        return by_size(rows, keys, lambda d: _whole_quantiles(d, keys, probs, names), lambda d: exact_quantiles(d, keys, "__x", probs, names=names, per_octave=per_octave))
    rows = rows.withColumn("__b", log_bucket(F.col("__x"), per_octave))
    edges = _bucket_edges(rows, keys, F.lit(1))

    def rank(q: float, side: int) -> Column:
        pos = (F.col("__total") - 1) * F.lit(float(q))
        return F.ceil(pos) if side else F.floor(pos)

    def holds(r: Column, upto: Column, count: Column) -> Column:
        return (r < upto) & (r >= upto - count)

    places = [(q, side) for q in probs for side in (0, 1)]
    hit = reduce(or_, [holds(rank(q, s), F.col("__e"), F.col("__s")) for q, s in places])
    hits = edges.where(hit).select(*keys, "__b", (F.col("__e") - F.col("__s")).alias("__o"), "__total")
    # offset and total depend on the bucket, so grouping by them only carries them along
    folded = rows.join(F.broadcast(hits) if few else hits, [*keys, "__b"]).groupBy(*keys, "__b", "__x", "__o", "__total").agg(
        F.count(F.lit(1)).alias("__c")
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = folded.withColumn("__cum", F.col("__o") + F.sum("__c").over(inside))
    out = []
    for q, name in zip(probs, names, strict=True):
        pos = (F.max("__total") - 1) * F.lit(float(q))
        lo, hi = (F.max(F.when(holds(rank(q, s), F.col("__cum"), F.col("__c")), F.col("__x"))) for s in (0, 1))
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return placed.groupBy(*keys).agg(*out) if keys else placed.agg(*out)


def _whole_quantiles(rows: DataFrame, keys: list[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    group = Window.partitionBy(*keys)
    placed = rows.withColumns({"__i": F.row_number().over(group.orderBy("__x")) - 1, "__total": F.count(F.lit(1)).over(group)})
    out = []
    for q, name in zip(probs, names, strict=True):
        pos = (F.col("__total") - 1) * F.lit(float(q))
        lo, hi = (F.max(F.when(F.col("__i") == end, F.col("__x"))) for end in (F.floor(pos), F.ceil(pos)))
        out.append((lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(name))
    return placed.groupBy(*keys).agg(*out)


def _whole_weighted(rows: DataFrame, keys: list[str], ties: list[Column], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    group = Window.partitionBy(*keys)
    order = group.orderBy("__x", *ties)
    knots = rows.select(
        *keys, "__x", F.col("__w").alias("__fw"),
        F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__c1"),
        F.coalesce(F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__cp"),
        F.lag("__x").over(order).alias("__xp"), F.lead("__x").over(order).isNull().alias("__last"),
        F.sum("__w").over(group).alias("__total"),
    )
    return _answers(knots, keys, probs, names)


def _target(q: float) -> Column:
    return F.col("__total") * F.lit(float(q))


def _owns(t: Column, lower: Column, upper: Column, first: Column, last: Column) -> Column:
    return ((t >= lower) | first) & ((t < upper) | last)


def _answers(knots: DataFrame, keys: list[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Weighted quantiles from rows that span (weight before it, value before it) .. (its last knot, its value)."""
    out = []
    for q, name in zip(probs, names, strict=True):
        t = _target(q)
        answer = F.when((t >= F.col("__cp") + F.col("__fw")) | F.col("__xp").isNull(), F.col("__x")).otherwise(
            F.col("__xp") + (F.col("__x") - F.col("__xp")) * (t - F.col("__cp")) / F.col("__fw")
        )
        mine = _owns(t, F.col("__cp"), F.col("__c1"), F.col("__xp").isNull(), F.col("__last"))
        out.append(F.max(F.when(mine, answer)).alias(name))
    return knots.groupBy(*keys).agg(*out) if keys else knots.agg(*out)


def weighted_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    probs: Sequence[float],
    *,
    tie: Sequence[str] = (),
    names: Sequence[str] | None = None,
    per_octave: int = PER_OCTAVE,
    count_first: bool = False,
) -> DataFrame:
    """Weighted quantile per group: linear in the right-cumulative weight.

    With samples sorted by value (ties in ``tie`` order) and ``c`` the cumulative weight, the
    answer at ``q`` is ``interp(q * total, c, x)``; below the first ``c`` it is the first value.
    Only the first of several equal values matters besides their sum, so equal values fold to
    two knots, ``(c - sum + first, x)`` and ``(c, x)``.
    """
    keys = list(keys)
    names = list(names or [q_name(q) for q in probs])
    rows = df.select(
        *keys,
        F.col(value).cast("double").alias("__x"),
        F.col(weight).cast("double").alias("__w"),
        *[F.col(t).alias(f"__t{i}") for i, t in enumerate(tie)],
    ).where(F.col("__x").isNotNull() & ~F.isnan("__x") & F.col("__w").isNotNull() & ~F.isnan("__w"))
    ties = [F.col(f"__t{i}") for i in range(len(tie))] or [F.col("__w")]
    if count_first:
        # as in the fold below, a null comes last in a single tie column and first within several
        orders = ties if len(ties) > 1 else [ties[0].asc_nulls_last()]
        names_of = [f"__t{i}" for i in range(len(tie))]
        return by_size(rows, keys, lambda d: _whole_weighted(d, keys, orders, probs, names), lambda d: weighted_quantiles(d, keys, "__x", "__w", probs, tie=names_of, names=names, per_octave=per_octave))
    tie_key = ties[0] if len(ties) == 1 else F.struct(*ties)
    rows = rows.withColumn("__tie", tie_key).drop(*[f"__t{i}" for i in range(len(tie))])
    rows = rows.withColumn("__b", log_bucket(F.col("__x"), per_octave))
    edges = _bucket_edges(rows, keys, F.col("__w"))

    start = F.col("__e") - F.col("__s")
    hit = reduce(or_, [_owns(_target(q), start, F.col("__e"), F.col("__prev").isNull(), F.col("__final")) for q in probs])
    hits = edges.where(hit).select(*keys, "__b", start.alias("__o"), F.col("__prev").alias("__p"), "__total")
    folded = (
        rows.join(hits, [*keys, "__b"])
        .groupBy(*keys, "__b", "__x", "__o", "__p", "__total")
        .agg(F.sum("__w").alias("__sw"), F.min_by("__w", "__tie").alias("__fw"))
    )
    order = Window.partitionBy(*keys, "__b").orderBy("__x")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    knots = folded.select(
        *keys,
        "__x",
        "__total",
        "__sw",
        "__fw",
        (F.col("__o") + F.sum("__sw").over(upto)).alias("__c1"),
        F.coalesce(F.lag("__x").over(order), F.col("__p")).alias("__xp"),
        F.lead("__x").over(order).isNull().alias("__last"),
    ).withColumn("__cp", F.col("__c1") - F.col("__sw"))
    return _answers(knots, keys, probs, names)


def exact_medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Medians of several expressions per group in one pass over an unpivoted view."""
    return multi_quantiles(df, keys, {(n, 0.5): (n, c) for n, c in values.items()})


def multi_quantiles(df: DataFrame, keys: Sequence[str], spec: dict, *, count_first: bool = False) -> DataFrame:
    """Quantiles of several expressions: ``{(name, q): (out_name, column)}``."""
    keys = list(keys)
    names = sorted({n for n, _ in spec})
    probs = sorted({q for _, q in spec})
    by_name = {n: c for (n, _), (_, c) in spec.items()}
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), by_name[n].cast("double").alias("v")) for i, n in enumerate(names)])
    long = (
        df.withColumn("__p", F.explode(pairs))
        .select(*keys, F.col("__p.k").alias("__k2"), F.col("__p.v").alias("__v"))
        .where(F.col("__v").isNotNull())
    )
    q = exact_quantiles(long, [*keys, "__k2"], "__v", probs, count_first=count_first)
    out = [
        F.max(F.when(F.col("__k2") == names.index(n), F.col(q_name(p)))).alias(o)
        for (n, p), (o, _) in spec.items()
    ]
    return q.groupBy(*keys).agg(*out) if keys else q.agg(*out)


__all__ = ["exact_medians", "exact_quantiles", "multi_quantiles", "q_name", "weighted_quantiles"]
