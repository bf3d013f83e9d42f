"""Order-sensitive functions over groups of any size.

A plain window over ``partitionBy(key)`` puts a whole group into one task, so one key that
holds a third of all rows stalls the job.  Here a group is first cut into *buckets* that are
monotone in the order.  Each bucket is windowed on its own; what a bucket needs from
its neighbours (running totals, the row before, the row after) comes from a summary with one
row per bucket, which is small and built with map-side combine.

Buckets start as whole groups, or as a function of the value where that is free (``log_bucket``).
Those with too many rows are split at the quantiles of a mergeable sketch of the first order column
that varies within them; rows that tie there are split by the next column (``order_bucket``).
Split points are stored before they are used, so a retried task assigns the same buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamet.session import stored

#: buckets per octave; a group spread over one decade falls into about 1700 buckets
PER_OCTAVE = 512
#: rows that a bucket may hold
ROWS_PER_BUCKET = 100_000
#: parts that a crowded bucket is cut into at once
SPLITS = 64
#: bytes of a string that make a number
STRING_BYTES = 6
#: smallest exponent of a positive double, so that bucket numbers of one sign share a sign
_EXPONENT_SHIFT = 1075.0
#: bucket of infinity, beyond any finite value
_END = 1 << 40


def log_bucket(x: Column, per_octave: int = PER_OCTAVE) -> Column:
    """Bucket number that never decreases as ``x`` grows; about 1/per_octave octave wide."""
    mag = F.floor((F.log2(F.abs(x)) + _EXPONENT_SHIFT) * per_octave) + 1
    return (
        F.when(x == 0, F.lit(0).cast("long"))
        .when(F.abs(x) == F.lit(float("inf")), F.when(x > 0, _END).otherwise(-_END))
        .when(x > 0, mag)
        .otherwise(-mag)
        .cast("long")
    )


def linear_bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(float(width))).cast("long")


def time_bucket(ts: Column, seconds: int) -> Column:
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.floor(F.timestamp_diff("SECOND", epoch, ts) / F.lit(seconds)).cast("long")


def order_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, first: Column | None = None, name: str = "__b", rows: int | None = None) -> DataFrame:
    """Add a bucket column that never decreases in ``order`` within a group, with about ``rows`` rows at most.

    ``first`` is a bucket to start from, monotone in the order; without it a group starts as one.
    Order columns are numbers, times or strings; nulls come first, as in a window, and NaN last.
    Only rows alike in all order columns stay together, however many they are.  Where no bucket is too
    large, all this costs is one count; else each round sketches the rows of those that are.
    """
    keys, rows, order = list(keys), rows or ROWS_PER_BUCKET, list(order)
    df = df.withColumn(name, (F.lit(0) if first is None else first).cast("long"))
    if df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows).isEmpty():
        return df
    # from here on a bucket is its path of splits, compared part by part
    df = df.withColumn(name, F.array(name))
    kinds = {c: df.schema[c].dataType for c in order}
    scratch = ["__n", "__i", *(f"__{k}{i}" for i in range(len(order)) for k in ("lo", "hi", "c"))]

    def image(i: int, value: Column) -> Column:
        return _image(kinds[order[i]], value, F.col(f"__lo{i}"), F.col(f"__hi{i}"))

    while True:
        ends = [e for i, c in enumerate(order) for e in (F.min(c).alias(f"__lo{i}"), F.max(c).alias(f"__hi{i}"), F.count(c).alias(f"__c{i}"))]
        sizes = df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("__n"), *ends)
        # the first column that varies; null differs from any value
        varies = F.coalesce(*[
            F.when((F.col(f"__c{i}") > 0) & ((image(i, F.col(f"__lo{i}")) < image(i, F.col(f"__hi{i}"))) | (F.col(f"__c{i}") < F.col("__n"))), i)
            for i in range(len(order))])
        crowded = stored(sizes.where(F.col("__n") > rows).withColumn("__i", varies).where("__i is not null"), "crowded")
        if crowded.isEmpty():
            return df
        value = F.coalesce(*[F.when(F.col("__i") == i, image(i, F.col(c))) for i, c in enumerate(order)])
        spread = df.join(crowded, [*keys, name]).select(*keys, name, value.alias("__v"))
        levels = F.array(*[F.lit(k / SPLITS) for k in range(1, SPLITS)])
        sketched = spread.groupBy(*keys, name).agg(F.kll_sketch_agg_double("__v").alias("__s"), F.min("__v").alias("__least"))
        # the least value is a split point too, so every round parts something
        points = F.array_sort(F.array_distinct(F.concat(F.kll_sketch_get_quantile_double("__s", levels), F.array("__least"))))
        splits = stored(sketched.select(*keys, name, points.alias("__p")), "splits").join(crowded, [*keys, name])
        # a column of its own, else it is computed anew for every split point
        df = df.join(splits, [*keys, name], "left").withColumn("__v", F.when(F.col("__p").isNotNull(), value))
        # a split point parts what is below it, what ties with it and what is beyond
        part = F.aggregate("__p", F.lit(0).cast("long"), lambda n, p: n + F.when(F.col("__v") > p, F.lit(2)).when(F.col("__v") == p, F.lit(1)).otherwise(F.lit(0)).cast("long"))
        df = df.withColumn(name, F.when(F.col("__p").isNotNull(), F.concat(name, F.array(part))).otherwise(F.col(name))).drop("__p", "__v", *scratch)


def _image(kind: T.DataType, x: Column, lo: Column, hi: Column) -> Column:
    """A double that never decreases as ``x`` grows between ``lo`` and ``hi``, and tells apart what is near; null is least."""
    if isinstance(kind, T.StringType):
        raw, low, high = (c.cast("binary") for c in (x, lo, hi))
        n = F.least(F.octet_length(lo), F.octet_length(hi))
        same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.substring(low, i, F.lit(1)) == F.substring(high, i, F.lit(1))), i).otherwise(acc))
        # bytes after those that all share; one that ends earlier comes before
        value = F.conv(F.rpad(F.hex(F.substring(raw, same + 1, F.lit(STRING_BYTES))), 2 * STRING_BYTES, "0"), 16, 10).cast("double")
        value = value + F.least(F.octet_length(x) - same, F.lit(STRING_BYTES + 1)) / 16
    elif isinstance(kind, (T.TimestampType, T.DateType)):
        value = (F.unix_micros(x.cast("timestamp")) - F.unix_micros(lo.cast("timestamp"))).cast("double")
    elif isinstance(kind, T.TimestampNTZType):
        value = F.timestamp_diff("MICROSECOND", lo, x).cast("double")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x.cast("double"))
    elif isinstance(kind, T.BooleanType):
        value = x.cast("double")
    else:
        value = (x.cast("decimal(38,6)") - lo.cast("decimal(38,6)")).cast("double")
    return F.coalesce(value, F.lit(float("-inf")))


def large_groups(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame | None:
    """Keys of the groups with more than ``rows`` rows, stored; None where there are none.  Costs one count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = stored(counts.where(F.col("__n") > (rows or ROWS_PER_BUCKET)).select(*keys), "large")
    return None if large.isEmpty() else large


def by_size(df: DataFrame, keys: Sequence[str], whole: Callable[[DataFrame], DataFrame], pieces: Callable[[DataFrame], DataFrame], rows: int | None = None) -> DataFrame:
    """``whole`` of the groups that one window may hold (up to ``rows`` rows), ``pieces`` of larger ones.

    Buckets of a small group would hold a row or two each, so that their summary and its joins shuffle
    more than the rows themselves.  ``df`` is read once more for the count.
    """
    keys = list(keys)
    if not keys:
        return pieces(df)
    large = large_groups(df, keys, rows)
    if large is None:
        return whole(df)
    return whole(df.join(large, keys, "left_anti")).unionByName(pieces(df.join(large, keys, "left_semi")))


def with_value_bucket(df: DataFrame, keys: Sequence[str], x: str, tie: Sequence[str] = (), *, name: str = "__b", rows: int | None = None) -> DataFrame:
    """Buckets of a numeric column ``x`` (not null): about 1/PER_OCTAVE octave wide, crowded ones split, ties by ``tie``."""
    return order_bucket(df, keys, [x, *tie], first=log_bucket(F.col(x)), name=name, rows=rows)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    bucket: str = "__b",
    number: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, str] | None = None,
    leads: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    count: str | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """Add row numbers, running sums, and previous/next values in ``order`` within ``keys``.

    ``order`` must be a total order within a group and ``bucket`` must be monotone in it.
    ``lags``/``leads`` map a new column name to an existing column name; ``totals`` maps a new
    name to the name of a running sum whose group total is wanted; ``count`` names the group size.
    """
    keys, order = list(keys), list(order)
    sums, lags, leads = dict(sums or {}), dict(lags or {}), dict(leads or {})
    rows = df.withColumns({f"__m_{n}": c for n, c in sums.items()}) if sums else df

    # a previous/next value of the one order column itself is a plain maximum/minimum
    own = len(order) == 1 and set(lags.values()) | set(leads.values()) <= set(order)
    position = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.sum(f"__m_{n}").alias(f"__t_{n}") for n in sums]
    if lags:
        tail = F.struct(*sorted(set(lags.values())))
        aggs.append((F.max(order[0]) if own else F.max_by(tail, position)).alias("__tail"))
    if leads:
        head = F.struct(*sorted(set(leads.values())))
        aggs.append((F.min(order[0]) if own else F.min_by(head, position)).alias("__head"))
    summary = rows.groupBy(*keys, bucket).agg(*aggs)

    across = Window.partitionBy(*keys).orderBy(bucket)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o_n")]
    cols += [F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}_s") for n in sums]
    whole = Window.partitionBy(*keys)
    cols += [F.sum(f"__t_{n}").over(whole).alias(t) for t, n in dict(totals or {}).items()]
    if count:
        cols.append(F.sum("__n").over(whole).alias(count))
    if lags:
        cols.append(F.lag("__tail").over(across).alias("__tail"))
    if leads:
        cols.append(F.lead("__head").over(across).alias("__head"))
    offsets = summary.select(*keys, bucket, *cols)

    joined = rows.join(offsets, [*keys, bucket])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # first/last row of a bucket take the neighbour's edge row
    new: dict[str, Column] = {}
    if number:
        new[number] = (F.col("__o_n") + F.row_number().over(inside)).cast("long")
    for n in sums:
        new[n] = F.col(f"__o_{n}_s") + F.coalesce(F.sum(f"__m_{n}").over(upto), F.lit(0))
    if lags:
        first = F.row_number().over(inside) == 1
        for n, c in lags.items():
            new[n] = F.when(first, F.col("__tail" if own else f"__tail.{c}")).otherwise(F.lag(c).over(inside))
    if leads:
        size = F.count(F.lit(1)).over(Window.partitionBy(*keys, bucket))
        last = F.row_number().over(inside) == size
        for n, c in leads.items():
            new[n] = F.when(last, F.col("__head" if own else f"__head.{c}")).otherwise(F.lead(c).over(inside))
    out = joined.withColumns(new) if new else joined
    drop = ["__o_n", "__tail", "__head", *(f"__m_{n}" for n in sums), *(f"__o_{n}_s" for n in sums)]
    if not keep_bucket:
        drop.append(bucket)
    return out.drop(*drop)
