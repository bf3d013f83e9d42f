"""The order-sensitive core against NumPy, with ties, hot groups and crowded buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from filamet.operators.ordered import linear_bucket, log_bucket, order_bucket, ordered, with_value_bucket
from filamet.operators.quantiles import exact_quantiles, multi_quantiles, weighted_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def frame(seed=7, n=3000):
    rng = np.random.default_rng(seed)
    # group 0 holds most rows; values with ties, negatives, zero and a dense cluster
    g = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n))
    x = np.round(rng.normal(0, 20, n), 0)
    x = np.where(rng.random(n) < 0.3, 1000 + rng.random(n) * 1e-3, x)
    w = np.where(rng.random(n) < 0.1, 0.0, rng.random(n) * 5)
    return pd.DataFrame({"g": g, "x": x, "w": w, "i": np.arange(n)})


@pytest.mark.parametrize("per_octave", [512, 2])
def test_exact_quantiles(spark, per_octave):
    pdf = frame()
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", PROBS, per_octave=per_octave).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g].to_numpy(), np.quantile(part.x, PROBS), rtol=1e-12)


@pytest.mark.parametrize("per_octave", [512, 2])
def test_weighted_quantiles(spark, per_octave):
    pdf = frame()
    got = weighted_quantiles(
        spark.createDataFrame(pdf), ["g"], "x", "w", PROBS, tie=["i"], per_octave=per_octave
    ).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        s = part.sort_values(["x", "i"], kind="stable")
        c = s.w.cumsum().to_numpy()
        want = np.interp(np.array(PROBS) * c[-1], c, s.x.to_numpy())
        np.testing.assert_allclose(got.loc[g].to_numpy(), want, rtol=1e-9, atol=1e-9)


def test_weighted_quantile_literals(spark):
    df = spark.createDataFrame([(1.0, 9.0), (10.0, 1.0)], "x double, w double")
    row = weighted_quantiles(df, [], "x", "w", [0.5, 0.95]).first()
    assert row[0] == pytest.approx(1.0)
    assert row[1] == pytest.approx(5.5)


def test_multi_quantiles_ignore_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 3.0, 5.0), (2, 7.0, None)], "g int, a double, b double")
    rows = {r.g: r for r in multi_quantiles(df, ["g"], {("a", 0.5): ("ma", F.col("a")), ("b", 0.5): ("mb", F.col("b"))}).collect()}
    assert rows[1].ma == 2.0 and rows[1].mb == 5.0 and rows[2].ma == 7.0 and rows[2].mb is None


@pytest.mark.parametrize("bucketing", ["log", "value", "linear"])
def test_ordered_equals_plain_window(spark, bucketing):
    df = spark.createDataFrame(frame())
    if bucketing == "log":
        b = df.withColumn("__b", log_bucket(F.col("x")))
    elif bucketing == "value":
        b = with_value_bucket(df, ["g"], "x", ["i"], rows=40)
    else:
        b = df.withColumn("__b", linear_bucket(F.col("x"), 10.0))
    got = ordered(b, ["g"], ["x", "i"], number="rn", sums={"cum": F.col("w")}, lags={"px": "x"}, leads={"nx": "x", "ni": "i"})
    w = Window.partitionBy("g").orderBy("x", "i")
    want = df.withColumns({
        "rn": F.row_number().over(w), "cum": F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "px": F.lag("x").over(w), "nx": F.lead("x").over(w), "ni": F.lead("i").over(w)})
    a = got.orderBy("i").toPandas()[["g", "x", "i", "rn", "cum", "px", "nx", "ni"]]
    e = want.orderBy("i").toPandas()[a.columns]
    pd.testing.assert_frame_equal(a, e, check_dtype=False, rtol=1e-9)


def sizes_of(df, *keys):
    return df.groupBy(*keys, "__b").count().agg(F.max("count"), F.count("*")).first()


def monotone(df, keys, order):
    """Buckets never decrease in the order of a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_last", F.lag("__b").over(w)).where("_last > __b").isEmpty()


def test_buckets_follow_the_counts(spark):
    """A run dense in time, ids far apart, names with one beginning, nulls: about the wanted rows each."""
    dense = spark.range(5000).select(F.lit(1).alias("k"), F.expr("timestamp_micros(1700000000000000 + id div 5)").alias("ts"), "id")
    sparse = spark.range(5000).select(F.lit(1).alias("k"), F.expr("if(id < 4990, id, id * 10000000000019)").alias("x"))
    names = spark.range(5000).select(F.lit(1).alias("k"), F.concat(F.lit("measurement-campaign-"), F.when(F.col("id") < 4900, F.lpad(F.col("id").cast("string"), 40, "0")).otherwise(F.col("id").cast("string"))).alias("n"))
    nulls = spark.range(5000).select(F.lit(1).alias("k"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).alias("v"), "id")
    for df, order in ((dense, ["ts", "id"]), (sparse, ["x"]), (names, ["n"]), (nulls, ["v", "id"])):
        b = order_bucket(df, ["k"], order, rows=200).cache()
        most, number = sizes_of(b, "k")
        assert most <= 200 and number <= 200, (order, most, number)
        assert monotone(b, ["k"], order)


def test_ties_are_split(spark):
    """Nine rows in ten have one value: the busiest bucket stays below its target."""
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 20 < 18, 3.0).otherwise(F.rand(1)).alias("x"), F.concat(F.lit("row"), "id").alias("i"), F.lit(0.5).alias("w"))
    df = spark.createDataFrame(df.toPandas())
    b = with_value_bucket(df, ["g"], "x", ["i"], rows=150).cache()
    assert sizes_of(b, "g")[0] <= 150 and monotone(b, ["g"], ["x", "i"])
    got = ordered(b, ["g"], ["x", "i"], number="n", sums={"c": F.col("w")}, leads={"nx": "i"})
    w = Window.partitionBy("g").orderBy("x", "i")
    want = df.withColumns({"n": F.row_number().over(w).cast("long"), "c": F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "nx": F.lead("i").over(w)})
    assert got.select(want.columns).exceptAll(want).isEmpty()


def test_rows_alike_stay_together(spark):
    """Rows equal in all order columns cannot be split; infinities and NaN keep their place."""
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, v) for v in [5.0] * 300 + [inf, -inf, nan, 1.0, -0.0, 0.0] * 20], "k int, x double")
    b = order_bucket(df, ["k"], ["x"], rows=50).cache()
    assert b.where("x = 5").select("__b").distinct().count() == 1 and monotone(b, ["k"], ["x"])
    assert order_bucket(df.where("false"), ["k"], ["x"], rows=50).count() == 0
