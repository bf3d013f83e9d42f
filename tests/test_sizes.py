"""Small groups are windowed whole after one shuffle; larger ones give the same in pieces."""

import numpy as np
import pandas as pd
import pytest

from filamet.operators import distributions as D
from filamet.operators import ordered
from filamet.operators.field_stats import W1_PAIRS, estimator_distances
from filamet.operators.quantiles import exact_quantiles, multi_quantiles, weighted_quantiles
from pyspark.sql import functions as F


def samples(spark, groups=(12, 300, 1, 40)):
    rng = np.random.default_rng(5)
    parts = [pd.DataFrame({"g": g, "m": rng.choice(["a", "b", "c"], n), "x": np.round(rng.normal(3, 2, n), 1), "w": rng.integers(0, 4, n).astype(float), "i": np.arange(n)}) for g, n in enumerate(groups)]
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


CASES = {
    "distances": lambda d: D.pair_distances(d, ["g"], "m", ["a", "b", "c"], "x", "w"),
    "unweighted": lambda d: D.pair_distances(d, ["g"], "m", ["a", "b", "c"], "x", "w", weighted=False),
    "grid": lambda d: D.quantile_grid(d, ["g", "m"], "x", "w", 7, tie=["i"]),
    "weighted": lambda d: weighted_quantiles(d, ["g", "m"], "x", "w", [0.0, 0.1, 0.5, 1.0], tie=["i"], count_first=True),
    "untied": lambda d: weighted_quantiles(d, ["g"], "x", "w", [0.5], count_first=True),
    "exact": lambda d: exact_quantiles(d, ["g"], "x", [0.0, 0.3, 1.0], count_first=True),
    "several": lambda d: multi_quantiles(d, ["g"], {("a", 0.5): ("ma", F.col("x")), ("b", 0.9): ("mb", F.when(F.col("m") == "b", F.col("w")))}, count_first=True),
}


@pytest.mark.parametrize("name", CASES)
def test_whole_and_in_pieces(spark, monkeypatch, name):
    df = samples(spark)
    keys = ["g", *[k for k in ("m", "left", "right", "level") if k in CASES[name](df).columns]]
    got = []
    for rows in (100_000, 30, 0):  # all whole, some in pieces, all in pieces
        monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", rows or 1)
        got.append(CASES[name](df).toPandas().sort_values(keys).reset_index(drop=True))
    for other in got[1:]:
        pd.testing.assert_frame_equal(got[0], other[got[0].columns], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("name", [*CASES, "estimators"])
def test_rows_of_small_groups_are_shuffled_once(spark, name):
    """Buckets of a row or two each, their summary and its joins shuffled several times what was read."""
    df = samples(spark, [50] * 20).select("*", *[F.col("x").alias(c) for c in ("edt", "edge", "profile", "redt", "redge", "rprofile")], *[(F.col("i") % 3 > k).alias(f"{c}_accepted") for k, c in enumerate(("edge", "profile", "redge", "rprofile"))])
    out = estimator_distances(df, ["g"]) if name == "estimators" else CASES[name](df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # grids and several quantiles regroup their few results
    assert plan.count("Exchange") <= (2 if name in ("grid", "several") else 1)
    if name == "estimators":
        assert out.count() == 20 * len(W1_PAIRS)


def test_review_state_with_few_and_many_cells(spark, tmp_path, monkeypatch):
    """Cells beyond the shared value have entries of their own; both kinds count on over batches."""
    from filamet.streaming import campaign as SC

    monkeypatch.setattr(SC, "FEW_CELLS", 3, raising=False)
    rows = [(case, cell, f"S{k}", 100 * k + cell, k) for k in range(3) for case, cells in ((1, 8), (2, 2), (3, 4)) for cell in range(cells) if (cell + k) % 3 or case == 2]
    df = spark.createDataFrame(rows, "case_id int, cell int, status string, s int, event_id int").select("case_id", "cell", "status", F.timestamp_seconds("s").alias("ts"), "event_id")
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    sizes = []
    for k in range(3):
        df.where(F.col("event_id") == k).coalesce(1).write.mode("append").parquet(src)
        sizes += SC.run_review_state(spark.readStream.schema(df.schema).parquet(src), "case_id", "cell", "status", "ts", "event_id", out, ck).values()
    got = sorted((int(r["case"]), int(r["cell"]), r["status"], r["revisions"]) for r in SC.read_review_state(spark, out).collect())
    want = sorted((r["case_id"], r["cell"], r["status"], r["revisions"]) for r in SC.review_state(df, "case_id", "cell", "status", "ts", "event_id").collect())
    assert got == want and len(got) == 14
    assert SC.FEW_CELLS == 3 and max(sizes) < len(got) + 3  # a value for the first cells of a case, its opening, entries for the others


def test_nearest_in_rows_and_in_trees(spark, monkeypatch):
    """Groups that fit in a row are not cut into cells; those beyond either limit are, with the same answers."""
    from filamet.operators import spatial

    rng = np.random.default_rng(8)
    sizes = {1: (80, 30), 2: (300, 20), 3: (5, 90), 4: (0, 7), 5: (9, 0)}
    draw = lambda k: pd.concat([pd.DataFrame({"g": g, "x": rng.integers(-9, 9, n[k]) / 2, "y": rng.integers(-9, 9, n[k]) * 1.0}) for g, n in sizes.items()], ignore_index=True)
    refs = spark.createDataFrame(draw(0).assign(p=lambda d: [f"r{k}" for k in d.index]))
    queries = spark.createDataFrame(pd.concat([draw(1), pd.DataFrame({"g": [1, 1], "x": [0.0, -0.0], "y": [-0.0, 0.0]})]))
    trees, cell_tree = [], spatial.cell_tree
    monkeypatch.setattr(spatial, "cell_tree", lambda *a: trees.append(1) or cell_tree(*a))
    got = []
    for few in (10**6, 60, 0):  # all in rows, some in trees, all in trees
        monkeypatch.setattr(spatial, "FEW_REFS", few or 1, raising=False)
        monkeypatch.setattr(spatial, "FEW_LOCATIONS", few or 1, raising=False)
        out = spatial.nearest(queries, refs, ["g"], order=["p"], payload=["p"], radius=3.0).toPandas()
        got.append(out.sort_values(["g", "x", "y"]).reset_index(drop=True))
        assert len(trees) == (0 if few == 10**6 else 1)
        trees.clear()
    assert len(got[0]) > 80 and set(got[0].g) == {1, 2, 3}
    for other in got[1:]:
        pd.testing.assert_frame_equal(got[0], other[got[0].columns], check_exact=True)


def test_equalize_without_a_row_per_target(spark):
    """The target of a level is found in the row of the level; as the smallest of all errors, the lowest target on a tie."""
    from filamet.operators import pixels

    rng = np.random.default_rng(2)
    sizes = [1, 2, 64, 128, 500, 1000]
    rows = pd.concat([pd.DataFrame({"g": g, "u": np.clip(np.round(rng.normal(0.5, 0.3, n), rng.integers(1, 4)), 0, 1)}) for g, n in enumerate(sizes)], ignore_index=True)
    for targets in (64, 7):
        out = pixels.equalize(spark.createDataFrame(rows), ["g"], "u", targets=targets)
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r["g"], r["u"]): r["equalized"] for r in out.collect()}
        for g, p in rows.groupby("g"):
            level = np.rint(p.u * 255)
            n = level.value_counts().sort_index()
            own = np.where((n.index > 0) & (n.index < 255), n, 0)
            err = (np.arange(targets)[:, None] + 1) * (len(p) / targets) - n.cumsum().to_numpy() + own / 2
            err[err < -len(p) * 1.4901161193847656e-08] = len(p)
            lut = dict(zip(n.index, np.rint(err.argmin(axis=0) / (targets - 1) * 255) / 255))
            assert all(got[g, u] == lut[k] for u, k in zip(p.u, level))


def test_contents_are_hashed_once(spark, monkeypatch):
    """Ordering reads names and hashes again and again, but not what they are made of."""
    from filamet.sources import files

    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 40)
    hashed = spark.sparkContext.accumulator(0)

    def digest(i):
        hashed.add(1)
        return f"h{i * 31 % 100:03d}"

    f = spark.range(400).select(F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("filename"), F.udf(digest)("id").alias("sha256"))
    got = [(r["filename"], r["sha256"]) for r in files.number_cases(f).orderBy(F.length("case_id"), "case_id").collect()]
    assert got == sorted((f"f{i % 7}", f"h{i * 31 % 100:03d}") for i in range(400))
    assert hashed.value == 400


def test_blocks_of_small_groups_are_shuffled_once(spark, monkeypatch):
    """Rows of small groups are numbered in one window; in pieces the blocks hold the same rows."""
    from filamet.operators import plugins

    df = samples(spark).select("g", "m", "x")
    out = plugins.blocks(df, ["g"], 25)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = []
    for rows in (100_000, 30, 1):
        monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", rows)
        b = plugins.blocks(df, ["g"], 25).groupBy("g", "_block", "m", "x").agg(F.sum("_copies").alias("n"))
        got.append(sorted(tuple(r) for r in b.collect()))
    assert got[0] == got[1] == got[2] and sum(r[-1] for r in got[0]) == 353


def test_otsu_on_bins_with_pixels(spark):
    """No row per empty bin; empty bins count in the mean of the best ones all the same."""
    from filamet.operators import pixels

    rng = np.random.default_rng(6)
    groups = [np.r_[rng.normal(2, 1, 40), rng.normal(9, 1, 30)], np.full(5, 3.25), 1 + rng.random(30) * 1e-6, np.array([0.0, 1.0]), rng.random(300) * 255, np.array([-4.0, 7.0, 7.0])]
    df = spark.createDataFrame(pd.DataFrame({"g": np.repeat(np.arange(len(groups)), [len(v) for v in groups]), "v": np.concatenate(groups)}))
    out = pixels.otsu(df, ["g"], "v")
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["g"]: r["threshold"] for r in out.collect()}
    for g, v in enumerate(groups):
        n, edges = np.histogram(v, 256)
        c = (edges[:-1] + edges[1:]) / 2
        w, s = n.cumsum(), (n * c).cumsum()
        score = (w * (w[-1] - w) * (s / np.maximum(w, 1e-12) - (s[-1] - s) / np.maximum(w[-1] - w, 1e-12)) ** 2)[:-1]
        assert got[g] == pytest.approx(c[int(np.flatnonzero(score >= score.max() - 1e-5).mean())], rel=1e-12)
