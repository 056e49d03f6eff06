"""Exact quantiles, ranks and weighted medians against numpy, at any group size and range."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridstats.functions.binning import order_code, part_code
from gridstats.operators import quantiles, ranges
from gridstats.operators.quantiles import exact_quantiles, select_ranks, weighted_median
from gridstats.operators.ranking import ks_two_sample, spearman, value_ranks
from gridstats.operators.summaries import quantile_bins

FEW = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
VALUES = st.lists(st.one_of(st.floats(-1e9, 1e9), st.sampled_from([0.0, 1.0, -1.0, 1e-13, 5.5])), min_size=1, max_size=40)


def frame(spark, values, group="a"):
    return spark.createDataFrame([(group, float(v)) for v in values] + [(group, None)], "g string, x double")


def test_skewed_groups(spark):
    rng = np.random.default_rng(3)
    data = {"hot": np.round(rng.lognormal(2, 3, 600), 2), "one": np.array([4.0]), "tied": np.array([2.0] * 30), None: rng.normal(size=9)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    probs = {"lo": 0.02, "mid": 0.5, "hi": 0.97, "top": 1.0}
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", probs).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k]["n"] == len(vs)
        for name, q in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, q), rel=1e-12)


@FEW
@given(values=VALUES)
def test_global_quantiles(spark, values):
    row = exact_quantiles(frame(spark, values), [], "x", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.9)):
        assert row[name] == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-9)


def test_rank_selection_by_group_size(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", float(i)) for i in range(4)], "g string, x double")
    got = {r["g"]: r["k"] for r in select_ranks(df, ["g"], "x", {"k": lambda n: n / 2}).collect()}
    assert got == {"a": 5.0, "b": 2.0}


@FEW
@given(values=VALUES, seed=st.integers(0, 99))
def test_weighted_median(spark, values, seed):
    weights = np.random.default_rng(seed).integers(1, 9, len(values))
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, weights)], "x double, w int")
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    want = np.array(values)[order][np.searchsorted(total, total[-1] / 2)]
    assert weighted_median(df, [], "x", "w").first()[0] == want


@FEW
@given(values=VALUES)
def test_average_ranks(spark, values):
    got = {r["x"]: r["avg_rank"] for r in value_ranks(frame(spark, values), [], "x").collect()}
    v = np.array(values)
    for x in set(values):
        assert got[x] == (v < x).sum() + ((v == x).sum() + 1) / 2


def test_rank_correlation_and_distribution_distance(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=200), 1), np.round(rng.normal(size=200), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    row = spearman(df, [], "x", "y").first()
    assert row["rho"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1]) and row["n"] == 200
    ks = ks_two_sample(df.select("x"), df.select((df.y + 0.5).alias("x")), ["x"]).first()["ks"]
    grid = np.concatenate([x, y + 0.5])
    assert ks == pytest.approx(max(abs((x <= g).mean() - (y + 0.5 <= g).mean()) for g in grid))


@FEW
@given(values=st.lists(st.integers(-5, 5), min_size=2, max_size=40))
def test_quantile_bins_are_monotone(spark, values):
    rows = sorted((r["x"], r["bin"]) for r in quantile_bins(frame(spark, values).dropna(), "x", 5).collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert len({b for _, b in rows}) <= 5
    for x in set(values):
        assert len({b for v, b in rows if v == x}) == 1


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("a", None)], "g string, x double")
    row = exact_quantiles(df, ["g"], "x", {"mid": 0.5}).first()
    assert (row["n"], row["mid"]) == (2, 2.0)
    assert exact_quantiles(df, [], "x", {"mid": 0.5}).first()["mid"] == 2.0
    assert sorted(r["x"] for r in value_ranks(df, ["g"], "x").collect()) == [1.0, 3.0]


@pytest.mark.parametrize("low,width", [(1e6, 1.0), (0.0, 1e-18), (0.0, 1e-306), (-273.15, 1e-7)])
def test_narrow_ranges_are_cut_into_small_windows(spark, low, width):
    values = low + np.arange(20_000) / 20_000 * width
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, [], "x", {"a": 0.1, "b": 0.5, "c": 1.0}).first()
    for name, q in (("a", 0.1), ("b", 0.5), ("c", 1.0)):
        assert got[name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=0)
    ranks = value_ranks(df, [], "x").toPandas().sort_values("x")
    assert np.array_equal(ranks["x"], np.unique(values)) and ranks["avg_rank"].max() >= len(values) - 1
    cells = df.distinct().groupBy(order_code("x").alias("c")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    parts = df.distinct().join(cells, order_code("x") == F.col("c")).groupBy("c", part_code("x", "lo", "hi")).count()
    assert parts.agg(F.max("count")).first()[0] <= 8


@pytest.mark.parametrize("rows", [None, 2000, 100])
def test_running_sums_over_ranges(spark, monkeypatch, rows):
    """One group of most rows, many small ones, null keys; several ranges and Arrow batches."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 150)
    rng = np.random.default_rng(8)
    keys = ["hot"] * 1500 + [f"k{i % 90}" for i in range(400)] + [None] * 100
    data = [(k, float(i % 3) if k else None, i * 0.5, int(n), float(n) / 4) for i, (k, n) in enumerate(zip(keys, rng.integers(0, 9, len(keys))))]
    frame = spark.createDataFrame(data, "g string, h double, x double, n long, w double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = ranges.running_sums(frame, ["g", "h"], "x", ["n", "w"], rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(data)
    sums = {}
    for r in sorted(got, key=lambda r: r["x"]):
        assert (r["n_before"], r["w_before"]) == sums.get((r["g"], r["h"]), (0, 0))
        n, w = sums.get((r["g"], r["h"]), (0, 0))
        sums[r["g"], r["h"]] = (n + r["n"], w + r["w"])


def test_quantiles_of_groups_larger_than_a_sketch(spark):
    frame = spark.range(300_000).select((F.col("id") % 7 == 0).alias("g"), (F.rand(5) * F.rand(6)).alias("x"), F.lit(0).alias("total")).cache()
    got = {r["g"]: r for r in exact_quantiles(frame, ["g"], "x", {"a": 0.001, "b": 0.5, "c": 0.999}).collect()}
    for g in (True, False):
        x = np.array([r["x"] for r in frame.where(F.col("g") == g).collect()])
        assert [got[g][k] for k in "abc"] == pytest.approx(np.quantile(x, [0.001, 0.5, 0.999]), rel=1e-12)


def test_groups_that_a_sketch_would_hold_are_not_sketched(spark, monkeypatch):
    """only groups larger than a sketch get brackets; null keys and small groups beside large ones stay exact."""
    rows = spark.range(9_000).select(F.when(F.col("id") < 5_000, "large").when(F.col("id") < 8_999, "small").alias("g"), F.hash("id").cast("double").alias("x"))
    got = {r["g"]: r for r in exact_quantiles(rows, ["g"], "x", {"a": 0.1, "b": 0.5}).collect()}
    values = {}
    for r in rows.collect():
        values.setdefault(r["g"], []).append(r["x"])
    assert set(got) == set(values) == {"large", "small", None}
    for g, x in values.items():
        assert got[g]["n"] == len(x) and [got[g]["a"], got[g]["b"]] == pytest.approx(np.quantile(x, [0.1, 0.5]), rel=1e-12)
    monkeypatch.setattr(quantiles, "_brackets", lambda *a: pytest.fail("small groups were sketched"))
    assert exact_quantiles(rows.where("g = 'small'"), ["g"], "x", {"b": 0.5}).first()["b"] == got["small"]["b"]


def test_columns_side_by_side(spark, monkeypatch):
    """whole columns take one pass each for brackets and ranks, and their rows are not multiplied by the columns for sketches."""
    rows = spark.range(20_000).select(F.hash("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(None).cast("double").alias("c"),
                                      F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(-F.col("id")).alias("d"))
    monkeypatch.setattr(quantiles, "melt", lambda *a, **k: pytest.fail("rows were multiplied"))
    got = {r["feature"]: r for r in quantiles.feature_quantiles(rows, ["a", "b", "c", "d"], {"p": 0.01, "q": 0.5, "r": 1.0}).collect()}
    held = rows.toPandas()
    assert set(got) == {"a", "b", "d"}
    for f in got:
        x = held[f].dropna().to_numpy()
        assert got[f]["n"] == len(x) and [got[f][k] for k in "pqr"] == pytest.approx(np.quantile(x, [0.01, 0.5, 1.0]), rel=1e-12)
    assert quantiles.feature_quantiles(rows.where("false"), ["a", "b"], {"p": 0.5}).count() == 0
