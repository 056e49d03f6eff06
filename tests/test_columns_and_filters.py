"""Small hand-computed cases for expressions, filters and joins."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridstats.functions import binning, columns as c, units
from gridstats.operators import dedup, joins, outliers
from gridstats.operators.features import apply_ordinal, fit_ordinal, interaction_terms, months_to_rows


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_two_digit_years_and_bad_dates(spark):
    df = one(spark, "d string", ("3/5/75",), ("12/31/68",), ("1/1/69",), ("07/04/24",), ("soon",), (None,))
    got = [r[0] for r in df.select(c.lenient_date("d", two_digit_year=True)).collect()]
    assert got == [dt.date(1975, 3, 5), dt.date(2068, 12, 31), dt.date(1969, 1, 1), dt.date(2024, 7, 4), None, None]


def test_codes_never_lose_characters(spark):
    got = [r[0] for r in one(spark, "s string", ("101",), ("123456789",), (None,)).select(c.zero_pad("s", 8)).collect()]
    assert got == ["00000101", "123456789", None]


def test_clip_keeps_null_and_numbers_parse(spark):
    df = one(spark, "x double, s string", (None, "NaN"), (-2.0, "1.5"), (9.0, "x"))
    got = [tuple(r) for r in df.select(c.clip("x", 0.0, 5.0), c.number_or("s", F.lit(7.0))).collect()]
    assert got == [(None, 7.0), (0.0, 1.5), (5.0, 7.0)]


def test_cut_is_right_closed_with_lowest(spark):
    df = one(spark, "x double", *[(v,) for v in (-1.0, 0.0, 5.0, 5.1, 10.0, 10.1)])
    assert [r[0] for r in df.select(binning.cut("x", [0, 5, 10])).collect()] == [None, 0, 0, 1, 1, None]


def test_order_codes_follow_the_values(spark):
    values = sorted([-1e12, -3.0, -2.9999999, -1e-15, 0.0, 1e-15, 1e-6, 1.0, 1.0000001, 7e20])
    codes = [r[0] for r in one(spark, "x double", *[(v,) for v in values]).select(binning.order_code("x")).collect()]
    assert codes == sorted(codes)


def test_constants(spark):
    assert units.henry_constant(25.0) == pytest.approx(0.034)
    row = spark.range(1).select(units.cell_area_m2(F.lit(0.0)), units.water_temperature(F.array(*[F.lit(-40.0)] * 12))).first()
    assert row[0] == pytest.approx((6_371_000 * math.radians(0.1)) ** 2, rel=1e-6) and row[1] == 0.1


def test_within_group_filter_exempts_small_groups(spark):
    rows = [("w", float(v)) for v in (0.0, 0.1, 0.2, 9.0)] + [("s", 0.0), ("s", 50.0), ("s", 99.0), (None, 5.0), ("w", None)]
    kept = outliers.within_group_filter(one(spark, "g string, v double", *rows), "g", "v", max_deviation=2.0, min_n=4)
    got = sorted(kept.collect(), key=str)
    assert len(got) == 3 + 3 + 1


def test_stratified_filter_skips_small_and_flat_strata(spark):
    wide = [("big", float(i)) for i in range(20)] + [("big", 500.0)]
    flat = [("flat", 1.0)] * 24 + [("flat", 2.0)]
    small = [("small", float(i)) for i in range(18)] + [("small", 900.0)]
    df = one(spark, "s string, v double", *wide, *flat, *small, (None, 1e6))
    got = outliers.stratified_iqr_filter(df, ["s"], "v").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"big": 20, "flat": 25, "small": 19, None: 1}


def test_outlier_votes_need_enough_values(spark):
    rows = [(float(i % 7), float(i % 5), None if i > 5 else 1e9) for i in range(40)] + [(999.0, 999.0, None)]
    df = one(spark, "a double, b double, c double", *rows)
    assert outliers.outlier_vote_filter(df, ["a", "b", "c"], min_features=2).count() == 40


def test_keep_first_is_idempotent(spark):
    df = one(spark, "k string, o int, v string", ("a", 2, "x"), ("a", 1, "y"), ("a", 1, "b"), (None, 1, "n"), (None, 0, "m"))
    first = dedup.keep_first(df, ["k"], ["o"])
    assert sorted(first.collect(), key=str) == sorted(dedup.keep_first(first, ["k"], ["o"]).collect(), key=str)
    assert {tuple(r) for r in first.collect()} == {("a", 1, "b"), (None, 0, "m")}


def test_suffixes_and_null_keys(spark):
    left = one(spark, "k string, v int", ("a", 1), (None, 2))
    right = one(spark, "k string, v int, w int", ("a", 3, 4), (None, 5, 6))
    safe = joins.suffix_join(left, right, ["k"], null_safe=True)
    assert safe.columns == ["k", "v_x", "v_y", "w"]
    assert {tuple(r) for r in safe.collect()} == {("a", 1, 3, 4), (None, 2, 5, 6)}
    assert {tuple(r) for r in joins.suffix_join(left, right, ["k"]).collect()} == {("a", 1, 3, 4), (None, 2, None, None)}


def test_grid_sampling_takes_the_nearer_node_and_bounds(spark):
    grid = one(spark, "lat double, lon double, v double", (0.0, 0.0, -3.0), (0.0, 1.0, 5.0), (1.0, 0.0, 7.0), (1.0, 1.0, 9.0))
    points = one(spark, "id int, lat double, lon double", (1, 0.4, 0.6), (2, 0.6, 0.4), (3, 0.1, 0.1), (4, 1.2, 0.0), (5, 0.5, 1.0))
    got = {r["id"]: r["v"] for r in joins.sample_grid(points, grid, lat="lat", lon="lon", value="v", step=1.0).collect()}
    assert got == {1: 5.0, 2: 7.0, 3: 0.0, 4: None, 5: 5.0}


def test_disjoint_groups(spark):
    a, b = one(spark, "g int", (1,), (2,)), one(spark, "g int", (3,))
    joins.assert_disjoint(a, b, "g")
    with pytest.raises(ValueError):
        joins.assert_disjoint(a, a, "g")


def test_interactions_chain_and_absent_inputs(spark):
    df = interaction_terms(one(spark, "a double, b double", (3.0, 4.0)), [
        ("p", "a", "b", "multiply"), ("s", "p", None, "square"), ("r", "a", "b", "ratio"), ("x", "a", "zz", "multiply")])
    row = df.first()
    assert (row["p"], row["s"], row["r"], row["x"]) == (12.0, 144.0, 0.3, None)


def test_ordinal_unknown_and_missing(spark):
    codes = fit_ordinal(one(spark, "c string", ("b",), ("a",), (None,)), "c")
    got = {r["c"]: r["e"] for r in apply_ordinal(one(spark, "c string", ("a",), ("b",), ("z",), (None,)), codes, "c", "e").collect()}
    assert got == {"a": 1, "b": 2, "z": -1, None: 0}  # the label Missing sorts before lower case


def test_months_to_rows(spark):
    wide = one(spark, "k int, " + ", ".join(f"v{m:02d} double" for m in range(1, 13)), (1, *[float(m) for m in range(12)]))
    rows = months_to_rows(wide, ["k"], ["v", "absent"]).collect()
    assert [(r["month"], r["v"], r["absent"]) for r in rows] == [(m, float(m - 1), None) for m in range(1, 13)]
