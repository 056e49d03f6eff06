"""Cumulative totals, ranks and distribution comparisons without a single-task window.

Rows are first collapsed to distinct values, so ties and copies cost nothing. The distinct values
move once more, into sorted ranges, and sums run along the ranges (``operators/ranges.py``), whatever
the size and the spread of a group. NaN counts as null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridstats.operators.quantiles import _same, melt, present
from gridstats.operators.ranges import running_sums
from gridstats.operators.scalars import attach_scalars


def running_totals(df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """Per (keys, distinct value): each measure, ``<m>_before`` (smaller values) and ``<m>_total``."""
    keys, names = list(keys), list(measures)
    distinct = (
        df.where(present(value))
        .groupBy(*keys, F.col(value).cast("double").alias(value))
        .agg(*[expr.alias(m) for m, expr in measures.items()])
    )
    totals = distinct.groupBy(*keys).agg(*[F.sum(m).alias(f"{m}_total") for m in names])
    rows = running_sums(distinct, keys, value, names)
    # Nothing to join on without groups: the totals are one row.
    return _same(rows, totals, keys, []) if keys else attach_scalars(rows, totals, "__t").select("*", "__t.*").drop("__t")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per distinct value: ``n_equal``, average rank (1-based), ``cume_dist`` and group size."""
    t = running_totals(df, keys, value, {"n": F.count(F.lit(1))})
    return t.select(
        *keys, value,
        F.col("n").alias("n_equal"),
        (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank"),
        ((F.col("n_before") + F.col("n")) / F.col("n_total")).alias("cume_dist"),
        F.col("n_total").alias("n_group"))


def empirical_cdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of the group at or below each distinct value."""
    return value_ranks(df, keys, value).select(*keys, value, "n_equal", F.col("cume_dist").alias("cdf"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ties, per group, and the number of complete pairs."""
    keys = list(keys)
    pairs = (
        df.where(present(x) & present(y))
        .groupBy(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
        .agg(F.count(F.lit(1)).alias("w"))
    )

    def centred(v: str, name: str) -> DataFrame:
        t = running_totals(pairs, keys, v, {"n": F.sum("w")})
        return t.select(*keys, v, (F.col("n_before") + (F.col("n") + 1) / 2 - (F.col("n_total") + 1) / 2).alias(name))

    ranked = _same(_same(pairs, centred("__x", "dx"), keys, ["__x"]), centred("__y", "dy"), keys, ["__y"])
    w, dx, dy = F.col("w"), F.col("dx"), F.col("dy")
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy))).alias("rho"),
        F.sum("w").alias("n"))


KOLMOGOROV_TERMS = 100


def kolmogorov_sf(argument: Column) -> Column:
    """Limiting survival function of the scaled maximum distance."""
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
        * F.exp(F.lit(-2.0) * k.cast("double") * k.cast("double") * argument * argument))
    total = F.lit(2.0) * F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(argument < 0.05, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(left: DataFrame, right: DataFrame, features: Sequence[str]) -> DataFrame:
    """Largest gap between the two samples' distributions, per feature, with asymptotic p-value."""
    both = melt(left, [], features).withColumn("side", F.lit(0)).unionByName(
        melt(right, [], features).withColumn("side", F.lit(1)))
    t = running_totals(both, ["feature"], "value", {
        "a": F.count_if(F.col("side") == 0), "b": F.count_if(F.col("side") == 1)})
    gap = F.abs((F.col("a_before") + F.col("a")) / F.col("a_total") - (F.col("b_before") + F.col("b")) / F.col("b_total"))
    stats = t.where((F.col("a_total") > 0) & (F.col("b_total") > 0)).groupBy("feature").agg(
        F.max(gap).alias("ks"), F.max("a_total").alias("n_left"), F.max("b_total").alias("n_right"))
    effective = F.sqrt(F.col("n_left") * F.col("n_right") / (F.col("n_left") + F.col("n_right")))
    return stats.withColumn("p_value", kolmogorov_sf(effective * F.col("ks")))
