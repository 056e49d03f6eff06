"""Row filters whose threshold comes from the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridstats.functions.columns import null_count, quoted
from gridstats.operators.quantiles import exact_median, exact_quantiles, feature_quantiles, melt, widen
from gridstats.operators.scalars import attach_scalars


def in_ranges(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Inclusive limits on several columns; null fails."""
    tests = []
    for name, (low, high) in ranges.items():
        if low is not None:
            tests.append(F.col(f"`{name}`") >= low)
        if high is not None:
            tests.append(F.col(f"`{name}`") <= high)
    return df.where(reduce(lambda a, b: a & b, tests))


def within_group_filter(df: DataFrame, group: str, value: str, *, max_deviation: float = 2.0,
                        min_n: int = 4) -> DataFrame:
    """Drop rows further than ``max_deviation`` from their group's median.

    Groups with fewer than ``min_n`` values, and rows without a group, are kept whole.
    """
    stats = exact_median(df.where(F.col(group).isNotNull()), [group], value, "__median").withColumnRenamed("n", "__n")
    joined = df.join(stats, group, "left")
    near = F.coalesce(F.abs(F.col(value) - F.col("__median")) <= max_deviation, F.lit(False))
    keep = F.col("__n").isNull() | (F.col("__n") < min_n) | near
    return joined.where(keep).select(*quoted(df.columns))


def stratified_iqr_filter(df: DataFrame, strata: Sequence[str], value: str, *, k: float = 3.5,
                          min_n: int = 20) -> DataFrame:
    """Drop rows outside q25 - k*IQR .. q75 + k*IQR of their own stratum.

    Small strata, strata without spread and rows with a null stratum are kept whole.
    """
    known = reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in strata])
    sizes = df.where(known).groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    q = exact_quantiles(df.where(known), strata, value, {"__q25": 0.25, "__q75": 0.75}).drop("n")
    limits = q.join(sizes, list(strata))
    limits = limits.where((F.col("__n") >= min_n) & (F.col("__q75") != F.col("__q25"))).select(
        *strata,
        (F.col("__q25") - k * (F.col("__q75") - F.col("__q25"))).alias("__lo"),
        (F.col("__q75") + k * (F.col("__q75") - F.col("__q25"))).alias("__hi"))
    joined = df.join(limits, list(strata), "left")
    outside = F.coalesce((F.col(value) < F.col("__lo")) | (F.col(value) > F.col("__hi")), F.lit(False))
    return joined.where(~outside).select(*quoted(df.columns))


def outlier_votes(df: DataFrame, features: Sequence[str], *, method: str = "iqr", threshold: float = 3.0,
                  min_values: int = 10, name: str = "votes") -> DataFrame:
    """Number of features in which a row is an outlier of the whole table."""
    if method == "iqr":
        stats = feature_quantiles(df, features, {"q25": 0.25, "q75": 0.75})
        stats = stats.where(F.col("n") >= min_values).select(
            "feature",
            (F.col("q25") - threshold * (F.col("q75") - F.col("q25"))).alias("lo"),
            (F.col("q75") + threshold * (F.col("q75") - F.col("q25"))).alias("hi"))
    elif method == "zscore":
        stats = melt(df, [], features).groupBy("feature").agg(
            F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
        stats = stats.where((F.col("n") >= min_values) & (F.col("s") > 0)).select(
            "feature", (F.col("m") - threshold * F.col("s")).alias("lo"), (F.col("m") + threshold * F.col("s")).alias("hi"))
    else:
        raise ValueError(f"unknown method {method!r}")
    marked = attach_scalars(df, widen(stats, features, ["lo", "hi"]), "__lim")

    def flag(f: str) -> Column:
        outside = (F.col(f) < F.col(f"__lim.{f}__lo")) | (F.col(f) > F.col(f"__lim.{f}__hi"))
        return F.coalesce(outside, F.lit(False)).cast("int")

    return marked.withColumn(name, reduce(lambda a, b: a + b, [flag(f) for f in features])).drop("__lim")


def outlier_vote_filter(df: DataFrame, features: Sequence[str], *, method: str = "iqr", threshold: float = 3.0,
                        min_features: int = 5, min_values: int = 10) -> DataFrame:
    """Drop rows that are outliers in at least ``min_features`` features."""
    voted = outlier_votes(df, features, method=method, threshold=threshold, min_values=min_values, name="__votes")
    return voted.where(F.col("__votes") < min_features).drop("__votes")


def sparse_row_filter(df: DataFrame, features: Sequence[str], *, most: float | None = 0.7,
                      limit: float | None = 0.4) -> DataFrame:
    """Drop rows that lack all, most or too many of the features."""
    k, missing = len(features), null_count(features)
    bad = missing == k
    if most is not None:
        bad = bad | (missing >= int(k * most))
    if limit is not None:
        bad = bad | (missing > int(k * limit))
    return df.where(~bad)


def min_group_size(df: DataFrame, group: str, min_n: int = 2) -> DataFrame:
    """Keep rows of groups with enough members; counts are combined before the shuffle."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") >= min_n) & F.col(group).isNotNull())
    return df.join(big.select(group), group, "left_semi")


def attrition(df: DataFrame, stages: Mapping[str, Column], group: str | None = None) -> DataFrame:
    """Rows and groups left after each stage of a filter cascade, counted in one pass.

    A row passes a stage when it passed all earlier ones and meets this stage's condition.
    Groups are counted through one (group) pre-aggregation rather than distinct sets.
    """
    passed, running = {"all": F.lit(True)}, F.lit(True)
    for name, condition in stages.items():
        running = running & F.coalesce(condition, F.lit(False))
        passed[name] = running
    flags = df.select(*([group] if group else []), *[p.cast("bigint").alias(f"p{i}") for i, p in enumerate(passed.values())])
    order = list(passed)
    if group:
        flags = flags.groupBy(group).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(order))])
    totals = flags.agg(
        *[F.sum(f"p{i}").alias(f"rows{i}") for i in range(len(order))],
        *[F.count_if((F.col(f"p{i}") > 0) & (F.col(group).isNotNull() if group else F.lit(True))).alias(f"groups{i}")
          for i in range(len(order))])
    rows = [F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.coalesce(F.col(f"rows{i}"), F.lit(0)).alias("n_rows"),
                     F.col(f"groups{i}").alias("n_groups")) for i, name in enumerate(order)]
    out = totals.select(F.inline(F.array(*rows)))
    return out if group else out.drop("n_groups")
