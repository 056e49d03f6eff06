"""Leakage-safe splits: whole groups go to one side. Draws come from a hash, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridstats.operators.quantiles import exact_median, select_ranks
from gridstats.operators.ranking import value_ranks
from gridstats.operators.scalars import attach_scalars
from gridstats.operators.summaries import quantile_bins
from gridstats.session import stored


def draw(group: str | Column, seed: int) -> Column:
    """Reproducible number in [0, 1) for a group id."""
    g = F.col(group) if isinstance(group, str) else group
    return F.shiftrightunsigned(F.xxhash64(g, F.lit(seed)), 11) / F.lit(float(1 << 53))


def stratified_groups(df: DataFrame, group: str, label: str, *, strata: int = 5) -> DataFrame:
    """One row per group: median label and its quantile stratum.

    The medians are materialised once; edges and draws read them again and again.
    """
    medians = stored(exact_median(df.where(F.col(group).isNotNull()), [group], label, "median_label").drop("n"))
    return quantile_bins(medians, "median_label", strata, "stratum")


def draw_groups(groups: DataFrame, group: str, share: float, seed: int, stratum: str | None = "stratum",
                name: str = "held_out") -> DataFrame:
    """Mark ceil(share * n) groups of every stratum, those with the smallest draws.

    The cut-off draw of a stratum is an exact order statistic, so no stratum is sorted in one task.
    """
    keys = [stratum] if stratum else []
    drawn = groups.withColumn("__u", draw(group, seed))
    cut = select_ranks(drawn, keys, "__u", {"__cut": lambda n: F.ceil(n * F.lit(share)) - 1}).drop("n")
    if keys:
        # At most one row per stratum, and strata are few by construction.
        joined = drawn.join(F.broadcast(cut), keys, "left")
        return joined.withColumn(name, F.coalesce(F.col("__u") <= F.col("__cut"), F.lit(False))).drop("__u", "__cut")
    joined = attach_scalars(drawn, cut, "__c")
    return joined.withColumn(name, F.col("__u") <= F.col("__c.__cut")).drop("__u", "__c")


def train_test_groups(df: DataFrame, group: str, label: str, *, test_share: float = 0.2, strata: int = 5,
                      seed: int = 1) -> DataFrame:
    """Rows with a boolean ``is_test``: groups drawn per stratum of their median label."""
    groups = draw_groups(stratified_groups(df, group, label, strata=strata), group, test_share, seed, name="is_test")
    return df.join(stored(groups.select(group, "is_test")), group, "inner")


def train_fit_calibration_groups(groups: DataFrame, group: str, *, share: float = 0.25, seed: int = 2,
                                 min_per_stratum: int = 2) -> DataFrame:
    """Second draw among training groups for calibration; unstratified when a stratum is too small."""
    smallest = groups.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).first()["n"]
    stratum = "stratum" if smallest is not None and smallest >= min_per_stratum else None
    return draw_groups(groups, group, share, seed, stratum, name="is_calibration")


def group_folds(df: DataFrame, group: str, k: int, *, seed: int = 0, name: str = "fold") -> DataFrame:
    """Fold number per row, groups whole, sizes balanced by dealing groups out from large to small."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    sizes = stored(sizes.withColumn("__size", -(F.col("__n") + draw(group, seed))))
    ranked = value_ranks(sizes, [], "__size").select("__size", (F.ceil("avg_rank") - 1).alias("__rank"))
    turn = F.col("__rank") % (2 * k)
    fold = F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int")
    # One small row per group, of a size that the planner knows: the rows need not move to meet it.
    folds = stored(sizes.join(ranked, "__size").select(group, fold.alias(name)))
    return df.join(folds, group, "inner")
