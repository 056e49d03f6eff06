"""Regression skill: global, per group, and aggregated over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridstats.functions.columns import clip
from gridstats.operators.quantiles import exact_quantiles, melt, weighted_median
from gridstats.operators.ranking import empirical_cdf
from gridstats.operators.scalars import attach_scalars
from gridstats.session import cut_lineage

METRICS = ("r2", "rmse", "mae", "mape", "smpe", "rmsle", "relative_error", "mean_bias", "abs_norm_bias",
           "pbias", "log_bias", "nse", "kge", "rrmse")
FLOOR = 1e-12


def skill_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = (), min_n: int = 1) -> DataFrame:
    """The whole metric set per group as one aggregate plus one exact median.

    A group whose actual values do not vary has null r2, nse and kge. ``mape``/``smpe`` leave out
    zero actual values. Positive floors apply only inside the logarithmic metrics.
    """
    keys = list(keys)
    y, p = F.col("__y"), F.col("__p")
    base = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(
        *keys, F.col(actual).cast("double").alias("__y"), F.col(predicted).cast("double").alias("__p"))
    base = base.withColumn("__d", p - y)
    base = base.withColumn("__l", F.log10(clip(p, lower=FLOOR) / clip(y, lower=FLOOR))).withColumn("__al", F.abs("__l"))
    relative = F.try_divide(F.col("__d"), y)
    sums = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(F.col("__d") * F.col("__d")).alias("mse"),
        F.avg(F.abs("__d")).alias("mae"),
        F.avg(F.abs(relative)).alias("mape"),
        (F.avg(relative) * 100).alias("smpe"),
        F.sqrt(F.avg(F.pow(F.ln(clip(p, lower=FLOOR)) - F.ln(clip(y, lower=FLOOR)), 2.0))).alias("rmsle"),
        F.avg("__d").alias("mean_bias"),
        F.avg(y).alias("my"), F.avg(p).alias("mp"),
        F.var_pop(y).alias("vy"), F.stddev_pop(y).alias("sy"), F.stddev_pop(p).alias("sp"),
        F.corr(y, p).alias("r"),
        F.pow(F.lit(10.0), F.avg("__l")).alias("log_bias"),
    ).where(F.col("n_samples") >= min_n)
    typical = exact_quantiles(base, keys, "__al", {"__med": 0.5}).drop("n")
    if keys:
        joined = sums.join(typical, keys)
    else:
        joined = attach_scalars(sums, typical, "__t").withColumn("__med", F.col("__t.__med"))
    skill = F.when(F.col("vy") > 0, 1 - F.col("mse") / F.col("vy"))
    kge = F.when((F.col("vy") > 0) & (F.col("my") != 0), 1 - F.sqrt(
        F.pow(F.col("r") - 1, 2.0)
        + F.pow(F.try_divide(F.col("sp"), F.col("sy")) - 1, 2.0)
        + F.pow(F.try_divide(F.col("mp"), F.col("my")) - 1, 2.0)))
    return joined.select(
        *keys,
        skill.alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "mape", "smpe", "rmsle",
        (F.pow(F.lit(10.0), F.col("__med")) - 1).alias("relative_error"),
        "mean_bias",
        F.try_divide(F.abs("mean_bias"), F.col("my")).alias("abs_norm_bias"),
        (F.try_divide(F.col("mean_bias"), F.col("my")) * 100).alias("pbias"),
        "log_bias", skill.alias("nse"), kge.alias("kge"),
        F.try_divide(F.sqrt("mse"), F.col("my")).alias("rrmse"), "n_samples")


def group_counts(df: DataFrame, group: str, min_n: int) -> DataFrame:
    """How many groups exist, qualify by size, and are left out."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") >= min_n).alias("n_kept"),
                     F.count_if(F.col("n") < min_n).alias("n_excluded"))


def aggregate_over_groups(per_group: DataFrame, metrics: Sequence[str] = METRICS, weight: str = "n_samples") -> DataFrame:
    """Mean, median, spread and size-weighted mean and median of each metric over groups.

    The per-group rows are materialised once: the medians below look at them several times.
    """
    long = melt(cut_lineage(per_group), [weight], metrics, name="metric").where(F.col("value").isNotNull())
    plain = long.groupBy("metric").agg(
        F.avg("value").alias("unweighted_mean"), F.stddev_pop("value").alias("unweighted_std"),
        F.try_divide(F.sum(F.col("value") * F.col(weight)), F.sum(weight)).alias("weighted_mean"),
        F.count(F.lit(1)).alias("n_groups"))
    q = exact_quantiles(long, ["metric"], "value", {"unweighted_median": 0.5, "p25": 0.25, "p75": 0.75})
    wm = weighted_median(long, ["metric"], "value", weight)
    return plain.join(q.drop("n"), "metric").join(wm, "metric")


def metric_cdf(per_group: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Cumulative distribution over groups of each metric."""
    return empirical_cdf(melt(per_group, [], metrics, name="metric"), ["metric"], "value")


def deltas_to_baseline(results: DataFrame, baseline: DataFrame, key: str, metrics: Sequence[str],
                       higher_is_better: Sequence[str], tolerance: float = 0.001) -> DataFrame:
    """Difference of each metric to the one baseline row, with hurt/helped/same markers."""
    one = baseline.agg(*[F.max(m).alias(m) for m in metrics])
    marked = attach_scalars(results, one, "__b")
    out = [F.col(key)]
    for m in metrics:
        d = F.col(m) - F.col(f"__b.{m}")
        gain = d if m in higher_is_better else -d
        out += [d.alias(f"delta_{m}"),
                F.when(gain < -tolerance, "hurt").when(gain > tolerance, "helped").otherwise("same").alias(f"mark_{m}")]
    return marked.select(*out)
