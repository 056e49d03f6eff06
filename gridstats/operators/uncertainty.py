"""Intervals, propagated standard errors and ratios with bounds."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridstats.functions.columns import ColumnLike, col, ratio
from gridstats.functions.units import Z_90, Z_95
from gridstats.operators.quantiles import exact_quantiles, feature_quantiles, select_ranks, widen
from gridstats.operators.scalars import attach_scalars
from gridstats.session import stored


def half_width(low: ColumnLike, high: ColumnLike) -> Column:
    return (col(high) - col(low)) / 2


def quadrature(value: ColumnLike) -> Column:
    """Root of the sum of squares: independent errors."""
    v = col(value)
    return F.sqrt(F.sum(v * v))


def two_level_sigma(df: DataFrame, outer: Sequence[str], inner: str, sigma: str) -> DataFrame:
    """Errors add linearly within inner groups and in quadrature across them.

    ``sigma_block`` is the two-level result, ``sigma_linear`` the pessimistic linear sum.
    """
    blocks = df.groupBy(*outer, inner).agg(F.coalesce(F.sum(sigma), F.lit(0.0)).alias("__s"))
    return blocks.groupBy(*outer).agg(quadrature("__s").alias("sigma_block"), F.sum("__s").alias("sigma_linear"))


def rescale_interval(central: ColumnLike, low: ColumnLike, high: ColumnLike,
                     factor: float = Z_90 / Z_95) -> tuple[Column, Column]:
    """Shrink a half-width by a factor and centre it on the estimate."""
    half = half_width(low, high) * F.lit(factor)
    return col(central) - half, col(central) + half


def ratio_with_bounds(num: tuple[ColumnLike, ColumnLike, ColumnLike],
                      den: tuple[ColumnLike, ColumnLike, ColumnLike], scale: float = 100.0) -> tuple[Column, Column, Column]:
    """(central, lower, upper) of a ratio: the lower bound divides by the upper denominator and vice versa."""
    return (ratio(num[0], den[0], scale), ratio(num[1], den[2], scale), ratio(num[2], den[1], scale))


def scale_by_total(df: DataFrame, central: str, sigma: str, z: float = Z_90, prefix: str = "") -> DataFrame:
    """Per-row bounds that keep the pattern of the estimate and the interval of its total.

    The total's error is the quadrature sum of the rows' errors; its lower bound stops at zero.
    """
    totals = df.agg(F.sum(central).alias("t"), quadrature(sigma).alias("s"))
    lo = F.greatest(F.col("__t.t") - z * F.col("__t.s"), F.lit(0.0))
    hi = F.col("__t.t") + z * F.col("__t.s")
    marked = attach_scalars(df, totals, "__t")
    return marked.withColumns({
        f"{prefix}lower": F.when(F.col("__t.t") > 0, F.col(central) * lo / F.col("__t.t")),
        f"{prefix}upper": F.when(F.col("__t.t") > 0, F.col(central) * hi / F.col("__t.t"))}).drop("__t")


def apportion(df: DataFrame, value: str, total_error: float, name: str = "error") -> DataFrame:
    """Split a published total error over rows in proportion to their value, with bounds."""
    totals = df.agg(F.sum(value).alias("t"))
    marked = attach_scalars(df, totals, "__t").withColumn("share", F.try_divide(F.col(value), F.col("__t.t")))
    return marked.withColumn(name, F.col("share") * total_error).withColumns({
        "lower": F.col(value) - F.col(name), "upper": F.col(value) + F.col(name),
        "relative_error_pct": F.try_divide(F.lit(total_error), F.col("__t.t")) * 100}).drop("__t")


def conformal_radii(residuals: DataFrame, residual: str, levels: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Split-conformal radius per level: rows (keys, level, radius, n).

    The radius is the interpolated quantile of the absolute residuals at
    ``min(ceil((n + 1) * level) / n, 1)``; larger levels never have smaller radii.
    """
    def position(level: float):
        def at(n: Column) -> Column:
            share = F.least(F.ceil((n + 1) * F.lit(float(level))) / n, F.lit(1.0))
            return (n - 1) * share
        return at

    ranks = {}
    for i, level in enumerate(levels):
        ranks[f"lo{i}"] = lambda n, at=position(level): F.floor(at(n))
        ranks[f"hi{i}"] = lambda n, at=position(level): F.ceil(at(n))
    picked = select_ranks(residuals, keys, residual, ranks)
    rows = []
    for i, level in enumerate(levels):
        at = position(level)(F.col("n"))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        rows.append(F.struct(F.lit(float(level)).alias("level"), (lo + (hi - lo) * (at - F.floor(at))).alias("radius")))
    return picked.select(*keys, "n", F.inline(F.array(*rows)))


def radii_row(radii: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Radii as one row with a column ``r<percent>`` per level."""
    return radii.agg(*[F.max(F.when(F.col("level") == float(lv), F.col("radius"))).alias(f"r{percent(lv)}") for lv in levels])


def percent(level: float) -> int:
    return int(level * 100 + 1e-9)


def log_intervals(log_prediction: ColumnLike, radius: Mapping[int, ColumnLike]) -> dict[str, Column]:
    """Prediction and bounds on the original scale from a log prediction, as floats."""
    z = col(log_prediction)
    out = {"predicted": F.exp(z).cast("float")}
    for pct, r in sorted(radius.items()):
        out[f"lower_{pct}"] = F.exp(z - col(r)).cast("float")
        out[f"upper_{pct}"] = F.exp(z + col(r)).cast("float")
    return out


def radius_span(radius: ColumnLike) -> dict[str, Column]:
    """Factor and orders of magnitude an interval of this log radius spans."""
    r = col(radius)
    return {"multiplier": F.exp(r), "decades": F.lit(2.0) * r / F.lit(math.log(10.0))}


def coverage(df: DataFrame, actual: str, predicted: str, low: str, high: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of truths inside the bounds, misses, median width and median relative width.

    The scored rows are stored once, since shares and medians both read them.
    """
    keys, widths = list(keys), ["__w", "__rw"]
    base = stored(df.select(
        *keys, F.col(actual).between(F.col(low), F.col(high)).alias("__in"),
        (F.col(high) - F.col(low)).alias("__w"),
        F.try_divide(F.col(high) - F.col(low), F.col(predicted)).alias("__rw")))
    share = base.groupBy(*keys).agg(
        F.count("__in").alias("n"), F.avg(F.col("__in").cast("double")).alias("coverage"), F.count_if(~F.col("__in")).alias("n_missed"))
    medians = widen(feature_quantiles(base, widths, {"median": 0.5}, keys), widths, ["median"], keys)
    medians = medians.withColumnsRenamed({"__w__median": "median_width", "__rw__median": "median_relative_width"})
    if keys:
        return share.join(medians, keys)
    return attach_scalars(share, medians, "__m").select("n", "coverage", "n_missed", "__m.*")


def residual_summary(df: DataFrame, residual: str) -> DataFrame:
    """Mean, median, population deviation and upper quantiles of residuals."""
    basic = df.agg(F.avg(residual).alias("mean"), F.stddev_pop(residual).alias("std"), F.count(residual).alias("n"))
    q = exact_quantiles(df, [], residual, {"median": 0.5, "p90": 0.9, "p95": 0.95}).drop("n")
    return attach_scalars(basic, q, "q").select("mean", "std", "n", "q.*")
