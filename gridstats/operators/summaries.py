"""Descriptive aggregates: grids, histograms, hexagons, box plots, running medians."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridstats.functions.binning import edge_bin, hex_cell, width_bin
from gridstats.functions.columns import safe_log10
from gridstats.operators.quantiles import (_same, exact_median, exact_quantiles, feature_quantiles, melt, present)
from gridstats.operators.scalars import attach_scalars, literal_row


def value_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """count, nulls, distinct, mean, std, min, quartiles and max per column, one row each."""
    long = melt(df, [], features)
    distinct = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    distinct = distinct.groupBy("feature").agg(F.count("value").alias("n_distinct"))
    basic = long.groupBy("feature").agg(
        F.count("value").alias("n_values"), F.count_if(F.col("value").isNull()).alias("n_null"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = feature_quantiles(df, features, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    return basic.join(distinct, "feature").join(q, "feature", "left")


def aggregate_to_grid(df: DataFrame, cell: Sequence[str], value: str, agg: str = "mean") -> DataFrame:
    """One value per cell; ``agg`` is mean, median, min, max or std (sample)."""
    if agg == "median":
        return exact_median(df, cell, value, value).drop("n")
    functions = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    return df.groupBy(*cell).agg(functions[agg](value).alias(value))


def mean_from_parts(df: DataFrame, cell: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean per cell built from mergeable sums and counts, each column with its own count."""
    parts = df.groupBy(*cell).agg(
        *[F.sum(v).alias(f"__s_{v}") for v in values], *[F.count(v).alias(f"__n_{v}") for v in values])
    return parts.select(*cell, *[F.try_divide(F.col(f"__s_{v}"), F.col(f"__n_{v}")).alias(v) for v in values],
                        F.col(f"__n_{values[0]}").alias("n"))


def weighted_mean(value: str, weight: str) -> Column:
    """Mean that leaves out null values together with their weights."""
    v, w = F.col(value), F.col(weight)
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def two_level_mean(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str, name: str) -> DataFrame:
    """Unweighted mean over inner groups of the means within them."""
    means = df.groupBy(*outer, *inner).agg(F.avg(value).alias("__m"))
    return means.groupBy(*outer).agg(F.avg("__m").alias(name))


def with_total(df: DataFrame, key: str, sums: Sequence[str], label: str = "TOTAL") -> DataFrame:
    """Sums per key plus one grand-total row."""
    rolled = df.rollup(key).agg(*[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in sums], F.grouping_id().alias("__g"))
    return rolled.withColumn(key, F.when(F.col("__g") == 1, F.lit(label)).otherwise(F.col(key).cast("string"))).drop("__g")


def pivot_fixed(df: DataFrame, index: Sequence[str], axis: str, values: Sequence, measure: Column,
                prefix: str, fill: float | None = None) -> DataFrame:
    """Long to wide over a known list of axis values: no pass to discover them."""
    wide = df.groupBy(*index).pivot(axis, list(values)).agg(measure)
    names = {str(v): f"{prefix}{v}" for v in values}
    wide = wide.withColumnsRenamed(names)
    return wide if fill is None else wide.fillna(fill, subset=list(names.values()))


def quantile_edges(df: DataFrame, value: str, q: int) -> DataFrame:
    """One row: ascending array of the distinct edges of ``q`` equal-count bins."""
    probs = {f"e{i}": i / q for i in range(q + 1)}
    edges = exact_quantiles(df, [], value, probs)
    return edges.select(F.array_distinct(F.array(*probs)).alias("edges"))


def quantile_bins(df: DataFrame, value: str, q: int, name: str = "bin") -> DataFrame:
    """0-based right-closed quantile bin; repeated edges merge, ties share a bin.

    A fit step: the q + 1 edges are evaluated once and enter the plan as literals.
    """
    edges = literal_row(quantile_edges(df, value, q))["edges"]
    return df.withColumn(name, edge_bin(value, edges))


def running_median(df: DataFrame, x: str, y: str, q: int = 20) -> DataFrame:
    """Median x and median y in each quantile bin of x."""
    binned = quantile_bins(df.where(F.col(x).isNotNull()), x, q)
    both = binned.select("bin", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    medians = exact_median(melt(both, ["bin"], ["x", "y"]), ["bin", "feature"], "value")
    picked = {f"{stat}_{f}": F.max(F.when(F.col("feature") == f, F.col(stat))) for f in ("x", "y") for stat in ("median", "n")}
    return medians.groupBy("bin").agg(*[e.alias(n) for n, e in picked.items() if n != "n_y"])


def binned_profile(df: DataFrame, by: str, features: Sequence[str], q: int = 8) -> DataFrame:
    """Mean of each feature per quantile bin of ``by``, rescaled to 0..1 over the bins."""
    binned = quantile_bins(df, by, q, "q_bin").withColumn("q_bin", F.col("q_bin") + 1)
    means = melt(binned, ["q_bin"], features).groupBy("q_bin", "feature").agg(F.avg("value").alias("mean"))
    span = means.groupBy("feature").agg(F.min("mean").alias("__lo"), F.max("mean").alias("__hi"))
    return means.join(span, "feature").select(
        "feature", "q_bin", "mean",
        F.when(F.col("__hi") > F.col("__lo"), (F.col("mean") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
         .otherwise(F.col("mean") * 0).alias("scaled"))


def histogram(df: DataFrame, value: str, *, bins: int | None = None, width: float | None = None,
              log10: bool = False, pad: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and densities in equal bins of the value or of its logarithm.

    Give ``bins`` to divide the padded range of the data, or ``width`` for bins on multiples of it.
    """
    base = df.select(*keys, (safe_log10(value) if log10 else F.col(value).cast("double")).alias("__v")).where("__v is not null")
    if width is not None:
        binned = base.withColumn("bin", width_bin("__v", F.lit(0.0), F.lit(float(width))))
        binned = binned.withColumn("__lo", F.lit(0.0)).withColumn("__w", F.lit(float(width)))
    else:
        extent = base.agg((F.min("__v") - pad).alias("lo"), (F.max("__v") + pad).alias("hi"))
        placed = attach_scalars(base, extent, "__e").withColumn("__lo", F.col("__e.lo"))
        placed = placed.withColumn("__w", (F.col("__e.hi") - F.col("__e.lo")) / bins)
        binned = placed.withColumn("bin", width_bin("__v", "__lo", "__w", F.lit(bins)))
    counts = binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("__lo").alias("__lo"), F.max("__w").alias("__w"))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("__total"))
    if keys:
        counts = counts.join(sizes, list(keys))
    else:
        counts = attach_scalars(counts, sizes, "__t").withColumn("__total", F.col("__t.__total"))
    return counts.select(
        *keys, "bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_start"), "n",
        (F.col("n") / (F.col("__total") * F.col("__w"))).alias("density"))


def histogram_2d(df: DataFrame, x: str, y: str, *, bins: int = 119, pad: float = 0.3) -> DataFrame:
    """Counts on a square lattice over the padded ranges of x and y: rows (i, j, n)."""
    base = df.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna()
    extent = base.agg((F.min("__x") - pad).alias("x0"), (F.max("__x") + pad).alias("x1"),
                      (F.min("__y") - pad).alias("y0"), (F.max("__y") + pad).alias("y1"))
    placed = attach_scalars(base, extent, "e")
    return placed.select(
        width_bin("__x", "e.x0", (F.col("e.x1") - F.col("e.x0")) / bins, F.lit(bins)).cast("int").alias("i"),
        width_bin("__y", "e.y0", (F.col("e.y1") - F.col("e.y0")) / bins, F.lit(bins)).cast("int").alias("j"),
    ).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def smooth_lattice(cells: DataFrame, *, bins: int = 119, sigma: float = 1.8, truncate: float = 4.0,
                   value: str = "n") -> DataFrame:
    """Gaussian smoothing of lattice counts, one axis at a time, mirrored at the border.

    Each filled cell adds its weighted share to its neighbours, so work follows the filled cells.
    """
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    total = sum(weights)
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / total).alias("w"))
                       for d, w in zip(range(-radius, radius + 1), weights)])

    def along(df: DataFrame, axis: str, other: str) -> DataFrame:
        # A cell reaches every position whose mirrored window covers it: itself and its mirror images.
        images = F.array(F.col(axis), -1 - F.col(axis), F.lit(2 * bins - 1) - F.col(axis))
        spread = df.select(other, F.explode(images).alias("__at"), "v").select(other, "__at", "v", F.inline(kernel))
        spread = spread.select(other, (F.col("__at") + F.col("d")).alias(axis), (F.col("v") * F.col("w")).alias("v"))
        return spread.where(F.col(axis).between(0, bins - 1)).groupBy("i", "j").agg(F.sum("v").alias("v"))

    start = cells.select("i", "j", F.col(value).cast("double").alias("v"))
    return along(along(start, "i", "j"), "j", "i").withColumnRenamed("v", "density")


def hexbin(df: DataFrame, x: str, y: str, *, gridsize: int = 50, min_count: int = 1) -> DataFrame:
    """Counts per hexagon of a lattice ``gridsize`` wide: rows (lattice, i, j, n)."""
    ny = int(gridsize / math.sqrt(3))
    base = df.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna()
    extent = base.agg(F.min("__x").alias("x0"), F.max("__x").alias("x1"), F.min("__y").alias("y0"), F.max("__y").alias("y1"))
    placed = attach_scalars(base, extent, "e").select(
        ((F.col("__x") - F.col("e.x0")) / ((F.col("e.x1") - F.col("e.x0")) / gridsize)).alias("u"),
        ((F.col("__y") - F.col("e.y0")) / ((F.col("e.y1") - F.col("e.y0")) / ny)).alias("v"))
    cells = placed.select(hex_cell("u", "v").alias("c")).select("c.*")
    return cells.groupBy("lattice", "i", "j").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def box_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last point within ``reach`` IQRs, n and number of points beyond."""
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("__lo", F.col("q1") - reach * (F.col("q3") - F.col("q1")))
    q = q.withColumn("__hi", F.col("q3") + reach * (F.col("q3") - F.col("q1")))
    values = df.where(present(value)).select(*keys, F.col(value).alias("__v"))
    if keys:
        rows = _same(values, q.select(*keys, "__lo", "__hi"), keys, [])
    else:
        rows = attach_scalars(values, q.select("__lo", "__hi"), "__q").select("__v", "__q.__lo", "__q.__hi")
    inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    ends = rows.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"), F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    q = q.drop("__lo", "__hi")
    return _same(q, ends, keys, []) if keys else attach_scalars(q, ends, "__ends").select(*q.columns, "__ends.*")


def dominant_category(df: DataFrame, key: str, category: Column, order: Sequence[str], default: str) -> DataFrame:
    """Most frequent class per group; ties go to the class listed first, no class gives the default."""
    counts = df.groupBy(key).agg(*[F.count_if(category == c).alias(f"__c{i}") for i, c in enumerate(order)])
    best = F.greatest(*[F.col(f"__c{i}") for i in range(len(order))])
    name = F.lit(order[-1])
    for i in reversed(range(len(order))):
        name = F.when(F.col(f"__c{i}") == best, F.lit(order[i])).otherwise(name)
    return counts.select(key, F.when(best > 0, name).otherwise(F.lit(default)).alias("dominant"))


def share_of_true(df: DataFrame, keys: Sequence[str], over: Sequence[str], flag: Column, name: str = "share") -> DataFrame:
    """Share of rows with a true flag per (keys, over), then averaged over ``over`` unweighted."""
    yearly = df.select(*keys, *over, F.coalesce(flag, F.lit(False)).cast("double").alias("__f"))
    return two_level_mean(yearly, keys, over, "__f", name)
