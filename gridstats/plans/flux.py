"""Flux per region from gridded estimates, with the error carried through both levels.

Estimates are long rows (cell, year, month, estimate, low, high). The lookup holds one row per
cell: inner and outer region, an annual factor and an array of twelve monthly factors. Because
flux and error add linearly within an inner region, nothing is ever gathered per cell-year: the
monthly means join the lookup once and reduce straight to (year, inner region).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gridstats.functions.columns import cell_key, ratio, wrap_longitude
from gridstats.functions.units import TERAGRAM_PER_GRAM, cell_area_m2, flux_factor
from gridstats.operators.joins import sample_grid
from gridstats.operators.spatial import assign_region
from gridstats.operators.uncertainty import half_width, quadrature

INTERVAL = ("low", "high")


def has_interval(df: DataFrame, columns: Sequence[str] = INTERVAL) -> bool:
    """Does the dataset carry interval columns? Read from the schema, no file is opened."""
    return set(columns) <= set(df.columns)


def distinct_cells(predictions: DataFrame, lat: str, lon: str, step: float = 0.1) -> DataFrame:
    """Distinct cells with integer keys and display coordinates."""
    keys = predictions.select(cell_key(lat, step).alias("ilat"), cell_key(lon, step).alias("ilon")).distinct()
    return keys.withColumns({"lat": F.bround(F.col("ilat") * step, 6), "lon": F.bround(F.col("ilon") * step, 6)})


def cell_lookup(cells: DataFrame, annual: DataFrame, monthly: DataFrame, outer: DataFrame, inner: DataFrame, *,
                runoff_step: float, tile: float = 1.0, codes: Sequence[str] | None = None, ppm: bool = False) -> DataFrame:
    """Region codes, area, runoff and factors per cell; cells without region or runoff are left out.

    ``annual`` and ``monthly`` are long climatologies (lat, lon[, month], value) in metres;
    ``outer``/``inner`` are region tables (region, rings).
    """
    annual = annual.withColumn("lon", wrap_longitude("lon"))
    monthly = monthly.withColumn("lon", wrap_longitude("lon"))
    area = cells.withColumn("area_m2", cell_area_m2("lat"))
    per_month = monthly.groupBy("lat", "lon").agg(F.map_from_entries(F.collect_list(F.struct("month", "value"))).alias("by_month"))
    per_month = per_month.select("lat", "lon", F.transform(
        F.sequence(F.lit(1), F.lit(12)), lambda m: F.greatest(F.try_element_at("by_month", m), F.lit(0.0))).alias("value"))
    sampled = sample_grid(area, annual, lat="lat", lon="lon", value="value", step=runoff_step).withColumnRenamed("value", "runoff_annual")
    sampled = sample_grid(sampled, per_month, lat="lat", lon="lon", value="value", step=runoff_step, floor=None)
    sampled = sampled.withColumnRenamed("value", "runoff_months").withColumn(
        "runoff_year", F.aggregate("runoff_months", F.lit(0.0), lambda a, r: a + F.coalesce(r, F.lit(0.0))))
    factors = F.transform("runoff_months", lambda r: F.coalesce(flux_factor(r, F.col("area_m2"), ppm=ppm), F.lit(0.0)))
    located = assign_region(sampled, outer, x="lon", y="lat", tile=tile, name="outer")
    located = assign_region(located, inner, x="lon", y="lat", tile=tile, name="inner")
    keep = F.col("outer").isNotNull() & F.col("inner").isNotNull() & (F.col("runoff_year") > 0)
    if codes is not None:
        keep = keep & F.col("outer").isin(list(codes))
    return located.withColumns({"factor": flux_factor("runoff_year", "area_m2", ppm=ppm), "factors": factors}).where(keep)


def factor_check(lookup: DataFrame) -> DataFrame:
    """Sum of monthly over annual factors, and monthly-sum over annual runoff; both should be near 1."""
    months = F.aggregate("factors", F.lit(0.0), lambda a, f: a + f)
    both = (F.col("runoff_annual") > 0) & (F.col("runoff_year") > 0)
    return lookup.agg(
        ratio(F.sum(months), F.sum("factor")).alias("factor_ratio"),
        ratio(F.avg(F.when(both, F.col("runoff_year"))), F.avg(F.when(both, F.col("runoff_annual")))).alias("runoff_ratio"))


def _by_year(rows: DataFrame) -> DataFrame:
    """(year, inner, outer) sums to (year, outer): flux, and error linear within, quadratic across."""
    return rows.groupBy("year", "outer").agg(
        F.sum("flux").alias("flux"), F.sum("estimate").alias("estimate"), F.sum("cells").alias("cells"),
        quadrature("sigma").alias("sigma_block"), F.sum("sigma").alias("sigma_linear"))


def monthly_flux(predictions: DataFrame, lookup: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Per (year, outer): seasonal flux, the sum over months of estimate times that month's factor.

    A month without an estimate adds nothing. ``estimate`` is the diagnostic mean over all lookup
    cells of the region and all months present anywhere in the year.
    """
    with_error = has_interval(predictions)
    means = predictions.groupBy(*cell, "year", "month").agg(
        F.avg("estimate").alias("estimate"),
        *([F.avg("low").alias("low"), F.avg("high").alias("high")] if with_error else []))
    factor = F.element_at("factors", F.col("month").cast("int")) * TERAGRAM_PER_GRAM
    sigma = half_width("low", "high") if with_error else F.lit(None).cast("double")
    joined = means.join(lookup.select(*cell, "outer", "inner", "factors"), list(cell), "inner").select(
        "year", "outer", "inner", "estimate",
        (F.col("estimate") * factor).alias("flux"), (sigma * factor).alias("sigma"))
    inner = joined.groupBy("year", "outer", "inner").agg(
        F.coalesce(F.sum("flux"), F.lit(0.0)).alias("flux"), F.sum("estimate").alias("estimate"),
        F.coalesce(F.sum("sigma"), F.lit(0.0)).alias("sigma"), F.lit(0).alias("cells"))
    months = predictions.select("year", "month").distinct().groupBy("year").agg(F.count(F.lit(1)).alias("months_present"))
    cells = lookup.groupBy("outer").agg(F.count(F.lit(1)).alias("n_cells"))
    return _by_year(inner).join(months, "year").join(cells, "outer").select(
        "year", "outer", "flux",
        (F.col("estimate") / F.col("months_present") / F.col("n_cells")).alias("estimate"), "sigma_block", "sigma_linear")


def annual_flux(predictions: DataFrame, lookup: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Per (year, outer): annual mean estimate of a cell times its annual factor."""
    with_error = has_interval(predictions)
    means = predictions.groupBy(*cell, "year").agg(
        F.avg("estimate").alias("estimate"),
        *([F.avg("low").alias("low"), F.avg("high").alias("high")] if with_error else []))
    factor = F.col("factor") * TERAGRAM_PER_GRAM
    sigma = half_width("low", "high") if with_error else F.lit(None).cast("double")
    rows = means.join(lookup.select(*cell, "outer", "inner", "factor"), list(cell), "inner").select(
        "year", "outer", "inner", "estimate", (F.col("estimate") * factor).alias("flux"), (sigma * factor).alias("sigma"))
    inner = rows.groupBy("year", "outer", "inner").agg(
        F.coalesce(F.sum("flux"), F.lit(0.0)).alias("flux"), F.sum("estimate").alias("estimate"),
        F.count("estimate").alias("cells"), F.coalesce(F.sum("sigma"), F.lit(0.0)).alias("sigma"))
    return _by_year(inner).select(
        "year", "outer", "flux", F.try_divide("estimate", "cells").alias("estimate"), "sigma_block", "sigma_linear")


def mean_over_years(yearly: DataFrame, zero_fill: bool = False) -> DataFrame:
    """Unweighted mean of the yearly values of each region.

    A region missing from a year is skipped, or counts as zero with ``zero_fill`` (the seasonal
    mode, where every region has a value in every processed year).
    """
    columns = ("flux", "estimate", "sigma_block", "sigma_linear")
    if not zero_fill:
        return yearly.groupBy("outer").agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n_years"))
    # The total row of the rollup knows the number of processed years; the window spans one row per region.
    rolled = yearly.rollup("outer").agg(
        *[F.sum(c).alias(c) for c in columns], F.count_distinct("year").alias("years"), F.grouping_id().alias("level"))
    rolled = rolled.withColumn("n_years", F.max("years").over(Window.partitionBy(F.lit(0))))
    return rolled.where(F.col("level") == 0).select("outer", *[(F.col(c) / F.col("n_years")).alias(c) for c in columns], "n_years")


def total_flux(regional: DataFrame) -> DataFrame:
    """One row: total, its error under three assumptions, and the interval of the primary one."""
    total = regional.agg(
        F.coalesce(F.sum("flux"), F.lit(0.0)).alias("flux"), quadrature("sigma_block").alias("sigma_block"),
        quadrature("sigma_linear").alias("sigma_regions"), F.sum("sigma_linear").alias("sigma_all_linear"))
    return total.withColumns({
        "relative_pct": F.try_divide("sigma_block", "flux") * 100,
        "lower": F.col("flux") - 1.645 * F.col("sigma_block"), "upper": F.col("flux") + 1.645 * F.col("sigma_block")})


def region_summary(lookup: DataFrame) -> DataFrame:
    """Mean runoff, area, number of cells and of inner regions per outer region."""
    inner = lookup.groupBy("outer", "inner").agg(
        F.sum("runoff_year").alias("r"), F.sum("area_m2").alias("a"), F.count("factor").alias("n"), F.count("runoff_year").alias("nr"))
    return inner.groupBy("outer").agg(
        F.try_divide(F.sum("r"), F.sum("nr")).alias("mean_runoff"), (F.sum("a") / 1e6).alias("area_km2"),
        F.sum("n").alias("n_cells"), F.count("inner").alias("n_inner"))
