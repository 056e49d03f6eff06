"""Time slices, grids, anomalies, seasons and series of gridded estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridstats.functions.columns import season_label
from gridstats.operators.joins import grid_difference, rows_of_nearest_cell
from gridstats.operators.quantiles import exact_median
from gridstats.operators.summaries import aggregate_to_grid, mean_from_parts, pivot_fixed


def time_slice(df: DataFrame, *, date: str | None = None, month: tuple[int, int] | None = None, year: int | None = None,
               years: tuple[int, int] | None = None, months: Sequence[int] | None = None, time: str = "valid_time") -> DataFrame:
    """Rows of one date, month, year, year range or list of months.

    Conditions on ``year`` and ``month`` prune partitions; a date also filters on its own day.
    """
    if date is not None:
        y, m, _ = (int(p) for p in date.split("-"))
        df = df.where((F.col("year") == y) & (F.col("month") == m) & (F.to_date(time) == F.lit(date).cast("date")))
    if month is not None:
        df = df.where((F.col("year") == month[0]) & (F.col("month") == month[1]))
    if year is not None:
        df = df.where(F.col("year") == year)
    if years is not None:
        df = df.where(F.col("year").between(*years))
    if months is not None:
        df = df.where(F.col("month").isin(list(months)))
    return df


def grid_of(df: DataFrame, cell: Sequence[str], value: str, agg: str = "mean", **when) -> DataFrame:
    return aggregate_to_grid(time_slice(df, **when), cell, value, agg)


def anomaly(df: DataFrame, cell: Sequence[str], value: str, year: int, base_year: int, agg: str = "mean") -> DataFrame:
    """Grid of one year minus the grid of another, over the cells both have."""
    return grid_difference(grid_of(df, cell, value, agg, year=year), grid_of(df, cell, value, agg, year=base_year), cell, value)


def seasonal_grids(df: DataFrame, cell: Sequence[str], value: str, year: int, agg: str = "mean") -> DataFrame:
    """One grid per season of a calendar year (its own December joins January and February)."""
    labelled = time_slice(df, year=year).withColumn("season", season_label("month"))
    return aggregate_to_grid(labelled, ["season", *cell], value, agg)


def yearly_series(df: DataFrame, value: str, agg: str = "mean", at: tuple[float, float] | None = None,
                  lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Yearly aggregate of the whole grid, or of the cell nearest to a coordinate."""
    rows = df if at is None else rows_of_nearest_cell(df, *at, lat_col=lat, lon_col=lon)
    if agg == "median":
        return exact_median(rows, ["year"], value, value).drop("n")
    return aggregate_to_grid(rows, ["year"], value, agg)


def all_time_mean(df: DataFrame, cell: Sequence[str], values: Sequence[str]) -> DataFrame:
    return mean_from_parts(df, cell, values)


def region_by_month(df: DataFrame, region: str, value: str, prefix: str) -> DataFrame:
    """Region rows, one column per month, plus the mean over the months present."""
    wide = pivot_fixed(df, [region], "month", range(1, 13), F.avg(value), prefix)
    cols = [f"{prefix}{m}" for m in range(1, 13)]
    present = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return wide.withColumn(f"{prefix}annual", F.try_divide(total, present))
