"""Score a whole gridded series in one plan: joins, features, model, intervals, partitioned output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, functions as F

from gridstats.functions.columns import cell_key, season_of
from gridstats.operators.boosting import FittedFeatures, score_with_intervals
from gridstats.operators.features import Interaction, cyclic_features, interaction_terms, months_to_rows
from gridstats.operators.dedup import keep_first
from gridstats.operators.joins import join_new_columns

CELL = ["ilat", "ilon"]


def with_cell(df: DataFrame, step: float = 0.1, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.withColumns({"ilat": cell_key(lat, step), "ilon": cell_key(lon, step)})


def static_by_month(static: DataFrame, families: Sequence[str], step: float = 0.1) -> DataFrame:
    """Static attributes, one row per (cell, month): cells keyed first, then deduplicated."""
    keyed = with_cell(static, step).drop("latitude", "longitude")
    rest = [c for c in keyed.columns if c not in CELL]
    return months_to_rows(keep_first(keyed, CELL, rest[:1]), CELL, families)


def model_input(daily: DataFrame, others: Sequence[DataFrame], static: DataFrame, renames: Mapping[str, str],
                interactions: Sequence[Interaction], step: float = 0.1) -> DataFrame:
    """All gridded inputs side by side with derived features, every (year, month) at once."""
    rows = with_cell(daily, step)
    for other in others:
        keyed = with_cell(other, step).drop("latitude", "longitude", "valid_time")
        rows = join_new_columns(rows, keyed, [*CELL, "year", "month"])
    rows = join_new_columns(rows, static, [*CELL, "month"]).withColumnsRenamed(dict(renames))
    if "valid_time" in rows.columns:
        rows = rows.withColumn("day_of_year", F.dayofyear("valid_time"))
    rows = cyclic_features(rows.withColumn("season", season_of("month")))
    return interaction_terms(rows, interactions)


def score_grid(rows: DataFrame, fitted: FittedFeatures, model: GBTRegressionModel, radii: DataFrame,
               levels: Sequence[float], keep: Sequence[str]) -> DataFrame:
    """Predictions and interval bounds next to the coordinate columns."""
    scored = score_with_intervals(model, fitted.apply(rows), fitted.names, radii, levels)
    bounds = [c for c in scored.columns if c == "predicted" or c.startswith(("lower_", "upper_"))]
    return scored.select(*keep, *bounds)
