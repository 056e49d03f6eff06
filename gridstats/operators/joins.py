"""Joins the built-in ``join`` does not spell out in one call. None of them forces a broadcast:
adaptive execution broadcasts a side only after measuring it, and splits skewed partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridstats.functions.columns import clip, quoted
from gridstats.operators.scalars import attach_scalars


def _renamed_keys(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return right.withColumnsRenamed({k: f"__r_{k}" for k in keys})


def _on(keys: Sequence[str], null_safe: bool) -> Column:
    def same(k: str) -> Column:
        left, right = F.col(f"`{k}`"), F.col(f"`__r_{k}`")
        return left.eqNullSafe(right) if null_safe else left == right

    return reduce(lambda a, b: a & b, [same(k) for k in keys])


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", *,
               null_safe: bool = False) -> DataFrame:
    """Equi-join that keeps the left copy of the keys; ``null_safe`` lets null match null."""
    if not null_safe:
        return left.join(right, list(keys), how)
    joined = left.join(_renamed_keys(right, keys), _on(keys, True), how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def suffix_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", *,
                suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = False) -> DataFrame:
    """Join in which columns present on both sides get a suffix on each side."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return keyed_join(left, right, keys, how, null_safe=null_safe)


def join_new_columns(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Bring over only the columns the left side does not have yet."""
    fresh = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(*keys, *quoted(fresh)), list(keys), how)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Add ``value`` from a key-value table; keys that are not listed get the default."""
    joined = df.join(table.select(key, value), key, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), default))


def in_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    return df.join(groups.select(key), key, "left_semi")


def not_in_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    return df.join(groups.select(key), key, "left_anti")


def assert_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise when a group id occurs on both sides."""
    shared = left.select(key).join(right.select(key), key, "left_semi").limit(1)
    if not shared.isEmpty():
        raise ValueError(f"{key} values occur on both sides")


def snap_index(value: str | Column, origin: float | Column, step: float) -> Column:
    """Index of the nearest node of a regular axis; a point half-way goes to the lower node."""
    v = F.col(value) if isinstance(value, str) else value
    return F.ceil((v - (origin if isinstance(origin, Column) else F.lit(origin))) / F.lit(step) - F.lit(0.5)).cast("bigint")


def sample_grid(points: DataFrame, grid: DataFrame, *, lat: str, lon: str, value: str, step: float,
                origin: tuple[float, float] | None = None, by: Sequence[str] = (), floor: float | None = 0.0,
                grid_lat: str = "lat", grid_lon: str = "lon") -> DataFrame:
    """Value of the nearest cell of a regular grid, per point.

    A hash join on integer node indexes counted from ``origin``, by default the grid's own least
    coordinates, so grids at any offset work; two nodes under one index are an error. Points outside the extent of the grid get null, values
    are floored. ``by`` holds further join keys present on both sides (for example the month).
    """
    extent = grid.agg(F.min(grid_lat).alias("lat0"), F.max(grid_lat).alias("lat1"),
                      F.min(grid_lon).alias("lon0"), F.max(grid_lon).alias("lon1"))
    lat0, lon0 = (F.lit(origin[0]), F.lit(origin[1])) if origin else (F.col("__e.lat0"), F.col("__e.lon0"))
    nodes = attach_scalars(grid, extent, "__e").select(
        *by, snap_index(grid_lat, lat0, step).alias("__i"), snap_index(grid_lon, lon0, step).alias("__j"), F.col(value))
    nodes = nodes.groupBy(*by, "__i", "__j").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("__n"))
    twice = F.raise_error(F.lit(f"grid has several nodes within one step of {step}"))
    nodes = nodes.withColumn(value, F.when(F.col("__n") > 1, twice).otherwise(F.col(value))).drop("__n")
    placed = attach_scalars(points, extent, "__e").withColumns({
        "__i": snap_index(lat, lat0, step), "__j": snap_index(lon, lon0, step),
        "__in": F.col(lat).between(F.col("__e.lat0"), F.col("__e.lat1"))
                & F.col(lon).between(F.col("__e.lon0"), F.col("__e.lon1"))})
    joined = placed.join(nodes, [*by, "__i", "__j"], "left")
    sampled = F.when(F.col("__in"), clip(value, lower=floor))
    return joined.withColumn(value, sampled).drop("__i", "__j", "__in", "__e")


def rows_of_nearest_cell(df: DataFrame, lat: float, lon: float, *, lat_col: str = "latitude",
                         lon_col: str = "longitude") -> DataFrame:
    """All rows of the cell nearest to one coordinate by city-block distance."""
    distance = F.abs(F.col(lat_col) - F.lit(lat)) + F.abs(F.col(lon_col) - F.lit(lon))
    nearest = df.agg(F.min(F.struct(distance.alias("d"), F.col(lat_col).alias("lat"), F.col(lon_col).alias("lon"))).alias("c"))
    marked = attach_scalars(df, nearest, "__near")
    return marked.where((F.col(lat_col) == F.col("__near.c.lat")) & (F.col(lon_col) == F.col("__near.c.lon"))).drop("__near")


def grid_difference(left: DataFrame, right: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """Cell-wise difference of two grids over the cells both have."""
    other = right.select(*cell, F.col(value).alias("__other"))
    return left.select(*cell, value).join(other, list(cell), "inner").select(
        *cell, (F.col(value) - F.col("__other")).alias(value))
