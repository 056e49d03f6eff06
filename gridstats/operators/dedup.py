"""Duplicate removal as map-side-combinable aggregates (no window over an unbounded group)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridstats.functions.columns import quoted


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key combination: the first by ``order``, ties broken by the remaining columns.

    Null keys form groups of their own. Column order of the input is kept.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    lead = [c for c in order if c not in keys]
    best = df.groupBy(*quoted(keys)).agg(F.min(F.struct(*quoted([*lead, *rest]))).alias("__row"))
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def first_value(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """First value by ``order`` of several columns per group, with the row count."""
    return df.groupBy(*keys).agg(*[F.min_by(v, order).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


def repeated_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Key combinations that hold the same value more than once: count above distinct count.

    Counting distinct goes through a (keys, value) pre-aggregation, so a hot key is combined
    before it is shuffled.
    """
    present = df.where(F.col(value).isNotNull())
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    pairs = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    counts = pairs.groupBy(*keys).agg(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
    return counts.where(F.col("n") > F.col("n_distinct"))
