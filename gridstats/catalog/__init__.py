"""Registered queries: each operator bound to the driver's tables, with equivalent SQL.

Doubles are rounded on both sides: ``digits`` here, ``round`` in the SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridstats.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}

MODULES = ("flux", "scalars", "filters", "joins", "aggregates", "statistics", "uncertainty", "contribution", "spatial",
           "features", "models", "sources", "training")


class Tables:
    """Lazy scans of the tables in a directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A fresh folder next to the checkpoints, which all executors share."""
        return f"{checkpoint_dir(self.spark)}/gridstats-{uuid.uuid4().hex}/{name}"


def rounded(df: DataFrame, digits: int) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.round(F.col(f"`{n}`").cast("double"), digits) for n in names}) if names else df


def query(name: str, covers: str, sql: str | None = None, digits: int = 6):
    """Register ``build(tables)`` under a name, with the operator ids it exercises and its SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(build(Tables(spark, sf_dir)), digits)
        OPERATORS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"gridstats.catalog.{module}")
