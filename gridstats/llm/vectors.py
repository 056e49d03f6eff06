"""Rows whose vectors can be compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def comparable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key``, ``v`` (array of double) of rows with a usable vector.

    Out go null, empty and zero vectors, those with null, NaN or infinite parts, and those of another
    length than most.
    """
    held = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    held = held.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = held.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return held.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))
