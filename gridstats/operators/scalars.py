"""Global one-row results attached to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame, name: str = "scalars") -> DataFrame:
    """Add the single row of an aggregate as one struct column.

    The row travels as a scalar subquery, evaluated once per query, so there is no join at all.
    ``one_row`` must be a global aggregate: exactly one row whatever the input holds.
    """
    return df.select("*", one_row.select(F.struct("*")).scalar().alias(name))


def literal_row(one_row: DataFrame) -> dict:
    """Evaluate a global aggregate once, as literal columns by name (a fit step)."""
    row = one_row.first()

    def literal(value, kind):
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value])
        return F.lit(value).cast(kind)

    return {f.name: literal(row[f.name], f.dataType) for f in one_row.schema.fields}


def broadcast_within(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """Hint a broadcast when the measured size of a materialised table is within a limit."""
    measured = df.agg(F.sum(size.cast("bigint"))).first()[0]
    return F.broadcast(df) if (measured or 0) <= limit else df
