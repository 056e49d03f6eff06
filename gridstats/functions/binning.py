"""Bin expressions: fixed edges, equal widths, hexagons and order-preserving codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gridstats.functions.columns import ColumnLike, col

# Bins per e-fold of magnitude of the order code, and a number above -ln of the least positive double.
CODE_RESOLUTION = 1 << 20
CODE_OFFSET = 746.0
# Equal parts that the values of one code are cut into between their own least and greatest.
PARTS = 1 << 16


def cut(value: ColumnLike, edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """Right-closed intervals over fixed edges, lowest edge included; outside gives null."""
    c = col(value)
    names = list(range(len(edges) - 1)) if labels is None else list(labels)
    out = F.when((c >= edges[0]) & (c <= edges[1]), F.lit(names[0]))
    for i in range(1, len(edges) - 1):
        out = out.when((c > edges[i]) & (c <= edges[i + 1]), F.lit(names[i]))
    return out


def edge_bin(value: ColumnLike, edges: ColumnLike) -> Column:
    """0-based right-closed bin against an ascending array column of edges."""
    c, e = col(value), col(edges)
    below = F.size(F.filter(e, lambda edge: edge < c)) - 1
    return F.when(c.isNotNull(), F.greatest(below, F.lit(0))).cast("int")


def width_bin(value: ColumnLike, low: ColumnLike, width: ColumnLike, bins: ColumnLike | None = None) -> Column:
    """Equal-width bin index; the last bin also holds its upper edge when ``bins`` is given."""
    index = F.floor((col(value) - col(low)) / col(width)).cast("bigint")
    return index if bins is None else F.least(index, col(bins) - F.lit(1))


def order_code(value: ColumnLike) -> Column:
    """Integer that never decreases with the value; a code holds one part in 2^20 of any magnitude."""
    c = col(value).cast("double")
    size = F.when(c == 0, F.lit(0.0)).otherwise(F.log(F.abs(c)) + F.lit(CODE_OFFSET))
    return F.floor(F.signum(c) * size * F.lit(float(CODE_RESOLUTION))).cast("bigint")


def part_code(value: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    """Part of the range from ``low`` to ``high``; within one order code a part holds some 2^17 doubles."""
    share = (col(value) - col(low)) / F.nullif(col(high) - col(low), F.lit(0.0))
    return F.coalesce(F.floor(share * F.lit(float(PARTS))).cast("bigint"), F.lit(0).cast("bigint"))


def hex_cell(x: ColumnLike, y: ColumnLike) -> Column:
    """Hexagon of a point given in lattice units: struct(lattice, i, j).

    Two rectangular lattices, one shifted by half a cell, hold the hexagon centres; a point
    belongs to the nearer of its two candidate centres, distances in y counting three times.
    """
    cx, cy = col(x), col(y)
    i1, j1 = F.rint(cx), F.rint(cy)
    i2, j2 = F.floor(cx), F.floor(cy)
    d1 = (cx - i1) * (cx - i1) + F.lit(3.0) * (cy - j1) * (cy - j1)
    d2 = (cx - i2 - 0.5) * (cx - i2 - 0.5) + F.lit(3.0) * (cy - j2 - 0.5) * (cy - j2 - 0.5)

    def cell(lattice: int, i: Column, j: Column) -> Column:
        return F.struct(F.lit(lattice).alias("lattice"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"))

    return F.when(d1 < d2, cell(0, i1, j1)).otherwise(cell(1, i2, j2))
