"""Column expressions shared by every operator. All return plain Catalyst columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quoted(names: Sequence[str]) -> list[Column]:
    """Columns by exact name, dots included."""
    return [F.col(f"`{n}`") for n in names]


# --- missing values -------------------------------------------------------------------


def nan_to_null(value: ColumnLike) -> Column:
    """NaN and NULL mean the same thing: missing."""
    return F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))


def finite_or_null(value: ColumnLike) -> Column:
    c = col(value).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def zero_sum(value: ColumnLike) -> Column:
    """Sum that is 0.0 when no value is present."""
    return F.coalesce(F.sum(col(value)), F.lit(0.0))


def null_count(features: Sequence[str]) -> Column:
    """How many of the listed columns are null in this row."""
    return reduce(lambda a, b: a + b, [F.col(f).isNull().cast("int") for f in features])


def row_mean(columns: Sequence[ColumnLike]) -> Column:
    """Mean over the non-null members of a row; null when none is present."""
    total = reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns])
    present = reduce(lambda a, b: a + b, [col(c).isNotNull().cast("int") for c in columns])
    return F.when(present > 0, total / present)


def missing_label(value: ColumnLike, label: str = "Missing") -> Column:
    """Text of a category, with every textual form of a missing value folded into one label."""
    text = col(value).cast("string")
    return F.when(text.isNull() | text.isin("nan", "None", "NaN", "<NA>"), F.lit(label)).otherwise(text)


# --- numbers --------------------------------------------------------------------------


def safe_ln(value: ColumnLike) -> Column:
    c = col(value)
    return F.when(c > 0, F.ln(c))


def safe_log10(value: ColumnLike) -> Column:
    c = col(value)
    return F.when(c > 0, F.log10(c))


def clip(value: ColumnLike, lower=None, upper=None) -> Column:
    """Limit a value; null stays null (``greatest``/``least`` alone would drop the null)."""
    c = col(value)
    out = c
    if upper is not None:
        out = F.when(c > F.lit(upper), F.lit(upper)).otherwise(out)
    if lower is not None:
        out = F.when(c < F.lit(lower), F.lit(lower)).otherwise(out)
    return out


def number_or(value: ColumnLike, fallback: ColumnLike | None = None) -> Column:
    """Text to double; text that is not a number gives the fallback, or null."""
    parsed = nan_to_null(col(value).try_cast("double"))
    return parsed if fallback is None else F.coalesce(parsed, col(fallback))


def ratio(numerator: ColumnLike, denominator: ColumnLike, scale: float = 1.0) -> Column:
    """``numerator / denominator * scale``; null where the denominator is not positive."""
    den = col(denominator)
    return F.when(den > 0, F.try_divide(col(numerator), den) * F.lit(scale))


# --- codes and keys -------------------------------------------------------------------


def zero_pad(value: ColumnLike, width: int) -> Column:
    """Left-pad with zeros without ever truncating a longer code."""
    text = col(value).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def code_prefix(value: ColumnLike, width: int, length: int) -> Column:
    return F.substring(zero_pad(value, width), 1, length)


def cell_key(value: ColumnLike, step: float, origin: float = 0.0) -> Column:
    """Integer index of the grid line nearest to a coordinate: an exact join key."""
    return F.rint((col(value) - F.lit(origin)) / F.lit(step)).cast("bigint")


def wrap_longitude(value: ColumnLike) -> Column:
    c = col(value)
    return F.when(c >= 180, c - 360).otherwise(c)


def text_match(value: ColumnLike, *, contains: str | None = None, ignore_case: bool = False,
               starts_with: str | None = None) -> Column:
    """String predicate in which a null text never matches."""
    text = col(value)
    tests = []
    if contains is not None:
        tests.append(F.contains(F.lower(text), F.lit(contains.lower())) if ignore_case
                     else F.contains(text, F.lit(contains)))
    if starts_with is not None:
        tests.append(F.startswith(text, F.lit(starts_with)))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def category_of(value: ColumnLike, classes: dict[str, Sequence], default: str | None = None) -> Column:
    """Name of the first class whose member list holds the code."""
    out = F.lit(default)
    for name, members in reversed(list(classes.items())):
        out = F.when(col(value).isin(list(members)), F.lit(name)).otherwise(out)
    return out


def position_in(value: ColumnLike, order: Sequence[str]) -> Column:
    """1-based position in a fixed order, 0 for codes that are not listed."""
    return F.array_position(F.array(*[F.lit(o) for o in order]), col(value)).cast("int")


# --- calendar -------------------------------------------------------------------------


def lenient_date(value: ColumnLike, two_digit_year: bool = False) -> Column:
    """Date of a text, null where it does not parse.

    ``two_digit_year`` reads month/day/yy with years 69-99 in the 1900s; otherwise the text
    is an ISO date or timestamp.
    """
    text = col(value)
    if not two_digit_year:
        return F.to_date(F.try_to_timestamp(text))
    parsed = F.to_date(F.try_to_timestamp(text, F.lit("M/d/yy")))
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def season_of(month: ColumnLike) -> Column:
    """1 = Dec-Feb, 2 = Mar-May, 3 = Jun-Aug, 4 = Sep-Nov."""
    return (F.floor((col(month) % 12) / 3) + 1).cast("int")


def season_label(month: ColumnLike) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ("DJF", "MAM", "JJA", "SON")]), season_of(month))


def cyclic(value: ColumnLike, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * col(value) / F.lit(period)
    return F.sin(angle), F.cos(angle)
