"""Feature preparation fitted on training rows and applied anywhere.

A fitted parameter set is a one-row frame (numeric features) or a table keyed by category. One-row
sets have a fixed size, a few numbers per feature: they are evaluated once and enter later plans as
literals. Category tables stay distributed and are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridstats.functions.columns import cyclic, missing_label, season_of
from gridstats.operators.quantiles import feature_quantiles, widen
from gridstats.operators.scalars import attach_scalars, literal_row
from gridstats.session import cut_lineage

Interaction = tuple[str, str, str | None, str]
APPROXIMATE_MONTH_DAYS = 30.44


def calendar_features(df: DataFrame, date: str) -> DataFrame:
    """Month, season, day of year, year and their sine and cosine forms."""
    df = df.withColumns({
        "month": F.month(date), "day_of_year": F.dayofyear(date), "year": F.year(date)})
    return cyclic_features(df.withColumn("season", season_of("month")))


def cyclic_features(df: DataFrame) -> DataFrame:
    """Sine and cosine of month and day; the day is approximated from the month when absent."""
    day = F.col("day_of_year") if "day_of_year" in df.columns else (F.col("month") - 0.5) * APPROXIMATE_MONTH_DAYS
    ms, mc = cyclic("month", 12.0)
    ds, dc = cyclic(day, 365.25)
    return df.withColumns({"month_sin": ms, "month_cos": mc, "day_sin": ds, "day_cos": dc})


def interaction_terms(df: DataFrame, specs: Sequence[Interaction]) -> DataFrame:
    """Derived columns in order; later terms may use earlier ones, absent inputs give null."""
    for name, a, b, op in specs:
        needed = [a] if op == "square" else [a, b]
        if any(c not in df.columns for c in needed):
            df = df.withColumn(name, F.lit(None).cast("double"))
        elif op == "multiply":
            df = df.withColumn(name, F.col(a) * F.col(b))
        elif op == "ratio":
            df = df.withColumn(name, F.col(a) / F.when(F.col(b) < 10, 10.0).otherwise(F.col(b)))
        elif op == "square":
            df = df.withColumn(name, F.col(a) * F.col(a))
        elif op == "normalize":
            df = df.withColumn(name, F.col(b) / F.when(F.col(a) < 1, 1.0).otherwise(F.col(a)))
        else:
            raise ValueError(f"unknown operation {op!r}")
    return df


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Listed columns in order; absent ones are added as typed nulls."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


# --- imputation -----------------------------------------------------------------------


def fit_imputer(train: DataFrame, features: Sequence[str], skew_limit: float = 1.0) -> DataFrame:
    """One row, one fill value per feature: the median where the skewness is large, else the mean."""
    moments = literal_row(train.agg(*[F.avg(f).alias(f"{f}__mean") for f in features], *[F.skewness(f).alias(f"{f}__skew") for f in features]))
    skewed = _where([F.abs(moments[f"{f}__skew"]) > skew_limit for f in features], train, features)
    fills = {f: moments[f"{f}__mean"] for f in features}
    if skewed:
        medians = literal_row(widen(feature_quantiles(train, skewed, {"median": 0.5}), skewed, ["median"]))
        fills |= {f: medians[f"{f}__median"] for f in skewed}
    return train.sparkSession.range(1).select(*[fills[f].alias(f) for f in features])


def _where(conditions: Sequence[Column], df: DataFrame, features: Sequence[str]) -> list[str]:
    """The features whose condition on literals holds."""
    row = df.sparkSession.range(1).select(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions)]).first()
    return [f for f, holds in zip(features, row) if holds]


def impute(df: DataFrame, fills: DataFrame, features: Sequence[str]) -> DataFrame:
    fill = literal_row(fills)
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), fill[f]) for f in features})


def high_missing(df: DataFrame, features: Sequence[str], limit: float = 0.5) -> DataFrame:
    """One row: does any feature lack more than ``limit`` of its values?"""
    shares = [F.avg(F.col(f).isNull().cast("double")) for f in features]
    worst = shares[0] if len(shares) == 1 else F.greatest(*shares)
    return df.agg(worst.alias("worst_share")).withColumn("high_missing", F.col("worst_share") > limit)


# --- scaling --------------------------------------------------------------------------

#: Parameters of a scaled feature.
SCALING = ("use_log", "shift", "robust", "center", "scale")

def _log(f: str, shift: Column) -> Column:
    return F.ln(F.col(f) + shift + 1)


def fit_scaler(train: DataFrame, features: Sequence[str], *, skew_limit: float = 1.5, outlier_share: float = 0.1,
               reach: float = 1.5) -> DataFrame:
    """One row of scaling parameters per feature: ``use_log``, ``shift``, ``robust``, ``center``, ``scale``.

    The logarithm is used when the skewness is large and falls by taking it. Features with many
    values beyond the whiskers are scaled by median and IQR, the others by mean and deviation.
    """
    raw = literal_row(train.agg(*[F.skewness(f).alias(f"{f}__skew") for f in features], *[F.min(f).alias(f"{f}__min") for f in features]))
    skew = {f: F.abs(raw[f"{f}__skew"]) for f in features}
    shift = {f: F.when((skew[f] > skew_limit) & (raw[f"{f}__min"] <= 0), F.abs(raw[f"{f}__min"]) + 1).otherwise(0.0) for f in features}
    # Only a skewed feature is looked at in logarithms.
    skewed = _where([skew[f] > skew_limit for f in features], train, features)
    logs = literal_row(train.agg(*[F.skewness(_log(f, shift[f])).alias(f) for f in skewed])) if skewed else {}
    use_log = {f: F.coalesce(F.abs(logs[f]) < skew[f], F.lit(False)) if f in logs else F.lit(False) for f in features}
    chosen = train.select(*[F.when(use_log[f], _log(f, shift[f])).otherwise(F.col(f).cast("double")).alias(f) for f in features])
    q = literal_row(widen(feature_quantiles(chosen, features, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), features, ["q25", "q50", "q75"]))

    def beyond(f: str) -> Column:
        margin = reach * (q[f"{f}__q75"] - q[f"{f}__q25"])
        return (F.col(f) < q[f"{f}__q25"] - margin) | (F.col(f) > q[f"{f}__q75"] + margin)

    last = chosen.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(beyond(f)).alias(f"{f}__out") for f in features],
        *[F.avg(f).alias(f"{f}__mean") for f in features], *[F.stddev_pop(f).alias(f"{f}__std") for f in features])
    out = []
    for f in features:
        robust = F.try_divide(F.col(f"{f}__out"), F.col("rows")) > outlier_share
        scale = F.when(robust, q[f"{f}__q75"] - q[f"{f}__q25"]).otherwise(F.col(f"{f}__std"))
        out += [use_log[f].alias(f"{f}__use_log"), shift[f].alias(f"{f}__shift"), robust.alias(f"{f}__robust"),
                F.when(robust, q[f"{f}__q50"]).otherwise(F.col(f"{f}__mean")).alias(f"{f}__center"),
                F.when(scale == 0, 1.0).otherwise(scale).alias(f"{f}__scale")]
    return last.select(*out)


def scale(df: DataFrame, params: DataFrame, features: Sequence[str]) -> DataFrame:
    p = literal_row(params)
    return df.withColumns({
        f: (F.when(p[f"{f}__use_log"], _log(f, p[f"{f}__shift"])).otherwise(F.col(f).cast("double")) - p[f"{f}__center"]) / p[f"{f}__scale"]
        for f in features})


# --- categories -----------------------------------------------------------------------


def categories(train: DataFrame, column: str) -> DataFrame:
    return train.select(missing_label(column).alias(column)).distinct()


def fit_ordinal(train: DataFrame, column: str) -> DataFrame:
    """Category and its 0-based position in sorted order; the label of missing values takes its own place."""
    # Sorted ranges of categories are numbered apart and moved up by the sizes of the ranges before.
    ranges = cut_lineage(categories(train, column).repartitionByRange(column).withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(column))
    return ranges.join(sizes.select("__range", (upto - F.col("__n")).alias("__before")), "__range").select(
        column, (F.col("__before") + within - 1).cast("int").alias("code"))


def apply_ordinal(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    """Codes by category; categories not seen in training get -1."""
    joined = df.withColumn("__k", missing_label(column)).join(codes.select(F.col(column).alias("__k"), F.col("code").alias("__code")), "__k", "left")
    return joined.withColumn(name, F.coalesce(F.col("__code"), F.lit(-1))).drop("__code", "__k")


def fit_target_encoder(train: DataFrame, column: str, label: str, *, smoothing: float = 25.0,
                       min_leaf: float = 5.0) -> DataFrame:
    """Per category: mean label pulled towards the overall mean by a sigmoid of the category size."""
    overall = train.agg(F.avg(label).alias("prior"))
    stats = train.groupBy(missing_label(column).alias(column)).agg(F.avg(label).alias("m"), F.count(label).alias("n"))
    w = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n") - min_leaf) / smoothing))
    return attach_scalars(stats, overall, "o").select(
        column, (F.col("o.prior") * (1 - w) + F.col("m") * w).alias("encoded"), F.col("o.prior").alias("prior"))


def apply_target_encoder(df: DataFrame, encoder: DataFrame, column: str, name: str) -> DataFrame:
    """Encoded value per row; unseen categories get the overall mean."""
    prior = literal_row(encoder.agg(F.max("prior").alias("prior")))["prior"]
    table = encoder.select(F.col(column).alias("__k"), F.col("encoded").alias(name))
    joined = df.withColumn("__k", missing_label(column)).join(table, "__k", "left").drop("__k")
    return joined.withColumn(name, F.coalesce(F.col(name), prior))


def one_hot_levels(train: DataFrame, column: str) -> list[str]:
    """Sorted categories that become named columns (the first one is the reference level).

    Columns are part of the plan, so this form suits categories that are few; the vector form below
    keeps the categories in a table, whatever their number.
    """
    return sorted(r[0] for r in categories(train, column).collect())


def apply_one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """0/1 columns for all levels but the first; unknown categories are all zero."""
    text = missing_label(column)
    return df.withColumns({f"{column}_{v}": (text == v).cast("float") for v in levels[1:]})


def one_hot_width(codes: DataFrame) -> int:
    """Slots of the vector form: all categories but the first."""
    return max(0, codes.count() - 1)


def apply_one_hot_vector(df: DataFrame, codes: DataFrame, column: str, name: str, width: int) -> DataFrame:
    """Sparse 0/1 vector from ordinal ``codes``: all zero for the first and for unknown categories."""
    coded = apply_ordinal(df, codes, column, "__at")
    if width == 0:
        return coded.drop("__at").withColumn(name, F.lit(0.0))
    slots = codes.where("code > 0").select((F.col("code") - 1).cast("double").alias("__slot"))
    # An index beyond the last slot counts as invalid, and the slot of invalid values is the one dropped.
    encoder = OneHotEncoder(inputCols=["__slot"], outputCols=[name], handleInvalid="keep", dropLast=True).fit(slots)
    slot = F.when(F.col("__at") > 0, F.col("__at") - 1).otherwise(width).cast("double")
    return encoder.transform(coded.withColumn("__slot", slot)).drop("__at", "__slot")


# --- month columns --------------------------------------------------------------------


def months_to_rows(df: DataFrame, keys: Sequence[str], families: Sequence[str]) -> DataFrame:
    """Twelve suffixed columns per family (``name01`` .. ``name12``) to one row per month."""
    rows = []
    for m in range(1, 13):
        fields = [F.lit(m).alias("month")]
        for f in families:
            name = f"{f}{m:02d}"
            fields.append((F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")).alias(f))
        rows.append(F.struct(*fields))
    drop = {f"{f}{m:02d}" for f in families for m in range(1, 13)}
    rest = [c for c in df.columns if c not in drop and c not in keys]
    return df.select(*keys, *rest, F.inline(F.array(*rows)))
