"""Boosted-tree regression on a log target: fit, score, cross-validate, select, ablate.

Every loop here runs over folds, feature subsets or conditions, whose number is fixed by the
caller; the rows stay in Spark throughout. Fits that do not depend on each other run at the same time: a small
one leaves most of a cluster idle. Folds and subsets read the same packed rows (``operators/trees.py``), subsets some of their columns.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridstats.functions.columns import safe_ln
from gridstats.operators.features import (apply_one_hot_vector, apply_ordinal, apply_target_encoder, fit_imputer, fit_ordinal,
                                          SCALING, fit_scaler, fit_target_encoder, high_missing, impute, one_hot_width, scale)
from gridstats.operators.neighbours import knn_impute
from gridstats.operators.quantiles import exact_median, feature_quantiles, widen
from gridstats.operators.skill import skill_metrics
from gridstats.operators.splits import group_folds
from gridstats.operators.trees import Boosted, Chosen, Packed, fit_trees, packed
from gridstats.operators.uncertainty import conformal_radii, log_intervals, percent, radii_row
from gridstats.operators.scalars import attach_scalars
from gridstats.session import checkpoint_dir, cut_lineage, file_by_file, stored


@dataclass(frozen=True)
class BoostingConfig:
    trees: int = 900
    depth: int = 5
    rate: float = 0.1
    subsample: float = 0.9
    min_child: int = 5
    seed: int = 42


#: Fits under way at once.
PARALLEL = 4
#: Bytes of its rows, about, that a task of a fit reads.
TASK_BYTES = 128 << 20
#: Rows that a single fit may keep as objects.
HELD_ROWS = 1 << 20
ENCODINGS = ("target", "ordinal", "onehot")
ROW, VALUES = "__row", "__values"


@dataclass
class FittedFeatures:
    """Parameters learned on training rows: two one-row frames and one table per category.

    ``donors`` holds the numeric training rows when gaps are filled from neighbours; ``widths`` the
    slots of one-hot vectors.
    """

    numeric: list[str]
    fills: DataFrame
    scaling: DataFrame
    encoders: dict[str, DataFrame] = field(default_factory=dict)
    strategy: dict[str, str] = field(default_factory=dict)
    donors: DataFrame | None = None
    widths: dict[str, int] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return self.numeric + [f"{c}_encoded" for c in self.encoders]

    def without(self, removed: Sequence[str]) -> FittedFeatures:
        """What a fit without some columns gives, where gaps are not filled from neighbours: columns are fitted one by one."""
        if self.donors is not None:
            raise ValueError("neighbours depend on all columns: fit again")
        numeric = [f for f in self.numeric if f not in removed]
        scaling = self.scaling.select(*[f"{f}__{p}" for f in numeric for p in SCALING])
        encoders = {c: t for c, t in self.encoders.items() if c not in removed}
        return FittedFeatures(numeric, self.fills.select(*numeric), scaling, encoders, {c: self.strategy[c] for c in encoders},
                              widths={f"{c}_encoded": self.widths[f"{c}_encoded"] for c in encoders if f"{c}_encoded" in self.widths})

    def fill(self, df: DataFrame) -> DataFrame:
        if self.donors is None:
            return impute(df, self.fills, self.numeric)
        # Row numbers must not change between the branches of the search.
        rows = cut_lineage(df.withColumn(ROW, F.monotonically_increasing_id()))
        return knn_impute(self.donors, rows, self.numeric, ROW).drop(ROW)

    def apply(self, df: DataFrame) -> DataFrame:
        out = scale(self.fill(df), self.scaling, self.numeric)
        for c, table in self.encoders.items():
            name = f"{c}_encoded"
            match self.strategy[c]:
                case "target":
                    out = apply_target_encoder(out, table, c, name)
                case "ordinal":
                    out = apply_ordinal(out, table, c, name)
                case "onehot":
                    out = apply_one_hot_vector(out, table, c, name, self.widths[name])
        return out

    def save(self, path: str) -> None:
        """All parameters under a folder that the cluster shares."""
        tables = {"fills": self.fills, "scaling": self.scaling, **{f"encoder_{i}": t for i, t in enumerate(self.encoders.values())}}
        if self.donors is not None:
            tables["donors"] = self.donors
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        settings = {"numeric": self.numeric, "categories": list(self.encoders), "strategy": self.strategy,
                    "widths": self.widths, "donors": self.donors is not None}
        one = self.fills.sparkSession.range(1).select(F.lit(json.dumps(settings)))
        one.write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedFeatures:
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])

        def table(name: str) -> DataFrame:
            return spark.read.parquet(f"{path}/{name}")

        return cls(settings["numeric"], table("fills"), table("scaling"),
                   {c: table(f"encoder_{i}") for i, c in enumerate(settings["categories"])},
                   settings["strategy"], table("donors") if settings["donors"] else None, settings["widths"])


def fit_features(train: DataFrame, numeric: Sequence[str], categorical: Mapping[str, str], label: str, *,
                 gap_limit: float = 0.5) -> FittedFeatures:
    """Fit imputation, scaling and encodings on training rows only; the small results are materialised.

    When any numeric feature lacks more than ``gap_limit`` of its values, gaps are filled from
    neighbours, else by mean or median. ``train`` is read about ten times: pass a stored or
    checkpointed frame.
    """
    if unknown := set(categorical.values()) - set(ENCODINGS):
        raise ValueError(f"unknown encodings {sorted(unknown)}; use one of {ENCODINGS}")
    numeric = list(numeric)
    fitted = FittedFeatures(numeric, cut_lineage(fit_imputer(train, numeric)), None, strategy=dict(categorical))
    if high_missing(train, numeric, gap_limit).first()["high_missing"]:
        fitted.donors = cut_lineage(train.select(*numeric, F.monotonically_increasing_id().alias(ROW)))
    filled = fitted.fill(train)
    fitted.scaling = cut_lineage(fit_scaler(filled if fitted.donors is None else cut_lineage(filled), numeric))
    for c, how in categorical.items():
        # The planner knows the size of a table: a small one is broadcast, and rows do not go to one task per category.
        fitted.encoders[c] = stored(fit_target_encoder(train, c, label) if how == "target" else fit_ordinal(train, c))
        if how == "onehot":
            fitted.widths[f"{c}_encoded"] = one_hot_width(fitted.encoders[c])
    return fitted


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def concurrently(spark: SparkSession, calls: Sequence[Callable]) -> list:
    """Results of the calls, in their order; the first error is raised."""
    with file_by_file(spark), ThreadPool(max(1, min(PARALLEL, len(calls)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda call: call()), calls, chunksize=1)


def stored_vectors(df: DataFrame, features: Sequence[str], keep: Sequence[str], label: str) -> DataFrame:
    """``features`` as one vector, the label and the columns to keep, written once, in files of what a task of a fit should read.

    Numbers are written as an array (``VALUES``), which is written and read faster than a vector; vectors as they are.
    """
    y = F.col(label).cast("double").alias(label)
    if all(isinstance(df.schema[f].dataType, T.NumericType) for f in features):
        values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
        rows = stored(df.select(values.alias(VALUES), y, *keep), task_rows(len(features)))
        return rows.select(array_to_vector(VALUES).alias("features"), *rows.columns)
    rows = assemble(df, features).select("features", y, *keep)
    one = rows.select("features").first()
    return stored(rows, task_rows(one["features"].size if one else 0))


def packed_vectors(rows: DataFrame, label: str, keep: Sequence[str] = ()) -> Packed:
    """Vectors in blocks."""
    return packed(rows, [VALUES if VALUES in rows.columns else "features"], label, keep)


def chosen_by(column: str, value, others: bool = False) -> Chosen:
    """Rows of blocks whose ``column`` is ``value``, or those where it is something else; a missing one is neither."""
    def rows(block: pa.RecordBatch) -> np.ndarray:
        same = (pc.not_equal if others else pc.equal)(block.column(column), value)
        return pc.fill_null(same, False).to_numpy(zero_copy_only=False)

    return rows


def task_rows(width: int) -> int:
    """Rows, unpacked as a fit keeps them, that a task of a fit should read."""
    return max(1, TASK_BYTES // (8 * width + 400))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in more partitions where one holds more than a task of a fit should read of them, unpacked as a fit keeps them."""
    held = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    seen, one = held.agg(F.max("n").alias("largest"), F.sum("n").alias("n")).first(), rows.select("features").first()
    limit = task_rows(one["features"].size if one else 0)
    return rows if (seen["largest"] or 0) <= limit else rows.repartition(math.ceil(seen["n"] / limit))


def in_task_files(rows: DataFrame) -> DataFrame:
    """``rows`` written once in files of what a task of a fit should read, where ``spread`` would move them: each job of
    a fit that plans its rows anew would run that shuffle again."""
    if spread(rows) is rows:
        return rows
    return stored(rows, task_rows(rows.select("features").first()["features"].size))


def estimator(label: str, config: BoostingConfig) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol=label, maxIter=config.trees, maxDepth=config.depth, stepSize=config.rate,
        subsamplingRate=config.subsample, minInstancesPerNode=config.min_child, seed=config.seed, checkpointInterval=10)


def fit_packed(rows: Packed, label: str, config: BoostingConfig, chosen: Chosen | None = None, places: Sequence[int] | None = None) -> Boosted:
    """A fit to the chosen rows and the features at some places."""
    return fit_trees(rows, estimator(label, config), chosen, places)


def fit_boosted(train: DataFrame, features: Sequence[str], label: str, config: BoostingConfig) -> GBTRegressionModel:
    """One fit. Rows that memory holds as objects go to Spark's own, which starts faster; the method is the same."""
    checkpoint_dir(train.sparkSession)
    if train.count() > HELD_ROWS:
        return fit_packed(packed(train, features, label), label, config).model
    rows = assemble(train, features).select("features", F.col(label).cast("double").alias(label))
    with file_by_file(rows.sparkSession):
        return estimator(label, config).fit(in_task_files(rows))


def score(model: GBTRegressionModel, df: DataFrame, features: Sequence[str], name: str = "log_prediction") -> DataFrame:
    return model.transform(assemble(df, features)).withColumnRenamed("prediction", name).drop("features")


def importances(model: GBTRegressionModel, features: Sequence[str], widths: Mapping[str, int] | None = None) -> list[tuple[str, float]]:
    """Importance per feature column; that of a vector column is the sum over its slots."""
    slots, at, out = model.featureImportances.toArray(), 0, []
    for f in features:
        width = max(1, (widths or {}).get(f, 1))
        out.append((f, float(slots[at:at + width].sum())))
        at += width
    return out


def importance_rollup(folds: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Fold importances (feature, fold, importance) by source column.

    Means add up over the columns derived from one source, deviations combine in quadrature.
    """
    stats = folds.groupBy("feature").agg(F.avg("importance").alias("m"), F.stddev_pop("importance").alias("s"))
    if parents is not None:
        stats = stats.join(parents, "feature", "left").withColumn("source", F.coalesce("source", "feature"))
    else:
        stats = stats.withColumn("source", F.col("feature"))
    return stats.groupBy("source").agg(
        F.sum("m").alias("importance"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("importance_std"),
        F.count(F.lit(1)).alias("n_columns"))


def cross_validate(df: DataFrame, features: Sequence[str], label: str, group: str, k: int, config: BoostingConfig,
                   *, fold: str = "fold", min_group: int = 10, widths: Mapping[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Per-fold skill on the original scale with the median group R2, and per-fold importances."""
    rows = packed(df.where(F.col(fold).isNotNull()), features, label, [group, fold])
    return cross_validate_packed(rows, features, label, group, k, config, fold=fold, min_group=min_group, widths=widths)


def cross_validate_packed(rows: Packed, features: Sequence[str], label: str, group: str, k: int, config: BoostingConfig,
                          *, fold: str = "fold", min_group: int = 10, widths: Mapping[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """``cross_validate`` of packed rows."""
    spark = rows.blocks.sparkSession

    def one(i: int):
        fit = fit_packed(rows, label, config, chosen_by(fold, i, others=True))
        scored = fit.predicted(rows, label, chosen_by(fold, i))
        scored = stored(scored.select(group, F.exp(label).alias("actual"), F.exp("log_prediction").alias("predicted")))
        metrics = skill_metrics(scored, "actual", "predicted").withColumn("fold", F.lit(i))
        per_group = stored(skill_metrics(scored, "actual", "predicted", [group], min_n=min_group).select("r2"))
        typical = exact_median(per_group, [], "r2", "group_median_r2").drop("n").agg(F.max("group_median_r2").alias("v"))
        metrics = attach_scalars(metrics, typical, "g").withColumn("group_median_r2", F.col("g.v")).drop("g")
        return cut_lineage(metrics), [(f, i, v) for f, v in importances(fit.model, features, widths)]

    found = concurrently(spark, [lambda i=i: one(i) for i in range(k)])
    imps = [row for _, part in found for row in part]
    return reduce(DataFrame.unionByName, [m for m, _ in found]), spark.createDataFrame(imps, "feature string, fold int, importance double")


def eliminate_features(df: DataFrame, features: Sequence[str], label: str, k: int, config: BoostingConfig, *,
                       always: Sequence[str] = (), step: int = 3, minimum: int = 10,
                       fold: str = "fold") -> tuple[list[str], DataFrame, GBTRegressionModel]:
    """Survivors of a stepwise elimination, its scores, and the model refitted on the survivors.

    In each fold the features are ranked and dropped on its training rows alone and every subset is
    scored on the held-out rows. The number of features with the best mean R2 (the smaller of equals)
    is then reached by the same elimination on all rows. ``always`` joins in the refit only: all fits read places of one stored vector.
    """

    def without_least(model: GBTRegressionModel, current: list[str], down_to: int) -> list[str]:
        ranked = sorted(importances(model, current), key=lambda p: (p[1], p[0]))
        dropped = {f for f, _ in ranked[:min(step, len(current) - down_to)]}
        return [f for f in current if f not in dropped]

    rows = packed_vectors(stored_vectors(df, [*features, *always], [fold], label), label, [fold])
    place = {f: i for i, f in enumerate(features)}

    def one(i: int) -> dict[int, float]:
        found, current = {}, list(features)
        while True:
            fit = fit_packed(rows, label, config, chosen_by(fold, i, others=True), [place[f] for f in current])
            error = F.avg(F.pow(F.col(label) - F.col("log_prediction"), 2.0))
            r2 = fit.predicted(rows, label, chosen_by(fold, i)).agg((1 - F.try_divide(error, F.var_pop(label))).alias("r2")).first()["r2"]
            found[len(current)] = float("-inf") if r2 is None else r2
            if len(current) <= minimum:
                return found
            current = without_least(fit.model, current, minimum)

    scores: dict[int, list[float]] = {}
    for found in concurrently(df.sparkSession, [lambda i=i: one(i) for i in range(k)]):
        for n, r2 in found.items():
            scores.setdefault(n, []).append(r2)
    trail = []
    for n, found in scores.items():
        mean = sum(found) / k
        trail.append((n, mean, (sum((s - mean) ** 2 for s in found) / k) ** 0.5))
    best = max(trail, key=lambda t: (t[1], -t[0]))[0]
    kept = list(features)
    while len(kept) > best:
        kept = without_least(fit_packed(rows, label, config, places=[place[f] for f in kept]).model, kept, best)
    table = df.sparkSession.createDataFrame(trail, "n_features int, cv_mean double, cv_std double")
    # A vector column among ``always`` takes several places.
    places = [*[place[f] for f in kept], *range(len(features), rows.width)]
    return kept, table.withColumn("selected", F.col("n_features") == best), fit_packed(rows, label, config, places=places).model


GROUP_METRICS = ("r2", "rmsle", "kge", "nse", "relative_error", "mape")


def group_rollup(scored: DataFrame, group: str, min_n: int = 10) -> DataFrame:
    """One row: number of groups, and mean, median and quartiles over groups of each metric."""
    per_group = stored(skill_metrics(scored, "actual", "predicted", [group], min_n).select(*GROUP_METRICS))
    q = feature_quantiles(per_group, GROUP_METRICS, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    q = widen(q, GROUP_METRICS, ["p25", "median", "p75"])
    means = per_group.agg(F.count(F.lit(1)).alias("n_groups"), *[F.avg(m).alias(f"group_{m}_mean") for m in GROUP_METRICS])
    return attach_scalars(means, q, "q").select(
        *means.columns, *[F.col(f"q.{m}__{s}").alias(f"group_{m}_{s}") for m in GROUP_METRICS for s in ("p25", "median", "p75")])


def ablate(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Mapping[str, str], label: str,
           conditions: Mapping[str, Sequence[str]], config: BoostingConfig, *, group: str, k: int = 5,
           min_group: int = 10) -> DataFrame:
    """Refit without each feature group on one shared split, FULL first: one row per condition with
    test skill, ``train_`` skill, R2 over grouped folds and the roll-up of skill per test group."""
    columns = [*dict.fromkeys([*numeric, *categorical, label, group])]
    train, test = stored(train.select(*columns)), stored(test.select(*columns))
    whole = fit_features(train, numeric, categorical, label)

    def one(name: str, removed: Sequence[str]) -> DataFrame:
        kept = [f for f in numeric if f not in removed]
        cats = {c: s for c, s in categorical.items() if c not in removed}
        fitted = whole.without(removed) if whole.donors is None else fit_features(train, kept, cats, label)
        dealt = fitted.apply(group_folds(train, group, k))
        ready = packed(dealt, fitted.names, label, [group, "fold"])
        fit = fit_packed(ready, label, config)

        def scored(rows: Packed) -> DataFrame:
            return stored(fit.predicted(rows, label).select(group, F.exp(label).alias("actual"), F.exp("log_prediction").alias("predicted")))

        held = scored(packed(fitted.apply(test), fitted.names, label, [group]))
        folds, _ = cross_validate_packed(ready, fitted.names, label, group, k, config, min_group=min_group, widths=fitted.widths)
        seen = skill_metrics(scored(ready), "actual", "predicted")
        row = skill_metrics(held, "actual", "predicted").withColumns({
            "condition": F.lit(name), "n_features": F.lit(sum(max(1, fitted.widths.get(f, 1)) for f in fitted.names))})
        for part in (seen.select(*[F.col(c).alias(f"train_{c}") for c in seen.columns]),
                     folds.agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std")),
                     group_rollup(held, group, min_group)):
            row = attach_scalars(row, part, "__s").select("*", "__s.*").drop("__s")
        return cut_lineage(row)

    rows = concurrently(train.sparkSession, [lambda n=n, r=r: one(n, r) for n, r in {"FULL": [], **conditions}.items()])
    return reduce(DataFrame.unionByName, rows)


def fit_with_intervals(fit_rows: DataFrame, calibration: DataFrame, features: Sequence[str], label: str,
                       levels: Sequence[float], config: BoostingConfig) -> tuple[GBTRegressionModel, DataFrame]:
    """Model fitted without the calibration groups, and the radii those groups give."""
    return _with_radii(fit_packed(packed(fit_rows, features, label), label, config), packed(calibration, features, label), None, label, levels)


def fit_packed_with_intervals(rows: Packed, calibration: str, label: str, levels: Sequence[float],
                              config: BoostingConfig) -> tuple[GBTRegressionModel, DataFrame]:
    """``fit_with_intervals`` of packed rows; the kept column ``calibration`` is true for those that give the radii."""
    fit = fit_packed(rows, label, config, chosen_by(calibration, False))
    return _with_radii(fit, rows, chosen_by(calibration, True), label, levels)


def _with_radii(fit: Boosted, calibration: Packed, chosen: Chosen | None, label: str, levels: Sequence[float]) -> tuple[GBTRegressionModel, DataFrame]:
    # Written once: a prediction costs more than reading one number.
    residuals = stored(fit.predicted(calibration, label, chosen).select(F.abs(F.col(label) - F.col("log_prediction")).alias("residual")))
    return fit.model, cut_lineage(conformal_radii(residuals, "residual", levels))


def score_with_intervals(model: GBTRegressionModel, df: DataFrame, features: Sequence[str], radii: DataFrame,
                         levels: Sequence[float]) -> DataFrame:
    """Prediction and bounds on the original scale, as floats, next to the input columns."""
    scored = attach_scalars(score(model, df, features), radii_row(radii, levels), "__r")
    return scored.withColumns(log_intervals(
        "log_prediction", {percent(lv): f"__r.r{percent(lv)}" for lv in levels})).drop("__r")


def log_target(df: DataFrame, target: str, name: str = "log_target") -> DataFrame:
    """Natural logarithm of a positive target; rows without one are dropped."""
    return df.withColumn(name, safe_ln(target)).where(F.col(name).isNotNull())
