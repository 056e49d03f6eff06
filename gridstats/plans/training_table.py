"""From point extractions and chemistry to a clean training table, one row per site and date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridstats.functions.columns import code_prefix, lenient_date, safe_log10, clip, text_match
from gridstats.functions.units import molality_to_molarity
from gridstats.operators.dedup import keep_first
from gridstats.operators.joins import suffix_join
from gridstats.operators.neighbours import isolation_filter
from gridstats.operators.outliers import in_ranges, stratified_iqr_filter, within_group_filter
from gridstats.session import cut_and_count

# Keys of the extractions, physical limits, excluded sites.
KEYS = ["CO2_ppm", "Date", "MonitoringLocation", "PFAF_ID", "HYBAS_ID"]
LIMITS = {
    "CO2_aq": (1e-6, 0.05), "ResultMeasure_pH": (4.0, 10.5), "Alkalinity_mg.L.CaCO3": (0.0, 2000.0),
    "ResultMeasure_tempC": (0.0, 50.0),
}
EXCLUDED_PREFIXES = ("USGS-404", "USGS-390")
EXCLUDED_SITES = ("USGS-393633103512300", "USGS-393702103544100", "USGS-394333103525100")


def merge_extractions(daily: DataFrame, monthly: DataFrame, land: DataFrame, *, null_safe: bool = True) -> DataFrame:
    """Wells only (no hyporheic sites), joined to monthly and land-surface columns on the five keys."""
    wells = daily.where(text_match("siteType", contains="Well", ignore_case=True) & ~text_match("siteType", contains="Hyporheic"))
    monthly = monthly.withColumnsRenamed({c: f"{c}_month" for c in monthly.columns if c not in KEYS})
    joined = suffix_join(wells, monthly, KEYS, null_safe=null_safe)
    return suffix_join(joined, land, KEYS, null_safe=null_safe).where(F.col("t2m").isNotNull())


def add_chemistry(points: DataFrame, chemistry: DataFrame) -> DataFrame:
    """Solved molality by site and date, as molarity; rows without chemistry are dropped."""
    chem = chemistry.select(lenient_date("Date", two_digit_year=True).alias("Date"), "MonitoringLocation", "molality_CO2")
    chem = chem.where(F.col("molality_CO2").isNotNull())
    points = points.withColumn("Date", lenient_date("Date"))
    return points.join(chem, ["Date", "MonitoringLocation"], "inner").withColumn("CO2_aq", molality_to_molarity("molality_CO2"))


def clean(points: DataFrame, features: Sequence[str], weather: Sequence[str], order: Sequence[str], *,
          k: int = 5, report: list[tuple[str, int]] | None = None) -> DataFrame:
    """Physical limits, own-site median, stratum spread, covariate isolation, duplicate weather, bad sites.

    The filters are sequential: each one takes its statistics from the rows that are left, and reads
    them several times. Every stage is therefore written once; left lazy, the passes would multiply. The rows of
    a stage are counted as they are written and go to ``report`` with its name.
    """
    def stage(name: str, df: DataFrame) -> DataFrame:
        held, rows = cut_and_count(df)
        if report is not None:
            report.append((name, rows))
        return held

    out = stage("merged", points)
    out = stage("physical limits", in_ranges(out, LIMITS))
    out = out.withColumn("__log", safe_log10("CO2_aq"))
    out = stage("own site", within_group_filter(out, "MonitoringLocation", "__log", max_deviation=2.0, min_n=4))
    out = out.withColumn("__log", safe_log10(clip("CO2_aq", lower=1e-12)))
    out = stage("stratum", stratified_iqr_filter(out, ["season", "HUC2"], "__log", k=3.5, min_n=20).drop("__log"))
    out = stage("isolation", isolation_filter(out, list(features), k=k, share=0.99))
    out = stage("duplicate weather", keep_first(out, list(weather), list(order)))
    site = F.col("MonitoringLocation")
    bad = site.isin(list(EXCLUDED_SITES))
    for p in EXCLUDED_PREFIXES:
        bad = bad | text_match(site, starts_with=p)
    return stage("listed sites", out.where(~F.coalesce(bad, F.lit(False))))


def training_table(daily: DataFrame, monthly: DataFrame, land: DataFrame, chemistry: DataFrame, features: Sequence[str],
                   weather: Sequence[str], order: Sequence[str], report: list[tuple[str, int]] | None = None) -> DataFrame:
    points = add_chemistry(merge_extractions(daily, monthly, land), chemistry)
    points = points.withColumn("HUC2", code_prefix("HUC8", 8, 2))
    return clean(points, features, weather, order, report=report)


def attrition_table(spark: SparkSession, report: Sequence[tuple[str, int]]) -> DataFrame:
    """Rows left after each stage and how many it dropped."""
    rows = [(i, name, n, (report[i - 1][1] if i else n) - n) for i, (name, n) in enumerate(report)]
    return spark.createDataFrame(rows, "step int, stage string, n_rows long, dropped long")
