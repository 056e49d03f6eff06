"""Stream efflux per region from reaches and from pixels, and its comparison with another flux."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridstats.functions.columns import clip
from gridstats.functions.units import (SECONDS_PER_YEAR, TERAGRAM_PER_GRAM, ZERO_C_IN_K, area_yield, misfit_to_ppm,
                                       ppm_to_g_per_m3, reach_area_m2, solubility, water_temperature)
from gridstats.operators.quantiles import exact_median
from gridstats.operators.summaries import pivot_fixed, share_of_true, two_level_mean
from gridstats.operators.uncertainty import ratio_with_bounds
from gridstats.session import cut_lineage

# Published coefficient and error tables.
DRYING = [  # stream order, then a, b, c of the drying share and d, e, f of the dry time
    (1, -0.009, 0.029, 0.77, -0.0019, 0.017, 0.026),
    (2, -0.009, 0.029, 0.61, -0.0021, 0.011, 0.088),
    (3, -0.008, 0.028, 0.44, -0.0018, 0.011, 0.058),
    (4, -0.005, 0.023, 0.27, -0.0028, 0.012, 0.127),
]
FALLBACK_AREA_SHARE = {1: 0.30, 2: 0.20, 3: 0.15, 4: 0.10}
MONTHLY_EMISSION = [115, 112, 137, 174, 208, 209, 205, 203, 174, 144, 114, 112]
MONTHLY_SIGMA = [20, 20, 30, 30, 20, 20, 10, 20, 20, 10, 20, 20]
ANNUAL_RELATIVE_SIGMA = 200 / 1970
FREEZING_LIMIT_C = -4.0
MELT_SHARE = 0.17
PUBLISHED_ERROR_TG = 23.0
MIN_WIDTH_M = 0.3
STREAM_ORDERS = tuple(range(1, 12))


def by_month(table: Sequence[float], month: str | Column = "month") -> Column:
    m = F.col(month) if isinstance(month, str) else month
    return F.element_at(F.array(*[F.lit(float(v)) for v in table]), m.cast("int"))


# --- climate --------------------------------------------------------------------------


def climate_rows(documents: DataFrame, column: str = "climate") -> DataFrame:
    """Map of region to struct of arrays into rows (outer, month, temp, prec)."""
    regions = documents.select(F.explode(column).alias("outer", "c"))
    return regions.select("outer", F.posexplode(F.arrays_zip("c.temp", "c.prec")).alias("m", "v")).select(
        "outer", (F.col("m") + 1).alias("month"), F.col("v.temp").alias("temp"), F.col("v.prec").alias("prec"))


def region_water_temperature(documents: DataFrame, column: str = "climate") -> DataFrame:
    regions = documents.select(F.explode(column).alias("outer", "c"))
    return regions.select("outer", water_temperature("c.temp").alias("water_c"))


# --- reaches --------------------------------------------------------------------------


def prepared_reaches(reaches: DataFrame) -> DataFrame:
    """Reach area and flux; a reach narrower than the minimum keeps a false ``kept`` flag."""
    own = "own_area_m2" if "own_area_m2" in reaches.columns else None
    out = reaches.withColumns({
        "kept": F.coalesce(F.col("width_m") >= MIN_WIDTH_M, F.lit(False)),
        "is_river": F.coalesce(F.col("kind") == "River", F.lit(False)),
        "area_m2": reach_area_m2("kind", "length_km", "width_m", own)})
    return out.withColumn("flux_g", F.col("rate") * F.col("area_m2"))


def _kept(value: str, *more: Column) -> Column:
    test = F.col("kept")
    for m in more:
        test = test & m
    return F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0.0))


def basin_statistics(reaches: DataFrame) -> DataFrame:
    """Per (outer, inner): sums, river and lake parts, counts and means over the kept reaches."""
    r = prepared_reaches(reaches)
    river, lake = F.col("is_river"), ~F.col("is_river")
    return r.groupBy("outer", "inner").agg(
        _kept("flux_g").alias("flux_g"), _kept("area_m2").alias("area_m2"), _kept("length_km").alias("length_km"),
        _kept("flux_g", river).alias("river_flux_g"), _kept("flux_g", lake).alias("lake_flux_g"),
        _kept("area_m2", river).alias("river_area_m2"), _kept("area_m2", lake).alias("lake_area_m2"),
        F.count_if("kept").alias("n_reaches"), F.count_if(~F.col("kept")).alias("n_filtered_out"),
        F.count_if(F.col("kept") & river).alias("n_rivers"), F.count_if(F.col("kept") & lake).alias("n_lakes"),
        *[F.avg(F.when(F.col("kept"), F.col(c))).alias(f"mean_{c}") for c in ("rate", "ppm", "width_m", "discharge")])


def _weighted(value: str) -> Column:
    v, w = F.col(value), F.col("n_reaches")
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def reach_efflux(reaches: DataFrame) -> DataFrame:
    """Per outer region: efflux, areas, counts, weighted means and medians over its base reaches."""
    basins = basin_statistics(reaches)
    sums = ("flux_g", "area_m2", "length_km", "river_flux_g", "lake_flux_g", "river_area_m2", "lake_area_m2",
            "n_reaches", "n_filtered_out", "n_rivers", "n_lakes")
    regions = basins.groupBy("outer").agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n_inner"),
        *[_weighted(f"mean_{c}").alias(f"mean_{c}") for c in ("rate", "ppm", "width_m", "discharge")])
    kept = prepared_reaches(reaches).where("kept")
    rivers = exact_median(kept.where("is_river"), ["outer"], "exchange", "exchange_river").drop("n")
    lakes = exact_median(kept.where("not is_river"), ["outer"], "exchange", "exchange_lake").drop("n")
    joined = regions.join(rivers, "outer", "left").join(lakes, "outer", "left").fillna(0.0, ["exchange_river", "exchange_lake"])
    return joined.withColumns({
        "flux_tg": F.col("flux_g") * TERAGRAM_PER_GRAM, "area_km2": F.col("area_m2") / 1e6,
        "river_share_pct": F.try_divide("river_flux_g", "flux_g") * 100})


def flux_by_order(reaches: DataFrame) -> DataFrame:
    """Flux per stream order 1..11, one zero-filled column each."""
    kept = prepared_reaches(reaches).where("kept").where(F.col("order").isin(list(STREAM_ORDERS)))
    return pivot_fixed(kept, ["outer"], "order", STREAM_ORDERS, F.sum("flux_g"), "flux_order_", 0.0)


def area_by_order(reaches: DataFrame, wide: bool = True) -> DataFrame:
    """Area per stream order 1..11: one zero-filled column each, or long rows (outer, order, area_m2)."""
    kept = prepared_reaches(reaches).where("kept").where(F.col("order").isin(list(STREAM_ORDERS)))
    if wide:
        return pivot_fixed(kept, ["outer"], "order", STREAM_ORDERS, F.sum("area_m2"), "area_order_", 0.0)
    return kept.groupBy("outer", "order").agg(F.sum("area_m2").alias("area_m2"))


def calibration_error(reaches: DataFrame, calibration: DataFrame, water: DataFrame, default_c: float = 15.0) -> DataFrame:
    """Per inner basin: flux error implied by its calibration misfit; basins without one get zero.

    ``calibration`` is (inner, outer, fitness), ``water`` (outer, water_c).
    """
    fit = calibration.join(water, "outer", "left").withColumn("water_c", F.coalesce("water_c", F.lit(default_c)))
    fit = fit.withColumns({"delta_ppm": misfit_to_ppm("fitness"), "solubility": solubility("water_c")})
    fit = fit.withColumn("delta_g_m3", ppm_to_g_per_m3("delta_ppm", "water_c")).drop("outer")
    kept = cut_lineage(prepared_reaches(reaches).where("kept").select("outer", "inner", "exchange", "area_m2"))
    exchange = exact_median(kept, ["outer", "inner"], "exchange", "exchange").drop("n")
    areas = kept.groupBy("outer", "inner").agg(F.sum("area_m2").alias("area_m2"))
    joined = areas.join(exchange, ["outer", "inner"], "left").join(fit, "inner", "left")
    error = F.coalesce(F.col("exchange"), F.lit(0.0)) * F.col("delta_g_m3") * F.col("area_m2") * SECONDS_PER_YEAR * TERAGRAM_PER_GRAM
    return joined.withColumn("error_tg", F.when(F.col("delta_g_m3").isNull(), 0.0).otherwise(error))


def calibration_error_by_region(basins: DataFrame) -> DataFrame:
    basins = cut_lineage(basins)
    median_delta = exact_median(basins, ["outer"], "delta_ppm", "median_delta_ppm").drop("n")
    sums = basins.groupBy("outer").agg(
        F.sum("error_tg").alias("error_tg"), F.count("inner").alias("n_inner"), F.avg("fitness").alias("mean_fitness"),
        F.avg("water_c").alias("mean_water_c"), F.avg("solubility").alias("mean_solubility"))
    return sums.join(median_delta, "outer", "left")


# --- pixels and corrections -----------------------------------------------------------


def pixel_rates(pixels: DataFrame) -> DataFrame:
    """Mean over months of the monthly mean rate, and mean number of pixels, per region."""
    monthly = pixels.where(F.col("rate").isNotNull()).groupBy("outer", "month").agg(
        F.avg("rate").alias("rate"), F.count("rate").alias("n"))
    return monthly.groupBy("outer").agg(F.avg("rate").alias("mean_rate"), F.avg("n").alias("mean_pixels"))


def dry_share(order: str, temp: str, prec: str) -> Column:
    """Share of a stream order's area that is dry: drying share times dry time, both within 0..0.9."""
    out = F.lit(None).cast("double")
    for o, a, b, c, d, e, f in DRYING:
        share = clip(F.lit(a) * F.col(prec) + F.lit(b) * F.col(temp) + F.lit(c), 0.0, 0.9)
        time = clip(F.lit(d) * F.col(prec) + F.lit(e) * F.col(temp) + F.lit(f), 0.0, 0.9)
        out = F.when(F.col(order) == o, share * time).otherwise(out)
    return out


def effective_area(areas: DataFrame, climate: DataFrame, by_order: DataFrame | None = None) -> DataFrame:
    """Area left after intermittency, averaged over the months: (outer, total, ephemeral, effective, pct).

    ``areas`` is (outer, area_km2); ``by_order`` (outer, order, area_km2) replaces the fixed shares
    of the total where it has a row.
    """
    orders = F.explode(F.array(*[F.struct(F.lit(o).alias("order"), F.lit(s).alias("share")) for o, s in FALLBACK_AREA_SHARE.items()]))
    rows = areas.select("outer", "area_km2", orders.alias("o")).select("outer", "area_km2", "o.order", "o.share")
    if by_order is not None:
        rows = rows.join(by_order.select("outer", "order", F.col("area_km2").alias("own")), ["outer", "order"], "left")
    else:
        rows = rows.withColumn("own", F.lit(None).cast("double"))
    rows = rows.withColumn("order_km2", F.coalesce("own", F.col("area_km2") * F.col("share")))
    dry = rows.join(climate, "outer").withColumn("dry_km2", F.col("order_km2") * dry_share("order", "temp", "prec"))
    monthly = dry.groupBy("outer", "month").agg(F.max("area_km2").alias("area_km2"), F.sum("dry_km2").alias("dry_km2"))
    return monthly.groupBy("outer").agg(
        F.max("area_km2").alias("total_km2"), F.avg("dry_km2").alias("ephemeral_km2"),
        F.avg(F.col("area_km2") - F.col("dry_km2")).alias("effective_km2")).withColumn(
        "reduction_pct", F.when(F.col("total_km2") > 0, F.col("ephemeral_km2") / F.col("total_km2") * 100).otherwise(0.0))


def frozen_share(temperatures: DataFrame, kelvin: str = "t2m") -> DataFrame:
    """(outer, month, share): share of cells below the freezing limit, averaged over years."""
    return share_of_true(temperatures, ["outer", "month"], ["year"], F.col(kelvin) - ZERO_C_IN_K < FREEZING_LIMIT_C)


def melt_months(shares: DataFrame, wrap: bool = False) -> DataFrame:
    """Per region: annual mean share and number of months with less ice than the month before.

    January has no predecessor unless ``wrap`` compares it with December.
    """
    w = Window.partitionBy("outer").orderBy("month")
    before = F.lag("share").over(w)
    if wrap:
        before = F.coalesce(before, F.last("share").over(Window.partitionBy("outer").orderBy("month").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))
    return shares.withColumn("melting", F.col("share") < before).groupBy("outer").agg(
        F.avg("share").alias("frozen_annual"), F.count_if("melting").alias("n_melt_months"))


def correction_cascade(rates: DataFrame, areas: DataFrame, effective: DataFrame | None, frozen: DataFrame | None) -> DataFrame:
    """Flux from raw area, after intermittency, after ice, with melt added back.

    ``rates`` (outer, mean_rate), ``areas`` (outer, area_km2), ``effective`` (outer, effective_km2),
    ``frozen`` (outer, month, share). Without climate input every stage equals the raw one.
    """
    base = rates.select("outer", "mean_rate").join(areas.select("outer", "area_km2"), "outer", "left")
    if effective is None:
        base = base.withColumn("effective_km2", F.col("area_km2"))
    else:
        base = base.join(effective.select("outer", "effective_km2"), "outer", "left")
    if effective is None or frozen is None:
        base = base.withColumns({"frozen_annual": F.lit(0.0), "n_melt_months": F.lit(0)})
    else:
        base = base.join(melt_months(frozen), "outer", "left").fillna({"frozen_annual": 0.0, "n_melt_months": 0})
    # The mean over months of effective * (1 - share) is effective * (1 - mean share).
    base = base.withColumn("active_km2", F.col("effective_km2") * (1 - F.col("frozen_annual")))
    unit = F.col("mean_rate") * F.lit(1e6 * TERAGRAM_PER_GRAM)
    out = base.withColumns({
        "flux_raw": unit * F.col("area_km2"), "flux_effective": unit * F.col("effective_km2"),
        "flux_active": unit * F.col("active_km2")})
    out = out.withColumn("flux_melt", F.col("flux_active") * MELT_SHARE * F.col("n_melt_months") / 12)
    return out.withColumn("flux_final", F.col("flux_active") + F.col("flux_melt"))


def cascade_totals(cascade: DataFrame) -> DataFrame:
    """One row: totals of every stage and the reduction each step brings."""
    stages = ("area_km2", "effective_km2", "active_km2", "flux_raw", "flux_effective", "flux_active", "flux_melt", "flux_final")
    t = cascade.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in stages])

    def drop(a: str, b: str) -> Column:
        return F.try_divide(F.col(a) - F.col(b), F.col(a)) * 100

    return t.withColumns({
        "area_effective_pct": drop("area_km2", "effective_km2"), "area_active_pct": drop("effective_km2", "active_km2"),
        "flux_effective_pct": drop("flux_raw", "flux_effective"), "flux_active_pct": drop("flux_effective", "flux_active"),
        "flux_final_pct": drop("flux_raw", "flux_final")})


def monthly_sigma(monthly_rates: DataFrame, cascade: DataFrame) -> DataFrame:
    """Error of a region's flux: monthly relative errors times monthly flux, added linearly.

    A month without its own rate uses the region's mean rate. ``monthly_rates``: (outer, month, rate).
    """
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    grid = cascade.select("outer", "mean_rate", "active_km2", "flux_final", months)
    joined = grid.join(monthly_rates, ["outer", "month"], "left")
    relative = by_month([s / e for s, e in zip(MONTHLY_SIGMA, MONTHLY_EMISSION)])
    flux = F.coalesce("rate", "mean_rate") * F.col("active_km2") * F.lit(1e6 * TERAGRAM_PER_GRAM) / 12
    return joined.groupBy("outer").agg(F.max("flux_final").alias("flux"), F.sum(flux * relative).alias("sigma")).withColumns({
        "lower": F.col("flux") - F.col("sigma"), "upper": F.col("flux") + F.col("sigma")})


# --- comparison -----------------------------------------------------------------------


def contribution(flux: DataFrame, reference: DataFrame, areas: DataFrame) -> DataFrame:
    """Flux as a percentage of a reference flux, with asymmetric bounds and yields of both.

    ``flux`` and ``reference`` are (outer, central, lower, upper), ``areas`` (outer, area_km2).
    """
    joined = areas.select("outer", "area_km2").join(flux, "outer", "left").join(
        reference.withColumnsRenamed({c: f"ref_{c}" for c in ("central", "lower", "upper")}), "outer", "left")
    pct = ratio_with_bounds(("central", "lower", "upper"), ("ref_central", "ref_lower", "ref_upper"))
    return joined.withColumns({
        "pct": pct[0], "pct_lower": pct[1], "pct_upper": pct[2],
        "yield": area_yield("central", "area_km2"), "ref_yield": area_yield("ref_central", "area_km2")})


def monthly_mean_rates(pixels: DataFrame) -> DataFrame:
    return pixels.where(F.col("rate").isNotNull()).groupBy("outer", "month").agg(F.avg("rate").alias("rate"))


def pixel_month_mean(pixels: DataFrame, value: str, name: str) -> DataFrame:
    return two_level_mean(pixels, ["outer"], ["month"], value, name)
