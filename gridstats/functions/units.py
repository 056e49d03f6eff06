"""Unit conversions and physical formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from gridstats.functions.columns import ColumnLike, col

# Physical constants and published coefficients.
EARTH_RADIUS_M = 6_371_000.0
CARBON_G_PER_MOL = 12.011
CO2_G_PER_MOL = 44.009
CO2_KG_PER_MOL = 0.04401
TERAGRAM_PER_GRAM = 1e-12
SECONDS_PER_YEAR = 365.25 * 24 * 3600
HENRY_25C = 0.034
HENRY_ENTHALPY_K = 2400.0
REFERENCE_K = 298.15
ZERO_C_IN_K = 273.15
HENRY_LOG10_TERMS = (108.3865, 0.01985076, -6919.53, -40.4515, 669365.0)
WATER_TEMPERATURE_LINE = (3.941, 0.818)
WATER_TEMPERATURE_FLOOR_C = 0.1
Z_90, Z_95 = 1.645, 1.960


def henry_constant(temperature_c: float = 15.0) -> float:
    """Van 't Hoff solubility in mol/L/atm at one fixed temperature."""
    kelvin = temperature_c + ZERO_C_IN_K
    return HENRY_25C * math.exp(HENRY_ENTHALPY_K * (1.0 / kelvin - 1.0 / REFERENCE_K))


def solubility(water_c: ColumnLike) -> Column:
    """Five-term log10 solubility by water temperature, mol/L/atm."""
    k = col(water_c) + F.lit(ZERO_C_IN_K)
    a, b, c, d, e = (F.lit(v) for v in HENRY_LOG10_TERMS)
    return F.pow(F.lit(10.0), a + b * k + c / k + d * F.log10(k) + e / (k * k))


def ppm_to_g_per_m3(ppm: ColumnLike, water_c: ColumnLike) -> Column:
    return col(ppm) * F.lit(1e-6) * solubility(water_c) * F.lit(1000.0) * F.lit(12.01)


def water_temperature(air_months: ColumnLike) -> Column:
    """Stream temperature from an array of monthly air temperatures."""
    values = col(air_months)
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)
    intercept, slope = WATER_TEMPERATURE_LINE
    return F.greatest(F.lit(intercept) + F.lit(slope) * mean, F.lit(WATER_TEMPERATURE_FLOOR_C))


def misfit_to_ppm(fitness: ColumnLike) -> Column:
    """Calibration misfit to a half-width in ppm; the misfit is floored first."""
    f = col(fitness)
    return F.lit(1.0) / F.when(f < 1e-10, F.lit(1e-10)).otherwise(f) / F.lit(2.0)


def molality_to_molarity(molality: ColumnLike, density: float = 1.0) -> Column:
    m = col(molality)
    return m * F.lit(density) / (F.lit(1.0) + m * F.lit(CO2_KG_PER_MOL))


def cell_area_m2(latitude: ColumnLike, dlat: float = 0.1, dlon: float = 0.1) -> Column:
    """Area of a latitude-longitude cell on the sphere."""
    lat = col(latitude)
    upper = F.sin(F.radians(lat + F.lit(dlat / 2)))
    lower = F.sin(F.radians(lat - F.lit(dlat / 2)))
    return F.lit(EARTH_RADIUS_M ** 2) * F.abs(upper - lower) * F.lit(math.radians(dlon))


def flux_factor(runoff_m: ColumnLike, area_m2: ColumnLike, *, ppm: bool = False,
                temperature_c: float = 15.0) -> Column:
    """Grams of carbon carried per unit concentration by a runoff depth over an area."""
    factor = col(runoff_m) * col(area_m2) * F.lit(1000.0) * F.lit(CARBON_G_PER_MOL)
    return F.lit(henry_constant(temperature_c) * 1e-6) * factor if ppm else factor


def area_yield(flux_tg: ColumnLike, area_km2: ColumnLike) -> Column:
    """Grams per square metre and year from teragrams per year over square kilometres."""
    return F.try_divide(col(flux_tg) / F.lit(TERAGRAM_PER_GRAM), col(area_km2) * F.lit(1e6))


def molar_to_mg_per_l(molar: ColumnLike) -> Column:
    return col(molar) * F.lit(CO2_G_PER_MOL) * F.lit(1000.0)


def molar_to_ppm(molar: ColumnLike, temperature_c: float = 15.0) -> Column:
    return col(molar) / F.lit(henry_constant(temperature_c) * 1e-6)


def kelvin_to_celsius(kelvin: ColumnLike) -> Column:
    return col(kelvin) - F.lit(ZERO_C_IN_K)


def reach_area_m2(kind: ColumnLike, length_km: ColumnLike, width_m: ColumnLike,
                  own_area: ColumnLike | None = None, river: str = "River") -> Column:
    """Rivers: length times width. Others: their own surface when numeric, else the same product."""
    product = col(length_km) * F.lit(1000.0) * col(width_m)
    if own_area is None:
        return product
    own = F.nanvl(col(own_area).try_cast("double"), F.lit(None).cast("double"))
    return F.when(col(kind) == river, product).otherwise(F.coalesce(own, product))
