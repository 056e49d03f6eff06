"""Regional flux on the tables: supplier = cell, nation = inner and region = outer region."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.functions.units import cell_area_m2, flux_factor
from gridstats.operators.uncertainty import half_width, two_level_sigma
from gridstats.plans.flux import (annual_flux, factor_check, mean_over_years, monthly_flux, region_summary, total_flux)

CELL = ["l_suppkey"]
TG = 1e-12


def estimates(t):
    price = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_suppkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), price.alias("estimate"),
        (price * (1 - F.col("l_discount"))).alias("low"), (price * (1 + F.col("l_tax"))).alias("high"))


def lookup(t):
    cells = t.supplier.where("s_acctbal > 0").join(
        t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    factors = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.col("s_acctbal") * (1 + m / 100) * 1e6)
    return cells.select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("outer"), F.col("n_name").alias("inner"),
        (F.col("s_acctbal") * 12e6).alias("factor"), factors.alias("factors"),
        (F.col("s_acctbal") / 1e3).alias("runoff_year"), (F.col("s_acctbal") / 1.1e3).alias("runoff_annual"),
        (F.col("s_acctbal") * 1e4).alias("area_m2"))


SQL_LOOKUP = """
with lk as (
  select s_suppkey as cell, r_name as "outer", n_name as "inner", s_acctbal as b
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where s_acctbal > 0),
est as (
  select l_suppkey as cell, year(l_shipdate) as y, month(l_shipdate) as m, l_extendedprice as e,
         l_extendedprice * (1 - l_discount) as lo, l_extendedprice * (1 + l_tax) as hi
  from lineitem)"""

SQL_MONTHLY = SQL_LOOKUP + """,
mm as (select cell, y, m, avg(e) as e, avg(lo) as lo, avg(hi) as hi from est group by cell, y, m),
fl as (
  select y, "outer", "inner", e, e * (b * (1 + m / 100.0) * 1e6 * 1e-12) as flux,
         (hi - lo) / 2 * (b * (1 + m / 100.0) * 1e6 * 1e-12) as sigma
  from mm join lk using (cell)),
inn as (select y, "outer", "inner", sum(flux) as flux, sum(sigma) as sigma, sum(e) as e from fl group by all),
yr as (select y, "outer", sum(flux) as flux, sqrt(sum(sigma * sigma)) as sb, sum(sigma) as sl, sum(e) as e from inn group by all),
mp as (select y, count(distinct m) as months from est group by y),
nc as (select "outer", count(*) as n from lk group by "outer"),
yearly as (
  select y, "outer", flux, e / months / n as estimate, sb as sigma_block, sl as sigma_linear
  from yr join mp using (y) join nc using ("outer")),
regional as (
  select "outer", sum(flux) / any_value(ny) as flux, sum(estimate) / any_value(ny) as estimate,
         sum(sigma_block) / any_value(ny) as sigma_block, sum(sigma_linear) / any_value(ny) as sigma_linear,
         cast(any_value(ny) as bigint) as n_years
  from yearly cross join (select count(distinct y) as ny from yearly) group by "outer")"""

SQL_ANNUAL = SQL_LOOKUP + """,
mm as (select cell, y, avg(e) as e, avg(lo) as lo, avg(hi) as hi from est group by cell, y),
fl as (
  select y, "outer", "inner", e, e * (b * 12e6 * 1e-12) as flux, (hi - lo) / 2 * (b * 12e6 * 1e-12) as sigma
  from mm join lk using (cell)),
inn as (select y, "outer", "inner", sum(flux) as flux, sum(sigma) as sigma, sum(e) as e, count(e) as n from fl group by all),
yearly as (
  select y, "outer", sum(flux) as flux, sum(e) / sum(n) as estimate, sqrt(sum(sigma * sigma)) as sigma_block,
         sum(sigma) as sigma_linear from inn group by all),
regional as (
  select "outer", avg(flux) as flux, avg(estimate) as estimate, avg(sigma_block) as sigma_block,
         avg(sigma_linear) as sigma_linear, count(*) as n_years from yearly group by "outer")"""

REGION_COLUMNS = """select "outer", round(flux, 6) as flux, round(estimate, 6) as estimate,
  round(sigma_block, 6) as sigma_block, round(sigma_linear, 6) as sigma_linear, n_years from regional"""
TOTAL_COLUMNS = """, tot as (
  select sum(flux) as flux, sqrt(sum(sigma_block * sigma_block)) as sb, sqrt(sum(sigma_linear * sigma_linear)) as sr,
         sum(sigma_linear) as sl from regional)
select round(flux, 6) as flux, round(sb, 6) as sigma_block, round(sr, 6) as sigma_regions, round(sl, 6) as sigma_all_linear,
       round(sb / flux * 100, 6) as relative_pct, round(flux - 1.645 * sb, 6) as lower, round(flux + 1.645 * sb, 6) as upper
from tot"""


def seasonal(t):
    return mean_over_years(monthly_flux(estimates(t), lookup(t), CELL), zero_fill=True)


def annual(t):
    return mean_over_years(annual_flux(estimates(t), lookup(t), CELL))


@query("regional_flux_seasonal", "A41 A9 A10 A11 P32 P33 J6 J7 SRC10 U1", SQL_MONTHLY + REGION_COLUMNS)
def _(t):
    return seasonal(t)


@query("regional_flux_annual", "A42 A9 A10 A11 P32 P33 J6", SQL_ANNUAL + REGION_COLUMNS)
def _(t):
    return annual(t)


@query("yearly_flux_seasonal", "A41 A9 A10", SQL_MONTHLY + """
select y as year, "outer", round(flux, 6) as flux, round(estimate, 6) as estimate, round(sigma_block, 6) as sigma_block,
       round(sigma_linear, 6) as sigma_linear from yearly""")
def _(t):
    return monthly_flux(estimates(t), lookup(t), CELL)


@query("total_flux_seasonal", "A10 A22", SQL_MONTHLY + TOTAL_COLUMNS)
def _(t):
    return total_flux(seasonal(t))


@query("total_flux_annual", "A10 A22", SQL_ANNUAL + TOTAL_COLUMNS)
def _(t):
    return total_flux(annual(t))


@query("two_level_error", "A10 P32 U1", """
with s as (select n_regionkey as r, n_nationkey as n, (l_tax + l_discount) * l_extendedprice / 2e6 as sigma
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
b as (select r, n, sum(sigma) as s from s group by r, n)
select r as n_regionkey, round(sqrt(sum(s * s)), 6) as sigma_block, round(sum(s), 6) as sigma_linear from b group by r""")
def _(t):
    price = F.col("l_extendedprice") / 1e6
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("sigma", half_width(price * (1 - F.col("l_discount")), price * (1 + F.col("l_tax"))))
    return two_level_sigma(rows, ["n_regionkey"], "n_nationkey", "sigma")


@query("flux_factor_consistency", "A44", SQL_LOOKUP + """
select round(sum(b * 12.78e6) / sum(b * 12e6), 6) as factor_ratio, round(avg(b / 1e3) / avg(b / 1.1e3), 6) as runoff_ratio from lk""")
def _(t):
    return factor_check(lookup(t))


@query("region_cell_summary", "A16 U2", SQL_LOOKUP + """
select "outer", round(avg(b / 1e3), 6) as mean_runoff, round(sum(b * 1e4) / 1e6, 6) as area_km2, count(*) as n_cells,
       count(distinct "inner") as n_inner from lk group by "outer" """)
def _(t):
    return region_summary(lookup(t))


@query("cell_areas_and_factors", "P12 P33", """
with c as (select c_custkey, c_acctbal / 250 as lat, abs(c_acctbal) / 1e4 as runoff from customer),
a as (select *, 6371000.0 * 6371000.0 * abs(sin(radians(lat + 0.05)) - sin(radians(lat - 0.05))) * radians(0.1) as area from c)
select c_custkey, round(area / 1e6, 6) as area_km2, round(runoff * area * 1000 * 12.011 / 1e9, 6) as molar_factor,
  round(0.034 * exp(2400.0 * (1.0 / 288.15 - 1.0 / 298.15)) * 1e-6 * runoff * area * 1000 * 12.011 / 1e3, 6) as ppm_factor
from a""")
def _(t):
    c = t.customer.select("c_custkey", (F.col("c_acctbal") / 250).alias("lat"), (F.abs("c_acctbal") / 1e4).alias("runoff"))
    c = c.withColumn("area", cell_area_m2("lat"))
    return c.select("c_custkey", (F.col("area") / 1e6).alias("area_km2"),
                    (flux_factor("runoff", "area") / 1e9).alias("molar_factor"),
                    (flux_factor("runoff", "area", ppm=True) / 1e3).alias("ppm_factor"))
