"""Intervals, conformal radii, coverage, ratios with bounds."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.catalog.flux import SQL_ANNUAL, annual
from gridstats.catalog.statistics import SQL_PAIRS, pairs
from gridstats.functions.columns import ratio
from gridstats.functions.units import area_yield
from gridstats.operators import uncertainty as u
from gridstats.operators.scalars import attach_scalars
from gridstats.plans.contribution import contribution

LEVELS = (0.68, 0.90, 0.95)
def residuals(t):
    return pairs(t).where("l_returnflag = 'R'").select(F.abs(F.ln("y") - F.ln("p")).alias("r"))


# The quantile position is interpolated by hand: SQL quantiles want constant fractions.
SQL_RADII = SQL_PAIRS + """
, cal as (select abs(ln(y) - ln(p)) as r, row_number() over (order by abs(ln(y) - ln(p))) - 1 as k from pr where l_returnflag = 'R'),
n as (select count(*) as n from cal),
pos as (select level, n, (n - 1) * least(ceil((n + 1) * level) / n, 1.0) as h from n cross join (select unnest([0.68::double, 0.90::double, 0.95::double]) as level)),
radii as (select level, n, lo.r + (hi.r - lo.r) * (h - floor(h)) as radius from pos join cal lo on lo.k = floor(h) join cal hi on hi.k = ceil(h))"""


@query("conformal_radii", "M16 J20", SQL_RADII + "select level, n, round(radius, 6) as radius from radii")
def _(t):
    return u.conformal_radii(residuals(t), "r", LEVELS)


@query("radius_spans", "P30", SQL_RADII + """
select level, round(exp(radius), 6) as multiplier, round(2 * radius / ln(10.0), 6) as decades from radii""")
def _(t):
    spans = u.radius_span("radius")
    return u.conformal_radii(residuals(t), "r", LEVELS).select("level", *[e.alias(n) for n, e in spans.items()])


def held_out(t):
    radii = u.radii_row(u.conformal_radii(residuals(t), "r", LEVELS), LEVELS)
    rows = attach_scalars(pairs(t).where("l_returnflag <> 'R'"), radii, "r")
    return rows.select("l_suppkey", "y", "p", F.exp(F.ln("p") - F.col("r.r90")).alias("low"), F.exp(F.ln("p") + F.col("r.r90")).alias("high"))


@query("log_intervals", "P29", SQL_RADII + """
, w as (select max(radius) filter (level = 0.68) as r68, max(radius) filter (level = 0.95) as r95 from radii)
select l_suppkey, round(avg(p::float::double), 4) as predicted, round(avg(exp(ln(p) - r68)::float::double), 4) as lower_68, round(avg(exp(ln(p) + r68)::float::double), 4) as upper_68,
  round(avg(exp(ln(p) - r95)::float::double), 4) as lower_95, round(avg(exp(ln(p) + r95)::float::double), 4) as upper_95 from pr cross join w group by l_suppkey""", digits=4)
def _(t):
    radii = u.radii_row(u.conformal_radii(residuals(t), "r", LEVELS), LEVELS)
    rows = attach_scalars(pairs(t), radii, "r").withColumn("lp", F.ln("p"))
    rows = rows.select("l_suppkey", *[e.alias(n) for n, e in u.log_intervals("lp", {68: "r.r68", 95: "r.r95"}).items()])
    return rows.groupBy("l_suppkey").agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in ("predicted", "lower_68", "upper_68", "lower_95", "upper_95")])


SQL_HELD = SQL_RADII + """
, h as (select l_suppkey, y, p, exp(ln(p) - radius) as lo, exp(ln(p) + radius) as hi from pr cross join (select radius from radii where level = 0.90) where l_returnflag <> 'R')
select {key} count(*) as n, round(avg((y between lo and hi)::int), 6) as coverage, count(*) filter (not y between lo and hi) as n_missed,
  round(median(hi - lo), 6) as median_width, round(median((hi - lo) / p), 6) as median_relative_width from h {group}"""


@query("interval_coverage", "A43 M16", SQL_HELD.format(key="", group=""))
def _(t):
    return u.coverage(held_out(t), "y", "p", "low", "high")


@query("interval_coverage_per_group", "A43", SQL_HELD.format(key="l_suppkey,", group="group by l_suppkey"))
def _(t):
    return u.coverage(held_out(t), "y", "p", "low", "high", ["l_suppkey"])


@query("residual_summary", "M19", SQL_PAIRS + """
, c as (select abs(ln(y) - ln(p)) as r from pr where l_returnflag = 'R')
select round(avg(r), 6) as mean, round(stddev_pop(r), 6) as std, count(*) as n, round(median(r), 6) as median, round(quantile_cont(r, 0.9), 6) as p90, round(quantile_cont(r, 0.95), 6) as p95 from c""")
def _(t):
    return u.residual_summary(residuals(t), "r")


SQL_REGIONS = SQL_ANNUAL + """,
ref as (select r_name as "outer", sum(o_totalprice) / 1e9 as central, sum(o_totalprice) * 0.9 / 1e9 as lo, sum(o_totalprice) * 1.2 / 1e9 as hi
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'ASIA' group by r_name),
area as (select r_name as "outer", count(*) * 1000.0 as area_km2 from nation join region on n_regionkey = r_regionkey group by r_name)"""
SQL_SCALED = SQL_REGIONS + """,
tot as (select sum(flux) as t, sqrt(sum(sigma_block * sigma_block)) as s from regional),
sc as (select "outer", flux as central, flux * greatest(t - 1.645 * s, 0.0) / t as lo, flux * (t + 1.645 * s) / t as hi from regional cross join tot)"""


def reference(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").groupBy(F.col("r_name").alias("outer"))
    return o.agg((F.sum("o_totalprice") / 1e9).alias("central"), (F.sum("o_totalprice") * 0.9 / 1e9).alias("lower"),
                 (F.sum("o_totalprice") * 1.2 / 1e9).alias("upper"))


def region_areas(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("outer")).agg((F.count(F.lit(1)) * 1000.0).alias("area_km2"))


def scaled(t):
    return u.scale_by_total(annual(t), "flux", "sigma_block").select("outer", F.col("flux").alias("central"), "lower", "upper")


@query("bounds_from_total", "P36 A10", SQL_SCALED + """
select "outer", round(central, 6) as central, round(lo, 6) as lower, round(hi, 6) as upper from sc""")
def _(t):
    return scaled(t)


@query("contribution_with_bounds", "P27 P28 J8 J18", SQL_SCALED + """
select area."outer" as "outer", area_km2, round(sc.central, 4) as central, round(sc.lo, 4) as lower, round(sc.hi, 4) as upper, round(ref.central, 4) as ref_central, round(ref.lo, 4) as ref_lower,
  round(ref.hi, 4) as ref_upper, round(sc.central / ref.central * 100, 4) as pct, round(sc.lo / ref.hi * 100, 4) as pct_lower, round(sc.hi / ref.lo * 100, 4) as pct_upper,
  round(sc.central / 1e-12 / (area_km2 * 1e6) / 1e6, 4) as yield_m, round(ref.central / 1e-12 / (area_km2 * 1e6) / 1e6, 4) as ref_yield_m
from area left join sc using ("outer") left join ref using ("outer")""", digits=4)
def _(t):
    out = contribution(scaled(t), reference(t), region_areas(t))
    return out.withColumns({"yield_m": F.col("yield") / 1e6, "ref_yield_m": F.col("ref_yield") / 1e6}).drop("yield", "ref_yield")


@query("apportioned_error", "A37 W5", SQL_REGIONS + """
, t as (select sum(flux) as t from regional)
select "outer", round(flux, 6) as flux, round(flux / t, 6) as share, round(flux / t * 23.0, 6) as error, round(flux - flux / t * 23.0, 6) as lower, round(flux + flux / t * 23.0, 6) as upper,
  round(23.0 / t * 100, 6) as relative_error_pct from regional cross join t""")
def _(t):
    return u.apportion(annual(t).select("outer", "flux"), "flux", 23.0)


@query("ratio_with_fixed_denominator", "P27", """
select c_custkey, case when c_acctbal > 0 then round(c_custkey / c_acctbal * 100, 6) end as own, round(c_acctbal / 57.0 * 100, 6) as fixed from customer""")
def _(t):
    return t.customer.select("c_custkey", ratio("c_custkey", "c_acctbal", 100.0).alias("own"), ratio("c_acctbal", F.lit(57.0), 100.0).alias("fixed"))


@query("area_yields", "P28 P13", """
select s_suppkey, round(s_acctbal / 1e9 / 1e-12 / ((s_suppkey + 1) * 1e6), 4) as yield from supplier""", digits=4)
def _(t):
    return t.supplier.select("s_suppkey", area_yield(F.col("s_acctbal") / 1e9, F.col("s_suppkey") + 1).alias("yield"))
