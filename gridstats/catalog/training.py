"""The chain from extractions to the training table, with customers as sampling points."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.plans.training_table import attrition_table, training_table

FEATURES = ["ResultMeasure_pH", "ResultMeasure_tempC", "slope"]
SQL_CHAIN = """
with base as (
  select c_custkey as k, 'USGS-' || (c_nationkey + 400) as loc, date '2000-01-01' + (c_custkey % 365)::int as d, (c_nationkey % 5 + 1)::int as huc2, (c_custkey % 4 + 1)::int as season,
    (c_custkey * 7 % 700) / 100.0 + 4 as ph, abs(c_acctbal) / 4 as alk, (c_custkey * 13 % 55)::double as temp, (c_custkey * 31 % 1000) / 100.0 as slope, abs(c_acctbal) as bal from customer),
chem as (select d, loc, max(bal) / 1e6 as m from base group by d, loc),
merged as (select base.*, m / (1 + m * 0.04401) as co2 from base join chem using (d, loc) where k % 11 <> 0 and k % 13 <> 0 and k % 17 <> 0),
limits as (select *, log10(co2) as lg from merged where co2 between 1e-6 and 0.05 and ph between 4 and 10.5 and alk between 0 and 2000 and temp between 0 and 50),
medians as (select loc, median(lg) as med, count(*) as n from limits group by loc),
site as (select limits.* from limits join medians using (loc) where n < 4 or abs(lg - med) <= 2),
spread as (select season, huc2, count(*) as n, quantile_cont(lg, 0.25) as a, quantile_cont(lg, 0.75) as b from site group by all),
stratum as (select site.* from site join spread using (season, huc2) where n < 20 or a = b or lg between a - 3.5 * (b - a) and b + 3.5 * (b - a)),
pairs as (select x.k as k, sqrt((x.ph - y.ph) ** 2 + (x.temp - y.temp) ** 2 + (x.slope - y.slope) ** 2) as dist,
  row_number() over (partition by x.k order by sqrt((x.ph - y.ph) ** 2 + (x.temp - y.temp) ** 2 + (x.slope - y.slope) ** 2)) as r from stratum x join stratum y on x.k <> y.k),
far as (select k, avg(dist) as md from pairs where r <= 5 group by k),
isolation as (select stratum.* from stratum join far using (k) where md <= (select quantile_cont(md, 0.99) from far)),
weather as (select * from isolation qualify row_number() over (partition by temp, season order by k) = 1),
listed as (select * from weather where loc not like 'USGS-404%' and loc not like 'USGS-390%')"""


def chain(t, report=None):
    k, day = F.col("c_custkey"), F.expr("date_add(date '2000-01-01', cast(c_custkey % 365 as int))")
    kind = F.when(k % 11 == 0, "Stream").when(k % 13 == 0, "Well: Hyporheic-zone well").otherwise("Well: water supply")
    place = F.concat(F.lit("USGS-"), (F.col("c_nationkey") + 400).cast("string"))
    keys = [k.cast("double").alias("CO2_ppm"), day.cast("string").alias("Date"), place.alias("MonitoringLocation"), (k % 97).alias("PFAF_ID"), k.alias("HYBAS_ID")]
    daily = t.customer.select(
        *keys, kind.alias("siteType"), ((F.col("c_nationkey") % 5 + 1) * 1_000_000).alias("HUC8"), (k % 4 + 1).cast("int").alias("season"),
        (k * 7 % 700 / 100.0 + 4).alias("ResultMeasure_pH"), (F.abs("c_acctbal") / 4).alias("Alkalinity_mg.L.CaCO3"),
        (k * 13 % 55).cast("double").alias("ResultMeasure_tempC"), F.when(k % 17 != 0, k * 1.0).alias("t2m"))
    monthly = t.customer.where(k % 19 != 0).select(*keys, (k * 0.5).alias("tp"))
    land = t.customer.select(*keys, (k * 31 % 1000 / 100.0).alias("slope"))
    chemistry = t.customer.groupBy(F.date_format(day, "M/d/yy").alias("Date"), place.alias("MonitoringLocation")).agg((F.max(F.abs("c_acctbal")) / 1e6).alias("molality_CO2"))
    return training_table(daily, monthly, land, chemistry, FEATURES, ["ResultMeasure_tempC", "season"], ["CO2_ppm"], report)


@query("training_table", "J1 J2 P7 F2 F4 W1 W7 M1 M20 W2", SQL_CHAIN + """
select k as c_custkey, season, round(co2 * 1e6, 6) as micromolar, case when k % 19 <> 0 then k * 0.5 end::double as tp_month from listed""")
def _(t):
    return chain(t).select(F.col("HYBAS_ID").alias("c_custkey"), "season", (F.col("CO2_aq") * 1e6).alias("micromolar"), "tp_month")


@query("training_table_attrition", "M21 J1 F2", SQL_CHAIN + """,
n as (select 0 as step, 'merged' as stage, count(*) as n_rows from merged union all select 1, 'physical limits', count(*) from limits union all select 2, 'own site', count(*) from site
  union all select 3, 'stratum', count(*) from stratum union all select 4, 'isolation', count(*) from isolation union all select 5, 'duplicate weather', count(*) from weather
  union all select 6, 'listed sites', count(*) from listed)
select step::int as step, stage, n_rows, coalesce(lag(n_rows) over (order by step), n_rows) - n_rows as dropped from n""")
def _(t):
    """Counted while the stages are written."""
    report = []
    chain(t, report)
    return attrition_table(t.spark, report)
