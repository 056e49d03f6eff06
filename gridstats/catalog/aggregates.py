"""Grouped aggregates, pivots and totals."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.functions import columns as c
from gridstats.operators import summaries as s
from gridstats.operators.boosting import importance_rollup
from gridstats.operators.quantiles import exact_median, exact_quantiles, weighted_median
from gridstats.plans import gridmaps


def monthly(t):
    return t.lineitem.withColumns({"year": F.year("l_shipdate"), "month": F.month("l_shipdate")})


def priced(t):
    # The odd unit keeps means of two-decimal prices off exact rounding ties.
    return monthly(t).withColumn("price", F.col("l_extendedprice") / 7.3e3)


def regional_orders(t):
    """Orders with the region and nation of their customer."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumns(
        {"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})


SQL_REGIONAL = """
with ro as (select *, year(o_orderdate) as year, month(o_orderdate) as month from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


@query("group_median_count_std", "A1", """
select l_suppkey, round(median(l_extendedprice), 4) as median, count(l_extendedprice) as n, round(stddev_samp(l_extendedprice), 4) as std from lineitem group by l_suppkey""", digits=4)
def _(t):
    m = exact_median(t.lineitem, ["l_suppkey"], "l_extendedprice")
    return m.join(t.lineitem.groupBy("l_suppkey").agg(F.stddev_samp("l_extendedprice").alias("std")), "l_suppkey")


@query("grouped_quantiles", "A2", """
select event_type, count(*) as n, round(quantile_cont(value, 0.02), 6) as p02, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.75), 6) as p75,
  round(quantile_cont(value, 0.98), 6) as p98 from events group by event_type""")
def _(t):
    return exact_quantiles(t.events, ["event_type"], "value", {"p02": .02, "p25": .25, "p75": .75, "p98": .98})


@query("global_quantiles", "A2", """
select count(*) as n, round(quantile_cont(c_acctbal, 0.01), 6) as p01, round(quantile_cont(c_acctbal, 0.5), 6) as p50, round(quantile_cont(c_acctbal, 0.99), 6) as p99 from customer""")
def _(t):
    return exact_quantiles(t.customer, [], "c_acctbal", {"p01": .01, "p50": .5, "p99": .99})


@query("describe_columns", "A5", """
with m as (select unnest([{f: 'l_quantity', v: case when l_linestatus = 'F' then l_quantity end}, {f: 'l_extendedprice', v: l_extendedprice / 1e3}]) as u from lineitem)
select u.f as feature, count(u.v) as n_values, count(*) - count(u.v) as n_null, round(avg(u.v), 6) as mean, round(stddev_samp(u.v), 6) as std, round(min(u.v), 6) as min,
  round(max(u.v), 6) as max, count(distinct u.v) as n_distinct, round(quantile_cont(u.v, 0.25), 6) as p25, round(quantile_cont(u.v, 0.5), 6) as p50, round(quantile_cont(u.v, 0.75), 6) as p75
from m group by u.f""")
def _(t):
    v = t.lineitem.select(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("l_quantity"), (F.col("l_extendedprice") / 1e3).alias("l_extendedprice"))
    return s.describe(v, ["l_quantity", "l_extendedprice"])


def _grid(agg, sql):
    @query(f"grid_{agg}", "A6", f"""
select l_suppkey, month(l_shipdate)::int as month, round({sql}, 6) as price from lineitem group by all""")
    def _(t):
        return s.aggregate_to_grid(priced(t), ["l_suppkey", "month"], "price", agg)


for _agg, _sql in (("mean", "avg(l_extendedprice / 7.3e3)"), ("median", "median(l_extendedprice / 7.3e3)"), ("max", "max(l_extendedprice / 7.3e3)"),
                   ("std", "stddev_samp(l_extendedprice / 7.3e3)")):
    _grid(_agg, _sql)


@query("pivot_region_by_month", "A7", SQL_REGIONAL + "select r_name, " + ", ".join(
    f"round(avg(o_totalprice) filter (month = {m}) / 7.3e3, 6) as m_{m}" for m in range(1, 13)) + ", round((" + " + ".join(
    f"avg(o_totalprice) filter (month = {m})" for m in range(1, 13)) + ") / 12 / 7.3e3, 6) as m_annual from ro group by r_name")
def _(t):
    return gridmaps.region_by_month(regional_orders(t).withColumn("v", F.col("o_totalprice") / 7.3e3), "r_name", "v", "m_")


@query("all_time_mean", "A8", """
select l_suppkey, count(l_quantity) as n, round(avg(l_quantity), 6) as l_quantity, round(avg(case when l_returnflag <> 'R' then l_extendedprice end) / 1e3, 6) as price from lineitem group by l_suppkey""")
def _(t):
    v = t.lineitem.withColumn("price", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")) / 1e3)
    return gridmaps.all_time_mean(v, ["l_suppkey"], ["l_quantity", "price"])


@query("region_sums_and_means", "A9 A16", SQL_REGIONAL + """
select r_name, round(sum(o_totalprice) / 1e6, 6) as total_millions, round(avg(o_totalprice) / 1e3, 6) as mean_thousands, count(o_orderkey) as n, count(distinct o_custkey) as n_customers from ro group by r_name""")
def _(t):
    # Distinct customers through a pre-aggregation: a region may hold a third of all rows.
    per = regional_orders(t).groupBy("r_name", "o_custkey").agg(F.sum("o_totalprice").alias("p"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("r_name").agg(
        (F.sum("p") / 1e6).alias("total_millions"), (F.sum("p") / F.sum("n") / 1e3).alias("mean_thousands"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_customers"))


@query("mean_of_yearly_sums", "A11 A20", SQL_REGIONAL + """
, y as (select r_name, year, sum(o_totalprice) / 1e6 as v from ro group by all)
select r_name, round(avg(v), 6) as mean_total from y group by r_name""")
def _(t):
    y = regional_orders(t).groupBy("r_name", "year").agg((F.sum("o_totalprice") / 1e6).alias("v"))
    return y.groupBy("r_name").agg(F.avg("v").alias("mean_total"))


@query("weighted_mean_without_nulls", "A12", """
select l_suppkey, round(sum(case when l_returnflag <> 'A' then l_discount end * l_quantity) / sum(case when l_returnflag <> 'A' then l_quantity end), 8) as mean from lineitem group by l_suppkey""", digits=8)
def _(t):
    v = t.lineitem.withColumn("d", F.when(F.col("l_returnflag") != "A", F.col("l_discount")))
    return v.groupBy("l_suppkey").agg(s.weighted_mean("d", "l_quantity").alias("mean"))


@query("parent_median_of_base_rows", "A13", SQL_REGIONAL + """
select r_name, count(*) as n, round(median(o_totalprice), 4) as median from ro where o_orderstatus = 'F' group by r_name""", digits=4)
def _(t):
    return exact_median(regional_orders(t).where("o_orderstatus = 'F'"), ["r_name"], "o_totalprice")


@query("conditional_sums_and_share", "A14", """
select l_suppkey, round(sum(case when l_returnflag = 'R' then l_extendedprice else 0 end) / 1e6, 6) as river, round(sum(case when l_returnflag <> 'R' then l_extendedprice else 0 end) / 1e6, 6) as lake,
  count(*) filter (l_returnflag = 'R') as n_river, round(sum(case when l_returnflag = 'R' then l_extendedprice else 0 end) / sum(l_extendedprice) * 100, 6) as river_pct from lineitem group by l_suppkey""")
def _(t):
    river = F.col("l_returnflag") == "R"
    part = lambda cond: F.sum(F.when(cond, F.col("l_extendedprice")).otherwise(0.0))
    return t.lineitem.groupBy("l_suppkey").agg(
        (part(river) / 1e6).alias("river"), (part(~river) / 1e6).alias("lake"), F.count_if(river).alias("n_river"),
        (F.try_divide(part(river), F.sum("l_extendedprice")) * 100).alias("river_pct"))


@query("area_by_order_pivot", "A15 A7", "select l_suppkey, " + ", ".join(
    f"round(coalesce(sum(l_extendedprice) filter (l_linenumber = {m}) / 1e3, 0.0), 6) as area_{m}" for m in range(1, 12)) + " from lineitem group by l_suppkey")
def _(t):
    return s.pivot_fixed(t.lineitem, ["l_suppkey"], "l_linenumber", range(1, 12), F.sum("l_extendedprice") / 1e3, "area_", 0.0)


@query("dominant_category", "A18 P40", """
with n as (select o_custkey, count(*) filter (o_orderpriority = '1-URGENT') as a, count(*) filter (o_orderpriority in ('2-HIGH', '3-MEDIUM')) as b, count(*) filter (o_orderpriority = '5-LOW') as c from orders group by o_custkey)
select o_custkey, case when greatest(a, b, c) = 0 then 'none' when a >= b and a >= c then 'urgent' when b >= c then 'middle' else 'low' end as dominant from n""")
def _(t):
    classes = {"urgent": ["1-URGENT"], "middle": ["2-HIGH", "3-MEDIUM"], "low": ["5-LOW"]}
    return s.dominant_category(t.orders, "o_custkey", c.category_of("o_orderpriority", classes), list(classes), "none")


@query("share_of_true_over_years", "A19 F12", SQL_REGIONAL + """
, y as (select r_name, month::int as month, year, avg((o_totalprice > 250000)::int) as f from ro group by all)
select r_name, month, round(avg(f), 6) as share from y group by r_name, month""")
def _(t):
    return s.share_of_true(regional_orders(t), ["r_name", "month"], ["year"], F.col("o_totalprice") > 250000)


@query("mean_of_monthly_means", "A20", SQL_REGIONAL + """
, m as (select r_name, month, avg(o_totalprice) / 1e3 as v from ro group by all) select r_name, round(avg(v), 6) as mean from m group by r_name""")
def _(t):
    return s.two_level_mean(regional_orders(t).withColumn("v", F.col("o_totalprice") / 1e3), ["r_name"], ["month"], "v", "mean")


@query("sums_with_total_row", "A22 J8", SQL_REGIONAL + """
select coalesce(r_name, 'TOTAL') as r_name, round(sum(o_totalprice / 1e6), 6) as price, count(*)::double as orders from ro group by rollup(r_name)""")
def _(t):
    v = regional_orders(t).withColumns({"price": F.col("o_totalprice") / 1e6, "orders": F.lit(1.0)})
    return s.with_total(v, "r_name", ["price", "orders"])


@query("paired_ratio_median", "A34", """
select count(*) as n, round(median(l_extendedprice / l_quantity), 6) as ratio from lineitem where l_quantity > 0 and l_extendedprice > 0""")
def _(t):
    pairs = t.lineitem.where("l_quantity > 0 and l_extendedprice > 0").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("r"))
    return exact_median(pairs, [], "r", "ratio")


@query("importance_rollup", "A36 U4", """
with f as (select p_name as feature, p_size % 5 as fold, sum(p_retailprice) / 1e5 as importance from part group by all),
s as (select feature, avg(importance) as m, stddev_pop(importance) as sd from f group by feature)
select split_part(feature, ' ', 1) as source, round(sum(m), 6) as importance, round(sqrt(sum(sd * sd)), 6) as importance_std, count(*) as n_columns from s group by 1""")
def _(t):
    folds = t.part.groupBy(F.col("p_name").alias("feature"), (F.col("p_size") % 5).alias("fold")).agg((F.sum("p_retailprice") / 1e5).alias("importance"))
    parents = t.part.select(F.col("p_name").alias("feature"), F.split("p_name", " ")[0].alias("source")).distinct()
    return importance_rollup(folds, parents)


@query("yearly_series", "A39", """
select year(l_shipdate)::int as year, round(avg(l_extendedprice / 7.3e3), 6) as price from lineitem group by all""")
def _(t):
    return gridmaps.yearly_series(priced(t), "price")


@query("yearly_series_of_nearest_cell", "A39 J11", """
with n as (select l_quantity as a, l_discount as b from lineitem order by abs(l_quantity - 30.2) + abs(l_discount - 0.07), l_quantity, l_discount limit 1)
select year(l_shipdate)::int as year, round(median(l_extendedprice / 7.3e3), 6) as price from lineitem join n on l_quantity = a and l_discount = b group by all""")
def _(t):
    return gridmaps.yearly_series(priced(t), "price", "median", (30.2, 0.07), "l_quantity", "l_discount")


@query("seasonal_grids", "A40 A6 F11", """
select case when month(l_shipdate) in (12, 1, 2) then 'DJF' when month(l_shipdate) in (3, 4, 5) then 'MAM' when month(l_shipdate) in (6, 7, 8) then 'JJA' else 'SON' end as season,
  l_suppkey, round(avg(l_extendedprice / 7.3e3), 6) as price from lineitem where year(l_shipdate) = 1998 group by all""")
def _(t):
    return gridmaps.seasonal_grids(priced(t), ["l_suppkey"], "price", 1998)


@query("grid_anomaly", "J17 A6 F11", """
with g as (select l_suppkey, year(l_shipdate) as y, median(l_extendedprice / 7.3e3) as v from lineitem group by all)
select a.l_suppkey, round(a.v - b.v, 6) as price from g a join g b using (l_suppkey) where a.y = 2000 and b.y = 1997""")
def _(t):
    return gridmaps.anomaly(priced(t), ["l_suppkey"], "price", 2000, 1997, "median")


@query("weighted_median", "W3", """
with o as (select event_type, value, (json_extract_string(props, '$.k'))::int as w from events),
a as (select event_type, value, sum(w) over (partition by event_type order by value) as cum, sum(w) over (partition by event_type) as tot from o)
select event_type, min(value) filter (cum >= tot / 2.0) as weighted_median from a group by event_type""")
def _(t):
    v = t.events.withColumn("w", F.get_json_object("props", "$.k").cast("int"))
    return weighted_median(v, ["event_type"], "value", "w")
