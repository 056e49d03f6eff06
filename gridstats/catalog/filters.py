"""Row filters and outlier removal."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.functions import columns as c
from gridstats.operators import dedup, outliers
from gridstats.operators.summaries import aggregate_to_grid, value_counts
from gridstats.plans.gridmaps import time_slice


def measures(t):
    """Measures with gaps, so that the null rules are exercised."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_quantity") > 4, F.col("l_quantity")).alias("q"),
        F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_discount") > 0.01, F.col("l_discount")).alias("disc"),
        F.when(F.col("l_linestatus") == "F", F.col("l_tax")).alias("tax"),
        F.col("l_linenumber").cast("double").alias("line"))


SQL_MEASURES = """
with v as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity > 4 then l_quantity end as q,
  case when l_returnflag <> 'N' then l_extendedprice end as price, case when l_discount > 0.01 then l_discount end as disc,
  case when l_linestatus = 'F' then l_tax end as tax, l_linenumber::double as line from lineitem)"""
FEATURES = ["q", "price", "disc", "tax", "line"]
ID = ["l_orderkey", "l_linenumber", "l_partkey"]
SQL_NULLS = "((q is null)::int + (price is null)::int + (disc is null)::int + (tax is null)::int + (line is null)::int)"


@query("drop_null_rows", "F1", SQL_MEASURES + """
select l_orderkey, l_linenumber, l_partkey, q from v where q is not null and price is not null""")
def _(t):
    return measures(t).dropna(subset=["q", "price"]).select(*ID, "q")


@query("inclusive_ranges", "F2", SQL_MEASURES + """
select l_orderkey, l_linenumber, l_partkey, q, price from v where q between 10 and 40 and price >= 20000 and disc <= 0.08""")
def _(t):
    return outliers.in_ranges(measures(t), {"q": (10, 40), "price": (20000, None), "disc": (None, 0.08)}).select(*ID, "q", "price")


@query("strict_number_range", "F3 P18", """
with v as (select event_id, case when event_type = 'view' then 'bad' else cast(value as varchar) end as s from events)
select event_id, try_cast(s as double) as x from v where try_cast(s as double) > 1 and try_cast(s as double) < 100""")
def _(t):
    v = t.events.select("event_id", c.number_or(F.when(F.col("event_type") == "view", "bad").otherwise(F.col("value").cast("string"))).alias("x"))
    return v.where((F.col("x") > 1) & (F.col("x") < 100))


@query("text_predicates", "F4", """
with v as (select p_partkey, p_name, p_brand, case when p_type = 'PROMO' then null else p_type end as kind from part)
select p_partkey, p_name, kind from v where coalesce(contains(lower(p_name), 'ring'), false) and not coalesce(contains(kind, 'LARGE'), false)
  and not coalesce(starts_with(p_brand, 'Brand#2'), false) and not coalesce(p_brand in ('Brand#1', 'Brand#3'), false)""")
def _(t):
    v = t.part.select("p_partkey", "p_name", "p_brand", F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("kind"))
    keep = (c.text_match("p_name", contains="RING", ignore_case=True) & ~c.text_match("kind", contains="LARGE")
            & ~c.text_match("p_brand", starts_with="Brand#2") & ~F.col("p_brand").isin("Brand#1", "Brand#3"))
    return v.where(keep).select("p_partkey", "p_name", "kind")


@query("region_codes_and_box", "F5 F6", """
select c_custkey, lpad(cast(c_nationkey as varchar), 2, '0') as code from customer
where lpad(cast(c_nationkey as varchar), 2, '0') in ('01', '02', '05', '11', '18') and c_acctbal between 500 and 6000 and c_nationkey between 2 and 20""")
def _(t):
    v = t.customer.withColumn("code", c.zero_pad("c_nationkey", 2))
    v = v.where(F.col("code").isin("01", "02", "05", "11", "18") & F.col("c_acctbal").between(500, 6000) & F.col("c_nationkey").between(2, 20))
    return v.select("c_custkey", "code")


@query("minimum_width_counts", "F7", """
select l_suppkey, count(*) filter (l_quantity >= 10) as n_kept, count(*) filter (l_quantity < 10) as n_removed,
  round(sum(l_quantity) filter (l_quantity >= 10), 6) as kept_total from lineitem group by l_suppkey""")
def _(t):
    wide = F.col("l_quantity") >= 10
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(wide).alias("n_kept"), F.count_if(~wide).alias("n_removed"),
                                               F.sum(F.when(wide, F.col("l_quantity"))).alias("kept_total"))


@query("sparse_rows_removed", "F8 P24", SQL_MEASURES + f"""
select l_orderkey, l_linenumber, l_partkey, {SQL_NULLS}::int as missing from v where not ({SQL_NULLS} = 5 or {SQL_NULLS} >= 3 or {SQL_NULLS} > 2)""")
def _(t):
    kept = outliers.sparse_row_filter(measures(t), FEATURES, most=0.7, limit=0.4)
    return kept.select(*ID, c.null_count(FEATURES).alias("missing"))


@query("minimum_group_size", "F9", """
select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by o_custkey having count(*) >= 12)""")
def _(t):
    return outliers.min_group_size(t.orders, "o_custkey", 12).select("o_orderkey", "o_custkey")


@query("validity_and_masking", "F10", """
select s_suppkey, n_name, case when s_acctbal > 1000 then s_acctbal end as balance from supplier left join nation on s_nationkey = n_nationkey and n_regionkey <> 3
where n_name is not null and s_acctbal > 0""")
def _(t):
    n = t.nation.where("n_regionkey <> 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    v = t.supplier.join(n, "s_nationkey", "left").where(F.col("n_name").isNotNull() & (F.col("s_acctbal") > 0))
    return v.select("s_suppkey", "n_name", F.when(F.col("s_acctbal") > 1000, F.col("s_acctbal")).alias("balance"))


def orders_by_month(t):
    return t.orders.withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})


@query("time_slices", "F11", """
with o as (select *, year(o_orderdate) as y, month(o_orderdate) as m from orders)
select 'date' as slice, count(*) as n, round(sum(o_totalprice) / 1e6, 6) as total from o where o_orderdate::date = date '1998-03-15'
union all select 'month', count(*), round(sum(o_totalprice) / 1e6, 6) from o where y = 1997 and m = 6
union all select 'year', count(*), round(sum(o_totalprice) / 1e6, 6) from o where y = 1999
union all select 'years', count(*), round(sum(o_totalprice) / 1e6, 6) from o where y between 1996 and 1998
union all select 'season', count(*), round(sum(o_totalprice) / 1e6, 6) from o where m in (6, 7, 8)""")
def _(t):
    o = orders_by_month(t)
    parts = {
        "date": time_slice(o, date="1998-03-15", time="o_orderdate"), "month": time_slice(o, month=(1997, 6)),
        "year": time_slice(o, year=1999), "years": time_slice(o, years=(1996, 1998)), "season": time_slice(o, months=[6, 7, 8])}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n"), (F.sum("o_totalprice") / 1e6).alias("total")).select(F.lit(name).alias("slice"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("threshold_flag", "F12", """
select o_orderkey, (o_totalprice / 1e3 - 273.15) < -4.0 as frozen from orders""")
def _(t):
    return t.orders.select("o_orderkey", (F.col("o_totalprice") / 1e3 - 273.15 < -4.0).alias("frozen"))


@query("within_group_outliers", "W1 J3 A1", """
with v as (select *, log10(value) as lv from events), s as (select user_id, median(lv) as med, count(lv) as n from v group by user_id)
select event_id, user_id, value from v join s using (user_id) where n < 4 or abs(lv - med) <= 0.5""")
def _(t):
    v = t.events.withColumn("lv", c.safe_log10("value"))
    return outliers.within_group_filter(v, "user_id", "lv", max_deviation=0.5, min_n=4).select("event_id", "user_id", "value")


@query("stratified_iqr_outliers", "W7 A2", """
with v as (select *, log10(greatest(value, 1e-12)) as lv, ts::date as day from events),
s as (select event_type, day, count(*) as n, quantile_cont(lv, 0.25) as q1, quantile_cont(lv, 0.75) as q3 from v group by event_type, day)
select event_id, event_type, value from v join s using (event_type, day)
where not (n >= 20 and q3 <> q1 and (lv < q1 - (q3 - q1) or lv > q3 + (q3 - q1)))""")
def _(t):
    v = t.events.withColumn("lv", c.safe_log10(c.clip("value", lower=1e-12))).withColumn("day", F.to_date("ts"))
    return outliers.stratified_iqr_filter(v, ["event_type", "day"], "lv", k=1.0, min_n=20).select("event_id", "event_type", "value")


SQL_IQR = SQL_MEASURES + ", lim as (select " + ", ".join(
    f"quantile_cont({f}, 0.25) - {{k}} * (quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)) as lo_{f}, "
    f"quantile_cont({f}, 0.75) + {{k}} * (quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)) as hi_{f}" for f in FEATURES) + " from v)"
SQL_Z = SQL_MEASURES + ", lim as (select " + ", ".join(
    f"avg({f}) - {{k}} * stddev_samp({f}) as lo_{f}, avg({f}) + {{k}} * stddev_samp({f}) as hi_{f}" for f in FEATURES) + " from v)"
SQL_VOTES = "(" + " + ".join(f"coalesce({f} < lo_{f} or {f} > hi_{f}, false)::int" for f in FEATURES) + ")"


@query("outlier_votes_iqr", "M2 A2 J20", SQL_IQR.format(k=0.25) + f"""
select l_orderkey, l_linenumber, l_partkey, {SQL_VOTES}::int as votes from v cross join lim where {SQL_VOTES} < 3""")
def _(t):
    return outliers.outlier_votes(measures(t), FEATURES, threshold=0.25).where("votes < 3").select(*ID, "votes")


@query("outlier_vote_filter_zscore", "M2", SQL_Z.format(k=1.0) + f"""
select l_orderkey, l_linenumber, l_partkey, q from v cross join lim where {SQL_VOTES} < 2""")
def _(t):
    return outliers.outlier_vote_filter(measures(t), FEATURES, method="zscore", threshold=1.0, min_features=2).select(*ID, "q")


@query("keep_first_per_key", "W2 M20", """
select event_id, user_id, event_type, value from events
qualify row_number() over (partition by user_id, event_type, ts::date order by event_id) = 1""")
def _(t):
    v = t.events.withColumn("day", F.to_date("ts"))
    return dedup.keep_first(v, ["user_id", "event_type", "day"], ["event_id"]).select("event_id", "user_id", "event_type", "value")


@query("repeated_values", "A3 M20", """
select l_quantity, l_discount, l_tax, count(l_suppkey) as n, count(distinct l_suppkey) as n_distinct from lineitem
group by all having count(l_suppkey) > count(distinct l_suppkey)""")
def _(t):
    return dedup.repeated_values(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_suppkey")


@query("filter_attrition", "M21", """
with f as (select user_id, value > 1 as a, value > 1 and value < 100 as b, value > 1 and value < 100 and event_type <> 'error' as c from events)
select 0 as step, 'all' as stage, count(*) as n_rows, count(distinct user_id) as n_groups from f
union all select 1, 'above', count(*), count(distinct user_id) from f where a
union all select 2, 'below', count(*), count(distinct user_id) from f where b
union all select 3, 'no_error', count(*), count(distinct user_id) from f where c""")
def _(t):
    return outliers.attrition(t.events, {
        "above": F.col("value") > 1, "below": F.col("value") < 100, "no_error": F.col("event_type") != "error"}, "user_id")


@query("value_counts", "A4 O1", """
select event_type, count(*) as n from events group by event_type""")
def _(t):
    return value_counts(t.events, ["event_type"])


@query("largest_orders", "O5", """
select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20""")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("grid_minimum", "A6", """
select l_suppkey, month(l_shipdate)::int as month, min(l_extendedprice) as l_extendedprice from lineitem group by all""")
def _(t):
    return aggregate_to_grid(t.lineitem.withColumn("month", F.month("l_shipdate")), ["l_suppkey", "month"], "l_extendedprice", "min")
