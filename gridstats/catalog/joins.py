"""Joins."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.operators import joins
from gridstats.operators.joins import keyed_join, sample_grid, suffix_join
from gridstats.operators.quantiles import exact_quantiles
from gridstats.sources.readers import union_frames


@query("suffixed_join_on_five_keys", "J1 P2", """
with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax from lineitem),
r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity + 1 as l_quantity, l_discount from lineitem where l_returnflag = 'A')
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l.l_quantity as l_quantity_x, l_tax, r.l_quantity as l_quantity_y, l_discount
from l left join r using (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    left = t.lineitem.select(*keys, "l_quantity", "l_tax")
    right = t.lineitem.where("l_returnflag = 'A'").select(*keys, (F.col("l_quantity") + 1).alias("l_quantity"), "l_discount")
    return suffix_join(left, right, keys)


@query("null_safe_join", "J1", """
with l as (select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_mktsegment end as seg from customer),
r as (select seg, count(*) as n from l group by seg)
select l.c_custkey, l.seg, r.n from l left join r on l.seg is not distinct from r.seg""")
def _(t):
    left = t.customer.select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("seg"))
    return keyed_join(left, left.groupBy("seg").agg(F.count(F.lit(1)).alias("n")), ["seg"], null_safe=True)


@query("fan_out_join", "J2 F1", """
select o_orderkey, o_orderdate::date::varchar as day, s.l_suppkey, s.l_quantity from orders join lineitem s on l_orderkey = o_orderkey and l_shipdate = o_orderdate + interval 30 day""")
def _(t):
    s = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.date_sub("l_shipdate", 30).alias("day"), "l_suppkey", "l_quantity")
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.join(s, ["o_orderkey", "day"], "inner").withColumn("day", F.col("day").cast("string"))


@query("group_statistics_joined_back", "J3 A1", """
with s as (select l_suppkey, median(l_quantity) as med, count(*) as n, stddev_samp(l_quantity) as sd from lineitem group by l_suppkey)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity - med, 6) as deviation, n, round(sd, 6) as sd from lineitem join s using (l_suppkey)""")
def _(t):
    med = exact_quantiles(t.lineitem, ["l_suppkey"], "l_quantity", {"med": 0.5})
    sd = t.lineitem.groupBy("l_suppkey").agg(F.stddev_samp("l_quantity").alias("sd"))
    return t.lineitem.join(med.join(sd, "l_suppkey"), "l_suppkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") - F.col("med")).alias("deviation"), "n", "sd")


@query("join_only_new_columns", "J4", """
select o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_name, c.c_acctbal from orders o left join customer c on o_custkey = c_custkey""")
def _(t):
    left = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    right = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal", F.lit(0.0).alias("o_totalprice"))
    return joins.join_new_columns(left, right, ["o_custkey"])


@query("static_attributes_by_month", "J5 P31", """
with g as (select l_suppkey, year(l_shipdate)::int as year, month(l_shipdate)::int as month, avg(l_quantity) as quantity from lineitem group by all)
select l_suppkey, year, month, round(quantity, 6) as quantity, round(s_acctbal * (1 + month / 100.0::double), 6) as attribute
from g join supplier on s_suppkey = l_suppkey""")
def _(t):
    from gridstats.operators.features import months_to_rows
    wide = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), *[
        (F.col("s_acctbal") * (1 + m / 100.0)).alias(f"attribute{m:02d}") for m in range(1, 13)])
    cells = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.avg("l_quantity").alias("quantity"))
    return cells.join(months_to_rows(wide, ["l_suppkey"], ["attribute"]), ["l_suppkey", "month"], "left")


@query("zero_filled_left_join", "J7", """
select c_custkey, coalesce(sum(o_totalprice) / 1e3, 0.0)::double as total from (select c_custkey from customer) left join (select * from orders where o_orderpriority = '1-URGENT') on o_custkey = c_custkey group by c_custkey""".replace("coalesce(sum(o_totalprice) / 1e3, 0.0)::double", "round(coalesce(sum(o_totalprice) / 1e3, 0.0), 6)"))
def _(t):
    o = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum("o_totalprice") / 1e3).alias("total"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("total", F.lit(0.0)).alias("total"))


@query("region_aligned_columns", "J8 J18 SET1", """
with c as (select n_regionkey as r, sum(c_acctbal) as c_total from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 2 group by n_regionkey),
s as (select n_regionkey as r, sum(s_acctbal) as s_total from supplier join nation on s_nationkey = n_nationkey group by n_regionkey)
select r_regionkey, r_name, round(c_total, 6) as c_total, round(s_total, 6) as s_total from region left join c on r = r_regionkey left join s on s.r = r_regionkey""")
def _(t):
    n = t.nation
    c = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey <> 2").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sum("c_acctbal").alias("c_total"))
    s = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sum("s_acctbal").alias("s_total"))
    return t.region.join(c, "r_regionkey", "left").join(s, "r_regionkey", "left")


@query("grid_sampling", "J10 P17", """
with g as (select s_suppkey, ceil((s_suppkey * 0.1 - 0.0) / 0.1 - 0.5)::bigint as i, s_acctbal as v from supplier),
p as (select c_custkey, c_acctbal / 1000 as lat from customer)
select c_custkey, case when lat between (select min(s_suppkey) * 0.1 from supplier) and (select max(s_suppkey) * 0.1 from supplier) then greatest(v, 0.0) end as v
from p left join g on ceil((lat - 0.0) / 0.1 - 0.5)::bigint = i""")
def _(t):
    grid = t.supplier.select((F.col("s_suppkey") * 0.1).alias("lat"), F.lit(0.0).alias("lon"), F.col("s_acctbal").alias("v"))
    points = t.customer.select("c_custkey", (F.col("c_acctbal") / 1000).alias("lat"), F.lit(0.0).alias("lon"))
    return sample_grid(points, grid, lat="lat", lon="lon", value="v", step=0.1).select("c_custkey", "v")


@query("rows_of_nearest_cell", "J11 O3", """
with v as (select l_orderkey, l_linenumber, l_suppkey, l_quantity as lat, l_discount as lon from lineitem),
n as (select lat, lon from v order by abs(lat - 17.4) + abs(lon - 0.033), lat, lon limit 1)
select l_orderkey, l_linenumber, l_suppkey, v.lat, v.lon from v join n on v.lat = n.lat and v.lon = n.lon""")
def _(t):
    v = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("lat"), F.col("l_discount").alias("lon"))
    return joins.rows_of_nearest_cell(v, 17.4, 0.033, lat_col="lat", lon_col="lon")


@query("rows_of_selected_groups", "J13", """
select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)""")
def _(t):
    return joins.in_groups(t.orders, t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey", "o_custkey")


@query("rows_without_listed_groups", "J14 SET4", """
select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def _(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.not_in_groups(t.customer, urgent, "c_custkey").select("c_custkey")


@query("sample_grid_offset", "J10", """
with g as (select 0.05::double + 0.1::double * (c_custkey % 10) as lat, 0.05::double + 0.1::double * ((c_custkey // 10) % 10) as lon, sum(c_acctbal) as v from customer group by all),
p as (select o_orderkey, 0.05::double + (o_orderkey % 83) * 0.011::double as lat, 0.05::double + (o_orderkey % 71) * 0.0127::double as lon from orders)
select o_orderkey, case when lat <= (select max(lat) from g) and lon <= (select max(lon) from g) then
  round((select greatest(arg_min(v, abs(g.lat - p.lat) + abs(g.lon - p.lon)), 0) from g), 6) end as v from p""")
def _(t):
    axis = lambda n: F.lit(0.05) + F.lit(0.1) * n
    grid = t.customer.groupBy(axis(F.col("c_custkey") % 10).alias("lat"), axis(F.floor(F.col("c_custkey") / 10) % 10).alias("lon")).agg(F.sum("c_acctbal").alias("v"))
    points = t.orders.select("o_orderkey", (F.lit(0.05) + (F.col("o_orderkey") % 83) * F.lit(0.011)).alias("lat"), (F.lit(0.05) + (F.col("o_orderkey") % 71) * F.lit(0.0127)).alias("lon"))
    return sample_grid(points, grid, lat="lat", lon="lon", value="v", step=0.1).select("o_orderkey", "v")


@query("lookup_with_default", "J15", """
select c_custkey, coalesce(s_acctbal, 15.0) as temperature from customer left join supplier on s_suppkey = c_custkey""")
def _(t):
    table = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("temperature"))
    return joins.lookup(t.customer.select("c_custkey"), table, "c_custkey", "temperature", F.lit(15.0))


@query("results_with_stations", "J16 SRC15", """
select o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey""")
def _(t):
    stations = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment").dropDuplicates(["o_custkey"])
    results = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return results.join(stations, "o_custkey", "left")


@query("grid_difference", "J17", """
with g as (select l_suppkey, year(l_shipdate) as y, avg(l_quantity) as q from lineitem group by all)
select a.l_suppkey, round(a.q - b.q, 6) as q from g a join g b on a.l_suppkey = b.l_suppkey where a.y = 1999 and b.y = 1996""")
def _(t):
    g = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.avg("l_quantity").alias("q"))
    return joins.grid_difference(g.where("y = 1999"), g.where("y = 1996"), ["l_suppkey"], "q")


@query("optional_calibration", "J19", """
select n_nationkey, s_acctbal as fitness, coalesce(s_acctbal * 2, 0.0) as contribution from nation left join supplier on s_suppkey = n_nationkey and s_acctbal > 3000""")
def _(t):
    fit = t.supplier.where("s_acctbal > 3000").select(F.col("s_suppkey").alias("n_nationkey"), F.col("s_acctbal").alias("fitness"))
    j = t.nation.select("n_nationkey").join(fit, "n_nationkey", "left")
    return j.withColumn("contribution", F.when(F.col("fitness").isNull(), 0.0).otherwise(F.col("fitness") * 2))


@query("union_of_differing_frames", "SET1", """
select 'c' as kind, c_custkey as id, c_acctbal as balance, c_mktsegment as segment from customer
union all select 's', s_suppkey, s_acctbal, null from supplier union all select 'o', o_orderkey, null, null from orders""")
def _(t):
    return union_frames([
        t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
        t.orders.select(F.lit("o").alias("kind"), F.col("o_orderkey").alias("id"))])


@query("distinct_values", "SET2 A45", """
select distinct year(l_shipdate)::int as year, month(l_shipdate)::int as month, l_suppkey from lineitem""")
def _(t):
    return t.lineitem.select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "l_suppkey").distinct()


@query("common_labels", "SET3", """
select distinct c_custkey from customer where c_custkey in (select o_custkey from orders where year(o_orderdate) = 1996)""")
def _(t):
    return t.customer.select("c_custkey").intersect(t.orders.where(F.year("o_orderdate") == 1996).select(F.col("o_custkey").alias("c_custkey")))


@query("multiset_difference", "SET4", """
select o_custkey from orders except all select c_custkey from customer""")
def _(t):
    return t.orders.select("o_custkey").exceptAll(t.customer.select("c_custkey"))


@query("top_values", "O2 O1", """
select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20""")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("extreme_rows", "O3", """
select o_custkey, arg_max(o_orderkey, o_totalprice) as largest_order, arg_min(o_orderkey, o_totalprice) as smallest_order from orders group by o_custkey""")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("largest_order"),
                                             F.min_by("o_orderkey", "o_totalprice").alias("smallest_order"))
