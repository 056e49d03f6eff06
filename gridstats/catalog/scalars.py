"""Row-wise expressions."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.functions import binning, columns as c, units
from gridstats.operators.features import calendar_features, cyclic_features, interaction_terms, months_to_rows
from gridstats.operators.joins import lookup
from gridstats.operators.summaries import binned_profile, quantile_bins
from gridstats.operators.scalars import attach_scalars
from gridstats.plans.contribution import dry_share
from gridstats.operators.uncertainty import rescale_interval


@query("project_and_rename", "P1 P2", """
select o_orderkey as order_id, o_custkey as o_custkey_month, round(o_totalprice, 6) as o_totalprice_month from orders""")
def _(t):
    kept = t.orders.drop("o_orderstatus", "o_orderdate", "o_orderpriority")
    return kept.withColumnsRenamed({
        "o_orderkey": "order_id", "o_custkey": "o_custkey_month", "o_totalprice": "o_totalprice_month", "absent": "absent_month"})


@query("lenient_dates", "P3", """
with t as (select o_orderkey, strftime(o_orderdate - interval 25 year, '%m/%d/%y') as short, case when o_orderpriority = '1-URGENT'
  then 'unknown' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as iso, o_orderdate - interval 25 year as d from orders)
select o_orderkey, strftime(d, '%Y-%m-%d') as short_date,
  case when iso = 'unknown' then null else substr(iso, 1, 10) end as iso_date from t""")
def _(t):
    old = F.col("o_orderdate") - F.make_interval(years=F.lit(25))
    d = t.orders.select("o_orderkey", F.date_format(old, "M/d/yy").alias("short"),
                        F.when(F.col("o_orderpriority") == "1-URGENT", "unknown")
                         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("iso"))
    return d.select("o_orderkey", F.date_format(c.lenient_date("short", two_digit_year=True), "yyyy-MM-dd").alias("short_date"),
                    F.date_format(c.lenient_date("iso"), "yyyy-MM-dd").alias("iso_date"))


@query("calendar_features", "P4 P5", """
select l_orderkey, l_linenumber, month(l_shipdate)::int as month, dayofyear(l_shipdate)::int as day_of_year, year(l_shipdate)::int as year,
  (floor((month(l_shipdate) % 12) / 3.0) + 1)::int as season,
  round(sin(2 * pi() * month(l_shipdate) / 12.0), 6) as month_sin, round(cos(2 * pi() * month(l_shipdate) / 12.0), 6) as month_cos,
  round(sin(2 * pi() * dayofyear(l_shipdate) / 365.25), 6) as day_sin, round(cos(2 * pi() * dayofyear(l_shipdate) / 365.25), 6) as day_cos
from lineitem""")
def _(t):
    return calendar_features(t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate").drop("l_shipdate")


@query("cyclic_without_day", "P5", """
select o_orderkey, month(o_orderdate)::int as month, round(sin(2 * pi() * month(o_orderdate) / 12.0), 6) as month_sin,
  round(cos(2 * pi() * month(o_orderdate) / 12.0), 6) as month_cos,
  round(sin(2 * pi() * ((month(o_orderdate) - 0.5) * 30.44) / 365.25), 6) as day_sin,
  round(cos(2 * pi() * ((month(o_orderdate) - 0.5) * 30.44) / 365.25), 6) as day_cos from orders""")
def _(t):
    return cyclic_features(t.orders.select("o_orderkey", F.month("o_orderdate").alias("month")))


@query("interaction_terms", "P6", """
select p_partkey, round(p_size * p_retailprice, 6) as product, round((p_size * p_retailprice) ** 2 / 1e6, 6) as product_sq,
  round(p_retailprice / greatest(p_size, 10), 6) as quotient, round(p_retailprice / greatest(p_size, 1), 6) as normal,
  cast(null as double) as absent from part""")
def _(t):
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    out = interaction_terms(p, [
        ("product", "p_size", "p_retailprice", "multiply"), ("product_sq", "product", None, "square"),
        ("quotient", "p_retailprice", "p_size", "ratio"), ("normal", "p_size", "p_retailprice", "normalize"),
        ("absent", "p_size", "no_such_column", "multiply")])
    return out.withColumn("product_sq", F.col("product_sq") / 1e6).drop("p_size", "p_retailprice")


@query("molality_conversion", "P7", """
select event_id, round(value / 1e3 * 1.0 / (1 + value / 1e3 * 0.04401), 9) as molar from events""", digits=9)
def _(t):
    return t.events.select("event_id", units.molality_to_molarity(F.col("value") / 1e3).alias("molar"))


@query("guarded_math", "P8", """
select c_custkey, case when c_acctbal > 0 then round(ln(c_acctbal), 6) end as ln_bal, case when c_acctbal > 0 then round(log10(c_acctbal), 6) end as log_bal,
  round(exp(c_acctbal / 1e4), 6) as exp_bal, round(power(abs(c_acctbal), 0.5), 6) as root_bal, round(sqrt(abs(c_acctbal)), 6) as sqrt_bal from customer""")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", c.safe_ln(b).alias("ln_bal"), c.safe_log10(b).alias("log_bal"),
                             F.exp(b / 1e4).alias("exp_bal"), F.pow(F.abs(b), 0.5).alias("root_bal"), F.sqrt(F.abs(b)).alias("sqrt_bal"))


@query("clip_values", "P9", """
with v as (select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_acctbal end as b from customer)
select c_custkey, case when b < 0 then 0 else b end as low, case when b > 5000 then 5000 else b end as high,
  case when b < 0 then 0 when b > 5000 then 5000 else b end as both_sides from v""")
def _(t):
    v = t.customer.withColumn("b", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")))
    return v.select("c_custkey", c.clip("b", lower=0.0).alias("low"), c.clip("b", upper=5000.0).alias("high"),
                    c.clip("b", 0.0, 5000.0).alias("both_sides"))


@query("solubility_forms", "P10 P38 P13 U3", """
with k as (select p_partkey, p_size + 273.15 as k, p_size as c, p_retailprice as ppm from part),
h as (select *, power(10.0, 108.3865 + 0.01985076 * k + -6919.53 / k + -40.4515 * log10(k) + 669365.0 / (k * k)) as kh from k)
select p_partkey, round(kh, 9) as kh, round(ppm * 1e-6 * kh * 1000 * 12.01, 9) as concentration,
  round(1.0 / greatest(ppm / 1e6, 1e-10) / 2 * 1e-6 * kh * 1000 * 12.01, 9) as misfit_concentration,
  round(ppm / 1e6 * 44.009 * 1000, 9) as mg_per_l, round(ppm / 1e6 / (0.034 * exp(2400.0 * (1.0 / 288.15 - 1.0 / 298.15)) * 1e-6) / 1e3, 9) as kppm,
  round(k - 273.15, 9) as celsius from h""", digits=9)
def _(t):
    p = t.part.withColumn("c", F.col("p_size").cast("double"))
    ppm = F.col("p_retailprice")
    return p.select("p_partkey", units.solubility("c").alias("kh"), units.ppm_to_g_per_m3(ppm, "c").alias("concentration"),
                    units.ppm_to_g_per_m3(units.misfit_to_ppm(ppm / 1e6), "c").alias("misfit_concentration"),
                    units.molar_to_mg_per_l(ppm / 1e6).alias("mg_per_l"), (units.molar_to_ppm(ppm / 1e6) / 1e3).alias("kppm"),
                    units.kelvin_to_celsius(F.col("c") + 273.15).alias("celsius"))


@query("water_temperature", "P11 A7", """
with m as (select n_nationkey, month(o_orderdate) as m, avg(o_totalprice) / 1e4 - 20 as t from orders
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)
select n_nationkey, round(greatest(3.941 + 0.818 * avg(t), 0.1), 6) as water_c from m group by n_nationkey""")
def _(t):
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("n_nationkey"), F.month("o_orderdate").alias("m")).agg((F.avg("o_totalprice") / 1e4 - 20).alias("v"))
    arrays = m.groupBy("n_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "v"))), lambda s: s["v"]).alias("months"))
    return arrays.select("n_nationkey", units.water_temperature("months").alias("water_c"))


@query("padded_codes", "P14 P15", """
with b as (select p_partkey, replace(p_brand, 'Brand#', '') as code, replace(p_brand, 'Brand#', '123456789') as long_code from part)
select p_partkey, lpad(code, 8, '0') as code8, substr(lpad(code, 4, '0'), 1, 2) as code2, long_code from b""")
def _(t):
    code = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    long = F.replace("p_brand", F.lit("Brand#"), F.lit("123456789"))
    return t.part.select("p_partkey", c.zero_pad(code, 8).alias("code8"), c.code_prefix(code, 4, 2).alias("code2"),
                         c.zero_pad(long, 8).alias("long_code"))


@query("cell_keys", "P16 P17", """
with v as (select c_custkey, c_acctbal / 50 as lon, c_acctbal / 250 as lat from customer)
select c_custkey, cast(round_even(lat / 0.1, 0) as bigint) as ilat, cast(round_even(lon / 0.1, 0) as bigint) as ilon,
  round(case when lon >= 180 then lon - 360 else lon end, 6) as wrapped from v""")
def _(t):
    v = t.customer.select("c_custkey", (F.col("c_acctbal") / 50).alias("lon"), (F.col("c_acctbal") / 250).alias("lat"))
    return v.select("c_custkey", c.cell_key("lat", 0.1).alias("ilat"), c.cell_key("lon", 0.1).alias("ilon"),
                    c.wrap_longitude("lon").alias("wrapped"))


@query("text_to_number", "P18", """
with v as (select event_id, value, case when event_type = 'error' then 'n/a' else json_extract_string(props, '$.k') end as k from events)
select event_id, try_cast(k as double) as k, coalesce(try_cast(k as double), value) as k_or_value from v""")
def _(t):
    k = F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", c.number_or(k).alias("k"), c.number_or(k, "value").alias("k_or_value"))


@query("missing_category_label", "P19 P23", """
with v as (select c_custkey, case c_mktsegment when 'BUILDING' then 'nan' when 'MACHINERY' then null when 'FURNITURE' then '<NA>' else c_mktsegment end as s,
  case when c_acctbal > 0 then c_acctbal end as b from customer)
select c_custkey, case when s is null or s in ('nan', 'None', 'NaN', '<NA>') then 'Missing' else s end as segment, coalesce(b, 0.0) as balance from v""")
def _(t):
    s = (F.when(F.col("c_mktsegment") == "BUILDING", "nan").when(F.col("c_mktsegment") == "FURNITURE", "<NA>")
         .when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")))
    v = t.customer.select("c_custkey", c.missing_label(s).alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return v.fillna(0.0, subset=["balance"])


@query("samples_per_site_label", "P20 A17", """
with g as (select o_custkey, min(o_orderkey) as k, count(*) as n from orders group by o_custkey)
select g.o_custkey, n, o_orderpriority as first_priority, case when n = 1 then '1' when n between 2 and 10 then '2-10'
  when n > 10 and n <= 20 then '10-20' else '20+' end as label
from g join (select o_orderkey, any_value(o_orderpriority) as o_orderpriority from orders group by o_orderkey) o on g.k = o.o_orderkey""")
def _(t):
    from gridstats.operators.dedup import first_value
    g = first_value(t.orders, ["o_custkey"], ["o_orderpriority"], "o_orderkey")
    label = F.when(F.col("n") == 1, "1").when(F.col("n").between(2, 10), "2-10").when((F.col("n") > 10) & (F.col("n") <= 20), "10-20").otherwise("20+")
    return g.select("o_custkey", "n", F.col("o_orderpriority").alias("first_priority"), label.alias("label"))


@query("fixed_edge_bins", "P21", """
with v as (select *, l_quantity - 1 as q from lineitem),
b as (select case when q >= -0.01 and q <= 0 then '0' when q > 0 and q <= 5 then '0-5' when q > 5 and q <= 25 then '5-25' when q > 25 and q <= 45 then '25-45' end as bin, q from v)
select bin, count(*) as n, round(sum(q), 6) as total from b group by bin""")
def _(t):
    v = t.lineitem.withColumn("q", F.col("l_quantity") - 1)
    return v.groupBy(binning.cut("q", [-0.01, 0, 5, 25, 45], ["0", "0-5", "5-25", "25-45"]).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("q").alias("total"))


SQL_EDGES = """
with e as (select list_sort(list_distinct(quantile_cont({x}, [{probs}]))) as edges from {table}),
b as (select s.*, greatest(len(list_filter(edges, lambda g: g < {x})) - 1, 0)::int as bin from {table} s cross join e)"""


def edges_sql(table, x, q):
    return SQL_EDGES.format(table=table, x=x, probs=", ".join(repr(i / q) for i in range(q + 1)))


@query("quantile_bins", "P22 J20", edges_sql("lineitem", "l_extendedprice", 5) + """
select bin, count(*) as n, min(l_extendedprice) as low, max(l_extendedprice) as high from b group by bin""")
def _(t):
    return quantile_bins(t.lineitem, "l_extendedprice", 5).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("quantile_bins_with_ties", "P22", edges_sql("lineitem", "l_discount", 20) + """
select bin, count(*) as n, min(l_discount) as low, max(l_discount) as high from b group by bin""")
def _(t):
    return quantile_bins(t.lineitem, "l_discount", 20).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


@query("row_statistics", "P24 P25", """
with v as (select l_orderkey, l_linenumber, l_partkey, case when l_quantity > 5 then l_quantity end as a, case when l_discount > 0 then l_discount * 100 end as b,
  case when l_tax > 0 then l_tax * 100 end as c from lineitem)
select l_orderkey, l_linenumber, l_partkey, (a is null)::int + (b is null)::int + (c is null)::int as n_null,
  round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a is not null)::int + (b is not null)::int + (c is not null)::int, 0), 6) as mean,
  round(least(a, b, c), 6) as low, round(greatest(a, b, c), 6) as high from v""")
def _(t):
    v = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("a"),
                          F.when(F.col("l_discount") > 0, F.col("l_discount") * 100).alias("b"),
                          F.when(F.col("l_tax") > 0, F.col("l_tax") * 100).alias("c"))
    return v.select("l_orderkey", "l_linenumber", "l_partkey", c.null_count(["a", "b", "c"]).alias("n_null"),
                    c.row_mean(["a", "b", "c"]).alias("mean"), F.least("a", "b", "c").alias("low"), F.greatest("a", "b", "c").alias("high"))


@query("interval_rescale", "P26", """
with v as (select l_suppkey, avg(l_extendedprice) as p, avg(l_extendedprice * (1 - l_discount)) as lo, avg(l_extendedprice * (1 + l_tax)) as hi from lineitem group by l_suppkey)
select l_suppkey, round((p - (hi - lo) / 2 * (1.645 / 1.960)) / 7.3e3, 6) as low, round((p + (hi - lo) / 2 * (1.645 / 1.960)) / 7.3e3, 6) as high from v""")
def _(t):
    p = F.col("l_extendedprice")
    v = t.lineitem.groupBy("l_suppkey").agg(F.avg(p).alias("p"), F.avg(p * (1 - F.col("l_discount"))).alias("lo"), F.avg(p * (1 + F.col("l_tax"))).alias("hi"))
    low, high = rescale_interval("p", "lo", "hi")
    return v.select("l_suppkey", (low / 7.3e3).alias("low"), (high / 7.3e3).alias("high"))


@query("month_column_selection", "P31", """
with m as (select c_nationkey, month(o_orderdate) as month, avg(o_totalprice) / 7.3e3 as v, count(*) as n from orders join customer on o_custkey = c_custkey group by all),
g as (select n_nationkey, month from nation cross join (select unnest(range(1, 13)) as month))
select n_nationkey, g.month::int as month, round(v, 6) as price, n::double as orders, cast(null as double) as absent from g left join m on n_nationkey = c_nationkey and g.month = m.month""")
def _(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("m", F.date_format("o_orderdate", "MM"))
    wide = o.groupBy(F.col("c_nationkey").alias("n_nationkey")).pivot("m", [f"{i:02d}" for i in range(1, 13)]).agg(
        (F.avg("o_totalprice") / 7.3e3).alias("price"), F.count(F.lit(1)).alias("orders"))
    names = {f"{i:02d}_{f}": f"{f}{i:02d}" for i in range(1, 13) for f in ("price", "orders")}
    return months_to_rows(wide.withColumnsRenamed(names), ["n_nationkey"], ["price", "orders", "absent"])


@query("intermittency_fractions", "P34", """
with v as (select p_partkey, p_size % 5 as ord, p_size / 1.3::double as temp, p_retailprice / 23 as prec from part),
k(ord, a, b, c, d, e, f) as (values (1, -0.009, 0.029, 0.77, -0.0019, 0.017, 0.026), (2, -0.009, 0.029, 0.61, -0.0021, 0.011, 0.088),
  (3, -0.008, 0.028, 0.44, -0.0018, 0.011, 0.058), (4, -0.005, 0.023, 0.27, -0.0028, 0.012, 0.127))
select p_partkey, round(case when a is not null then least(greatest(a * prec + b * temp + c, 0.0), 0.9) * least(greatest(d * prec + e * temp + f, 0.0), 0.9) end, 6) as dry
from v left join k using (ord)""")
def _(t):
    v = t.part.select("p_partkey", (F.col("p_size") % 5).alias("ord"), (F.col("p_size") / 1.3).alias("temp"),
                      (F.col("p_retailprice") / 23).alias("prec"))
    return v.select("p_partkey", dry_share("ord", "temp", "prec").alias("dry"))


@query("display_names", "P35 J15 U4", """
select p_partkey, case p_type when 'PROMO' then 'Promotion' when 'ECONOMY' then 'Budget' else p_type end as label from part""")
def _(t):
    names = t.spark.createDataFrame([("PROMO", "Promotion"), ("ECONOMY", "Budget")], "p_type string, label string")
    return lookup(t.part.select("p_partkey", "p_type"), names, "p_type", "label", F.col("p_type")).drop("p_type")


@query("reach_area", "P37", """
select l_orderkey, l_linenumber, l_partkey, round(case when l_linestatus = 'O' then l_quantity * 1000 * l_tax
  else coalesce(try_cast(case when l_returnflag = 'R' then 'unknown' else cast(l_discount as varchar) end as double), l_quantity * 1000 * l_tax) end, 6) as area from lineitem""")
def _(t):
    own = F.when(F.col("l_returnflag") == "R", "unknown").otherwise(F.col("l_discount").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             units.reach_area_m2("l_linestatus", "l_quantity", "l_tax", own, river="O").alias("area"))


@query("binned_profile", "P39 A33 P22", edges_sql("lineitem", "l_extendedprice", 8) + """
, m as (select bin + 1 as q_bin, unnest([{feature: 'l_quantity', v: l_quantity}, {feature: 'l_tax', v: l_tax}]) as u from b),
g as (select u.feature as feature, q_bin, avg(u.v) as mean from m group by all),
s as (select *, min(mean) over (partition by feature) as lo, max(mean) over (partition by feature) as hi from g)
select feature, q_bin, round(mean, 6) as mean, round(case when hi > lo then (mean - lo) / (hi - lo) else 0 end, 6) as scaled from s""")
def _(t):
    return binned_profile(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"])


@query("code_classes", "P40 O4", """
select p_type, count(*) as n, any_value(case when p_type in ('PROMO', 'ECONOMY') then 'low' when p_type in ('LARGE', 'STANDARD') then 'high' end) as class,
  any_value(coalesce(list_position(['LARGE', 'MEDIUM', 'PROMO'], p_type), 0))::int as place from part group by p_type""")
def _(t):
    kind = c.category_of("p_type", {"low": ["PROMO", "ECONOMY"], "high": ["LARGE", "STANDARD"]})
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).select(
        "p_type", "n", kind.alias("class"), c.position_in("p_type", ["LARGE", "MEDIUM", "PROMO"]).alias("place"))


@query("global_scalars_on_rows", "J20 W5", """
select c_custkey, round(c_acctbal - (select avg(c_acctbal) from customer), 6) as centred, round(c_acctbal / (select sum(c_acctbal) from customer) * 1e3, 6) as share from customer""")
def _(t):
    stats = t.customer.agg(F.avg("c_acctbal").alias("m"), F.sum("c_acctbal").alias("s"))
    return attach_scalars(t.customer, stats, "g").select(
        "c_custkey", (F.col("c_acctbal") - F.col("g.m")).alias("centred"), (F.col("c_acctbal") / F.col("g.s") * 1e3).alias("share"))
