"""Sources and sinks: tables written in every layout to a scratch folder and read back."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.sources import readers as r, writers as w
from gridstats.streaming import incremental


def parts_by_month(t):
    return t.lineitem.select("l_suppkey", "l_quantity", "l_extendedprice", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))


@query("csv_round_trip", "SRC1 SNK1 SRC5", """
select c_custkey, c_name, c_nationkey, c_acctbal, case when c_mktsegment <> 'BUILDING' then round(c_acctbal / 7.3e3, 6) end as gap from customer""")
def _(t):
    path = t.scratch("customer.csv")
    gap = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") / 7.3e3).otherwise(F.lit(float("nan")))
    w.write_csv(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", gap.alias("gap")), path)
    return r.read_table(t.spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, gap double")


@query("csv_with_text_key", "SRC2 SRC3 SRC17", """
select lpad(cast(c_nationkey as varchar), 2, '0') as region, sum(c_acctbal) as central, cast(null as double) as lower, sum(c_acctbal) * 2 as upper from customer group by 1""".replace(
    "sum(c_acctbal) as central", "round(sum(c_acctbal), 4) as central").replace("sum(c_acctbal) * 2 as upper", "round(sum(c_acctbal) * 2, 4) as upper"), digits=4)
def _(t):
    path = t.scratch("published.csv")
    w.write_csv(t.customer.groupBy(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("region")).agg(
        F.sum("c_acctbal").alias("central"), (F.sum("c_acctbal") * 2).alias("upper")), path)
    return r.read_published(t.spark, path)


@query("key_from_file_name", "SRC4 SRC3 P15 SNK6", """
select lpad(cast(l_linenumber as varchar), 4, '0') as inner_code, substr(lpad(cast(l_linenumber as varchar), 4, '0'), 1, 2) as outer_code, count(*) as n, round(sum(l_quantity), 6) as quantity, count(case when l_linenumber <= 3 then 1 end) as n_tax from lineitem group by all""")
def _(t):
    # One directory per code, as the writer's partitioning names them; the higher codes lack the tax column.
    root = t.scratch("reaches")
    base = t.lineitem.select(F.lpad(F.col("l_linenumber").cast("string"), 4, "0").alias("final"), "l_quantity", "l_tax", "l_linenumber")
    for side, cols in (("with", ["l_quantity", "l_tax"]), ("without", ["l_quantity"])):
        held = base.where(F.col("l_linenumber") <= 3 if side == "with" else F.col("l_linenumber") > 3)
        held.select("final", *cols).write.partitionBy("final").option("header", True).csv(f"{root}/{side}")
    found = r.read_named_csvs(t.spark, f"{root}/*/*/*.csv", r"final=(\d+)/", "inner_code", {"l_quantity": "double", "l_tax": "double"},
                              anchor="l_quantity", prefix="outer_code")
    return found.groupBy("inner_code", "outer_code").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.count("l_tax").alias("n_tax"))


@query("recursive_tree_scan", "SRC6 SET1 SRC15", """
select 'a' as part, count(*) as n, count(s_acctbal) as n_balance, cast(0 as bigint) as n_price from supplier union all select 'b', count(*), cast(0 as bigint), count(p_retailprice) from part""")
def _(t):
    root = t.scratch("tree")
    t.supplier.select(F.lit("a").alias("part"), "s_suppkey", "s_acctbal").write.parquet(f"{root}/one/deep")
    t.part.select(F.lit("b").alias("part"), "p_partkey", "p_retailprice").write.parquet(f"{root}/two")
    return r.read_tree(t.spark, root).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("s_acctbal").alias("n_balance"), F.count("p_retailprice").alias("n_price"))


@query("partition_slice", "SRC7 SRC9 SNK2 F11", """
select l_suppkey, count(*) as n, round(sum(l_quantity), 6) as quantity from lineitem where year(l_shipdate) = 1998 and month(l_shipdate) in (3, 4) group by l_suppkey""")
def _(t):
    path = t.scratch("partitioned")
    w.write_partitions(parts_by_month(t), path)
    return r.read_partitions(t.spark, path, 1998, [3, 4]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("flat_directory_layout", "SRC8", """
select year(l_shipdate)::int as year, month(l_shipdate)::int as month, count(*) as n, round(sum(l_quantity), 6) as quantity from lineitem group by all""")
def _(t):
    root = t.scratch("flat")
    rows = parts_by_month(t)
    for (y,) in rows.select("year").distinct().collect():
        rows.where(F.col("year") == y).drop("year").write.parquet(f"{root}/year_{y}")
    return r.read_flat_layout(t.spark, root).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("schema_probe", "SRC10 SRC9", """
select true as has_quantity, false as has_bounds, count(*) as n, round(sum(l_quantity), 6) as l_quantity from lineitem""")
def _(t):
    df = t.lineitem
    probe = {"has_quantity": not r.missing_columns(df, ["l_quantity"]), "has_bounds": not r.missing_columns(df, ["lower_90", "upper_90"])}
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("l_quantity")).select(*[F.lit(v).alias(k) for k, v in probe.items()], "n", "l_quantity")


@query("climate_file", "SRC11", """
with m as (select c_mktsegment as s, month(o_orderdate) - 1 as k, round(avg(o_totalprice) / 7.3e3, 3) as temp, count(*) / 2.0 as prec from orders join customer on o_custkey = c_custkey group by all)
select s as "outer", (k + 1)::int as month, round(temp, 3) as temp, prec::double as prec from m""", digits=3)
def _(t):
    from gridstats.plans.contribution import climate_rows
    path = t.scratch("climate.json")
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", F.month("o_orderdate").alias("k")).agg(F.round(F.avg("o_totalprice") / 7.3e3, 3).alias("temp"), (F.count(F.lit(1)) / 2).alias("prec"))
    m = m.groupBy("c_mktsegment").agg(F.sort_array(F.collect_list(F.struct("k", "temp", "prec"))).alias("v"))
    entry = F.struct("c_mktsegment", F.struct(F.col("v.temp").alias("temp"), F.col("v.prec").alias("prec")))
    m.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.text(path)
    return climate_rows(r.read_climate(t.spark, path))


@query("climatology_table", "SRC12 P17 P16", """
select s_suppkey * 0.5 as lat, case when s_nationkey * 10.0 >= 180 then s_nationkey * 10.0 - 360 else s_nationkey * 10.0 end as lon, case when s_acctbal > 0 then s_acctbal end as value from supplier""".replace("s_suppkey * 0.5 as lat", "(s_suppkey * 0.5)::double as lat").replace("else s_nationkey * 10.0 end as lon", "else s_nationkey * 10.0 end::double as lon"))
def _(t):
    from gridstats.functions.columns import wrap_longitude
    path = t.scratch("climatology")
    t.supplier.select((F.col("s_suppkey") * 0.5).alias("latitude"), (F.col("s_nationkey") * 10.0).alias("longitude"), F.lit(1.0).alias("zz"),
                      F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(float("nan")).alias("ssro")).write.parquet(path)
    return r.read_climatology(t.spark, path).withColumn("lon", wrap_longitude("lon"))


@query("pixel_window", "SRC13 F6 P16", """
select round_even(c_acctbal / 300.0, 6) as latitude, round_even(c_custkey / 7.0, 6) as longitude, c_acctbal as rate from customer where c_acctbal / 300.0 between 5 and 25 and c_custkey / 7.0 between 10 and 200""")
def _(t):
    path = t.scratch("pixels")
    t.customer.select((F.col("c_acctbal") / 300.0).alias("y"), (F.col("c_custkey") / 7.0).alias("x"), F.col("c_acctbal").alias("rate")).write.parquet(path)
    return r.read_pixels(t.spark, path, "rate", (5, 25, 10, 200))


@query("region_table", "SRC14 SRC16 F5", """
select lpad(cast(n_nationkey as varchar), 4, '0') as region, (n_nationkey * 10.5)::double as areasqkm from nation where substr(lpad(cast(n_nationkey as varchar), 4, '0'), 1, 4) in ('0001', '0005', '0018')""")
def _(t):
    path = t.scratch("regions")
    ring = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))
    t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("HUC4"), (F.col("n_nationkey") * 10.5).alias("areasqkm"), F.array(ring).alias("rings")).write.parquet(path)
    table = r.read_regions(t.spark, path, "huc4", ["HUC_4", "HUC4"], keep=["0001", "0005", "0018"], prefix=4)
    return table.select("region", "areasqkm")


@query("landed_samples", "SRC15 J16 SET1 SET2 F11", """
select count(*) as n, count(c_name) as n_known, count(distinct o_custkey) as n_sites, round(sum(o_totalprice) / 1e6, 6) as total from orders left join customer on o_custkey = c_custkey and c_nationkey <> 7 where o_orderdate::date between date '1996-01-01' and date '1998-12-31'""")
def _(t):
    stations, results = t.scratch("stations"), t.scratch("results")
    s = t.customer.where("c_nationkey <> 7").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    s.write.parquet(f"{stations}/a")
    s.where("c_name like '%9'").write.parquet(f"{stations}/b")
    o = t.orders.withColumn("day", F.to_date("o_orderdate"))
    o.where("o_orderstatus = 'F'").select("o_custkey", "o_totalprice", "day").write.parquet(f"{results}/a")
    o.where("o_orderstatus <> 'F'").select("o_custkey", "o_totalprice", "day", "o_orderpriority").write.parquet(f"{results}/b")
    rows = r.read_landed_samples(t.spark, stations, results, "o_custkey", "1996-01-01", "1998-12-31", "day")
    per = rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count("c_name").alias("k"), F.sum("o_totalprice").alias("p"))
    return per.agg(F.sum("n").alias("n"), F.sum("k").alias("n_known"), F.count(F.lit(1)).alias("n_sites"), (F.sum("p") / 1e6).alias("total"))


@query("resumed_partitions", "SNK3 J14 SET4", """
select year(l_shipdate)::int as year, month(l_shipdate)::int as month, count(*) as n, case when year(l_shipdate) = 1997 then 1 else 2 end::int as run from lineitem group by all""")
def _(t):
    path = t.scratch("resumed")
    w.write_partitions(parts_by_month(t).where("year = 1997").withColumn("run", F.lit(1)), path)
    w.resume_partitions(parts_by_month(t).withColumn("run", F.lit(2)), path)
    return t.spark.read.parquet(path).groupBy("year", "month", "run").agg(F.count(F.lit(1)).alias("n"))


@query("cached_aggregate", "SNK4 A8", """
select l_suppkey, count(*) as n, round(avg(l_quantity), 6) as quantity from lineitem group by l_suppkey""")
def _(t):
    path = t.scratch("alltime")
    build = lambda: t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("quantity"))
    w.cached_table(t.spark, path, build)
    return w.cached_table(t.spark, path, lambda: build().limit(0))


@query("cube_with_attributes", "SNK5", """
select year(l_shipdate)::int as year, count(*) as n, round(avg(l_quantity), 6) as quantity, 'pieces' as units from lineitem group by all""")
def _(t):
    path = t.scratch("cube")
    w.write_cube(parts_by_month(t), path, {"l_quantity": {"units": "pieces", "long_name": "quantity per line"}})
    back = t.spark.read.parquet(path)
    units = back.schema["l_quantity"].metadata["units"]
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("quantity")).withColumn("units", F.lit(units))


@query("one_output_per_region", "SNK6", """
select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by r_name""")
def _(t):
    path = t.scratch("regional")
    w.write_per_region(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), path, "r_name")
    return t.spark.read.parquet(path).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("incremental_all_time_mean", "ST1 A8", """
select l_suppkey, round(avg(l_quantity), 6) as l_quantity, count(*) as n from lineitem group by l_suppkey""")
def _(t):
    landing, out, state = t.scratch("landing"), t.scratch("means"), t.scratch("state")
    rows = t.lineitem.select("l_suppkey", "l_quantity", "l_returnflag")
    for flag in ("A", "N", "R"):
        rows.where(F.col("l_returnflag") == flag).write.mode("append").parquet(landing)
        stream = incremental.landed_stream(t.spark, landing, rows.schema)
        incremental.finished(incremental.running_mean(stream, ["l_suppkey"], ["l_quantity"], out, state, compact_every=2))
    return incremental.read_running(t.spark, out, ["l_suppkey"])


@query("incremental_scoring", "ST2", """
select l_returnflag, count(*) as n, round(sum(l_quantity * 2 + s_acctbal / 1e3) / 1e3, 6) as score from lineitem join supplier on l_suppkey = s_suppkey group by l_returnflag""")
def _(t):
    landing, out, state = t.scratch("landing"), t.scratch("scored"), t.scratch("state")
    rows = t.lineitem.select("l_suppkey", "l_quantity", "l_returnflag")
    static = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    score = lambda s: s.join(static, "l_suppkey").select("l_returnflag", (F.col("l_quantity") * 2 + F.col("s_acctbal") / 1e3).alias("score"))
    for flag in ("A", "N", "R"):
        rows.where(F.col("l_returnflag") == flag).write.mode("append").parquet(landing)
        stream = incremental.landed_stream(t.spark, landing, rows.schema)
        incremental.finished(incremental.score_new(stream, score, out, state, by=["l_returnflag"]))
    return t.spark.read.parquet(out).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), (F.sum("score") / 1e3).alias("score"))
