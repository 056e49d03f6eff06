"""Reach and pixel efflux on the tables: order lines are reaches, nations inner and regions outer."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.plans import contribution as k


def reaches(t):
    l = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return l.select(
        F.col("n_regionkey").alias("outer"), F.col("n_nationkey").alias("inner"), (F.col("l_extendedprice") / 7.3e4).alias("length_km"),
        (F.col("l_quantity") / 13).alias("width_m"), F.when(F.col("l_returnflag") == "R", "River").otherwise("Lake").alias("kind"),
        (F.col("l_discount") * 100).alias("rate"), F.when(F.col("l_tax") > 0, F.col("l_tax") * 1e4).alias("ppm"), F.col("l_tax").alias("discharge"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") / F.col("l_quantity")).alias("exchange"), F.col("l_linenumber").alias("order"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice").cast("string")).otherwise("n/a").alias("own_area_m2"))


SQL_REACHES = """
with rr as (select n_regionkey as o, n_nationkey as i, l_extendedprice / 7.3e4 as len, l_quantity / 13 as w, l_returnflag = 'R' as river, l_discount * 100 as rate,
  case when l_tax > 0 then l_tax * 1e4 end as ppm, l_tax as q, case when l_discount > 0 then l_discount / l_quantity end as ex, l_linenumber as ord,
  case when l_linestatus = 'F' then l_extendedprice end as own from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
re as (select *, case when river then len * 1000 * w else coalesce(own, len * 1000 * w) end as area from rr),
k as (select *, rate * area as flux from re where w >= 0.3), nk as (select i, count(*) as n from re where w < 0.3 group by i)"""
SQL_BASINS = SQL_REACHES + """,
b as (select o, k.i as i, sum(flux) as flux, sum(area) as area, sum(len) as len, sum(case when river then flux else 0 end) as rf, sum(case when river then 0 else flux end) as lf,
  sum(case when river then area else 0 end) as ra, sum(case when river then 0 else area end) as la, count(*) as n, coalesce(any_value(nk.n), 0)::bigint as nf, count(*) filter (river) as nr,
  count(*) filter (not river) as nl, avg(rate) as mrate, avg(ppm) as mppm, avg(w) as mw, avg(q) as mq from k left join nk on k.i = nk.i group by o, k.i)"""


@query("reach_efflux", "A12 A13 A14 F7 P37 P13 SRC3", SQL_BASINS + """,
m as (select o, median(ex) filter (river) as mr, median(ex) filter (not river) as ml from k group by o)
select b.o as "outer", round(sum(flux) / 1e9, 6) as flux_g, round(sum(area) / 1e9, 6) as area_m2, round(sum(len) / 1e3, 6) as length_km, sum(n)::bigint as n_reaches, sum(nf)::bigint as n_filtered_out,
  sum(nr)::bigint as n_rivers, sum(nl)::bigint as n_lakes, count(*) as n_inner, round(sum(mrate * n) / sum(n), 6) as mean_rate, round(sum(mppm * n) / sum(n), 6) as mean_ppm, round(sum(mw * n) / sum(n), 6) as mean_width_m,
  round(sum(mq * n) / sum(n), 6) as mean_discharge, round(any_value(mr), 6) as exchange_river, round(any_value(ml), 6) as exchange_lake, round(sum(flux) * 1e-12, 6) as flux_tg, round(sum(area) / 1e6 / 1e3, 6) as area_km2,
  round(sum(rf) / sum(flux) * 100, 6) as river_share_pct from b join m using (o) group by b.o""")
def _(t):
    out = k.reach_efflux(reaches(t)).drop("river_flux_g", "lake_flux_g", "river_area_m2", "lake_area_m2")
    return out.withColumns({"flux_g": F.col("flux_g") / 1e9, "area_m2": F.col("area_m2") / 1e9, "length_km": F.col("length_km") / 1e3, "area_km2": F.col("area_km2") / 1e3})


@query("reach_basin_statistics", "A14 A9 F7 P37", SQL_BASINS + """
select o as "outer", i as "inner", round(flux / 1e9, 6) as flux, round(rf / 1e9, 6) as river_flux, round(lf / 1e9, 6) as lake_flux, round(ra / 1e9, 6) as river_area, round(la / 1e9, 6) as lake_area, n as n_reaches, nf as n_filtered_out from b""")
def _(t):
    b = k.basin_statistics(reaches(t))
    parts = {"flux": "flux_g", "river_flux": "river_flux_g", "lake_flux": "lake_flux_g", "river_area": "river_area_m2", "lake_area": "lake_area_m2"}
    return b.select("outer", "inner", *[(F.col(c) / 1e9).alias(n) for n, c in parts.items()], "n_reaches", "n_filtered_out")


@query("reach_area_by_order", "A15", SQL_REACHES + 'select o as "outer", ' + ", ".join(
    f"round(coalesce(sum(area) filter (ord = {m}), 0.0) / 1e9, 6) as area_order_{m}" for m in range(1, 12)) + " from k group by o")
def _(t):
    wide = k.area_by_order(reaches(t))
    return wide.select("outer", *[(F.col(f"area_order_{m}") / 1e9).alias(f"area_order_{m}") for m in range(1, 12)])


@query("reach_flux_by_order", "A15", SQL_REACHES + 'select o as "outer", ' + ", ".join(
    f"round(coalesce(sum(flux) filter (ord = {m}), 0.0) / 1e9, 6) as flux_order_{m}" for m in range(1, 12)) + " from k group by o")
def _(t):
    wide = k.flux_by_order(reaches(t))
    return wide.select("outer", *[(F.col(f"flux_order_{m}") / 1e9).alias(f"flux_order_{m}") for m in range(1, 12)])


def climate(t):
    """Monthly means per region as pseudo climate."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_regionkey").alias("outer"), F.month("o_orderdate").alias("month")).agg(
        (F.avg("o_totalprice") / 1e4 - 10).alias("temp"), (F.avg("c_acctbal") / 40).alias("prec"))


SQL_CLIMATE = """
, cl as (select n_regionkey as o, month(o_orderdate) as m, avg(o_totalprice) / 1e4 - 10 as temp, avg(c_acctbal) / 40 as prec from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey group by all)"""


def climate_documents(t):
    """The same as one nested document, the shape the climate file has."""
    months = climate(t).groupBy("outer").agg(F.sort_array(F.collect_list(F.struct("month", "temp", "prec"))).alias("m"))
    entry = F.struct(F.col("outer").cast("string").alias("key"), F.struct(F.col("m.temp").alias("temp"), F.col("m.prec").alias("prec")).alias("value"))
    return months.agg(F.map_from_entries(F.collect_list(entry)).alias("climate"))


@query("climate_document_rows", "SRC11 U4", "with d as (select 1)" + SQL_CLIMATE + """
select o::varchar as "outer", m::int as month, round(temp, 6) as temp, round(prec, 6) as prec from cl""")
def _(t):
    return k.climate_rows(climate_documents(t))


def water(t):
    docs = k.region_water_temperature(climate_documents(t))
    return docs.select(F.col("outer").cast("int").alias("outer"), "water_c")


@query("calibration_error_by_region", "A38 A13 P38 P10 P11 J15 J19", SQL_REACHES + SQL_CLIMATE + """,
wt as (select o, greatest(3.941 + 0.818 * avg(temp), 0.1) as tw from cl where o <> 4 group by o),
f as (select n_nationkey as i, n_regionkey as o2, s_acctbal / 1e5 as fit, coalesce(tw, 15.0) as tw from supplier join nation on s_suppkey = n_nationkey left join wt on wt.o = n_regionkey where s_acctbal > 1000),
g as (select *, 1.0 / greatest(fit, 1e-10) / 2 as dp, tw + 273.15 as kk from f),
h as (select *, power(10.0, 108.3865 + 0.01985076 * kk + -6919.53 / kk + -40.4515 * log10(kk) + 669365.0 / (kk * kk)) as kh from g),
b as (select o, k.i as i, sum(area) as area, median(ex) as ex from k group by o, k.i),
e as (select b.o, b.i, fit, dp, tw, kh, coalesce(coalesce(ex, 0) * (dp * 1e-6 * kh * 1000 * 12.01) * area * (365.25 * 24 * 3600) * 1e-12, 0.0) as err from b left join h on b.i = h.i)
select o as "outer", round(sum(err), 6) as error_tg, count(*) as n_inner, round(avg(fit), 6) as mean_fitness, round(avg(tw), 6) as mean_water_c, round(avg(kh), 6) as mean_solubility, round(median(dp), 6) as median_delta_ppm from e group by o""")
def _(t):
    fits = t.supplier.where("s_acctbal > 1000").join(t.nation, F.col("s_suppkey") == F.col("n_nationkey")).select(
        F.col("n_nationkey").alias("inner"), F.col("n_regionkey").alias("outer"), (F.col("s_acctbal") / 1e5).alias("fitness"))
    return k.calibration_error_by_region(k.calibration_error(reaches(t), fits, water(t).where('`outer` <> 4')))


def areas(t):
    return reaches(t).groupBy("outer").agg((F.sum("length_km") / 1e3).alias("area_km2"))


SQL_EFFECTIVE = SQL_REACHES + SQL_CLIMATE + """,
ar as (select o, sum(len) / 1e3 as area from rr group by o),
co(ord, a, b, c, d, e, f, share) as (values (1, -0.009, 0.029, 0.77, -0.0019, 0.017, 0.026, 0.30), (2, -0.009, 0.029, 0.61, -0.0021, 0.011, 0.088, 0.20),
  (3, -0.008, 0.028, 0.44, -0.0018, 0.011, 0.058, 0.15), (4, -0.005, 0.023, 0.27, -0.0028, 0.012, 0.127, 0.10)),
dry as (select ar.o as o, m, area, sum({own} * least(greatest(a * prec + b * temp + c, 0.0), 0.9) * least(greatest(d * prec + e * temp + f, 0.0), 0.9)) as dry
  from ar cross join co join cl on cl.o = ar.o {join} group by all),
ea as (select o, any_value(area) as total, avg(dry) as eph, avg(area - dry) as eff from dry group by o)"""
SQL_FALLBACK = SQL_EFFECTIVE.format(own="area * share::double", join="")
SQL_OWN = SQL_EFFECTIVE.format(own="coalesce(oa, area * share::double)", join="left join (select o as oo, ord as oord, sum(area) / 1e9 as oa from k where ord <= 2 group by all) on oo = ar.o and oord = co.ord")
SQL_AREA_COLUMNS = """select o as "outer", round(total, 6) as total_km2, round(eph, 6) as ephemeral_km2, round(eff, 6) as effective_km2, round(eph / total * 100, 6) as reduction_pct from ea"""


@query("effective_area_fallback", "A46 P34 SRC11", SQL_FALLBACK + SQL_AREA_COLUMNS)
def _(t):
    return k.effective_area(areas(t), climate(t))


@query("effective_area_by_order", "A46 A15 P34", SQL_OWN + SQL_AREA_COLUMNS)
def _(t):
    own = k.area_by_order(reaches(t).where("`order` <= 2"), wide=False).withColumn("area_km2", F.col("area_m2") / 1e9)
    return k.effective_area(areas(t), climate(t), own)


def temperatures(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(F.col("n_regionkey").alias("outer"), F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"),
                    (F.col("o_totalprice") / 1e4 + 250).alias("t2m")).where("`outer` <> 3")


SQL_FROZEN = """
, fy as (select n_regionkey as o, month(o_orderdate) as m, year(o_orderdate) as y, avg((o_totalprice / 1e4 + 250 - 273.15 < -4.0)::int) as f from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey where n_regionkey <> 3 group by all), fs as (select o, m, avg(f) as share from fy group by o, m),
fl as (select *, lag(share) over (partition by o order by m) as prev from fs), mm as (select o, avg(share) as fa, count(*) filter (share < prev) as melt from fl group by o)"""


@query("frozen_share", "A19 F12 A7 P13", "with d as (select 1)" + SQL_FROZEN + """ select o as "outer", m::int as month, round(share, 6) as share from fs""")
def _(t):
    return k.frozen_share(temperatures(t))


@query("melt_months", "W4", "with d as (select 1)" + SQL_FROZEN + """ select o as "outer", round(fa, 6) as frozen_annual, melt as n_melt_months from mm""")
def _(t):
    return k.melt_months(k.frozen_share(temperatures(t)))


@query("melt_months_wrapped", "W4", "with d as (select 1)" + SQL_FROZEN + """
, fw as (select *, coalesce(prev, (select share from fs d where d.o = fl.o and d.m = 12)) as p2 from fl)
select o as "outer", round(avg(share), 6) as frozen_annual, count(*) filter (share < p2) as n_melt_months from fw group by o""")
def _(t):
    return k.melt_months(k.frozen_share(temperatures(t)), wrap=True)


def pixels(t):
    l = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return l.select(F.col("n_regionkey").alias("outer"), F.month("l_shipdate").alias("month"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / 1e3).alias("rate"))


SQL_PIXELS = """
, px as (select n_regionkey as o, month(l_shipdate) as m, avg(case when l_discount > 0 then l_extendedprice / 1e3 end) as rate, count(case when l_discount > 0 then 1 end) as n
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all), pr as (select o, avg(rate) as mean_rate, avg(n) as pix from px group by o)"""


@query("pixel_rates", "A20 A16 F1", "with d as (select 1)" + SQL_PIXELS + """ select o as "outer", round(mean_rate, 6) as mean_rate, round(pix, 6) as mean_pixels from pr""")
def _(t):
    return k.pixel_rates(pixels(t))


SQL_CASCADE = SQL_FALLBACK + SQL_FROZEN + SQL_PIXELS + """,
ca as (select pr.o as o, mean_rate, total as area, eff, eff * (1 - coalesce(fa, 0.0)) as act, coalesce(fa, 0.0) as fa, coalesce(melt, 0)::bigint as melt from pr left join ea on ea.o = pr.o left join mm on mm.o = pr.o),
cf as (select *, mean_rate * area * 1e6 * 1e-12 as f0, mean_rate * eff * 1e6 * 1e-12 as f1, mean_rate * act * 1e6 * 1e-12 as f2, mean_rate * act * 1e6 * 1e-12 * 0.17 * melt / 12 as f3 from ca)"""


def cascade(t):
    a = areas(t)
    return k.correction_cascade(k.pixel_rates(pixels(t)), a, k.effective_area(a, climate(t)), k.frozen_share(temperatures(t)))


@query("correction_cascade", "A47 A46 A19 A20 W4", SQL_CASCADE + """
select o as "outer", round(mean_rate, 6) as mean_rate, round(area, 6) as area_km2, round(eff, 6) as effective_km2, round(act, 6) as active_km2, round(fa, 6) as frozen_annual, melt as n_melt_months,
  round(f0 * 1e3, 6) as flux_raw, round(f1 * 1e3, 6) as flux_effective, round(f2 * 1e3, 6) as flux_active, round(f3 * 1e3, 6) as flux_melt, round((f2 + f3) * 1e3, 6) as flux_final from cf""")
def _(t):
    out = cascade(t)
    return out.withColumns({c: F.col(c) * 1e3 for c in out.columns if c.startswith("flux_")})


@query("correction_cascade_without_climate", "A47", SQL_CASCADE + """
select o as "outer", round(f0 * 1e3, 6) as flux_raw, round(f0 * 1e3, 6) as flux_final from cf""")
def _(t):
    out = k.correction_cascade(k.pixel_rates(pixels(t)), areas(t), None, None)
    return out.select("outer", (F.col("flux_raw") * 1e3).alias("flux_raw"), (F.col("flux_final") * 1e3).alias("flux_final"))


@query("cascade_totals", "A48 A22", SQL_CASCADE + """,
t as (select sum(area) as a, sum(eff) as e, sum(act) as c, sum(f0) as f0, sum(f1) as f1, sum(f2) as f2, sum(f2 + f3) as f4 from cf)
select round((a - e) / a * 100, 6) as area_effective_pct, round((e - c) / e * 100, 6) as area_active_pct, round((f0 - f1) / f0 * 100, 6) as flux_effective_pct, round((f1 - f2) / f1 * 100, 6) as flux_active_pct,
  round((f0 - f4) / f0 * 100, 6) as flux_final_pct, round(f4 * 1e3, 6) as flux_final from t""")
def _(t):
    out = k.cascade_totals(cascade(t))
    return out.select("area_effective_pct", "area_active_pct", "flux_effective_pct", "flux_active_pct", "flux_final_pct", (F.col("flux_final") * 1e3).alias("flux_final"))


@query("monthly_relative_sigma", "A21", SQL_CASCADE + """,
ms as (select unnest(range(1, 13)) as m, unnest([20, 20, 30, 30, 20, 20, 10, 20, 20, 10, 20, 20]) as s, unnest([115, 112, 137, 174, 208, 209, 205, 203, 174, 144, 114, 112]) as e),
sg as (select cf.o as o, any_value(f2 + f3) as flux, sum(coalesce(px.rate, mean_rate) * act * 1e6 * 1e-12 / 12 * (s::double / e)) as sigma from cf cross join ms left join px on px.o = cf.o and px.m = ms.m group by cf.o)
select o as "outer", round(flux * 1e3, 6) as flux, round(sigma * 1e3, 6) as sigma, round((flux - sigma) * 1e3, 6) as lower, round((flux + sigma) * 1e3, 6) as upper from sg""")
def _(t):
    out = k.monthly_sigma(k.monthly_mean_rates(pixels(t)), cascade(t))
    return out.select("outer", *[(F.col(c) * 1e3).alias(c) for c in ("flux", "sigma", "lower", "upper")])
