"""Skill, ranks, distributions and binned densities."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.catalog.scalars import edges_sql
from gridstats.operators import ranking, skill, summaries as s


def pairs(t):
    """Actual and predicted values: price against quantity times list price."""
    j = t.lineitem.join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_suppkey", "l_returnflag", (F.col("l_extendedprice") / 1e3).alias("y"),
                    (F.col("l_quantity") * F.col("p_retailprice") * 0.0018 + 1).alias("p"))


SQL_PAIRS = """
with pr as (select l_suppkey, l_returnflag, l_extendedprice / 1e3 as y, l_quantity * p_retailprice * 0.0018 + 1 as p from lineitem join part on l_partkey = p_partkey)"""
SQL_METRICS = """1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) as r2, sqrt(avg((p - y) * (p - y))) as rmse, avg(abs(p - y)) as mae, avg(abs((p - y) / y)) as mape,
  avg((p - y) / y) * 100 as smpe, sqrt(avg((ln(greatest(p, 1e-12)) - ln(greatest(y, 1e-12))) ** 2)) as rmsle,
  power(10.0, median(abs(log10(greatest(p, 1e-12) / greatest(y, 1e-12))))) - 1 as relative_error, avg(p - y) as mean_bias, abs(avg(p - y)) / avg(y) as abs_norm_bias,
  100 * sum(p - y) / sum(y) as pbias, power(10.0, avg(log10(greatest(p, 1e-12) / greatest(y, 1e-12)))) as log_bias, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) as nse,
  1 - sqrt((corr(y, p) - 1) ** 2 + (stddev_pop(p) / stddev_pop(y) - 1) ** 2 + (avg(p) / avg(y) - 1) ** 2) as kge, sqrt(avg((p - y) * (p - y))) / avg(y) as rrmse, count(*) as n_samples"""
SQL_ROUNDED = ", ".join(f"round({m}, 6) as {m}" for m in skill.METRICS) + ", n_samples"


@query("skill_overall", "A23 P8", SQL_PAIRS + f", m as (select {SQL_METRICS} from pr) select {SQL_ROUNDED} from m")
def _(t):
    return skill.skill_metrics(pairs(t), "y", "p")


@query("skill_per_group", "A24 U5", SQL_PAIRS + f", m as (select l_suppkey, {SQL_METRICS} from pr group by l_suppkey having count(*) >= 580) select l_suppkey, {SQL_ROUNDED} from m")
def _(t):
    return skill.skill_metrics(pairs(t), "y", "p", ["l_suppkey"], min_n=580)


@query("skill_group_counts", "A24", SQL_PAIRS + """
, g as (select l_suppkey, count(*) as n from pr group by l_suppkey) select count(*) as n_groups, count(*) filter (n >= 580) as n_kept, count(*) filter (n < 580) as n_excluded from g""")
def _(t):
    return skill.group_counts(pairs(t), "l_suppkey", 580)


SQL_GROUPED = SQL_PAIRS + f", m as (select l_suppkey, {SQL_METRICS} from pr group by l_suppkey), u as (select n_samples as w, unnest([" + ", ".join(
    f"{{'metric': '{m}', 'value': {m}}}" for m in skill.METRICS) + "]) as u from m), l as (select u.metric as metric, u.value as value, w from u)"


@query("skill_over_groups", "A25 W3", SQL_GROUPED + """
, c as (select *, sum(w) over (partition by metric order by value) as cum, sum(w) over (partition by metric) as tot from l)
select metric, round(avg(value), 6) as unweighted_mean, round(stddev_pop(value), 6) as unweighted_std, round(sum(value * w) / sum(w), 6) as weighted_mean, count(*) as n_groups,
  round(quantile_cont(value, 0.5), 6) as unweighted_median, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.75), 6) as p75,
  round(min(value) filter (cum >= tot / 2.0), 6) as weighted_median from c group by metric""")
def _(t):
    return skill.aggregate_over_groups(skill.skill_metrics(pairs(t), "y", "p", ["l_suppkey"]))


@query("skill_cdf_over_groups", "A26", SQL_GROUPED + """
select metric, round(value, 6) as value, count(*) as n_equal, round(any_value(cdf), 6) as cdf from (
  select metric, value, cume_dist() over (partition by metric order by value) as cdf from l where metric in ('rmse', 'kge')) group by metric, value""")
def _(t):
    return skill.metric_cdf(skill.skill_metrics(pairs(t), "y", "p", ["l_suppkey"]), ["rmse", "kge"])


@query("empirical_cdf", "A26 W6", """
select event_type, value, count(*) as n_equal, round(any_value(cdf), 6) as cdf from (select event_type, value, cume_dist() over (partition by event_type order by value) as cdf from events) group by event_type, value""")
def _(t):
    return ranking.empirical_cdf(t.events, ["event_type"], "value")


@query("average_tie_ranks", "W6", """
select l_quantity, count(*) as n_equal, any_value(r) + (count(*) - 1) / 2.0 as avg_rank, round(any_value(cd), 6) as cume_dist, any_value(n) as n_group
from (select l_quantity, rank() over (order by l_quantity) as r, cume_dist() over (order by l_quantity) as cd, count(*) over () as n from lineitem) group by l_quantity""")
def _(t):
    return ranking.value_ranks(t.lineitem, [], "l_quantity")


SQL_RANKED = """
with r as (select {by} rank() over ({part} order by {x}) + (count(*) over (partition by {by} {x}) - 1) / 2.0 as a,
  rank() over ({part} order by {y}) + (count(*) over (partition by {by} {y}) - 1) / 2.0 as b from {table})
select {by} round(corr(a, b), 6) as rho, count(*) as n from r {group}"""


@query("rank_correlation", "A30 W6", SQL_RANKED.format(by="", part="", x="l_quantity", y="l_extendedprice", table="lineitem", group=""))
def _(t):
    return ranking.spearman(t.lineitem, [], "l_quantity", "l_extendedprice")


@query("rank_correlation_per_group", "A30", SQL_RANKED.format(by="p_type,", part="partition by p_type", x="p_size", y="p_retailprice", table="part", group="group by p_type"))
def _(t):
    return ranking.spearman(t.part, ["p_type"], "p_size", "p_retailprice")


@query("two_sample_distance", "A35 W6", """
with m as (select l_returnflag = 'A' as side, unnest([{f: 'l_quantity', v: l_quantity}, {f: 'l_extendedprice', v: l_extendedprice}, {f: 'l_tax', v: l_tax}]) as u from lineitem where l_returnflag in ('A', 'R')),
d as (select u.f as feature, u.v as v, count(*) filter (side) as a, count(*) filter (not side) as b from m group by all),
w as (select feature, sum(a) over o as ca, sum(b) over o as cb, sum(a) over (partition by feature) as na, sum(b) over (partition by feature) as nb from d window o as (partition by feature order by v)),
k as (select feature, max(abs(ca / na - cb / nb)) as ks, max(na)::bigint as n_left, max(nb)::bigint as n_right from w group by feature),
e as (select *, sqrt(n_left::double * n_right / (n_left + n_right)) * ks as z from k)
select feature, round(ks, 6) as ks, n_left, n_right, round(case when z < 0.05 then 1.0 else least(greatest(2 * list_sum(list_transform(range(1, 101), lambda i: (case when i % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0::double * i * i * z * z))), 0.0), 1.0) end, 6) as p_value from e""")
def _(t):
    return ranking.ks_two_sample(t.lineitem.where("l_returnflag = 'A'"), t.lineitem.where("l_returnflag = 'R'"),
                                 ["l_quantity", "l_extendedprice", "l_tax"])


@query("histogram_equal_width", "A27", """
with e as (select min(value) as lo, (max(value) - min(value)) / 40 as w, count(*) as t from events),
b as (select least(floor((value - lo) / w)::bigint, 39) as bin, lo, w, t from events cross join e)
select bin, round(any_value(lo) + bin * any_value(w), 6) as bin_start, count(*) as n, round(count(*) / (any_value(t) * any_value(w)), 6) as density from b group by bin""")
def _(t):
    return s.histogram(t.events, "value", bins=40)


@query("histogram_log", "A27", """
with v as (select event_type, log10(value) as v from events), e as (select min(v) - 0.2 as lo, (max(v) + 0.2 - (min(v) - 0.2)) / 59 as w from v),
b as (select event_type, least(floor((v - lo) / w)::bigint, 58) as bin, lo, w from v cross join e), t as (select event_type, count(*) as t from events group by event_type)
select event_type, bin, round(any_value(lo) + bin * any_value(w), 6) as bin_start, count(*) as n, round(count(*) / (any_value(t) * any_value(w)), 6) as density from b join t using (event_type) group by event_type, bin""")
def _(t):
    return s.histogram(t.events, "value", bins=59, log10=True, pad=0.2, keys=["event_type"])


@query("histogram_fixed_width", "A27", """
select floor(l_extendedprice / 100)::bigint as bin, floor(l_extendedprice / 100) * 100.0 as bin_start, count(*) as n, round(count(*) / ((select count(*) from lineitem) * 100.0), 8) as density from lineitem group by all""", digits=8)
def _(t):
    return s.histogram(t.lineitem, "l_extendedprice", width=100.0)


SQL_LATTICE = SQL_PAIRS + """
, v as (select log10(y) as x, log10(p) as q from pr), e as (select min(x) - 0.3 as x0, (max(x) + 0.3 - (min(x) - 0.3)) / {n} as wx, min(q) - 0.3 as y0, (max(q) + 0.3 - (min(q) - 0.3)) / {n} as wy from v),
h as (select least(floor((x - x0) / wx), {n} - 1)::int as i, least(floor((q - y0) / wy), {n} - 1)::int as j, count(*) as n from v cross join e group by all)"""


def log_pairs(t):
    return pairs(t).select(F.log10("y").alias("x"), F.log10("p").alias("q"))


@query("histogram_two_dimensional", "A28", SQL_LATTICE.format(n=119) + "select i, j, n from h")
def _(t):
    return s.histogram_2d(log_pairs(t), "x", "q")


@query("smoothed_density", "A28", SQL_LATTICE.format(n=119) + """
, k as (select d, exp(-0.5 * (d / 1.8) ** 2) as w from (select unnest(range(-7, 8)) as d)), kn as (select d, w / (select sum(w) from k) as w from k),
a as (select s.i as i, h.j as j, sum(h.n * kn.w) as v from (select unnest(range(0, 119)) as i) s cross join kn join h on h.i = case when s.i + d < 0 then -1 - (s.i + d) when s.i + d > 118 then 237 - (s.i + d) else s.i + d end group by all),
b as (select a.i as i, s.j as j, sum(a.v * kn.w) as v from (select unnest(range(0, 119)) as j) s cross join kn join a on a.j = case when s.j + d < 0 then -1 - (s.j + d) when s.j + d > 118 then 237 - (s.j + d) else s.j + d end group by all)
select i::int as i, j::int as j, round(v, 6) as density from b""")
def _(t):
    return s.smooth_lattice(s.histogram_2d(log_pairs(t), "x", "q"))


@query("hexagonal_bins", "A29", SQL_PAIRS + """
, v as (select log10(y) as x, log10(p) as q from pr), e as (select min(x) as x0, (max(x) - min(x)) / 50 as wx, min(q) as y0, (max(q) - min(q)) / 28 as wy from v),
u as (select (x - x0) / wx as u, (q - y0) / wy as v from v cross join e),
d as (select u, v, round_even(u, 0) as i1, round_even(v, 0) as j1, floor(u) as i2, floor(v) as j2 from u),
c as (select (u - i1) ** 2 + 3 * (v - j1) ** 2 < (u - i2 - 0.5) ** 2 + 3 * (v - j2 - 0.5) ** 2 as first, * from d)
select (case when first then 0 else 1 end)::int as lattice, (case when first then i1 else i2 end)::bigint as i, (case when first then j1 else j2 end)::bigint as j, count(*) as n from c group by all having count(*) >= 3""")
def _(t):
    return s.hexbin(log_pairs(t), "x", "q", gridsize=50, min_count=3)


@query("running_median", "A31 P22", edges_sql("lineitem", "l_extendedprice", 20) + """
select bin, count(*) as n_x, round(median(l_extendedprice), 4) as median_x, round(median(l_quantity), 4) as median_y from b group by bin""", digits=4)
def _(t):
    return s.running_median(t.lineitem, "l_extendedprice", "l_quantity")


@query("box_plot_statistics", "A32", """
with q as (select event_type, count(*) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from events group by event_type)
select event_type, any_value(n) as n, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median, round(any_value(q3), 6) as q3,
  min(value) filter (value >= q1 - 1.5 * (q3 - q1)) as whisker_low, max(value) filter (value <= q3 + 1.5 * (q3 - q1)) as whisker_high,
  count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as n_outliers from events join q using (event_type) group by event_type""")
def _(t):
    return s.box_stats(t.events, ["event_type"], "value")


@query("deltas_to_baseline", "W8", SQL_PAIRS + """
, m as (select l_returnflag, 1 - sum((p - y) ** 2) / (var_pop(y) * count(*)) as r2, sqrt(avg((p - y) ** 2)) as rmse from pr group by l_returnflag), d as (select a.l_returnflag, a.r2 - b.r2 as d1, a.rmse - b.rmse as d2 from m a cross join (select * from m where l_returnflag = 'N') b)
select l_returnflag, round(d1, 6) as delta_r2, case when d1 < -0.001 then 'hurt' when d1 > 0.001 then 'helped' else 'same' end as mark_r2, round(d2, 6) as delta_rmse, case when d2 > 0.001 then 'hurt' when d2 < -0.001 then 'helped' else 'same' end as mark_rmse from d""")
def _(t):
    m = skill.skill_metrics(pairs(t), "y", "p", ["l_returnflag"])
    return skill.deltas_to_baseline(m, m.where("l_returnflag = 'N'"), "l_returnflag", ["r2", "rmse"], ["r2"])
