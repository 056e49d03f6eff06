"""Feature preparation and leakage-safe splits."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.operators import features as f
from gridstats.operators import splits
from gridstats.operators.neighbours import knn_impute


def gaps(t):
    """Event values with gaps: errors carry none, purchases only large ones."""
    kind = F.col("event_type")
    value = F.when((kind != "error") & ((kind != "purchase") | (F.col("value") > 5)), F.col("value"))
    return t.events.select("event_id", "user_id", "event_type", value.alias("value"),
                           F.when(kind != "view", F.get_json_object("props", "$.k").cast("double")).alias("k"))


SQL_GAPS = """
with v as (select event_id, user_id, event_type, case when event_type <> 'error' and (event_type <> 'purchase' or value > 5) then value end as value,
  case when event_type <> 'view' then json_extract_string(props, '$.k')::double end as k from events)"""


def sql_skew(x: str, where: str = "") -> str:
    return f"(avg({x} ** 3) - 3 * avg({x}) * avg({x} ** 2) + 2 * avg({x}) ** 3) / nullif((avg({x} ** 2) - avg({x}) ** 2), 0) ** 1.5"


SQL_FILLS = SQL_GAPS + f"""
, s as (select case when abs({sql_skew('value')}) > 1 then median(value) else avg(value) end as fv, case when abs({sql_skew('k')}) > 1 then median(k) else avg(k) end as fk from v)"""


@query("imputation", "M6 P23", SQL_FILLS + """
select event_id, round(coalesce(value, fv), 6) as value, round(coalesce(k, fk), 6) as k from v cross join s""")
def _(t):
    v = gaps(t)
    return f.impute(v, f.fit_imputer(v, ["value", "k"]), ["value", "k"]).select("event_id", "value", "k")


@query("share_missing", "M7 P24", SQL_GAPS + """
select round(greatest(avg((value is null)::int), avg((k is null)::int)), 6) as worst_share, greatest(avg((value is null)::int), avg((k is null)::int)) > 0.5 as high_missing from v""")
def _(t):
    return f.high_missing(gaps(t), ["value", "k"])


SQL_KNN = """
with v as (select event_id, case when event_type <> 'error' then value end as a, case when event_type <> 'view' then json_extract_string(props, '$.k')::double end as b, user_id::double as c from events),
q as (select * from v where a is null or b is null),
p as (select q.event_id as q, d.event_id as id, d.a, d.b, q.a as qa, q.b as qb, sqrt(coalesce((q.a - d.a) ** 2, 0) + coalesce((q.b - d.b) ** 2, 0) + (q.c - d.c) ** 2)
  * sqrt(3.0::double / (1 + (q.a is not null and d.a is not null)::int + (q.b is not null and d.b is not null)::int)) as dist from q cross join v d),
ra as (select q, a, dist, row_number() over (partition by q order by dist, id) as r from p where qa is null and a is not null),
rb as (select q, b, dist, row_number() over (partition by q order by dist, id) as r from p where qb is null and b is not null),
ea as (select q, case when min(dist) = 0 then avg(a) filter (dist = 0) else sum(a / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) end as a from ra where r <= 5 group by q),
eb as (select q, case when min(dist) = 0 then avg(b) filter (dist = 0) else sum(b / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) end as b from rb where r <= 5 group by q)
select event_id, round(coalesce(v.a, ea.a), 6) as a, round(coalesce(v.b, eb.b), 6) as b, c from v left join ea on ea.q = event_id left join eb on eb.q = event_id"""


@query("nearest_neighbour_imputation", "M7 J12", SQL_KNN)
def _(t):
    kind = F.col("event_type")
    v = t.events.select("event_id", F.when(kind != "error", F.col("value")).alias("a"),
                        F.when(kind != "view", F.get_json_object("props", "$.k").cast("double")).alias("b"), F.col("user_id").cast("double").alias("c"))
    return knn_impute(v, v, ["a", "b", "c"], "event_id", 5)


SQL_SCALED = """
with v as (select event_id, value, json_extract_string(props, '$.k')::double as k, user_id::double as u from events),
m as (select {x} as x, event_id from v), a as (select {skew} as sk, min(x) as mn from m),
sh as (select *, case when abs(sk) > 1.5 and mn <= 0 then abs(mn) + 1 else 0 end as shift from a),
lg as (select {lskew} as lsk from (select ln(x + shift + 1) as l from m cross join sh)),
c as (select shift, abs(sk) > 1.5 and abs(lsk) < abs(sk) as ul from sh cross join lg),
z as (select event_id, case when ul then ln(x + shift + 1) else x end as z from m cross join c),
q as (select quantile_cont(z, 0.25) as q1, median(z) as q2, quantile_cont(z, 0.75) as q3, avg(z) as mu, stddev_pop(z) as sd from z),
o as (select count(*) filter (z < q1 - 1.5 * (q3 - q1) or z > q3 + 1.5 * (q3 - q1)) / count(*) > 0.1 as rb from z cross join q)
select event_id, round((z - case when rb then q2 else mu end) / case when rb then q3 - q1 else sd end, 6) as {name} from z cross join q cross join o"""


def _scaling(name, source):
    sql = SQL_SCALED.format(x=source, skew=sql_skew("x"), lskew=sql_skew("l"), name=name)

    @query(f"adaptive_scaling_{name}", "M8", sql)
    def _(t):
        v = t.events.select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("user_id").cast("double").alias("u"))
        v = v.select("event_id", F.expr(source).alias(name))
        return f.scale(v, f.fit_scaler(v, [name]), [name])


_scaling("heavy_tail", "value")
_scaling("shifted_tail", "power(value, 2) - 50")
_scaling("flat", "k")
_scaling("spiky", "case when k < 80 then u / 1000 else u end")


@query("ordinal_codes", "M9 P19", """
with v as (select c_custkey, c_acctbal, case when c_mktsegment <> 'AUTOMOBILE' then c_mktsegment else 'Missing' end as s from customer),
c as (select distinct s from v where c_acctbal > 0 and s <> 'FURNITURE'), r as (select s, row_number() over (order by s) - 1 as code from c)
select c_custkey, coalesce(code, -1)::int as code from v left join r using (s)""")
def _(t):
    # One segment stands for missing values, one is not seen in training.
    rows = t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("AUTOMOBILE")))
    table = f.fit_ordinal(rows.where("c_acctbal > 0 and c_mktsegment is distinct from 'FURNITURE'"), "c_mktsegment")
    return f.apply_ordinal(rows, table, "c_mktsegment", "encoded").select("c_custkey", F.col("encoded").alias("code"))


@query("target_encoding", "M10", """
with tr as (select * from events where event_type <> 'signup'), pr as (select avg(value) as p from tr),
e as (select event_type, avg(value) as m, count(*) as n from tr group by event_type)
select event_id, round(coalesce(p * (1 - 1 / (1 + exp(-(n - 1990) / 25.0))) + m * (1 / (1 + exp(-(n - 1990) / 25.0))), p), 6) as encoded from events cross join pr left join e using (event_type)""")
def _(t):
    encoder = f.fit_target_encoder(t.events.where("event_type <> 'signup'"), "event_type", "value", min_leaf=1990)
    return f.apply_target_encoder(t.events, encoder, "event_type", "encoded").select("event_id", "encoded")


@query("one_hot_columns", "M11", """
select c_custkey, (c_mktsegment = 'BUILDING')::int::double as c_mktsegment_building, (c_mktsegment = 'HOUSEHOLD')::int::double as c_mktsegment_household, (c_mktsegment = 'MACHINERY')::int::double as c_mktsegment_machinery from customer""")
def _(t):
    levels = f.one_hot_levels(t.customer.where("c_mktsegment <> 'FURNITURE'"), "c_mktsegment")
    wide = f.apply_one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", levels).drop("c_mktsegment")
    return wide.select(*[F.col(c).cast("double").alias(c.lower()) if c != "c_custkey" else F.col(c) for c in wide.columns])


def labelled(t):
    return t.events.select("event_id", "user_id", "value")


SQL_STRATA = """
with g as (select user_id, median(value) as m from events group by user_id), e as (select list_sort(list_distinct(quantile_cont(m, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) as edges from g),
st as (select user_id, m, greatest(len(list_filter(edges, lambda x: x < m)) - 1, 0)::int as stratum from g cross join e)"""


@query("grouped_train_test_split", "M3 J13 SET3", SQL_STRATA + """
, s as (select stratum, count(*) as n, ceil(count(*) * 0.2) as h from st group by stratum)
select sum(n)::bigint as n_groups, sum(h)::bigint as n_test_groups, (select count(*) from events) as n_rows, 0::bigint as n_shared from s""")
def _(t):
    # Which groups are drawn depends on the hash; how many, and that none is split, does not.
    split = splits.train_test_groups(labelled(t), "user_id", "value")
    groups = split.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("is_test").cast("int")).alias("hi"), F.min(F.col("is_test").cast("int")).alias("lo"))
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("hi").alias("n_test_groups"), F.sum("n").alias("n_rows"), F.count_if(F.col("hi") != F.col("lo")).alias("n_shared"))


@query("strata_of_groups", "M3 P22 A1", SQL_STRATA + " select user_id, round(m, 6) as median_label, stratum from st")
def _(t):
    return splits.stratified_groups(labelled(t), "user_id", "value")


@query("calibration_group_split", "M4", SQL_STRATA + """
select stratum, count(*) as n_groups, ceil(count(*) * 0.25)::bigint as n_calibration from st group by stratum""")
def _(t):
    groups = splits.stratified_groups(labelled(t), "user_id", "value")
    drawn = splits.train_fit_calibration_groups(groups, "user_id", share=0.25, seed=2)
    return drawn.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("is_calibration").alias("n_calibration"))


@query("group_folds", "M5", """
with g as (select count(distinct user_id) as n from events), r as (select unnest(range(0, (select n from g))) % 10 as t)
select (case when t < 5 then t else 9 - t end)::int as fold, count(*) as n_groups from r group by 1""")
def _(t):
    folds = splits.group_folds(labelled(t), "user_id", 5).groupBy("fold", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"))
