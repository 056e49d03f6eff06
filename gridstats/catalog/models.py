"""Boosted trees on the tables: the price of an order line from its other columns.

Scores depend on the tree learner, so the queries return what SQL can know of any learner: rows and groups
per fold and condition, subsets tried, vectors against their columns, and orders that scores must keep.
"""

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.operators import boosting as b
from gridstats.operators import skill, splits
from gridstats.operators.features import interaction_terms
from gridstats.operators.scalars import attach_scalars, literal_row
from gridstats.operators.trees import packed
from gridstats.operators.uncertainty import coverage, percent
from gridstats.plans.scoring import model_input, score_grid, static_by_month
from gridstats.session import cut_lineage, stored
from gridstats.sources.writers import load_fitted, save_fitted, write_partitions
from gridstats.streaming import incremental

LEVELS = (0.68, 0.90, 0.95)
CONFIG = b.BoostingConfig(trees=8, depth=4, rate=0.3)
SMALL = b.BoostingConfig(trees=3, depth=3, rate=0.3)
NUMERIC = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "size_price"]
CATEGORICAL = {"p_type": "target", "p_brand": "ordinal"}


def lines(t):
    """Order lines with part attributes and log price; discounts of zero count as missing."""
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_type", "p_brand")
    l = t.lineitem.select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_tax", "l_extendedprice",
                          F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"))
    rows = interaction_terms(l.join(p, F.col("l_partkey") == F.col("p_partkey")), [("size_price", "p_size", "p_retailprice", "multiply")])
    return b.log_target(rows, "l_extendedprice")


NEEDED = ["l_suppkey", "l_extendedprice", "log_target", *NUMERIC, *CATEGORICAL]


def needed(t):
    """What the models use of the order lines, written once."""
    return stored(lines(t).select(*NEEDED))


def split(t, held=None):
    """Rows to train and to test on; ``held`` are order lines that are stored already."""
    rows = needed(t) if held is None else held.select(*NEEDED)
    rows = stored(splits.train_test_groups(rows, "l_suppkey", "log_target"))
    return rows.where(~F.col("is_test")), rows.where("is_test")


def prepared(t):
    train, test = split(t)
    fitted = b.fit_features(train, NUMERIC, CATEGORICAL, "log_target")
    return fitted, fitted.apply(train), fitted.apply(test)


SQL_LINES = """
with l as (select l_suppkey, ln(l_extendedprice) as y from lineitem join part on l_partkey = p_partkey where l_extendedprice > 0),
g as (select l_suppkey, median(y) as m, count(*) as c from l group by l_suppkey),
e as (select list_sort(list_distinct(quantile_cont(m, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) as edges from g),
st as (select greatest(len(list_filter(edges, lambda x: x < m)) - 1, 0)::int as stratum from g cross join e),
s as (select stratum, ceil(count(*) * 0.2) as h from st group by stratum)"""


def wrong_vectors(df, features):
    """Rows whose assembled vector is not their columns in order."""
    columns = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    return F.count_if(vector_to_array("features") != columns).alias("wrong_vectors")


@query("boosted_trees_skill", "M12 M13 M3 M6 M8 M9 M10 A23", SQL_LINES + """
select (select count(*) from l) as n_rows, (select sum(h)::bigint from s) as test_groups, 0::bigint as wrong_vectors, true as rises_with_price, true as rmse_above_mae""")
def _(t):
    """The facts that hold for any learner; the scores themselves depend on the trees."""
    fitted, train, test = prepared(t)
    train, test = stored(train), stored(test)
    model = b.fit_boosted(train, fitted.names, "log_target", CONFIG)
    found = stored(b.score(model, test, fitted.names))
    rises = found.agg((F.corr("log_target", "log_prediction") > 0).alias("v"))
    m = skill.skill_metrics(found.select("l_extendedprice", F.exp("log_prediction").alias("p")), "l_extendedprice", "p")
    sides = train.withColumn("held", F.lit(False)).unionByName(test.withColumn("held", F.lit(True)))
    counts = b.assemble(sides, fitted.names).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(F.col("held"), F.col("l_suppkey"))).alias("test_groups"),
                                                 wrong_vectors(sides, fitted.names))
    return attach_scalars(attach_scalars(counts, m, "m"), rises, "r").select(*counts.columns, F.col("r.v").alias("rises_with_price"), (F.col("m.rmse") >= F.col("m.mae")).alias("rmse_above_mae"))


SQL_FOLDS = SQL_LINES + """,
f as (select least(t, 5 - t) as fold, c from (select c, (row_number() over (order by c desc) - 1) % 6 as t from g))"""


def all_folds(t):
    """All order lines with features and three grouped folds."""
    rows = needed(t)
    fitted = b.fit_features(rows, NUMERIC, CATEGORICAL, "log_target")
    return fitted, fitted.apply(splits.group_folds(rows, "l_suppkey", 3))


@query("grouped_cross_validation", "M14 M5 A24", SQL_FOLDS + """
select fold::int as fold, sum(c)::bigint as n_samples, true as scores_below_one, true as rmse_above_mae from f group by fold""")
def _(t):
    fitted, folds = all_folds(t)
    metrics, _ = b.cross_validate(folds, fitted.names, "log_target", "l_suppkey", 3, SMALL)
    return metrics.select("fold", "n_samples", ((F.col("r2") <= 1) & (F.col("kge") <= 1) & (F.col("group_median_r2") <= 1)).alias("scores_below_one"),
                          (F.col("rmse") >= F.col("mae")).alias("rmse_above_mae"))


@query("fold_importances", "A36 M14", """
select unnest(['l_quantity', 'l_discount', 'l_tax', 'p_size', 'p_retailprice', 'size_price', 'p_type_encoded', 'p_brand_encoded']) as source, 1::bigint as n_columns, true as is_share, 1.0::double as total""")
def _(t):
    fitted, folds = all_folds(t)
    _, imps = b.cross_validate(folds, fitted.names, "log_target", "l_suppkey", 3, SMALL)
    found = cut_lineage(b.importance_rollup(imps))
    total = found.agg(F.sum("importance").alias("v"))
    return attach_scalars(found, total, "t").select("source", "n_columns", F.col("importance").between(0, 1).alias("is_share"), F.col("t.v").alias("total"))


@query("feature_elimination", "M15", """
select n_features, true as scored, true as one_best, true as kept_as_many, 0::bigint as wrong_vectors from (select unnest([6, 4, 2])::int as n_features)""")
def _(t):
    """Subsets of six, four and two features, in each of two folds; the survivors are as many as the best subset."""
    fitted, train, _ = prepared(t)
    folds = stored(splits.group_folds(train, "l_suppkey", 2))
    encoded = [f for f in fitted.names if f not in fitted.numeric]
    kept, trail, model = b.eliminate_features(folds, fitted.numeric, "log_target", 2, SMALL, always=encoded, step=2, minimum=2)
    best = trail.agg(F.count_if("selected").alias("n"), F.max(F.when(F.col("selected"), F.col("n_features"))).alias("size"))
    wrong = literal_row(b.assemble(folds, [*kept, *encoded]).agg(wrong_vectors(folds, [*kept, *encoded])))
    marked = attach_scalars(trail, best, "b")
    whole = F.lit(model.numFeatures == len(kept) + len(encoded) and set(kept) <= set(fitted.numeric))
    return marked.select("n_features", (F.col("cv_mean") <= 1).alias("scored"), (F.col("b.n") == 1).alias("one_best"),
                         ((F.col("b.size") == len(kept)) & whole).alias("kept_as_many"), wrong["wrong_vectors"].alias("wrong_vectors"))


def calibrated(t, held=None):
    train, test = split(t, held)
    fitted = b.fit_features(train, NUMERIC, CATEGORICAL, "log_target")
    groups = splits.stratified_groups(train, "l_suppkey", "log_target")
    # Of a size that the planner knows: the rows need not move to meet the groups.
    drawn = stored(splits.train_fit_calibration_groups(groups, "l_suppkey").select("l_suppkey", "is_calibration"))
    rows = packed(fitted.apply(train).join(drawn, "l_suppkey"), fitted.names, "log_target", ["is_calibration"])
    model, radii = b.fit_packed_with_intervals(rows, "is_calibration", "log_target", LEVELS, CONFIG)
    return fitted, model, radii, fitted.apply(test)


@query("conformal_coverage", "M16 M4 P29 A43", SQL_LINES + """
select unnest([0.68, 0.90, 0.95])::double as level, (select sum(h)::bigint from s) as test_groups, 0::bigint as outside_next, true as covers_more""")
def _(t):
    """Intervals of rising levels hold each other and cover more of the prices."""
    fitted, model, radii, test = calibrated(t)
    scored = stored(b.score_with_intervals(model, test, fitted.names, radii, LEVELS))
    groups = scored.agg(F.count_distinct("l_suppkey").alias("n"))
    covered, out = None, None
    for level, wider in zip(LEVELS, [*LEVELS[1:], LEVELS[-1]]):
        low, high = (f"{side}_{percent(level)}" for side in ("lower", "upper"))
        row = coverage(scored, "l_extendedprice", "predicted", low, high)
        outside = scored.agg(F.count_if((F.col(low) < F.col(f"lower_{percent(wider)}")) | (F.col(high) > F.col(f"upper_{percent(wider)}"))).alias("n"))
        row = attach_scalars(attach_scalars(row.select(F.col("coverage").alias("share")), outside, "o"), groups, "g")
        more = F.lit(True) if covered is None else F.col("share") >= F.lit(covered)
        covered = row.first()["share"]
        row = row.select(F.lit(level).alias("level"), F.col("g.n").alias("test_groups"), F.col("o.n").alias("outside_next"), more.alias("covers_more"))
        out = row if out is None else out.unionByName(row)
    return out


@query("feature_group_ablation", "M18 W8", SQL_LINES + """
select condition, n_features, (select sum(h)::bigint from s) as n_groups, true as scores_below_one, condition = 'FULL' as same_as_full
from (values ('FULL', 8), ('no_part', 6), ('no_type', 7)) v(condition, n_features)""")
def _(t):
    """Every condition is tested on the same groups; only FULL shows no difference to itself."""
    train, test = split(t)
    results = cut_lineage(b.ablate(train, test, NUMERIC, CATEGORICAL, "log_target", {"no_part": ["p_retailprice", "size_price"], "no_type": ["p_type"]},
                                  SMALL, group="l_suppkey", k=2))
    deltas = skill.deltas_to_baseline(results, results.where("condition = 'FULL'"), "condition", ["r2", "rmsle", "kge"], ["r2", "kge"])
    below = (F.col("r2") <= 1) & (F.col("train_r2") <= 1) & (F.col("cv_r2_mean") <= 1) & (F.col("group_r2_median") <= 1) & (F.col("group_kge_median") <= 1)
    joined = results.select("condition", "n_features", "n_groups", below.alias("scores_below_one")).join(deltas, "condition")
    return joined.select("condition", "n_features", "n_groups", "scores_below_one", ((F.col("delta_r2") == 0) & (F.col("delta_rmsle") == 0) & (F.col("delta_kge") == 0)).alias("same_as_full"))


@query("partitioned_scoring", "M17 J4 J5 P4 P5 P6 P29 SNK2", """
select year(l_shipdate)::int as year, month(l_shipdate)::int as month, count(distinct l_suppkey) as n, true as bounds_hold, true as near_the_price
from lineitem where l_extendedprice > 0 group by all""")
def _(t):
    """Suppliers are cells: monthly line statistics joined to static attributes, scored, written, read back."""
    cell = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    cell = cell.agg(F.avg("l_quantity").alias("l_quantity"), F.avg("l_discount").alias("l_discount"), F.avg("l_extendedprice").alias("price"))
    place = {"latitude": F.col("l_suppkey") * 0.1, "longitude": F.lit(0.0)}
    daily = cell.select("year", "month", "l_quantity", "price", *[v.alias(n) for n, v in place.items()])
    other = cell.select("year", "month", "l_discount", *[v.alias(n) for n, v in place.items()])
    static = t.supplier.select((F.col("s_suppkey") * 0.1).alias("latitude"), F.lit(0.0).alias("longitude"), *[
        (F.col("s_acctbal") * (1 + m / 100)).alias(f"balance{m:02d}") for m in range(1, 13)])
    rows = model_input(daily, [other], static_by_month(static, ["balance"]), {"balance": "account"}, [("load", "l_quantity", "l_discount", "multiply")])
    rows = cut_lineage(b.log_target(rows, "price"))
    features = ["l_quantity", "l_discount", "account", "load", "month_sin", "month_cos", "season"]
    fitted = b.fit_features(rows, features, {}, "log_target")
    ready = fitted.apply(rows)
    held = F.col("year") >= 2000
    model, radii = b.fit_with_intervals(cut_lineage(ready.where(~held)), ready.where(held), features, "log_target", LEVELS, SMALL)
    path = t.scratch("scored")
    write_partitions(score_grid(rows, fitted, model, radii, LEVELS, ["year", "month", "latitude", "longitude"]), path)
    back = t.spark.read.parquet(path)
    held = F.bool_and((F.col("lower_95") <= F.col("lower_90")) & (F.col("lower_90") < F.col("predicted"))
                      & (F.col("predicted") < F.col("upper_90")) & (F.col("upper_90") <= F.col("upper_95")))
    # Prices spread over two decades; a month's mean prediction stays within a factor of three of its mean price.
    near = (F.avg("predicted") / F.max("mean_price")).between(1 / 3, 3)
    prices = rows.groupBy("year", "month").agg(F.avg("price").alias("mean_price"))
    return back.join(prices, ["year", "month"]).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), held.alias("bounds_hold"), near.alias("near_the_price"))


@query("fitted_model_round_trip", "SNK7 M13", SQL_LINES + """
select sum(h)::bigint as test_groups, 0.0::double as largest_difference from s""")
def _(t):
    """A model and its feature parameters, saved and restored, give the same predictions on raw rows."""
    train, raw = split(t)
    raw = cut_lineage(raw.withColumn("line", F.monotonically_increasing_id()))
    fitted = b.fit_features(train, NUMERIC, {"p_type": "target", "p_brand": "onehot"}, "log_target")
    model = b.fit_boosted(cut_lineage(fitted.apply(train)), fitted.names, "log_target", SMALL)
    path = t.scratch("fitted")
    save_fitted(model, {}, path)
    fitted.save(f"{path}/features")
    again, _ = load_fitted(t.spark, GBTRegressionModel, [], path)
    restored = b.FittedFeatures.load(t.spark, f"{path}/features")
    first = b.score(model, fitted.apply(raw), fitted.names, "first").select("line", "l_suppkey", "first")
    second = b.score(again, restored.apply(raw), restored.names, "second").select("line", "second")
    return first.join(second, "line", "left").agg(
        F.count_distinct("l_suppkey").alias("test_groups"), F.max(F.coalesce(F.abs(F.col("first") - F.col("second")), F.lit(float("inf")))).alias("largest_difference"))


@query("incremental_model_scoring", "ST2 M17", """
select year(l_shipdate)::int as year, count(*) as n, true as bounds_hold from lineitem join part on l_partkey = p_partkey where l_extendedprice > 0 group by 1""")
def _(t):
    """Lines land in two portions; a stream scores each with the model and its intervals, once."""
    # Joined once: the model and both portions read it.
    rows = stored(lines(t).withColumn("year", F.year("l_shipdate")))
    fitted, model, radii, _ = calibrated(t, rows)
    landing, out, state = t.scratch("landing"), t.scratch("scored"), t.scratch("state")
    first = F.coalesce(F.col("year") < 1995, F.lit(False))
    for portion in (first, ~first):
        rows.where(portion).write.mode("append").parquet(landing)
        stream = incremental.landed_stream(t.spark, landing, rows.schema)
        incremental.finished(incremental.score_new(stream, lambda s: score_grid(s, fitted, model, radii, LEVELS, ["year"]), out, state, by=["year"]))
    hold = (F.col("lower_95") <= F.col("lower_90")) & (F.col("lower_90") < F.col("predicted")) & (F.col("predicted") < F.col("upper_90")) & (F.col("upper_90") <= F.col("upper_95"))
    return t.spark.read.parquet(out).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.bool_and(hold).alias("bounds_hold"))
