"""Composed plans: flux equivalence, conformal intervals, splits, models, training table, sinks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstats import catalog
from gridstats.operators import boosting, features, splits
from gridstats.operators.skill import skill_metrics
from gridstats.operators.summaries import histogram_2d, smooth_lattice
from gridstats.operators.uncertainty import conformal_radii, coverage
from gridstats.plans.flux import annual_flux, mean_over_years, monthly_flux, total_flux
from gridstats.plans.training_table import training_table
from gridstats.session import checkpoint_dir, cut_lineage, file_by_file

catalog.load()


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [(1, "01", "0101", 12e12), (2, "01", "0102", 24e12), (3, "02", "0201", 36e12)]
    df = spark.createDataFrame(rows, "cell int, outer string, inner string, factor double")
    return df.withColumn("factors", F.array_repeat(F.col("factor") / 12, 12))


def test_flat_months_reproduce_the_annual_flux(spark, lookup):
    rows = [(c, y, m, 2.0 * c, 1.0 * c, 4.0 * c) for c in (1, 2, 3) for y in (2000, 2001) for m in range(1, 13)]
    est = spark.createDataFrame(rows, "cell int, year int, month int, estimate double, low double, high double")
    a = {r["outer"]: r.asDict() for r in mean_over_years(annual_flux(est, lookup, ["cell"])).collect()}
    b = {r["outer"]: r.asDict() for r in mean_over_years(monthly_flux(est, lookup, ["cell"]), zero_fill=True).collect()}
    for outer in ("01", "02"):
        for c in ("flux", "estimate", "sigma_block", "sigma_linear"):
            assert a[outer][c] == pytest.approx(b[outer][c])
    # Region 01 by hand: errors 1.5 * 12 and 3 * 24 in different inner regions.
    assert a["01"]["flux"] == pytest.approx(2 * 12 + 4 * 24)
    assert a["01"]["sigma_block"] == pytest.approx(math.hypot(1.5 * 12, 3 * 24))
    assert a["01"]["sigma_linear"] == pytest.approx(1.5 * 12 + 3 * 24)
    total = total_flux(mean_over_years(annual_flux(est, lookup, ["cell"]))).first()
    assert total["flux"] == pytest.approx(24 + 96 + 216)


def test_missing_months_add_nothing(spark, lookup):
    est = spark.createDataFrame([(1, 2000, 1, 5.0), (2, 2000, 1, 5.0), (1, 2000, 2, 5.0)], "cell int, year int, month int, estimate double")
    row = monthly_flux(est, lookup, ["cell"]).where("`outer` = '01'").first()
    assert row["flux"] == pytest.approx(5 * 1 + 5 * 2 + 5 * 1)
    assert row["estimate"] == pytest.approx(15 / 2 / 2)


def test_radii_are_nested_and_cover(spark):
    rng = np.random.default_rng(8)
    noise = rng.normal(size=4000)
    df = spark.createDataFrame([(float(v), i < 2000) for i, v in enumerate(noise)], "e double, cal boolean")
    radii = {r["level"]: r["radius"] for r in conformal_radii(df.where("cal").select(F.abs("e").alias("r")), "r", (0.68, 0.9, 0.95)).collect()}
    assert radii[0.68] <= radii[0.9] <= radii[0.95]
    res = np.abs(noise[:2000])
    assert radii[0.9] == pytest.approx(np.quantile(res, min(math.ceil(2001 * 0.9) / 2000, 1.0)))
    held = df.where("not cal").select(F.exp("e").alias("y"), F.lit(1.0).alias("p"), F.lit(math.exp(-radii[0.9])).alias("lo"), F.lit(math.exp(radii[0.9])).alias("hi"))
    assert coverage(held, "y", "p", "lo", "hi").first()["coverage"] == pytest.approx(0.9, abs=0.03)


def test_splits_keep_groups_whole(spark):
    rng = np.random.default_rng(9)
    rows = [(int(g), float(rng.normal())) for g in range(60) for _ in range(int(rng.integers(1, 9)))] + [(0, 1.0)] * 200
    df = spark.createDataFrame(rows, "g int, y double")
    split = cut_lineage(splits.train_test_groups(df, "g", "y"))
    train, test = split.where("not is_test").select("g").distinct(), split.where("is_test").select("g").distinct()
    assert train.intersect(test).count() == 0 and test.count() == 15 and split.count() == len(rows)
    assert split.where("is_test").select("g").distinct().exceptAll(
        splits.train_test_groups(df, "g", "y").where("is_test").select("g").distinct()).count() == 0
    folds = cut_lineage(splits.group_folds(df, "g", 5))
    assert folds.select("g", "fold").distinct().count() == 60
    assert {r["count"] for r in folds.select("g", "fold").distinct().groupBy("fold").count().collect()} == {12}


def test_smoothing_keeps_the_mass(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(50, 2))], "x double, y double")
    cells = histogram_2d(df, "x", "y", bins=20)
    assert cells.agg(F.sum("n")).first()[0] == 50
    assert smooth_lattice(cells, bins=20).agg(F.sum("density")).first()[0] == pytest.approx(50)


def test_training_table(spark):
    weather = ["t2m", "sp"]
    daily, monthly, land, chem = [], [], [], []
    for i in range(40):
        key = (1000.0 + i, f"2001-0{i % 9 + 1}-10", f"USGS-{i % 4}", 10 + i, 20 + i)
        daily.append((*key, "Well" if i != 3 else "Well: Hyporheic-zone well", "1010101", 1, 280.0 + i, 1000.0 + i % 20, 7.0, 100.0, 12.0))
        monthly.append((*key, 270.0 + i))
        land.append((*key, 0.5 * i))
    for d, w in {(r[1], r[2]) for r in daily}:
        y, m, day = d.split("-")
        chem.append((f"{int(m)}/{int(day)}/{y[2:]}", w, 1e-3))
    keys = "CO2_ppm double, Date string, MonitoringLocation string, PFAF_ID bigint, HYBAS_ID bigint"
    table = training_table(
        spark.createDataFrame(daily, keys + ", siteType string, HUC8 string, season int, t2m double, sp double, ResultMeasure_pH double, `Alkalinity_mg.L.CaCO3` double, ResultMeasure_tempC double"),
        spark.createDataFrame(monthly, keys + ", t2m double"), spark.createDataFrame(land, keys + ", ESoil double"),
        spark.createDataFrame(chem, "Date string, MonitoringLocation string, molality_CO2 double"), weather, weather, ["Date", "MonitoringLocation"])
    rows = table.collect()
    assert 30 <= len(rows) <= 39 and {r["HUC2"] for r in rows} == {"01"}
    assert {"t2m_month", "ESoil", "CO2_aq"} <= set(table.columns)
    assert all(r["CO2_aq"] == pytest.approx(1e-3 / (1 + 1e-3 * 0.04401)) for r in rows)
    assert not any("Hyporheic" in r["siteType"] for r in rows)


@pytest.fixture(scope="module")
def learnable(spark):
    """Groups with a target that the features explain but for noise; some gaps, one useless column."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        a, b, kind = rng.uniform(0, 10), rng.lognormal(0, 1), ["x", "y", "z"][i % 3]
        y = math.exp(0.3 * a + (2.0 if kind == "x" else 0.0) + rng.normal(0, 0.2))
        rows.append((i % 60, float(a) if i % 10 else None, float(b), kind, y))
    return cut_lineage(boosting.log_target(spark.createDataFrame(rows, "g int, a double, b double, kind string, y double"), "y"))


def test_models_learn_and_cover(spark, learnable):
    config = boosting.BoostingConfig(trees=10, depth=4, rate=0.3)
    split = cut_lineage(splits.train_test_groups(learnable, "g", "log_target"))
    train, test = split.where("not is_test"), split.where("is_test")
    fitted = boosting.fit_features(train, ["a", "b"], {"kind": "target"}, "log_target")
    ready = cut_lineage(fitted.apply(train))
    groups = splits.train_fit_calibration_groups(splits.stratified_groups(train, "g", "log_target"), "g").select("g", "is_calibration")
    marked = cut_lineage(ready.join(groups, "g"))
    model, radii = boosting.fit_with_intervals(marked.where("not is_calibration"), marked.where("is_calibration"), fitted.names, "log_target", (0.68, 0.9), config)
    scored = cut_lineage(boosting.score_with_intervals(model, fitted.apply(test), fitted.names, radii, (0.68, 0.9)))
    assert skill_metrics(scored, "y", "predicted").first()["r2"] > 0.6
    assert coverage(scored, "y", "predicted", "lower_90", "upper_90").first()["coverage"] == pytest.approx(0.9, abs=0.1)
    results = boosting.ablate(train, test, ["a", "b"], {"kind": "target"}, "log_target", {"no_a": ["a"]}, config, group="g", k=2)
    rows = {r["condition"]: r for r in results.collect()}
    assert rows["no_a"]["r2"] < rows["FULL"]["r2"] - 0.2 and rows["no_a"]["cv_r2_mean"] < rows["FULL"]["cv_r2_mean"]
    assert rows["FULL"]["train_r2"] > 0.6 and rows["FULL"]["n_groups"] == test.select("g").distinct().count()
    assert rows["FULL"]["group_r2_p25"] <= rows["FULL"]["group_r2_median"] <= rows["FULL"]["group_r2_p75"]
    kept, trail, refitted = boosting.eliminate_features(cut_lineage(splits.group_folds(ready, "g", 2)), fitted.names, "log_target", 2,
                                              boosting.BoostingConfig(trees=2, depth=3, rate=0.5), step=1, minimum=2)
    assert "a" in kept and trail.where("selected").count() == 1 and refitted.numFeatures == len(kept)


def test_encodings_and_gaps(spark, tmp_path):
    rows = [(i, float(i % 7) if i % 10 < 4 else None, float(i), ["b", None, "a", "z"][i % 4], float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, a double, b double, kind string, y double")
    with pytest.raises(ValueError, match="unknown encodings"):
        boosting.fit_features(df, ["a", "b"], {"kind": "other"}, "y")
    fitted = boosting.fit_features(df, ["a", "b"], {"kind": "onehot"}, "y")
    assert fitted.donors is not None and fitted.widths == {"kind_encoded": 3}
    filled = {r["id"]: r["a"] for r in fitted.fill(df).collect()}
    have = [(r[0], r[1], r[2]) for r in rows if r[1] is not None]
    for i, a, b, *_ in rows:
        if a is None:
            near = sorted((abs(x - b), n, v) for n, v, x in have)[:5]
            want = sum(v / d for d, _, v in near) / sum(1 / d for d, _, _ in near)
            assert filled[i] == pytest.approx(want) or near[4][0] == sorted(abs(x - b) for _, _, x in have)[5]
        else:
            assert filled[i] == a
    # Sorted categories are Missing, a, b, z; the first one and unknown ones are all zero.
    more = df.limit(0).unionByName(spark.createDataFrame([(1, 1.0, 1.0, k, 1.0) for k in (None, "a", "b", "z", "new")], df.schema))
    got = {r["kind"]: r["kind_encoded"].toArray().tolist() for r in fitted.apply(more).collect()}
    assert got == {None: [0, 0, 0], "a": [1, 0, 0], "b": [0, 1, 0], "z": [0, 0, 1], "new": [0, 0, 0]}
    fitted.save(str(tmp_path / "fit"))
    again = boosting.FittedFeatures.load(spark, str(tmp_path / "fit"))
    assert again.names == fitted.names
    assert sorted(map(str, again.apply(df).collect())) == sorted(map(str, fitted.apply(df).collect()))
    model = boosting.fit_boosted(fitted.apply(df), fitted.names, "y", boosting.BoostingConfig(trees=2, depth=2))
    shares = dict(boosting.importances(model, fitted.names, fitted.widths))
    assert set(shares) == {"a", "b", "kind_encoded"} and sum(shares.values()) == pytest.approx(1.0)


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_category_tables_have_a_known_size(spark):
    """Rows are not dealt out by their category: a small table of codes is broadcast to them."""
    from gridstats.operators import boosting
    train = spark.range(400).selectExpr("id", "double(id % 7) as x", "if(id % 50 = 0, 'b', 'a') as kind", "string(id % 3) as sort", "double(id % 5) as y")
    fitted = boosting.fit_features(train, ["x"], {"kind": "target", "sort": "onehot"}, "y")
    plan = fitted.apply(train)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2 and fitted.apply(train).count() == 400


def test_fit_spreads_large_partitions(spark, monkeypatch):
    from gridstats.operators import boosting
    rows = boosting.assemble(spark.range(1000).coalesce(1).selectExpr("double(id) as x", "double(id % 9) as y"), ["x"])
    assert boosting.spread(rows).rdd.getNumPartitions() == 1
    monkeypatch.setattr(boosting, "TASK_BYTES", 408 * 100)
    spread = boosting.spread(rows)
    assert spread.rdd.getNumPartitions() == 10 and sorted(r["x"] for r in spread.collect()) == [float(i) for i in range(1000)]
    assert boosting.spread(rows.limit(0)).count() == 0


def test_vectors_come_in_files_of_a_task(spark, monkeypatch):
    """a fit reads stored vectors file by file, without a shuffle to spread them."""
    monkeypatch.setattr(boosting, "TASK_BYTES", 100 * (8 * 1 + 400))
    vectors = boosting.stored_vectors(spark.range(0, 1000, 1, 2).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y")), ["x"], [], "y")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with file_by_file(spark):
        rows = boosting.spread(vectors)
        assert max(rows.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 100
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before and vectors.count() == 1000


def test_a_condition_takes_its_part_of_one_fit(spark, monkeypatch):
    """columns are fitted one by one, so a part of one fit is the fit of that part; medians are for skewed columns only (F6)."""
    rows = cut_lineage(spark.range(400).select((F.col("id") % 20).alias("g"), (F.col("id") % 7).cast("double").alias("a"), F.exp(F.col("id") % 13).alias("b"),
                                               F.when(F.col("id") % 5 > 0, F.col("id") % 11).cast("double").alias("c"), (F.col("id") % 4).cast("string").alias("kind"),
                                               F.concat(F.lit("k"), F.col("id") % 3).alias("other"), (F.col("id") % 17 / 10.0).alias("y")))
    asked, inner = [], features.feature_quantiles
    monkeypatch.setattr(features, "feature_quantiles", lambda df, names, probs, keys=(): asked.append((list(names), len(probs))) or inner(df, names, probs, keys))
    whole = boosting.fit_features(rows, ["a", "b", "c"], {"kind": "target", "other": "onehot"}, "y")
    assert asked == [(["b"], 1), (["a", "b", "c"], 3)]
    part, again = whole.without(["a", "kind"]), boosting.fit_features(rows, ["b", "c"], {"other": "onehot"}, "y")
    assert part.names == again.names and part.widths == again.widths
    assert part.fills.collect() == again.fills.collect() and part.scaling.collect() == again.scaling.collect()


def test_a_fit_writes_crowded_rows_once(spark, monkeypatch):
    """F8, F9: rows that crowd a task are written in files of a task; jobs of a fit do not shuffle them again and again."""
    rows = boosting.assemble(spark.range(1000).coalesce(1).selectExpr("double(id) as x", "double(id % 9) as y"), ["x"])
    assert boosting.in_task_files(rows) is rows and boosting.in_task_files(rows.limit(0)).count() == 0
    monkeypatch.setattr(boosting, "TASK_BYTES", 408 * 100)
    with file_by_file(spark):
        held = boosting.in_task_files(rows)
        assert held.rdd.getNumPartitions() == 10 and sorted(r["x"] for r in held.collect()) == [float(i) for i in range(1000)]
        assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()


def test_elimination_refits_on_slices_of_one_vector(spark, monkeypatch):
    """F8: one vector is written for all fits, the refit with ``always`` included, whose vector columns keep all their slots."""
    rows = spark.range(600).select((F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                   F.concat(F.lit("k"), F.col("id") % 4).alias("kind"), (F.col("id") % 7 + F.col("id") % 4).cast("double").alias("y"))
    rows = cut_lineage(rows)
    ready = boosting.fit_features(rows, ["a", "b"], {"kind": "onehot"}, "y").apply(rows)
    written, inner = [], boosting.stored_vectors
    monkeypatch.setattr(boosting, "stored_vectors", lambda *args: written.append(args[1]) or inner(*args))
    kept, _, model = boosting.eliminate_features(ready, ["a", "b"], "y", 2, boosting.BoostingConfig(trees=2, depth=2), always=["kind_encoded"], step=1, minimum=1)
    assert written == [["a", "b", "kind_encoded"]] and model.numFeatures == len(kept) + 3


def test_incremental_scoring_joins_the_lines_once(spark, monkeypatch):
    """the model and both portions read one stored join of lines and parts."""
    from gridstats.catalog import models
    asked, inner = [], models.lines
    monkeypatch.setattr(models, "lines", lambda t: asked.append(t) or inner(t))
    rows = catalog.QUERIES["incremental_model_scoring"](spark, "/root/testdata/sf0.001").collect()
    assert len(asked) == 1 and all(r["bounds_hold"] for r in rows)
