import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gridstats.operators import boosting, splits, trees
from gridstats.session import cut_lineage


def few_values(spark, n=900):
    """Features of few values, so that all split points are the same for any learner."""
    id_ = F.col("id")
    x = [(id_ % 7).cast("double"), (F.floor(id_ / 7) % 11).cast("double"), F.when(id_ % 5 == 0, -1.5).otherwise(0.0)]
    rows = spark.range(0, n, 1, 5).select((id_ % 30).alias("g"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    # A column that no split explains keeps gains of different splits apart.
    return cut_lineage(rows.withColumn("y", F.exp(F.col("x0") / 4) + F.col("x1") * (F.col("x2") + 2.1) + F.pmod(F.xxhash64("g", "x0", "x1"), F.lit(97)) / 50.0))


def test_trees_are_those_of_spark(spark, monkeypatch):
    """F2 to F4: the same trees as Spark's, from blocks of any size, for dense and sparse vectors and more trees than are kept at once."""
    rows = few_values(spark)
    names = ["x0", "x1", "x2"]
    # Slots beyond 0.0 make the vectors sparse.
    vectors = boosting.assemble(rows.withColumns({f"z{i}": F.lit(0.0) for i in range(9)}), [*names, *[f"z{i}" for i in range(9)]]).select("features", "y")
    assert "(12," in str([r["features"] for r in vectors.collect()])
    for held, block in ((10, 1 << 15), (2, 50)):
        monkeypatch.setattr(trees, "HELD_TREES", held)
        monkeypatch.setattr(trees, "BLOCK_ROWS", block)
        estimator = GBTRegressor(featuresCol="features", labelCol="y", maxIter=5, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, seed=3)
        want, fit = estimator.fit(vectors), trees.fit_trees(boosting.packed_vectors(vectors, "y"), estimator)
        both = fit.model.transform(want.transform(vectors).withColumnRenamed("prediction", "want")).select("want", "prediction").collect()
        assert [r["prediction"] for r in both] == pytest.approx([r["want"] for r in both])
        assert fit.model.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray())
        assert [t.numNodes for t in fit.model.trees] == [t.numNodes for t in want.trees] and fit.model.treeWeights == want.treeWeights
        seen = fit.predicted(trees.packed(rows.withColumns({f"z{i}": F.lit(0.0) for i in range(9)}), [*names, *[f"z{i}" for i in range(9)]], "y", ["g"]), "y").collect()
        assert sorted(r["log_prediction"] for r in seen) == pytest.approx(sorted(r["want"] for r in both)) and {r["g"] for r in seen} == set(range(30))


def test_sums_are_merged_before_they_come_to_the_driver(spark, monkeypatch):
    estimator = GBTRegressor(featuresCol="features", labelCol="y", maxIter=2, maxDepth=3, subsamplingRate=0.7, seed=3)
    rows = trees.packed(few_values(spark), ["x0", "x1", "x2"], "y")
    whole = trees.fit_trees(rows, estimator)
    monkeypatch.setattr(trees, "COLLECTED", 0)
    assert trees.fit_trees(rows, estimator).model.toDebugString.split("\n")[1:] == whole.model.toDebugString.split("\n")[1:]


def test_split_points_follow_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=20_000)
    rows = spark.createDataFrame([(float(v), 0.0) for v in x], "x double, y double").repartition(7)
    points, = trees.fit_split_points(trees.packed(rows, ["x"], "y"), [0], None)
    assert len(points) == 31
    # As many rows between two points as between any others, to the grain of the thinned values.
    assert np.histogram(x, [-np.inf, *points, np.inf])[0] == pytest.approx(np.full(32, len(x) / 32), rel=0.15)
    with pytest.raises(Exception, match="must be numbers"):
        trees.packed(rows.withColumn("x", F.when(F.col("x") < 1, F.col("x"))), ["x"], "y")
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit_packed(trees.packed(rows.limit(0), ["x"], "y"), "y", boosting.BoostingConfig(trees=1, depth=1))


def test_large_single_fits_are_packed(spark, monkeypatch):
    """a fit to more rows than memory should keep as objects reads blocks."""
    rows, config = few_values(spark), boosting.BoostingConfig(trees=2, depth=2, subsample=1.0)
    held = boosting.fit_boosted(rows, ["x0", "x1"], "y", config)
    monkeypatch.setattr(boosting, "HELD_ROWS", 100)
    monkeypatch.setattr(GBTRegressor, "fit", lambda *args: pytest.fail("Spark's fit keeps every row"))
    read = boosting.fit_boosted(rows, ["x0", "x1"], "y", config)
    assert read.featureImportances.toArray() == pytest.approx(held.featureImportances.toArray())


def test_folds_read_rows_that_are_packed_once(spark, monkeypatch):
    """rows are packed once for all folds, and no fit keeps them as objects."""
    rows = cut_lineage(splits.group_folds(few_values(spark), "g", 3))
    made, inner = [], boosting.packed
    monkeypatch.setattr(boosting, "packed", lambda *args: made.append(args[1]) or inner(*args))
    monkeypatch.setattr(GBTRegressor, "fit", lambda *args: pytest.fail("Spark's fit keeps every row"))
    metrics, imps = boosting.cross_validate(rows, ["x0", "x1", "x2"], "y", "g", 3, boosting.BoostingConfig(trees=3, depth=3, rate=0.3))
    assert made == [["x0", "x1", "x2"]] and sum(r["n_samples"] for r in metrics.collect()) == 900
    assert {r["fold"]: r["total"] for r in imps.groupBy("fold").agg(F.sum("importance").alias("total")).collect()} == pytest.approx({0: 1, 1: 1, 2: 1})
