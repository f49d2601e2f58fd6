"""Deep forests: against Spark's own fit of the same estimator, in groups and above them."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlark.operators import forest as T
from ledgerlark.operators import ml as M

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    """Few values per feature, so that both fits cut at the same places; classes with noise, so that trees grow deep."""
    df = spark.range(0, 4000, 1, 4).select("id", *[F.floor(F.rand(k) * (9 + 5 * k)).cast("double").alias(c) for k, c in enumerate(FEATURES)])
    return df.withColumn("label", (F.col("a") + F.col("b") * F.col("c") / 9 + 8 * F.rand(9) > 14).cast("double")).cache()


def probabilities(model, rows):
    got = model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).toPandas().sort_values("id")
    return got["p"].to_numpy()


@pytest.mark.parametrize("group", [1 << 14, 300])
@pytest.mark.parametrize("depth", [16, 30])
def test_one_tree_of_all_rows_and_features_is_the_one_that_spark_fits(spark, rows, group, depth, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "GROUP", group)
    est = RandomForestClassifier(numTrees=1, maxDepth=depth, featureSubsetStrategy="all", bootstrap=False, seed=1, labelCol="label")
    called = []
    monkeypatch.setattr(M, "fit_forest", lambda *a: called.append(1) or T.fit_forest(*a))
    own, other = M.fit(rows, FEATURES, est), Pipeline(stages=[M.assembler(FEATURES), est]).fit(rows)
    assert called  # grown to the end by groups, not by Spark's level jobs
    a, b = own.stages[-1], other.stages[-1]
    assert abs(a.totalNumNodes - b.totalNumNodes) <= 0.02 * b.totalNumNodes and a.numFeatures == 4 and a.getMaxDepth() == depth  # equal gains may be cut elsewhere
    p, q = probabilities(own, rows), probabilities(other, rows)
    assert (np.abs(p - q) < 1e-9).mean() > 0.98
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), atol=0.02)
    own.write().overwrite().save(str(tmp_path / "m"))
    assert np.array_equal(probabilities(M.PipelineModel.load(str(tmp_path / "m")), rows), p)


def test_a_forest_agrees_with_sparks_and_with_its_reruns_in_batches(spark, rows, monkeypatch):
    est = RandomForestClassifier(numTrees=40, maxDepth=30, seed=1, labelCol="label")
    train, test = rows.filter("id % 4 != 0"), rows.filter("id % 4 = 0")
    monkeypatch.setattr(T, "GROUP", 500)
    one = M.fit(train, FEATURES, est)
    other = Pipeline(stages=[M.assembler(FEATURES), est]).fit(train)
    p, q = probabilities(one, test), probabilities(other, test)
    y = test.orderBy("id").select("label").toPandas()["label"].to_numpy()
    assert abs(((p > 0.5) == y).mean() - ((q > 0.5) == y).mean()) < 0.04 and np.corrcoef(p, q)[0, 1] > 0.95
    assert 0.85 < one.stages[-1].totalNumNodes / other.stages[-1].totalNumNodes < 1.15
    monkeypatch.setattr(T, "COPIES", 20_000)  # six trees a batch
    assert np.array_equal(probabilities(M.fit(train, FEATURES, est), test), p)


@pytest.mark.parametrize("group", [1 << 14, 20])
def test_one_class_and_missing_values(spark, rows, group, monkeypatch):
    monkeypatch.setattr(T, "GROUP", group)
    est = RandomForestClassifier(numTrees=3, maxDepth=20, seed=1, labelCol="label")
    one = rows.withColumn("label", F.lit(1.0)).limit(50)
    assert (probabilities(M.fit(one, FEATURES, est), one) == 1.0).all()
    with pytest.raises(Exception, match="finite"):
        M.fit(rows.withColumn("a", F.when(F.col("id") % 11 != 0, F.col("a"))), FEATURES, est)


@pytest.mark.parametrize("group", [1 << 14, 300])
def test_one_weighted_tree_is_the_one_that_spark_fits(spark, rows, group, monkeypatch):
    monkeypatch.setattr(T, "GROUP", group)
    weighted = rows.withColumn("w", F.when(F.col("label") == 1, 1.75).otherwise(0.625))  # whole numbers of the unit
    est = RandomForestClassifier(numTrees=1, maxDepth=10, minInstancesPerNode=20, featureSubsetStrategy="all", bootstrap=False, seed=1, labelCol="label", weightCol="w")
    own, other = M.fit(weighted, FEATURES, est), Pipeline(stages=[M.assembler(FEATURES), est]).fit(weighted)
    assert isinstance(own.stages[-1], T.StoredForest) and abs(own.stages[-1].totalNumNodes - other.stages[-1].totalNumNodes) <= 0.02 * other.stages[-1].totalNumNodes
    p, q = probabilities(own, weighted), probabilities(other, weighted)
    assert (np.abs(p - q) < 1e-9).mean() > 0.98


def test_rows_are_scored_and_importances_found_without_sparks_model(spark, rows, monkeypatch, tmp_path):
    est = RandomForestClassifier(numTrees=9, maxDepth=12, seed=1, labelCol="label")
    M.fit(rows, FEATURES, est).write().overwrite().save(str(tmp_path / "m"))
    model = M.PipelineModel.load(str(tmp_path / "m"))
    other = M.PipelineModel([model.stages[0], T.RandomForestClassificationModel.load(f"{tmp_path}/m/stages/1_{model.stages[1].uid}/forest")])
    holed = rows.withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a")))  # a missing value goes right
    expected = other.transform(holed).select("id", "rawPrediction", "probability", "prediction").toPandas().sort_values("id")
    monkeypatch.setattr(T.RandomForestClassificationModel, "load", None)
    got = model.transform(holed).select("id", "rawPrediction", "probability", "prediction").toPandas().sort_values("id")
    for c in ("rawPrediction", "probability"):
        assert np.allclose(np.stack([v.toArray() for v in got[c]]), np.stack([v.toArray() for v in expected[c]]), atol=1e-9)
    assert (got["prediction"].to_numpy() == expected["prediction"].to_numpy()).all()
    assert np.allclose(model.stages[-1].featureImportances.toArray(), other.stages[-1].featureImportances.toArray(), atol=1e-9)
    assert model.transform(rows.filter("false")).count() == 0


def test_splits_found_by_tables_and_by_sorting_are_the_same():
    rng = np.random.default_rng(3)
    x, y, w = rng.integers(0, 32, (3000, 6)).astype(np.uint8), rng.integers(0, 2, 3000), rng.integers(1, 4, 3000)
    for c, times in ((w, None), (w * rng.integers(1, 1000, 3000), w)):
        own = rng.integers(0, 40, 3000)
        sub = T._subset([1], 40, 6, 3)
        n, p = np.bincount(own, c, 40), np.bincount(own, c * y, 40)
        both = [f(T._cells(x, np.arange(3000), own, sub, 32), (40, 3, 32), c, c * y, times, n, p, 5) for f in (T._best_of_tables, T._best_of_sorted)]
        assert all(np.array_equal(a, b) for a, b in zip(*both)) and (both[0][2] > 0).all()
