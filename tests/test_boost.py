"""Boosted trees: against Spark's own fit of the same estimator, and the jobs that a fit takes."""

import uuid

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlark.operators import boost as B
from ledgerlark.operators import ml as M

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Few values per feature, so that both fits cut at the same places; two weights."""
    df = spark.range(0, 6000, 1, 4).select("id", *[F.floor(F.rand(k) * (7 + 5 * k)).cast("double").alias(c) for k, c in enumerate(FEATURES)])
    df = df.withColumn("label", (F.col("a") + F.col("b") * F.col("c") / 9 + 4 * F.rand(9) > 10).cast("double"))
    return df.withColumn("w", F.when(F.col("label") == 1, 1.75).otherwise(0.5)).cache()


def probabilities(model, rows):
    got = model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).toPandas().sort_values("id")
    return got["p"].to_numpy()


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("renew", [50, 3])
def test_the_model_is_the_one_that_spark_fits(spark, rows, weight, renew, monkeypatch, tmp_path):
    monkeypatch.setattr(B, "RENEW", renew)
    est = GBTClassifier(maxIter=8, maxDepth=4, stepSize=0.3, seed=1, labelCol="label", featuresCol="features")
    if weight:
        est.setWeightCol(weight)
    own, other = M.fit(rows, FEATURES, est), Pipeline(stages=[M.assembler(FEATURES), est]).fit(rows)
    assert np.allclose(probabilities(own, rows), probabilities(other, rows), atol=1e-6)
    a, b = own.stages[-1], other.stages[-1]
    assert a.treeWeights == b.treeWeights and a.numFeatures == b.numFeatures and a.getMaxIter() == 8 and a.getMaxDepth() == 4
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), atol=1e-6)
    own.write().overwrite().save(str(tmp_path / "m"))
    assert np.allclose(probabilities(M.PipelineModel.load(str(tmp_path / "m")), rows), probabilities(own, rows))


def test_a_round_takes_a_job_for_every_level_and_reruns_agree(spark, rows):
    est = GBTClassifier(maxIter=30, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=1, labelCol="label")
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "fit")
    one = M.fit(rows, FEATURES, est)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(uuid.uuid4().hex, "rest")
    assert jobs <= 30 * 3 + 30, jobs
    assert np.array_equal(probabilities(one, rows), probabilities(M.fit(rows, FEATURES, est), rows))
    y = rows.orderBy("id").select("label").toPandas()["label"].to_numpy()
    assert ((probabilities(one, rows) > 0.5) == (y == 1)).mean() > 0.8


def test_one_class_and_missing_values(spark, rows):
    one = rows.withColumn("c", F.lit(2.0)).withColumn("label", F.lit(1.0)).limit(50)
    model = M.fit(one, FEATURES, GBTClassifier(maxIter=3, maxDepth=3, labelCol="label"))
    assert (probabilities(model, one) > 0.85).all()
    with pytest.raises(Exception, match="finite"):
        M.fit(rows.withColumn("a", F.when(F.col("id") % 11 != 0, F.col("a"))), FEATURES, GBTClassifier(maxIter=2, labelCol="label"))


def test_cut_points_of_many_values_are_quantiles():
    x = np.random.default_rng(0).normal(size=(20_000, 1))
    cut = B.cut_points(x, 32)[0]
    assert len(cut) == 31 and np.allclose(np.diff([0, *(x[:, 0][:, None] <= cut).mean(axis=0), 1]), 1 / 32, atol=2e-3)


def test_rows_parted_by_node_are_where_a_walk_down_the_tree_takes_them():
    rng, width, depth = np.random.default_rng(4), 8, 4
    bins = rng.integers(0, width, (3, 500))
    keys = np.stack([bins[0] * width + bins[1], bins[2] * width]).astype(np.uint16)
    block = B.Block(keys, np.ones(500, np.int8), None, np.zeros(500), np.ones(500, bool))
    tree = B.Tree.empty(depth)
    for at in (0, 1, 2, 3, 5, 6, 7, 11, 13):  # node 4 and others end early
        tree.feature[at], tree.cut[at] = rng.integers(0, 3), rng.integers(1, 6)
    walked = np.zeros(500, int)
    for _ in range(depth):
        f = tree.feature[walked]
        walked = np.where(f < 0, walked, 2 * walked + 1 + (bins[f, np.arange(500)] > tree.cut[walked]))
    assert np.array_equal(block.nodes(tree, depth, width), walked)
    some, wanted = np.flatnonzero(rng.random(500) < 0.6), np.unique(walked)[::2]
    found = dict(block.reached(tree, depth, width, some, wanted))
    for place in wanted:
        assert np.array_equal(found[place], some[walked[some] == place])
