"""Tree contributions: against enumeration of all feature subsets, and as a split of the models' own scores."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from ledgerlark.operators import ml as M
from ledgerlark.operators import trees as T

FEATURES = ["a", "b", "c", "d", "e"]


def random_trees(seed, depth, features, trees=3):
    """Node rows of complete random trees; some nodes have no training rows at all."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(trees):
        todo, own = [(0, 0, float(rng.integers(50, 100)))], {}
        made = 1
        while todo:
            at, level, count = todo.pop()
            if level == depth or count < 2:
                own[at] = (t, at, -1, -1, -1, 0.0, count, float(rng.normal()))
                continue
            left = float(rng.integers(0 if rng.random() < 0.1 else 1, int(count)))
            own[at] = (t, at, made, made + 1, int(rng.integers(features)), float(rng.integers(0, 4)), count, 0.0)
            todo += [(made, level + 1, left), (made + 1, level + 1, count - left)]
            made += 2
        rows += [own[k] for k in sorted(own)]
    return pd.DataFrame(rows, columns=["tree", "node", "left", "right", "feature", "threshold", "count", "value"])


def expected(nodes, x, known):
    """Mean leaf value where only the features in ``known`` are looked at."""
    total = 0.0
    for _, t in nodes.groupby("tree"):
        t = t.set_index("node")

        def walk(at):
            n = t.loc[at]
            if n["left"] < 0:
                return n["value"]
            if n["feature"] in known:
                return walk(n["left"] if x[int(n["feature"])] <= n["threshold"] else n["right"])
            parts = [(t.loc[c]["count"], c) for c in (n["left"], n["right"]) if t.loc[c]["count"] > 0]
            return sum(w * walk(c) for w, c in parts) / n["count"]

        total += walk(0)
    return total


def enumerated(nodes, x, features):
    out = []
    for i in range(features):
        others = [j for j in range(features) if j != i]
        out.append(sum(factorial(k) * factorial(features - 1 - k) / factorial(features) * (expected(nodes, x, {*s, i}) - expected(nodes, x, set(s)))
                       for k in range(features) for s in combinations(others, k)))
    return np.array(out)


@pytest.mark.parametrize("tabled", [8, 0])
def test_contributions_equal_the_enumeration_of_subsets(monkeypatch, tabled):
    monkeypatch.setattr(T, "TABLED", tabled)
    rng = np.random.default_rng(5)
    for seed, depth in ((1, 2), (2, 4), (3, 5)):
        nodes = random_trees(seed, depth, 4)
        found = T.Ensemble(nodes)
        assert np.isclose(found.base, expected(nodes, None, set()))
        for x in rng.integers(0, 5, (6, 4)).astype(float):
            reached = [expected(nodes, x, set(range(4)))]
            given = found.contributions(x[None, :])[0]
            if all(np.isfinite(reached)):
                assert np.allclose(given, enumerated(nodes, x, 4)), (seed, x)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select("id", *[(F.rand(k) * 4).alias(c) for k, c in enumerate(FEATURES)])
    df = df.withColumn("label", ((F.col("a") + F.col("b") * F.col("c") > 5) | (F.col("d") > 3.5)).cast("double"))
    return df.cache()


def scored(model, rows):
    out = model.transform(rows)
    kind = type(model.stages[-1]).__name__
    from pyspark.ml.functions import vector_to_array
    if kind == "GBTClassificationModel":  # log-odds are twice the margin
        return out.select("id", (2 * vector_to_array("rawPrediction")[1]).alias("score"))
    if kind.endswith("RegressionModel"):
        return out.select("id", F.col("prediction").alias("score"))
    return out.select("id", vector_to_array("probability")[1].alias("score"))


ESTIMATORS = {
    "boosted classifier": lambda: GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.3, seed=1, labelCol="label"),
    "boosted regressor": lambda: GBTRegressor(maxIter=3, maxDepth=3, seed=1, labelCol="label"),
    "forest": lambda: RandomForestClassifier(numTrees=4, maxDepth=6, seed=1, labelCol="label"),
    "tree": lambda: DecisionTreeClassifier(maxDepth=9, labelCol="label"),
}


@pytest.mark.parametrize("kind", ESTIMATORS)
def test_contributions_and_base_are_the_models_score(spark, rows, kind):
    model = M.fit(rows, FEATURES, ESTIMATORS[kind]())
    ensemble = T.Ensemble(T.node_table(model, spark))
    steps = T.tree_waterfall(rows, "id", FEATURES, ensemble, max_features=3)
    by_row = steps.groupBy("id").agg(F.min("base").alias("base"), F.sum("contribution").alias("given"), F.max_by("end", "step").alias("last"), F.count("*").alias("n"),
                                     F.count("feature").alias("named"), F.min_by("start", "step").alias("first"))
    got = by_row.join(scored(model, rows), "id").toPandas()
    assert len(got) == 400 and (got["n"] == 4).all() and (got["named"] == 3).all()
    assert np.allclose(got["base"] + got["given"], got["score"], atol=1e-9)
    assert np.allclose(got["last"], got["score"], atol=1e-9) and np.allclose(got["first"], got["base"], atol=1e-9)


def test_steps_are_ordered_and_joined(spark, rows):
    model = M.fit(rows, FEATURES, GBTClassifier(maxIter=3, maxDepth=3, seed=1, labelCol="label"))
    ensemble = T.Ensemble(T.node_table(model, spark))
    steps = T.tree_waterfall(rows, "id", FEATURES, ensemble).toPandas().sort_values(["id", "step"])
    assert steps["feature"].notna().all() and (steps.groupby("id").size() == len(FEATURES)).all()
    for _, one in steps.groupby("id"):
        size = one["contribution"].abs().to_numpy()
        assert (size[:-1] >= size[1:] - 1e-15).all()
        assert np.allclose(one["start"].to_numpy()[1:], one["end"].to_numpy()[:-1])


def test_rows_with_missing_values_and_no_rows(spark, rows):
    model = M.fit(rows, FEATURES, GBTClassifier(maxIter=3, maxDepth=3, seed=1, labelCol="label"))
    ensemble = T.Ensemble(T.node_table(model, spark))
    holed = rows.limit(20).withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")))
    got = T.tree_waterfall(holed, "id", FEATURES, ensemble).groupBy("id").agg((F.sum("contribution") + F.min("base")).alias("sum")).join(scored(model, holed.withColumn("a", F.coalesce("a", F.lit(float("nan"))))), "id").toPandas()
    assert len(got) == 20 and np.allclose(got["sum"], got["score"], atol=1e-9)
    assert T.tree_waterfall(rows.filter("false"), "id", FEATURES, ensemble).count() == 0


def test_parts_of_trees_and_long_paths_add_up(monkeypatch):
    monkeypatch.setattr(T, "ROWS", 4)  # several blocks of rows
    nodes = random_trees(7, 6, 4)
    x = np.random.default_rng(2).integers(0, 5, (10, 4)).astype(float)
    x[3, 1] = np.nan  # goes right everywhere
    monkeypatch.setattr(T, "TABLED", 0)
    alone = T.Ensemble(nodes)
    one_by_one = alone.contributions(x)
    monkeypatch.setattr(T, "TABLED", 5)
    found = T.Ensemble(nodes)
    assert not alone.parts and found.parts and found.paths and max(len(p.splits) for p in found.parts) <= 5
    assert sum(len(p.leaves) for p in found.parts) + sum(len(p.value) for p in found.paths) == sum(len(p.value) for p in alone.paths)
    assert np.allclose(found.contributions(x), one_by_one, atol=1e-12) and np.isclose(found.base, alone.base)
