"""The autoencoder: gradients by differences, falling losses, equal reruns on any partitioning, planted outliers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import anomaly as N
from ledgerlark.operators import autoencoder as AE
from ledgerlark.operators import ml as M
from ledgerlark.operators import passes

COLS = ["x0", "x1", "x2", "x3"]


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    sizes = [4, 2, 2, 4]
    x, flat = rng.normal(size=(9, 4)), AE._start(sizes, 3)
    loss, grad = AE.terms(x, flat, sizes)
    for k in range(len(flat)):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        up, down = AE.terms(x, flat + step, sizes)[0], AE.terms(x, flat - step, sizes)[0]
        assert np.allclose((up - down) / 2e-6, grad[:, k], atol=1e-5), k


@pytest.fixture(scope="module")
def deposits(spark):
    """Rows on a plane and one far from it."""
    rng = np.random.default_rng(7)
    flat = rng.normal(size=(600, 2))
    x = np.column_stack([flat, flat.sum(axis=1), flat[:, 0] - flat[:, 1]]) + 0.05 * rng.normal(size=(600, 4))
    x[0] = [6.0, -6.0, 9.0, -9.0]
    df = spark.createDataFrame([(int(k), *map(float, r)) for k, r in enumerate(x)], "id long, x0 double, x1 double, x2 double, x3 double")
    return M.standard_scale(df, COLS)


@pytest.fixture(scope="module")
def fitted(deposits):
    return AE.fit(deposits, COLS, passes=80)


def test_loss_falls_and_reruns_agree_on_any_partitioning(spark, deposits, fitted, monkeypatch):
    assert fitted.losses == sorted(fitted.losses, reverse=True) and fitted.losses[-1] < 0.7 * fitted.losses[0]
    monkeypatch.setattr(AE, "few_tasks", lambda df: df)
    monkeypatch.setattr(passes, "PARTS", 1)  # sums added up by Spark
    again = AE.fit(deposits.repartition(5, "x1"), COLS, passes=80)
    assert again.losses == fitted.losses
    assert all((a == b).all() for a, b in zip([*again.weights, *again.offsets], [*fitted.weights, *fitted.offsets]))


def test_error_is_the_networks_and_the_planted_outlier_stands_out(deposits, fitted):
    scored = AE.reconstruction_error(deposits, COLS, fitted).select("id", "reconstruction_error", *COLS).orderBy("id").toPandas()
    sizes = [4, 2, 2, 4]
    flat = np.concatenate([np.concatenate([w.ravel(), b]) for w, b in zip(fitted.weights, fitted.offsets)])
    loss, _ = AE.terms(scored[COLS].to_numpy(), flat, sizes)
    assert np.allclose(scored["reconstruction_error"], loss * 2 / 4)
    assert scored["reconstruction_error"][0] > scored["reconstruction_error"].quantile(0.97)


def test_no_rows_and_missing_values(spark, deposits):
    empty = AE.fit(deposits.filter("false"), COLS)
    assert empty.losses == [] and len(empty.weights) == 3
    assert AE.reconstruction_error(deposits.filter("false"), COLS, empty).count() == 0
    holed = deposits.withColumn("x0", F.when(F.col("id") > 3, F.col("x0")))
    net = AE.fit(holed, COLS, passes=3, starts=1)
    assert AE.reconstruction_error(holed, COLS, net).filter("reconstruction_error is null").count() == 4


def test_forest_arrays_give_the_paths_of_single_walks():
    import pandas as pd
    rng = np.random.default_rng(2)
    trees = [N._grow(pd.DataFrame(rng.normal(size=(40, 2)), columns=["a", "b"]).assign(tree_id=t), ["a", "b"], 6, 1) for t in range(5)]
    forest = N.Forest(pd.concat(trees).sample(frac=1, random_state=1))
    x = rng.normal(size=(30, 2)) * 2

    def walk(tree, row):
        t, at, steps = tree.set_index("node"), 0, 0
        while t.loc[at, "feat"] >= 0:
            at = int(t.loc[at, "left"] if row[int(t.loc[at, "feat"])] < t.loc[at, "thr"] else t.loc[at, "right"])
            steps += 1
        return steps + N._c(t.loc[at, "size"])

    assert np.allclose(forest.path_lengths(x), [np.mean([walk(t, r) for t in trees]) for r in x])
