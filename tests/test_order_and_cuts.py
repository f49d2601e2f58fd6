"""Quintile cuts, AUC from counts, sorted reports, committed tables and the model cache."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import aggregate as A
from ledgerlark.operators import clean as C
from ledgerlark.operators import ml as M
from ledgerlark.operators import ranking as R
from ledgerlark.operators import risk as K
from ledgerlark.operators import segment as G
from ledgerlark.operators import series as S
from ledgerlark.sources import io as IO


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 11, 100, 103])
def test_quintiles_equal_qcut_of_first_ranks(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.randint(0, max(1, n // 4)), float(rng.randint(0, 3))) for i in range(n)]
    got = G.quintile_scores(spark.createDataFrame(rows, "CustomerID long, a long, b double"), "a", "s")
    got = {r.CustomerID: r.s for r in G.quintile_scores(got, "b", "t", higher_is_better=False).collect()}
    pdf = pd.DataFrame(rows, columns=["CustomerID", "a", "b"])
    rank = pdf["a"].rank(method="first")
    want = [5] if n == 1 else (pd.qcut(rank, 5, labels=False) + 1).tolist()
    assert [got[i] for i in range(n)] == want


def test_quantiles_of_an_empty_table_are_one_null_row(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert [r.m for r in R.scalar_quantiles(df, "v", {"m": 0.5}).collect()] == [None]
    assert R.group_quantiles(df, ["g"], "v", {"m": 0.5}).count() == 0


def test_row_numbers_of_groups_cut_by_partitions(spark):
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", rng.randint(0, 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = R.group_row_number(df, ["g"], [F.col("v"), F.col("id")], size_out="n", partitions=7, few=True).collect()
    for g in "ab":
        want = sorted((v, i) for h, v, i in rows if h == g)
        mine = sorted((r.rn, r.v, r.id) for r in got if r.g == g)
        assert [(v, i) for _, v, i in mine] == want
        assert [k for k, _, _ in mine] == list(range(1, len(want) + 1))
        assert {r.n for r in got if r.g == g} == {len(want)}


def test_auc_equals_pairwise_count(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y int, s double")
    assert M.auc(df, "y", "s").first().auc == pytest.approx(want, abs=1e-12)
    assert M.auc(df.filter("y = 1"), "y", "s").first().auc is None


def test_reports_are_sorted(spark):
    base = spark.createDataFrame([(float(i % 7), float(i % 5), 1.0 * (i % 3)) for i in range(60)], "a double, b double, c double")
    moved = base.withColumns({"b": F.col("b") + 9, "c": F.col("c") + 0.4})
    scores = [r.drift_score for r in K.drift_report(moved, base, ["a", "b", "c"]).collect()]
    assert scores == sorted(scores, reverse=True) and scores[0] > scores[-1]
    values = [(r.column_name, r.value) for r in A.distinct_values(spark.createDataFrame([("z", "q"), ("a", "p")], "y string, x string"), ["y", "x"]).collect()]
    assert values == sorted(values)
    months = pd.date_range("2001-01-01", periods=30, freq="MS")
    df = spark.createDataFrame([("s", m.date(), 100.0 + 3 * i + (i % 4)) for i, m in enumerate(months)],
                               "series_id string, month_start date, value double")
    mape = [r.mape for r in S.baseline_backtest(df, ["series_id"]).collect()]
    assert mape == sorted(mape)


def test_a_table_without_commit_is_built_again(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert not (tmp_path / "t" / "_SUCCESS").exists()
    assert IO.ensure_materialized(spark, path, lambda: spark.range(5)).count() == 5
    assert IO.ensure_materialized(spark, path, lambda: spark.range(9)).count() == 5


def test_model_cache_misses_on_changed_source_or_parameters(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.range(4).write.parquet(one)
    spark.range(4).write.parquet(two)
    data = spark.createDataFrame([(float(i), float(i % 2)) for i in range(8)], "x double, label double")
    built = []

    def cached(params):
        return IO.cached_artifact(spark, [one, two], str(tmp_path / "store"), lambda: built.append(1) or M.fit(data, ["x"], M.LogisticRegression(maxIter=5)), params)

    cached({"maxIter": 5})
    cached({"maxIter": 5})
    assert len(built) == 1
    cached({"maxIter": 6})
    assert len(built) == 2
    spark.range(40).write.mode("overwrite").parquet(two)
    cached({"maxIter": 6})
    assert len(built) == 3


def test_balanced_training_learns_a_rare_class(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(2.0 * (i % 10 == 0), 1), rng.gauss(0, 1), int(i % 10 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y int")
    plain, even = (M.train_and_evaluate(M.Split(df, ["x", "z"], "y", "id", balance=b), {"lr": M.LogisticRegression(maxIter=50)}).first() for b in (False, True))
    assert even.auc > 0.8 and even.recall > plain.recall


def test_explanations_order_features_inside_a_row(spark):
    from ledgerlark.operators import explain as P
    df = spark.createDataFrame([(1, 1.0, 10.0, None), (2, 3.0, 10.0, None), (3, None, 16.0, None)], "id long, a double, b double, c double")
    coef = spark.createDataFrame([("a", 2.0), ("b", -0.5)], "feature string, beta double")
    w = P.contribution_waterfall(df, "id", ["a", "b", "c"], coef)
    got = [(r.id, r.step, r.feature, r.contribution, r.start, r.end) for r in w.orderBy("id", "step").collect()]
    assert got == [(1, 1, "a", -2.0, 0.0, -2.0), (1, 2, "b", 1.0, -2.0, -1.0), (2, 1, "a", 2.0, 0.0, 2.0), (2, 2, "b", 1.0, 2.0, 3.0),
                   (3, 1, "b", -2.0, 0.0, -2.0), (3, 2, "a", 0.0, -2.0, -2.0)]
    imp = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "feature string, importance double")
    top = P.local_feature_impact(df, "id", ["a", "b", "c"], imp, top_n=2)
    got = [(r.id, r["rank"], r.feature, r.impact) for r in top.orderBy("id", "rank").collect()]
    assert got == [(1, 1, "b", -1.0), (1, 2, "a", -0.5), (2, 1, "b", -1.0), (2, 2, "a", 0.5), (3, 1, "b", 2.0), (3, 2, "a", -1.0)]
    assert "hashpartitioning(id" not in w._jdf.queryExecution().toString() + top._jdf.queryExecution().toString()


def test_class_profile_counts_null_as_a_class(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "y string")
    assert {(r["class"], r.class_count, r.class_pct) for r in C.class_profile(df, "y").collect()} == {("a", 2, 50.0), (None, 1, 25.0), ("b", 1, 25.0)}
    assert C.class_profile(df.limit(0), "y").count() == 0


def test_serving_covariates_and_scaled_counts(spark):
    from ledgerlark.operators import serving as SV
    months = [m.date() for m in pd.date_range("2001-01-01", periods=3, freq="MS")]
    rows = [("s", m, v, r, float(n), 9.0) for m, v, r, n in zip(months, (2.0, 4.0, 6.0), (5.0, 6.0, None), (10, 20, 30))]
    panel = spark.createDataFrame(rows, "series_id string, month_start date, value double, avg_int_rate double, loan_count double, avg_loan_amnt double")
    last = SV.last_covariates(panel).first()
    assert (last.avg_int_rate, last.avg_loan_amnt, last.loan_count) == (6.0, 9.0, 30.0)
    hint = spark.createDataFrame([(8.0,)], "total_hint double")
    assert SV.scaled_loan_count(panel, hint).first().loan_count == 40.0  # mean 20, twice the mean total
    assert SV.next_month_features(panel.select("series_id", "month_start", "value")).first().rolling_12 == 4.0


def test_stored_models_are_fitted_once_and_score_every_row(spark, tmp_path):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.gauss(2.0 * (i % 4 == 0), 1), int(i % 4 == 0)) for i in range(300)], "id long, x double, y int")
    split, built, stored = M.Split(df, ["x"], "y", "id"), [], {}

    def keep(s, est):
        key = str(s.params(est))
        if key not in stored:
            built.append(1)
            stored[key] = s.fit(est)
        return stored[key]

    est = {"lr": M.LogisticRegression(maxIter=20), "other": M.LogisticRegression(maxIter=21)}
    first = M.train_and_evaluate(split, est, keep=keep).orderBy("model").collect()
    assert M.train_and_evaluate(split, est, keep=keep).orderBy("model").collect() == first and len(built) == 2
    assert split.train.count() + split.test.count() == 300 and split.test.count() > 0
    assert keep(split, est["lr"]).transform(df).count() == 300
    board = M.leaderboard(M.train_and_evaluate(split, est, keep=keep)).collect()
    assert [r["rank"] for r in board if r.champion] == [1]


def test_models_by_group_are_tested_on_later_months(spark):
    from pyspark.ml.regression import LinearRegression
    rows = [(g, k, float(k), float(k) * (2 if g == "A" else 3)) for g in "AB" for k in range(20)]
    df = spark.createDataFrame(rows, "grade string, k int, x double, label double")
    out = M.evaluate_by_group(df.filter("k < 15"), df.filter("k >= 15"), "grade", ["A", "B"], ["x"], lambda: {"lin": LinearRegression(labelCol="label")})
    got = {(r.grade, r.model): r.mape for r in out.collect()}
    assert set(got) == {("A", "lin"), ("B", "lin")} and max(got.values()) < 1e-3


def test_loans_are_scored_by_stored_models_in_one_pass(spark, sf, tmp_path):
    """Small default and churn models, fitted side by side, stored in the named folder and found there again."""
    from ledgerlark.operators import risk as K
    from ledgerlark.plans import q_ml as Q
    from ledgerlark.sources.domain import Tables, clean_loans
    spark.conf.set("spark.ledgerlark.models.dir", str(tmp_path))
    try:
        t = Tables(spark, sf)
        loans = clean_loans(t)
        small = lambda **kw: M.GBTClassifier(maxIter=2, maxDepth=2, seed=1, labelCol="label", **kw)
        fits = [lambda: Q._keeper(spark, sf)(Q._default_split(spark, sf, t), small()), lambda: Q._keeper(spark, sf)(Q._churn_split(spark, sf, t), small(weightCol="weight"))]
        models = M.side_by_side(fits)
        stored = sorted(p.name for p in tmp_path.iterdir())
        assert len(stored) == 2
        scored = Q.score_loans(loans, dict(zip(("default_probability", "churn_probability"), models)))
        assert "Exchange hashpartitioning(loan_id" not in scored._jdf.queryExecution().executedPlan().toString()
        rows = K.risk_score_band(scored).collect()
        assert len(rows) == loans.count() and all(0 < r.default_probability < 1 and r.risk_band in ("Low", "Medium", "High") for r in rows)
        again = Q.score_loans(loans, dict(zip(("default_probability", "churn_probability"), M.side_by_side(fits))))
        key = lambda r: r.loan_id
        assert sorted(again.collect(), key=key) == sorted(scored.collect(), key=key)
        assert sorted(p.name for p in tmp_path.iterdir()) == stored
    finally:
        spark.conf.unset("spark.ledgerlark.models.dir")
