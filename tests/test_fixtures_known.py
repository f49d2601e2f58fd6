"""Literal fixtures with known answers (drift, churn label, rule flags, flat min-max,
feature alignment, small stress bump)."""

import datetime as dt

from ledgerlark.operators import anomaly as N
from ledgerlark.operators import encode as E
from ledgerlark.operators import risk as K
from ledgerlark.operators import windows as W


def test_drift_report_orders_shifted_feature_first(spark):
    base = [(10.0 + (i % 5), 50000.0 + i, 15.0 + (i % 3)) for i in range(40)]
    cur = [(r + 7.0, a, d) for r, a, d in base]
    cols = "int_rate double, annual_inc double, dti double"
    rep = K.drift_report(spark.createDataFrame(cur, cols), spark.createDataFrame(base, cols),
                         ["int_rate", "annual_inc", "dti"]).collect()
    by = {r.feature: r for r in rep}
    top = max(rep, key=lambda r: r.drift_score)
    assert top.feature == "int_rate"
    assert by["annual_inc"].drift_score == 0 and by["dti"].drift_score == 0


def test_churn_label_cut(spark):
    rows = [(1, "Fully Paid", dt.date(2015, 1, 1), dt.date(2017, 7, 1), " 36 months"),   # 30 months < 30.6
            (2, "Fully Paid", dt.date(2015, 1, 1), dt.date(2017, 8, 1), " 36 months"),   # 31 months
            (3, "Fully Paid", dt.date(2015, 1, 1), None, " 36 months"),
            (4, "Charged Off", dt.date(2015, 1, 1), dt.date(2017, 8, 1), " 36 months")]
    df = spark.createDataFrame(rows, "loan_id int, loan_status string, issue_d date, last_pymnt_d date, term string")
    out = {r.loan_id: r.churn_flag for r in K.churn_label(df).collect()}
    assert out == {1: 0, 2: 1, 3: 0}


def test_rule_flags_all_three(spark):
    dep = spark.createDataFrame([(1, 8000.0, 2, 12), (2, 50.0, 13, 1)], "deposit_id int, amount double, hour int, frequency int")
    thr = spark.createDataFrame([(5000.0, 6.0)], "amount_high double, frequency_high double")
    out = {r.deposit_id: r.rule_reasons for r in N.rule_flags(dep, thr).collect()}
    assert out[1] == "Unusual amount, Unusual hour, High frequency"
    assert out[2] == "Patterns consistent with history"


def test_minmax_flat_column_is_one(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0), (5.0, 2.0)], "a double, b double")
    rows = W.minmax_normalize(df, ["a", "b"]).orderBy("b").collect()
    assert [r.a_norm for r in rows] == [1.0, 1.0, 1.0]
    assert [r.b_norm for r in rows] == [0.0, 0.5, 1.0]


def test_align_features_unseen_and_missing(spark):
    feats = ["age", "balance", "job_admin.", "job_technician", "marital_single", "campaign"]
    df = spark.createDataFrame([(35, 100.0, "astronaut", "single", 200)],
                               "age int, balance double, job string, marital string, duration int")
    row = E.align_features(df, feats).first()
    assert len(row) == len(feats)
    assert row["job_admin."] == 0 and row["job_technician"] == 0 and row["marital_single"] == 1
    assert row["campaign"] == 0


def test_stress_small_bump_keeps_delinquencies(spark):
    df = spark.createDataFrame([(10.0, 100000.0, 12.0, 0)], "int_rate double, annual_inc double, dti double, delinq_2yrs int")
    r = K.stress_scenario(df, 150, 10, 2.9).first()
    assert r.delinq_2yrs == 0 and abs(r.dti - 14.9) < 1e-9
