"""Literal fixtures for the column expressions (known answers)."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlark.functions import expr as X
from ledgerlark.operators import encode as E
from ledgerlark.operators import ranking as R
from ledgerlark.operators import risk as K


def col(spark, values, typ, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_fix_percent_and_emp_length(spark):
    assert col(spark, ["13.56%", " 7.1 %", "n/a", None], "string", X.fix_percent) == [13.56, 7.1, None, None]
    assert col(spark, ["10+ years", "< 1 year", "n/a"], "string", X.first_int) == [10.0, 1.0, None]


def test_normalize_location(spark):
    got = col(spark, [" new-delhi  (n) ", "", None, "None"], "string", X.normalize_location)
    assert got == ["NEWDELHI N", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_parse_mixed_dates(spark):
    got = col(spark, ["2/8/16", "10/21/16", "2016-08-02", "x", "31/2/2016", "1/1/80"], "string", X.parse_mixed_dates)
    assert got == [dt.date(2016, 8, 2), dt.date(2016, 10, 21), dt.date(2016, 8, 2), None, None, dt.date(1980, 1, 1)]


def test_month_year(spark):
    assert col(spark, ["Dec-2015", "bad"], "string", X.parse_month_year) == [dt.date(2015, 12, 1), None]


def test_cut_bins_right_closed(spark):
    got = col(spark, [0.0, -1.0, 30.0, 30.5, 120.0, 121.0], "double", lambda c: X.cut(c, *E.AGE_BINS))
    assert got == ["Young", "nan", "Young", "Adult", "Senior", "nan"]


def test_risk_band_edges(spark):
    got = col(spark, [0.30, 0.300001, 0.55, 0.56], "double", lambda c: X.band(c, *K.RISK_BAND_CUTS))
    assert got == ["Low", "Medium", "Medium", "High"]


def test_rnd_is_half_up(spark):
    assert col(spark, [0.125, 2.5, -2.5], "double", lambda c: X.rnd(c, 2 if False else 0)) == [0.0, 3.0, -2.0]


def test_quintiles_match_qcut(spark):
    df = spark.createDataFrame([(r,) for r in range(1, 8)], "r long")
    got = [x[0] for x in df.orderBy("r").select(R.quintile_score(F.col("r"), F.lit(7))).collect()]
    assert got == [1, 1, 2, 3, 4, 5, 5]
    one = spark.createDataFrame([(1,)], "r long")
    assert one.select(R.quintile_score(F.col("r"), F.lit(1))).first()[0] == 5
    assert one.select(R.quintile_score(F.col("r"), F.lit(1), higher_is_better=False)).first()[0] == 1


def test_encode_known_categories(spark):
    df = spark.createDataFrame([(" c ", "MORTGAGE", " Credit_Card"), ("Z", None, "x")], "grade string, home_ownership string, purpose string")
    rows = E.encode_known_categories(df).collect()
    assert tuple(rows[0]) == (2, 2, 1)
    assert tuple(rows[1]) == (0, 0, 0)


def test_prepare_features_order_and_fill(spark):
    df = spark.createDataFrame([(12000.0, 14.2, "C", "MORTGAGE", "credit_card")],
                               "loan_amnt double, int_rate double, grade string, home_ownership string, purpose string")
    wanted = ["loan_amnt", "int_rate", "grade", "home_ownership", "purpose", "dti"]
    out = E.prepare_features(df, wanted)
    assert out.columns == wanted
    assert tuple(out.first()) == (12000.0, 14.2, 2.0, 2.0, 1.0, 0.0)


def test_stress_scenario(spark):
    df = spark.createDataFrame([(10.0, 100000.0, 12.0, 0)], "int_rate double, annual_inc double, dti double, delinq_2yrs int")
    r = K.stress_scenario(df, 150, 10, 4).first()
    assert (r.int_rate, r.annual_inc, r.dti, r.delinq_2yrs) == (11.5, 90000.0, 16.0, 1.0)
    r2 = K.stress_scenario(df, 150, 10, 2.9).first()
    assert r2.delinq_2yrs == 0.0


def test_bround_vs_truncate(spark):
    from ledgerlark.operators import clean as C
    df = spark.createDataFrame([(1.0, 10.5, 1.0, 1.0), (1.0, 11.5, 1.0, 1.0)], "amount double, hour double, day_of_week double, frequency double")
    assert [r.hour for r in C.normalize_deposits(df).collect()] == [10, 12]
    assert [r.hour for r in C.validate_deposits(df).collect()] == [10, 11]


def test_require_columns_names_missing(spark):
    import pytest

    from ledgerlark.operators import clean as C
    df = spark.createDataFrame([(1, "x")], "age int, job string")
    with pytest.raises(C.MissingColumnsError, match="CustomerID"):
        C.require_columns(df, C.TX_REQUIRED, "wealth persona", any_of=[C.AMOUNT_ALIASES])
