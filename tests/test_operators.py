"""Behaviour of the grouped/window operators on small literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlark.operators import ranking as R
from ledgerlark.operators import segment as G
from ledgerlark.operators import series as S
from ledgerlark.operators import windows as W


def monthly(spark, values, sid="s"):
    rows = []
    y, m = 2020, 1
    for v in values:
        rows.append((sid, dt.date(y, m, 1), float(v) if v is not None else None))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return spark.createDataFrame(rows, "series_id string, month_start date, value double")


def test_baseline_forecasts_known(spark):
    df = monthly(spark, [100 + 2 * i for i in range(24)])
    out = S.baseline_forecasts(df, ["series_id"], 4).orderBy("step").collect()
    assert len(out) == 4
    assert out[0].naive_last == 146.0 and abs(out[0].moving_avg_3 - 144.0) < 1e-9
    assert out[0].month_start == dt.date(2022, 1, 1)


def test_forecast_uncertainty_band_order(spark):
    df = monthly(spark, [100 + 2 * i for i in range(24)])
    for r in S.forecast_uncertainty(df, ["series_id"], 4).collect():
        assert 0 <= r.forecast_lower <= r.forecast_central <= r.forecast_upper


def test_rolling_band_flags_spike(spark):
    vals = [120 + 1.5 * i for i in range(30)]
    vals[-1] += 35
    df = monthly(spark, vals)
    a = W.rolling_band_anomalies(df).collect()
    assert a and a[-1].direction == "Spike" or any(r.direction == "Spike" and r.month_start == dt.date(2022, 6, 1) for r in a)


def test_rolling_backtest_short_series_empty(spark):
    df = monthly(spark, list(range(1, 14)))
    out = S.rolling_backtest(df, ["series_id"])
    assert out.count() == 0 and {"horizon", "mape", "coverage"} <= set(out.columns)


def test_ffill_bfill(spark):
    df = monthly(spark, [None, 2, None, 4])
    got = [r.value for r in W.ffill_bfill(df).orderBy("month_start").collect()]
    assert got == [2.0, 2.0, 2.0, 4.0]


def test_global_row_number_matches_sort(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 101).alias("k"), F.col("id"))
    r = R.global_row_number(df, [F.col("k"), F.col("id")], partitions=4).orderBy("rn").collect()
    expected = sorted((x.k, x.id) for x in df.collect())
    assert [(x.k, x.id) for x in r] == expected
    assert [x.rn for x in r] == list(range(1, 501))


def test_group_quantiles_match_linear_interpolation(spark):
    import numpy as np
    rows = [("hot", float(v)) for v in range(100)] + [("one", 5.0), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    q = {r.g: r for r in R.group_quantiles(df, ["g"], "v", {"q1": 0.25, "med": 0.5, "p99": 0.99}).collect()}
    assert abs(q["hot"].p99 - np.quantile(np.arange(100.0), 0.99)) < 1e-9
    assert q["one"].med == 5.0 and q["two"].med == 2.5 and q["two"].q1 == 1.75


def test_persona_mapping_names(spark):
    prof = spark.createDataFrame([
        (0, 1.0, 10.0, 40.0, 100.0), (1, 5.0, 50.0, 70.0, 900.0), (2, 9.0, 80.0, 25.0, 300.0), (3, 4.0, 40.0, 45.0, 400.0)],
        "Cluster int, Frequency double, Monetary double, MedianAge double, AvgAccountBalance double")
    names = {r.Cluster: r.Persona for r in G.persona_mapping(prof).collect()}
    assert names == {0: "Low-Activity Accounts", 1: "Wealthy Seniors", 2: "Frequent Young Transactors", 3: "Mid-Tier Savers"}
    three = G.persona_mapping(prof.filter("Cluster < 3"))
    assert {r.Persona for r in three.collect()} == {"Segment 0", "Segment 1", "Segment 2"}


def test_trailing_count_matches_window(spark):
    from pyspark.sql import Window
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ours = W.trailing_count(ev, "user_id", "ts", 86400, "event_id", out="f")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(us).rangeBetween(-86400 * 1_000_000, 0)
    ref = ev.withColumn("f2", F.count(F.lit(1)).over(w))
    j = ours.join(ref.select("event_id", "f2"), "event_id")
    assert j.filter(F.col("f") != F.col("f2")).count() == 0 and j.count() == ev.count()


def test_group_quantiles_match_numpy_with_duplicates(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.integers(0, 20, 400)] + [("g%d" % (i % 7), float(rng.normal())) for i in range(90)]
    rows += [("one", 3.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"q1": 0.25, "med": 0.5, "p99": 0.99}
    got = {r.g: r for r in R.group_quantiles(df, ["g"], "v", qs).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([v for k, v in rows if k == g])
        for name, q in qs.items():
            assert abs(getattr(got[g], name) - np.percentile(vals, q * 100)) < 1e-9, (g, name)
    whole = R.scalar_quantiles(df, "v", {"m": 0.5}).first().m
    assert abs(whole - np.percentile([v for _, v in rows], 50)) < 1e-9


def test_rolling_backtest_windows_equal_expanded(spark):
    import math
    rows = []
    for sid, n, gaps in [("a", 40, {5, 6, 17}), ("b", 30, set()), ("c", 22, {0, 1, 2})]:
        for i in range(n):
            v = None if i in gaps else 100 + 3 * i + 15 * math.sin(i / 2.0)
            rows.append((sid, dt.date(2015 + (i + (i // 7)) // 12, (i + (i // 7)) % 12 + 1, 1), v))
    df = spark.createDataFrame(rows, "series_id string, month_start date, value double")
    a = sorted(tuple(r) for r in S.rolling_backtest(df, ["series_id"]).collect())
    b = sorted(tuple(r) for r in S.rolling_backtest_expanded(df, ["series_id"]).collect())
    assert a == b and len(a) > 0
