"""Demand-by-grade, briefs, recursive and seasonal forecasts on literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlark.operators import aggregate as A
from ledgerlark.operators import demand as D
from ledgerlark.operators import series as S
from ledgerlark.operators import serving


def months(n, y=2020, m=1):
    out = []
    for _ in range(n):
        out.append(dt.date(y, m, 1))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return out


def grades_table(spark, n=24):
    rows = []
    for i, d in enumerate(months(n)):
        for j, g in enumerate(D.GRADES):
            rows.append(("P", g, d, float(10 + j + 0.3 * i), 5 + j))
    return spark.createDataFrame(rows, "portfolio string, grade string, month_start date, value double, loan_count long")


def test_confidence_z():
    assert abs(D.confidence_z(0.8) - 1.2815515655446004) < 1e-12
    assert D.confidence_z(2.0) == D.confidence_z(0.999)


def test_demand_weights_follow_last_month_and_sum_to_target(spark):
    df = grades_table(spark)
    f = D.demand_forecast(df, ["portfolio"], 4, 0.8, "baseline").collect()
    tgt = {r.step: r.forecast_central for r in D.total_target(D.grade_history(df, ["portfolio"]), ["portfolio"], 4).collect()}
    assert len(f) == 20
    for s in range(1, 5):
        rows = [r for r in f if r.step == s]
        assert abs(sum(r.baseline_central for r in rows) - tgt[s]) < 1e-6
        last = {g: 10 + j + 0.3 * 23 for j, g in enumerate(D.GRADES)}
        tot = sum(last.values())
        for r in rows:
            assert abs(r.baseline_central - tgt[s] * last[r.grade] / tot) < 1e-6
            assert r.forecast_lower <= r.forecast_central <= r.forecast_upper


def test_demand_scenarios_scale_central(spark):
    df = grades_table(spark)
    base = {(r.grade, r.step): r.forecast_central for r in D.demand_forecast(df, ["portfolio"], 3, 0.8, "baseline").collect()}
    opt = {(r.grade, r.step): r.forecast_central for r in D.demand_forecast(df, ["portfolio"], 3, 0.8, "optimistic").collect()}
    for k, v in base.items():
        assert abs(opt[k] - v * 1.15) < 0.011
    t = D.demand_totals(D.demand_forecast(df, ["portfolio"], 3, 0.8, "pessimistic"), ["portfolio"]).first()
    assert abs(t.optimistic_total - t.baseline_total * 1.15) < 0.011


def test_short_portfolio_skipped(spark):
    df = grades_table(spark, n=8)
    assert D.demand_forecast(df, ["portfolio"], 3).count() == 0


def test_grade_share_sums_to_one(spark):
    s = D.grade_share(grades_table(spark), ["portfolio"]).collect()
    assert len(s) == 5 and abs(sum(r.share for r in s) - 1.0) < 1e-9


def test_ordered_distinct_first_occurrence(spark):
    df = spark.createDataFrame([("u", 3, "b"), ("u", 1, "a"), ("u", 2, "b"), ("u", 4, "a"), ("v", 1, "c")],
                               "k string, t int, item string")
    out = {r.k: r.items for r in A.ordered_distinct(df, ["k"], "item", ["t"]).collect()}
    assert out == {"u": ["a", "b"], "v": ["c"]}


def test_next_action_priorities(spark):
    anomalies = spark.createDataFrame([("a", dt.date(2021, 3, 1), "Spike"), ("a", dt.date(2021, 5, 1), "Dip")],
                                      "series_id string, month_start date, direction string")
    conf = spark.createDataFrame([("a", "High confidence"), ("b", "Unstable"), ("c", "High confidence"),
                                  ("d", "Watch closely")], "series_id string, confidence_label string")
    growth = spark.createDataFrame([("a", 0.0), ("b", 0.2), ("c", 0.06), ("d", -0.05)], "series_id string, likely_change double")
    out = {r.series_id: r.next_action for r in S.next_action(anomalies, conf, growth, ["series_id"]).collect()}
    assert out["a"].startswith("Priority: investigate the latest dip signal") and "2021-05" in out["a"]
    assert out["b"].startswith("Priority: rely on baseline models")
    assert out["c"].startswith("Priority: prepare capacity")
    assert out["d"].startswith("Priority: activate retention")


def test_root_cause_default_and_direction(spark):
    vals = [100.0] * 23 + [200.0]
    df = spark.createDataFrame([("s", d, v) for d, v in zip(months(24), vals)], "series_id string, month_start date, value double")
    an = spark.createDataFrame([("s", months(24)[-1], 200.0, "Spike")],
                               "series_id string, month_start date, value double, direction string")
    r = S.root_cause_hint(df, an, ["series_id"]).first()
    assert r.root_cause.startswith("seasonal demand burst")
    assert "possible campaign or one-off surge" in r.root_cause


def test_seasonal_trend_fit_and_ensemble(spark):
    import math
    vals = [100 + 2 * i + 10 * math.sin(2 * math.pi * i / 12) for i in range(36)]
    df = spark.createDataFrame([("s", d, v) for d, v in zip(months(36), vals)], "series_id string, month_start date, value double")
    st = S.seasonal_trend_fit(df, ["series_id"], 3).orderBy("step").collect()
    assert [r.step for r in st] == [1, 2, 3]
    assert all(0 <= r.yhat_lower <= r.yhat <= r.yhat_upper for r in st)
    assert abs(st[0].yhat - (100 + 2 * 36 + 10 * math.sin(2 * math.pi * 36 / 12))) < 15
    e = S.ensemble_forecast(df, ["series_id"], 4).collect()
    assert len(e) == 4 and all(r.ensemble is not None for r in e)


def test_volume_recursive_shape(spark):
    rows = []
    for sid, scale in [("A", 1.0), ("B", 2.0)]:
        for i, d in enumerate(months(30)):
            rows.append((sid, d, scale * (5 + 0.1 * i), 10.0 + i * 0.01, 40.0 + i, 120000.0))
    panel = spark.createDataFrame(rows, "series_id string, month_start date, value double, avg_int_rate double, "
                                        "loan_count double, avg_loan_amnt double")
    out = serving.volume_forecast_recursive(panel, ["series_id"], 4, "stress").collect()
    assert len(out) == 8
    assert {r.month_start for r in out if r.series_id == "A"} == set(months(4, 2022, 7))
    assert all(0 <= r.forecast_lower <= r.forecast_central <= r.forecast_upper for r in out)
    assert F is not None


def _simulate_demand(hist, targets, scenario, z, shares):
    """Step-by-step statistical path, written as a plain loop over the steps."""
    import numpy as np
    m = D.SCENARIO_MULT[scenario]
    gh = {g: list(v) for g, v in hist.items()}
    th = [sum(vals) for vals in zip(*hist.values())]
    out = {}
    for step, target in enumerate(targets, start=1):
        if target <= 0:
            target = max(th[-1], 1.0)
        preds = {g: max(0.0, gh[g][-1]) for g in D.GRADES}
        raw = sum(preds.values())
        if raw <= 1e-6:
            preds = {g: max(0.0, target * shares[g]) for g in D.GRADES}
            raw = sum(preds.values())
        if raw > 1e-6:
            preds = {g: max(0.0, p * target / raw) for g, p in preds.items()}
        month_total = 0.0
        for g in D.GRADES:
            bc = preds[g]
            recent = np.asarray(gh[g][-12:], dtype=float)
            deltas = np.diff(recent) if recent.size > 1 else np.asarray([0.0])
            vol = max(float(np.std(deltas)), 0.04 * max(abs(bc), 1.0))
            sp = vol * np.sqrt(step)
            lo = max(0.0, bc - z * sp)
            hi = max(lo, bc + z * sp)
            c = bc * m
            if scenario == "optimistic":
                hi *= 1.15
            elif scenario == "pessimistic":
                lo *= 0.85
            c, lo = max(0.0, c), max(0.0, lo)
            out[(g, step)] = (c, lo, max(lo, hi))
            gh[g].append(c)
            month_total += c
        th.append(month_total)
    return out


def test_demand_matches_step_loop_with_falling_total(spark):
    n = 24
    hist = {g: [max(0.0, (60.0 - 2.4 * i) * (1 + 0.1 * j)) for i in range(n)] for j, g in enumerate(D.GRADES)}
    rows = [("P", g, d, hist[g][i], 1) for g in D.GRADES for i, d in enumerate(months(n))]
    df = spark.createDataFrame(rows, "portfolio string, grade string, month_start date, value double, loan_count long")
    targets = [r.forecast_central for r in
               D.total_target(D.grade_history(df, ["portfolio"]), ["portfolio"], 6).orderBy("step").collect()]
    assert min(targets) <= 0 < max(targets) or min(targets) <= 0  # the fallback path is exercised
    for scenario in ("optimistic", "pessimistic", "baseline"):
        want = _simulate_demand(hist, targets, scenario, D.confidence_z(0.8), D.FALLBACK_SHARES)
        got = D.demand_forecast(df, ["portfolio"], 6, 0.8, scenario).collect()
        assert len(got) == 30
        for r in got:
            c, lo, hi = want[(r.grade, r.step)]
            assert abs(r.forecast_central - c) < 0.0051, (scenario, r)
            assert abs(r.forecast_lower - lo) < 0.0051, (scenario, r)
            assert abs(r.forecast_upper - hi) < 0.0051, (scenario, r)


def test_demand_zero_last_month_uses_shares(spark):
    n = 20
    hist = {g: [10.0 + j + 0.5 * i for i in range(n - 1)] + [0.0] for j, g in enumerate(D.GRADES)}
    rows = [("P", g, d, hist[g][i], 1) for g in D.GRADES for i, d in enumerate(months(n))]
    df = spark.createDataFrame(rows, "portfolio string, grade string, month_start date, value double, loan_count long")
    targets = [r.forecast_central for r in
               D.total_target(D.grade_history(df, ["portfolio"]), ["portfolio"], 3).orderBy("step").collect()]
    want = _simulate_demand(hist, targets, "baseline", D.confidence_z(0.8), D.FALLBACK_SHARES)
    for r in D.demand_forecast(df, ["portfolio"], 3, 0.8, "baseline").collect():
        c, lo, hi = want[(r.grade, r.step)]
        assert abs(r.forecast_central - c) < 0.0051 and abs(r.forecast_upper - hi) < 0.0051, r
