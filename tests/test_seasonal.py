"""The seasonal fit: coordinate descent against a direct search, a planted bend, widening bands, equal reruns."""

from datetime import date

import numpy as np

from ledgerlark.operators import seasonal as SN


def test_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(5):
        x = rng.normal(size=(40, 8))
        y = x[:, 1] * 2 - x[:, 5] + 0.1 * rng.normal(size=40)
        gram, pull, penalty = x.T @ x, x.T @ y, 8.0
        b = SN.sparse_changes(gram, pull, penalty, np.zeros(8))
        slope = pull - gram @ b
        on = b != 0
        assert np.allclose(slope[on], penalty * np.sign(b[on]), atol=1e-4) and (np.abs(slope[~on]) <= penalty + 1e-4).all()
        assert on[1] and on[5] and on.sum() < 8


def planted(n=96, bend=48):
    t = np.arange(n)
    rng = np.random.default_rng(1)
    trend = 5.0 + 0.004 * t + 0.03 * np.maximum(0, t - bend)
    return np.expm1(trend + 0.1 * np.sin(2 * np.pi * t / 12) + 0.005 * rng.normal(size=n)), t % 12 + 1.0


def test_a_planted_bend_is_found():
    value, month = planted()
    fit = SN.fit_series(value, month)
    size = np.abs(fit.change)
    place = fit.at * 95
    near = np.abs(place - 48) <= 5
    assert near[size.argmax()] and size[near].sum() > 0.7 * size.sum() and (size > 1e-6).sum() < len(size)
    slope = (fit.change[near].sum() * fit.scale) / 95
    assert abs(slope - 0.03) < 0.006


def test_bands_widen_and_reruns_agree(spark):
    value, month = planted()
    rows = [("bent", date(2000 + k // 12, k % 12 + 1, 1), float(v)) for k, v in enumerate(value)]
    rows += [("flat", d, 50.0) for _, d, _ in rows[:30]] + [("one", date(2001, 1, 1), 7.0), ("holes", date(2001, 1, 1), None), ("holes", date(2001, 2, 1), 3.0)]
    df = spark.createDataFrame(rows, "series_id string, month_start date, value double")
    out = SN.seasonal_trend_fit(df, ["series_id"], 12).orderBy("series_id", "step").collect()
    again = SN.seasonal_trend_fit(df.repartition(3), ["series_id"], 12).orderBy("series_id", "step").collect()
    assert out == again and len(out) == 48
    bent = [r for r in out if r.series_id == "bent"]
    wide = [np.log1p(r.yhat_upper) - np.log1p(r.yhat_lower) for r in bent]
    assert wide[-1] > 1.3 * wide[0] and all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in bent)
    truth = np.expm1(5.0 + 0.004 * 96 + 0.03 * 48)
    assert abs(bent[0].yhat / truth - 1) < 0.1
    flat = [r for r in out if r.series_id == "flat"]
    assert all(abs(r.yhat - 50) < 2 for r in flat)
    bends = SN.changepoints(df, ["series_id"]).collect()
    assert {r.series_id for r in bends} <= {"bent", "flat"} and any(abs((r.month_start - date(2004, 1, 1)).days) < 160 and r.change > 0.005 for r in bends)
    assert SN.seasonal_trend_fit(df.filter("false"), ["series_id"]).count() == 0
