"""Queries for the forecasting family over many series at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import sql_rnd
from ..operators import seasonal as SN
from ..operators import series as S
from ..sources.domain import Tables, nation_series, series
from . import sql_series as Q
from .registry import query
from .sql_views import with_views as V

K = ["series_id"]


def _series(spark, d):
    return series(Tables(spark, d))


@query("baseline_forecasts", Q.chain(V("series"), Q.baseline("series", K, 4, "bf")) + f"""
SELECT series_id, step, month_start, naive_last, {sql_rnd('moving_avg_3', 6)} AS moving_avg_3,
       {sql_rnd('exp_smoothing', 6)} AS exp_smoothing FROM bf""")
def q_baseline_forecasts(spark, d):
    b = S.baseline_forecasts(_series(spark, d), K, 4)
    return b.withColumns({"moving_avg_3": X.rnd(F.col("moving_avg_3"), 6), "exp_smoothing": X.rnd(F.col("exp_smoothing"), 6)})


@query("forecast_uncertainty", Q.chain(V("series"), Q.uncertainty("series", K, 4, "fu")) + "SELECT * FROM fu")
def q_forecast_uncertainty(spark, d):
    return S.forecast_uncertainty(_series(spark, d), K, 4)


@query("forecast_uncertainty_gaps", Q.chain(V("nation_series"), Q.uncertainty("nation_series", K, 6, "fu")) + "SELECT * FROM fu")
def q_forecast_uncertainty_gaps(spark, d):
    """Same model on 25 sparse series with missing months (forward/backward fill path)."""
    return S.forecast_uncertainty(nation_series(Tables(spark, d)), K, 6)


@query("scenario_forecast", Q.chain(V("series"), Q.scenario("series", K, 6, "sf", growth=7.5, remove_outlier=True,
                                                            mode="seasonal_plus")) + "SELECT * FROM sf")
def q_scenario_forecast(spark, d):
    return S.scenario_forecast(_series(spark, d), K, 6, growth_adjust_pct=7.5, remove_recent_outlier=True,
                               pattern_mode="seasonal_plus")


@query("scenario_forecast_flat", Q.chain(V("series"), Q.scenario("series", K, 4, "sf", growth=-10.0, mode="flat"))
       + "SELECT * FROM sf")
def q_scenario_forecast_flat(spark, d):
    return S.scenario_forecast(_series(spark, d), K, 4, growth_adjust_pct=-10.0, pattern_mode="flat")


@query("mad_outliers", Q.chain(V("nation_series"), Q.mad_outliers("nation_series", K, "mo"))
       + "SELECT series_id, month_start, value, is_outlier, cleaned_value FROM mo")
def q_mad_outliers(spark, d):
    m = S.mad_outliers(nation_series(Tables(spark, d)), K)
    return m.select("series_id", "month_start", "value", "is_outlier", "cleaned_value")


@query("baseline_backtest", Q.chain(V("series"), Q.baseline_backtest("series", K, "bb")) + "SELECT * FROM bb")
def q_baseline_backtest(spark, d):
    return S.baseline_backtest(_series(spark, d), K, 4)


@query("rolling_backtest", Q.chain(V("series"), Q.rolling_backtest("series", K, "rb")) + "SELECT * FROM rb")
def q_rolling_backtest(spark, d):
    return S.rolling_backtest(_series(spark, d), K, 6)


@query("confidence_label", Q.chain(V("series"), Q.baseline_backtest("series", K, "bb"), Q.uncertainty("series", K, 4, "fu")) + f"""
, rel AS (SELECT series_id, avg(coalesce((forecast_upper - forecast_lower) / nullif(forecast_central, 0.0), 1.0)) AS r
          FROM fu GROUP BY series_id)
, j AS (SELECT rel.series_id, rel.r, coalesce(bb.mape, 18.0) AS m FROM rel
        LEFT JOIN bb ON bb.series_id = rel.series_id AND bb.model = 'Trend-Seasonal Forecast')
SELECT series_id, {sql_rnd('greatest(0.0, least(100.0, 100.0 - 1.6 * m - 40.0 * r))', 1)} AS confidence_score,
       CASE WHEN greatest(0.0, least(100.0, 100.0 - 1.6 * m - 40.0 * r)) >= 70 THEN 'High confidence'
            WHEN greatest(0.0, least(100.0, 100.0 - 1.6 * m - 40.0 * r)) >= 45 THEN 'Watch closely' ELSE 'Unstable' END
       AS confidence_label
FROM j""")
def q_confidence_label(spark, d):
    s = _series(spark, d)
    return S.confidence_label(S.baseline_backtest(s, K, 4), S.forecast_uncertainty(s, K, 4), K)


_TR_SQL = """tr AS (SELECT series_id, month_start, value FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month_start DESC) AS rd FROM series) t WHERE rd > 4)"""
_TE_SQL = """te AS (SELECT series_id, month_start, value AS y FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month_start DESC) AS rd FROM series) t WHERE rd <= 4)"""


def _split_last(df, k=4):
    rd = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("month_start").desc()))
    t = df.withColumn("_rd", rd)
    return t.filter(F.col("_rd") > k).drop("_rd"), t.filter(F.col("_rd") <= k).drop("_rd")


@query("mape_rmse", Q.chain(V("series"), [_TR_SQL, _TE_SQL], Q.uncertainty("tr", K, 4, "fu")) + f"""
SELECT te.series_id, {sql_rnd(f"avg({Q.ape('te.y', 'fu.forecast_central')})", 4)} AS mape,
       {sql_rnd('sqrt(avg((te.y - fu.forecast_central) * (te.y - fu.forecast_central)))', 4)} AS rmse,
       count(fu.forecast_central) AS matched
FROM te LEFT JOIN fu ON te.series_id = fu.series_id AND te.month_start = fu.month_start GROUP BY te.series_id""")
def q_mape_rmse(spark, d):
    """Hold out the last 4 months of every series; MAPE (%, 1e-6 floor) and RMSE of the
    trend-seasonal forecast made from the rest."""
    tr, te = _split_last(_series(spark, d))
    fc = S.forecast_uncertainty(tr, K, 4)
    j = te.join(fc, ["series_id", "month_start"], "left")
    err = F.col("value") - F.col("forecast_central")
    return j.groupBy("series_id").agg(X.rnd(F.avg(S.mape_pct(F.col("value"), F.col("forecast_central"))), 4).alias("mape"),
                                      X.rnd(F.sqrt(F.avg(err * err)), 4).alias("rmse"),
                                      F.count("forecast_central").alias("matched"))


@query("join_forecast_actual", Q.chain(V("series"), [_TR_SQL, _TE_SQL], Q.uncertainty("tr", K, 4, "fu")) + """
SELECT te.series_id, te.month_start, te.y AS actual, fu.forecast_central, fu.forecast_lower, fu.forecast_upper
FROM te LEFT JOIN fu ON te.series_id = fu.series_id AND te.month_start = fu.month_start""")
def q_join_forecast_actual(spark, d):
    tr, te = _split_last(_series(spark, d))
    fc = S.forecast_uncertainty(tr, K, 4).drop("step")
    return te.withColumnRenamed("value", "actual").join(fc, ["series_id", "month_start"], "left")


@query("append_forecast", Q.chain(V("series"), Q.uncertainty("series", K, 4, "fu")) + """
SELECT series_id, month_start, value AS actual, CAST(NULL AS DOUBLE) AS forecast_central, CAST(NULL AS DOUBLE) AS forecast_lower,
       CAST(NULL AS DOUBLE) AS forecast_upper, 'history' AS kind FROM series
UNION ALL
SELECT series_id, month_start, CAST(NULL AS DOUBLE) AS actual, forecast_central, forecast_lower, forecast_upper, 'forecast' AS kind
FROM fu""")
def q_append_forecast(spark, d):
    s = _series(spark, d)
    hist = s.select("series_id", "month_start", F.col("value").alias("actual"), F.lit("history").alias("kind"))
    fc = S.forecast_uncertainty(s, K, 4).drop("step").withColumn("kind", F.lit("forecast"))
    return hist.unionByName(fc, allowMissingColumns=True)


@query("forecast_totals", Q.chain(V("series"), Q.uncertainty("series", K, 6, "fu")) + f"""
, last_actual AS (SELECT series_id, arg_max(value, month_start) AS last_value FROM series GROUP BY series_id)
SELECT f.series_id, {sql_rnd('sum(forecast_central)', 2)} AS projected_total, {sql_rnd('avg(forecast_central)', 4)} AS monthly_average,
       arg_max(forecast_central, step) AS final_value, arg_max(forecast_upper - forecast_lower, step) AS final_range,
       {sql_rnd('(arg_max(forecast_central, step) - any_value(l.last_value)) / nullif(any_value(l.last_value), 0)', 6)} AS growth_vs_last
FROM fu f JOIN last_actual l ON f.series_id = l.series_id GROUP BY f.series_id""")
def q_forecast_totals(spark, d):
    s = _series(spark, d)
    fc = S.forecast_uncertainty(s, K, 6)
    last = s.groupBy("series_id").agg(F.max_by("value", "month_start").alias("_last"))
    j = fc.join(last, "series_id")
    return j.groupBy("series_id").agg(
        X.rnd(F.sum("forecast_central"), 2).alias("projected_total"),
        X.rnd(F.avg("forecast_central"), 4).alias("monthly_average"),
        F.max_by("forecast_central", "step").alias("final_value"),
        F.max_by(F.col("forecast_upper") - F.col("forecast_lower"), "step").alias("final_range"),
        X.rnd((F.max_by("forecast_central", "step") - F.first("_last")) / F.nullif(F.first("_last"), F.lit(0.0)), 6)
        .alias("growth_vs_last"))


@query("outlook_growth", Q.chain(V("series"), Q.scenario("series", K, 6, "sf", growth=5.0)) + f"""
, last_actual AS (SELECT series_id, arg_max(value, month_start) AS last_value FROM series GROUP BY series_id)
, fin AS (SELECT series_id, arg_max(forecast_central, step) AS c, arg_max(forecast_lower, step) AS lo,
                 arg_max(forecast_upper, step) AS hi FROM sf GROUP BY series_id)
SELECT f.series_id, {sql_rnd('(f.c - l.last_value) / nullif(l.last_value, 0)', 6)} AS likely_change,
       {sql_rnd('(f.lo - l.last_value) / nullif(l.last_value, 0)', 6)} AS low_change,
       {sql_rnd('(f.hi - l.last_value) / nullif(l.last_value, 0)', 6)} AS high_change
FROM fin f JOIN last_actual l ON f.series_id = l.series_id""")
def q_outlook_growth(spark, d):
    """Change of the final scenario month (likely / low / high) against the last actual."""
    s = _series(spark, d)
    sf = S.scenario_forecast(s, K, 6, growth_adjust_pct=5.0)
    fin = sf.groupBy("series_id").agg(F.max_by("forecast_central", "step").alias("c"),
                                      F.max_by("forecast_lower", "step").alias("lo"),
                                      F.max_by("forecast_upper", "step").alias("hi"))
    last = s.groupBy("series_id").agg(F.max_by("value", "month_start").alias("_l"))
    j = fin.join(last, "series_id")
    ch = lambda c: X.rnd((F.col(c) - F.col("_l")) / F.nullif(F.col("_l"), F.lit(0.0)), 6)
    return j.select("series_id", ch("c").alias("likely_change"), ch("lo").alias("low_change"), ch("hi").alias("high_change"))


@query("scenario_grid", Q.chain(V("series"), Q.uncertainty("series", K, 4, "fu")) + f"""
, sc AS (SELECT * FROM (VALUES ('baseline', CAST(0 AS DOUBLE)), ('optimistic', CAST(5 AS DOUBLE)),
                              ('conservative', CAST(-5 AS DOUBLE)), ('stress', CAST(-12 AS DOUBLE))) AS t(scenario, growth))
SELECT f.series_id, sc.scenario, f.step, f.month_start,
       {sql_rnd('greatest(f.forecast_central * (1.0 + sc.growth / 100.0), 0.0)', 2)} AS forecast_central,
       {sql_rnd('greatest(f.forecast_lower * (1.0 + sc.growth / 100.0), 0.0)', 2)} AS forecast_lower,
       {sql_rnd('greatest(f.forecast_upper * (1.0 + sc.growth / 100.0), 0.0)', 2)} AS forecast_upper
FROM fu f CROSS JOIN sc""")
def q_scenario_grid(spark, d):
    """Every series under every preset growth scenario in one job (broadcast scenario table)."""
    from ..operators.risk import SCENARIO_PRESETS
    s = _series(spark, d)
    sc = spark.createDataFrame([(k, v[0]) for k, v in SCENARIO_PRESETS.items()], "scenario string, growth double")
    fc = S.forecast_uncertainty(s, K, 4).crossJoin(F.broadcast(sc))
    mult = 1.0 + F.col("growth") / 100.0
    return fc.select("series_id", "scenario", "step", "month_start",
                     *[X.rnd(F.greatest(F.col(c) * mult, F.lit(0.0)), 2).alias(c)
                       for c in ["forecast_central", "forecast_lower", "forecast_upper"]])


# ---- data-quality snapshot, anomaly root causes and the recommended next action ----

AS_OF = "2002-01-01"


@query("qa_snapshot", Q.chain(V("nation_series"), Q.rolling_backtest("nation_series", K, "rb")) + f"""
, base AS (SELECT series_id, count(*) AS records,
                  {sql_rnd('avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) * 100', 2)} AS missing_ratio,
                  CAST(datediff('day', max(month_start), DATE '{AS_OF}') AS DOUBLE) AS data_lag_days
           FROM nation_series GROUP BY series_id)
, r AS (SELECT series_id, {sql_rnd('CAST(sum(CAST(mape AS DECIMAL(18,2))) AS DOUBLE) / count(mape)', 2)} AS avg_rolling_mape,
                {sql_rnd('CAST(sum(CAST(coverage AS DECIMAL(18,2))) AS DOUBLE) / count(coverage)', 2)} AS avg_rolling_coverage
        FROM rb GROUP BY series_id)
SELECT base.*, r.avg_rolling_mape, r.avg_rolling_coverage FROM base LEFT JOIN r ON base.series_id = r.series_id""")
def q_qa_snapshot(spark, d):
    """Records, missing share, data lag against a fixed as-of date and mean rolling
    back-test quality, for 25 sparse series at once."""
    s = nation_series(Tables(spark, d))
    return S.qa_snapshot(s, S.rolling_backtest(s, K, 6), K, AS_OF)


def _root_cause_sql(src: str) -> str:
    from .q_windows import band_ctes
    return V(src) + band_ctes(src) + f"""
, rf AS (SELECT *, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month_start
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month_start
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v,
                row_number() OVER (PARTITION BY series_id ORDER BY month_start DESC) AS rd FROM {src})
, rc AS (SELECT series_id, CASE WHEN count(v) > 1 THEN stddev_samp(v) / greatest(avg(v), 1e-6) ELSE 0.0 END AS cv
         FROM rf WHERE rd <= 6 GROUP BY series_id)
, se AS (SELECT series_id, month(month_start) AS cm, avg(value) AS sa FROM {src} GROUP BY series_id, month(month_start))
, j AS (SELECT a.series_id, a.month_start, a.value, a.direction, se.sa, rc.cv FROM anom a
        LEFT JOIN se ON se.series_id = a.series_id AND se.cm = month(a.month_start)
        LEFT JOIN rc ON rc.series_id = a.series_id)
, t AS (SELECT *, concat_ws(', ',
          CASE WHEN value > sa * 1.12 THEN 'seasonal demand burst' END,
          CASE WHEN value <= sa * 1.12 AND value < sa * 0.88 THEN 'seasonal slowdown' END,
          CASE WHEN coalesce(cv > 0.18, false) THEN 'high recent volatility' END,
          CASE WHEN contains(lower(direction), 'spike') THEN 'possible campaign or one-off surge' END,
          CASE WHEN contains(lower(direction), 'dip') THEN 'possible operational or demand drop' END) AS txt FROM j)
SELECT series_id, month_start, value, direction,
       CASE WHEN txt = '' THEN 'unusual deviation from recent baseline' ELSE txt END AS root_cause FROM t"""


@query("root_cause_hint", _root_cause_sql("nation_series"))
def q_root_cause_hint(spark, d):
    """Likely drivers of every recent spike/dip of 25 sparse series."""
    from ..operators import windows as Wn
    s = nation_series(Tables(spark, d))
    return S.root_cause_hint(s, Wn.rolling_band_anomalies(s), K)


def _next_action_sql() -> str:
    from .q_windows import band_ctes
    head = Q.chain(V("series"), Q.baseline_backtest("series", K, "bb"), Q.uncertainty("series", K, 4, "fu"))
    return head + band_ctes("series") + """
, rel AS (SELECT series_id, avg(coalesce((forecast_upper - forecast_lower) / nullif(forecast_central, 0.0), 1.0)) AS r
          FROM fu GROUP BY series_id)
, cj AS (SELECT rel.series_id, greatest(0.0, least(100.0, 100.0 - 1.6 * coalesce(bb.mape, 18.0) - 40.0 * rel.r)) AS sc FROM rel
         LEFT JOIN bb ON bb.series_id = rel.series_id AND bb.model = 'Trend-Seasonal Forecast')
, conf AS (SELECT series_id, CASE WHEN sc >= 70 THEN 'High confidence' WHEN sc >= 45 THEN 'Watch closely' ELSE 'Unstable' END AS lbl FROM cj)
, la AS (SELECT series_id, arg_max(value, month_start) AS l FROM series GROUP BY series_id)
, fin AS (SELECT series_id, arg_max(forecast_central, step) AS c FROM fu GROUP BY series_id)
, gr AS (SELECT fin.series_id, (fin.c - la.l) / greatest(1e-6, la.l) AS g FROM fin JOIN la ON fin.series_id = la.series_id)
, lat AS (SELECT series_id, arg_max(direction, month_start) AS dir, max(month_start) AS m FROM anom GROUP BY series_id)
, ids AS (SELECT series_id FROM conf UNION SELECT series_id FROM gr UNION SELECT series_id FROM lat)
SELECT ids.series_id,
  CASE WHEN lat.m IS NOT NULL THEN 'Priority: investigate the latest ' || lower(lat.dir)
            || ' signal and validate source systems for ' || strftime(lat.m, '%Y-%m') || '.'
       WHEN conf.lbl = 'Unstable' THEN 'Priority: rely on baseline models for planning and retrain after reviewing drift and data quality.'
       WHEN gr.g > 0.05 THEN 'Priority: prepare capacity for expected growth and monitor conversion quality weekly.'
       WHEN gr.g < -0.03 THEN 'Priority: activate retention and acquisition checks to mitigate expected slowdown.'
       ELSE 'Priority: maintain current plan and monitor weekly forecast deltas for early movement.' END AS next_action
FROM ids LEFT JOIN conf ON conf.series_id = ids.series_id LEFT JOIN gr ON gr.series_id = ids.series_id
LEFT JOIN lat ON lat.series_id = ids.series_id"""


@query("next_action", _next_action_sql())
def q_next_action(spark, d):
    """One recommendation per series from its anomalies, forecast confidence and growth."""
    from ..operators import windows as Wn
    s = _series(spark, d)
    fc = S.forecast_uncertainty(s, K, 4)
    conf = S.confidence_label(S.baseline_backtest(s, K, 4), fc, K)
    return S.next_action(Wn.rolling_band_anomalies(s), conf, S.growth_vs_last(s, fc, K), K)


@query("seasonal_trend_fit")
def q_seasonal_trend_fit(spark, d):
    """Trend + yearly seasonality (80 % band), 3 months ahead, for every series."""
    return SN.seasonal_trend_fit(_series(spark, d), K, 3)


@query("seasonal_changepoints")
def q_seasonal_changepoints(spark, d):
    """The months at which each series' trend bends, under the seasonal fit's sparse changes of slope."""
    return SN.changepoints(_series(spark, d), K)


@query("ensemble_forecast")
def q_ensemble_forecast(spark, d):
    """Average of the trend-seasonal and the seasonal-trend-fit forecasts, 4 months."""
    return S.ensemble_forecast(_series(spark, d), K, 4)


@query("volume_forecast_recursive")
def q_volume_forecast_recursive(spark, d):
    """Six-month recursive forecast of every grade and the total under the conservative
    scenario: 0.7 x boosted trees + 0.3 x linear, fed back step by step."""
    from ..operators import serving
    from ..sources.domain import volume_panel
    return serving.volume_forecast_recursive(volume_panel(Tables(spark, d)), K, 6, "conservative")
