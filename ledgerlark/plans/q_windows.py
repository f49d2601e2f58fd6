"""Queries for window operators over many series and series tails (§2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import sql_rnd
from ..operators import aggregate as A
from ..operators import windows as W
from ..sources.domain import Tables, clean_loans, nation_series, series
from .registry import query
from .sql_views import with_views as V

P = "PARTITION BY series_id ORDER BY month_start"


def _s(spark, d):
    return series(Tables(spark, d))


@query("lag_features", V("series") + f"""
SELECT series_id, month_start, value, lag(value, 1) OVER ({P}) AS lag_1, lag(value, 2) OVER ({P}) AS lag_2,
       lag(value, 3) OVER ({P}) AS lag_3, lag(value, 6) OVER ({P}) AS lag_6, lag(value, 12) OVER ({P}) AS lag_12
FROM series""")
def q_lag_features(spark, d):
    return W.lag_features(_s(spark, d))


def _sql_roll(k):
    frame = f"({P} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(value) OVER {frame} = {k} THEN {sql_rnd(f'avg(value) OVER {frame}', 6)} END AS rolling_mean_{k}"


@query("rolling_shifted_mean", V("series") + f"""
SELECT series_id, month_start, value, {_sql_roll(3)}, {_sql_roll(6)}, {_sql_roll(12)} FROM series""")
def q_rolling_shifted_mean(spark, d):
    r = W.rolling_shifted_mean(_s(spark, d))
    return r.withColumns({f"rolling_mean_{k}": X.rnd(F.col(f"rolling_mean_{k}"), 6) for k in (3, 6, 12)})


_GROWTH = f"""(last_value(value IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
   / nullif(last_value(value IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1)"""


@query("mom_growth", V("nation_series") + f"SELECT series_id, month_start, value, {_GROWTH} AS mom_growth FROM nation_series")
def q_mom_growth(spark, d):
    """pct_change with the previous value forward-filled; /0 -> NULL (not inf)."""
    return W.mom_growth(nation_series(Tables(spark, d)))


@query("training_frame", V("series") + f"""
, b AS (
  SELECT series_id, month_start, value,
         CAST(month(month_start) AS INTEGER) AS month, CAST(quarter(month_start) AS INTEGER) AS quarter,
         CAST(year(month_start) AS INTEGER) AS year,
         lag(value, 1) OVER ({P}) AS lag_1, lag(value, 2) OVER ({P}) AS lag_2, lag(value, 3) OVER ({P}) AS lag_3,
         lag(value, 6) OVER ({P}) AS lag_6, lag(value, 12) OVER ({P}) AS lag_12,
         {_sql_roll(3)}, {_sql_roll(6)}, {_sql_roll(12)}, {_GROWTH} AS g
  FROM series)
, c AS (SELECT *, lag(g, 1) OVER ({P}) AS mom_growth FROM b)
SELECT series_id, month_start, value, month, quarter, year, lag_1, lag_2, lag_3, lag_6, lag_12,
       rolling_mean_3, rolling_mean_6, rolling_mean_12, mom_growth
FROM c WHERE lag_12 IS NOT NULL AND rolling_mean_12 IS NOT NULL AND mom_growth IS NOT NULL""")
def q_training_frame(spark, d):
    """Calendar, lags, shifted rolling means and previous-month growth; rows with any
    missing feature dropped. Growth is lagged one month so the target is not leaked."""
    t = W.training_frame(_s(spark, d))
    return t.withColumns({f"rolling_mean_{k}": X.rnd(F.col(f"rolling_mean_{k}"), 6) for k in (3, 6, 12)})


@query("ffill_bfill", V("nation_series") + f"""
SELECT series_id, month_start, value,
       coalesce(last_value(value IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(value IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value_filled
FROM nation_series""")
def q_ffill_bfill(spark, d):
    return W.ffill_bfill(nation_series(Tables(spark, d)), out="value_filled")


def band_ctes(src: str, out: str = "anom") -> str:
    """CTEs ending in ``out``: the last 8 Spike/Dip rows per series (value rounded to 2)."""
    fr = f"({P} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    return f"""
, {out}_f AS (SELECT series_id, month_start,
          coalesce(last_value(value IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   first_value(value IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM {src})
, {out}_b AS (SELECT *, CASE WHEN count(v) OVER {fr} >= 3 THEN avg(v) OVER {fr} END AS m,
               coalesce(CASE WHEN count(v) OVER {fr} >= 3 THEN stddev_samp(v) OVER {fr} END, 0.0) AS sd FROM {out}_f)
, {out}_c AS (SELECT *, m + 1.8 * sd AS upper, m - 1.8 * sd AS lower FROM {out}_b)
, {out}_e AS (SELECT *, CASE WHEN v > upper THEN 'Spike' WHEN v < lower THEN 'Dip' END AS direction FROM {out}_c)
, {out}_g AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month_start DESC) AS rn FROM {out}_e WHERE direction IS NOT NULL)
, {out} AS (SELECT series_id, month_start, {sql_rnd('v', 2)} AS value, lower, upper, direction FROM {out}_g WHERE rn <= 8)
"""


def _sql_band(src: str) -> str:
    return band_ctes(src) + f"""SELECT series_id, month_start, value, {sql_rnd('lower', 4)} AS lower, {sql_rnd('upper', 4)} AS upper,
       direction FROM anom"""


@query("rolling_band_anomalies", V("nation_series") + _sql_band("nation_series"))
def q_rolling_band_anomalies(spark, d):
    a = W.rolling_band_anomalies(nation_series(Tables(spark, d)))
    return a.withColumns({"value": X.rnd(F.col("value"), 2), "lower": X.rnd(F.col("lower"), 4), "upper": X.rnd(F.col("upper"), 4)})


@query("series_tail", V("series") + """
SELECT series_id, month_start, value FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month_start DESC) AS rn FROM series) t WHERE rn <= 3""")
def q_series_tail(spark, d):
    return W.series_tail(_s(spark, d), 3)


@query("diff_volatility", V("series") + f"""
, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month_start DESC) AS rn FROM series) x WHERE rn <= 12)
, dd AS (SELECT series_id, value - lag(value) OVER ({P}) AS d FROM t)
SELECT series_id, {sql_rnd('stddev_pop(d)', 6)} AS diff_std FROM dd GROUP BY series_id""")
def q_diff_volatility(spark, d):
    v = W.diff_volatility(_s(spark, d), 12)
    return v.withColumn("diff_std", X.rnd(F.col("diff_std"), 6))


@query("minmax_normalize", V("monthly_volume") + f"""
, s AS (SELECT min(funded_amnt) AS a1, max(funded_amnt) AS b1, min(loan_count) AS a2, max(loan_count) AS b2,
               min(avg_int_rate) AS a3, max(avg_int_rate) AS b3 FROM monthly_volume)
SELECT month_start,
  {sql_rnd('CASE WHEN b1 - a1 < 1e-12 THEN 1.0 ELSE (funded_amnt - a1) / (b1 - a1) END', 6)} AS funded_amnt_norm,
  {sql_rnd('CASE WHEN b2 - a2 < 1e-12 THEN 1.0 ELSE (loan_count - a2) / (b2 - a2) END', 6)} AS loan_count_norm,
  {sql_rnd('CASE WHEN b3 - a3 < 1e-12 THEN 1.0 ELSE (avg_int_rate - a3) / (b3 - a3) END', 6)} AS avg_int_rate_norm,
  CAST(1 AS DOUBLE) AS flat_norm
FROM monthly_volume CROSS JOIN s""")
def q_minmax_normalize(spark, d):
    """Min-max scaling; a flat column scores 1 everywhere (``flat_norm``)."""
    m = A.monthly_volume(clean_loans(Tables(spark, d))).withColumn("flat", F.lit(5.0))
    n = W.minmax_normalize(m, ["funded_amnt", "loan_count", "avg_int_rate", "flat"])
    return n.select("month_start", *[X.rnd(F.col(f"{c}_norm"), 6).alias(f"{c}_norm")
                                     for c in ["funded_amnt", "loan_count", "avg_int_rate"]],
                    F.col("flat_norm"))


@query("serve_features", V("series") + f"""
, t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month_start DESC) AS rd FROM series)
, a AS (SELECT series_id, max(month_start) AS last_month,
          max(CASE WHEN rd = 1 THEN value END) AS lag_1, max(CASE WHEN rd = 2 THEN value END) AS lag_2,
          max(CASE WHEN rd = 3 THEN value END) AS lag_3, max(CASE WHEN rd = 6 THEN value END) AS lag_6,
          max(CASE WHEN rd = 12 THEN value END) AS lag_12,
          avg(CASE WHEN rd <= 3 THEN value END) AS r3, avg(CASE WHEN rd <= 6 THEN value END) AS r6,
          avg(CASE WHEN rd <= 12 THEN value END) AS r12
        FROM t GROUP BY series_id)
, cov AS (SELECT grade AS series_id, month_start, avg_int_rate, loan_count, funded_amnt / loan_count AS avg_loan_amnt, funded_amnt_m AS v FROM grade_monthly
          UNION ALL SELECT 'TOTAL', month_start, avg_int_rate, loan_count, avg_loan_amnt, funded_amnt_m FROM monthly_volume)
, lc AS (SELECT series_id, arg_max(avg_int_rate, month_start) AS avg_int_rate, arg_max(avg_loan_amnt, month_start) AS avg_loan_amnt,
                greatest(1.0, greatest(1.0, avg(loan_count)) * (greatest((SELECT arg_max(v, month_start) FROM cov WHERE series_id = 'TOTAL'), 1.0)
                         / greatest(avg(v), 1.0))) AS loan_count FROM cov GROUP BY series_id)
SELECT series_id, CAST(last_month + INTERVAL 1 MONTH AS DATE) AS month_start,
       CAST(month(last_month + INTERVAL 1 MONTH) AS INTEGER) AS month,
       CAST(quarter(last_month + INTERVAL 1 MONTH) AS INTEGER) AS quarter,
       CAST(year(last_month + INTERVAL 1 MONTH) AS INTEGER) AS year,
       lag_1, coalesce(lag_2, lag_1) AS lag_2, coalesce(lag_3, lag_1) AS lag_3, coalesce(lag_6, lag_1) AS lag_6,
       coalesce(lag_12, lag_1) AS lag_12, {sql_rnd('r3', 6)} AS rolling_3, {sql_rnd('r6', 6)} AS rolling_6, {sql_rnd('r12', 6)} AS rolling_12,
       {sql_rnd('CASE WHEN lag_2 IS NULL OR lag_2 = 0 THEN 0.0 ELSE (lag_1 - lag_2) / abs(lag_2) END', 6)} AS mom_growth,
       {sql_rnd('avg_int_rate', 6)} AS avg_int_rate, {sql_rnd('avg_loan_amnt', 4)} AS avg_loan_amnt, {sql_rnd('loan_count', 6)} AS loan_count
FROM a JOIN lc USING (series_id)""")
def q_serve_features(spark, d):
    """Feature row for the next (unseen) month of every series: lags (missing -> lag 1),
    rolling means over the available last 3/6/12 values, growth over |previous|; rate and amount
    last known, loan count scaled by the last total."""
    from ..operators import serving
    from ..sources.domain import volume_panel
    panel = volume_panel(Tables(spark, d))
    hint = panel.filter("series_id = 'TOTAL'").agg(F.max_by("value", "month_start").alias("total_hint"))
    f = serving.next_month_features(_s(spark, d))
    f = f.join(serving.last_covariates(panel).drop("loan_count"), "series_id").join(serving.scaled_loan_count(panel, hint), "series_id")
    digits = {"rolling_3": 6, "rolling_6": 6, "rolling_12": 6, "mom_growth": 6, "avg_int_rate": 6, "avg_loan_amnt": 4, "loan_count": 6}
    return f.withColumns({c: X.rnd(F.col(c), n) for c, n in digits.items()})
