"""Queries for pivots, profiles, summaries, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import sql_rnd
from ..operators import aggregate as A
from ..operators import series as S
from ..sources.domain import Tables, clean_loans, series
from ..sources.tables import read_table
from . import sql_series as Q
from .registry import query
from .sql_views import with_views as V

GR = ["A", "B", "C", "D", "E"]


def _gm(spark, d):
    return A.grade_monthly(clean_loans(Tables(spark, d)))


@query("grade_pivot", V("grade_monthly") + "SELECT month_start, "
       + ", ".join(f"coalesce(sum(CASE WHEN grade = '{g}' THEN funded_amnt_m END), 0.0) AS {g}" for g in GR)
       + " FROM grade_monthly GROUP BY month_start")
def q_grade_pivot(spark, d):
    return A.grade_pivot(_gm(spark, d))


@query("grade_seasonality", V("grade_monthly") + f"""
, g AS (SELECT grade, CAST(month(month_start) AS INTEGER) AS cal_month, avg(funded_amnt_m) AS avg_value FROM grade_monthly GROUP BY 1, 2)
, spine AS (SELECT grade, CAST(m AS INTEGER) AS cal_month FROM (VALUES {", ".join(f"('{g}')" for g in GR)}) t(grade)
            CROSS JOIN range(1, 13) r(m))
SELECT s.grade, s.cal_month, {sql_rnd('coalesce(g.avg_value, 0.0)', 6)} AS avg_value
FROM spine s LEFT JOIN g ON s.grade = g.grade AND s.cal_month = g.cal_month""")
def q_grade_seasonality(spark, d):
    s = A.grade_seasonality(_gm(spark, d))
    return s.withColumn("avg_value", X.rnd(F.col("avg_value"), 6))


@query("year_month_heatmap", V("grade_monthly") + "SELECT grade, CAST(year(month_start) AS INTEGER) AS year, "
       + ", ".join(f"avg(CASE WHEN month(month_start) = {m} THEN funded_amnt_m END) AS m{m:02d}" for m in range(1, 13))
       + " FROM grade_monthly GROUP BY 1, 2")
def q_year_month_heatmap(spark, d):
    return A.year_month_heatmap(_gm(spark, d))


def _grade_fc(spark, d):
    s = series(Tables(spark, d)).filter(F.col("series_id").isin(GR))
    return S.forecast_uncertainty(s, ["series_id"], 4)


_FCW = "".join(
    f", max(CASE WHEN series_id = '{g}' THEN forecast_central END) AS {g}_central, "
    f"max(CASE WHEN series_id = '{g}' THEN forecast_lower END) AS {g}_lower, "
    f"max(CASE WHEN series_id = '{g}' THEN forecast_upper END) AS {g}_upper, "
    f"max(CASE WHEN series_id = '{g}' THEN greatest(0.0, forecast_upper - forecast_lower) END) AS {g}_range" for g in GR)


@query("forecast_wide", Q.chain(V("series") + ", gs AS (SELECT * FROM series WHERE series_id IN ('A','B','C','D','E'))",
                                Q.uncertainty("gs", ["series_id"], 4, "fu")) + f"SELECT month_start{_FCW} FROM fu GROUP BY month_start")
def q_forecast_wide(spark, d):
    return A.forecast_wide(_grade_fc(spark, d))


@query("grade_forecast_insights", Q.chain(V("series") + ", gs AS (SELECT * FROM series WHERE series_id IN ('A','B','C','D','E'))",
                                          Q.uncertainty("gs", ["series_id"], 4, "fu")) + f"""
, per AS (SELECT series_id AS grade, sum(forecast_central) AS horizon_total,
                 (arg_max(forecast_central, step) - arg_min(forecast_central, step)) / nullif(arg_min(forecast_central, step), 0) AS growth,
                 avg(forecast_upper - forecast_lower) AS mean_band FROM fu GROUP BY series_id)
SELECT grade, {sql_rnd('horizon_total', 2)} AS horizon_total, {sql_rnd('growth', 6)} AS growth, {sql_rnd('mean_band', 4)} AS mean_band,
       grade = (SELECT arg_max(grade, horizon_total) FROM per) AS is_largest,
       grade = (SELECT arg_max(grade, growth) FROM per) AS is_fastest_growing,
       grade = (SELECT arg_max(grade, mean_band) FROM per) AS is_most_uncertain
FROM per""")
def q_grade_forecast_insights(spark, d):
    """Per grade: horizon total, first-to-last growth, mean band width, and which grade
    leads each (argmax over the 5-row table)."""
    fc = _grade_fc(spark, d)
    first = F.min_by("forecast_central", "step")
    per = fc.groupBy(F.col("series_id").alias("grade")).agg(
        F.sum("forecast_central").alias("horizon_total"),
        ((F.max_by("forecast_central", "step") - first) / F.nullif(first, F.lit(0.0))).alias("growth"),
        F.avg(F.col("forecast_upper") - F.col("forecast_lower")).alias("mean_band"))
    lead = per.agg(F.max_by("grade", "horizon_total").alias("_a"), F.max_by("grade", "growth").alias("_b"),
                   F.max_by("grade", "mean_band").alias("_c"))
    j = per.crossJoin(F.broadcast(lead))
    return j.select("grade", X.rnd(F.col("horizon_total"), 2).alias("horizon_total"), X.rnd(F.col("growth"), 6).alias("growth"),
                    X.rnd(F.col("mean_band"), 4).alias("mean_band"), (F.col("grade") == F.col("_a")).alias("is_largest"),
                    (F.col("grade") == F.col("_b")).alias("is_fastest_growing"),
                    (F.col("grade") == F.col("_c")).alias("is_most_uncertain"))


@query("risk_distribution", V("grade_monthly") + f"""
, latest AS (SELECT * FROM grade_monthly WHERE month_start = (SELECT max(month_start) FROM grade_monthly))
, t AS (SELECT coalesce(sum(CASE WHEN grade IN ('A', 'B') THEN funded_amnt_m END), 0.0) AS low_risk,
               coalesce(sum(CASE WHEN grade = 'C' THEN funded_amnt_m END), 0.0) AS medium_risk,
               coalesce(sum(CASE WHEN grade IN ('D', 'E') THEN funded_amnt_m END), 0.0) AS high_risk FROM latest)
SELECT *, {sql_rnd('CASE WHEN low_risk + medium_risk + high_risk > 0 THEN high_risk / (low_risk + medium_risk + high_risk) * 100 ELSE 0.0 END', 4)} AS high_share_pct,
       CASE WHEN (CASE WHEN low_risk + medium_risk + high_risk > 0 THEN high_risk / (low_risk + medium_risk + high_risk) * 100 ELSE 0.0 END) >= 35 THEN 'danger'
            WHEN (CASE WHEN low_risk + medium_risk + high_risk > 0 THEN high_risk / (low_risk + medium_risk + high_risk) * 100 ELSE 0.0 END) >= 20 THEN 'warning'
            ELSE 'success' END AS tone
FROM t""")
def q_risk_distribution(spark, d):
    """Latest month's demand by risk tier (A+B / C / D+E), high-risk share and tone."""
    g = _gm(spark, d)
    latest = g.agg(F.max("month_start").alias("_m"))
    cur = g.join(F.broadcast(latest), g.month_start == latest._m)
    t = cur.agg(F.coalesce(F.sum(F.when(F.col("grade").isin("A", "B"), F.col("funded_amnt_m"))), F.lit(0.0)).alias("low_risk"),
                F.coalesce(F.sum(F.when(F.col("grade") == "C", F.col("funded_amnt_m"))), F.lit(0.0)).alias("medium_risk"),
                F.coalesce(F.sum(F.when(F.col("grade").isin("D", "E"), F.col("funded_amnt_m"))), F.lit(0.0)).alias("high_risk"))
    tot = F.col("low_risk") + F.col("medium_risk") + F.col("high_risk")
    share = F.when(tot > 0, F.col("high_risk") / tot * 100).otherwise(F.lit(0.0))
    return t.select("*", X.rnd(share, 4).alias("high_share_pct"),
                    F.when(share >= 35, "danger").when(share >= 20, "warning").otherwise("success").alias("tone"))


_CAT = ["grade", "home_ownership", "purpose", "term", "loan_status"]


@query("distinct_values", V("clean_loans") + " UNION ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM clean_loans" for c in _CAT))
def q_distinct_values(spark, d):
    return A.distinct_values(clean_loans(Tables(spark, d)), _CAT)


_PROF = [("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
         ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_linenumber", "int")]


def _sql_profile() -> str:
    parts = []
    for c, t in _PROF:
        mean = (sql_rnd(f"CAST(sum(CAST({c} AS DECIMAL(38,2))) AS DOUBLE) / count({c})", 6) if t != "string"
                else "CAST(NULL AS DOUBLE)")
        parts.append(f"SELECT '{c}' AS column_name, '{t}' AS data_type, "
                     f"round(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS null_pct, {mean} AS mean, "
                     f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, "
                     f"count(DISTINCT {c}) AS unique_count FROM lineitem")
    return " UNION ALL ".join(parts)


@query("column_profile", _sql_profile())
def q_column_profile(spark, d):
    li = read_table(spark, d, "lineitem")
    p = A.column_profile(li, [c for c, _ in _PROF], mean_scale=2)
    return p.withColumn("mean", X.rnd(F.col("mean"), 6))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sql_corr() -> str:
    ranks = ", ".join(f"(rank() OVER (ORDER BY {c}) + count(*) OVER (ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 AS r_{c}"
                      for c in _CORR)
    pairs = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]
    sel = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {sql_rnd(f'corr({a}, {b})', 6)} AS pearson, {sql_rnd(f'corr(r_{a}, r_{b})', 6)} AS spearman FROM rk"
        for a, b in pairs)
    return f"WITH rk AS (SELECT {', '.join(_CORR)}, {ranks} FROM lineitem) {sel}"


@query("correlation_matrix", _sql_corr())
def q_correlation_matrix(spark, d):
    li = read_table(spark, d, "lineitem").select(*_CORR)
    c = A.correlation_matrix(li, _CORR)
    return c.withColumns({"pearson": X.rnd(F.col("pearson"), 6), "spearman": X.rnd(F.col("spearman"), 6)})


@query("head_limit", V("clean_loans") + """
SELECT loan_id, loan_status, funded_amnt FROM clean_loans ORDER BY issue_d DESC, loan_id LIMIT 30""")
def q_head_limit(spark, d):
    """First n rows by an explicit key (the reference relies on file order)."""
    c = clean_loans(Tables(spark, d))
    return c.orderBy(F.col("issue_d").desc(), "loan_id").limit(30).select("loan_id", "loan_status", "funded_amnt")


@query("join_scenario_delta", Q.chain(V("series"), Q.scenario("series", ["series_id"], 6, "base"),
                                      Q.scenario("series", ["series_id"], 6, "stressed", growth=-12.0)) + """
SELECT b.series_id, b.month_start, b.forecast_central AS baseline_central, s.forecast_central AS scenario_central,
       s.forecast_central - b.forecast_central AS delta
FROM base b JOIN stressed s ON b.series_id = s.series_id AND b.month_start = s.month_start""")
def q_join_scenario_delta(spark, d):
    """Scenario vs baseline forecast: inner self-join on (series, month) and the delta."""
    s = series(Tables(spark, d))
    b = S.scenario_forecast(s, ["series_id"], 6).alias("b")
    st = S.scenario_forecast(s, ["series_id"], 6, growth_adjust_pct=-12.0).alias("s")
    j = b.join(st, ["series_id", "month_start"])
    return j.select("series_id", "month_start", F.col("b.forecast_central").alias("baseline_central"),
                    F.col("s.forecast_central").alias("scenario_central"),
                    (F.col("s.forecast_central") - F.col("b.forecast_central")).alias("delta"))


@query("cross_grade_shares", V("monthly_volume", "grade_monthly") + f"""
, sh AS (SELECT grade, sum(funded_amnt) / (SELECT sum(funded_amnt) FROM grade_monthly) AS share FROM grade_monthly GROUP BY grade)
SELECT m.month_start, sh.grade, {sql_rnd('m.funded_amnt_m * sh.share', 6)} AS funded_amnt_m FROM monthly_volume m CROSS JOIN sh""")
def q_cross_grade_shares(spark, d):
    """Monthly totals spread over grades by their overall shares: month x grade via a
    broadcast cross join with the 5-row share table."""
    c = clean_loans(Tables(spark, d))
    g = A.grade_monthly(c)
    tot = g.agg(F.sum("funded_amnt").alias("_t"))
    sh = g.groupBy("grade").agg(F.sum("funded_amnt").alias("_g")).crossJoin(F.broadcast(tot)).select(
        "grade", (F.col("_g") / F.col("_t")).alias("share"))
    m = A.monthly_volume(c)
    return m.crossJoin(F.broadcast(sh)).select("month_start", "grade", X.rnd(F.col("funded_amnt_m") * F.col("share"), 6).alias("funded_amnt_m"))


# The features of the default importances.
_DEFAULT_FEATURES = ["month", "quarter", "year", "lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "rolling_3", "rolling_6",
                     "avg_int_rate", "loan_count", "mom_growth"]
# Fallback importance weights for the grade models (others 0.01).
_DEFAULT_WEIGHTS = {"lag_1": 0.26, "rolling_3": 0.2, "rolling_6": 0.15, "lag_3": 0.12, "lag_6": 0.08, "mom_growth": 0.07,
                    "loan_count": 0.06, "month": 0.04, "quarter": 0.02}


@query("default_importance", V("grade_monthly") + """
, fs AS (SELECT DISTINCT grade FROM grade_monthly)
, w AS (SELECT * FROM (VALUES """ + ", ".join(f"('{f}', CAST({_DEFAULT_WEIGHTS.get(f, 0.01)} AS DOUBLE))" for f in _DEFAULT_FEATURES) + """) t(feature, w))
, n AS (SELECT fs.grade, w.feature, w.w / sum(w.w) OVER (PARTITION BY fs.grade) AS importance FROM fs CROSS JOIN w)
SELECT grade, feature, round(importance, 8) AS importance FROM (
  SELECT *, row_number() OVER (PARTITION BY grade ORDER BY importance DESC, feature) AS rn FROM n) t WHERE rn <= 6""")
def q_default_importance(spark, d):
    """Fallback feature importance for every grade present: fixed weights normalised,
    top 6 (the weight table is a literal broadcast to the grade list)."""
    grades = _gm(spark, d).select("grade").distinct()
    w = spark.createDataFrame([(f, float(_DEFAULT_WEIGHTS.get(f, 0.01))) for f in _DEFAULT_FEATURES], "feature string, w double")
    n = grades.crossJoin(F.broadcast(w)).withColumn("importance", F.col("w") / F.sum("w").over(Window.partitionBy("grade")))
    rn = F.row_number().over(Window.partitionBy("grade").orderBy(F.col("importance").desc(), "feature"))
    return n.withColumn("_rn", rn).filter("_rn <= 6").select("grade", "feature", F.round("importance", 8).alias("importance"))
