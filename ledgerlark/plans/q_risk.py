"""Queries for stress testing, score blending, labels, rules and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import sql_rnd
from ..operators import aggregate as A
from ..operators import risk as K
from ..sources.domain import Tables, campaign, clean_loans
from .registry import query
from .sql_views import with_views as V

SCENARIOS = [("baseline", 0.0, 0.0, 0.0), ("rate_shock", 150.0, 10.0, 4.0), ("mild", 50.0, 5.0, 2.9), ("severe", 300.0, 20.0, 6.0)]
_SCEN_SQL = "(VALUES " + ", ".join(
    f"('{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for n, a, b, c in SCENARIOS) + \
    ") AS s(scenario, rate_bps, income_drop_pct, dti_bump)"


@query("stress_scenario", V("clean_loans") + f"""
SELECT l.loan_id, s.scenario,
       l.int_rate + s.rate_bps / CAST(100 AS DOUBLE) AS int_rate,
       l.annual_inc * (1 - s.income_drop_pct / CAST(100 AS DOUBLE)) AS annual_inc,
       l.dti + s.dti_bump AS dti,
       CASE WHEN s.dti_bump >= 3 THEN least(greatest(CAST(l.delinq_2yrs AS DOUBLE) + 1, 0.0), 10.0)
            ELSE CAST(l.delinq_2yrs AS DOUBLE) END AS delinq_2yrs
FROM clean_loans l CROSS JOIN {_SCEN_SQL}""")
def q_stress_scenario(spark, d):
    lo = clean_loans(Tables(spark, d)).select("loan_id", "int_rate", "annual_inc", "dti", "delinq_2yrs")
    return K.stress_grid(lo, K.scenario_table(spark, SCENARIOS))


def _scored(spark, d):
    return K.standin_scores(clean_loans(Tables(spark, d)))


_SCORE = "CAST(0.6 AS DOUBLE) * default_probability + CAST(0.4 AS DOUBLE) * churn_probability"


@query("risk_score_band", V("scored_loans") + f"""
SELECT loan_id, default_probability, churn_probability, {_SCORE} AS risk_score,
       CASE WHEN {_SCORE} <= 0.30 THEN 'Low' WHEN {_SCORE} <= 0.55 THEN 'Medium' ELSE 'High' END AS risk_band
FROM scored_loans""")
def q_risk_score_band(spark, d):
    return K.risk_score_band(_scored(spark, d)).select("loan_id", "default_probability", "churn_probability", "risk_score",
                                                       "risk_band")


@query("probability_labels", V("scored_loans") + """
SELECT loan_id,
  CASE WHEN default_probability >= 0.65 THEN 'High' WHEN default_probability >= 0.35 THEN 'Medium' ELSE 'Low' END AS bridge_label,
  CASE WHEN default_probability >= 0.5 THEN 'High' WHEN default_probability >= 0.3 THEN 'Medium' ELSE 'Low' END AS default_tier,
  CASE WHEN default_probability >= 0.30 THEN 'DEFAULT' ELSE 'REPAY' END AS default_decision,
  CASE WHEN churn_probability >= 0.6 THEN 'High' WHEN churn_probability >= 0.4 THEN 'Medium' ELSE 'Low' END AS churn_tier,
  CASE WHEN churn_probability >= 0.5 THEN 'CHURNED' ELSE 'RETAINED' END AS churn_decision,
  CASE WHEN default_probability >= 0.6 THEN 'Likely Subscribe' ELSE 'Low Intent' END AS deposit_label
FROM scored_loans""")
def q_probability_labels(spark, d):
    return K.probability_labels(_scored(spark, d)).select(
        "loan_id", "bridge_label", "default_tier", "default_decision", "churn_tier", "churn_decision", "deposit_label")


def _sql_actions() -> str:
    parts = [f"WHEN churn_probability >= {t} THEN '{' | '.join(K.RETENTION_ACTIONS[l])}'"
             for t, l in zip([0.65, 0.35], ["High", "Medium"])]
    return "CASE " + " ".join(parts) + f" ELSE '{' | '.join(K.RETENTION_ACTIONS['Low'])}' END"


@query("retention_actions", V("scored_loans") + f"""
SELECT loan_id, CASE WHEN churn_probability >= 0.65 THEN 'High' WHEN churn_probability >= 0.35 THEN 'Medium' ELSE 'Low' END
       AS retention_tier, {_sql_actions()} AS suggestions FROM scored_loans""")
def q_retention_actions(spark, d):
    r = K.retention_actions(_scored(spark, d))
    return r.select("loan_id", "retention_tier", F.array_join("suggestions", " | ").alias("suggestions"))


_TOP3 = ["duration", "poutcome_success", "pdays"]


def _propensity(col="client_id"):
    return (F.col(col) * 37 % 1000) / 1000.0 + 0.0003


@query("campaign_advice", V("campaign") + f"""
, p AS (SELECT client_id, CAST((client_id * 37) % 1000 AS DOUBLE) / 1000.0 + 0.0003 AS propensity FROM campaign)
SELECT client_id, propensity,
  CASE WHEN propensity >= 0.6 THEN '{K.CAMPAIGN_TONES[0][1]}' WHEN propensity >= 0.4 THEN '{K.CAMPAIGN_TONES[1][1]}'
       ELSE '{K.CAMPAIGN_TONES[2][1]}' END AS tone,
  'Model `Random Forest` indicates **' ||
  CASE WHEN propensity >= 0.6 THEN '{K.CAMPAIGN_TONES[0][1]}' WHEN propensity >= 0.4 THEN '{K.CAMPAIGN_TONES[1][1]}'
       ELSE '{K.CAMPAIGN_TONES[2][1]}' END || '** to subscribe (probability ' || printf('%.1f%%', propensity * 100) ||
  '). Primary drivers: {", ".join(_TOP3)}. Recommendation: ' ||
  CASE WHEN propensity >= 0.6 THEN '{K.CAMPAIGN_TONES[0][2]}' WHEN propensity >= 0.4 THEN '{K.CAMPAIGN_TONES[1][2]}'
       ELSE '{K.CAMPAIGN_TONES[2][2]}' END AS advice
FROM p""")
def q_campaign_advice(spark, d):
    """Advice text per client from a deterministic stand-in propensity and a fixed
    driver list (the model-backed version feeds ``score_deposit`` output)."""
    c = campaign(Tables(spark, d)).select("client_id").withColumn(
        "propensity", (F.col("client_id") * 37 % 1000).cast("double") / 1000.0 + 0.0003)
    out = K.campaign_advice(c, "propensity", F.lit("Random Forest"), F.array(*[F.lit(f) for f in _TOP3]))
    return out.select("client_id", "propensity", "tone", "advice")


@query("churn_label", V("clean_loans") + r"""
SELECT loan_id,
  CAST((year(last_pymnt_d) - year(issue_d)) * 12 + (month(last_pymnt_d) - month(issue_d)) AS INTEGER) AS actual_months,
  TRY_CAST(regexp_extract(term, '(\d+)', 1) AS DOUBLE) AS term_months,
  CAST(coalesce((year(last_pymnt_d) - year(issue_d)) * 12 + (month(last_pymnt_d) - month(issue_d))
       >= TRY_CAST(regexp_extract(term, '(\d+)', 1) AS DOUBLE) * 0.85, false) AS INTEGER) AS churn_flag
FROM clean_loans WHERE loan_status = 'Fully Paid'""")
def q_churn_label(spark, d):
    return K.churn_label(clean_loans(Tables(spark, d))).select("loan_id", "actual_months", "term_months", "churn_flag")


def _requests(spark, d):
    g = A.grade_monthly(clean_loans(Tables(spark, d)))
    m = F.month("month_start")
    return g.select(
        "month_start", "grade",
        F.when(m % 5 == 0, "baseline").when(m % 5 == 1, " Optimistic").when(m % 5 == 2, "conservative")
        .when(m % 5 == 3, "stress").otherwise("panic").alias("scenario"),
        (F.col("loan_count") % 15).cast("string").alias("horizon_raw"),
        (F.col("loan_count") - 40.0).alias("user_growth"),
        (m * 50 - 300.0).alias("user_rate"),
        F.when(m % 2 == 0, F.lit(None).cast("double")).otherwise(m * 12 - 60.0).alias("user_count"),
        F.lit(0.0).alias("user_amount"),
        ((F.col("loan_count") % 60) / 60.0 + 0.45).alias("confidence"),
        (F.col("funded_amnt_m") - 5).alias("base_volume"),
    )


_REQ_SQL = """
, req AS (
  SELECT month_start, grade,
    CASE month(month_start) % 5 WHEN 0 THEN 'baseline' WHEN 1 THEN ' Optimistic' WHEN 2 THEN 'conservative'
         WHEN 3 THEN 'stress' ELSE 'panic' END AS scenario,
    CAST(loan_count % 15 AS VARCHAR) AS horizon_raw,
    loan_count - CAST(40 AS DOUBLE) AS user_growth,
    month(month_start) * 50 - CAST(300 AS DOUBLE) AS user_rate,
    CASE WHEN month(month_start) % 2 = 0 THEN NULL ELSE month(month_start) * 12 - CAST(60 AS DOUBLE) END AS user_count,
    CAST(0 AS DOUBLE) AS user_amount,
    CAST(loan_count % 60 AS DOUBLE) / 60.0 + 0.45 AS confidence,
    funded_amnt_m - 5 AS base_volume
  FROM grade_monthly)
"""


def _sql_scenario_parameters() -> str:
    presets = "(VALUES " + ", ".join(
        f"('{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({e} AS DOUBLE), CAST({m} AS DOUBLE))"
        for k, (a, b, c, e, m) in K.SCENARIO_PRESETS.items()) + ") AS p(scenario, p_growth, p_rate, p_count, p_amount, risk_multiplier)"
    names = {"growth": "growthAdjustmentPct", "rate": "interestRateShockBps", "count": "loanCountChangePct",
             "amount": "avgLoanAmountChangePct"}
    checks = ["CASE WHEN p.p_growth IS NULL THEN 'Unsupported scenario' END",
              "CASE WHEN h IS NULL THEN 'Invalid numeric value for horizonMonths' END",
              "CASE WHEN h < 1 OR h > 12 THEN 'horizonMonths must be between 1 and 12' END"]
    for k, (lo, hi) in K.USER_BOUNDS.items():
        c = f"coalesce(user_{k}, 0.0)"
        checks.append(f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{names[k]} must be between {lo} and {hi}' END")
    err = "concat_ws('; ', " + ", ".join(checks) + ")"
    totals = ", ".join(f"CASE WHEN {err} = '' THEN p.p_{k} + coalesce(user_{k}, 0.0) END AS total_{k}" for k in K.USER_BOUNDS)
    return (V("grade_monthly") + _REQ_SQL + f"""
, r AS (SELECT *, lower(trim(scenario)) AS scen, CAST(round(TRY_CAST(trim(horizon_raw) AS DOUBLE)) AS INTEGER) AS h FROM req)
SELECT r.month_start, r.grade, r.scen AS scenario, r.h AS horizon,
       CASE WHEN {err} = '' THEN NULL ELSE {err} END AS error, {totals},
       CASE WHEN {err} = '' THEN p.risk_multiplier END AS risk_multiplier
FROM r LEFT JOIN {presets} ON r.scen = p.scenario""")


@query("scenario_parameters", _sql_scenario_parameters())
def q_scenario_parameters(spark, d):
    out = K.scenario_parameters(_requests(spark, d))
    return out.select("month_start", "grade", "scenario", "horizon", "error", *[f"total_{k}" for k in K.USER_BOUNDS],
                      "risk_multiplier")


@query("demand_request_rules", V("grade_monthly") + _REQ_SQL + """
, r AS (SELECT *, lower(trim(scenario)) AS scen, CAST(round(TRY_CAST(trim(horizon_raw) AS DOUBLE)) AS INTEGER) AS h FROM req)
, e AS (SELECT *, concat_ws('; ',
    CASE WHEN h IS NULL THEN 'Invalid numeric value for horizon' END,
    CASE WHEN h < 1 OR h > 12 THEN 'horizon must be between 1 and 12' END,
    CASE WHEN confidence < 0.5 OR confidence > 0.99 THEN 'confidence must be between 0.5 and 0.99' END,
    CASE WHEN scen NOT IN ('baseline', 'optimistic', 'pessimistic') THEN 'Unsupported scenarioType' END,
    CASE WHEN base_volume IS NOT NULL AND base_volume <= 0 THEN 'baseVolume must be greater than 0 when provided' END) AS err
  FROM r)
SELECT month_start, grade, scen AS scenario, h AS horizon, err = '' AS valid, CASE WHEN err = '' THEN NULL ELSE err END AS error
FROM e""")
def q_demand_request_rules(spark, d):
    return K.demand_request_rules(_requests(spark, d)).select("month_start", "grade", "scenario", "horizon", "valid", "error")


DRIFT_COLS = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "revol_util", "emp_length", "open_acc", "total_acc"]


def _sql_drift() -> str:
    def stats(where: str, p: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{c}' AS feature, avg(coalesce(CAST({c} AS DOUBLE), 0.0)) AS {p}_mean, "
            f"stddev_samp(coalesce(CAST({c} AS DOUBLE), 0.0)) AS {p}_std, "
            f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {p}_miss FROM clean_loans WHERE {where}" for c in DRIFT_COLS)
    z = "abs(c.cur_mean - b.base_mean) / (b.base_std + 1e-6)"
    miss = "abs(c.cur_miss - b.base_miss)"
    score = f"least(1.0, 0.7 * least(1.0, {z} / 3.0) + 0.3 * least(1.0, {miss} * 5))"
    return V("clean_loans") + f"""
, c AS ({stats("issue_year >= 2000", "cur")}), b AS ({stats("issue_year < 2000", "base")})
SELECT c.feature, {sql_rnd('c.cur_mean', 4)} AS current_mean, {sql_rnd('b.base_mean', 4)} AS baseline_mean,
       {sql_rnd(z, 4)} AS mean_shift_sigma, {sql_rnd(miss, 4)} AS missing_delta, {sql_rnd(score, 4)} AS drift_score,
       CASE WHEN {score} >= 0.5 THEN 'High' WHEN {score} >= 0.25 THEN 'Moderate' ELSE 'Low' END AS status
FROM c JOIN b ON c.feature = b.feature"""


@query("drift_report", _sql_drift())
def q_drift_report(spark, d):
    """Later loans (issued 2000 and after) against earlier ones."""
    lo = clean_loans(Tables(spark, d))
    return K.drift_report(lo.filter(F.col("issue_year") >= 2000), lo.filter(F.col("issue_year") < 2000), DRIFT_COLS)


@query("portfolio_kpis", V("scored_loans") + f"""
SELECT count(*) AS records, {sql_rnd('avg(default_probability)', 6)} AS mean_default_probability,
       {sql_rnd('avg(churn_probability)', 6)} AS mean_churn_probability,
       {sql_rnd("avg(CASE WHEN CAST(0.6 AS DOUBLE) * default_probability + CAST(0.4 AS DOUBLE) * churn_probability > 0.55 THEN 1.0 ELSE 0.0 END)", 6)} AS high_risk_share,
       {sql_rnd('sum(default_probability)', 4)} AS expected_defaults
FROM scored_loans""")
def q_portfolio_kpis(spark, d):
    s = K.risk_score_band(_scored(spark, d))
    return s.agg(F.count(F.lit(1)).alias("records"),
                  X.rnd(F.avg("default_probability"), 6).alias("mean_default_probability"),
                  X.rnd(F.avg("churn_probability"), 6).alias("mean_churn_probability"),
                  X.rnd(F.avg((F.col("risk_band") == "High").cast("double")), 6).alias("high_risk_share"),
                  X.rnd(F.sum("default_probability"), 4).alias("expected_defaults"))


@query("stress_compare", V("scored_loans") + """
, st AS (
  SELECT loan_id, default_probability AS base_probability,
         least(0.99, greatest(0.01, (int_rate + 1.5 - 5) / 25 + (dti + 4 - 17.5) / 100)) AS stressed_probability
  FROM scored_loans)
SELECT loan_id, base_probability, stressed_probability, stressed_probability - base_probability AS delta FROM st""")
def q_stress_compare(spark, d):
    """Base vs stressed (+150 bps, -10 % income, +4 dti) probability per loan: both sides
    scored by the same scorer, joined on the id."""
    lo = clean_loans(Tables(spark, d))
    base = K.standin_scores(lo).select("loan_id", F.col("default_probability").alias("base_probability"))
    stressed = K.standin_scores(K.stress_scenario(lo, 150, 10, 4)).select(
        "loan_id", F.col("default_probability").alias("stressed_probability"))
    j = base.join(stressed, "loan_id")
    return j.withColumn("delta", F.col("stressed_probability") - F.col("base_probability"))
