"""Risk operators: stress scenarios, score blending and bands, labels, drift, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X

# The serving thresholds and texts.
RISK_BAND_CUTS = ([0.30, 0.55], ["Low", "Medium", "High"])
BRIDGE_LABELS = ([0.65, 0.35], ["High", "Medium"], "Low")
DASH_DEFAULT_LABELS = ([0.5, 0.3], ["High", "Medium"], "Low")
DASH_CHURN_LABELS = ([0.6, 0.4], ["High", "Medium"], "Low")
RETENTION_ACTIONS = {
    "High": [
        "Trigger relationship manager outreach within 24 hours.",
        "Offer repayment plan optimization and proactive support.",
        "Escalate account to high-touch retention workflow.",
    ],
    "Medium": [
        "Start targeted engagement nudges for the next billing cycle.",
        "Monitor repayment delay and service interactions weekly.",
        "Send personalized retention communication.",
    ],
    "Low": [
        "Maintain standard servicing cadence.",
        "Continue routine engagement monitoring.",
        "No immediate retention action required.",
    ],
}
CAMPAIGN_TONES = [
    (0.6, "high propensity", "Prioritize immediate outreach with premium-term offers and a shorter follow-up cycle."),
    (0.4, "moderate propensity", "Use a two-step campaign: educational message first, then a targeted offer call."),
    (None, "low propensity", "Avoid expensive call-center actions; prefer low-cost digital nurture and re-score later."),
]
SCENARIO_PRESETS = {
    "baseline": (0.0, 0.0, 0.0, 0.0, 1.0),
    "optimistic": (5.0, -20.0, 8.0, 3.0, 0.9),
    "conservative": (-5.0, 30.0, -6.0, -2.0, 1.15),
    "stress": (-12.0, 75.0, -15.0, -4.0, 1.35),
}  # growth %, rate shock bps, loan count %, avg amount %, risk multiplier
USER_BOUNDS = {"growth": (-40.0, 60.0), "rate": (-400.0, 400.0), "count": (-50.0, 120.0), "amount": (-50.0, 80.0)}
DEMAND_SCENARIOS = {"baseline": 1.0, "optimistic": 1.15, "pessimistic": 0.85}


def stress_scenario(df: DataFrame, rate_bps: float | Column, income_drop_pct: float | Column, dti_bump: float | Column) -> DataFrame:
    """Rate + bps/100, income x (1 - pct/100), dti + bump; delinquencies +1 (clipped
    0..10) only when the bump is at least 3. Only columns that exist change. Parameters
    may be columns, so one job can apply many scenarios (see :func:`stress_grid`)."""
    rate_bps, income_drop_pct, dti_bump = (F.lit(v) if not isinstance(v, Column) else v
                                           for v in (rate_bps, income_drop_pct, dti_bump))
    cols = {}
    if "int_rate" in df.columns:
        cols["int_rate"] = X.safe_numeric(F.col("int_rate")) + rate_bps / 100.0
    if "annual_inc" in df.columns:
        cols["annual_inc"] = X.safe_numeric(F.col("annual_inc")) * (1 - income_drop_pct / 100.0)
    if "dti" in df.columns:
        cols["dti"] = X.safe_numeric(F.col("dti")) + dti_bump
    if "delinq_2yrs" in df.columns:
        bumped = F.least(F.greatest(X.safe_numeric(F.col("delinq_2yrs")) + 1, F.lit(0.0)), F.lit(10.0))
        cols["delinq_2yrs"] = F.when(dti_bump >= 3, bumped).otherwise(F.col("delinq_2yrs").cast("double"))
    return df.withColumns(cols)


def scenario_table(spark: SparkSession, rows: list[tuple[str, float, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "scenario string, rate_bps double, income_drop_pct double, dti_bump double")


def stress_grid(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every record under every scenario in one job: a broadcast cross join with the
    (small, fixed) scenario table."""
    j = df.crossJoin(F.broadcast(scenarios))
    out = stress_scenario(j, F.col("rate_bps"), F.col("income_drop_pct"), F.col("dti_bump"))
    return out.drop("rate_bps", "income_drop_pct", "dti_bump")


def standin_scores(loans: DataFrame) -> DataFrame:
    """Deterministic linear stand-in for the two model probabilities, used by the
    SQL-checked queries that consume model output (same formula in the oracle)."""
    pd_ = F.least(F.lit(0.99), F.greatest(F.lit(0.01), (F.col("int_rate") - 5) / 25 + (F.col("dti") - 17.5) / 100))
    pc = F.least(F.lit(0.99), F.greatest(F.lit(0.01), 0.1 + F.coalesce(F.col("emp_length"), F.lit(0.0)) / 15
                                          - F.coalesce(F.col("revol_util"), F.lit(0.0)) / 500))
    return loans.withColumns({"default_probability": pd_, "churn_probability": pc})


def risk_score_band(df: DataFrame, default_col: str = "default_probability", churn_col: str = "churn_probability") -> DataFrame:
    """0.6 default + 0.4 churn; Low <= .30 < Medium <= .55 < High (right-closed)."""
    score = 0.6 * F.col(default_col) + 0.4 * F.col(churn_col)
    return df.withColumn("risk_score", score).withColumn("risk_band", X.band(F.col("risk_score"), *RISK_BAND_CUTS))


def probability_labels(df: DataFrame, default_col: str = "default_probability", churn_col: str = "churn_probability") -> DataFrame:
    """Every labelling rule the reference applies to a probability."""
    p, c = F.col(default_col), F.col(churn_col)
    return df.withColumns({
        "bridge_label": X.threshold_label(p, *BRIDGE_LABELS),
        "default_tier": X.threshold_label(p, *DASH_DEFAULT_LABELS),
        "default_decision": F.when(p >= 0.30, "DEFAULT").otherwise("REPAY"),
        "churn_tier": X.threshold_label(c, *DASH_CHURN_LABELS),
        "churn_decision": F.when(c >= 0.5, "CHURNED").otherwise("RETAINED"),
        "deposit_label": F.when(p >= 0.6, "Likely Subscribe").otherwise("Low Intent"),
    })


def retention_actions(df: DataFrame, churn_col: str = "churn_probability") -> DataFrame:
    """Three fixed suggestions per churn tier (>= .65 High, >= .35 Medium, else Low)."""
    tier = X.threshold_label(F.col(churn_col), *BRIDGE_LABELS)
    arr = None
    for label, texts in RETENTION_ACTIONS.items():
        a = F.array(*[F.lit(t) for t in texts])
        arr = F.when(tier == label, a) if arr is None else arr.when(tier == label, a)
    return df.withColumns({"retention_tier": tier, "suggestions": arr})


def campaign_advice(df: DataFrame, prob_col: str, model_name: Column, top_features: Column) -> DataFrame:
    """Tone + recommendation by propensity, with the first three driver names."""
    p = F.col(prob_col)
    tone = F.when(p >= 0.6, CAMPAIGN_TONES[0][1]).when(p >= 0.4, CAMPAIGN_TONES[1][1]).otherwise(CAMPAIGN_TONES[2][1])
    rec = F.when(p >= 0.6, CAMPAIGN_TONES[0][2]).when(p >= 0.4, CAMPAIGN_TONES[1][2]).otherwise(CAMPAIGN_TONES[2][2])
    feats = F.when(F.size(top_features) > 0, F.array_join(F.slice(top_features, 1, 3), ", ")).otherwise(
        F.lit("campaign duration and prior outcomes"))
    text = F.concat(F.lit("Model `"), model_name, F.lit("` indicates **"), tone, F.lit("** to subscribe (probability "),
                    F.format_string("%.1f%%", p * 100), F.lit("). Primary drivers: "), feats,
                    F.lit(". Recommendation: "), rec)
    return df.withColumns({"tone": tone, "advice": text})


def churn_label(loans: DataFrame, cut: float = 0.85) -> DataFrame:
    """Fully paid loans: months from issue to last payment vs the term; churn = 1 when
    months >= cut * term (missing dates -> 0)."""
    paid = loans.filter(F.col("loan_status") == "Fully Paid")
    months = (F.year("last_pymnt_d") - F.year("issue_d")) * 12 + (F.month("last_pymnt_d") - F.month("issue_d"))
    term = X.first_int(F.col("term"))
    return paid.withColumns({"actual_months": months, "term_months": term}).withColumn(
        "churn_flag", F.coalesce(F.col("actual_months") >= F.col("term_months") * cut, F.lit(False)).cast("int"))


def scenario_parameters(requests: DataFrame) -> DataFrame:
    """Resolve forecast requests: preset + bounded user adjustments, horizon 1..12.
    Invalid requests keep a NULL result and an ``error`` text instead of failing the job."""
    spark = requests.sparkSession
    presets = spark.createDataFrame(
        [(k, *v) for k, v in SCENARIO_PRESETS.items()],
        "scenario string, p_growth double, p_rate double, p_count double, p_amount double, risk_multiplier double")
    r = requests.withColumn("scenario", F.lower(F.trim("scenario")))
    r = r.withColumn("horizon", F.round(X.to_double(F.col("horizon_raw"))).cast("int"))
    j = r.join(F.broadcast(presets), "scenario", "left")
    errs = [(F.col("p_growth").isNull(), "Unsupported scenario"),
            (F.col("horizon").isNull(), "Invalid numeric value for horizonMonths"),
            ((F.col("horizon") < 1) | (F.col("horizon") > 12), "horizonMonths must be between 1 and 12")]
    names = {"growth": "growthAdjustmentPct", "rate": "interestRateShockBps", "count": "loanCountChangePct",
             "amount": "avgLoanAmountChangePct"}
    for k, (lo, hi) in USER_BOUNDS.items():
        c = F.coalesce(F.col(f"user_{k}"), F.lit(0.0))
        errs.append(((c < lo) | (c > hi), f"{names[k]} must be between {lo} and {hi}"))
    err = X.reasons(errs, sep="; ")
    ok = F.length(err) == 0
    out = j.withColumn("error", F.when(ok, F.lit(None).cast("string")).otherwise(err))
    for k in USER_BOUNDS:
        out = out.withColumn(f"total_{k}", F.when(ok, F.col(f"p_{k}") + F.coalesce(F.col(f"user_{k}"), F.lit(0.0))))
    return out.withColumn("risk_multiplier", F.when(ok, F.col("risk_multiplier"))).drop(
        "p_growth", "p_rate", "p_count", "p_amount")


def demand_request_rules(requests: DataFrame) -> DataFrame:
    """Validate demand requests: horizon 1..12, confidence .5..99, scenario in set,
    base volume > 0 when given; adds ``valid`` and ``error``."""
    scen = F.lower(F.trim("scenario"))
    h = F.round(X.to_double(F.col("horizon_raw"))).cast("int")
    errs = [(h.isNull(), "Invalid numeric value for horizon"),
            ((h < 1) | (h > 12), "horizon must be between 1 and 12"),
            ((F.col("confidence") < 0.5) | (F.col("confidence") > 0.99), "confidence must be between 0.5 and 0.99"),
            (~scen.isin(list(DEMAND_SCENARIOS)), "Unsupported scenarioType"),
            (F.col("base_volume").isNotNull() & (F.col("base_volume") <= 0), "baseVolume must be greater than 0 when provided")]
    err = X.reasons(errs, sep="; ")
    return requests.withColumns({"scenario": scen, "horizon": h, "valid": F.length(err) == 0,
                                 "error": F.when(F.length(err) > 0, err)})


def drift_report(current: DataFrame, baseline: DataFrame, cols: list[str]) -> DataFrame:
    """Per feature: |mean shift| / (baseline sample std + 1e-6) -> z, missing-rate delta,
    score = min(1, .7 min(1, z/3) + .3 min(1, 5 dmiss)); High >= .5, Moderate >= .25.
    NULLs count as 0 in the means (as the reference fills them). Two one-pass
    aggregates, stacked to rows and joined on the feature name."""
    cols = [c for c in cols if c in current.columns and c in baseline.columns]

    def stats(df: DataFrame, p: str) -> DataFrame:
        aggs = []
        for c in cols:
            v = X.safe_numeric(F.col(c), 0.0)
            aggs += [F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std"),
                     F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__miss")]
        row = df.agg(*aggs)
        st = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`, `{c}__miss`" for c in cols)
        return row.select(F.expr(f"stack({len(cols)}, {st}) AS (feature, {p}_mean, {p}_std, {p}_miss)"))

    j = stats(current, "cur").join(stats(baseline, "base"), "feature")
    shift = F.abs(F.col("cur_mean") - F.col("base_mean"))
    z = shift / (F.col("base_std") + 1e-6)
    miss = F.abs(F.col("cur_miss") - F.col("base_miss"))
    score = F.least(F.lit(1.0), 0.7 * F.least(F.lit(1.0), z / 3.0) + 0.3 * F.least(F.lit(1.0), miss * 5))
    return j.select(
        "feature", F.round("cur_mean", 4).alias("current_mean"), F.round("base_mean", 4).alias("baseline_mean"),
        F.round(z, 4).alias("mean_shift_sigma"), F.round(miss, 4).alias("missing_delta"),
        F.round(score, 4).alias("drift_score"),
        F.when(score >= 0.5, "High").when(score >= 0.25, "Moderate").otherwise("Low").alias("status")).orderBy(
        F.col("drift_score").desc(), "feature")
