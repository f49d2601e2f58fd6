"""Queries for splits, weights, scaling, evaluation, explanation and models.

SQL-checked queries evaluate the deterministic stand-in scores (``risk.standin_scores``)
or correlation-based importances; queries that train models are checked by rows only.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import sql_rnd
from ..operators import anomaly as N
from ..operators import autoencoder as AE
from ..operators import encode as E
from ..operators import explain as P
from ..operators import ml as M
from ..operators import risk as K
from ..operators import series as S
from ..operators import serving as SV
from ..operators import trees as TR
from ..operators.demand import GRADES
from ..session import models_path, stable
from ..sources import io as IO
from ..sources.domain import Tables, clean_loans, deposits, series, volume_panel
from ..sources.tables import table_path
from . import sql_series as Q
from .q_clean import _sql_prepare_features
from .registry import query
from .sql_views import with_views as V


def _scored(spark, d):
    return K.standin_scores(clean_loans(Tables(spark, d)))


@query("stratified_split", V("clean_loans") + """
, h AS (SELECT loan_id, default_flag, (loan_id * 7919 + 42 * 104729) % 1000003 AS hk FROM clean_loans)
, r AS (SELECT *, row_number() OVER (PARTITION BY default_flag ORDER BY hk, loan_id) AS rn,
               count(*) OVER (PARTITION BY default_flag) AS n FROM h)
SELECT loan_id, default_flag, rn <= ceil(n * 0.8) AS is_train FROM r""")
def q_stratified_split(spark, d):
    c = clean_loans(Tables(spark, d)).select("loan_id", "default_flag")
    return M.stratified_split(c, "default_flag", "loan_id")


@query("chrono_split", V("monthly_volume") + "SELECT month_start, funded_amnt_m, month_start < DATE '2000-01-01' AS is_train FROM monthly_volume")
def q_chrono_split(spark, d):
    from ..operators import aggregate as A
    m = A.monthly_volume(clean_loans(Tables(spark, d))).select("month_start", "funded_amnt_m")
    return M.chrono_split(m, "month_start", "2000-01-01")


@query("class_weights", V("clean_loans") + """
, c AS (SELECT default_flag, count(*) AS n_class FROM clean_loans GROUP BY default_flag)
SELECT default_flag, n_class, (SELECT sum(n_class) FROM c) / (2.0 * n_class) AS weight,
       ((SELECT sum(n_class) FROM c) - (SELECT sum(n_class) FROM c WHERE default_flag = 1)) / (SELECT sum(n_class) FROM c WHERE default_flag = 1)
       AS neg_pos_ratio FROM c""")
def q_class_weights(spark, d):
    return M.class_weights(clean_loans(Tables(spark, d)), "default_flag")


@query("standard_scale", V("deposits") + ", st AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in N.FEATURES) + " FROM deposits) SELECT deposit_id, "
    + ", ".join(sql_rnd(f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END", 6) + f" AS {c}" for c in N.FEATURES)
    + " FROM deposits CROSS JOIN st")
def q_standard_scale(spark, d):
    dep = deposits(Tables(spark, d)).select("deposit_id", *[F.col(c).cast("double") for c in N.FEATURES])
    s = M.standard_scale(dep, N.FEATURES)
    return s.select("deposit_id", *[X.rnd(F.col(c), 6).alias(c) for c in N.FEATURES])


_AUC_SQL = """
, rk AS (SELECT default_flag AS y, (rank() OVER (ORDER BY p) + count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 AS ar
         FROM sc)
, auc AS (SELECT (sum(CASE WHEN y = 1 THEN ar END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM rk)
"""


def _sql_metrics(src: str, thr: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""SELECT {g}CAST(sum(CASE WHEN p >= {thr} AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN p >= {thr} AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN p < {thr} AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN p < {thr} AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM {src} {gb}"""


def _sql_metric_cols() -> str:
    prec = "tp / nullif(tp + fp, 0)"
    rec = "tp / nullif(tp + fn, 0)"
    return (f"tp, fp, fn, tn, {sql_rnd(f'coalesce({prec}, 0.0)', 6)} AS precision, {sql_rnd(f'coalesce({rec}, 0.0)', 6)} AS recall, "
            f"{sql_rnd(f'coalesce(2 * ({prec}) * ({rec}) / nullif(({prec}) + ({rec}), 0), 0.0)', 6)} AS f1, "
            f"{sql_rnd('(tp + tn) / (tp + tn + fp + fn)', 6)} AS accuracy")


def _round_metrics(m):
    return m.withColumns({c: X.rnd(F.col(c), 6) for c in ["precision", "recall", "f1", "accuracy"]})


@query("eval_classification", V("scored_loans") + ", sc AS (SELECT default_flag, default_flag AS y, default_probability AS p FROM scored_loans)"
       + _AUC_SQL + f", m AS ({_sql_metrics('sc', '0.5')}) SELECT {_sql_metric_cols()}, {sql_rnd('auc', 6)} AS auc FROM m CROSS JOIN auc")
def q_eval_classification(spark, d):
    s = _scored(spark, d)
    m = M.classification_metrics(s, "default_flag", "default_probability", 0.5).crossJoin(
        M.auc(s, "default_flag", "default_probability"))
    return _round_metrics(m).withColumn("auc", X.rnd(F.col("auc"), 6))


@query("threshold_sweep", V("scored_loans") + """
, sc AS (SELECT default_flag AS y, default_probability AS p, t.threshold FROM scored_loans
         CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.4 AS DOUBLE)), (CAST(0.3 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) t(threshold))
""" + f", m AS ({_sql_metrics('sc', 'threshold', 'threshold')}) SELECT threshold, {_sql_metric_cols()} FROM m")
def q_threshold_sweep(spark, d):
    return _round_metrics(M.threshold_sweep(_scored(spark, d), "default_flag", "default_probability"))


@query("roc_points", V("scored_loans") + f"""
, per AS (SELECT default_probability AS p, sum(default_flag) AS pos, sum(1 - default_flag) AS neg FROM scored_loans GROUP BY 1)
, c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cn,
               sum(pos) OVER () AS tp_all, sum(neg) OVER () AS tn_all FROM per)
SELECT p AS threshold, {sql_rnd('cp / tp_all', 8)} AS tpr, {sql_rnd('cn / tn_all', 8)} AS fpr FROM c""")
def q_roc_points(spark, d):
    r = M.roc_points(_scored(spark, d), "default_flag", "default_probability")
    return r.withColumns({"tpr": X.rnd(F.col("tpr"), 8), "fpr": X.rnd(F.col("fpr"), 8)})


@query("confusion_matrix", V("scored_loans") + """
SELECT default_flag AS actual, CAST(default_probability >= 0.3 AS INTEGER) AS predicted, count(*) AS n FROM scored_loans GROUP BY 1, 2""")
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(_scored(spark, d), "default_flag", "default_probability", 0.3)


@query("leaderboard_sort", V("scored_loans") + f"""
, sc AS (SELECT 'default stand-in' AS model, default_flag AS y, default_probability AS p FROM scored_loans
         UNION ALL SELECT 'churn stand-in', default_flag, churn_probability FROM scored_loans
         UNION ALL SELECT 'blended risk', default_flag, CAST(0.6 AS DOUBLE) * default_probability + CAST(0.4 AS DOUBLE) * churn_probability FROM scored_loans)
, m AS ({_sql_metrics('sc', '0.5', 'model')})
, mm AS (SELECT model, {_sql_metric_cols()} FROM m)
SELECT model, f1, accuracy, CAST(row_number() OVER (ORDER BY f1 DESC, accuracy DESC, model) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY f1 DESC, accuracy DESC, model) = 1 AS champion FROM mm""")
def q_leaderboard_sort(spark, d):
    """Scorers ordered by F1 then accuracy; the first is the champion."""
    s = K.risk_score_band(_scored(spark, d))
    parts = [s.select(F.lit(n).alias("model"), "default_flag", F.col(c).alias("p"))
             for n, c in [("default stand-in", "default_probability"), ("churn stand-in", "churn_probability"),
                          ("blended risk", "risk_score")]]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    m = _round_metrics(M.classification_metrics(u, "default_flag", "p", 0.5, group=["model"]))
    return M.leaderboard(m).select("model", "f1", "accuracy", "rank", "champion")


@query("model_table_sort", Q.chain(V("series"), Q.baseline_backtest("series", ["series_id"], "bb")) + "SELECT model, "
       + ", ".join(f"max(CASE WHEN series_id = '{g}' THEN mape END) AS {g}" for g in ["A", "B", "C", "D", "E", "TOTAL"])
       + " FROM bb GROUP BY model")
def q_model_table_sort(spark, d):
    """Back-test MAPE as a model x series matrix, best model of the total first."""
    b = S.baseline_backtest(series(Tables(spark, d)), ["series_id"], 4)
    return b.groupBy("model").pivot("series_id", ["A", "B", "C", "D", "E", "TOTAL"]).agg(F.first("mape")).orderBy(
        F.col("TOTAL").asc_nulls_last(), "model")


def _features(spark, d):
    c = clean_loans(Tables(spark, d))
    return E.prepare_features(c, M.DEFAULT_FEATURES, keep=["loan_id", "default_flag"])


def _sql_corr_importance(feats: list[str], label: str, src: str) -> str:
    raw = " UNION ALL ".join(f"SELECT '{f}' AS feature, coalesce(abs(corr({f}, CAST({label} AS DOUBLE))), 0.0) AS raw FROM {src}" for f in feats)
    return f"""({raw})"""


_FEAT_SQL = V("clean_loans") + ", pf AS (" + _sql_prepare_features().replace("SELECT loan_id,", "SELECT loan_id, default_flag,") + ")"
_IMP_SQL = f"""
, raw AS {_sql_corr_importance(M.DEFAULT_FEATURES, 'default_flag', 'pf')}
, imp AS (SELECT feature, CASE WHEN (SELECT sum(raw) FROM raw) > 0 THEN raw / (SELECT sum(raw) FROM raw)
                               ELSE 1.0 / (SELECT count(*) FROM raw) END AS importance FROM raw)
"""


@query("top_features", _FEAT_SQL + _IMP_SQL + f"""
SELECT feature, {sql_rnd('importance', 8)} AS importance,
       upper(substr(replace(feature, '_', ' '), 1, 1)) || substr(replace(feature, '_', ' '), 2) AS label
FROM imp ORDER BY importance DESC, feature LIMIT 6""")
def q_top_features(spark, d):
    """Top 6 drivers of default by normalised |correlation| (model-free importance)."""
    imp = P.correlation_importance(_features(spark, d), M.DEFAULT_FEATURES, "default_flag")
    t = P.top_features(imp, 6)
    return t.select("feature", X.rnd(F.col("importance"), 8).alias("importance"),
                    F.concat(F.upper(F.substring(F.regexp_replace("feature", "_", " "), 1, 1)),
                             F.expr("substring(replace(feature, '_', ' '), 2)")).alias("label"))


@query("top_driver_text", _FEAT_SQL + _IMP_SQL + f"""
SELECT feature, array_to_string(list_transform(string_split(replace(feature, '_', ' '), ' '), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ')
       || ' (' || printf('%.1f', {sql_rnd('importance * 100', 1)}) || '%)' AS driver
FROM imp ORDER BY importance DESC, feature LIMIT 4""")
def q_top_driver_text(spark, d):
    """The four largest drivers of default as text, ``Name (12.3%)``."""
    imp = P.correlation_importance(_features(spark, d), M.DEFAULT_FEATURES, "default_flag")
    return P.driver_text(imp).select("feature", "driver")


_LONG_SQL = " UNION ALL ".join(f"SELECT loan_id, '{f}' AS feature, {f} AS value FROM pf" for f in M.DEFAULT_FEATURES)
_MEANS_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(sum(CAST({f} AS DECIMAL(38,10))) AS DOUBLE) / count({f}) AS baseline FROM pf"
    for f in M.DEFAULT_FEATURES)
_IMPACT_SQL = _FEAT_SQL + _IMP_SQL + f"""
, lf AS ({_LONG_SQL})
, mn AS ({_MEANS_SQL})
, li AS (SELECT lf.loan_id, lf.feature, lf.value, mn.baseline,
                (coalesce(lf.value, 0.0) - mn.baseline) * coalesce({sql_rnd('imp.importance', 12)}, 0.0) AS impact
         FROM lf JOIN mn ON lf.feature = mn.feature LEFT JOIN imp ON lf.feature = imp.feature)
"""


def _rounded_importance(f):
    """Importances to 12 decimals: correlation algorithms differ in the last bits across
    engines, and impacts are compared after rounding."""
    imp = P.correlation_importance(f, M.DEFAULT_FEATURES, "default_flag")
    return imp.withColumn("importance", X.rnd(F.col("importance"), 12))


@query("local_feature_impact", _IMPACT_SQL + f"""
SELECT loan_id, feature, {sql_rnd('impact', 6)} AS impact FROM li""")
def q_local_feature_impact(spark, d):
    f = _features(spark, d)
    imp = _rounded_importance(f)
    li = P.local_feature_impact(f, "loan_id", M.DEFAULT_FEATURES, imp, top_n=None)
    return li.select("loan_id", "feature", X.rnd(F.col("impact"), 6).alias("impact"))


@query("top_local_impacts", _IMPACT_SQL + f"""
SELECT loan_id, feature, {sql_rnd('value', 4)} AS value, {sql_rnd('baseline', 4)} AS baseline, {sql_rnd('impact', 6)} AS impact, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY abs(impact) DESC, feature) AS rank FROM li) t WHERE rank <= 8""")
def q_top_local_impacts(spark, d):
    f = _features(spark, d)
    imp = _rounded_importance(f)
    li = P.local_feature_impact(f, "loan_id", M.DEFAULT_FEATURES, imp, top_n=8)
    return li.select("loan_id", "feature", X.rnd(F.col("value"), 4).alias("value"), X.rnd(F.col("baseline"), 4).alias("baseline"),
                     X.rnd(F.col("impact"), 6).alias("impact"), "rank")


_WF_FEATS = ["int_rate", "dti", "annual_inc", "revol_util", "emp_length", "open_acc"]


@query("contribution_waterfall", _FEAT_SQL + ", coef AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, regr_slope(CAST(default_flag AS DOUBLE), {f}) AS beta FROM pf" for f in _WF_FEATS) + ")"
       + ", lf AS (" + " UNION ALL ".join(f"SELECT loan_id, '{f}' AS feature, {f} AS value FROM pf" for f in _WF_FEATS) + ")"
       + ", mn AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg({f}) AS mean FROM pf" for f in _WF_FEATS) + ")" + f"""
, c AS (SELECT lf.loan_id, lf.feature, coef.beta * (coalesce(lf.value, mn.mean) - mn.mean) AS contribution
        FROM lf JOIN mn ON lf.feature = mn.feature JOIN coef ON lf.feature = coef.feature)
, w AS (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY abs(contribution) DESC, feature) AS step,
               sum(contribution) OVER (PARTITION BY loan_id ORDER BY abs(contribution) DESC, feature ROWS UNBOUNDED PRECEDING) AS e FROM c)
SELECT loan_id, feature, CAST(step AS INTEGER) AS step, {sql_rnd('contribution', 6)} AS contribution, {sql_rnd('e - contribution', 6)} AS start, {sql_rnd('e', 6)} AS "end"
FROM w WHERE step <= 12""")
def q_contribution_waterfall(spark, d):
    """Linear contributions beta (x - mean), beta = univariate least-squares slope of the
    default flag on the feature, as a per-loan waterfall."""
    f = _features(spark, d)
    coef_row = f.agg(*[F.regr_slope(F.col("default_flag").cast("double"), F.col(c)).alias(c) for c in _WF_FEATS])
    coef = P.long_form(coef_row.withColumn("_one", F.lit(1)), "_one", _WF_FEATS).select("feature", F.col("value").alias("beta"))
    w = P.contribution_waterfall(f, "loan_id", _WF_FEATS, coef)
    return w.select("loan_id", "feature", "step", *[X.rnd(F.col(c), 6).alias(c) for c in ["contribution", "start", "end"]])


@query("join_importance_outer", _FEAT_SQL + _IMP_SQL + f"""
, pc AS (SELECT pf.*, CAST(coalesce((year(c.last_pymnt_d) - year(c.issue_d)) * 12 + (month(c.last_pymnt_d) - month(c.issue_d))
                  >= TRY_CAST(regexp_extract(c.term, '(\\d+)', 1) AS DOUBLE) * 0.85, false) AS INTEGER) AS churn_flag
         FROM pf JOIN clean_loans c ON pf.loan_id = c.loan_id WHERE c.loan_status = 'Fully Paid')
, rawc AS {_sql_corr_importance(M.CHURN_FEATURES, 'churn_flag', 'pc')}
, impc AS (SELECT feature, CASE WHEN (SELECT sum(raw) FROM rawc) > 0 THEN raw / (SELECT sum(raw) FROM rawc)
                                ELSE 1.0 / (SELECT count(*) FROM rawc) END AS importance FROM rawc)
, j AS (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.importance, 0.0) AS default_importance,
               coalesce(b.importance, 0.0) AS churn_importance FROM imp a FULL OUTER JOIN impc b ON a.feature = b.feature)
SELECT feature, {sql_rnd('default_importance', 8)} AS default_importance, {sql_rnd('churn_importance', 8)} AS churn_importance,
       {sql_rnd('0.6 * default_importance + 0.4 * churn_importance', 8)} AS importance
FROM j ORDER BY 0.6 * default_importance + 0.4 * churn_importance DESC, feature LIMIT 10""")
def q_join_importance_outer(spark, d):
    """Default-model and churn-model importances (model-free stand-ins) merged by a full
    outer join on the feature, missing -> 0, blended .6/.4, top 10."""
    c = clean_loans(Tables(spark, d))
    f = E.prepare_features(c, M.DEFAULT_FEATURES, keep=["loan_id", "default_flag"])
    a = P.correlation_importance(f, M.DEFAULT_FEATURES, "default_flag").withColumnRenamed("importance", "default_importance")
    ch = K.churn_label(c).select("loan_id", "churn_flag")
    fc = f.join(ch, "loan_id")
    b = P.correlation_importance(fc, M.CHURN_FEATURES, "churn_flag").withColumnRenamed("importance", "churn_importance")
    j = a.join(b, "feature", "full").select("feature", F.coalesce("default_importance", F.lit(0.0)).alias("default_importance"),
                                            F.coalesce("churn_importance", F.lit(0.0)).alias("churn_importance"))
    j = j.withColumn("importance", 0.6 * F.col("default_importance") + 0.4 * F.col("churn_importance"))
    top = j.orderBy(F.col("importance").desc(), "feature").limit(10)
    return top.select("feature", *[X.rnd(F.col(x), 8).alias(x) for x in ["default_importance", "churn_importance", "importance"]])


_THR_SQL = V("deposits") + """
, thr AS (SELECT quantile_cont(amount, 0.99) AS amount_high, quantile_cont(CAST(frequency AS DOUBLE), 0.95) AS frequency_high FROM deposits)
, fl AS (SELECT d.*, amount >= amount_high AS flag_amount, hour < 6 OR hour > 20 AS flag_hour, frequency >= frequency_high AS flag_frequency
         FROM deposits d CROSS JOIN thr)
, rs AS (SELECT *, (CAST(flag_amount AS INTEGER) + CAST(flag_hour AS INTEGER) + CAST(flag_frequency AS INTEGER)) / 3.0 AS rule_score,
                flag_amount OR flag_hour OR flag_frequency AS rule_flagged,
                CASE WHEN NOT (flag_amount OR flag_hour OR flag_frequency) THEN 'Patterns consistent with history'
                     ELSE concat_ws(', ', CASE WHEN flag_amount THEN 'Unusual amount' END, CASE WHEN flag_hour THEN 'Unusual hour' END,
                                    CASE WHEN flag_frequency THEN 'High frequency' END) END AS rule_reasons FROM fl)
"""


def _rules(spark, d):
    dep = deposits(Tables(spark, d))
    return N.rule_flags(dep, N.thresholds(dep))


@query("anomaly_thresholds", _THR_SQL + f"SELECT {sql_rnd('amount_high', 6)} AS amount_high, {sql_rnd('frequency_high', 6)} AS frequency_high FROM thr")
def q_anomaly_thresholds(spark, d):
    t = N.thresholds(deposits(Tables(spark, d)))
    return t.select(X.rnd(F.col("amount_high"), 6).alias("amount_high"), X.rnd(F.col("frequency_high"), 6).alias("frequency_high"))


@query("deposit_rule_flags", _THR_SQL + "SELECT deposit_id, flag_amount, flag_hour, flag_frequency, rule_reasons FROM rs")
def q_deposit_rule_flags(spark, d):
    return _rules(spark, d).select("deposit_id", "flag_amount", "flag_hour", "flag_frequency", "rule_reasons")


@query("hourly_anomaly_trend", _THR_SQL + f"""
SELECT hour, lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS time, {sql_rnd('avg(rule_score)', 4)} AS score FROM rs GROUP BY hour""")
def q_hourly_anomaly_trend(spark, d):
    """Mean (rule) anomaly score by hour of day, labelled ``HH:00``."""
    r = _rules(spark, d)
    return r.groupBy("hour").agg(X.rnd(F.avg("rule_score"), 4).alias("score")).withColumn(
        "time", F.format_string("%02d:00", F.col("hour")))


@query("flagged_share", _THR_SQL + f"SELECT {sql_rnd('avg(CASE WHEN rule_flagged THEN 1.0 ELSE 0.0 END)', 6)} AS flagged_share, count(*) AS records FROM rs")
def q_flagged_share(spark, d):
    r = _rules(spark, d)
    return r.agg(X.rnd(F.avg(F.col("rule_flagged").cast("double")), 6).alias("flagged_share"), F.count(F.lit(1)).alias("records"))


# ---- model-backed queries (rows-only check) -------------------------------------------

def _default_split(spark, d, tables=None):
    c = clean_loans(tables or Tables(spark, d))
    return M.Split(E.prepare_features(c, M.DEFAULT_FEATURES, keep=["loan_id", "default_flag"]), M.DEFAULT_FEATURES, "default_flag", "loan_id", balance=True)


def _churn_split(spark, d, tables=None):
    labelled = K.churn_label(clean_loans(tables or Tables(spark, d)))
    f = E.prepare_features(labelled, M.CHURN_FEATURES, keep=["loan_id", "churn_flag"])
    return M.Split(f, M.CHURN_FEATURES, "churn_flag", "loan_id", weight_col="weight")


def _campaign_split(spark, d):
    from ..sources.domain import campaign
    design, feats = E.campaign_design(campaign(Tables(spark, d)))
    return M.Split(design, feats, "target", "client_id", balance=True)


def _keeper(spark, d, tables=("orders", "lineitem", "customer")):
    """Models are trained once: a fitted model is stored in the models folder and read back as
    long as its source tables, its features and all its parameters are the same."""
    def keep(split, est):
        params = split.params(est)
        name = hashlib.sha256(json.dumps([d, params], sort_keys=True, default=str).encode()).hexdigest()
        return IO.cached_artifact(spark, [table_path(d, t) for t in tables], f"{models_path(spark)}/{name}",
                                  lambda: split.fit(est), params)
    return keep


def _default_model(spark, d, tables=None):
    return _keeper(spark, d)(_default_split(spark, d, tables), M.classifiers()[M.BOOSTED])


def _churn_model(spark, d, tables=None):
    return _keeper(spark, d)(_churn_split(spark, d, tables), M.classifiers(weight_col="weight")[M.BOOSTED])


def _probability(model, frame, out):
    return M.positive_probability(model.transform(frame)).select("loan_id", F.col("probability_1").alias(out))


def score_loans(loans, models):
    """Every loan's probabilities, an output column for each of ``models``, in one pass over the loans: one frame
    with the features of all models, to which they are applied in turn. Features are prepared alike for all."""
    frame = E.prepare_features(loans, M.DEFAULT_FEATURES, keep=["loan_id"])
    for out, model in models.items():
        frame = M.positive_probability(model.transform(frame), out).drop("features", "rawPrediction", "probability", "prediction")
    return frame.select("loan_id", *models)


@query("train_default_models")
def q_train_default_models(spark, d):
    """LR, random forest (200 trees, depth 10, leaf 50) and boosted trees (depth 6, step
    .05, subsample .8) on the training part of the stratified 80/20 split, balanced by SMOTE;
    metrics of each on the untouched test part. The models are stored for scoring."""
    return M.train_and_evaluate(_default_split(spark, d), M.classifiers(), keep=_keeper(spark, d))


@query("train_churn_models")
def q_train_churn_models(spark, d):
    """Same families with balanced class weights on the churn label of fully paid loans."""
    return M.train_and_evaluate(_churn_split(spark, d), M.classifiers(weight_col="weight"), keep=_keeper(spark, d))


def _campaign_board(spark, d):
    """(split, leaderboard, stored models by name) of the deposit campaign."""
    split, keep = _campaign_split(spark, d), _keeper(spark, d)
    board = M.leaderboard(M.train_and_evaluate(split, M.campaign_classifiers(), keep=keep))
    return split, stable(board, "leaderboard"), lambda name: keep(split, M.campaign_classifiers()[name])


@query("train_deposit_models")
def q_train_deposit_models(spark, d):
    """LR, decision tree (depth 8), random forest (220 trees) on the one-hot campaign
    design, trained on the balanced training part; leaderboard by F1 then accuracy."""
    return _campaign_board(spark, d)[1]


#: First and last month of the chronological test; training ends before it.
TEST_FROM, TEST_TO = "2000-01-01", "2000-12-01"


def _chronological(frame):
    frame = stable(frame, "volume_frame")
    return frame.filter(F.col("month_start") < TEST_FROM), frame.filter(F.col("month_start").between(TEST_FROM, TEST_TO))


@query("train_volume_models")
def q_train_volume_models(spark, d):
    """Linear and boosted regressors of the monthly total on calendar, lag, rolling, rate, amount
    and count features; trained before 2000, tested on the 12 months of 2000 (MAPE %, RMSE)."""
    panel = volume_panel(Tables(spark, d)).filter(F.col("series_id") == "TOTAL")
    return M.evaluate_regressors(*_chronological(SV.model_frame(panel)), SV.VOLUME_FEATURES, M.regressors())


@query("train_grade_models")
def q_train_grade_models(spark, d):
    """Linear, forest (200 trees, depth 6, leaf 3) and boosted (200 rounds, depth 4) regressors
    for every grade, trained before 2000 and tested on the 12 months of 2000 (MAPE %, RMSE)."""
    panel = volume_panel(Tables(spark, d)).filter(F.col("series_id").isin(GRADES))
    train, test = _chronological(SV.model_frame(panel))
    linear = M.evaluate_linear_by_group(train, test, "series_id", SV.GRADE_FEATURES)
    return linear.unionByName(M.evaluate_by_group(train, test, "series_id", GRADES, SV.GRADE_FEATURES, M.grade_regressors))


@query("score_portfolio")
def q_score_portfolio(spark, d):
    """Every loan scored with the stored default and churn models, blended and banded. Models that are not stored
    yet are fitted side by side."""
    t = Tables(spark, d)
    loans = clean_loans(t)
    default, churn = M.side_by_side([lambda: _default_model(spark, d, t), lambda: _churn_model(spark, d, t)])
    s = K.risk_score_band(score_loans(loans, {"default_probability": default, "churn_probability": churn}))
    return s.withColumns({"record_id": F.concat(F.lit("L-"), (F.col("loan_id") + 2000).cast("string")),
                          "borrower": F.concat(F.lit("Borrower-"), F.col("loan_id").cast("string"))})


@query("score_default")
def q_score_default(spark, d):
    """Batch default scoring with the stored model: issue month validated 1..12, features
    prepared, probability, tier label, and the model's top-8 importance as an array per row."""
    c = clean_loans(Tables(spark, d)).filter(F.col("issue_month").between(1, 12))
    m = _default_model(spark, d)
    imp = sorted(M.model_importance(m, M.DEFAULT_FEATURES), key=lambda t: -t[1])[:8]  # len(features) numbers
    s = _probability(m, E.prepare_features(c, M.DEFAULT_FEATURES, keep=["loan_id"]), "probability")
    return s.withColumns({"label": X.threshold_label(F.col("probability"), *K.BRIDGE_LABELS),
                          "top_drivers": F.array(*[F.lit(n) for n, _ in imp])})


@query("score_churn")
def q_score_churn(spark, d):
    """Batch churn scoring with the stored model: every loan with a valid issue month, tier label
    and the three retention actions."""
    c = clean_loans(Tables(spark, d)).filter(F.col("issue_month").between(1, 12))
    s = _probability(_churn_model(spark, d), E.prepare_features(c, M.CHURN_FEATURES, keep=["loan_id"]), "churn_probability")
    return K.retention_actions(s).withColumn("suggestions", F.array_join("suggestions", " | "))


@query("stress_compare_model")
def q_stress_compare_model(spark, d):
    """Base vs stressed (+150 bps, -10 % income, +4 dti) probability per loan by the stored
    default model."""
    c, m = clean_loans(Tables(spark, d)), _default_model(spark, d)
    score = lambda df, out: _probability(m, E.prepare_features(df, M.DEFAULT_FEATURES, keep=["loan_id"]), out)
    j = score(c, "base_probability").join(score(K.stress_scenario(c, 150, 10, 4), "stressed_probability"), "loan_id")
    return j.withColumn("delta", F.col("stressed_probability") - F.col("base_probability"))


@query("contribution_waterfall_model")
def q_contribution_waterfall_model(spark, d):
    """Contributions coefficient x (value - mean) to the log-odds of the stored logistic default
    model, as a per-loan waterfall of the 12 largest."""
    f = _features(spark, d)
    lr = _keeper(spark, d)(_default_split(spark, d), M.classifiers()["Logistic Regression"]).stages[-1]
    coef = spark.createDataFrame(list(zip(M.DEFAULT_FEATURES, map(float, lr.coefficients.toArray()))), "feature string, beta double")
    w = P.contribution_waterfall(f, "loan_id", M.DEFAULT_FEATURES, coef)
    return w.select("loan_id", "feature", "step", "contribution", "start", "end")


@query("contribution_waterfall_tree")
def q_contribution_waterfall_tree(spark, d):
    """Exact contributions of the features to the log-odds of the stored boosted default model: for every loan a
    waterfall from the model's base to the loan's score, of the 12 largest and one step for the rest."""
    t = Tables(spark, d)
    model = _default_model(spark, d, t)
    f = E.prepare_features(clean_loans(t), M.DEFAULT_FEATURES, keep=["loan_id"])
    return TR.tree_waterfall(f, "loan_id", M.DEFAULT_FEATURES, TR.Ensemble(TR.node_table(model, spark)))


def score_campaign(spark, d, model: str | None = None):
    """Batch propensity of every client by the named stored model (the leaderboard's champion if
    none is named): class, probability, ``Likely Subscribe`` at .6 and the campaign advice text."""
    split, board, stored = _campaign_board(spark, d)
    names = sorted(M.campaign_classifiers())
    if model is not None and model not in names:
        raise ValueError(f"Unknown model '{model}'. Valid models: {', '.join(names)}")
    name = model or board.filter("champion").first()["model"]  # one row per model
    m = stored(name)
    imp = sorted(M.model_importance(m, split.features), key=lambda t: -t[1])[:3]
    s = M.positive_probability(m.transform(split.data)).select(
        "client_id", F.col("prediction").cast("int").alias("prediction"), F.col("probability_1").alias("probability"))
    s = s.withColumn("label", F.when(F.col("probability") >= 0.6, "Likely Subscribe").otherwise("Low Intent"))
    return K.campaign_advice(s, "probability", F.lit(name), F.array(*[F.lit(n) for n, _ in imp]))


@query("score_deposit")
def q_score_deposit(spark, d):
    return score_campaign(spark, d)


@query("deposit_leaderboard")
def q_deposit_leaderboard(spark, d):
    """Metrics of the deposit models by rank; the champion's row names its top-8 features."""
    split, board, stored = _campaign_board(spark, d)
    champion = board.filter("champion").first()["model"]  # one row per model
    imp = sorted(M.model_importance(stored(champion), split.features), key=lambda t: -t[1])[:8]
    top = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(float(v)).alias("importance")) for n, v in imp])
    return board.withColumn("top_features", F.when(F.col("champion"), top)).orderBy("rank")


@query("feature_importance")
def q_feature_importance(spark, d):
    """Importance of the stored default model, normalised and sorted (one row per feature)."""
    rows = M.model_importance(_default_model(spark, d), M.DEFAULT_FEATURES)
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


@query("persona_kmeans")
def q_persona_kmeans(spark, d):
    """Standardised recency/frequency/monetary, k-means k=4 (best of 20 seeded runs),
    personas named from the cluster profile."""
    from ..operators import clean as Cl
    from ..operators import segment as G
    from ..sources.domain import transactions
    cust = G.rfm_wealth_layer(Cl.prepare_transactions(transactions(Tables(spark, d))))
    z = M.standard_scale(cust, ["Recency", "Frequency", "Monetary"], suffix="_z")
    _, _, assigned = M.kmeans_best(z, ["Recency_z", "Frequency_z", "Monetary_z"], k=4, n_init=20)
    prof = G.persona_mapping(G.cluster_profile(assigned))
    return assigned.join(F.broadcast(prof.select("Cluster", "Persona")), "Cluster").select("CustomerID", "Cluster", "Persona")


@query("isolation_forest")
def q_isolation_forest(spark, d):
    """Forest of 200 isolation trees on standardised deposit features; outlier when the
    decision (score - 3 % quantile) is negative."""
    s = N.outliers(deposits(Tables(spark, d)))
    return s.select("deposit_id", "iso_score", "iso_decision", "is_outlier")


@query("reconstruction_error")
def q_reconstruction_error(spark, d):
    """Mean squared error of every deposit's standardised features under a 2-2 autoencoder fitted on all of them."""
    dep = deposits(Tables(spark, d))
    z = M.standard_scale(dep.select("deposit_id", *[F.col(c).cast("double") for c in N.FEATURES]), N.FEATURES)
    z = stable(z, "deposits_scaled")
    return AE.reconstruction_error(z, N.FEATURES, AE.fit(z, N.FEATURES)).select("deposit_id", "reconstruction_error")


@query("reconstruction_threshold")
def q_reconstruction_threshold(spark, d):
    """The error from which a deposit counts as badly reconstructed (97 % quantile), and how many reach it."""
    dep = deposits(Tables(spark, d))
    z = stable(M.standard_scale(dep.select(*[F.col(c).cast("double") for c in N.FEATURES]), N.FEATURES), "deposits_scaled")
    e = stable(AE.reconstruction_error(z, N.FEATURES, AE.fit(z, N.FEATURES)).select("reconstruction_error"), "reconstruction")
    thr = N.reconstruction_threshold(e)
    return e.crossJoin(F.broadcast(thr)).groupBy("reconstruction_high").agg(
        F.count(F.lit(1)).alias("records"), F.sum((F.col("reconstruction_error") >= F.col("reconstruction_high")).cast("long")).alias("high"))


@query("score_deposits")
def q_score_deposits(spark, d):
    s = N.score_deposits(deposits(Tables(spark, d)))
    return s.select("deposit_id", "anomaly_score", "is_anomaly", "reasons", "risk_label")


@query("dedupe_reasons", _THR_SQL + """
, ex AS (SELECT user_id, ts, deposit_id, unnest(string_split(rule_reasons, ', ')) AS reason,
                unnest(range(len(string_split(rule_reasons, ', ')))) AS pos FROM rs WHERE rule_flagged)
, fo AS (SELECT user_id, reason, ts, deposit_id, pos FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id, reason ORDER BY ts, deposit_id, pos) AS rn FROM ex) t WHERE rn = 1)
SELECT user_id, string_agg(reason, ', ' ORDER BY ts, deposit_id, pos) AS reasons, CAST(count(*) AS INTEGER) AS n_reasons
FROM fo GROUP BY user_id""")
def q_dedupe_reasons(spark, d):
    """Per user, the distinct rule reasons of their flagged deposits in order of first
    appearance."""
    from ..operators import aggregate as A
    r = _rules(spark, d).filter("rule_flagged")
    ex = r.select("user_id", "ts", "deposit_id", F.posexplode(F.split("rule_reasons", ", ")).alias("pos", "reason"))
    o = A.ordered_distinct(ex, ["user_id"], "reason", ["ts", "deposit_id", "pos"], out="_r")
    return o.select("user_id", F.array_join("_r", ", ").alias("reasons"), F.size("_r").alias("n_reasons"))


def _union_features_sql() -> str:
    cols = sorted(set(M.DEFAULT_FEATURES) | set(M.CHURN_FEATURES))
    mm = ", ".join(f"coalesce(min({c}) <> max({c}), false) AS {c}" for c in cols)
    st = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS varies FROM mm" for c in cols)
    sets = " UNION ".join(
        f"SELECT feature FROM st WHERE varies AND feature IN ({', '.join(repr(c) for c in fs)})"
        for fs in (M.DEFAULT_FEATURES, M.CHURN_FEATURES))
    return V("clean_loans") + f", mm AS (SELECT {mm} FROM clean_loans), st AS ({st})\nSELECT feature FROM ({sets}) u"


@query("union_features", _union_features_sql())
def q_union_features(spark, d):
    """Sorted union of the features the default and churn models need (those that vary
    in the cleaned portfolio)."""
    return M.required_features(clean_loans(Tables(spark, d)), {"default": M.DEFAULT_FEATURES, "churn": M.CHURN_FEATURES})


@query("smote")
def q_smote(spark, d):
    """Training split of the default model balanced 50/50 with SMOTE (k = 5, exact
    neighbours among defaulted loans); original rows plus synthetic rows."""
    from ..operators import resample as RS
    c = clean_loans(Tables(spark, d))
    f = E.prepare_features(c, M.DEFAULT_FEATURES, keep=["loan_id", "default_flag"])
    train = M.stratified_split(f, "default_flag", "loan_id").filter("is_train").drop("is_train")
    return RS.smote(train, "default_flag", "loan_id", M.DEFAULT_FEATURES, k=5)
