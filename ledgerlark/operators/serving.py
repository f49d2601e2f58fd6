"""Next-month feature rows for serving and recursive forecasts.

One row per series holding its recent history as a sorted array, so each recursive
step is a projection over that array (``slice``/``element_at``/``aggregate``) and a
model ``transform``; no per-series Python and no driver loop over series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

T, V = "month_start", "value"


def history_arrays(df: DataFrame, keys: list[str] | None = None, depth: int = 12) -> DataFrame:
    """(keys, last_month, hist) with ``hist`` = the last ``depth`` values, oldest first.
    ``max_by``-style top-k per series is bounded by ``depth`` elements."""
    keys = keys or ["series_id"]
    recent = _last_rows(df.filter(F.col(V).isNotNull()), keys, depth)
    srt = F.array_sort(F.collect_list(F.struct(F.col(T).alias("t"), F.col(V).alias("v"))))
    g = recent.groupBy(*keys).agg(srt.alias("_h"), F.max(T).alias("last_month"))
    return g.select(*keys, "last_month", F.transform("_h", lambda s: s["v"]).alias("hist"))


def _last_rows(df: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The last ``depth`` rows of each series, so at most ``depth`` rows per series are
    gathered into an array however long its history is."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(T).desc()))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= depth).drop("_rn")


def features_from_history(h: DataFrame) -> DataFrame:
    """Feature columns from the ``hist`` array for the month after ``last_month``."""
    n = F.size("hist")

    def back(k: int):
        return F.when(n >= k, F.element_at("hist", -k))

    def mean_last(k: int):
        tail = F.slice("hist", -F.least(n, F.lit(k)), F.least(n, F.lit(k)))
        return F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x) / F.size(tail)

    nxt = F.add_months("last_month", 1)
    lag1 = back(1)
    lag2 = back(2)
    return h.withColumns({
        T: nxt, "month": F.month(nxt), "quarter": F.quarter(nxt), "year": F.year(nxt),
        "lag_1": lag1, "lag_2": F.coalesce(lag2, lag1), "lag_3": F.coalesce(back(3), lag1),
        "lag_6": F.coalesce(back(6), lag1), "lag_12": F.coalesce(back(12), lag1),
        "rolling_3": mean_last(3), "rolling_6": mean_last(6), "rolling_12": mean_last(12),
        "mom_growth": F.when(lag2.isNull() | (lag2 == 0), F.lit(0.0)).otherwise((lag1 - lag2) / F.abs(lag2)),
    })


def next_month_features(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["series_id"]
    f = features_from_history(history_arrays(df, keys))
    return f.select(*keys, T, "month", "quarter", "year", "lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "rolling_3",
                    "rolling_6", "rolling_12", "mom_growth")


COVARIATES = ["avg_int_rate", "avg_loan_amnt", "loan_count"]


def last_covariates(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, covariates): each covariate's last known value of a series."""
    known = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(T))).alias(c) for c in COVARIATES]
    return panel.groupBy(*(keys or ["series_id"])).agg(*known)


def scaled_loan_count(panel: DataFrame, total_hint: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, loan_count): a series' mean count (1 at least) scaled by the expected total of the
    month over the series' mean value (1 at least); 1 at least. ``total_hint``: one row, ``total_hint``."""
    means = panel.filter(F.col(V).isNotNull()).groupBy(*(keys or ["series_id"])).agg(F.avg("loan_count").alias("_c"), F.avg(V).alias("_v"))
    one = F.lit(1.0)
    count = F.greatest(one, F.col("_c")) * (F.greatest(F.col("total_hint"), one) / F.greatest(F.col("_v"), one))
    return means.crossJoin(F.broadcast(total_hint)).select(*(keys or ["series_id"]), F.greatest(one, count).alias("loan_count"))


# The loan-volume scenario presets (growth %, rate shock bps, loan count %,
# average loan amount %) and the band multiplier of each scenario.
VOLUME_SCENARIOS = {
    "baseline": (0.0, 0.0, 0.0, 0.0),
    "optimistic": (5.0, -20.0, 8.0, 3.0),
    "conservative": (-5.0, 30.0, -6.0, -2.0),
    "stress": (-12.0, 75.0, -15.0, -4.0),
}
VOLUME_RISK_MULTIPLIER = {"baseline": 1.0, "optimistic": 0.9, "conservative": 1.15, "stress": 1.35}
GRADE_FEATURES = ["month", "quarter", "year", "lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "rolling_3", "rolling_6",
                  "avg_int_rate", "loan_count", "mom_growth"]
VOLUME_FEATURES = ["month", "quarter", "year", "lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "rolling_3", "rolling_6",
                   "rolling_12", "avg_int_rate", "avg_loan_amnt", "loan_count", "mom_growth"]


def model_frame(panel: DataFrame, sid: str = "series_id") -> DataFrame:
    """(series, month, label, features) rows of a panel on which volume models are trained."""
    from . import windows as W
    tf = W.training_frame(panel, sid=sid).withColumnsRenamed({f"rolling_mean_{k}": f"rolling_{k}" for k in (3, 6, 12)})
    return tf.select(sid, T, F.col(V).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in VOLUME_FEATURES])


def volume_models(panel: DataFrame, keys: list[str] | None = None, seed: int = 42):
    """Boosted-tree and linear regressors of next-month value on lag, rolling, growth and
    covariate features, pooled over all series of ``panel`` (keys, month_start, value,
    avg_int_rate, loan_count, avg_loan_amnt)."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    from ..session import stable
    from . import ml as M
    tf = stable(model_frame(panel, (keys or ["series_id"])[0]), "volume_frame")  # both fits read it
    tree = M.fit(tf, VOLUME_FEATURES, GBTRegressor(**M.BOOSTING, maxDepth=4, subsamplingRate=0.8, seed=seed, labelCol="label",
                                                   predictionCol="_tree"))
    lin = M.fit(tf, VOLUME_FEATURES, LinearRegression(labelCol="label", predictionCol="_lin", regParam=0.01))
    return tree, lin


def volume_forecast_recursive(panel: DataFrame, keys: list[str] | None = None, horizon: int = 6,
                              scenario: str = "baseline", growth_adjust_pct: float | None = None,
                              models=None, checkpoint_every: int = 3) -> DataFrame:
    """Recursive multi-step forecast for every series with at least 12 months.

    State is one row per series: the last 12 values (oldest first) and the last known
    covariates. Each step builds the next month's features from the array, applies the
    scenario shocks to the covariates, blends 0.7 x tree + 0.3 x linear (floored at 0,
    times the growth adjustment), sets the band from the model gap, the std of the last
    12 differences (5 % floor) x sqrt(step), the scenario risk multiplier and the growth
    size, then appends the central value and the implied loan count to the state.
    The state is checkpointed every few steps so lineage stays short."""
    from ..session import stable
    keys = keys or ["series_id"]
    g_pct, bps, cnt_pct, amt_pct = VOLUME_SCENARIOS.get(scenario, VOLUME_SCENARIOS["baseline"])
    if growth_adjust_pct is not None:
        g_pct = float(growth_adjust_pct)
    risk = VOLUME_RISK_MULTIPLIER.get(scenario, 1.0)
    tree, lin = models or volume_models(panel, keys)

    w = F.array_sort(F.collect_list(F.struct(F.col(T).alias("t"), F.col(V).alias("v"), "avg_int_rate", "loan_count",
                                             "avg_loan_amnt")))
    valid = panel.filter(F.col(V).isNotNull())
    n = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 12)
    st = _last_rows(valid, keys, 12).groupBy(*keys).agg(w.alias("_h")).join(n, keys)
    last = F.element_at("_h", -1)
    st = st.select(*keys, last["t"].alias("last_month"),
                   F.transform(F.slice("_h", -12, 12), lambda s: s["v"]).alias("hist"),
                   last["avg_int_rate"].alias("_rate"), last["loan_count"].cast("double").alias("_count"),
                   last["avg_loan_amnt"].alias("_amnt"),
                   F.array().cast("array<struct<step:int,month_start:date,forecast_central:double,"
                                  "forecast_lower:double,forecast_upper:double>>").alias("_out"))
    for step in range(1, horizon + 1):
        f = features_from_history(st).withColumns({
            "avg_int_rate": F.greatest(F.lit(0.0), F.col("_rate") + bps / 100.0),
            "loan_count": F.greatest(F.lit(1.0), F.col("_count") * (1 + cnt_pct / 100.0)),
            "avg_loan_amnt": F.greatest(F.lit(500.0), F.col("_amnt") * (1 + amt_pct / 100.0)),
        }).withColumns({c: F.col(c).cast("double") for c in VOLUME_FEATURES})
        p = lin.transform(tree.transform(f).drop("features")).drop("features")
        central = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), 0.7 * F.col("_tree") + 0.3 * F.col("_lin")) * (1 + g_pct / 100.0))
        p = p.withColumn("_c", central)
        d = F.transform(F.sequence(F.lit(2), F.size("hist")), lambda i: F.element_at("hist", i) - F.element_at("hist", i - 1))
        nd = F.size("hist") - 1
        mean_d = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / nd
        var_d = F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - mean_d) * (x - mean_d)) / nd
        vol = F.when(F.size("hist") > 2, F.sqrt(var_d)).otherwise(F.lit(0.0))
        vol = F.greatest(vol, 0.05 * F.greatest(F.abs(F.col("_c")), F.lit(1.0)))
        spread = (F.greatest(F.abs(F.col("_tree") - F.col("_lin")), vol * float(step) ** 0.5) * risk
                  * (1.0 + min(0.35, abs(g_pct) / 100.0)))
        p = p.withColumn("_sp", spread).withColumn("_lo", F.greatest(F.lit(0.0), F.col("_c") - 1.28 * F.col("_sp")))
        rec = F.struct(F.lit(step).alias("step"), F.col(T).alias("month_start"), X.rnd(F.col("_c"), 2).alias("forecast_central"),
                       X.rnd(F.col("_lo"), 2).alias("forecast_lower"),
                       X.rnd(F.greatest(F.col("_lo"), F.col("_c") + 1.28 * F.col("_sp")), 2).alias("forecast_upper"))
        amnt = F.when(F.col("avg_loan_amnt") <= 0, F.lit(1.0)).otherwise(F.col("avg_loan_amnt"))
        inferred = F.greatest(F.lit(1.0), F.col("_c") * 1_000_000.0 / amnt)
        st = p.select(*keys, F.col(T).alias("last_month"), F.slice(F.concat("hist", F.array("_c")), -12, 12).alias("hist"),
                      F.col("avg_int_rate").alias("_rate"), F.greatest(inferred, F.col("loan_count")).alias("_count"),
                      amnt.alias("_amnt"), F.concat("_out", F.array(rec)).alias("_out"))
        if step % checkpoint_every == 0 and step < horizon:
            st = stable(st)
    return st.select(*keys, F.inline("_out"))
