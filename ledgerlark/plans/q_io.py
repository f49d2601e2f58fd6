"""Queries for sources and sinks: each writes table-derived data to the
shared checkpoint folder in the source format, reads it back with the source operator,
and returns what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import ml as M
from ..operators import encode as E
from ..session import scratch_path
from ..sources import io as IO
from ..sources.domain import Tables, clean_loans, deposits, raw_loans, series, transactions
from ..sources.tables import table_path
from .q_clean import CLEAN_COLS
from .registry import query
from .sql_views import with_views as V


def _tmp(spark, name):
    return scratch_path(spark, f"io/{name}-{uuid.uuid4().hex}")


RAW_SCHEMA = ("loan_id bigint, member_id bigint, loan_status string, loan_amnt double, funded_amnt double, int_rate string, "
              "revol_util string, installment double, annual_inc double, dti double, grade string, issue_d string, "
              "earliest_cr_line string, last_pymnt_d string, last_credit_pull_d string, emp_length string, term string, "
              "home_ownership string, purpose string, delinq_2yrs int, inq_last_6mths int, open_acc int, pub_rec int, "
              "total_acc int, mths_since_last_delinq int")


@query("scan_csv", V("raw_loans") + "SELECT * FROM raw_loans")
def q_scan_csv(spark, d):
    path = IO.write_csv(raw_loans(Tables(spark, d)), _tmp(spark, "raw_loans_csv"))
    return IO.scan_csv(spark, path, RAW_SCHEMA)


@query("scan_csv_flexible", V("raw_loans") + "SELECT * FROM raw_loans")
def q_scan_csv_flexible(spark, d):
    """A semicolon-separated export read back with the separator detected from its header."""
    path = IO.write_csv(raw_loans(Tables(spark, d)), _tmp(spark, "raw_loans_semicolon"), sep=";")
    return IO.scan_csv_flexible(spark, path, RAW_SCHEMA)


@query("resolve_source", "SELECT * FROM orders")
def q_resolve_source(spark, d):
    """First existing candidate wins: a missing cache path, then the shared table."""
    path = IO.resolve_source(spark, [_tmp(spark, "missing-cache"), table_path(d, "orders")], "orders")
    return spark.read.parquet(path)


_DEP_SCHEMA = T.StructType([T.StructField("deposit_id", T.LongType()), T.StructField("amount", T.DoubleType()),
                            T.StructField("hour", T.IntegerType()), T.StructField("day_of_week", T.IntegerType()),
                            T.StructField("frequency", T.IntegerType())])


@query("scan_json_rows", V("deposits") + "SELECT deposit_id, amount, hour, day_of_week, frequency FROM deposits")
def q_scan_json_rows(spark, d):
    """Request rows as JSON objects, half of them spelling the field ``dayOfWeek``."""
    dep = deposits(Tables(spark, d))
    obj = F.when(F.col("deposit_id") % 2 == 0,
                 F.to_json(F.struct("deposit_id", "amount", "hour", "day_of_week", "frequency")))
    alt = F.to_json(F.struct("deposit_id", "amount", "hour", F.col("day_of_week").alias("dayOfWeek"), "frequency"))
    path = _tmp(spark, "deposit_json")
    dep.select(F.coalesce(obj, alt).alias("value")).write.mode("overwrite").text(path)
    return IO.scan_json_rows(spark, path, _DEP_SCHEMA, aliases={"dayOfWeek": "day_of_week"})


@query("scan_nested_history", V("series") + "SELECT series_id, month_start, value FROM series")
def q_scan_nested_history(spark, d):
    """Per series, a document whose ``history`` is a JSON string of ``{ds, y}`` points
    (one point per month, so each document is bounded by the calendar), parsed back."""
    s = series(Tables(spark, d))
    pts = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.date_format("month_start", "yyyy-MM-dd").alias("ds"),
                                                                  F.col("value").alias("y")))).alias("data")))
    docs = s.groupBy("series_id").agg(pts.alias("history"))
    path = _tmp(spark, "history_json")
    docs.write.mode("overwrite").json(path)
    back = spark.read.schema("series_id string, history string").json(path)
    return IO.parse_nested_history(back, keys=["series_id"])


@query("require_columns", V("transactions") + "SELECT TransactionID, CustomerID FROM transactions")
def q_require_columns(spark, d):
    """Campaign columns given to the card-transaction loader fail with a named error;
    the transactions themselves (amount under its alias) pass."""
    from ..sources.domain import campaign
    try:
        C.require_columns(campaign(Tables(spark, d)), C.TX_REQUIRED, "wealth persona", any_of=[C.AMOUNT_ALIASES])
        raise AssertionError("expected a missing-column error")
    except C.MissingColumnsError:
        pass
    tx = transactions(Tables(spark, d))
    return C.require_columns(tx, C.TX_REQUIRED, "wealth persona", any_of=[C.AMOUNT_ALIASES]).select("TransactionID", "CustomerID")


@query("ensure_materialized", V("clean_loans") + f"SELECT {CLEAN_COLS} FROM clean_loans")
def q_ensure_materialized(spark, d):
    path = _tmp(spark, "clean_loans")
    IO.ensure_materialized(spark, path, lambda: clean_loans(Tables(spark, d)))
    return IO.ensure_materialized(spark, path, lambda: (_ for _ in ()).throw(AssertionError("rebuilt")))


@query("sink_table", V("monthly_volume") + """
SELECT month_start, funded_amnt, loan_count, avg_int_rate, avg_loan_amnt, funded_amnt_m, CAST(year(month_start) AS INTEGER) AS year
FROM monthly_volume""")
def q_sink_table(spark, d):
    """Monthly volume written partitioned by year and read back (partition column restored)."""
    m = A.monthly_volume(clean_loans(Tables(spark, d))).withColumn("year", F.year("month_start"))
    path = IO.sink_table(m, _tmp(spark, "monthly"), partition_by=["year"])
    return spark.read.parquet(path)


@query("sink_json_records", V("series") + "SELECT series_id, month_start, value FROM series")
def q_sink_json_records(spark, d):
    """The series written as JSON lines and read back."""
    path = IO.sink_json(series(Tables(spark, d)), ["series_id", "month_start", "value"], _tmp(spark, "series_json"))
    return spark.read.schema("series_id string, month_start date, value double").json(path)


@query("sink_scored_export", V("scored_loans") + """
SELECT loan_id, default_probability, churn_probability FROM scored_loans""")
def q_sink_scored_export(spark, d):
    """Scored portfolio exported as header CSV and read back."""
    from ..operators import risk as K
    s = K.standin_scores(clean_loans(Tables(spark, d))).select("loan_id", "default_probability", "churn_probability")
    path = IO.sink_table(s, _tmp(spark, "scored_csv"), fmt="csv")
    return spark.read.schema("loan_id bigint, default_probability double, churn_probability double").option("header", True).csv(path)


@query("model_store")
def q_model_store(spark, d):
    """Train once, cache the model keyed by its sources' versions and its parameters, reload and score."""
    src = [table_path(d, name) for name in ("orders", "lineitem", "customer")]
    params = {"model": "logistic regression", "maxIter": M.LR_ITER, "features": M.DEFAULT_FEATURES}
    store = _tmp(spark, "model_store")
    f = E.prepare_features(clean_loans(Tables(spark, d)), M.DEFAULT_FEATURES, keep=["loan_id", "default_flag"]).withColumn(
        "label", F.col("default_flag").cast("double"))
    build = lambda: M.fit(f, M.DEFAULT_FEATURES, M.LogisticRegression(maxIter=M.LR_ITER))
    IO.cached_artifact(spark, src, store, build, params)
    model = IO.cached_artifact(spark, src, store, lambda: (_ for _ in ()).throw(AssertionError("cache miss")), params)
    return M.positive_probability(model.transform(f)).select("loan_id", "probability_1")
