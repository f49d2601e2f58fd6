"""Aggregations: monthly and grade volumes, pivots, profiles and summaries.

All of them are ``groupBy().agg()`` with built-in aggregates, so Spark does a partial
(map-side) aggregate before the shuffle and a hot key costs one small partial row per
map task. Exact medians/quantiles go through :mod:`ledgerlark.operators.ranking`
instead of the ``percentile`` aggregate, whose buffer for one key would hold every
distinct value of that key in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranking as R
from .joins import lookup
from ..functions import expr as X
from .clean import require_columns

GRADES = ["A", "B", "C", "D", "E"]


def month_start(c: str = "issue_d"):
    return F.trunc(F.col(c), "MM")


def monthly_volume(loans: DataFrame) -> DataFrame:
    """Per issue month: funded total (cents-exact), loan count, mean rate, mean amount,
    funded total in millions. Rows with NULL issue date or funded amount are dropped."""
    require_columns(loans, ["issue_d", "funded_amnt", "int_rate", "loan_amnt"], "monthly loan volume")
    work = loans.filter(F.col("issue_d").isNotNull() & F.col("funded_amnt").isNotNull())
    funded = X.exact_sum2("funded_amnt")
    return work.groupBy(month_start().alias("month_start")).agg(
        funded.alias("funded_amnt"),
        F.count(F.lit(1)).alias("loan_count"),
        X.exact_mean2("int_rate").alias("avg_int_rate"),
        X.exact_mean2("loan_amnt").alias("avg_loan_amnt"),
        (funded / 1000000.0).alias("funded_amnt_m"),
    )


def grade_monthly(loans: DataFrame, grades: list[str] | None = None) -> DataFrame:
    """Per month x grade (grade upper/trim). ``grades`` keeps only those (notebook: A-E)."""
    require_columns(loans, ["issue_d", "grade", "funded_amnt", "int_rate"], "grade demand")
    work = loans.filter(F.col("issue_d").isNotNull() & F.col("grade").isNotNull() & F.col("funded_amnt").isNotNull())
    work = work.withColumn("grade", F.upper(F.trim("grade")))
    if grades:
        work = work.filter(F.col("grade").isin(grades))
    funded = X.exact_sum2("funded_amnt")
    return work.groupBy(month_start().alias("month_start"), "grade").agg(
        funded.alias("funded_amnt"),
        F.count(F.lit(1)).alias("loan_count"),
        X.exact_mean2("int_rate").alias("avg_int_rate"),
        (funded / 1000000.0).alias("funded_amnt_m"),
    )


def grade_pivot(grade_df: DataFrame, value: str = "funded_amnt_m", grades: list[str] = GRADES) -> DataFrame:
    """One row per month, one column per grade (fixed list, so no extra pass to find
    the pivot values); missing -> 0."""
    p = grade_df.groupBy("month_start").pivot("grade", grades).agg(F.sum(value))
    return p.na.fill(0.0, subset=grades)


def grade_seasonality(grade_df: DataFrame, value: str = "funded_amnt_m", grades: list[str] = GRADES) -> DataFrame:
    """Mean by grade x calendar month over a 12-slot spine; empty slots -> 0."""
    by = grade_df.groupBy("grade", F.month("month_start").alias("cal_month")).agg(F.avg(value).alias("avg_value"))
    spine = (grade_df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("cal_month"))
             .crossJoin(grade_df.sparkSession.createDataFrame([(g,) for g in grades], "grade string")))
    return F.broadcast(spine).join(by, ["grade", "cal_month"], "left").select(
        "grade", "cal_month", F.coalesce("avg_value", F.lit(0.0)).alias("avg_value"))


def year_month_heatmap(grade_df: DataFrame, value: str = "funded_amnt_m") -> DataFrame:
    """Per grade and year: mean value for each calendar month 1..12 as columns m01..m12."""
    months = list(range(1, 13))
    p = (grade_df.withColumn("year", F.year("month_start")).withColumn("cal_month", F.month("month_start"))
         .groupBy("grade", "year").pivot("cal_month", months).agg(F.avg(value)))
    return p.select("grade", "year", *[F.col(str(m)).alias(f"m{m:02d}") for m in months])


def forecast_wide(fc: DataFrame, grades: list[str] = GRADES) -> DataFrame:
    """Long per-grade forecast -> one row per month with central/lower/upper/range per grade."""
    fc = fc.withColumn("band", F.greatest(F.lit(0.0), F.col("forecast_upper") - F.col("forecast_lower")))
    p = fc.groupBy("month_start").pivot("series_id", grades).agg(
        F.first("forecast_central").alias("central"), F.first("forecast_lower").alias("lower"),
        F.first("forecast_upper").alias("upper"), F.first("band").alias("range"))
    return p


def regional_benchmark(tx: DataFrame, loc: str = "CustLocationNorm", amount: str = "TransactionAmount") -> DataFrame:
    """Per location: exact median, q1, q3, p99 (linear interpolation); IQR with 0 -> 1."""
    q = R.group_quantiles(tx, [loc], amount, {"loc_median": 0.5, "loc_q1": 0.25, "loc_q3": 0.75, "loc_p99": 0.99})
    iqr = F.col("loc_q3") - F.col("loc_q1")
    return q.withColumn("loc_iqr", F.when(iqr == 0, F.lit(1.0)).otherwise(iqr))


def customer_benchmark(tx: DataFrame, cid: str = "CustomerID", amount: str = "TransactionAmount") -> DataFrame:
    """Per customer: exact median, sample std (NULL -> 0), count."""
    med = R.group_quantiles(tx, [cid], amount, {"cust_median": 0.5})
    st = tx.groupBy(cid).agg(F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("cust_std"),
                             F.count(amount).alias("cust_n"))
    return st.join(med, cid, "left")


def location_mode(tx: DataFrame, cid: str = "CustomerID", loc: str = "CustLocationNorm") -> DataFrame:
    """Most frequent location per customer; ties -> alphabetically first."""
    counts = tx.groupBy(cid, loc).agg(F.count(F.lit(1)).alias("_n"))
    # One row per (customer, location) after a partial aggregate; min_by over the key
    # (-count, name) picks the highest count, then the smallest name, without a window.
    return counts.groupBy(cid).agg(F.min_by(F.col(loc), F.struct(-F.col("_n"), F.col(loc))).alias(loc))


def pipeline_summary(tx: DataFrame, customers: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Single row: transactions, distinct customers, vital-few share, anomaly share."""
    a = tx.agg(F.count(F.lit(1)).alias("transactions"), F.countDistinct("CustomerID").alias("customers"))
    b = customers.agg(F.avg(F.col("IsVitalFew").cast("double")).alias("vital_few_share"))
    c = anomalies.agg(F.avg(F.col("IsBehavioralAnomaly").cast("double")).alias("behavioral_anomaly_share"),
                      F.sum(F.col("IsBehavioralAnomaly").cast("long")).alias("behavioral_anomalies"))
    return a.crossJoin(b).crossJoin(c)


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long form (column_name, value) of the sorted distinct values of each column."""
    parts = [df.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")).distinct() for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("column_name", "value")


def column_profile(df: DataFrame, cols: list[str], mean_scale: int | None = None) -> DataFrame:
    """name, type, null_pct, mean, min, max, unique_count per column (one aggregate pass;
    ``count(DISTINCT)`` is exact). ``mean_scale`` = known decimal places of the numeric
    columns: the mean is then taken over an exact DECIMAL sum."""
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        numeric = types[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or types[c].startswith("decimal")
        aggs += [
            F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__nulls"),
            ((F.sum(F.col(c).cast(f"decimal(38,{mean_scale})")).cast("double") / F.count(c) if mean_scale is not None
              else F.avg(c)) if numeric else F.lit(None).cast("double")).alias(f"{c}__mean"),
            F.min(c).cast("string").alias(f"{c}__min"),
            F.max(c).cast("string").alias(f"{c}__max"),
            F.countDistinct(c).alias(f"{c}__uniq"),
        ]
    row = df.agg(*aggs)
    stack = ", ".join(
        f"'{c}', '{types[c]}', `{c}__nulls`, `{c}__mean`, `{c}__min`, `{c}__max`, `{c}__uniq`" for c in cols)
    return row.select("__n", F.expr(
        f"stack({len(cols)}, {stack}) AS (column_name, data_type, null_count, mean, min_value, max_value, unique_count)"
    )).select("column_name", "data_type",
              F.round(F.col("null_count") * 100.0 / F.col("__n"), 4).alias("null_pct"),
              F.round("mean", 6).alias("mean"), "min_value", "max_value", "unique_count")


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson and Spearman correlation for every pair (long form). Spearman = Pearson
    of average ranks; ranks come from ``rank()`` windows per column (ties averaged)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    pear = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    ranked = df.select(*cols)
    for c in cols:
        ranked = lookup(ranked, average_rank(df, c), [c])
    spear = ranked.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}__{b}") for a, b in pairs])
    stack_p = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    p_long = pear.select(F.expr(f"stack({len(pairs)}, {stack_p}) AS (col_a, col_b, pearson)"))
    s_long = spear.select(F.expr(f"stack({len(pairs)}, {stack_p}) AS (col_a, col_b, spearman)"))
    return p_long.join(s_long, ["col_a", "col_b"]).select(
        "col_a", "col_b", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def average_rank(df: DataFrame, c: str) -> DataFrame:
    """(value, average rank) with ties averaged; see ``ranking.average_rank_table``."""
    return R.average_rank_table(df, c, out=f"_r_{c}")


def ordered_distinct(df: DataFrame, keys: list[str], item: str, order: list[str], out: str = "items") -> DataFrame:
    """Distinct ``item`` values per key, in order of first occurrence (``dict.fromkeys``).

    First occurrences come from a partial-aggregated ``min(struct(order))`` per
    (key, item), so a hot key never gathers its raw rows; only its distinct items (a
    small vocabulary, e.g. reason labels) are collected and sorted."""
    first = df.groupBy(*keys, item).agg(F.min(F.struct(*order)).alias("_first"))
    g = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", F.col(item).alias("_it")))).alias("_s"))
    return g.select(*keys, F.transform("_s", lambda s: s["_it"]).alias(out))
