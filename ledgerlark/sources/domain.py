"""Domain views over the shared tables (DataFrame twins of ``plans/sql_views.py``).

The reference works on loan, campaign, deposit and card-transaction tables that are
not shipped; these views map the star schema onto those shapes. Each view is a lazy
plan; nothing is materialised here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import clean as C
from ..operators import windows as W
from ..plans.sql_views import PURPOSES, _CONTACT, _EDU, _JOBS, _MARITAL, _MONTHS, _POUT
from .tables import Tables, spread


def _pick(key: Column, values: list[str]) -> Column:
    out = None
    for i, v in enumerate(values):
        out = (F.when(key == i, F.lit(v)) if out is None else out.when(key == i, F.lit(v)))
    return out


def li_order(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("li_amount"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("li_disc_c"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("li_tax_c"),
        F.sum(F.round(F.col("l_quantity")).cast("bigint")).alias("li_qty"),
        F.count(F.lit(1)).alias("li_n"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("bigint").alias("li_returns"),
        F.max("l_shipdate").alias("li_last_ship"),
        F.min("l_shipdate").alias("li_first_ship"),
    )


def raw_loans(t: Tables) -> DataFrame:
    o = t.orders.alias("o")
    li = li_order(t).alias("li")
    c = t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment").alias("c")
    j = o.join(li, F.col("o.o_orderkey") == F.col("li.l_orderkey"), "left").join(
        c, F.col("o.o_custkey") == F.col("c.c_custkey"), "left")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    grade = (F.when(F.substring("o_orderpriority", 1, 1) == "1", "A")
             .when(F.substring("o_orderpriority", 1, 1) == "2", "B")
             .when(F.substring("o_orderpriority", 1, 1) == "3", "C")
             .when(F.substring("o_orderpriority", 1, 1) == "4", "D")
             .when(F.substring("o_orderpriority", 1, 1) == "5", "E"))
    rate_bp = F.lit(500) + (F.col("li_disc_c") * 37 + ok) % 2000
    util_pm = (F.col("li_qty") * 13 + ck) % 1000
    home = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", "RENT").when(F.col("c_mktsegment") == "BUILDING", "OWN")
            .when(F.col("c_mktsegment").isin("FURNITURE", "HOUSEHOLD"), "MORTGAGE").otherwise("OTHER"))
    purpose = _pick(ok % 7, PURPOSES)
    emp_k = ck % 12
    return j.select(
        ok.alias("loan_id"),
        ck.alias("member_id"),
        F.when(F.col("o_orderstatus") == "F", "Fully Paid").when(F.col("o_orderstatus") == "P", "Charged Off")
        .otherwise("Current").alias("loan_status"),
        F.col("li_amount").alias("loan_amnt"),
        F.col("o_totalprice").alias("funded_amnt"),
        F.when(ok % 53 == 0, F.lit("n/a")).otherwise(
            F.concat(F.floor(rate_bp / 100).cast("string"), F.lit("."), F.lpad((rate_bp % 100).cast("string"), 2, "0"), F.lit("%"))
        ).alias("int_rate"),
        F.concat(F.floor(util_pm / 10).cast("string"), F.lit("."), (util_pm % 10).cast("string"), F.lit("%")).alias("revol_util"),
        (F.col("o_totalprice") / F.when(ok % 2 == 0, 36).otherwise(60)).alias("installment"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 20 + 20000).alias("annual_inc"),
        (((F.col("li_tax_c") * 3 + F.col("c_nationkey") * 50) % 3500).cast("double") / 100).alias("dti"),
        F.when(ok % 10 == 3, F.concat(F.lower(grade), F.lit(" "))).when(ok % 10 == 7, F.concat(F.lit(" "), grade))
        .otherwise(grade).alias("grade"),
        F.date_format("o_orderdate", "MMM-yyyy").alias("issue_d"),
        F.date_format(F.add_months(F.to_date("o_orderdate"), -(F.lit(12) + ck % 240).cast("int")), "MMM-yyyy").alias("earliest_cr_line"),
        F.date_format("li_last_ship", "MMM-yyyy").alias("last_pymnt_d"),
        F.date_format("li_first_ship", "MMM-yyyy").alias("last_credit_pull_d"),
        F.when(emp_k == 0, "< 1 year").when(emp_k == 1, "1 year").when(emp_k == 10, "10+ years").when(emp_k == 11, "n/a")
        .otherwise(F.concat(emp_k.cast("string"), F.lit(" years"))).alias("emp_length"),
        F.when(ok % 2 == 0, " 36 months").otherwise(" 60 months").alias("term"),
        F.when(ok % 9 == 4, F.concat(F.lit(" "), home, F.lit(" "))).otherwise(home).alias("home_ownership"),
        F.when(ok % 11 == 5, F.upper(purpose)).otherwise(purpose).alias("purpose"),
        F.col("li_returns").cast("int").alias("delinq_2yrs"),
        (ck % 7).cast("int").alias("inq_last_6mths"),
        F.col("li_n").cast("int").alias("open_acc"),
        F.when(ck % 13 == 0, 1).otherwise(0).alias("pub_rec"),
        (F.coalesce(F.col("li_n"), F.lit(0)) + ck % 20).cast("int").alias("total_acc"),
        F.when(ok % 10 < 6, F.lit(None).cast("int")).otherwise((ck % 48).cast("int")).alias("mths_since_last_delinq"),
    )


def loans(t: Tables) -> DataFrame:
    """Typed loans (all statuses): raw text parsed with the cleaning rules."""
    r = raw_loans(t)
    return r.select(
        "loan_id", "member_id", "loan_status", "loan_amnt", "funded_amnt",
        X.fix_percent(F.col("int_rate")).alias("int_rate"),
        X.fix_percent(F.col("revol_util")).alias("revol_util"),
        "installment", "annual_inc", "dti",
        F.upper(F.trim("grade")).alias("grade"),
        X.parse_month_year(F.col("issue_d")).alias("issue_d"),
        X.parse_month_year(F.col("earliest_cr_line")).alias("earliest_cr_line"),
        X.parse_month_year(F.col("last_pymnt_d")).alias("last_pymnt_d"),
        X.parse_month_year(F.col("last_credit_pull_d")).alias("last_credit_pull_d"),
        X.first_int(F.col("emp_length")).alias("emp_length"),
        "term", "home_ownership", "purpose", "delinq_2yrs", "inq_last_6mths", "open_acc", "pub_rec", "total_acc",
    )


def clean_loans(t: Tables) -> DataFrame:
    """Cleaned loans; built once per ``Tables`` (one query) however many views use it,
    so the filtered table is materialised and its null ratios computed only once."""
    memo = t.__dict__.setdefault("_memo", {})
    if "clean_loans" not in memo:
        memo["clean_loans"] = C.clean_loans(raw_loans(t))
    return memo["clean_loans"]


def transactions(t: Tables) -> DataFrame:
    o = spread(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    c = t.customer.select("c_custkey", "c_acctbal", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    ok, ck = F.col("o_orderkey"), F.col("c_custkey")
    dob_y, dob_m, dob_d = F.lit(1940) + ck % 60, F.lit(1) + F.floor(ck / 28) % 12, F.lit(1) + ck % 28
    ty, tm, td = F.year("o_orderdate").cast("bigint"), F.month("o_orderdate").cast("bigint"), F.dayofmonth("o_orderdate").cast("bigint")

    def s(c_: Column) -> Column:
        return c_.cast("string")

    def p2(c_: Column) -> Column:
        return F.lpad(s(c_), 2, "0")

    dob = (F.when(ck % 97 == 0, F.lit("1/1/1800"))
           .when(ck % 5 == 0, F.concat(s(dob_y), F.lit("-"), p2(dob_m), F.lit("-"), p2(dob_d)))
           .when((dob_y >= 1976) & (ck % 2 == 0), F.concat(s(dob_d), F.lit("/"), s(dob_m), F.lit("/"), p2(dob_y % 100)))
           .otherwise(F.concat(p2(dob_d), F.lit("-"), p2(dob_m), F.lit("-"), s(dob_y))))
    loc = (F.when(ck % 50 == 0, F.lit(None).cast("string"))
           .when(ck % 4 == 1, F.lower("n_name"))
           .when(ck % 4 == 2, F.concat(F.lit(" "), F.regexp_replace("n_name", "_", "-"), F.lit("  ")))
           .when((ck % 4 == 3) & (ck % 3 == 0), F.concat(F.col("n_name"), F.lit(" (n)")))
           .otherwise(F.col("n_name")))
    tdate = (F.when(ok % 3 == 0, F.concat(s(td), F.lit("/"), s(tm), F.lit("/"), p2(ty % 100)))
             .when(ok % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
             .when((ok % 11 == 2) & (td > 12), F.concat(s(tm), F.lit("/"), s(td), F.lit("/"), s(ty)))
             .otherwise(F.concat(p2(td), F.lit("/"), p2(tm), F.lit("/"), s(ty))))
    amount = F.col("o_totalprice") / 100
    return j.select(
        ok.alias("TransactionID"),
        F.when(ok % 9 == 0, F.concat(F.lit(" C"), s(F.col("o_custkey")), F.lit(" ")))
        .otherwise(F.concat(F.lit("C"), s(F.col("o_custkey")))).alias("CustomerID"),
        dob.alias("CustomerDOB"),
        loc.alias("CustLocation"),
        F.col("c_acctbal").alias("CustAccountBalance"),
        tdate.alias("TransactionDate"),
        F.when(ok % 101 == 0, -amount).otherwise(amount).alias("TransactionAmount (INR)"),
    )


def deposits(t: Tables) -> DataFrame:
    ev = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    base = ev.select(
        F.col("event_id").alias("deposit_id"), "user_id", "ts", "event_type",
        F.col("value").alias("amount"),
        F.hour("ts").cast("int").alias("hour"),
        F.weekday("ts").cast("int").alias("day_of_week"),
    )
    return W.trailing_count(base, key="user_id", ts="ts", seconds=86400, id_col="deposit_id", out="frequency")


def campaign(t: Tables) -> DataFrame:
    per_cust = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    c = t.customer.select("c_custkey", "c_acctbal")
    j = c.join(per_cust, c.c_custkey == per_cust.o_custkey, "left")
    ck = F.col("c_custkey")
    n = F.coalesce(F.col("n_orders"), F.lit(0))
    job = _pick(ck % 5, _JOBS)
    return j.select(
        ck.alias("client_id"),
        F.when(ck % 97 == 0, F.lit(None).cast("int")).otherwise((F.lit(18) + (ck * 7) % 75).cast("int")).alias("age"),
        F.when(ck % 10 == 1, F.concat(F.lit(" "), F.upper(job))).otherwise(job).alias("job"),
        _pick(ck % 3, _MARITAL).alias("marital"),
        _pick(ck % 4, _EDU).alias("education"),
        F.when(F.col("c_acctbal") < 0, "yes").otherwise("no").alias("default"),
        F.col("c_acctbal").alias("balance"),
        F.when(ck % 2 == 0, "yes").otherwise("no").alias("housing"),
        F.when(ck % 5 == 0, "yes").otherwise("no").alias("loan"),
        _pick(ck % 3, _CONTACT).alias("contact"),
        (F.lit(1) + ck % 28).cast("int").alias("day"),
        _pick(ck % 12, _MONTHS).alias("month"),
        (n * 37 + ck % 300).cast("int").alias("duration"),
        (F.lit(1) + n % 6).cast("int").alias("campaign"),
        F.when(ck % 4 == 0, -1).otherwise(ck % 400).cast("int").alias("pdays"),
        (ck % 4).cast("int").alias("previous"),
        _pick(ck % 4, _POUT).alias("poutcome"),
        F.when((ck * 7919 + n * 31) % 100 < 15, "yes").otherwise("no").alias("y"),
    )


def monthly_volume(t: Tables) -> DataFrame:
    from ..operators import aggregate as A
    return A.monthly_volume(clean_loans(t))


def grade_monthly(t: Tables) -> DataFrame:
    from ..operators import aggregate as A
    return A.grade_monthly(clean_loans(t))


def series(t: Tables) -> DataFrame:
    """Long many-series table: one series per grade plus ``TOTAL``; value = funded amount in thousands."""
    g = grade_monthly(t).select(F.col("grade").alias("series_id"), "month_start", (F.col("funded_amnt") / 1000.0).alias("value"))
    m = monthly_volume(t).select(F.lit("TOTAL").alias("series_id"), "month_start", (F.col("funded_amnt") / 1000.0).alias("value"))
    return g.unionByName(m)


def volume_panel(t: Tables) -> DataFrame:
    """Per series (grades and TOTAL) monthly funded amount in millions with the
    covariates the volume models use: mean rate, loan count, mean loan amount."""
    g = grade_monthly(t).select(F.col("grade").alias("series_id"), "month_start", F.col("funded_amnt_m").alias("value"),
                                "avg_int_rate", F.col("loan_count").cast("double").alias("loan_count"),
                                (F.col("funded_amnt") / F.col("loan_count")).alias("avg_loan_amnt"))
    m = monthly_volume(t).select(F.lit("TOTAL").alias("series_id"), "month_start", F.col("funded_amnt_m").alias("value"),
                                 "avg_int_rate", F.col("loan_count").cast("double").alias("loan_count"), "avg_loan_amnt")
    return g.unionByName(m)


def nation_series(t: Tables) -> DataFrame:
    """Sparse series with gaps: funded amount per nation and grade over the full month spine,
    for every pair of them that has a loan."""
    lo = loans(t)
    month = F.trunc("issue_d", "MM")
    spine = lo.agg(F.min(month).alias("lo"), F.max(month).alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month_start"))
    cust = t.customer.select("c_custkey", "c_nationkey")
    agg = (lo.filter(F.col("grade").isNotNull()).join(cust, F.col("member_id") == F.col("c_custkey"))
           .groupBy(F.col("c_nationkey").alias("n_nationkey"), "grade", month.alias("month_start"))
           .agg((X.exact_sum2("funded_amnt") / 1000.0).alias("value")))
    # months, and pairs of a nation and a grade, are both small and bounded by calendar and dimensions
    pairs = agg.select("n_nationkey", "grade").distinct().join(F.broadcast(t.nation.select("n_nationkey", "n_name")), "n_nationkey")
    grid = F.broadcast(spine).crossJoin(F.broadcast(pairs))
    return grid.join(agg, ["n_nationkey", "grade", "month_start"], "left").select(
        F.concat_ws("/", "n_name", "grade").alias("series_id"), "month_start", "value")


def region_grade(t: Tables) -> DataFrame:
    """Funded amount (millions) and loan count per region x grade x month. Region and
    nation are fixed-size dimensions (5 and 25 rows), so they are broadcast."""
    c = clean_loans(t).filter(F.col("issue_d").isNotNull() & F.col("grade").isNotNull() & F.col("funded_amnt").isNotNull())
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    cust = t.customer.select("c_custkey", "c_nationkey").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    j = c.join(cust, F.col("member_id") == F.col("c_custkey"))
    return j.groupBy(F.col("r_name").alias("portfolio"), F.upper(F.trim("grade")).alias("grade"),
                     F.trunc("issue_d", "MM").alias("month_start")).agg(
        (X.exact_sum2("funded_amnt") / 1000000.0).alias("value"), F.count(F.lit(1)).alias("loan_count"))


VIEW_BUILDERS = {
    "raw_loans": raw_loans,
    "loans": loans,
    "clean_loans": clean_loans,
    "monthly_volume": monthly_volume,
    "grade_monthly": grade_monthly,
    "series": series,
    "nation_series": nation_series,
    "transactions": transactions,
    "deposits": deposits,
    "campaign": campaign,
    "region_grade": region_grade,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEW_BUILDERS[name](Tables(spark, sf_dir))
