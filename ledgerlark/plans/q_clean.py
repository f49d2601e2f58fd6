"""Queries for scans, cleaning and feature expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import encode as E
from ..sources.domain import Tables, campaign, clean_loans, deposits, loans, raw_loans, transactions
from .registry import query
from .sql_views import sql_normalize_location, sql_parse_mixed_dates
from .sql_views import with_views as V

CLEAN_COLS = ("loan_id, member_id, loan_status, loan_amnt, funded_amnt, int_rate, revol_util, installment, annual_inc, dti, "
              "grade, issue_d, earliest_cr_line, last_pymnt_d, last_credit_pull_d, emp_length, term, home_ownership, purpose, "
              "delinq_2yrs, inq_last_6mths, open_acc, pub_rec, total_acc, default_flag, issue_year, issue_month")


@query("clean_loans", V("clean_loans") + f"SELECT {CLEAN_COLS} FROM clean_loans")
def q_clean_loans(spark, d):
    return clean_loans(Tables(spark, d))


@query("monthly_volume", V("monthly_volume") + """
SELECT month_start, funded_amnt, loan_count, avg_int_rate, avg_loan_amnt, funded_amnt_m FROM monthly_volume""")
def q_monthly_volume(spark, d):
    return A.monthly_volume(clean_loans(Tables(spark, d)))


@query("grade_monthly", V("grade_monthly") + """
SELECT month_start, grade, funded_amnt, loan_count, avg_int_rate, funded_amnt_m FROM grade_monthly""")
def q_grade_monthly(spark, d):
    return A.grade_monthly(clean_loans(Tables(spark, d)))


RAW_COLS = ["loan_id", "member_id", "loan_status", "loan_amnt", "funded_amnt", "int_rate", "revol_util", "installment",
            "annual_inc", "dti", "grade", "issue_d", "earliest_cr_line", "last_pymnt_d", "last_credit_pull_d", "emp_length",
            "term", "home_ownership", "purpose", "delinq_2yrs", "inq_last_6mths", "open_acc", "pub_rec", "total_acc",
            "mths_since_last_delinq"]


@query("filter_loan_status", V("raw_loans") + """
SELECT loan_id, loan_status, funded_amnt FROM raw_loans WHERE loan_status IN ('Fully Paid', 'Charged Off')""")
def q_filter_loan_status(spark, d):
    return C.filter_loan_status(raw_loans(Tables(spark, d))).select("loan_id", "loan_status", "funded_amnt")


_NULL_RATIO_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_ratio, "
    f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 AS dropped FROM f" for c in RAW_COLS)


@query("drop_high_null_columns", V("raw_loans") + ", f AS (SELECT * FROM raw_loans WHERE loan_status IN ('Fully Paid', 'Charged Off')) "
       + _NULL_RATIO_SQL)
def q_drop_high_null_columns(spark, d):
    """Null ratio per column after the status filter and whether the operator drops it."""
    f = C.filter_loan_status(raw_loans(Tables(spark, d)))
    kept = set(C.drop_high_null_columns(f, 0.5).columns)
    ratios = C.null_ratios(f)
    st = ", ".join(f"'{c}', `{c}`" for c in f.columns)
    long = ratios.select(F.expr(f"stack({len(f.columns)}, {st}) AS (column_name, null_ratio)"))
    return long.select("column_name", F.round("null_ratio", 6).alias("null_ratio"),
                       (~F.col("column_name").isin(list(kept))).alias("dropped"))


@query("fix_percent", V("raw_loans") + """
SELECT loan_id, int_rate AS int_rate_text, revol_util AS revol_util_text,
       TRY_CAST(trim(replace(int_rate, '%', '')) AS DOUBLE) AS int_rate,
       TRY_CAST(trim(replace(revol_util, '%', '')) AS DOUBLE) AS revol_util
FROM raw_loans""")
def q_fix_percent(spark, d):
    r = raw_loans(Tables(spark, d))
    return r.select("loan_id", F.col("int_rate").alias("int_rate_text"), F.col("revol_util").alias("revol_util_text"),
                    X.fix_percent(F.col("int_rate")).alias("int_rate"), X.fix_percent(F.col("revol_util")).alias("revol_util"))


@query("fix_month_dates", V("raw_loans") + """
SELECT loan_id,
       CAST(try_strptime(issue_d, '%b-%Y') AS DATE) AS issue_d,
       CAST(try_strptime(earliest_cr_line, '%b-%Y') AS DATE) AS earliest_cr_line,
       CAST(try_strptime(last_pymnt_d, '%b-%Y') AS DATE) AS last_pymnt_d,
       CAST(try_strptime(last_credit_pull_d, '%b-%Y') AS DATE) AS last_credit_pull_d
FROM raw_loans""")
def q_fix_month_dates(spark, d):
    r = raw_loans(Tables(spark, d))
    return C.fix_dtypes(r.select("loan_id", "issue_d", "earliest_cr_line", "last_pymnt_d", "last_credit_pull_d"))


@query("fix_emp_length", V("raw_loans") + r"""
SELECT loan_id, emp_length AS emp_length_text, TRY_CAST(regexp_extract(emp_length, '(\d+)', 1) AS DOUBLE) AS emp_length
FROM raw_loans""")
def q_fix_emp_length(spark, d):
    r = raw_loans(Tables(spark, d))
    return r.select("loan_id", F.col("emp_length").alias("emp_length_text"), X.first_int(F.col("emp_length")).alias("emp_length"))


@query("drop_critical_nulls", V("loans") + """
SELECT loan_id, loan_status FROM loans
WHERE loan_status IS NOT NULL AND loan_amnt IS NOT NULL AND int_rate IS NOT NULL AND annual_inc IS NOT NULL
  AND dti IS NOT NULL AND grade IS NOT NULL AND issue_d IS NOT NULL""")
def q_drop_critical_nulls(spark, d):
    return C.drop_critical_nulls(loans(Tables(spark, d))).select("loan_id", "loan_status")


@query("shared_features", V("loans") + """
SELECT loan_id, CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS default_flag,
       CAST(year(issue_d) AS INTEGER) AS issue_year, CAST(month(issue_d) AS INTEGER) AS issue_month FROM loans""")
def q_shared_features(spark, d):
    return C.shared_features(loans(Tables(spark, d))).select("loan_id", "default_flag", "issue_year", "issue_month")


_NULL_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count, "
    f"round(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS null_pct FROM raw_loans" for c in RAW_COLS)


@query("null_profile", V("raw_loans") + _NULL_PROFILE_SQL)
def q_null_profile(spark, d):
    return C.null_profile(raw_loans(Tables(spark, d)))


@query("class_profile", V("raw_loans") + """
, c AS (SELECT loan_status AS class, count(*) AS class_count FROM raw_loans GROUP BY 1)
SELECT class, class_count, round(class_count * 100.0 / (SELECT sum(class_count) FROM c), 4) AS class_pct FROM c""")
def q_class_profile(spark, d):
    """Loans per status and their share, the second half of the null profile."""
    return C.class_profile(raw_loans(Tables(spark, d)), "loan_status")


@query("safe_numeric", V("raw_loans") + """
SELECT loan_id, coalesce(TRY_CAST(trim(CAST(loan_amnt AS VARCHAR)) AS DOUBLE), 0.0) AS loan_amnt,
       coalesce(TRY_CAST(trim(int_rate) AS DOUBLE), 0.0) AS int_rate_as_number,
       coalesce(TRY_CAST(trim(CAST(delinq_2yrs AS VARCHAR)) AS DOUBLE), 0.0) AS delinq_2yrs
FROM raw_loans""")
def q_safe_numeric(spark, d):
    r = raw_loans(Tables(spark, d))
    return r.select("loan_id", X.safe_numeric(F.col("loan_amnt")).alias("loan_amnt"),
                    X.safe_numeric(F.col("int_rate")).alias("int_rate_as_number"),
                    X.safe_numeric(F.col("delinq_2yrs")).alias("delinq_2yrs"))


def _sql_map(expr: str, mapping: dict[str, int]) -> str:
    return "CAST(coalesce(CASE " + expr + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END, 0) AS INTEGER)"


@query("encode_known_categories", V("raw_loans") + f"""
SELECT loan_id, {_sql_map('upper(trim(grade))', E.CATEGORY_MAPS['grade'])} AS grade,
       {_sql_map('trim(home_ownership)', E.CATEGORY_MAPS['home_ownership'])} AS home_ownership,
       {_sql_map('lower(trim(purpose))', E.CATEGORY_MAPS['purpose'])} AS purpose
FROM raw_loans""")
def q_encode_known_categories(spark, d):
    r = raw_loans(Tables(spark, d)).select("loan_id", "grade", "home_ownership", "purpose")
    return E.encode_known_categories(r)


PORTFOLIO_FEATURES = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "delinq_2yrs", "inq_last_6mths", "open_acc",
                      "pub_rec", "revol_util", "total_acc", "emp_length", "grade", "home_ownership", "purpose", "issue_year",
                      "issue_month", "mort_acc"]


def _sql_prepare_features() -> str:
    enc = {"grade": _sql_map('upper(trim(grade))', E.CATEGORY_MAPS['grade']),
           "home_ownership": _sql_map('trim(home_ownership)', E.CATEGORY_MAPS['home_ownership']),
           "purpose": _sql_map('lower(trim(purpose))', E.CATEGORY_MAPS['purpose'])}
    cols = []
    for f in PORTFOLIO_FEATURES:
        if f == "mort_acc":
            cols.append("CAST(0 AS DOUBLE) AS mort_acc")
        elif f in enc:
            cols.append(f"CAST({enc[f]} AS DOUBLE) AS {f}")
        else:
            cols.append(f"coalesce(TRY_CAST({f} AS DOUBLE), 0.0) AS {f}")
    return "SELECT loan_id, " + ", ".join(cols) + " FROM clean_loans"


@query("prepare_features", V("clean_loans") + _sql_prepare_features())
def q_prepare_features(spark, d):
    return E.prepare_features(clean_loans(Tables(spark, d)), PORTFOLIO_FEATURES, keep=["loan_id"])


@query("label_encode", V("clean_loans") + """
SELECT loan_id,
  CAST(dense_rank() OVER (ORDER BY coalesce(grade, 'nan')) - 1 AS INTEGER) AS grade,
  CAST(dense_rank() OVER (ORDER BY coalesce(home_ownership, 'nan')) - 1 AS INTEGER) AS home_ownership,
  CAST(dense_rank() OVER (ORDER BY coalesce(purpose, 'nan')) - 1 AS INTEGER) AS purpose,
  CAST(dense_rank() OVER (ORDER BY coalesce(term, 'nan')) - 1 AS INTEGER) AS term
FROM clean_loans""")
def q_label_encode(spark, d):
    c = clean_loans(Tables(spark, d)).select("loan_id", "grade", "home_ownership", "purpose", "term")
    return E.label_encode(c, ["grade", "home_ownership", "purpose", "term"])


@query("median_impute", V("loans") + """
SELECT loan_id,
  round(coalesce(loan_amnt, (SELECT median(loan_amnt) FROM loans)), 4) AS loan_amnt,
  round(coalesce(int_rate, (SELECT median(int_rate) FROM loans)), 6) AS int_rate,
  round(coalesce(dti, (SELECT median(dti) FROM loans)), 6) AS dti,
  round(coalesce(CAST(open_acc AS DOUBLE), (SELECT median(CAST(open_acc AS DOUBLE)) FROM loans)), 6) AS open_acc,
  round(coalesce(emp_length, (SELECT median(emp_length) FROM loans)), 6) AS emp_length
FROM loans""")
def q_median_impute(spark, d):
    lo = loans(Tables(spark, d)).select("loan_id", "loan_amnt", "int_rate", "dti", F.col("open_acc").cast("double"), "emp_length")
    m = E.median_impute(lo, ["loan_amnt", "int_rate", "dti", "open_acc", "emp_length"])
    return m.select("loan_id", F.round("loan_amnt", 4).alias("loan_amnt"),
                    *[F.round(c, 6).alias(c) for c in ["int_rate", "dti", "open_acc", "emp_length"]])


_BANK_NUM = ["age", "balance", "day", "duration", "campaign", "pdays", "previous"]
_BANK_CAT = ["job", "marital", "education", '"default"', "housing", "loan", "contact", '"month"', "poutcome", "y"]


@query("normalize_bank", V("campaign") + "SELECT client_id, "
       + ", ".join(f"TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) AS {c}" for c in _BANK_NUM) + ", "
       + ", ".join(f"lower(trim({c})) AS {c}" for c in _BANK_CAT)
       + " FROM campaign WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _BANK_NUM))
def q_normalize_bank(spark, d):
    return C.normalize_bank(campaign(Tables(spark, d)))


_DEP_RAW_SQL = """
, dep_raw AS (
  SELECT deposit_id, amount, CAST(hour AS DOUBLE) + CAST(minute(ts) AS DOUBLE) / 60 AS hour,
         CAST(day_of_week AS DOUBLE) AS day_of_week, CAST(frequency AS DOUBLE) - 0.5 AS frequency FROM deposits)
"""


def _dep_raw(spark, d):
    dep = deposits(Tables(spark, d))
    return dep.select("deposit_id", "amount", (F.col("hour").cast("double") + F.minute("ts").cast("double") / 60).alias("hour"),
                      F.col("day_of_week").cast("double").alias("day_of_week"),
                      (F.col("frequency").cast("double") - 0.5).alias("frequency"))


@query("normalize_deposits", V("deposits") + _DEP_RAW_SQL + """
SELECT deposit_id, greatest(amount, 1.0) AS amount,
       CAST(round_even(least(greatest(hour, 0.0), 23.0), 0) AS INTEGER) AS hour,
       CAST(round_even(least(greatest(day_of_week, 0.0), 6.0), 0) AS INTEGER) AS day_of_week,
       CAST(round_even(greatest(frequency, 1.0), 0) AS INTEGER) AS frequency
FROM dep_raw WHERE amount IS NOT NULL AND hour IS NOT NULL AND day_of_week IS NOT NULL AND frequency IS NOT NULL""")
def q_normalize_deposits(spark, d):
    return C.normalize_deposits(_dep_raw(spark, d))


@query("validate_deposits", V("deposits") + _DEP_RAW_SQL + """
SELECT deposit_id, greatest(amount, 1.0) AS amount,
       CAST(trunc(least(greatest(hour, 0.0), 23.0)) AS INTEGER) AS hour,
       CAST(trunc(least(greatest(day_of_week, 0.0), 6.0)) AS INTEGER) AS day_of_week,
       CAST(trunc(greatest(frequency, 1.0)) AS INTEGER) AS frequency
FROM dep_raw WHERE amount IS NOT NULL AND hour IS NOT NULL AND day_of_week IS NOT NULL AND frequency IS NOT NULL""")
def q_validate_deposits(spark, d):
    return C.validate_deposits(_dep_raw(spark, d))


@query("reject_bad_numeric", V("deposits") + """
SELECT deposit_id, amount, hour, day_of_week, frequency FROM deposits
WHERE amount IS NOT NULL AND NOT isnan(amount) AND hour IS NOT NULL AND day_of_week IS NOT NULL AND frequency IS NOT NULL""")
def q_reject_bad_numeric(spark, d):
    """Batch guard on the deposit rows; all rows are numeric here, so the batch passes."""
    dep = deposits(Tables(spark, d)).select("deposit_id", "amount", "hour", "day_of_week", "frequency")
    return C.reject_bad_numeric(dep, ["amount", "hour", "day_of_week", "frequency"])


@query("prepare_transactions", V("tx_clean") + """
SELECT TransactionID, CustomerID, CustomerDOB, CustLocationNorm, CustAccountBalance, TransactionDate, TransactionAmount,
       round(Age, 6) AS Age FROM tx_clean""")
def q_prepare_transactions(spark, d):
    tx = C.prepare_transactions(transactions(Tables(spark, d)))
    return tx.select("TransactionID", "CustomerID", "CustomerDOB", "CustLocationNorm", "CustAccountBalance", "TransactionDate",
                     "TransactionAmount", F.round("Age", 6).alias("Age"))


@query("normalize_location", V("transactions") + f"""
SELECT DISTINCT CustLocation AS location_text, {sql_normalize_location('CustLocation')} AS location_norm FROM transactions""")
def q_normalize_location(spark, d):
    tx = transactions(Tables(spark, d))
    return tx.select(F.col("CustLocation").alias("location_text"),
                     X.normalize_location(F.col("CustLocation")).alias("location_norm")).distinct()


@query("parse_mixed_dates", V("transactions") + f"""
SELECT DISTINCT d AS date_text, {sql_parse_mixed_dates('d')} AS parsed FROM (
  SELECT TransactionDate AS d FROM transactions UNION ALL SELECT CustomerDOB AS d FROM transactions) t""")
def q_parse_mixed_dates(spark, d):
    tx = transactions(Tables(spark, d))
    texts = tx.select(F.col("TransactionDate").alias("d")).unionByName(tx.select(F.col("CustomerDOB").alias("d")))
    return texts.select(F.col("d").alias("date_text"), X.parse_mixed_dates(F.col("d")).alias("parsed")).distinct()


@query("customer_age", V("tx_clean") + "SELECT TransactionID, CustomerDOB, round(Age, 6) AS Age FROM tx_clean")
def q_customer_age(spark, d):
    tx = C.prepare_transactions(transactions(Tables(spark, d)))
    return tx.select("TransactionID", "CustomerDOB", F.round("Age", 6).alias("Age"))


def _sql_cut(col: str, edges, labels) -> str:
    v = f"coalesce(TRY_CAST({col} AS DOUBLE), 0.0)"
    parts = []
    for i, lab in enumerate(labels):
        lo_op = ">=" if i == 0 else ">"
        parts.append(f"WHEN {v} {lo_op} {edges[i]} AND {v} <= {edges[i + 1]} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " ELSE 'nan' END"


SQL_BINS = (f"{_sql_cut('age', *E.AGE_BINS)} AS age_category, {_sql_cut('balance', *E.BALANCE_BINS)} AS balance_category, "
            f"{_sql_cut('duration', *E.DURATION_BINS)} AS duration_category")


@query("bin_features", V("campaign") + f"SELECT client_id, {SQL_BINS} FROM campaign")
def q_bin_features(spark, d):
    return E.bin_features(campaign(Tables(spark, d))).select("client_id", "age_category", "balance_category", "duration_category")


_ONEHOT_CATS = ["age_category", "balance_category", "duration_category", "job", "marital", "education", "default", "housing",
                "loan", "contact", "month", "poutcome"]


@query("one_hot", V("campaign") + f", b AS (SELECT *, {SQL_BINS} FROM campaign) "
       + " UNION ALL ".join(f"SELECT client_id, '{c}_' || CAST(\"{c}\" AS VARCHAR) AS feature, 1 AS value FROM b"
                            for c in _ONEHOT_CATS))
def q_one_hot(spark, d):
    """Sparse long form of the dummy matrix: one (client_id, feature, 1) row per non-zero
    cell; the wide matrix for model training is ``encode.campaign_design``."""
    b = E.bin_features(campaign(Tables(spark, d)))
    st = ", ".join(f"concat('{c}_', CAST(`{c}` AS STRING))" for c in _ONEHOT_CATS)
    return b.select("client_id", F.expr(f"explode(array({st})) AS feature"), F.lit(1).alias("value"))


_ONEHOT_NUMS = ["day", "campaign", "pdays", "previous"]
_SQL_ENTRIES = (f", b AS (SELECT *, {SQL_BINS} FROM campaign), e AS ("
                + " UNION ALL ".join([f"SELECT client_id, y, '{c}_' || CAST(\"{c}\" AS VARCHAR) AS feature, 1.0::DOUBLE AS value FROM b WHERE \"{c}\" IS NOT NULL" for c in _ONEHOT_CATS]
                                     + [f"SELECT client_id, y, '{c}', CAST(\"{c}\" AS DOUBLE) FROM b WHERE \"{c}\" <> 0" for c in _ONEHOT_NUMS]) + ")")


@query("one_hot_sparse", V("campaign") + _SQL_ENTRIES + "SELECT client_id, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS target, feature, value FROM e")
def q_one_hot_sparse(spark, d):
    """The campaign design as sparse vectors placed by a dictionary table, numbers passed through beside the target;
    read back as its entries that are not 0."""
    data, cats, nums = E.campaign_columns(campaign(Tables(spark, d)))
    design, table = E.sparse_design(data, cats, nums, keep=["client_id", "target"])
    return E.sparse_entries(design, table, nums, ["client_id", "target"])


@query("campaign_baseline", V("campaign") + _SQL_ENTRIES + f"""
, f AS (SELECT DISTINCT feature FROM e WHERE feature NOT IN ({', '.join(repr(c) for c in _ONEHOT_NUMS)}) UNION ALL SELECT unnest({_ONEHOT_NUMS!r}))
SELECT f.feature, round(coalesce(sum(e.value), 0.0) / (SELECT count(*) FROM campaign), 9) AS mean FROM f LEFT JOIN e ON e.feature = f.feature GROUP BY f.feature""")
def q_campaign_baseline(spark, d):
    """The mean of every feature of the campaign design: the baseline that goes with the deposit models."""
    data, cats, nums = E.campaign_columns(campaign(Tables(spark, d)))
    means = E.feature_means(*E.sparse_design(data, cats, nums), nums)
    return means.select("feature", F.round("mean", 9).alias("mean"))


# A frozen training feature list (as saved with a model): includes a category the
# scored rows never have (absent -> 0) and misses rows' unseen values (dropped).
FROZEN_FEATURES = ["day", "campaign", "pdays", "previous", "age_category_Adult", "age_category_Mid", "age_category_Senior",
                   "age_category_Young", "balance_category_High", "balance_category_Low", "balance_category_Negative",
                   "duration_category_Long", "duration_category_Short", "duration_category_VeryLong", "job_admin.",
                   "job_blue-collar", "job_management", "job_services", "job_technician", "job_retired", "marital_married",
                   "marital_single", "poutcome_success", "month_may"]


def _sql_align() -> str:
    nums = {"day", "campaign", "pdays", "previous"}
    cols = []
    for f in FROZEN_FEATURES:
        if f in nums:
            cols.append(f'coalesce(TRY_CAST("{f}" AS DOUBLE), 0.0) AS "{f}"')
            continue
        for c in E.BIN_FEATURES + E.CAMPAIGN_FEATURES:
            if f.startswith(c + "_"):
                cols.append(f"coalesce(CAST(\"{c}\" = '{f[len(c) + 1:]}' AS DOUBLE), 0.0) AS \"{f}\"")
                break
    return "SELECT client_id, " + ", ".join(cols) + f" FROM (SELECT *, {SQL_BINS} FROM campaign) b"


@query("align_features", V("campaign") + _sql_align())
def q_align_features(spark, d):
    return E.align_features(campaign(Tables(spark, d)), FROZEN_FEATURES, keep=["client_id"])


@query("calendar_features", V("monthly_volume") + """
SELECT month_start, CAST(month(month_start) AS INTEGER) AS month, CAST(quarter(month_start) AS INTEGER) AS quarter,
       CAST(year(month_start) AS INTEGER) AS year FROM monthly_volume""")
def q_calendar_features(spark, d):
    from ..operators import windows as W
    m = A.monthly_volume(clean_loans(Tables(spark, d))).select("month_start")
    return W.calendar_features(m)
