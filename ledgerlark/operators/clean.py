"""Cleaning and typing operators (DataFrame -> DataFrame)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import stable

# The statuses that are kept and the columns that must be there or hold percents and months.
VALID_STATUSES = ["Fully Paid", "Charged Off"]
CRITICAL_COLUMNS = ["loan_status", "loan_amnt", "int_rate", "annual_inc", "dti", "grade", "issue_d"]
PERCENT_COLUMNS = ["int_rate", "revol_util"]
MONTH_DATE_COLUMNS = ["issue_d", "earliest_cr_line", "last_pymnt_d", "last_credit_pull_d"]


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, required: list[str], context: str, any_of: list[list[str]] | None = None) -> DataFrame:
    """Raise before any action if ``required`` columns are absent. ``any_of`` groups are
    satisfied by any one member (``TransactionAmount`` or ``TransactionAmount (INR)``)."""
    have = set(df.columns)
    missing = [c for c in required if c not in have]
    for group in any_of or []:
        if not any(g in have for g in group):
            missing.append(" or ".join(group))
    if missing:
        raise MissingColumnsError(f"{context}: missing required columns: {', '.join(missing)}")
    return df


def filter_loan_status(df: DataFrame) -> DataFrame:
    return df.filter(F.col("loan_status").isin(VALID_STATUSES))


def null_ratios(df: DataFrame) -> DataFrame:
    """One row: the null share of every column, in a single pass that only counts."""
    n = F.count(F.lit(1))
    return df.agg(*[((n - F.count(F.col(f"`{c}`"))) / F.nullif(n, F.lit(0))).alias(c) for c in df.columns])


def drop_high_null_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns whose null ratio is strictly above ``threshold``.

    The ratios come from one aggregate pass whose result is a single row of
    ``len(df.columns)`` numbers, the only value brought to the driver.
    """
    row = null_ratios(df).first()
    if row is None:
        return df
    drop = [c for c in df.columns if row[c] is not None and row[c] > threshold]
    return df.drop(*drop)


def fix_dtypes(df: DataFrame) -> DataFrame:
    cols = {}
    for c in PERCENT_COLUMNS:
        if c in df.columns:
            cols[c] = X.fix_percent(F.col(c))
    for c in MONTH_DATE_COLUMNS:
        if c in df.columns:
            cols[c] = X.parse_month_year(F.col(c))
    if "emp_length" in df.columns:
        cols["emp_length"] = X.first_int(F.col("emp_length"))
    return df.withColumns(cols) if cols else df


def drop_critical_nulls(df: DataFrame) -> DataFrame:
    subset = [c for c in CRITICAL_COLUMNS if c in df.columns]
    return df.dropna(subset=subset) if subset else df


def shared_features(df: DataFrame) -> DataFrame:
    cols = {"default_flag": (F.col("loan_status") == "Charged Off").cast("int")}
    if "issue_d" in df.columns:
        cols["issue_year"] = F.year("issue_d")
        cols["issue_month"] = F.month("issue_d")
    return df.withColumns(cols)


def normalize_grade(df: DataFrame) -> DataFrame:
    return df.withColumn("grade", F.upper(F.trim("grade"))) if "grade" in df.columns else df


def clean_loans(raw: DataFrame, threshold: float = 0.5, materialize: bool = True) -> DataFrame:
    """status filter -> drop >threshold-null columns -> types -> critical nulls -> features.

    Grade text is upper-cased and trimmed in the typing step (the reference does it in
    the aggregation step); values are otherwise unchanged. The column drop depends on
    the data, so the filtered table is read twice (null ratios, then the rest); with
    ``materialize`` it is computed once and written to the shared checkpoint folder
    instead of recomputing its joins and aggregations for each read. It is written with its types, so
    that no consumer parses text again, and with a mark for each parsed column that had a value: text that
    does not parse is null by then, but counts as a value when columns are dropped.
    """
    df = filter_loan_status(raw)
    if materialize:
        given = {c: f"_given_{c}" for c in [*PERCENT_COLUMNS, *MONTH_DATE_COLUMNS, "emp_length"] if c in df.columns}
        marked = df.withColumns({m: F.when(F.col(c).isNotNull(), F.lit(True)) for c, m in given.items()})
        typed = stable(normalize_grade(fix_dtypes(marked)), "loans_filtered")
        seen = typed.select(*[F.col(given.get(c, c)).alias(c) for c in df.columns])
        df = typed.select(*drop_high_null_columns(seen, threshold).columns)
    else:
        df = normalize_grade(fix_dtypes(drop_high_null_columns(df, threshold)))
    df = drop_critical_nulls(df)
    return shared_features(df)


def null_profile(df: DataFrame) -> DataFrame:
    """Long form: (column_name, null_count, null_pct) from one aggregate pass."""
    counts = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in df.columns],
                    F.count(F.lit(1)).alias("__n"))
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.select(F.col("__n"), F.expr(f"stack({len(df.columns)}, {stack}) AS (column_name, null_count)")).select(
        "column_name", "null_count",
        F.round(F.col("null_count") * 100.0 / F.nullif(F.col("__n"), F.lit(0)), 4).alias("null_pct"))


def class_profile(df: DataFrame, label: str) -> DataFrame:
    """(class, class_count, class_pct) of a label; a null label is a class of its own."""
    c = df.groupBy(F.col(label).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("class_count"))
    total = c.agg(F.sum("class_count").alias("_n"))
    return c.crossJoin(F.broadcast(total)).select("class", "class_count", F.round(F.col("class_count") * 100.0 / F.col("_n"), 4).alias("class_pct"))


BANK_NUMERIC = ["age", "balance", "day", "duration", "campaign", "pdays", "previous"]
BANK_CATEGORICAL = ["job", "marital", "education", "default", "housing", "loan", "contact", "month", "poutcome", "y"]


def normalize_bank(df: DataFrame) -> DataFrame:
    """Coerce the 7 numerics, trim+lower the 10 categoricals, drop rows with a null numeric."""
    require_columns(df, BANK_NUMERIC + BANK_CATEGORICAL, "bank campaign")
    cols = {c: X.to_double(F.col(c)) for c in BANK_NUMERIC}
    cols.update({c: F.lower(F.trim(F.col(c).cast("string"))) for c in BANK_CATEGORICAL})
    return df.withColumns(cols).dropna(subset=BANK_NUMERIC)


DEPOSIT_COLUMNS = ["amount", "hour", "day_of_week", "frequency"]


def _clip_deposits(df: DataFrame) -> DataFrame:
    cols = {c: X.to_double(F.col(c)) for c in DEPOSIT_COLUMNS}
    df = df.withColumns(cols).dropna(subset=DEPOSIT_COLUMNS)
    return df.withColumns({
        "amount": F.greatest(F.col("amount"), F.lit(1.0)),
        "hour": F.least(F.greatest(F.col("hour"), F.lit(0.0)), F.lit(23.0)),
        "day_of_week": F.least(F.greatest(F.col("day_of_week"), F.lit(0.0)), F.lit(6.0)),
        "frequency": F.greatest(F.col("frequency"), F.lit(1.0)),
    })


def normalize_deposits(df: DataFrame) -> DataFrame:
    """Processed-table variant: clip, then round half-to-even (``bround``) to integers."""
    require_columns(df, DEPOSIT_COLUMNS, "deposit anomaly")
    d = _clip_deposits(df)
    return d.withColumns({c: F.bround(F.col(c)).cast("int") for c in ["hour", "day_of_week", "frequency"]})


def validate_deposits(df: DataFrame) -> DataFrame:
    """Model-input variant: same clip, but truncates to integers."""
    require_columns(df, DEPOSIT_COLUMNS, "deposit anomaly")
    d = _clip_deposits(df)
    return d.withColumns({c: F.col(c).cast("int") for c in ["hour", "day_of_week", "frequency"]})


def split_bad_numeric(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows: bad = any listed column fails numeric coercion."""
    bad_cond = None
    for c in cols:
        cond = X.to_double(F.col(c)).isNull()
        bad_cond = cond if bad_cond is None else (bad_cond | cond)
    return df.filter(~bad_cond), df.filter(bad_cond)


def reject_bad_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Batch guard: fail the whole batch if any row has a non-numeric value."""
    good, bad = split_bad_numeric(df, cols)
    if bad.limit(1).count() > 0:
        raise ValueError(f"batch rejected: non-numeric values in {', '.join(cols)}")
    return good


AMOUNT_ALIASES = ["TransactionAmount", "TransactionAmount (INR)"]
TX_REQUIRED = ["CustomerID", "CustomerDOB", "CustLocation", "CustAccountBalance", "TransactionDate"]


def prepare_transactions(df: DataFrame, pivot: int = 76, materialize: bool = True) -> DataFrame:
    """Clean card transactions: alias rename, trim ids, normalise location, coerce
    numbers and mixed dates, DOB before 1900 -> NULL, drop unusable rows, amount >= 0,
    and age against the latest transaction date (outside 18..100 -> NULL).

    Deviation: a NULL CustomerID is dropped (the reference keeps it as the text 'nan').
    The reference date is a one-row aggregate joined back by broadcast, not collected.
    """
    require_columns(df, TX_REQUIRED, "wealth persona", any_of=[AMOUNT_ALIASES])
    amount_col = "TransactionAmount" if "TransactionAmount" in df.columns else "TransactionAmount (INR)"
    keep = [F.col(c) for c in ["TransactionID"] if c in df.columns]
    types = dict(df.dtypes)
    numeric = {c: types[c] in ("double", "float", "int", "bigint", "smallint") or types[c].startswith("decimal")
               for c in ["CustAccountBalance", amount_col]}
    dob = X.parse_mixed_dates(F.col("CustomerDOB"), pivot)
    tx = df.select(
        *keep,
        F.trim(F.col("CustomerID").cast("string")).alias("CustomerID"),
        F.when(F.year(dob) < 1900, F.lit(None).cast("date")).otherwise(dob).alias("CustomerDOB"),
        F.col("CustLocation"),
        X.normalize_location(F.col("CustLocation")).alias("CustLocationNorm"),
        X.to_double(F.col("CustAccountBalance"), numeric["CustAccountBalance"]).alias("CustAccountBalance"),
        X.parse_mixed_dates(F.col("TransactionDate"), pivot).alias("TransactionDate"),
        X.to_double(F.col(f"`{amount_col}`"), numeric[amount_col]).alias("TransactionAmount"),
    )
    if materialize:
        # every consumer (reference date here; RFM, benchmarks, personas downstream)
        # reads this table several times: parse the text once and cut the lineage.
        # Rows are dropped after it: a filter on parsed text would go down to the scans
        # and joins below, which would parse it again in the few tasks that read a file
        tx = stable(tx)
    tx = tx.dropna(subset=["CustomerID", "TransactionDate", "TransactionAmount", "CustAccountBalance"])
    tx = tx.filter(F.col("TransactionAmount") >= 0)
    ref = tx.agg(F.max("TransactionDate").alias("_ref_date"))
    tx = tx.crossJoin(F.broadcast(ref))  # one row: the reference date
    age = F.datediff(F.col("_ref_date"), F.col("CustomerDOB")) / 365.25
    return tx.withColumn("Age", F.when((age < 18) | (age > 100), F.lit(None).cast("double")).otherwise(age)).drop("_ref_date")
