"""Domain views over the shared tables, written in ANSI SQL for DuckDB.

They are the SQL twins of :mod:`ledgerlark.sources.domain`; every oracle query in
:mod:`ledgerlark.plans.oracle` starts with ``WITH`` + the views it needs. Text
columns are built from integer arithmetic so both engines render them identically.
"""

from __future__ import annotations

# Category lists used to synthesise text columns.
PURPOSES = ["debt_consolidation", "credit_card", "home_improvement", "other", "major_purchase", "medical", "small_business"]


def _case_list(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


VIEWS: dict[str, str] = {}

VIEWS["li_order"] = """
li_order AS (
  SELECT l_orderkey,
         round(sum(l_extendedprice), 2) AS li_amount,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS li_disc_c,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS li_tax_c,
         CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS li_qty,
         count(*) AS li_n,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS li_returns,
         max(l_shipdate) AS li_last_ship,
         min(l_shipdate) AS li_first_ship
  FROM lineitem GROUP BY l_orderkey)"""

_GRADE = ("CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' "
          "WHEN '4' THEN 'D' WHEN '5' THEN 'E' END")
_RATE_BP = "(500 + (li.li_disc_c * 37 + o.o_orderkey) % 2000)"
_UTIL_PM = "((li.li_qty * 13 + o.o_custkey) % 1000)"
_HOME = ("CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'RENT' WHEN 'BUILDING' THEN 'OWN' WHEN 'FURNITURE' THEN 'MORTGAGE' "
         "WHEN 'HOUSEHOLD' THEN 'MORTGAGE' ELSE 'OTHER' END")

VIEWS["raw_loans"] = f"""
raw_loans AS (
  SELECT o.o_orderkey AS loan_id,
         o.o_custkey AS member_id,
         CASE o.o_orderstatus WHEN 'F' THEN 'Fully Paid' WHEN 'P' THEN 'Charged Off' ELSE 'Current' END AS loan_status,
         li.li_amount AS loan_amnt,
         o.o_totalprice AS funded_amnt,
         CASE WHEN o.o_orderkey % 53 = 0 THEN 'n/a'
              ELSE CAST({_RATE_BP} // 100 AS VARCHAR) || '.' || lpad(CAST({_RATE_BP} % 100 AS VARCHAR), 2, '0') || '%' END AS int_rate,
         CAST({_UTIL_PM} // 10 AS VARCHAR) || '.' || CAST({_UTIL_PM} % 10 AS VARCHAR) || '%' AS revol_util,
         o.o_totalprice / (CASE WHEN o.o_orderkey % 2 = 0 THEN 36 ELSE 60 END) AS installment,
         greatest(c.c_acctbal, 0) * 20 + 20000 AS annual_inc,
         CAST((li.li_tax_c * 3 + c.c_nationkey * 50) % 3500 AS DOUBLE) / 100 AS dti,
         CASE WHEN o.o_orderkey % 10 = 3 THEN lower({_GRADE}) || ' '
              WHEN o.o_orderkey % 10 = 7 THEN ' ' || {_GRADE} ELSE {_GRADE} END AS grade,
         strftime(o.o_orderdate, '%b-%Y') AS issue_d,
         strftime(o.o_orderdate - to_months(CAST(12 + o.o_custkey % 240 AS INTEGER)), '%b-%Y') AS earliest_cr_line,
         strftime(li.li_last_ship, '%b-%Y') AS last_pymnt_d,
         strftime(li.li_first_ship, '%b-%Y') AS last_credit_pull_d,
         CASE o.o_custkey % 12 WHEN 0 THEN '< 1 year' WHEN 1 THEN '1 year' WHEN 10 THEN '10+ years' WHEN 11 THEN 'n/a'
              ELSE CAST(o.o_custkey % 12 AS VARCHAR) || ' years' END AS emp_length,
         CASE WHEN o.o_orderkey % 2 = 0 THEN ' 36 months' ELSE ' 60 months' END AS term,
         CASE WHEN o.o_orderkey % 9 = 4 THEN ' ' || {_HOME} || ' ' ELSE {_HOME} END AS home_ownership,
         CASE WHEN o.o_orderkey % 11 = 5 THEN upper({_case_list('o.o_orderkey % 7', PURPOSES)})
              ELSE {_case_list('o.o_orderkey % 7', PURPOSES)} END AS purpose,
         CAST(li.li_returns AS INTEGER) AS delinq_2yrs,
         CAST(o.o_custkey % 7 AS INTEGER) AS inq_last_6mths,
         CAST(li.li_n AS INTEGER) AS open_acc,
         CASE WHEN o.o_custkey % 13 = 0 THEN 1 ELSE 0 END AS pub_rec,
         CAST(coalesce(li.li_n, 0) + o.o_custkey % 20 AS INTEGER) AS total_acc,
         CASE WHEN o.o_orderkey % 10 < 6 THEN NULL ELSE CAST(o.o_custkey % 48 AS INTEGER) END AS mths_since_last_delinq
  FROM orders o
  LEFT JOIN li_order li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""

# Typed loans: the raw text parsed with the same rules the cleaning operators use.
VIEWS["loans"] = r"""
loans AS (
  SELECT loan_id, member_id, loan_status, loan_amnt, funded_amnt,
         TRY_CAST(trim(replace(int_rate, '%', '')) AS DOUBLE) AS int_rate,
         TRY_CAST(trim(replace(revol_util, '%', '')) AS DOUBLE) AS revol_util,
         installment, annual_inc, dti,
         upper(trim(grade)) AS grade,
         CAST(try_strptime(issue_d, '%b-%Y') AS DATE) AS issue_d,
         CAST(try_strptime(earliest_cr_line, '%b-%Y') AS DATE) AS earliest_cr_line,
         CAST(try_strptime(last_pymnt_d, '%b-%Y') AS DATE) AS last_pymnt_d,
         CAST(try_strptime(last_credit_pull_d, '%b-%Y') AS DATE) AS last_credit_pull_d,
         TRY_CAST(regexp_extract(emp_length, '(\d+)', 1) AS DOUBLE) AS emp_length,
         term, home_ownership, purpose, delinq_2yrs, inq_last_6mths, open_acc, pub_rec, total_acc
  FROM raw_loans)"""

# Cleaned loans: the reference's pipeline (status filter -> drop >50% null columns ->
# types -> critical nulls -> shared features). mths_since_last_delinq is the column
# the null-ratio step removes on these tables.
VIEWS["clean_loans"] = """
clean_loans AS (
  SELECT loan_id, member_id, loan_status, loan_amnt, funded_amnt, int_rate, revol_util, installment, annual_inc, dti,
         grade, issue_d, earliest_cr_line, last_pymnt_d, last_credit_pull_d, emp_length, term, home_ownership, purpose,
         delinq_2yrs, inq_last_6mths, open_acc, pub_rec, total_acc,
         CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS default_flag,
         CAST(year(issue_d) AS INTEGER) AS issue_year,
         CAST(month(issue_d) AS INTEGER) AS issue_month
  FROM loans
  WHERE loan_status IN ('Fully Paid', 'Charged Off')
    AND loan_amnt IS NOT NULL AND int_rate IS NOT NULL AND annual_inc IS NOT NULL AND dti IS NOT NULL
    AND grade IS NOT NULL AND issue_d IS NOT NULL)"""

VIEWS["monthly_volume"] = """
monthly_volume AS (
  SELECT CAST(date_trunc('month', issue_d) AS DATE) AS month_start,
         CAST(sum(CAST(funded_amnt AS DECIMAL(18,2))) AS DOUBLE) AS funded_amnt,
         count(*) AS loan_count,
         CAST(sum(CAST(int_rate AS DECIMAL(18,2))) AS DOUBLE) / count(int_rate) AS avg_int_rate,
         CAST(sum(CAST(loan_amnt AS DECIMAL(18,2))) AS DOUBLE) / count(loan_amnt) AS avg_loan_amnt,
         CAST(sum(CAST(funded_amnt AS DECIMAL(18,2))) AS DOUBLE) / 1000000.0 AS funded_amnt_m
  FROM clean_loans WHERE issue_d IS NOT NULL AND funded_amnt IS NOT NULL
  GROUP BY 1)"""

VIEWS["grade_monthly"] = """
grade_monthly AS (
  SELECT CAST(date_trunc('month', issue_d) AS DATE) AS month_start,
         upper(trim(grade)) AS grade,
         CAST(sum(CAST(funded_amnt AS DECIMAL(18,2))) AS DOUBLE) AS funded_amnt,
         count(*) AS loan_count,
         CAST(sum(CAST(int_rate AS DECIMAL(18,2))) AS DOUBLE) / count(int_rate) AS avg_int_rate,
         CAST(sum(CAST(funded_amnt AS DECIMAL(18,2))) AS DOUBLE) / 1000000.0 AS funded_amnt_m
  FROM clean_loans WHERE issue_d IS NOT NULL AND grade IS NOT NULL AND funded_amnt IS NOT NULL
  GROUP BY 1, 2)"""

# Many-series long form: one series per grade plus the total.
VIEWS["series"] = """
series AS (
  SELECT grade AS series_id, month_start, funded_amnt / 1000.0 AS value FROM grade_monthly
  UNION ALL
  SELECT 'TOTAL' AS series_id, month_start, funded_amnt / 1000.0 AS value FROM monthly_volume)"""

# Sparse many-series table with gaps: per nation, monthly funded amount of grade-A
# loans over the full month spine (NULL where a nation had none that month).
VIEWS["nation_series"] = """
nation_series AS (
  WITH spine AS (
    SELECT CAST(unnest(generate_series(min(date_trunc('month', issue_d)), max(date_trunc('month', issue_d)), INTERVAL 1 MONTH)) AS DATE) AS month_start
    FROM loans),
  agg AS (
    SELECT c.c_nationkey AS n_nationkey, l.grade, CAST(date_trunc('month', l.issue_d) AS DATE) AS month_start,
           CAST(sum(CAST(l.funded_amnt AS DECIMAL(18,2))) AS DOUBLE) / 1000.0 AS value
    FROM loans l JOIN customer c ON l.member_id = c.c_custkey
    WHERE l.grade IS NOT NULL
    GROUP BY 1, 2, 3),
  pairs AS (SELECT DISTINCT a.n_nationkey, n.n_name, a.grade FROM agg a JOIN nation n ON a.n_nationkey = n.n_nationkey)
  SELECT p.n_name || '/' || p.grade AS series_id, s.month_start, a.value
  FROM spine s CROSS JOIN pairs p
  LEFT JOIN agg a ON a.n_nationkey = p.n_nationkey AND a.grade = p.grade AND a.month_start = s.month_start)"""

_DOB_Y = "(1940 + c.c_custkey % 60)"
_DOB_M = "(1 + (c.c_custkey // 28) % 12)"
_DOB_D = "(1 + c.c_custkey % 28)"
_TX_Y = "CAST(year(o.o_orderdate) AS BIGINT)"
_TX_M = "CAST(month(o.o_orderdate) AS BIGINT)"
_TX_D = "CAST(day(o.o_orderdate) AS BIGINT)"

VIEWS["transactions"] = f"""
transactions AS (
  SELECT o.o_orderkey AS TransactionID,
         CASE WHEN o.o_orderkey % 9 = 0 THEN ' C' || CAST(o.o_custkey AS VARCHAR) || ' ' ELSE 'C' || CAST(o.o_custkey AS VARCHAR) END AS CustomerID,
         CASE WHEN c.c_custkey % 97 = 0 THEN '1/1/1800'
              WHEN c.c_custkey % 5 = 0 THEN CAST({_DOB_Y} AS VARCHAR) || '-' || lpad(CAST({_DOB_M} AS VARCHAR), 2, '0') || '-' || lpad(CAST({_DOB_D} AS VARCHAR), 2, '0')
              WHEN {_DOB_Y} >= 1976 AND c.c_custkey % 2 = 0 THEN CAST({_DOB_D} AS VARCHAR) || '/' || CAST({_DOB_M} AS VARCHAR) || '/' || lpad(CAST({_DOB_Y} % 100 AS VARCHAR), 2, '0')
              ELSE lpad(CAST({_DOB_D} AS VARCHAR), 2, '0') || '-' || lpad(CAST({_DOB_M} AS VARCHAR), 2, '0') || '-' || CAST({_DOB_Y} AS VARCHAR) END AS CustomerDOB,
         CASE WHEN c.c_custkey % 50 = 0 THEN NULL
              WHEN c.c_custkey % 4 = 1 THEN lower(n.n_name)
              WHEN c.c_custkey % 4 = 2 THEN ' ' || replace(n.n_name, '_', '-') || '  '
              WHEN c.c_custkey % 4 = 3 AND c.c_custkey % 3 = 0 THEN n.n_name || ' (n)'
              ELSE n.n_name END AS CustLocation,
         c.c_acctbal AS CustAccountBalance,
         CASE WHEN o.o_orderkey % 3 = 0 THEN CAST({_TX_D} AS VARCHAR) || '/' || CAST({_TX_M} AS VARCHAR) || '/' || lpad(CAST({_TX_Y} % 100 AS VARCHAR), 2, '0')
              WHEN o.o_orderkey % 3 = 1 THEN strftime(o.o_orderdate, '%Y-%m-%d')
              WHEN o.o_orderkey % 11 = 2 AND {_TX_D} > 12 THEN CAST({_TX_M} AS VARCHAR) || '/' || CAST({_TX_D} AS VARCHAR) || '/' || CAST({_TX_Y} AS VARCHAR)
              ELSE lpad(CAST({_TX_D} AS VARCHAR), 2, '0') || '/' || lpad(CAST({_TX_M} AS VARCHAR), 2, '0') || '/' || CAST({_TX_Y} AS VARCHAR) END AS TransactionDate,
         CASE WHEN o.o_orderkey % 101 = 0 THEN -(o.o_totalprice / 100) ELSE o.o_totalprice / 100 END AS "TransactionAmount (INR)"
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

VIEWS["deposits"] = """
deposits AS (
  SELECT event_id AS deposit_id, user_id, ts, event_type,
         value AS amount,
         CAST(hour(ts) AS INTEGER) AS hour,
         CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
         CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS INTEGER) AS frequency
  FROM events)"""

_JOBS = ["admin.", "technician", "services", "management", "blue-collar"]
_MARITAL = ["married", "single", "divorced"]
_EDU = ["primary", "secondary", "tertiary", "unknown"]
_CONTACT = ["cellular", "telephone", "unknown"]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_POUT = ["unknown", "failure", "success", "other"]

VIEWS["campaign"] = f"""
campaign AS (
  WITH per_cust AS (
    SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
  SELECT c.c_custkey AS client_id,
         CASE WHEN c.c_custkey % 97 = 0 THEN NULL ELSE CAST(18 + (c.c_custkey * 7) % 75 AS INTEGER) END AS age,
         CASE WHEN c.c_custkey % 10 = 1 THEN ' ' || upper({_case_list('c.c_custkey % 5', _JOBS)}) ELSE {_case_list('c.c_custkey % 5', _JOBS)} END AS job,
         {_case_list('c.c_custkey % 3', _MARITAL)} AS marital,
         {_case_list('c.c_custkey % 4', _EDU)} AS education,
         CASE WHEN c.c_acctbal < 0 THEN 'yes' ELSE 'no' END AS "default",
         c.c_acctbal AS balance,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS housing,
         CASE WHEN c.c_custkey % 5 = 0 THEN 'yes' ELSE 'no' END AS loan,
         {_case_list('c.c_custkey % 3', _CONTACT)} AS contact,
         CAST(1 + c.c_custkey % 28 AS INTEGER) AS "day",
         {_case_list('c.c_custkey % 12', _MONTHS)} AS "month",
         CAST(coalesce(p.n_orders, 0) * 37 + c.c_custkey % 300 AS INTEGER) AS duration,
         CAST(1 + coalesce(p.n_orders, 0) % 6 AS INTEGER) AS campaign,
         CAST(CASE WHEN c.c_custkey % 4 = 0 THEN -1 ELSE c.c_custkey % 400 END AS INTEGER) AS pdays,
         CAST(c.c_custkey % 4 AS INTEGER) AS previous,
         {_case_list('c.c_custkey % 4', _POUT)} AS poutcome,
         CASE WHEN (c.c_custkey * 7919 + coalesce(p.n_orders, 0) * 31) % 100 < 15 THEN 'yes' ELSE 'no' END AS y
  FROM customer c LEFT JOIN per_cust p ON c.c_custkey = p.o_custkey)"""

# Per-region grade demand: funded amount (millions) and loan count per region x grade x month.
VIEWS["region_grade"] = """
region_grade AS (
  SELECT r.r_name AS portfolio, upper(trim(c.grade)) AS grade, CAST(date_trunc('month', c.issue_d) AS DATE) AS month_start,
         CAST(sum(CAST(c.funded_amnt AS DECIMAL(18,2))) AS DOUBLE) / 1000000.0 AS value, count(*) AS loan_count
  FROM clean_loans c JOIN customer cu ON c.member_id = cu.c_custkey JOIN nation n ON cu.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE c.issue_d IS NOT NULL AND c.grade IS NOT NULL AND c.funded_amnt IS NOT NULL
  GROUP BY 1, 2, 3)"""

# Dependencies between views, so an oracle pulls in exactly what it needs.
DEPS = {
    "li_order": [],
    "raw_loans": ["li_order"],
    "loans": ["raw_loans"],
    "clean_loans": ["loans"],
    "monthly_volume": ["clean_loans"],
    "grade_monthly": ["clean_loans"],
    "series": ["grade_monthly", "monthly_volume"],
    "nation_series": ["loans"],
    "transactions": [],
    "deposits": [],
    "campaign": [],
    "region_grade": ["clean_loans"],
}


def with_views(*names: str) -> str:
    """``WITH`` clause holding the named views and their dependencies, in order."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(VIEWS[n].strip() for n in ordered) + "\n"


def sql_parse_mixed_dates(col: str, pivot: int = 76) -> str:
    """DuckDB twin of ``functions.expr.parse_mixed_dates``."""
    iso = r"'^(\d{4})-(\d{1,2})-(\d{1,2})$'"
    dmy = r"'^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})$'"
    s = f"trim(CAST({col} AS VARCHAR))"
    a = f"TRY_CAST(regexp_extract({s}, {dmy}, 1) AS INTEGER)"
    b = f"TRY_CAST(regexp_extract({s}, {dmy}, 2) AS INTEGER)"
    yt = f"regexp_extract({s}, {dmy}, 3)"
    y = (f"(CASE WHEN length({yt}) = 2 THEN (CASE WHEN TRY_CAST({yt} AS INTEGER) < {pivot} "
         f"THEN TRY_CAST({yt} AS INTEGER) + 2000 ELSE TRY_CAST({yt} AS INTEGER) + 1900 END) ELSE TRY_CAST({yt} AS INTEGER) END)")
    day = f"(CASE WHEN {b} <= 12 THEN {a} ELSE {b} END)"
    mon = f"(CASE WHEN {b} <= 12 THEN {b} ELSE {a} END)"

    def ymd(yy, mm, dd):
        return (f"CAST(try_strptime(lpad(CAST({yy} AS VARCHAR), 4, '0') || '-' || lpad(CAST({mm} AS VARCHAR), 2, '0') || '-' || "
                f"lpad(CAST({dd} AS VARCHAR), 2, '0'), '%Y-%m-%d') AS DATE)")
    iso_d = ymd(f"TRY_CAST(regexp_extract({s}, {iso}, 1) AS INTEGER)", f"TRY_CAST(regexp_extract({s}, {iso}, 2) AS INTEGER)",
                f"TRY_CAST(regexp_extract({s}, {iso}, 3) AS INTEGER)")
    return (f"(CASE WHEN regexp_matches({s}, {iso}) THEN {iso_d} "
            f"WHEN regexp_matches({s}, {dmy}) AND ({b} <= 12 OR {a} <= 12) THEN {ymd(y, mon, day)} ELSE NULL END)")


def sql_normalize_location(col: str) -> str:
    s = f"trim(regexp_replace(regexp_replace(upper(CAST({col} AS VARCHAR)), '[^A-Z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))"
    return f"(CASE WHEN {col} IS NULL OR {s} IN ('', 'NAN', 'NONE') THEN 'UNKNOWN' ELSE {s} END)"


VIEWS["tx_clean"] = f"""
tx_clean AS (
  WITH p AS (
    SELECT TransactionID, trim(CustomerID) AS CustomerID,
           {sql_parse_mixed_dates('CustomerDOB')} AS dob,
           CustLocation, {sql_normalize_location('CustLocation')} AS CustLocationNorm,
           TRY_CAST(CustAccountBalance AS DOUBLE) AS CustAccountBalance,
           {sql_parse_mixed_dates('TransactionDate')} AS TransactionDate,
           TRY_CAST("TransactionAmount (INR)" AS DOUBLE) AS TransactionAmount
    FROM transactions),
  f AS (
    SELECT TransactionID, CustomerID, CASE WHEN year(dob) < 1900 THEN NULL ELSE dob END AS CustomerDOB, CustLocation,
           CustLocationNorm, CustAccountBalance, TransactionDate, TransactionAmount
    FROM p
    WHERE CustomerID IS NOT NULL AND TransactionDate IS NOT NULL AND TransactionAmount IS NOT NULL
      AND CustAccountBalance IS NOT NULL AND TransactionAmount >= 0),
  r AS (SELECT max(TransactionDate) AS ref FROM f)
  SELECT f.*, CASE WHEN date_diff('day', CustomerDOB, ref) / 365.25 < 18 OR date_diff('day', CustomerDOB, ref) / 365.25 > 100
                   THEN NULL ELSE date_diff('day', CustomerDOB, ref) / 365.25 END AS Age
  FROM f CROSS JOIN r)"""
DEPS["tx_clean"] = ["transactions"]

# Deterministic stand-in for model outputs (S-checkable): linear, clipped scores.
VIEWS["scored_loans"] = """
scored_loans AS (
  SELECT *,
         least(0.99, greatest(0.01, (int_rate - 5) / 25 + (dti - 17.5) / 100)) AS default_probability,
         least(0.99, greatest(0.01, 0.1 + coalesce(emp_length, 0) / 15 - coalesce(revol_util, 0) / 500)) AS churn_probability
  FROM clean_loans)"""
DEPS["scored_loans"] = ["clean_loans"]
