"""Queries for RFM, Pareto, behavioural benchmarks, regional scores and personas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import sql_rnd
from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import segment as G
from ..sources.domain import Tables, transactions
from .registry import query
from .sql_views import with_views as V


def _tx(spark, d):
    return C.prepare_transactions(transactions(Tables(spark, d)))


def _q(n: str) -> str:
    """Quintile score SQL over a global row number ``r`` and table size ``n``."""
    return f"CAST(CASE WHEN {n} - 1 <= 0 THEN 5 ELSE greatest(1, ((r - 1) * 5 + {n} - 2) // ({n} - 1)) END AS INTEGER)"


SQL_RFM = V("tx_clean") + f"""
, rfm_agg AS (
  SELECT CustomerID, max(TransactionDate) AS LastTransactionDate, count(TransactionAmount) AS Frequency,
         CAST(sum(CAST(TransactionAmount AS DECIMAL(24,4))) AS DOUBLE) AS Monetary,
         CAST(sum(CAST(CustAccountBalance AS DECIMAL(18,2))) AS DOUBLE) / count(CustAccountBalance) AS AvgAccountBalance,
         median(Age) AS MedianAge
  FROM tx_clean GROUP BY CustomerID)
, loc_mode AS (
  SELECT CustomerID, CustLocationNorm FROM (
    SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY n DESC, CustLocationNorm) AS rn
    FROM (SELECT CustomerID, CustLocationNorm, count(*) AS n FROM tx_clean GROUP BY CustomerID, CustLocationNorm) a) b
  WHERE rn = 1)
, rfm_base AS (
  SELECT a.CustomerID, a.LastTransactionDate, a.Frequency, a.Monetary, a.AvgAccountBalance,
         coalesce(a.MedianAge, (SELECT median(MedianAge) FROM rfm_agg)) AS MedianAge, l.CustLocationNorm,
         CAST(date_diff('day', a.LastTransactionDate, (SELECT max(TransactionDate) FROM tx_clean)) AS INTEGER) AS Recency
  FROM rfm_agg a LEFT JOIN loc_mode l ON a.CustomerID = l.CustomerID)
, r1 AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY Recency, CustomerID) AS r FROM rfm_base)
, r2 AS (SELECT * EXCLUDE (r), 6 - {_q('n')} AS R_Score, row_number() OVER (ORDER BY Frequency, CustomerID) AS r FROM r1)
, r3 AS (SELECT * EXCLUDE (r), {_q('n')} AS F_Score, row_number() OVER (ORDER BY Monetary, CustomerID) AS r FROM r2)
, r4 AS (SELECT * EXCLUDE (r, n), {_q('n')} AS M_Score FROM r3)
, rfm AS (SELECT *, R_Score + F_Score + M_Score AS RFM_Consolidated,
                 CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Score,
                 Monetary + greatest(AvgAccountBalance, 0.0) AS WealthValue FROM r4)
, wealth AS (
  SELECT *, WealthValue >= (SELECT quantile_cont(WealthValue, 0.8) FROM rfm) AS IsVitalFew,
         CASE WHEN t.tot > 0 THEN WealthValue / t.tot ELSE 0.0 END AS WealthSharePct,
         row_number() OVER (ORDER BY WealthValue DESC, CustomerID) AS WealthRank
  FROM rfm CROSS JOIN (SELECT sum(WealthValue) AS tot FROM rfm) t)
, customers AS (
  SELECT * EXCLUDE (tot), sum(WealthSharePct) OVER (ORDER BY WealthValue DESC, CustomerID ROWS UNBOUNDED PRECEDING)
         AS CumulativeWealthSharePct FROM wealth)
"""


def _customers(spark, d):
    return G.rfm_wealth_layer(_tx(spark, d))


@query("rfm_customer", SQL_RFM + f"""
SELECT CustomerID, LastTransactionDate, Frequency, Monetary, AvgAccountBalance, {sql_rnd('MedianAge', 6)} AS MedianAge,
       CustLocationNorm, Recency FROM rfm_base""")
def q_rfm_customer(spark, d):
    b = G.rfm_base(_tx(spark, d))
    return b.withColumn("MedianAge", X.rnd(F.col("MedianAge"), 6))


@query("location_mode", SQL_RFM + "SELECT CustomerID, CustLocationNorm FROM loc_mode")
def q_location_mode(spark, d):
    return A.location_mode(_tx(spark, d))


@query("join_location_mode", SQL_RFM + """
SELECT a.CustomerID, a.Frequency, l.CustLocationNorm FROM rfm_agg a LEFT JOIN loc_mode l ON a.CustomerID = l.CustomerID""")
def q_join_location_mode(spark, d):
    tx = _tx(spark, d)
    agg = tx.groupBy("CustomerID").agg(F.count("TransactionAmount").alias("Frequency"))
    return agg.join(A.location_mode(tx), "CustomerID", "left")


@query("quintile_scores", SQL_RFM + "SELECT CustomerID, R_Score, F_Score, M_Score FROM r4")
def q_quintile_scores(spark, d):
    return G.rfm_scores(G.rfm_base(_tx(spark, d))).select("CustomerID", "R_Score", "F_Score", "M_Score")


@query("rfm_scores", SQL_RFM + "SELECT CustomerID, Recency, Frequency, Monetary, R_Score, F_Score, M_Score, RFM_Consolidated, RFM_Score FROM rfm")
def q_rfm_scores(spark, d):
    return G.rfm_scores(G.rfm_base(_tx(spark, d))).select(
        "CustomerID", "Recency", "Frequency", "Monetary", "R_Score", "F_Score", "M_Score", "RFM_Consolidated", "RFM_Score")


@query("pareto_wealth", SQL_RFM + f"""
SELECT CustomerID, WealthValue, IsVitalFew, {sql_rnd('WealthSharePct', 9)} AS WealthSharePct,
       {sql_rnd('CumulativeWealthSharePct', 6)} AS CumulativeWealthSharePct, WealthRank FROM customers""")
def q_pareto_wealth(spark, d):
    c = _customers(spark, d)
    return c.select("CustomerID", "WealthValue", "IsVitalFew", X.rnd(F.col("WealthSharePct"), 9).alias("WealthSharePct"),
                    X.rnd(F.col("CumulativeWealthSharePct"), 6).alias("CumulativeWealthSharePct"), "WealthRank")


SQL_BEHAV = V("tx_clean") + """
, reg AS (
  SELECT CustLocationNorm, quantile_cont(TransactionAmount, 0.5) AS loc_median, quantile_cont(TransactionAmount, 0.25) AS loc_q1,
         quantile_cont(TransactionAmount, 0.75) AS loc_q3, quantile_cont(TransactionAmount, 0.99) AS loc_p99
  FROM tx_clean GROUP BY CustLocationNorm)
, reg2 AS (SELECT *, CASE WHEN loc_q3 - loc_q1 = 0 THEN 1.0 ELSE loc_q3 - loc_q1 END AS loc_iqr FROM reg)
, cst AS (
  SELECT CustomerID, median(TransactionAmount) AS cust_median, coalesce(stddev_samp(TransactionAmount), 0.0) AS cust_std,
         count(TransactionAmount) AS cust_n FROM tx_clean GROUP BY CustomerID)
, j AS (
  SELECT t.*, r.loc_median, r.loc_q1, r.loc_q3, r.loc_p99, r.loc_iqr, c.cust_median, c.cust_std, c.cust_n,
         coalesce(t.TransactionAmount > r.loc_q3 + 3.0 * r.loc_iqr, false) AS flag_regional_outlier,
         coalesce(t.TransactionAmount >= r.loc_p99, false) AS flag_extreme_high,
         coalesce(c.cust_n >= 5 AND t.TransactionAmount > greatest(c.cust_median * 3.0, c.cust_median + 3.0 * c.cust_std), false)
           AS flag_customer_spike,
         coalesce(t.CustAccountBalance < 0, false) AS flag_balance_stress
  FROM tx_clean t LEFT JOIN reg2 r ON t.CustLocationNorm = r.CustLocationNorm LEFT JOIN cst c ON t.CustomerID = c.CustomerID)
, behav AS (
  SELECT *, least(greatest(0.40 * CAST(flag_regional_outlier AS DOUBLE) + 0.25 * CAST(flag_extreme_high AS DOUBLE)
                   + 0.25 * CAST(flag_customer_spike AS DOUBLE) + 0.10 * CAST(flag_balance_stress AS DOUBLE), 0.0), 1.0)
              AS BehavioralAnomalyScore,
         abs(TransactionAmount - loc_median) / loc_iqr AS RegionalIqrDeviation,
         coalesce(abs(TransactionAmount - cust_median) / nullif(cust_std, 0.0), 0.0) AS CustomerZLike,
         CASE WHEN NOT (flag_regional_outlier OR flag_extreme_high OR flag_customer_spike OR flag_balance_stress)
              THEN 'Within expected behavior'
              ELSE concat_ws(', ', CASE WHEN flag_regional_outlier THEN 'Regional benchmark outlier' END,
                                   CASE WHEN flag_extreme_high THEN 'Extreme transaction amount (P99+)' END,
                                   CASE WHEN flag_customer_spike THEN 'Spike vs customer historical behavior' END,
                                   CASE WHEN flag_balance_stress THEN 'Negative account balance stress' END) END AS BehavioralReason
  FROM j)
"""


@query("regional_benchmark", SQL_BEHAV + f"""
SELECT CustLocationNorm, {sql_rnd('loc_median', 6)} AS loc_median, {sql_rnd('loc_q1', 6)} AS loc_q1, {sql_rnd('loc_q3', 6)} AS loc_q3,
       {sql_rnd('loc_p99', 6)} AS loc_p99, {sql_rnd('loc_iqr', 6)} AS loc_iqr FROM reg2""")
def q_regional_benchmark(spark, d):
    r = A.regional_benchmark(_tx(spark, d))
    return r.select("CustLocationNorm", *[X.rnd(F.col(c), 6).alias(c) for c in ["loc_median", "loc_q1", "loc_q3", "loc_p99", "loc_iqr"]])


@query("customer_benchmark", SQL_BEHAV + f"""
SELECT CustomerID, {sql_rnd('cust_median', 6)} AS cust_median, {sql_rnd('cust_std', 6)} AS cust_std, cust_n FROM cst""")
def q_customer_benchmark(spark, d):
    c = A.customer_benchmark(_tx(spark, d))
    return c.select("CustomerID", X.rnd(F.col("cust_median"), 6).alias("cust_median"), X.rnd(F.col("cust_std"), 6).alias("cust_std"),
                    "cust_n")


@query("behavioral_anomalies", SQL_BEHAV + f"""
SELECT TransactionID, CustomerID, {sql_rnd('RegionalIqrDeviation', 6)} AS RegionalIqrDeviation,
       {sql_rnd('CustomerZLike', 6)} AS CustomerZLike, flag_regional_outlier, flag_extreme_high, flag_customer_spike,
       flag_balance_stress, BehavioralAnomalyScore, BehavioralAnomalyScore >= 0.5 AS IsBehavioralAnomaly, BehavioralReason
FROM behav""")
def q_behavioral_anomalies(spark, d):
    b = G.behavioral_anomalies(_tx(spark, d))
    return b.select("TransactionID", "CustomerID", X.rnd(F.col("RegionalIqrDeviation"), 6).alias("RegionalIqrDeviation"),
                    X.rnd(F.col("CustomerZLike"), 6).alias("CustomerZLike"), "flag_regional_outlier", "flag_extreme_high",
                    "flag_customer_spike", "flag_balance_stress", "BehavioralAnomalyScore", "IsBehavioralAnomaly",
                    "BehavioralReason")


@query("join_regional_customer", SQL_BEHAV + f"""
SELECT TransactionID, CustLocationNorm, {sql_rnd('loc_median', 6)} AS loc_median, CustomerID,
       {sql_rnd('cust_median', 6)} AS cust_median, cust_n FROM j""")
def q_join_regional_customer(spark, d):
    """Transactions with their location statistics and their customer statistics."""
    tx = _tx(spark, d)
    j = tx.join(A.regional_benchmark(tx), "CustLocationNorm", "left").join(A.customer_benchmark(tx), "CustomerID", "left")
    return j.select("TransactionID", "CustLocationNorm", X.rnd(F.col("loc_median"), 6).alias("loc_median"), "CustomerID",
                    X.rnd(F.col("cust_median"), 6).alias("cust_median"), "cust_n")


@query("top_behavioral", SQL_BEHAV + """
SELECT TransactionID, CustomerID, BehavioralAnomalyScore, BehavioralReason FROM behav
WHERE BehavioralAnomalyScore >= 0.5 ORDER BY BehavioralAnomalyScore DESC, TransactionID LIMIT 25""")
def q_top_behavioral(spark, d):
    b = G.behavioral_anomalies(_tx(spark, d)).filter("IsBehavioralAnomaly")
    return b.orderBy(F.col("BehavioralAnomalyScore").desc(), "TransactionID").limit(25).select(
        "TransactionID", "CustomerID", "BehavioralAnomalyScore", "BehavioralReason")


SQL_REGION = SQL_RFM + """
, reg_a AS (
  SELECT CustLocationNorm, count(CustomerID) AS Customers,
         CAST(sum(CAST(AvgAccountBalance AS DECIMAL(18,2))) AS DOUBLE) AS TotalAccountBalance,
         CAST(sum(CAST(AvgAccountBalance AS DECIMAL(18,2))) AS DOUBLE) / count(AvgAccountBalance) AS AvgAccountBalance,
         median(AvgAccountBalance) AS MedianAccountBalance,
         CAST(sum(CAST(Monetary AS DECIMAL(24,4))) AS DOUBLE) AS TotalTransactionValue,
         avg(CASE WHEN IsVitalFew THEN 1.0 ELSE 0.0 END) AS VitalFewShare,
         CAST(sum(RFM_Consolidated) AS DOUBLE) / count(RFM_Consolidated) AS AvgRfmConsolidated
  FROM customers GROUP BY CustLocationNorm)
, mm AS (SELECT min(TotalAccountBalance) a1, max(TotalAccountBalance) b1, min(TotalTransactionValue) a2, max(TotalTransactionValue) b2,
                min(VitalFewShare) a3, max(VitalFewShare) b3, min(AvgRfmConsolidated) a4, max(AvgRfmConsolidated) b4 FROM reg_a)
, reg_s AS (
  SELECT reg_a.*,
    0.40 * (CASE WHEN b1 - a1 < 1e-12 THEN 1.0 ELSE (TotalAccountBalance - a1) / (b1 - a1) END)
    + 0.30 * (CASE WHEN b2 - a2 < 1e-12 THEN 1.0 ELSE (TotalTransactionValue - a2) / (b2 - a2) END)
    + 0.20 * (CASE WHEN b3 - a3 < 1e-12 THEN 1.0 ELSE (VitalFewShare - a3) / (b3 - a3) END)
    + 0.10 * (CASE WHEN b4 - a4 < 1e-12 THEN 1.0 ELSE (AvgRfmConsolidated - a4) / (b4 - a4) END) AS PotentialScore
  FROM reg_a CROSS JOIN mm)
, regions AS (SELECT *, PotentialScore >= (SELECT quantile_cont(PotentialScore, 0.75) FROM reg_s) AS HighPotentialZone FROM reg_s)
"""


def _regional(cust):
    """Regional intelligence with exact sums (the blend then agrees bit for bit)."""
    return G.regional_intelligence(cust)


@query("regional_intelligence", SQL_REGION + f"""
SELECT CustLocationNorm, Customers, TotalAccountBalance, {sql_rnd('AvgAccountBalance', 6)} AS AvgAccountBalance,
       {sql_rnd('MedianAccountBalance', 6)} AS MedianAccountBalance, TotalTransactionValue, {sql_rnd('VitalFewShare', 6)} AS VitalFewShare,
       {sql_rnd('AvgRfmConsolidated', 6)} AS AvgRfmConsolidated, {sql_rnd('PotentialScore', 6)} AS PotentialScore, HighPotentialZone
FROM regions""")
def q_regional_intelligence(spark, d):
    r = _regional(_customers(spark, d))
    return r.select("CustLocationNorm", "Customers", "TotalAccountBalance", X.rnd(F.col("AvgAccountBalance"), 6).alias("AvgAccountBalance"),
                    X.rnd(F.col("MedianAccountBalance"), 6).alias("MedianAccountBalance"), "TotalTransactionValue",
                    X.rnd(F.col("VitalFewShare"), 6).alias("VitalFewShare"),
                    X.rnd(F.col("AvgRfmConsolidated"), 6).alias("AvgRfmConsolidated"),
                    X.rnd(F.col("PotentialScore"), 6).alias("PotentialScore"), "HighPotentialZone")


@query("top_regions", SQL_REGION + f"""
SELECT CustLocationNorm, {sql_rnd('PotentialScore', 6)} AS PotentialScore, HighPotentialZone FROM regions
ORDER BY PotentialScore DESC, CustLocationNorm LIMIT 10""")
def q_top_regions(spark, d):
    r = _regional(_customers(spark, d))
    return r.orderBy(F.col("PotentialScore").desc(), "CustLocationNorm").limit(10).select(
        "CustLocationNorm", X.rnd(F.col("PotentialScore"), 6).alias("PotentialScore"), "HighPotentialZone")


@query("top_vital_few", SQL_RFM + """
SELECT CustomerID, WealthValue, CustLocationNorm, RFM_Score FROM customers WHERE IsVitalFew
ORDER BY WealthValue DESC, CustomerID LIMIT 20""")
def q_top_vital_few(spark, d, n: int = 20):
    n = max(5, min(100, n))
    c = _customers(spark, d).filter("IsVitalFew")
    return c.orderBy(F.col("WealthValue").desc(), "CustomerID").limit(n).select("CustomerID", "WealthValue", "CustLocationNorm",
                                                                                "RFM_Score")


# Stand-in cluster labels for the SQL-checked profile/persona queries (k-means itself
# is the rows-checked ``persona_kmeans``): a deterministic function of the scores.
SQL_PERSONA = SQL_RFM + """
, clustered AS (SELECT *, CAST((R_Score * 3 + F_Score) % 4 AS INTEGER) AS Cluster FROM customers)
, prof AS (
  SELECT Cluster, count(CustomerID) AS Customers, avg(MedianAge) AS MedianAge, avg(Recency) AS Recency, avg(Frequency) AS Frequency,
         avg(Monetary) AS Monetary, avg(AvgAccountBalance) AS AvgAccountBalance,
         avg(CASE WHEN IsVitalFew THEN 1.0 ELSE 0.0 END) AS VitalFewShare
  FROM clustered GROUP BY Cluster)
, p1 AS (SELECT *, row_number() OVER (ORDER BY Frequency, Monetary, Cluster) AS r1, count(*) OVER () AS k FROM prof)
, p2 AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN r1 > 1 THEN 0 ELSE 1 END, MedianAge DESC, Monetary DESC,
                                      AvgAccountBalance DESC, Cluster) AS r2 FROM p1)
, p3 AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN r1 > 1 AND r2 > 1 THEN 0 ELSE 1 END,
                                      Frequency - 0.10 * MedianAge DESC, Cluster) AS r3 FROM p2)
, personas AS (
  SELECT *, CASE WHEN k <> 4 THEN 'Segment ' || CAST(Cluster AS VARCHAR) WHEN r1 = 1 THEN 'Low-Activity Accounts'
                 WHEN r2 = 1 THEN 'Wealthy Seniors' WHEN r3 = 1 THEN 'Frequent Young Transactors' ELSE 'Mid-Tier Savers' END AS Persona
  FROM p3)
"""


def _clustered(spark, d):
    c = _customers(spark, d)
    return c.withColumn("Cluster", ((F.col("R_Score") * 3 + F.col("F_Score")) % 4).cast("int"))


@query("cluster_profile", SQL_PERSONA + f"""
SELECT Cluster, Customers, {sql_rnd('MedianAge', 6)} AS MedianAge, {sql_rnd('Recency', 6)} AS Recency,
       {sql_rnd('Frequency', 6)} AS Frequency, {sql_rnd('Monetary', 4)} AS Monetary,
       {sql_rnd('AvgAccountBalance', 4)} AS AvgAccountBalance, {sql_rnd('VitalFewShare', 6)} AS VitalFewShare FROM prof""")
def q_cluster_profile(spark, d):
    p = G.cluster_profile(_clustered(spark, d))
    return p.select("Cluster", "Customers", *[X.rnd(F.col(c), 6).alias(c) for c in ["MedianAge", "Recency", "Frequency"]],
                    *[X.rnd(F.col(c), 4).alias(c) for c in ["Monetary", "AvgAccountBalance"]],
                    X.rnd(F.col("VitalFewShare"), 6).alias("VitalFewShare"))


@query("persona_mapping", SQL_PERSONA + "SELECT Cluster, Persona FROM personas")
def q_persona_mapping(spark, d):
    return G.persona_mapping(G.cluster_profile(_clustered(spark, d))).select("Cluster", "Persona")


@query("map_lookup", SQL_PERSONA + """
SELECT c.CustomerID, c.Cluster, coalesce(p.Persona, 'Other') AS Persona FROM clustered c LEFT JOIN personas p ON c.Cluster = p.Cluster""")
def q_map_lookup(spark, d):
    """Cluster -> persona as a broadcast lookup join (the mapping has one row per cluster)."""
    c = _clustered(spark, d)
    m = G.persona_mapping(G.cluster_profile(c)).select("Cluster", "Persona")
    return c.join(F.broadcast(m), "Cluster", "left").select("CustomerID", "Cluster", F.coalesce("Persona", F.lit("Other")).alias("Persona"))


@query("persona_counts", SQL_PERSONA + """
SELECT p.Persona, count(*) AS Customers FROM clustered c JOIN personas p ON c.Cluster = p.Cluster GROUP BY p.Persona""")
def q_persona_counts(spark, d):
    c = _clustered(spark, d)
    m = G.persona_mapping(G.cluster_profile(c)).select("Cluster", "Persona")
    return c.join(F.broadcast(m), "Cluster").groupBy("Persona").agg(F.count(F.lit(1)).alias("Customers")).orderBy(F.desc("Customers"))


@query("pipeline_summary", SQL_BEHAV.replace(V("tx_clean"), SQL_RFM) + """
SELECT (SELECT count(*) FROM tx_clean) AS transactions, (SELECT count(DISTINCT CustomerID) FROM tx_clean) AS customers,
       (SELECT avg(CASE WHEN IsVitalFew THEN 1.0 ELSE 0.0 END) FROM customers) AS vital_few_share,
       (SELECT avg(CASE WHEN BehavioralAnomalyScore >= 0.5 THEN 1.0 ELSE 0.0 END) FROM behav) AS behavioral_anomaly_share,
       (SELECT CAST(sum(CASE WHEN BehavioralAnomalyScore >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) FROM behav) AS behavioral_anomalies""")
def q_pipeline_summary(spark, d):
    tx = _tx(spark, d)
    return A.pipeline_summary(tx, G.rfm_wealth_layer(tx), G.behavioral_anomalies(tx))


@query("persona_pipeline")
def q_persona_pipeline(spark, d):
    """Clean -> RFM -> personas -> behavioural anomalies -> regional potential, one row
    per customer."""
    return G.persona_pipeline(_tx(spark, d))
