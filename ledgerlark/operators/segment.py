"""Customer segmentation: RFM scores, Pareto wealth layer, behavioural benchmarks,
regional intelligence and persona profiles.

Global orderings (quintile ranks, cumulative wealth share) use the range-partitioned
ranks of :mod:`ledgerlark.operators.ranking`; per-location and per-customer medians
and quantiles are exact and skew-safe for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import stable
from . import aggregate as A
from . import ranking as R
from .joins import lookup

PERSONAS = ["Low-Activity Accounts", "Wealthy Seniors", "Frequent Young Transactors", "Mid-Tier Savers"]


def exact_sum4(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(24,4)")).cast("double")


def rfm_base(tx: DataFrame) -> DataFrame:
    """Per customer: last date, count, exact sum, exact mean balance, median age (NULL ->
    median of medians), modal location, recency in days vs the latest transaction."""
    agg = tx.groupBy("CustomerID").agg(
        F.max("TransactionDate").alias("LastTransactionDate"),
        F.count("TransactionAmount").alias("Frequency"),
        exact_sum4("TransactionAmount").alias("Monetary"),
        X.exact_mean2("CustAccountBalance").alias("AvgAccountBalance"),
    )
    med_age = R.few_value_quantiles(tx, ["CustomerID"], "Age", {"MedianAge": 0.5})  # whole days of 18 to 100 years
    cust = agg.join(med_age, "CustomerID", "left").join(A.location_mode(tx), "CustomerID", "left")
    ref = tx.agg(F.max("TransactionDate").alias("_ref"))
    fill = R.scalar_quantiles(med_age, "MedianAge", {"_age_fill": 0.5})
    cust = cust.crossJoin(F.broadcast(ref)).crossJoin(F.broadcast(fill))  # one-row scalars
    out = cust.select(
        "CustomerID", "LastTransactionDate", "Frequency", "Monetary", "AvgAccountBalance",
        F.coalesce("MedianAge", "_age_fill").alias("MedianAge"), "CustLocationNorm",
        F.datediff("_ref", "LastTransactionDate").alias("Recency"))
    # one row per customer, read by three global rankings, the wealth layer, regional
    # scores and personas: computed once and written to the shared checkpoint folder
    return stable(out, "rfm_base")


def _quintiles(df: DataFrame, scores: dict[str, tuple[str, bool]], tie: str) -> DataFrame:
    """Adds a quintile 1..5 per entry ``output -> (metric, higher is better)``, equal to pandas
    ``qcut(rank(method='first'), 5)`` over (metric, tie key).

    One ranking of narrow (metric, value, tie) rows finds the last row of each of the first
    four quintiles; the table itself is only compared with these cuts, one broadcast row.
    Rank r has score <= s where 5 * (r - 1) <= s * (n - 1); one row alone scores 5."""
    key = lambda m: F.struct(F.col(m).cast("double").alias("v"), F.col(tie).alias("t"))
    names = sorted({m for m, _ in scores.values()})
    long = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("_m"), key(m).alias("_k")) for m in names])))
    ranked = R.group_row_number(long, ["_m"], [F.col("_k")], out="_r", size_out="_n", few=True)
    cut = lambda s: F.expr(f"(_n - 1) * {s} DIV 5 + 1")
    row = ranked.agg(F.max("_n").alias("_q_n"), *[
        F.max(F.when((F.col("_m") == m) & (F.col("_r") == cut(s)), F.col("_k"))).alias(f"_q_{i}_{s}")
        for i, m in enumerate(names) for s in (1, 2, 3, 4)])
    out = df.crossJoin(F.broadcast(row))  # one row of cuts
    for name, (metric, higher) in scores.items():
        i = names.index(metric)
        s = 1 + sum((key(metric) > F.col(f"_q_{i}_{c}")).cast("int") for c in (1, 2, 3, 4))
        s = F.when(F.col("_q_n") <= 1, F.lit(5)).otherwise(s)
        out = out.withColumn(name, (s if higher else F.lit(6) - s).cast("int"))
    return out.drop(*row.columns)


def quintile_scores(df: DataFrame, metric: str, out: str, higher_is_better: bool = True, tie: str = "CustomerID") -> DataFrame:
    """Quintile 1..5 of ``metric`` with ties in the order of ``tie``."""
    return _quintiles(df, {out: (metric, higher_is_better)}, tie)


def rfm_scores(cust: DataFrame) -> DataFrame:
    s = _quintiles(cust, {"R_Score": ("Recency", False), "F_Score": ("Frequency", True), "M_Score": ("Monetary", True)}, "CustomerID")
    return s.withColumns({
        "RFM_Consolidated": F.col("R_Score") + F.col("F_Score") + F.col("M_Score"),
        "RFM_Score": F.concat(F.col("R_Score").cast("string"), F.col("F_Score").cast("string"), F.col("M_Score").cast("string")),
    })


def pareto_wealth(cust: DataFrame, vital_q: float = 0.8) -> DataFrame:
    """Wealth = monetary + max(balance, 0); vital few = wealth >= its 80th percentile;
    share of total wealth and cumulative share in descending wealth order (ties by id).

    One global ranking serves both the cumulative share and the percentile: the
    percentile's two neighbouring order statistics are read off the ranked rows (linear
    interpolation, as pandas), so no second sort of the table is needed."""
    w = cust.withColumn("WealthValue", F.col("Monetary") + F.greatest(F.col("AvgAccountBalance"), F.lit(0.0)))
    tot = w.agg(F.sum("WealthValue").alias("_tot"))
    w = w.crossJoin(F.broadcast(tot))  # one-row scalar
    w = w.withColumn("WealthSharePct", F.when(F.col("_tot") > 0, F.col("WealthValue") / F.col("_tot")).otherwise(F.lit(0.0)))
    ranked = R.global_row_number(w, [F.col("WealthValue").desc(), F.col("CustomerID")], out="WealthRank",
                                 sum_col="WealthSharePct", cum_out="CumulativeWealthSharePct", total_out="_n")
    asc = F.col("_n") - F.col("WealthRank")  # 0-based position in ascending order
    pos = (F.col("_n") - 1) * vital_q
    thr = ranked.agg(F.max(F.when(asc == F.floor(pos), F.col("WealthValue"))).alias("_lo"),
                     F.max(F.when(asc == F.ceil(pos), F.col("WealthValue"))).alias("_hi"),
                     F.max(pos - F.floor(pos)).alias("_fr"))
    thr = thr.select((F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_fr")).alias("_thr"))
    out = ranked.crossJoin(F.broadcast(thr))  # one-row scalar
    return out.withColumn("IsVitalFew", F.col("WealthValue") >= F.col("_thr")).drop("_thr", "_tot", "_n")


def rfm_wealth_layer(tx: DataFrame) -> DataFrame:
    return pareto_wealth(rfm_scores(rfm_base(tx)))


def behavioral_anomalies(tx: DataFrame) -> DataFrame:
    """Each transaction against its location's quantiles and its customer's history:
    regional outlier (> q3 + 3 IQR), extreme (>= p99), customer spike (n >= 5 and above
    max(3 median, median + 3 std)), negative balance; weighted .40/.25/.25/.10 score,
    anomaly at >= .5, reason text."""
    reg = A.regional_benchmark(tx)
    cust = A.customer_benchmark(tx)
    # one row per location, sent to the facts if it is small; the facts move once, to their customers
    j = lookup(tx, reg, ["CustLocationNorm"]).join(cust, "CustomerID", "left")
    amt = F.col("TransactionAmount")
    f1 = amt > F.col("loc_q3") + 3.0 * F.col("loc_iqr")
    f2 = amt >= F.col("loc_p99")
    f3 = (F.col("cust_n") >= 5) & (amt > F.greatest(F.col("cust_median") * 3.0, F.col("cust_median") + 3.0 * F.col("cust_std")))
    f4 = F.col("CustAccountBalance") < 0
    j = j.withColumns({"flag_regional_outlier": F.coalesce(f1, F.lit(False)), "flag_extreme_high": F.coalesce(f2, F.lit(False)),
                       "flag_customer_spike": F.coalesce(f3, F.lit(False)), "flag_balance_stress": F.coalesce(f4, F.lit(False))})
    raw = (0.40 * F.col("flag_regional_outlier").cast("double") + 0.25 * F.col("flag_extreme_high").cast("double")
           + 0.25 * F.col("flag_customer_spike").cast("double") + 0.10 * F.col("flag_balance_stress").cast("double"))
    z = F.try_divide(F.abs(amt - F.col("cust_median")), F.nullif(F.col("cust_std"), F.lit(0.0)))
    return j.withColumns({
        "RegionalIqrDeviation": F.abs(amt - F.col("loc_median")) / F.col("loc_iqr"),
        "CustomerZLike": F.coalesce(z, F.lit(0.0)),
        "BehavioralAnomalyScore": F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)),
    }).withColumn("IsBehavioralAnomaly", F.col("BehavioralAnomalyScore") >= 0.5).withColumn(
        "BehavioralReason", X.reasons([
            (F.col("flag_regional_outlier"), "Regional benchmark outlier"),
            (F.col("flag_extreme_high"), "Extreme transaction amount (P99+)"),
            (F.col("flag_customer_spike"), "Spike vs customer historical behavior"),
            (F.col("flag_balance_stress"), "Negative account balance stress"),
        ], default="Within expected behavior"))


def regional_intelligence(cust: DataFrame) -> DataFrame:
    """Per location: customer count, balance total/mean/median, transaction value, vital
    share, mean RFM; potential score = .4/.3/.2/.1 blend of min-max scaled totals; high
    potential zone = score >= its 75th percentile."""
    med = R.group_quantiles(cust, ["CustLocationNorm"], "AvgAccountBalance", {"MedianAccountBalance": 0.5})
    reg = cust.groupBy("CustLocationNorm").agg(
        F.count("CustomerID").alias("Customers"),
        F.sum("AvgAccountBalance").alias("TotalAccountBalance"),
        F.avg("AvgAccountBalance").alias("AvgAccountBalance"),
        F.sum("Monetary").alias("TotalTransactionValue"),
        F.avg(F.col("IsVitalFew").cast("double")).alias("VitalFewShare"),
        F.avg("RFM_Consolidated").alias("AvgRfmConsolidated"),
    ).join(med, "CustLocationNorm", "left")
    parts = ["TotalAccountBalance", "TotalTransactionValue", "VitalFewShare", "AvgRfmConsolidated"]
    stats = reg.agg(*[F.min(c).alias(f"_mn_{c}") for c in parts], *[F.max(c).alias(f"_mx_{c}") for c in parts])
    reg = reg.crossJoin(F.broadcast(stats))  # one row of min/max
    from .windows import minmax
    score = (0.40 * minmax(parts[0], F.col(f"_mn_{parts[0]}"), F.col(f"_mx_{parts[0]}"))
             + 0.30 * minmax(parts[1], F.col(f"_mn_{parts[1]}"), F.col(f"_mx_{parts[1]}"))
             + 0.20 * minmax(parts[2], F.col(f"_mn_{parts[2]}"), F.col(f"_mx_{parts[2]}"))
             + 0.10 * minmax(parts[3], F.col(f"_mn_{parts[3]}"), F.col(f"_mx_{parts[3]}")))
    reg = reg.withColumn("PotentialScore", score).drop(*[f"_mn_{c}" for c in parts], *[f"_mx_{c}" for c in parts])
    thr = R.scalar_quantiles(reg, "PotentialScore", {"_zone": 0.75})
    return reg.crossJoin(F.broadcast(thr)).withColumn("HighPotentialZone", F.col("PotentialScore") >= F.col("_zone")).drop("_zone")


def cluster_profile(cust: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    return cust.groupBy(cluster_col).agg(
        F.count("CustomerID").alias("Customers"), F.avg("MedianAge").alias("MedianAge"), F.avg("Recency").alias("Recency"),
        F.avg("Frequency").alias("Frequency"), F.avg("Monetary").alias("Monetary"),
        F.avg("AvgAccountBalance").alias("AvgAccountBalance"), F.avg(F.col("IsVitalFew").cast("double")).alias("VitalFewShare"))


def persona_mapping(profile: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """Name the clusters of a k-row profile. With exactly 4 clusters: lowest activity,
    then oldest of the rest, then highest (frequency - .1 age), then the last; any other
    k gives ``Segment i``. Windows here run over the k-row profile only."""
    k = profile.agg(F.count(F.lit(1)).alias("_k"))
    p = profile.crossJoin(F.broadcast(k))
    c = F.col(cluster_col)
    w1 = Window.orderBy(F.col("Frequency"), F.col("Monetary"), c)
    p = p.withColumn("_r1", F.row_number().over(w1))
    rest1 = F.col("_r1") > 1
    w2 = Window.orderBy((~rest1).cast("int"), F.col("MedianAge").desc(), F.col("Monetary").desc(),
                        F.col("AvgAccountBalance").desc(), c)
    p = p.withColumn("_r2", F.row_number().over(w2))
    rest2 = rest1 & (F.col("_r2") > 1)
    w3 = Window.orderBy((~rest2).cast("int"), (F.col("Frequency") - 0.10 * F.col("MedianAge")).desc(), c)
    p = p.withColumn("_r3", F.row_number().over(w3))
    name = (F.when(F.col("_k") != 4, F.concat(F.lit("Segment "), c.cast("string")))
            .when(F.col("_r1") == 1, PERSONAS[0]).when(F.col("_r2") == 1, PERSONAS[1])
            .when(F.col("_r3") == 1, PERSONAS[2]).otherwise(PERSONAS[3]))
    return p.withColumn("Persona", name).drop("_k", "_r1", "_r2", "_r3")


def persona_pipeline(tx: DataFrame, k: int = 4, n_init: int = 20, seed: int = 42) -> DataFrame:
    """End to end: cleaned transactions (materialised once by ``prepare_transactions``)
    -> RFM and wealth layer -> k-means personas on standardised R/F/M -> per-customer
    behavioural anomaly counts -> the customer's regional potential; one row per
    customer. Customers meet by a join on their key; the k-row cluster table is broadcast and the
    regional table (one row per location) is a measured lookup."""
    from . import ml as M
    cust = rfm_wealth_layer(tx)
    z = M.standard_scale(cust, ["Recency", "Frequency", "Monetary"], suffix="_z")
    _, _, assigned = M.kmeans_best(z, ["Recency_z", "Frequency_z", "Monetary_z"], k=k, n_init=n_init, seed=seed)
    assigned = assigned.drop("Recency_z", "Frequency_z", "Monetary_z")
    prof = persona_mapping(cluster_profile(assigned))
    beh = behavioral_anomalies(tx).groupBy("CustomerID").agg(
        F.sum(F.col("IsBehavioralAnomaly").cast("int")).alias("BehavioralAnomalies"),
        F.max("BehavioralAnomalyScore").alias("MaxBehavioralScore"))
    reg = regional_intelligence(assigned).select("CustLocationNorm", "PotentialScore", "HighPotentialZone")
    out = (assigned.join(F.broadcast(prof.select("Cluster", "Persona")), "Cluster")
           .join(beh, "CustomerID", "left"))
    out = lookup(out, reg, ["CustLocationNorm"])
    return out.select("CustomerID", "Cluster", "Persona", "Recency", "Frequency", "Monetary", "RFM_Score", "WealthValue",
                      "IsVitalFew", "CustLocationNorm", "PotentialScore", "HighPotentialZone",
                      F.coalesce("BehavioralAnomalies", F.lit(0)).alias("BehavioralAnomalies"), "MaxBehavioralScore")
