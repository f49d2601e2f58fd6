"""Window operators over long many-series tables ``(series_id, month_start, value)``.

Series windows partition by ``series_id``: a monthly series has one row per month, so
a partition holds at most a few hundred rows however large the source tables are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import stable
from .ranking import global_row_number

SID, T, V = "series_id", "month_start", "value"


def _w(sid: str = SID, t: str = T) -> Window:
    return Window.partitionBy(sid).orderBy(t)


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, id_col: str, out: str = "frequency") -> DataFrame:
    """Rows of the same ``key`` with time in ``[ts - seconds, ts]`` (inclusive, ties
    counted), like ``count(*) OVER (PARTITION BY key ORDER BY ts RANGE ... PRECEDING)``.

    Linear and skew-safe: the answer is the number of the key's rows up to ``ts`` less the
    number before ``ts - seconds``. Both are read off one running count over all distinct
    (key, time) points, which range partitions spread whatever the key; rows are counted per
    point first. Rows without a time count the key's rows without a time.
    """
    span = seconds * 1_000_000
    base = df.withColumn("_tc_us", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = base.select(F.col(key).alias("_tc_key"), F.col("_tc_us").alias("_tc_p"), F.lit(1).alias("_tc_c"))
    probes = rows.select("_tc_key", (F.col("_tc_p") - span - 1).alias("_tc_p"), F.lit(0).alias("_tc_c")).filter("_tc_p is not null")
    points = rows.union(probes).groupBy("_tc_key", "_tc_p").agg(F.sum("_tc_c").alias("_tc_c"))
    run = global_row_number(points, [F.col("_tc_key"), F.col("_tc_p")], out="_tc_n", sum_col="_tc_c", cum_out="_tc_upto")
    run = stable(run.select("_tc_key", "_tc_p", "_tc_c", "_tc_upto"), "trailing_count")
    now = run.filter("_tc_c > 0").select(F.col("_tc_key").alias("_tc_k1"), F.col("_tc_p").alias("_tc_p1"), "_tc_c", "_tc_upto")
    past = run.select(F.col("_tc_key").alias("_tc_k2"), F.col("_tc_p").alias("_tc_p2"), F.col("_tc_upto").alias("_tc_before"))
    seen = now.join(past, F.col("_tc_k1").eqNullSafe(F.col("_tc_k2")) & (F.col("_tc_p1") - span - 1 == F.col("_tc_p2")), "left")
    seen = seen.select("_tc_k1", "_tc_p1", F.coalesce(F.col("_tc_upto") - F.col("_tc_before"), F.col("_tc_c")).cast("int").alias(out))
    hit = base[key].eqNullSafe(seen["_tc_k1"]) & base["_tc_us"].eqNullSafe(seen["_tc_p1"])
    return base.join(seen, hit).drop("_tc_us", "_tc_k1", "_tc_p1")


def ffill_bfill(df: DataFrame, value: str = V, sid: str = SID, t: str = T, out: str | None = None) -> DataFrame:
    """Forward fill, then backward fill for a leading gap."""
    w = _w(sid, t)
    fwd = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    bwd = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out or value, F.coalesce(fwd, bwd))


def lag_features(df: DataFrame, lags=(1, 2, 3, 6, 12), value: str = V, sid: str = SID, t: str = T) -> DataFrame:
    """Row-based lags (gaps in the calendar are not filled, as in the reference)."""
    w = _w(sid, t)
    return df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})


def rolling_shifted_mean(df: DataFrame, windows=(3, 6, 12), value: str = V, sid: str = SID, t: str = T) -> DataFrame:
    """Mean of the previous k rows (excluding the current), NULL until k rows exist."""
    w = _w(sid, t)
    cols = {}
    for k in windows:
        frame = w.rowsBetween(-k, -1)
        cols[f"rolling_mean_{k}"] = F.when(F.count(value).over(frame) == k, F.avg(value).over(frame))
    return df.withColumns(cols)


def mom_growth(df: DataFrame, value: str = V, sid: str = SID, t: str = T, out: str = "mom_growth",
               shift: int = 0) -> DataFrame:
    """``pct_change``: value / previous (forward-filled) value - 1. Division by zero gives
    NULL instead of inf. ``shift=1`` uses the previous month's growth (no target leak)."""
    w = _w(sid, t)
    prev = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cur = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    g = F.try_divide(cur, F.when(prev != 0, prev)) - 1
    df = df.withColumn(out, g)
    if shift:
        df = df.withColumn(out, F.lag(out, shift).over(w))
    return df


def calendar_features(df: DataFrame, t: str = T) -> DataFrame:
    return df.withColumns({"month": F.month(t), "quarter": F.quarter(t), "year": F.year(t)})


def training_frame(df: DataFrame, value: str = V, sid: str = SID, t: str = T) -> DataFrame:
    """Calendar + lags + shifted rolling means + growth; rows with any NULL feature dropped."""
    out = calendar_features(df, t)
    out = lag_features(out, value=value, sid=sid, t=t)
    out = rolling_shifted_mean(out, value=value, sid=sid, t=t)
    out = mom_growth(out, value=value, sid=sid, t=t, shift=1)
    return out.dropna()


def rolling_band_anomalies(df: DataFrame, window: int = 6, z_limit: float = 1.8, value: str = V, sid: str = SID,
                           t: str = T, last_n: int = 8) -> DataFrame:
    """Trailing band (window incl. current row, min periods max(3, window//2)),
    mean +- z * sample std (std of one value -> 0); Spike/Dip rows, last ``last_n``."""
    filled = ffill_bfill(df, value, sid, t, out="_v")
    w = _w(sid, t)
    frame = w.rowsBetween(-(window - 1), 0)
    minp = max(3, window // 2)
    cnt = F.count("_v").over(frame)
    mean = F.when(cnt >= minp, F.avg("_v").over(frame))
    std = F.coalesce(F.when(cnt >= minp, F.stddev_samp("_v").over(frame)), F.lit(0.0))
    banded = filled.withColumns({"_mean": mean, "_std": std}).withColumns({
        "upper": F.col("_mean") + z_limit * F.col("_std"),
        "lower": F.col("_mean") - z_limit * F.col("_std"),
    })
    flagged = banded.withColumn(
        "direction", F.when(F.col("_v") > F.col("upper"), "Spike").when(F.col("_v") < F.col("lower"), "Dip"))
    anomalies = flagged.filter(F.col("direction").isNotNull())
    rn = F.row_number().over(Window.partitionBy(sid).orderBy(F.col(t).desc()))
    return anomalies.withColumn("_rn", rn).filter(F.col("_rn") <= last_n).select(
        sid, t, X.rnd(F.col("_v"), 2).alias(value), "lower", "upper", "direction")


def series_tail(df: DataFrame, k: int, sid: str = SID, t: str = T) -> DataFrame:
    """Last k rows per series."""
    rn = F.row_number().over(Window.partitionBy(sid).orderBy(F.col(t).desc()))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def diff_volatility(df: DataFrame, tail: int | None = 12, value: str = V, sid: str = SID, t: str = T) -> DataFrame:
    """Population std of first differences over the last ``tail`` rows (all if None)."""
    base = series_tail(df, tail, sid, t) if tail else df
    d = base.withColumn("_d", F.col(value) - F.lag(value, 1).over(_w(sid, t)))
    return d.groupBy(sid).agg(F.stddev_pop("_d").alias("diff_std"))


def minmax(c: str, lo: Column, hi: Column) -> Column:
    """(x - min) / (max - min); a flat column (range < 1e-12) scores 1."""
    return F.when((hi - lo) < 1e-12, F.lit(1.0)).otherwise((F.col(c) - lo) / (hi - lo))


def minmax_normalize(df: DataFrame, cols: list[str], suffix: str = "_norm") -> DataFrame:
    """Min-max scale each column; min/max come from one aggregate row joined by broadcast."""
    stats = df.agg(*[F.min(c).alias(f"_mn_{c}") for c in cols], *[F.max(c).alias(f"_mx_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(stats))
    return j.withColumns({f"{c}{suffix}": minmax(c, F.col(f"_mn_{c}"), F.col(f"_mx_{c}")) for c in cols}).drop(
        *[f"_mn_{c}" for c in cols], *[f"_mx_{c}" for c in cols])
