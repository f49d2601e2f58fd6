"""Streaming queries: each lands table-derived rows in a folder, runs the
stream to completion and returns the sink contents; checked against the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as N
from ..sources.domain import Tables, deposits
from ..streaming import jobs as J
from .q_ml import _THR_SQL
from .registry import query


@query("stream_deposit_scan", _THR_SQL + "SELECT deposit_id, flag_amount, flag_hour, flag_frequency, rule_reasons FROM rs")
def q_stream_deposit_scan(spark, d):
    """Arriving deposits scored by the rule flags; equals the batch ``deposit_rule_flags``."""
    dep = deposits(Tables(spark, d))
    hist = dep  # thresholds learned from the deposit history
    thr = N.thresholds(hist)
    landing = J.land(dep, "deposits", files=8, order="ts")
    return J.deposit_scan(spark, landing, spark.read.parquet(landing).schema, thr)


_CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query("stream_hourly_trend", f"""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_value
FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED}""")
def q_stream_hourly_trend(spark, d):
    ev = Tables(spark, d).events
    landing = J.land(ev, "events", files=8, order="ts")
    out = J.hourly_trend(spark, landing, spark.read.parquet(landing).schema)
    return J.closed_before(out, ev)


@query("stream_frequency_24h", f"""
WITH w AS (SELECT user_id, date_trunc('hour', ts) - to_hours(CAST(k AS BIGINT)) AS window_start FROM events CROSS JOIN range(0, 24) r(k))
SELECT user_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS deposits FROM w
GROUP BY user_id, window_start HAVING window_start + INTERVAL 24 HOUR <= {_CLOSED}""")
def q_stream_frequency_24h(spark, d):
    ev = Tables(spark, d).events
    landing = J.land(ev, "events24", files=8, order="ts", file_rows=J.FILE_ROWS)
    landed = spark.read.parquet(landing)
    # a quarter of the files at a time, two of eight: each micro-batch writes all windows that are still open once more
    out = J.frequency_24h(spark, landing, landed.schema, files_per_trigger=max(J.FILES_PER_TRIGGER, -(-len(landed.inputFiles()) // 4)))
    return J.closed_before(out, ev)


@query("stream_hourly_score", _THR_SQL + """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS events,
       sum(CAST(flag_amount AS INTEGER) + CAST(flag_hour AS INTEGER) + CAST(flag_frequency AS INTEGER)) / (3.0 * count(*)) AS avg_score
FROM rs GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM deposits)""")
def q_stream_hourly_score(spark, d):
    """Mean rule score by event hour of the arriving deposits."""
    dep = deposits(Tables(spark, d))
    landing = J.land(dep, "deposits_hourly", files=8, order="ts")
    landed = spark.read.parquet(landing)
    out = J.hourly_score(spark, landing, landed.schema, N.thresholds(landed))
    return J.closed_before(out, landed)


@query("stream_trailing_frequency", """
WITH f AS (SELECT event_id AS deposit_id, ts, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS INTEGER) AS frequency
           FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT deposit_id, frequency FROM f WHERE ts < (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def q_stream_trailing_frequency(spark, d):
    """The 24 h deposit count of every arriving deposit, kept up by state and timers; equals the batch ``frequency``
    of the deposits that the stream's last watermark has passed."""
    ev = Tables(spark, d).events.select(F.col("event_id").alias("deposit_id"), "user_id", "ts")
    landing = J.land(ev, "trailing", files=8, order="ts")
    out = J.trailing_frequency(spark, landing, spark.read.parquet(landing).schema)
    closed = ev.crossJoin(F.broadcast(ev.agg((F.max("ts") - F.expr("INTERVAL 2 HOURS")).alias("_wm")))).filter("ts < _wm")
    return out.join(closed.select("deposit_id"), "deposit_id")
