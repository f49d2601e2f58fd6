"""DuckDB twins of the forecasting operators, generated for any key list.

Each generator returns a list of CTE definitions (``name AS (...)``) reading a source
CTE with ``keys + month_start + value`` and ending in the CTE named ``out``.
"""

from __future__ import annotations

import math

from ..functions.expr import sql_rnd


def _k(keys, alias=None):
    return ", ".join(f"{alias}.{k}" if alias else k for k in keys)


def _on(keys, a, b):
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


def filled(src: str, keys: list[str], out: str) -> list[str]:
    p = f"PARTITION BY {_k(keys)} ORDER BY month_start"
    return [f"""{out} AS (
  SELECT *, coalesce(last_value(value IGNORE NULLS) OVER ({p} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     first_value(value IGNORE NULLS) OVER ({p} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v,
         row_number() OVER ({p}) - 1 AS idx, count(*) OVER (PARTITION BY {_k(keys)}) AS n
  FROM {src})"""]


def baseline(src: str, keys: list[str], horizon: int, out: str, alpha: float = 0.35) -> list[str]:
    f = f"{out}_f"
    ctes = filled(src, keys, f)
    ctes.append(f"""{out}_s AS (
  SELECT {_k(keys)}, max(month_start) AS last_month, arg_max(v, month_start) AS naive_last, any_value(n) AS n_,
         avg(CASE WHEN rd <= 3 THEN v END) AS ma3,
         sum({alpha!r} * v * pow({1 - alpha!r}, n - 1 - idx)) AS es_sum
  FROM (SELECT *, row_number() OVER (PARTITION BY {_k(keys)} ORDER BY month_start DESC) AS rd FROM {f}) t
  GROUP BY {_k(keys)})""")
    ctes.append(f"""{out} AS (
  SELECT {_k(keys, 's')}, st.step, CAST(s.last_month + to_months(st.step) AS DATE) AS month_start, s.naive_last,
         CASE WHEN s.n_ >= 3 THEN s.ma3 ELSE s.naive_last END AS moving_avg_3,
         s.es_sum + pow({1 - alpha!r}, s.n_) * s.naive_last AS exp_smoothing
  FROM {out}_s s CROSS JOIN (SELECT CAST(range AS INTEGER) AS step FROM range(1, {horizon + 1})) st)""")
    return ctes


def uncertainty(src: str, keys: list[str], horizon: int, out: str, z: float = 1.28, digits: int | None = 2) -> list[str]:
    f = f"{out}_f"
    ctes = filled(src, keys, f)
    tail = "idx >= n - least(12, greatest(3, n))"
    ctes.append(f"""{out}_d AS (
  SELECT *, v - lag(v) OVER (PARTITION BY {_k(keys)} ORDER BY month_start) AS diff FROM {f})""")
    ctes.append(f"""{out}_s AS (
  SELECT {_k(keys)}, max(month_start) AS last_month, arg_max(v, month_start) AS base, any_value(n) AS n_, avg(v) AS gmean,
         coalesce(regr_slope(CASE WHEN {tail} THEN v END, CASE WHEN {tail} THEN CAST(idx AS DOUBLE) END), 0.0) AS slope,
         stddev_pop(diff) AS sd
  FROM {out}_d GROUP BY {_k(keys)})""")
    noise = "(CASE WHEN n_ > 2 THEN sd ELSE 0.0 END)"
    ctes.append(f"""{out}_n AS (
  SELECT *, CASE WHEN {noise} < 1.0 THEN greatest(5.0, 0.03 * greatest(gmean, 1.0)) ELSE {noise} END AS noise FROM {out}_s)""")
    ctes.append(f"""{out}_p AS (
  SELECT {_k(keys)}, month(month_start) AS cm, avg(value) AS pmean FROM {src} GROUP BY {_k(keys)}, month(month_start))""")
    ctes.append(f"""{out}_c AS (
  SELECT {_k(keys, 's')}, st.step, CAST(s.last_month + to_months(st.step) AS DATE) AS month_start,
         greatest(0.0, (s.base + s.slope * st.step) * (coalesce(p.pmean, s.gmean) / greatest(s.gmean, 1e-6))) AS c,
         s.noise * sqrt(CAST(st.step AS DOUBLE)) AS sp
  FROM {out}_n s CROSS JOIN (SELECT CAST(range AS INTEGER) AS step FROM range(1, {horizon + 1})) st
  LEFT JOIN {out}_p p ON {_on(keys, 'p', 's')} AND p.cm = month(CAST(s.last_month + to_months(st.step) AS DATE)))""")

    def r(e):
        return sql_rnd(e, digits) if digits is not None else e
    low = f"greatest(0.0, c - {z!r} * sp)"
    ctes.append(f"""{out} AS (
  SELECT {_k(keys)}, step, month_start, {r('c')} AS forecast_central, {r(low)} AS forecast_lower,
         {r(f'greatest({low}, c + {z!r} * sp)')} AS forecast_upper
  FROM {out}_c)""")
    return ctes


def mad_outliers(src: str, keys: list[str], out: str, last: int = 8, limit: float = 3.5) -> list[str]:
    f = f"{out}_f"
    ctes = filled(src, keys, f)
    tail = f"idx >= n - {last}"
    ctes.append(f"""{out}_m AS (SELECT {_k(keys)}, median(v) AS med FROM {f} WHERE {tail} AND n >= {last} GROUP BY {_k(keys)})""")
    ctes.append(f"""{out}_a AS (
  SELECT {_k(keys, 'f')}, median(abs(f.v - m.med)) AS mad FROM {f} f JOIN {out}_m m ON {_on(keys, 'f', 'm')}
  WHERE f.{tail} GROUP BY {_k(keys, 'f')})""")
    isout = f"(f.{tail} AND m.med IS NOT NULL AND abs((f.v - m.med) / (a.mad + 1e-6)) > {limit})"
    ctes.append(f"""{out} AS (
  SELECT f.*, coalesce({isout}, false) AS is_outlier,
         CASE WHEN coalesce({isout}, false) THEN m.med ELSE f.value END AS cleaned_value
  FROM {f} f LEFT JOIN {out}_m m ON {_on(keys, 'f', 'm')} LEFT JOIN {out}_a a ON {_on(keys, 'f', 'a')})""")
    return ctes


def scenario(src: str, keys: list[str], horizon: int, out: str, growth: float = 0.0, remove_outlier: bool = False,
             mode: str = "baseline") -> list[str]:
    ctes = []
    base = src
    if remove_outlier:
        ctes += mad_outliers(src, keys, f"{out}_o")
        ctes.append(f"{out}_b AS (SELECT {_k(keys)}, month_start, cleaned_value AS value FROM {out}_o)")
        base = f"{out}_b"
    ctes += uncertainty(base, keys, horizon, f"{out}_u")
    mult = 1.0 + growth / 100.0
    ctes.append(f"""{out}_g AS (
  SELECT {_k(keys)}, step, month_start, greatest(forecast_central * {mult!r}, 0.0) AS c,
         greatest(forecast_lower * {mult!r}, 0.0) AS lo, greatest(forecast_upper * {mult!r}, 0.0) AS hi FROM {out}_u)""")
    if mode == "flat":
        first = f"first_value(c) OVER (PARTITION BY {_k(keys)} ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        ctes.append(f"""{out}_m AS (SELECT {_k(keys)}, step, month_start, {first} AS c FROM {out}_g)""")
        ctes.append(f"""{out}_m2 AS (SELECT *, greatest(c * 0.92, 0.0) AS lo FROM {out}_m)""")
        ctes.append(f"""{out}_m3 AS (SELECT *, greatest(lo, c * 1.08) AS hi FROM {out}_m2)""")
        last = f"{out}_m3"
    elif mode == "seasonal_plus" and horizon > 1:
        boost = f"(1.0 + 0.04 * sin(step * 2 * {math.pi!r} / {max(horizon, 2)}))"
        ctes.append(f"""{out}_m3 AS (
  SELECT {_k(keys)}, step, month_start, greatest(c * {boost}, 0.0) AS c, greatest(lo * {boost}, 0.0) AS lo,
         greatest(hi * {boost}, 0.0) AS hi FROM {out}_g)""")
        last = f"{out}_m3"
    else:
        last = f"{out}_g"
    ctes.append(f"""{out} AS (
  SELECT {_k(keys)}, step, month_start, {sql_rnd('c', 2)} AS forecast_central, {sql_rnd('lo', 2)} AS forecast_lower,
         {sql_rnd('hi', 2)} AS forecast_upper FROM {last})""")
    return ctes


def ape(y: str, p: str) -> str:
    return f"abs(({y} - {p}) / greatest(abs({y}), 1e-6)) * 100"


def baseline_backtest(src: str, keys: list[str], out: str, holdout: int = 4) -> list[str]:
    ctes = [f"""{out}_i AS (
  SELECT *, row_number() OVER (PARTITION BY {_k(keys)} ORDER BY month_start) - 1 AS idx,
         count(*) OVER (PARTITION BY {_k(keys)}) AS n FROM {src})""",
            f"""{out}_h AS (SELECT *, greatest(1, least({holdout}, greatest(1, n - 4))) AS h FROM {out}_i)""",
            f"""{out}_tr AS (SELECT {_k(keys)}, month_start, value FROM {out}_h WHERE idx < n - h)""",
            f"""{out}_te AS (SELECT {_k(keys)}, month_start, value AS y FROM {out}_h WHERE idx >= n - h)"""]
    ctes += baseline(f"{out}_tr", keys, holdout, f"{out}_bf")
    ctes += uncertainty(f"{out}_tr", keys, holdout, f"{out}_fu")
    ctes.append(f"""{out}_j AS (
  SELECT {_k(keys, 't')}, t.y, b.naive_last, b.moving_avg_3, b.exp_smoothing, u.forecast_central
  FROM {out}_te t LEFT JOIN {out}_bf b ON {_on(keys, 't', 'b')} AND t.month_start = b.month_start
  LEFT JOIN {out}_fu u ON {_on(keys, 't', 'u')} AND t.month_start = u.month_start)""")
    models = [("Naive (last value)", "naive_last"), ("Moving Average (3)", "moving_avg_3"),
              ("Exp Smoothing", "exp_smoothing"), ("Trend-Seasonal Forecast", "forecast_central")]
    union = " UNION ALL ".join(f"SELECT {_k(keys)}, '{m}' AS model, {ape('y', c)} AS e FROM {out}_j" for m, c in models)
    ctes.append(f"""{out} AS (
  SELECT {_k(keys)}, model, {sql_rnd('avg(e)', 2)} AS mape FROM ({union}) u GROUP BY {_k(keys)}, model)""")
    return ctes


def rolling_backtest(src: str, keys: list[str], out: str, max_horizon: int = 6, min_rows: int = 14) -> list[str]:
    max_h = max(1, min(int(max_horizon), 6))
    ks = keys + ["split"]
    ctes = [f"""{out}_i AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_k(keys)} ORDER BY month_start) - 1 AS idx,
         count(*) OVER (PARTITION BY {_k(keys)}) AS n FROM {src}) t WHERE n >= {min_rows})""",
            f"""{out}_sp AS (
  SELECT {_k(keys)}, n, unnest(generate_series(greatest(8, n - 24), n - 1)) AS split
  FROM (SELECT DISTINCT {_k(keys)}, n FROM {out}_i) d)""",
            f"""{out}_tr AS (
  SELECT {_k(keys, 'i')}, s.split, i.month_start, i.value FROM {out}_i i JOIN {out}_sp s ON {_on(keys, 'i', 's')}
  WHERE i.idx < s.split)"""]
    ctes += uncertainty(f"{out}_tr", ks, max_h, f"{out}_fc")
    ctes.append(f"""{out}_te AS (
  SELECT {_k(keys, 's')}, s.split, hz.h, i.idx, i.month_start, i.value AS y
  FROM {out}_sp s CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(1, {max_h + 1})) hz
  JOIN {out}_i i ON {_on(keys, 's', 'i')}
  WHERE s.split <= s.n - hz.h AND i.idx >= s.split AND i.idx < s.split + hz.h)""")
    ctes.append(f"""{out}_m AS (
  SELECT t.*, f.forecast_central, f.forecast_lower, f.forecast_upper
  FROM {out}_te t LEFT JOIN {out}_fc f ON {_on(ks, 't', 'f')} AND f.step <= t.h AND f.month_start = t.month_start)""")
    ctes.append(f"""{out}_ps AS (
  SELECT {_k(keys)}, h, split, count(*) AS rws, count(forecast_central) AS hit, count(y) AS ny,
         avg({ape('y', 'forecast_central')}) AS m,
         avg(CAST(y >= forecast_lower AND y <= forecast_upper AS DOUBLE) * 100) AS cov
  FROM {out}_m GROUP BY {_k(keys)}, h, split)""")
    ctes.append(f"""{out} AS (
  SELECT {_k(keys)}, h AS horizon, {sql_rnd('avg(m)', 2)} AS mape, {sql_rnd('avg(cov)', 2)} AS coverage
  FROM {out}_ps WHERE hit = rws AND ny = rws GROUP BY {_k(keys)}, h)""")
    return ctes


def chain(head: str, *groups: list[str]) -> str:
    """Append CTE groups to a ``WITH ...`` head produced by ``with_views``."""
    parts = [c for g in groups for c in g]
    return head.rstrip() + ",\n" + ",\n".join(parts) + "\n"
