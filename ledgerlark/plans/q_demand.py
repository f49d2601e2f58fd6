"""Credit demand by grade for every region at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import sql_rnd
from ..operators import demand as D
from ..sources.domain import Tables, region_grade
from . import sql_series as Q
from .registry import query
from .sql_views import with_views as V

K = ["portfolio"]
HORIZON, CONF, BASE = 6, 0.8, 4.5
_GR = ", ".join(f"('{g}')" for g in D.GRADES)
_FB = ", ".join(f"('{g}', {s!r})" for g, s in D.FALLBACK_SHARES.items())


def _hist_sql(min_months: int = 12) -> list[str]:
    return [
        "h_s AS (SELECT portfolio, grade, month_start, sum(value) AS v FROM region_grade GROUP BY portfolio, grade, month_start)",
        "h_m AS (SELECT DISTINCT portfolio, month_start FROM region_grade)",
        f"""h_all AS (
  SELECT m.portfolio, g.grade, m.month_start, coalesce(s.v, 0.0) AS value,
         row_number() OVER (PARTITION BY m.portfolio, g.grade ORDER BY m.month_start) - 1 AS idx,
         count(*) OVER (PARTITION BY m.portfolio, g.grade) AS n
  FROM h_m m CROSS JOIN (VALUES {_GR}) g(grade)
  LEFT JOIN h_s s ON s.portfolio = m.portfolio AND s.grade = g.grade AND s.month_start = m.month_start)""",
        f"hist AS (SELECT * FROM h_all WHERE n >= {min_months})",
    ]


def _total_sql(base: float | None) -> list[str]:
    val = "value" if base is None else (
        f"CASE WHEN month_start = max(month_start) OVER (PARTITION BY portfolio) THEN {float(base)!r} ELSE value END")
    return [f"tot0 AS (SELECT portfolio, month_start, sum(value) AS value FROM hist GROUP BY portfolio, month_start)",
            f"tot AS (SELECT portfolio, month_start, {val} AS value FROM tot0)"]


def _forecast_sql(horizon: int, confidence: float, scenario: str, base: float | None) -> list[str]:
    m = D.SCENARIO_MULT.get(scenario, 1.0)
    z = D.confidence_z(confidence)
    floor_ = f"pow({m!r}, k - 1)" if m >= 1 else "1.0"
    hi = "hi * 1.15" if scenario == "optimistic" else "hi"
    lo = "lo * 0.85" if scenario == "pessimistic" else "lo"
    ctes = _hist_sql() + _total_sql(base) + Q.uncertainty("tot", K, horizon, "tg")
    ctes += [
        f"""lg AS (SELECT portfolio, grade, arg_max(value, month_start) AS gl, any_value(n) AS n FROM hist GROUP BY portfolio, grade)""",
        f"""lw AS (SELECT l.*, sum(greatest(gl, 0.0)) OVER (PARTITION BY portfolio) AS sl, fb.share FROM lg l
         LEFT JOIN (VALUES {_FB}) fb(grade, share) ON fb.grade = l.grade)""",
        f"""lw2 AS (SELECT *, CASE WHEN sl > 1e-6 THEN greatest(gl, 0.0) / sl ELSE coalesce(share, 0.0) END AS w FROM lw)""",
        f"""ta AS (SELECT t.portfolio, t.step, t.month_start, t.forecast_central AS c, l.tl,
                 coalesce(max(CASE WHEN t.forecast_central > 0 THEN t.step END) OVER (PARTITION BY t.portfolio ORDER BY t.step
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS a,
                 coalesce(last_value(CASE WHEN t.forecast_central > 0 THEN t.forecast_central END IGNORE NULLS) OVER (
                          PARTITION BY t.portfolio ORDER BY t.step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                          l.tl / {m!r}) AS e
          FROM tg t JOIN (SELECT portfolio, any_value(sl) AS tl FROM lw GROUP BY portfolio) l ON l.portfolio = t.portfolio)""",
        f"""te AS (SELECT *, CAST(step - a AS DOUBLE) AS k FROM ta)""",
        f"""tf AS (SELECT portfolio, step, month_start, CASE WHEN c > 0 THEN c ELSE greatest(pow({m!r}, k) * e, {floor_}) END AS eff FROM te)""",
        f"""fc AS (SELECT t.portfolio, w.grade, t.step, t.month_start, t.eff * w.w AS bc, t.eff * w.w * {m!r} AS ac,
                 w.n + t.step - 1 AS idx FROM tf t JOIN lw2 w ON w.portfolio = t.portfolio)""",
        """sq AS (SELECT portfolio, grade, idx, value AS x FROM hist UNION ALL SELECT portfolio, grade, idx, ac AS x FROM fc)""",
        """sd0 AS (SELECT *, x - lag(x) OVER (PARTITION BY portfolio, grade ORDER BY idx) AS d FROM sq)""",
        """sd AS (SELECT portfolio, grade, idx, coalesce(stddev_pop(d) OVER (PARTITION BY portfolio, grade ORDER BY idx
                 ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING), 0.0) AS s FROM sd0)""",
        f"""b0 AS (SELECT f.*, greatest(sd.s, 0.04 * greatest(abs(f.bc), 1.0)) * sqrt(CAST(f.step AS DOUBLE)) AS sp
          FROM fc f JOIN sd ON sd.portfolio = f.portfolio AND sd.grade = f.grade AND sd.idx = f.idx)""",
        f"""b1 AS (SELECT *, greatest(0.0, bc - {z!r} * sp) AS lo FROM b0)""",
        f"""b2 AS (SELECT *, greatest(lo, bc + {z!r} * sp) AS hi FROM b1)""",
        f"""dfc AS (SELECT portfolio, grade, step, month_start, {sql_rnd(f'greatest(0.0, ac)', 2)} AS forecast_central,
                  {sql_rnd(f'greatest(0.0, {lo})', 2)} AS forecast_lower,
                  {sql_rnd(f'greatest(greatest(0.0, {lo}), {hi})', 2)} AS forecast_upper, bc AS baseline_central FROM b2)""",
    ]
    return ctes


def _region_grade(spark, d):
    return region_grade(Tables(spark, d))


@query("total_target", Q.chain(V("region_grade"), _hist_sql(), _total_sql(BASE), Q.uncertainty("tot", K, HORIZON, "tg"))
       + "SELECT * FROM tg")
def q_total_target(spark, d):
    """Total demand forecast per region with the last actual overridden by a base volume."""
    return D.total_target(D.grade_history(_region_grade(spark, d), K).filter(F.col("n") >= 12), K, HORIZON, BASE)


@query("grade_share", V("region_grade") + f"""
, w AS (SELECT portfolio, grade, value, loan_count,
               row_number() OVER (PARTITION BY portfolio, grade ORDER BY month_start) - 1 AS i,
               lag(value) OVER (PARTITION BY portfolio, grade ORDER BY month_start) AS lag_1,
               avg(value) OVER (PARTITION BY portfolio, grade ORDER BY month_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_3,
               avg(value) OVER (PARTITION BY portfolio, grade ORDER BY month_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS rolling_6
        FROM region_grade)
, sc AS (SELECT portfolio, grade, greatest(coalesce(avg(lag_1), 0.0), 0.0) + greatest(coalesce(avg(rolling_3), 0.0), 0.0)
                + greatest(coalesce(avg(rolling_6), 0.0), 0.0) + greatest(coalesce(avg(loan_count), 0.0), 0.0) AS s
         FROM w WHERE i >= 12 GROUP BY portfolio, grade)
, pg AS (SELECT p.portfolio, g.grade, fb.fb FROM (SELECT DISTINCT portfolio FROM region_grade) p CROSS JOIN (VALUES {_GR}) g(grade)
         JOIN (VALUES {_FB}) fb(grade, fb) ON fb.grade = g.grade)
, j AS (SELECT pg.*, CASE WHEN sc.s > 0 THEN sc.s ELSE 0.0 END AS pos FROM pg
        LEFT JOIN sc ON sc.portfolio = pg.portfolio AND sc.grade = pg.grade)
, t AS (SELECT *, sum(pos) OVER (PARTITION BY portfolio) AS tot FROM j)
SELECT portfolio, grade, {sql_rnd('CASE WHEN tot > 0 THEN pos / tot ELSE fb END', 9)} AS share FROM t""")
def q_grade_share(spark, d):
    s = D.grade_share(_region_grade(spark, d), K)
    return s.withColumn("share", X.rnd(F.col("share"), 9))


@query("demand_forecast_by_grade", Q.chain(V("region_grade"), _forecast_sql(HORIZON, CONF, "optimistic", None))
       + "SELECT portfolio, grade, step, month_start, forecast_central, forecast_lower, forecast_upper FROM dfc")
def q_demand_forecast_by_grade(spark, d):
    """Optimistic 6-month demand by grade for every region (statistical path, 80 % band)."""
    f = D.demand_forecast(_region_grade(spark, d), K, HORIZON, CONF, "optimistic")
    return f.drop("baseline_central")


@query("demand_totals", Q.chain(V("region_grade"), _forecast_sql(HORIZON, CONF, "pessimistic", None)) + f"""
SELECT portfolio, {sql_rnd('sum(forecast_central)', 2)} AS total_forecast, {sql_rnd('sum(baseline_central)', 2)} AS baseline_total,
       {sql_rnd('sum(baseline_central) * 1.15', 2)} AS optimistic_total, {sql_rnd('sum(baseline_central) * 0.85', 2)} AS pessimistic_total
FROM dfc GROUP BY portfolio""")
def q_demand_totals(spark, d):
    """Selected (pessimistic) and scenario totals per region."""
    return D.demand_totals(D.demand_forecast(_region_grade(spark, d), K, HORIZON, CONF, "pessimistic"), K)


@query("grade_backtest")
def q_grade_backtest(spark, d):
    """One-step back-test of the per-grade linear model over the last 18 months, per region."""
    return D.grade_backtest(_region_grade(spark, d), K)
