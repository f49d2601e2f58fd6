"""Driver contract: entry() runs, every query has a callable, oracles are a subset."""

import duckdb

import __spark_entry__ as E
from ledgerlark.sources.tables import TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "funded_amnt_m" in df.columns


def test_oracles_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_flagship_matches_oracle(spark, sf):
    q, o = E.queries(), E.oracle_sql()
    for key in ["monthly_volume", "grade_pivot", "rfm_scores", "forecast_uncertainty", "eval_classification"]:
        got = sorted(tuple(r) for r in q[key](spark, sf).select(*sorted(q[key](spark, sf).columns)).collect())
        res = _duck(sf).execute(o[key])
        cols = [d[0] for d in res.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        exp = sorted(tuple(r[i] for i in order) for r in res.fetchall())
        assert len(got) == len(exp), key
        for a, b in zip(got, exp):
            for x, y in zip(a, b):
                if isinstance(x, float) and isinstance(y, float):
                    assert abs(x - y) <= 1e-9 * max(1.0, abs(y)), key
                else:
                    assert x == y, key
