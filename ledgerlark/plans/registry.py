"""Query registry: ``key -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``.

Each module under ``plans`` registers its queries with :func:`query`; the entry point
(`__spark_entry__.py`) exposes the collected dicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    import importlib

    for name in PLAN_MODULES:
        importlib.import_module(f"{__package__}.{name}")


PLAN_MODULES = ["q_clean", "q_risk", "q_series", "q_windows", "q_segment", "q_aggregate", "q_ml", "q_stream", "q_io", "q_demand"]
