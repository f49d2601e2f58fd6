"""Explanations: feature importance tables, per-row impacts and contribution waterfalls.

A row's features are an array of structs beside the (one row per feature) broadcast means and
importances, so per-row top-k and running sums need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def long_form(df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    st = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    return df.select(id_col, F.expr(f"stack({len(features)}, {st}) AS (feature, value)"))


def correlation_importance(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Model-free importance: |corr(feature, label)| normalised to sum 1 (all zero ->
    uniform). Used where a SQL-checkable stand-in for model importances is needed."""
    row = df.agg(*[F.coalesce(F.abs(F.corr(F.col(f).cast("double"), F.col(label).cast("double"))), F.lit(0.0)).alias(f)
                   for f in features])
    lf = long_form(row.withColumn("_one", F.lit(1)), "_one", features).select("feature", F.col("value").alias("raw"))
    tot = lf.agg(F.sum("raw").alias("_t"), F.count(F.lit(1)).alias("_k"))
    j = lf.crossJoin(F.broadcast(tot))
    return j.select("feature", F.when(F.col("_t") > 0, F.col("raw") / F.col("_t")).otherwise(1.0 / F.col("_k")).alias("importance"))


def top_features(importance: DataFrame, n: int = 6) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def driver_text(importance: DataFrame, n: int = 4) -> DataFrame:
    """``Name (12.3%)`` for the top n drivers, humanised (underscores -> spaces, title case)."""
    top = top_features(importance, n)
    txt = F.concat(F.initcap(F.regexp_replace("feature", "_", " ")), F.lit(" ("),
                   F.format_string("%.1f", X.rnd(F.col("importance") * 100, 1)), F.lit("%)"))
    return top.select("feature", "importance", txt.alias("driver"))


def _by_feature(table: DataFrame, value: str, out: str) -> DataFrame:
    """One row: a map of the (one row per feature) table, for a broadcast."""
    return table.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col(value).cast("double")))).alias(out))


def _largest_first(items: Column, size: str) -> Column:
    """The structs of an array by falling |size|, then feature, nulls last. They begin with the feature."""
    keyed = F.transform(items, lambda s: F.struct(F.coalesce(-F.abs(s[size]), F.lit(float("inf"))).alias("k"), s["feature"].alias("f"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def local_feature_impact(df: DataFrame, id_col: str, features: list[str], importance: DataFrame, top_n: int | None = 8) -> DataFrame:
    """(value - portfolio mean) * importance per row and feature; top_n by |impact|.
    Means come from exact decimal sums, so they do not depend on summation order. A row's
    features are ordered inside the row: rows are not shuffled."""
    means = df.agg(*[(F.sum(F.col(f).cast("decimal(38,10)")).cast("double") / F.count(f)).alias(f"_m_{f}") for f in features])
    row = df.crossJoin(F.broadcast(means)).crossJoin(F.broadcast(_by_feature(importance, "importance", "_imp")))

    def item(f: str) -> Column:
        v, m = F.col(f).cast("double"), F.col(f"_m_{f}")
        imp = F.coalesce(F.element_at("_imp", F.lit(f)), F.lit(0.0))
        return F.struct(F.lit(f).alias("feature"), v.alias("value"), m.alias("baseline"), ((F.coalesce(v, F.lit(0.0)) - m) * imp).alias("impact"))

    items = F.array(*[item(f) for f in features])
    if top_n is None:
        return row.select(id_col, F.inline(items))
    ordered = row.select(id_col, F.posexplode(F.slice(_largest_first(items, "impact"), 1, top_n)).alias("_at", "_s"))
    return ordered.select(id_col, "_s.*", (F.col("_at") + 1).alias("rank"))


def contribution_waterfall(df: DataFrame, id_col: str, features: list[str], coef: DataFrame, max_features: int = 12) -> DataFrame:
    """Linear-model contributions c = beta * (x - mean) per row, ordered by |c| with the
    running start/end of the waterfall from the base value 0. Features without a beta are
    left out. The order and the running sums are made inside the row."""
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"_m_{f}") for f in features])
    row = df.crossJoin(F.broadcast(means)).crossJoin(F.broadcast(_by_feature(coef, "beta", "_beta")))

    def item(f: str) -> Column:
        m, beta = F.col(f"_m_{f}"), F.element_at("_beta", F.lit(f))
        return F.struct(F.lit(f).alias("feature"), (beta * (F.coalesce(F.col(f).cast("double"), m) - m)).alias("contribution"))

    known = F.filter(F.array(*[item(f) for f in features]), lambda s: F.map_contains_key("_beta", s["feature"]))
    row = row.select(id_col, F.slice(_largest_first(known, "contribution"), 1, max_features).alias("_c"))
    upto = lambda i: F.aggregate(F.slice("_c", 1, i + 1), F.lit(0.0), lambda acc, s: acc + F.coalesce(s["contribution"], F.lit(0.0)))
    steps = F.transform("_c", lambda s, i: F.struct((i + 1).alias("step"), s["feature"].alias("feature"), s["contribution"].alias("contribution"), upto(i).alias("end")))
    return row.select(id_col, F.inline(steps)).withColumn("start", F.col("end") - F.col("contribution"))
