"""Measured lookups, exact sums, starts that move together, least squares per group, sparse one-hot designs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import aggregate as A
from ledgerlark.operators import encode as E
from ledgerlark.operators import joins as J
from ledgerlark.operators import ml as M
from ledgerlark.operators import passes
from ledgerlark.operators import ranking as R
from ledgerlark.operators import segment as G


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_small_and_large_tables_agree(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 5)).alias("k"))
    table = spark.createDataFrame([(k, f"v{k}") for k in range(4)], "k long, v string")
    for how in ("left", "inner"):
        want = sorted(df.join(table, "k", how).collect(), key=str)
        assert sorted(J.lookup(df, table, ["k"], how).collect(), key=str) == want
        large = J.lookup(df, table, ["k"], how, small_rows=1)
        assert sorted(large.collect(), key=str) == want and "_copy" in plan(large)
    assert "hashpartitioning(k" not in plan(J.lookup(df, table, ["k"]))


def test_facts_are_not_moved_on_few_keys(spark):
    """At a 20 kB broadcast limit no exchange is on the location, the label or a column's value."""
    rows = [(k, f"c{k % 40}", "ABC"[k % 3], float(k % 50), float(k), "x") for k in range(400)]
    tx = spark.createDataFrame(rows, "TransactionID long, CustomerID string, CustLocationNorm string, TransactionAmount double, CustAccountBalance double, pad string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        assert "hashpartitioning(CustLocationNorm" not in plan(G.behavioral_anomalies(tx))
        assert "hashpartitioning(_lv" not in plan(E.label_encode(tx, ["CustLocationNorm"]))
        assert "hashpartitioning(TransactionAmount" not in plan(A.correlation_matrix(tx, ["TransactionAmount", "CustAccountBalance"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exact_sums_do_not_depend_on_parts_or_order(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=900) * 1e-3, rng.normal(size=100) * 1e12])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    square = lambda x: np.column_stack([x[:, 0], x[:, 0] * 2])
    one = passes.exact_sums(df.repartition(1), ["v"], square, 1)
    monkeypatch.setattr(passes, "PARTS", 0)
    many = passes.exact_sums(df.repartition(7, "v"), ["v"], square, 7)
    assert (one == many).all() and np.isclose(one[0], x.sum()) and np.isclose(one[1], 2 * x.sum())


def test_quantiles_of_few_values(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(rng.integers(4)), float(rng.integers(18, 30))) for _ in range(300)] + [(9, None)], "g long, v double")
    qs = {"q1": 0.25, "m": 0.5, "p99": 0.99}
    key = lambda r: r.g
    assert sorted(R.few_value_quantiles(df, ["g"], "v", qs).collect(), key=key) == sorted(R.group_quantiles(df, ["g"], "v", qs).collect(), key=key)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.4 + c for c in ((0, 0), (4, 0), (0, 5), (6, 6))])
    return spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in enumerate(x)] + [(999, None, 1.0)], "id long, a double, b double")


def test_all_starts_together_equal_each_alone(blobs):
    centres, cost, rows = M.kmeans_best(blobs, ["a", "b"], k=4, n_init=6)
    alone = [M.kmeans_best(blobs, ["a", "b"], k=4, n_init=1, seed=42 + s)[1] for s in range(6)]
    assert cost == min(alone)
    x = blobs.dropna().select("a", "b").toPandas().to_numpy()
    assert np.isclose(cost, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum(), rtol=1e-6)
    got = {r.id: r.Cluster for r in rows.collect()}
    assert got[999] is None and all(len({got[i] for i in range(s, s + 60)}) == 1 for s in (0, 60, 120, 180)) and set(got.values()) == {0, 1, 2, 3, None}


def test_kmeans_needs_two_clusters_and_takes_no_rows(blobs):
    with pytest.raises(ValueError):
        M.kmeans_best(blobs, ["a"], k=1)
    assert M.kmeans_best(blobs.filter("false"), ["a", "b"], k=2, n_init=2)[2].count() == 0


def test_least_squares_per_group_in_one_aggregate(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in "AB":
        x = np.column_stack([2000 + rng.integers(0, 9, 40), rng.normal(size=40) * 50, np.full(40, 7.0)])
        y = 3.0 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=40) + (5 if g == "A" else -90)
        rows += [(g, *map(float, r), float(v)) for r, v in zip(x, y)]
        want[g] = np.linalg.lstsq(np.column_stack([x[:, :2], np.ones(40)]), y, rcond=None)[0]
    df = spark.createDataFrame(rows + [("A", None, 1.0, 1.0, 1.0)], "g string, year double, x double, flat double, label double")
    got = {r.g: r for r in M.linear_by_group(df, "g", ["year", "x", "flat"]).collect()}
    for g, (a, b, c) in want.items():
        assert np.allclose(got[g].coefficients, [a, b, 0.0], rtol=1e-4) and np.isclose(got[g].intercept, c, rtol=1e-4)
    scored = {r.g: r for r in M.evaluate_linear_by_group(df, df.dropna(), "g", ["year", "x", "flat"]).collect()}
    assert set(scored) == {"A", "B"} and all(r.rmse < 2 and r.model == "Linear Regression" for r in scored.values())


def test_hundred_thousand_categories_encode_sparsely(spark):
    df = spark.range(100_000).select("id", F.concat(F.lit("c"), F.col("id").cast("string")).alias("big"), (F.col("id") % 3).cast("string").alias("small"), (F.col("id") % 2).cast("double").alias("num"), F.lit(1).alias("target"))
    design, table = E.sparse_design(df, ["big", "small"], ["num"], keep=["id", "target"])
    assert table.count() == 100_003
    row = design.filter("id = 5").first()
    assert row.features.size == 100_004 and len(row.features.indices) == 3 and row.target == 1
    entries = E.sparse_entries(design.filter("id in (5, 6)"), table, ["num"], ["id", "target"]).collect()
    assert {(r.id, r.feature, r.value) for r in entries} == {(5, "big_c5", 1.0), (5, "small_2", 1.0), (5, "num", 1.0), (6, "big_c6", 1.0), (6, "small_0", 1.0)}


def test_sparse_design_of_missing_and_unseen_values(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (3, "b", 0.0)], "id long, c string, n double")
    design, table = E.sparse_design(df, ["c"], ["n"], keep=["id"])
    new = spark.createDataFrame([(4, "zzz", 2.0), (5, "b", 1.0)], "id long, c string, n double")
    again, _ = E.sparse_design(new, ["c"], ["n"], keep=["id"], table=table)
    assert {(r.id, r.feature, r.value) for r in E.sparse_entries(design.union(again), table, ["n"], ["id"]).collect()} == {
        (1, "c_a", 1.0), (2, "n", 3.0), (3, "c_b", 1.0), (4, "n", 2.0), (5, "c_b", 1.0), (5, "n", 1.0)}
    assert {r.feature: r["mean"] for r in E.feature_means(design, table, ["n"]).collect()} == {"n": 1.0, "c_a": 1 / 3, "c_b": 1 / 3}


def test_sums_of_groups_and_products_are_exact_at_any_size():
    rng = np.random.default_rng(3)
    group = rng.integers(0, 3, 500)
    for size in (10.0, 2.0 ** 40):  # the larger ones leave what floats hold
        a, b = np.rint(rng.normal(size=(3, 500)) * size * 2 ** 8), np.rint(rng.normal(size=(2, 500)) * size * 2 ** 8)
        assert passes.product_sums(a, b) == [sum(int(x) * int(y) for x, y in zip(p, q)) for p in a for q in b]
        assert passes.grouped_sums(a, group, 3) == [sum(int(x) for x in p[group == g]) for g in range(3) for p in a]


def test_a_pass_reads_held_blocks_and_not_the_table_again(spark):
    """Rows are made once however many passes go over them."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(0, 1000, 1, 4).select(F.col("id").cast("double").alias("v")).mapInArrow(count, "v double")
    blocks = passes.held_rows(df, ["v"])
    for _ in range(3):
        assert passes.exact_totals(blocks, lambda x: passes.whole_sums(x.T), 4, 1.0).tolist() == [499500.0]
    blocks.unpersist()
    assert made.value == 1000
