"""Trailing counts by buckets of users."""

from datetime import datetime, timedelta

import numpy as np

from ledgerlark.streaming import jobs as J


def test_counts_of_many_users_equal_brute_force():
    rng = np.random.default_rng(3)
    t = J.TrailingCount(10)
    for n in (0, 1, 2, 300):
        held = np.empty(n, t.FIELDS)
        held["user"], held["us"] = rng.integers(-3, 4, n), rng.choice([0, 1, 5, 10, 11, 20, 60, 10**10, -(10**16)], n) * 1_000_000
        held["id"], held["open"] = np.arange(n), True
        held = held[np.lexsort((held["id"], held["us"], held["user"]))]
        want = [sum(1 for o in held if o["user"] == e["user"] and e["us"] - t.span <= o["us"] <= e["us"]) for e in held]
        assert t._counts(held).tolist() == want


def test_state_has_a_few_rows_for_each_bucket_whatever_the_users(spark, monkeypatch):
    ended, finish = [], J._finish
    monkeypatch.setattr(J, "_finish", lambda *a: ended.append(finish(*a)) or ended[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        start = datetime(2024, 1, 1)
        rows = [(k, k % 500, start + timedelta(seconds=3 * k)) for k in range(1500)]
        ev = spark.createDataFrame(rows, "deposit_id long, user_id long, ts timestamp_ntz")
        out = J.trailing_frequency(spark, J.land(ev, "b", files=2, order="ts"), ev.schema, files_per_trigger=1, delay="10 minutes", buckets=4)
        want = {(k, k // 500 + 1) for k in range(1500) if 3 * k * 1000 <= (3 * 1499 - 600) * 1000}
        assert {tuple(r) for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in ended[-1].recentProgress if p["stateOperators"]) < 100
