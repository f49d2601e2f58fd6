"""Streams: the same rows for one and many micro-batches, after restarts and after replayed batches."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import windows as W
from ledgerlark.streaming import jobs as J

SCHEMA = "deposit_id long, user_id long, ts timestamp_ntz, value double"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(k, rng.choice([1, 1, 1, 2, 3]), start + timedelta(minutes=rng.randrange(0, 60 * 24 * 4)), float(k % 9)) for k in range(400)]
    rows += [(1000 + k, 1, rows[0][2], 1.0) for k in range(3)] + [(2000, None, start, 1.0), (2001, 7, None, 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture()
def ended(monkeypatch):
    """The queries that have ended."""
    out, finish = [], J._finish
    monkeypatch.setattr(J, "_finish", lambda *a: out.append(finish(*a)) or out[-1])
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hourly_trend_of_one_and_of_many_batches(spark, events, ended):
    timed = events.filter("ts is not null")
    landing = J.land(timed, "t", files=10, order="ts")
    one = rows_of(J.hourly_trend(spark, landing, timed.schema, files_per_trigger=None))
    many = rows_of(J.hourly_trend(spark, landing, timed.schema, files_per_trigger=1))
    assert one == many and len(one) > 80 and sum(r[2] for r in one) > 390
    first, last = ended
    assert first.recentProgress[0]["numInputRows"] == timed.count() and len([p for p in last.recentProgress if p["numInputRows"]]) == 10
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in last.recentProgress) < 30  # of 96 hours
    assert last.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4  # hours that the watermark has not closed
    assert "RocksDB" not in (spark.conf.get(J._PROVIDER, None) or "")


def batch_twin(events, delay_hours=2):
    timed = events.filter("user_id is not null and ts is not null")
    counted = W.trailing_count(timed, "user_id", "ts", 86_400, "deposit_id")
    last = timed.agg((F.max("ts") - F.expr(f"interval {delay_hours} hours")).alias("w"))
    return rows_of(counted.crossJoin(last).filter("ts < w").select("deposit_id", "frequency"))


def test_trailing_counts_equal_the_batch_after_one_and_many_batches_and_a_restart(spark, events, ended):
    want = batch_twin(events)
    landing = J.land(events, "f", files=6, order="ts")
    assert rows_of(J.trailing_frequency(spark, landing, events.schema, files_per_trigger=None)) == want
    assert rows_of(J.trailing_frequency(spark, landing, events.schema, files_per_trigger=1)) == want
    # what is kept is a day and the delay before the last event, of four days
    assert ended[-1].recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 200
    early, late = (J.land(events.filter(c), n, files=2, order="ts") for c, n in (("ts < '2024-01-02 12:00'", "a"), ("ts >= '2024-01-02 12:00'", "b")))
    base = J.stream_folder(spark, "restart")
    before = rows_of(J.trailing_frequency(spark, early, events.schema, base=base))
    assert 0 < len(before) < len(want)
    for name in os.listdir(late):  # more files land
        if name.startswith("part-"):
            os.link(f"{late}/{name}", f"{early}/later-{name}")
    assert rows_of(J.trailing_frequency(spark, early, events.schema, base=base)) == want


def test_a_replayed_batch_leaves_its_rows_once(spark, events):
    landing = J.land(events, "d", files=4, order="ts")
    base = J.stream_folder(spark, "replay")
    stream = lambda: J.read_landing(spark, landing, events.schema, 1).select("deposit_id", "value")
    once = rows_of(J.run_batches(stream(), base))
    assert len(once) == events.count()
    commits = sorted(int(f) for f in os.listdir(f"{base}/checkpoint/commits") if f.isdigit())
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):  # the last batch was written, but not committed
        if os.path.exists(f"{base}/checkpoint/commits/{name}"):
            os.remove(f"{base}/checkpoint/commits/{name}")
    assert rows_of(J.run_batches(stream(), base)) == once
    assert sorted(int(f) for f in os.listdir(f"{base}/checkpoint/commits") if f.isdigit()) == commits


def test_no_files_give_no_rows(spark, events):
    landing = J.land(events.filter("false"), "none", files=1)
    assert J.trailing_frequency(spark, landing, events.schema).count() == 0
