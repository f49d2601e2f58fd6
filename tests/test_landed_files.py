"""The 24 h windows: a task reads one landed file, whose rows are bounded."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlark.streaming import jobs as J


def test_files_and_tasks_are_bounded_in_rows(spark, monkeypatch):
    ev = spark.createDataFrame([(k % 7, datetime(2024, 1, 1) + timedelta(minutes=k)) for k in range(4000)], "user_id long, ts timestamp_ntz")
    landing = J.land(ev, "bounded", files=2, order="ts", file_rows=200)
    landed = spark.read.parquet(landing).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in landed) == 4000 and max(r["count"] for r in landed) <= 600
    splits = []
    run = J._run
    def seen(query, *a):  # noqa: ANN001, ANN002, ANN202
        splits.append((spark.read.parquet(landing).rdd.getNumPartitions(), len(landed)))
        return run(query, *a)
    monkeypatch.setattr(J, "_run", seen)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = J.frequency_24h(spark, landing, ev.schema, files_per_trigger=8).filter("window_end <= '2024-01-03'").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert splits[0][0] == splits[0][1] > 2  # a split for each file
    want = {}
    for k in range(4000):
        for h in range(24):
            key = (k % 7, datetime(2024, 1, 1) + timedelta(hours=k // 60 - h))
            want[key] = want.get(key, 0) + 1
    want = {(u, w, w + timedelta(hours=24), n) for (u, w), n in want.items() if w + timedelta(hours=24) <= datetime(2024, 1, 3)}
    assert {tuple(r) for r in got} == want
