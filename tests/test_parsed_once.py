"""Transactions: text is parsed once per row, by all cores; dates read by the cast equal dates read by their numbers."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import expr as X
from ledgerlark.operators import clean as C
from ledgerlark.sources.domain import Tables, transactions
from ledgerlark.sources.tables import spread


def read_by_hand(text, pivot=76):
    s = (text or "").strip(" ")
    try:
        if re.fullmatch(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", s):
            return date(*map(int, s.split("-")))
        if re.fullmatch(r"[0-9]{1,2}[/-][0-9]{1,2}[/-]([0-9]{4}|[0-9]{2})", s):
            a, b, y = re.split("[/-]", s)
            year = int(y) if len(y) == 4 else int(y) + (2000 if int(y) < pivot else 1900)
            return date(year, int(b), int(a)) if int(b) <= 12 else date(year, int(a), int(b)) if int(a) <= 12 else None
    except ValueError:
        return None
    return None


def test_dates_of_all_forms(spark):
    nums = ["0", "1", "9", "02", "12", "13", "28", "29", "30", "31", "32", "99"]
    texts = [f"{a}{p}{b}{q}{y}" for a in nums for b in nums for p, q in ("//", "--", "/-") for y in ("2023", "2024", "75", "76", "00", "1800")]
    texts += [f"{y}-{a}-{b}" for a in nums for b in nums for y in ("2023", "2024", "1999")]
    texts += [None, "", " 3/4/21 ", "3/4/1", "3/4/123", "2020", "2020-01", "2020/01/02", "2020-01-02T00:00", "1/2/2020 x", "nan", "2020-1-2x", "+1/2/2020"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.parse_mixed_dates(F.col("t")).alias("d")).collect()
    assert [(r["t"], r["d"]) for r in got] == [(t, read_by_hand(t)) for t in texts]


def test_no_filter_below_the_written_table_parses_text(spark, sf, monkeypatch):
    written, stable = [], C.stable
    monkeypatch.setattr(C, "stable", lambda df: written.append(df) or stable(df))
    clean = C.prepare_transactions(transactions(Tables(spark, sf)))
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if re.search("Filter|Join", line) and "RLIKE" in line]
    want = C.prepare_transactions(transactions(Tables(spark, sf)), materialize=False)
    assert clean.exceptAll(want).count() == 0 and want.exceptAll(clean).count() == 0
    assert clean.filter("TransactionAmount < 0 or TransactionDate is null").count() == 0


def test_one_row_group_in_many_splits_is_spread(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    cores = spark.sparkContext.defaultParallelism
    for name, value in zip(names, ("1", str(cores))):
        spark.conf.set(name, value)
    try:
        scan = spark.read.parquet(str(tmp_path / "one"))
        if scan.rdd.getNumPartitions() < 2:
            pytest.skip("one core")
        assert len([r for r in scan.groupBy(F.spark_partition_id()).count().collect()]) == 1
        dealt = spread(scan).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(dealt) == cores and max(r["count"] for r in dealt) < 2 * 20_000 / cores
    finally:
        for name in names:
            spark.conf.unset(name)
