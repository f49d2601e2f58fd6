"""Global ranks, prefix sums and exact quantiles without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task. Here the
order is produced by a range shuffle instead: ``repartitionByRange`` splits the key
space (a hot key is split by the secondary sort keys too), each partition is sorted
locally, and a table with one row per partition (so at most
``spark.sql.shuffle.partitions`` rows, a proven bound) supplies the offsets by
broadcast. Exact per-group quantiles use the same ranks, so a group holding a third
of all rows is spread over many tasks instead of one aggregation buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable

_PID, _LOCAL = "_rk_pid", "_rk_local"


def _tag_sorted(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    # Without an explicit count, AQE may merge neighbouring small ranges (merged ranges
    # stay contiguous and in key order), so a small table is not cut into hundreds of
    # tiny partitions and files; large tables keep ranges of the advisory size.
    if partitions:
        ranged = df.repartitionByRange(partitions, *order)
    else:
        ranged = df.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    tagged = ranged.withColumn(_PID, F.spark_partition_id()).withColumn(
        _LOCAL, F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33))
    # Partition ids and positions must not change if a later stage is retried.
    return stable(tagged)


def global_row_number(df: DataFrame, order: list[Column], out: str = "rn", partitions: int | None = None,
                      sum_col: str | None = None, cum_out: str | None = None, total_out: str | None = None,
                      sums: dict[str, str] | None = None) -> DataFrame:
    """1-based row number over the total order ``order`` (must be a strict order: add a
    unique key as the last element). With ``sum_col`` also adds the inclusive running
    sum of that column as ``cum_out``, and with ``sums`` (column -> output) those of
    several columns in the same pass; with ``total_out`` the table's row count (taken
    from the same per-partition counts, no extra pass)."""
    sums = dict(sums or {})
    if sum_col:
        sums[sum_col] = cum_out or f"cum_{sum_col}"
    tagged = _tag_sorted(df, order, partitions)
    per_part = tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("_rk_cnt"),
                                        *[F.sum(c).alias(f"_rk_sum{i}") for i, c in enumerate(sums)])
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)  # <= #partitions rows
    offsets = per_part.select(
        _PID,
        F.coalesce(F.sum("_rk_cnt").over(w), F.lit(0)).alias("_rk_off"),
        *([F.sum("_rk_cnt").over(Window.partitionBy()).alias(total_out)] if total_out else []),
        *[F.coalesce(F.sum(f"_rk_sum{i}").over(w), F.lit(0.0)).alias(f"_rk_soff{i}") for i in range(len(sums))],
    )
    res = tagged.join(F.broadcast(offsets), _PID)
    res = res.withColumn(out, F.col(_LOCAL) + F.col("_rk_off") + 1)
    wl = Window.partitionBy(_PID).orderBy(_LOCAL).rowsBetween(Window.unboundedPreceding, 0)
    if sums:
        res = res.withColumns({o: F.sum(c).over(wl) + F.col(f"_rk_soff{i}") for i, (c, o) in enumerate(sums.items())})
    return res.drop(_PID, _LOCAL, "_rk_off", *[f"_rk_soff{i}" for i in range(len(sums))])


def _pieces(tagged: DataFrame, group: list[str], what: Column, few: bool) -> DataFrame:
    """One row per (partition, group) of the written order: the group's first position in the
    partition, its sum of ``what`` in earlier partitions and its sum over the whole table.
    A group is cut only at partition borders, so there is one row per group and at most one
    more per partition: with ``few`` groups (a fixed small set) a proven bound to broadcast."""
    per = tagged.groupBy(_PID, *group).agg(F.min(_LOCAL).alias("_rk_first"), F.sum(what).alias("_rk_part"))
    w = Window.partitionBy(*group)
    before = w.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    out = per.select(_PID, *group, "_rk_first", F.coalesce(F.sum("_rk_part").over(before), F.lit(0)).alias("_rk_off"),
                     F.sum("_rk_part").over(w).alias("_rk_n"))
    return F.broadcast(out) if few else out


def group_row_number(df: DataFrame, group: list[str], order: list[Column], out: str = "rn",
                     size_out: str | None = None, partitions: int | None = None, few: bool = False) -> DataFrame:
    """1-based row number within each group (skew-safe version of
    ``row_number().over(Window.partitionBy(group).orderBy(order))``). ``few`` says that the
    groups are a fixed small set (classes, column names)."""
    tagged = _tag_sorted(df, [F.col(g) for g in group] + order, partitions)
    res = tagged.join(_pieces(tagged, group, F.lit(1), few), [_PID, *group])
    res = res.withColumn(out, F.col(_LOCAL) - F.col("_rk_first") + F.col("_rk_off") + 1)
    res = res.drop(_PID, _LOCAL, "_rk_first", "_rk_off")
    if size_out:
        return res.withColumnRenamed("_rk_n", size_out) if size_out != "_rk_n" else res
    return res.drop("_rk_n")


def group_quantiles(df: DataFrame, group: list[str], value: str, quantiles: dict[str, float],
                    partitions: int | None = None, few: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/numpy default, DuckDB
    ``quantile_cont``) per group; NULL values are ignored. Empty ``group`` = whole table
    (one row, NULL without values). ``few`` as in :func:`group_row_number`.

    Rows are first counted per (group, value) with map-side combining, so repeated
    values (a customer's age, a popular amount) collapse before anything is sorted; the
    distinct pairs are then ordered globally and written once (range-partitioned, no
    single-task window), and each quantile reads the value whose running count in the
    group covers its position. A running count spans one group of one partition; the
    counts of earlier partitions are added to it."""
    base = df.select(*[F.col(g) for g in group], F.col(value).alias("_rk_v")).filter(F.col("_rk_v").isNotNull())
    vc = base.groupBy(*group, "_rk_v").agg(F.count(F.lit(1)).alias("_rk_c"))
    tagged = _tag_sorted(vc, [F.col(g) for g in group] + [F.col("_rk_v")], partitions)
    j = tagged.join(_pieces(tagged, group, F.col("_rk_c"), few or not group), [_PID, *group])
    run = Window.partitionBy(_PID, *group).orderBy(_LOCAL).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_rk_cum", F.sum("_rk_c").over(run) + F.col("_rk_off"))
    lo_pos, hi_pos = F.col("_rk_cum") - F.col("_rk_c"), F.col("_rk_cum")  # first 0-based position of the value, one past its last
    aggs = [F.max("_rk_n").alias("_rk_n")]
    for name, q in quantiles.items():
        pos = (F.col("_rk_n") - 1) * q
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((lo_pos <= at) & (at < hi_pos), F.col("_rk_v"))).alias(f"_{tag}_{name}"))
    per = j.groupBy(*group).agg(*aggs)
    outs = []
    for name, q in quantiles.items():
        pos = (F.col("_rk_n") - 1) * q
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * frac).alias(name))
    return per.select(*[F.col(g) for g in group], *outs)


def few_value_quantiles(df: DataFrame, group: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """:func:`group_quantiles` of a value with a small, bounded number of distinct values (an age in days of 18 to 100 years): rows
    are counted per (group, value), the counted values of a group stand in one sorted array, and the quantiles
    are read inside the row. Nothing is ordered beyond a group."""
    base = df.select(*[F.col(g) for g in group], F.col(value).alias("_rk_v")).filter(F.col("_rk_v").isNotNull())
    counted = base.groupBy(*group, "_rk_v").agg(F.count(F.lit(1)).alias("_rk_c"))
    held = counted.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_rk_v", "_rk_c"))).alias("_rk_s"), F.sum("_rk_c").alias("_rk_n"))

    def at(place: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(dict(base.dtypes)["_rk_v"]).alias("v"))
        step = lambda acc, s: F.struct((acc["seen"] + s["_rk_c"]).alias("seen"), F.when((acc["seen"] <= place) & (place < acc["seen"] + s["_rk_c"]), s["_rk_v"]).otherwise(acc["v"]).alias("v"))
        return F.aggregate("_rk_s", start, step)["v"]

    outs = []
    for name, q in quantiles.items():
        pos = (F.col("_rk_n") - 1) * q
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return held.select(*[F.col(g) for g in group], *outs)


def scalar_quantiles(df: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """One-row DataFrame of exact whole-table quantiles (to be joined by broadcast)."""
    return group_quantiles(df, [], value, quantiles)


def quintile_score(rank: Column, n: Column, higher_is_better: bool = True) -> Column:
    """Quintile 1..5 of a 1-based rank among ``n`` rows, equal to
    ``pd.qcut(rank(method='first'), 5)`` (``ntile`` differs); one row -> 5.
    Integer arithmetic: score = max(1, ceil(5*(r-1)/(n-1)))."""
    num = (rank - 1) * 5
    den = n - 1
    # floor((num + den - 1) / den) == ceil(num / den) for non-negative integers
    s = F.when(den <= 0, F.lit(5)).otherwise(F.greatest(F.lit(1), F.floor((num + den - 1) / den)).cast("int"))
    return s if higher_is_better else (F.lit(6) - s)


def average_rank_table(df: DataFrame, c: str, out: str = "_avg_rank") -> DataFrame:
    """(value, average 1-based rank of that value among all non-null rows), ties averaged.

    Works on distinct values: a global running count over the value order gives each
    value's last rank; its first rank is that minus its count plus one."""
    vc = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_cnt"))
    cum = global_row_number(vc, [F.col(c)], out="_vr", sum_col="_cnt", cum_out="_hi")
    return cum.select(c, ((F.col("_hi") - F.col("_cnt") + 1 + F.col("_hi")) / 2.0).alias(out))
