"""Joins of a large table with a table that has one row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stable

#: A lookup table of at most this many rows is sent to the rows; a larger one is copied ``COPIES`` times and the
#: rows are dealt over the copies, so that one key's rows go to as many tasks.
SMALL_ROWS, COPIES = 200_000, 16


def lookup(df: DataFrame, table: DataFrame, on: list[str], how: str = "left", small_rows: int = SMALL_ROWS, copies: int = COPIES,
           rows: int | None = None) -> DataFrame:
    """``df`` joined (left or inner) with ``table``, which has at most one row for each key and is written once to
    be counted, unless ``rows`` tells how many rows a written table has at most. Where it is small, the rows of ``df`` are not moved; where it is not, a key with a third of them is
    spread over ``copies`` tasks. Rows with a null key find nothing."""
    if rows is None:
        table = stable(table, "lookup")
        rows = table.count()
    if rows <= small_rows:
        return df.join(F.broadcast(table), on, how)
    dealt = df.withColumn("_copy", F.pmod(F.monotonically_increasing_id(), F.lit(copies)).cast("int"))
    copied = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return dealt.join(copied, [*on, "_copy"], how).drop("_copy")
