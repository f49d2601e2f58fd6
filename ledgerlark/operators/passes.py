"""Exact sums over all rows, for fits that go over the rows again and again.

A pass gives the sum of a few dozen numbers per row. Rows' terms are summed as whole numbers of a small unit, so
the sums depend neither on the number of partitions nor on their order, and reruns of a fit agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

#: Terms are summed as multiples of this.
UNIT = 2.0 ** -26
#: Factors are split into multiples of this and the rest.
HALF = 2.0 ** 13
#: Up to so many parts their sums go straight to the driver, a row each; beyond, Spark adds them up first.
PARTS = 256
#: Rows whose terms are made at once.
ROWS = 4096
#: Rows of a held block.
BLOCK = 1 << 17


def whole_sums(each: np.ndarray) -> list[int]:
    """The sums of rows of whole numbers held as floats, exactly; each: (terms, rows of the table)."""
    if np.abs(each).max(initial=0.0) * each.shape[1] < 2.0 ** 53:
        return [int(v) for v in each.sum(axis=1)]
    return [sum(map(int, c)) for c in each]


def grouped_sums(each: np.ndarray, group: np.ndarray, groups: int) -> list[int]:
    """:func:`whole_sums` of every group, one group after the other."""
    if np.abs(each).max(initial=0.0) * each.shape[1] < 2.0 ** 53:
        return [int(v) for v in np.stack([np.bincount(group, c, groups) for c in each], axis=1).ravel()]
    return [v for g in range(groups) for v in whole_sums(each[:, group == g])]


def _halves(a: np.ndarray) -> np.ndarray:
    high = np.rint(a * (1 / HALF))
    return np.concatenate([high, a - high * HALF])


def product_sums(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The sums over the table's rows of all products of a term in ``a`` and one in ``b`` (terms, rows), whole numbers held as
    floats, exactly: numbers are split in two, so that a matrix product adds up whole numbers that floats hold."""
    n, m = len(a), len(b)
    first, second = _halves(a), _halves(b)
    if np.abs(first).max(initial=0.0) * np.abs(second).max(initial=0.0) * a.shape[1] >= 2.0 ** 53:
        return [sum(int(x) * int(y) for x, y in zip(one, other)) for one in a for other in b]
    p = [[int(v) for v in row] for row in first @ second.T]
    half = int(HALF)
    return [(p[i][j] * half + p[i][m + j] + p[n + i][j]) * half + p[n + i][m + j] for i in range(n) for j in range(m)]


def held_rows(rows: DataFrame, features: list[str]) -> RDD:
    """The features of all rows as persisted blocks (features, rows), for passes that then read plain bytes. Rows have no nulls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[np.ndarray] = []
        for b in batches:
            part.append(np.stack([b.column(f).to_numpy().astype(float) for f in features]))
            if sum(p.shape[1] for p in part) >= BLOCK:
                yield block(part)
                part = []
        if part:
            yield block(part)

    def block(part: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(part, axis=1).tobytes()], pa.binary())], names=["x"])

    found = rows.select(*features).mapInArrow(run, "x binary").rdd
    return found.map(lambda r: np.frombuffer(r["x"]).reshape(len(features), -1)).persist(StorageLevel.MEMORY_AND_DISK)


def exact_sums(rows: DataFrame, features: list[str], terms: Callable[[np.ndarray], np.ndarray], parts: int) -> np.ndarray:
    """The column sums of ``terms(x)`` over all rows; x has the ``features`` of some rows, without nulls. ``parts``: the
    partitions of ``rows``, which are not empty."""
    blocks = held_rows(rows, features)
    try:
        return exact_totals(blocks, lambda x: whole_sums(np.rint(terms(x).T / UNIT)), parts)
    finally:
        blocks.unpersist()


def exact_totals(blocks: RDD, totals: Callable[[np.ndarray], list[int]], parts: int, unit: float = UNIT) -> np.ndarray:
    """As :func:`exact_sums`, of whole numbers (of ``unit``) that ``totals`` has added up over the rows (rows, features) it
    is given, for the blocks of :func:`held_rows`."""
    def run(blocks: Iterator[np.ndarray]) -> Iterator[list[int]]:
        total: list[int] = []
        for b in blocks:
            for i in range(0, b.shape[1], ROWS):
                total = _both(total, totals(b[:, i : i + ROWS].T))
        if total:
            yield total

    found = blocks.mapPartitions(run)
    whole: list[int] = []
    for one in [found.treeReduce(_both)] if parts > PARTS else found.collect():  # a row for each part, of a few dozen numbers
        whole = _both(whole, one)
    return np.array([float(w) for w in whole]) * unit


def _both(one: list[int], other: list[int]) -> list[int]:
    return [a + b for a, b in zip(one, other)] if one else other


#: Rows that are worth a task of their own in the many short jobs of a fit.
ROWS_PER_TASK = 50_000


def few_tasks(df: DataFrame) -> DataFrame:
    """A written table in no more partitions than its rows are worth; large tables stay as they are."""
    return df.coalesce(max(1, -(-df.count() // ROWS_PER_TASK)))
