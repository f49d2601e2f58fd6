"""Readers for the shared Parquet tables.

Every reader goes through ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the scan; nothing is cached here, so a query only reads the
columns its plan asks for.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return path


# Fixed-size dimensions (5 regions, 25 nations): never worth spreading out.
FIXED_SIZE = {"region", "nation"}
#: A scan of at most this many splits (1 GB at Spark's default split size) is spread over more tasks.
SMALL_SPLITS = 8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table. One that arrives as a few splits (one file, one row group) is spread by
    a round-robin repartition to min(cores, 16 x splits) partitions, so that row-wise parsing
    and the map side of aggregations use the cores; filters and column pruning still reach
    the scan. At most ``SMALL_SPLITS`` splits are moved so, whatever the cluster's size:
    larger tables are read as they are stored, without an exchange."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {TABLES}")
    df = spark.read.parquet(table_path(sf_dir, name))
    if name in FIXED_SIZE:
        return df
    splits, cores = df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    if splits <= SMALL_SPLITS and splits < cores:
        df = df.repartition(min(cores, 16 * max(splits, 1)))
    return df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan, dealt to all cores where the scan has fewer than two splits for each. Splits are cut by bytes, but a
    row group is read by one of them alone: a file of few row groups leaves most splits empty, and what follows the scan
    to the task that has the rows. For scans of few narrow columns that go into work on text."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


class Tables:
    """Attribute access to the tables of one scale factor: ``Tables(spark, d).orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir or os.environ.get("LEDGERLARK_SF_DIR", DEFAULT_SF_DIR)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
