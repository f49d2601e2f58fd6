"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import decontaminate, minhash, mixing, pii, quality_gam
from ledgerlark.llm.common import prepare, read, stable


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model rejects go; it is fitted on the labelled rows of ``docs``."""
    prepare(spark)
    return quality_gam.keep_good(docs, quality_gam.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    prepare(spark)
    return minhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is masked."""
    prepare(spark)
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words each document gives to the mix and the training positions at which it starts; the
    training order is written to the shared folder."""
    prepare(spark)
    return mixing.deal(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]
#: Models and near-duplicate groups cannot be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stable(docs, "pipeline")
    return docs
