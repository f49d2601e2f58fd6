import pytest

ODD = [None, "", " \t\n", "one", "é à 😀", "word " * 9000, "x" * 40000, "a\n\n\nb\nb\nb #*$ <|im_start|>"]


@pytest.fixture(scope="session")
def odd_docs(spark, sf):
    """The small documents, odd texts, repeated rows, null ids, and columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [(-1 - k, t, None, None) for k, t in enumerate(ODD)] * 2 + [(None, None, None, None), (None, "null id text with a few words", "en", "s"), (-50, "null id text with a few words", "en", "s")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return base.union(odd).withColumn("node", F.lit(1)).withColumn("score", F.lit("x")).withColumn("band", F.lit(2.0)).withColumn("key", F.lit(None).cast("string"))


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def no_labels(labels):
    return labels.filter("false")
