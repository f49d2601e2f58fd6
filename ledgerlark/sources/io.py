"""Sources and sinks: CSV (fixed or detected separator), JSON request rows, nested JSON
history, first-existing-path resolution, materialise-once tables, JSON records, saved
models. Paths for intermediate tables come from the session's shared checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import require_columns  # noqa: F401  (re-exported: part of the source API)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def resolve_source(spark: SparkSession, candidates: list[str], label: str) -> str:
    """First existing path among the candidates (explicit path first), else an error
    naming every candidate."""
    for c in candidates:
        if c and path_exists(spark, c):
            return c
    raise FileNotFoundError(f"{label}: none of the candidate paths exist: {', '.join(c for c in candidates if c)}")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    (df.write.mode("overwrite").option("header", True).option("sep", sep)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Header CSV with an explicit schema (no inference pass), whitespace kept."""
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def detect_separator(spark: SparkSession, path: str, candidates: str = ",;\t|") -> str:
    """Separator of a delimited file from its header line: the candidate occurring most.
    Only the first line is read (``limit(1)`` on the text source)."""
    first = spark.read.text(path).limit(1).first()
    line = first[0] if first else ""
    best = max(candidates, key=line.count)
    return best if line.count(best) > 0 else ","


def scan_csv_flexible(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma or semicolon CSV. Unlike a parse-error retry (which a ';' file never
    triggers, since it parses as one column), the separator is chosen from the header."""
    return scan_csv(spark, path, schema, detect_separator(spark, path))


def scan_json_rows(spark: SparkSession, path: str, schema: T.StructType, aliases: dict[str, str] | None = None) -> DataFrame:
    """JSON request rows (one object per line) with field aliases folded in
    (``dayOfWeek`` -> ``day_of_week``). An empty input is an error, as in the reference."""
    aliases = aliases or {}
    fields = list(schema.fields) + [T.StructField(a, f.dataType) for a, canon in aliases.items()
                                    for f in schema.fields if f.name == canon]
    df = spark.read.schema(T.StructType(fields)).json(path)
    if df.limit(1).count() == 0:
        raise ValueError("rows must be a non-empty list")
    for alias, canon in aliases.items():
        df = df.withColumn(canon, F.coalesce(F.col(canon), F.col(alias))).drop(alias)
    return df


HISTORY_SCHEMA = "struct<data: array<struct<ds: string, y: double>>>"


def parse_nested_history(df: DataFrame, col: str = "history", keys: list[str] | None = None) -> DataFrame:
    """A JSON string whose ``data`` holds ``{ds, y}`` points -> monthly means: parse,
    ``inline``, month-truncate, drop missing values, average per month."""
    keys = keys or []
    parsed = df.select(*keys, F.from_json(F.col(col), HISTORY_SCHEMA).alias("_h"))
    pts = parsed.select(*keys, F.inline("_h.data"))
    pts = pts.withColumn("month_start", F.trunc(F.try_to_timestamp(F.col("ds")).cast("date"), "MM")).dropna(subset=["month_start", "y"])
    return pts.groupBy(*keys, "month_start").agg(F.avg("y").alias("value"))


def ensure_materialized(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path`` if it is there as a whole (its write was committed), else build
    it, write it there and read it back (a written table also cuts the lineage of the build)."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sink_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def json_records(df: DataFrame, cols: list[str]) -> DataFrame:
    """One JSON object per row over ``cols``; NaN becomes null and null fields are kept."""
    sel = []
    types = dict(df.dtypes)
    for c in cols:
        v = F.col(c)
        if types[c] in ("double", "float"):
            v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
        sel.append(v.alias(c))
    return df.select(F.to_json(F.struct(*sel), {"ignoreNullFields": "false"}).alias("record"))


def sink_json(df: DataFrame, cols: list[str], path: str) -> str:
    """The rows of ``df`` as JSON lines over ``cols``; returns the folder."""
    json_records(df, cols).write.mode("overwrite").text(path)
    return path


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def source_version(spark: SparkSession, path: str) -> DataFrame:
    """One row (files, bytes, newest modification time) describing a source, the key
    that decides whether cached artifacts built from it are still valid."""
    df = spark.read.format("binaryFile").load(path).select("length", "modificationTime")
    return df.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))


def cached_artifact(spark: SparkSession, sources: str | list[str], store: str, build: Callable[[], PipelineModel],
                    params: dict | None = None) -> PipelineModel:
    """Load the model under ``store`` if it was built from the same version of every table
    of ``sources`` with the same ``params``; otherwise rebuild and save it with the new stamp."""
    key: dict = {"params": params or {}}
    for source in [sources] if isinstance(sources, str) else sources:
        key[source] = [str(v) for v in source_version(spark, source).first()]
    stamp = json.dumps(key, sort_keys=True, default=str)
    meta = f"{store}/version"  # no leading underscore: readers skip such names
    if path_exists(spark, meta) and path_exists(spark, f"{store}/model"):
        if spark.read.text(meta).first()[0] == stamp:
            return load_model(f"{store}/model")
    model = build()
    save_model(model, f"{store}/model")
    spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(meta)
    return model
