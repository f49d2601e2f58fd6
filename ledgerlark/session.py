"""Session helpers: one place that fixes the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "ledgerlark") -> SparkSession:
    """Local session for tests and the bench. On a cluster, use the cluster's session
    and call :func:`configure` on it instead."""
    builder = (
        SparkSession.builder.master(master or "local[8]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Settings that change results if missing (time zone) or robustness (checkpoint dir)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # the JVM never compiles a method of more than 8000 bytes: a stage that would generate one runs operator by operator
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant folder and is
    used as is. Only in local mode may it be unset: a scratch folder of the machine is
    taken then. Elsewhere no folder is known to be shared, which is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        spark.conf.set("spark.checkpoint.dir", existing)
        return existing
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="ledgerlark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for tables a job writes and reads back."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def models_path(spark: SparkSession) -> str:
    """The folder of fitted models: ``spark.ledgerlark.models.dir`` where it is set, else a folder of the
    warehouse if the session names one, so models outlast the session; else under the checkpoint dir."""
    named = spark.conf.get("spark.ledgerlark.models.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ledgerlark_models"
    return scratch_path(spark, "models")


def stable(df: DataFrame, name: str = "stable") -> DataFrame:
    """Cut lineage reliably (survives executor loss) so ids/ranks computed from
    partition layout stay fixed when downstream stages are retried.

    The rows are written once as Parquet under the shared checkpoint folder and read
    back: one computation (an RDD checkpoint computes its input twice), a columnar file
    that later scans prune, and files any executor can read after a loss."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
