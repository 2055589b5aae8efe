"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


SHUFFLE_TARGET_BYTES = 256 * 1024**2


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Shuffle partitions for an input: about 256 MB each, at least two per core.

    AQE merges partitions that turn out small but cannot split a whole shuffle, so the
    number has to be large enough from the start: 100 TB ask for 400,000.
    """
    return max(2 * cores, -(-input_bytes // SHUFFLE_TARGET_BYTES))


def build_session(
    app: str = "almagest",
    master: str | None = None,
    input_bytes: int | None = None,
    cores: int = 8,
    **conf: str,
) -> SparkSession:
    """A session with the settings the operators are written for.

    `input_bytes` and `cores` size the shuffles; explicit settings win.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if input_bytes is not None:
        conf = {"spark.sql.shuffle.partitions": str(shuffle_partitions(input_bytes, cores)), **conf}
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All record times are UTC; casts between zoned and zone-less time rely on it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_root(spark: SparkSession) -> str:
    """The cluster's shared folder, or one in the warehouse where that is not set.

    Driver and executors share both. The session's settings are not changed.
    """
    return (spark.conf.get(CHECKPOINT_KEY, None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work").rstrip("/")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables, below the cluster's shared folder."""
    return f"{work_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, partitions: list[str]) -> DataFrame | None:
    """A written parquet table, or None when nothing has been written yet.

    Partition values are text and stay text: left alone, Spark would read a part
    named 01 as the number 1 and a date folder as a date.
    """
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    typed = [T.StructField(f.name, T.StringType()) if f.name in partitions else f for f in found.fields]
    return spark.read.schema(T.StructType(typed)).parquet(path)
