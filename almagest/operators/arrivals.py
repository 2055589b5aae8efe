"""What is new between two snapshots, and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.functions.scalars import epoch_ms
from almagest.schema import ARRIVAL_LIFE_MS, LOG_ROWS


def arrivals(previous: DataFrame | None, current: DataFrame, arrived_ms: int | Column) -> DataFrame:
    """Records of `current` whose id the previous snapshot lacks.

    No previous snapshot means backfill: nothing counts as new then.
    """
    at = F.lit(arrived_ms) if isinstance(arrived_ms, int) else arrived_ms
    stamped = current.withColumn("arrived_ms", at)
    if previous is None:
        return stamped.limit(0)
    return stamped.join(previous.select("id"), "id", "left_anti")


def alive(arrived: DataFrame, now_ms: int, life_ms: int = ARRIVAL_LIFE_MS) -> DataFrame:
    """Arrivals younger than their life time."""
    return arrived.where(F.lit(now_ms) - F.col("arrived_ms") < life_ms)


def newest(arrived: DataFrame, limit: int) -> DataFrame:
    """The newest arrivals; a top-k, so each task keeps only `limit` rows."""
    return arrived.orderBy(F.col("arrived_ms").desc(), F.col("id").asc()).limit(limit)


def still_present(current: DataFrame, arrived: DataFrame) -> DataFrame:
    """Recently arrived records that the current snapshot still has."""
    return current.join(arrived.select("id"), "id", "left_semi")


def newest_present(current: DataFrame, arrived: DataFrame) -> DataFrame:
    """The newest arrival that still exists."""
    return arrived.join(current.select("id"), "id", "left_semi").orderBy(
        F.col("arrived_ms").desc(), F.col("id").asc()
    ).limit(1)


def event_log(quakes: DataFrame, alert_arrivals: DataFrame, rows: int = LOG_ROWS) -> DataFrame:
    """Quakes by occurrence time and alerts by arrival time, newest first; quakes first on ties."""
    q = quakes.select(
        F.lit("quake").alias("kind"), epoch_ms("occurred_at").alias("sort_ms"), F.col("id").cast("string").alias("id")
    )
    a = alert_arrivals.select(
        F.lit("alert").alias("kind"), F.col("arrived_ms").alias("sort_ms"), F.col("id").cast("string").alias("id")
    )
    return (
        q.unionByName(a)
        .orderBy(F.col("sort_ms").desc(), F.col("kind").desc(), F.col("id").asc())
        .limit(rows)
    )
