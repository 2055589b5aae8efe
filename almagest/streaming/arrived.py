"""Arrivals across successive snapshots as a stream: first-seen state, and boards of the newest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from almagest.schema import ARRIVAL_LIFE_MS, ARRIVAL_LIMITS, DAY_MS
from almagest.session import read_table
from almagest.streaming.state import STATE_PROVIDER


class FirstSeen(StatefulProcessor):
    """Sightings of one (layer, id) in numbered snapshots; out goes each arrival.

    An id arrives in a snapshot if the one before did not have it. Snapshot 0 is backfill.
    State is one number per id, and goes when the id has not been seen for `keep_ms`.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "snapshot bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0] if self.seen.exists() else None
        # A snapshot has an id once or a few times; a batch holds as many snapshots as the trigger lets in.
        batch = pd.concat(list(rows)).groupby("snapshot", as_index=False)["at_ms"].min().sort_values("snapshot")
        found = []
        for snapshot, at in zip(batch["snapshot"].tolist(), batch["at_ms"].tolist(), strict=True):
            if last is not None and snapshot <= last:
                continue
            if snapshot > 0 and (last is None or last < snapshot - 1):
                found.append(at)
            last = snapshot
        if last is not None:
            self.seen.update((int(last),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(batch["at_ms"].max()) + self.keep_ms)
        if found:
            yield pd.DataFrame({"layer": key[0], "id": key[1], "arrived_ms": found})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def arrival_stream(sightings: DataFrame, keep_ms: int = DAY_MS, delay: str = "1 hour") -> DataFrame:
    """(layer, id, arrived_ms) of a stream of sightings (layer, id, snapshot, at).

    `snapshot` numbers a layer's snapshots from 0 without gaps; `keep_ms` must be longer than
    two snapshots are apart. Ids are spread over all tasks, so no layer is one task's work.
    """
    sightings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    rows = sightings.where("layer IS NOT NULL AND id IS NOT NULL AND snapshot IS NOT NULL AND at IS NOT NULL").select(
        "layer", F.col("id").cast("string").alias("id"), F.col("snapshot").cast("bigint").alias("snapshot"),
        F.col("at").cast("timestamp").alias("at"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"),
    )
    return rows.withWatermark("at", delay).groupBy("layer", "id").transformWithStateInPandas(
        statefulProcessor=FirstSeen(keep_ms),
        outputStructType="layer string, id string, arrived_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


@dataclass(frozen=True)
class ArrivalBoard:
    """The newest arrivals per layer, kept while a stream of arrivals runs.

    The newest n of everything are the newest n of the board before and the batch, so a
    board never has more than the limits. A batch writes its board to a folder of its own
    number from the board of the number before, so a repeated batch replaces itself.
    """

    spark: SparkSession
    root: str
    limits: dict[str, int]
    default_limit: int = ARRIVAL_LIMITS["weather"]

    def _limit(self) -> Column:
        pairs = [F.lit(x) for pair in self.limits.items() for x in pair]
        known = F.create_map(*pairs)[F.col("layer")] if pairs else F.lit(None).cast("int")
        return F.coalesce(known, F.lit(self.default_limit))

    def _newest(self, rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("layer").orderBy(F.col("arrived_ms").desc(), F.col("id"))
        most = max([self.default_limit, *self.limits.values()])
        # A plain bound first: every task then cuts its own rows before they are shuffled.
        ranked = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        return ranked.where(F.col("place") <= self._limit()).drop("place")

    def batch(self, arrived: DataFrame, batch_id: int) -> None:
        before = read_table(self.spark, f"{self.root}/boards/n={batch_id - 1}", []) if batch_id else None
        rows = arrived if before is None else arrived.unionByName(before)
        self._newest(rows).write.mode("overwrite").parquet(f"{self.root}/boards/n={batch_id}")

    def start(self, arrived: DataFrame) -> StreamingQuery:
        return (
            arrived.writeStream.option("checkpointLocation", f"{self.root}/checkpoint")
            .foreachBatch(self.batch)
            .trigger(availableNow=True)
            .start()
        )

    def last_batch(self) -> int:
        return self.spark.read.parquet(f"{self.root}/boards").agg(F.max(F.col("n").cast("bigint"))).first()[0]

    def read(self, batch_id: int, now_ms: int | None = None, life_ms: dict[str, int] | None = None) -> DataFrame:
        """The board after a batch; with a clock, without those older than their layer's life time."""
        rows = self.spark.read.parquet(f"{self.root}/boards/n={batch_id}")
        if now_ms is None:
            return rows
        lives = {"earthquake": ARRIVAL_LIFE_MS} if life_ms is None else life_ms
        life = F.create_map(*[F.lit(x) for pair in lives.items() for x in pair])[F.col("layer")] if lives else F.lit(None).cast("bigint")
        return rows.where(life.isNull() | (F.lit(now_ms) - F.col("arrived_ms") < life))
