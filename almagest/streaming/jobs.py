"""Structured Streaming jobs over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from almagest.operators.keys import first_per_key
from almagest.operators.ledger import poll_summary
from almagest.operators.slots import commit_window, with_slot
from almagest.schema import SLOT_SEC


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A parquet table (or glob) in a folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_updates(updates: DataFrame, work: str) -> StreamingQuery:
    """Run an updating aggregation over everything that is there, keeping each batch's updates.

    A batch writes to a folder of its own number, so a repeated batch replaces itself.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{work}/updates/n={batch_id}"
        )

    running = (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", f"{work}/checkpoint")
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return running


def current_rows(spark: SparkSession, work: str, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    rows = spark.read.parquet(f"{work}/updates").drop("n")
    return first_per_key(rows, keys, [F.col("batch").desc()]).drop("batch")


def slot_counts(spark: SparkSession, folder: str, name: str, work: str, width_sec: int = SLOT_SEC) -> DataFrame:
    """Tumbling slots over the event stream: count and value sum per slot.

    State is one row per slot, so it grows with time and not with events.
    """
    events = stream_table(spark, folder, name)
    slot = F.window(F.col("ts").cast("timestamp"), f"{width_sec} seconds")
    updates = (
        events.groupBy(slot.alias("w"))
        .agg(F.count(F.lit(1)).alias("records"), F.max("value").alias("max_value"))
        .select(F.unix_seconds("w.start").alias("slot"), "records", "max_value")
    )
    run_updates(updates, work)
    return current_rows(spark, work, ["slot"])


def poll_summary_stream(polls: DataFrame, work: str) -> DataFrame:
    """The freshness summary per layer, kept up to date from a stream of poll events.

    The rule needs only maxima, so the built-in aggregation carries it: partial
    aggregates are made where the events are, and state is one row per layer.
    """
    run_updates(poll_summary(polls), work)
    return current_rows(polls.sparkSession, work, ["layer"])


def bounded_slot_counts(events: DataFrame, work: str, at: str = "ts", landed: str = "landed_at", width_sec: int = SLOT_SEC) -> tuple[StreamingQuery, StreamingQuery]:
    """Tumbling slots with state that ends, and late rows counted beside them.

    A row is on time if its slot is the current or the previous one when it lands; the
    others go to a side output, counted by the slot in which they landed. Both streams have a
    watermark of two slots behind, on the event time and on the landing time: no row that
    is on time comes after it, as events do not lie in the future, and slots that it
    has passed leave the state. Updates are kept per batch: see `current_rows` on
    work/slots (slot) and work/late (slot).
    """
    bound = f"{2 * width_sec} seconds"
    event, arrival = F.col(at).cast("timestamp"), F.col(landed).cast("timestamp")
    timed = events.withColumns({at: event, landed: arrival}).where(F.col(at).isNotNull() & F.col(landed).isNotNull())
    placed = commit_window(with_slot(timed, at, width_sec), F.unix_seconds(landed), width_sec)

    def counted(rows: DataFrame, time: str, name: str) -> StreamingQuery:
        slot = F.window(time, f"{width_sec} seconds")
        updates = rows.withWatermark(time, bound).groupBy(slot.alias("w")).agg(F.count(F.lit(1)).alias("records"))
        return run_updates(updates.select(F.unix_seconds("w.start").alias("slot"), "records"), f"{work}/{name}")

    return counted(placed.where("committed"), at, "slots"), counted(placed.where("NOT committed"), landed, "late")
