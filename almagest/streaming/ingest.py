"""Continuous ingest: landed documents to slots, latest headers and the status ledger."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

from almagest.functions.scalars import date_of_slot, slot_of
from almagest.operators.arrivals import arrivals
from almagest.operators.keys import first_per_key
from almagest.operators.latest import LatestTable
from almagest.operators.merge import BY_REVISION
from almagest.operators.slots import SlotTable, commit_window, with_slot
from almagest.session import read_table
from almagest.sources import feeds


def numbered_documents(docs: DataFrame, container: str) -> DataFrame:
    """Documents with outcome, elements, doc_no and seq_base, in the order of landing time and then path.

    A second has a range of 2**32 numbers of its own. Documents that landed in it are laid out
    one after the other by how many elements they hold, so no two elements share an
    arrival_seq, however many documents or elements there are. Only paths, times and sizes
    are ordered, one second at a time.
    """
    sizes = feeds.document_status(docs, container, ["path", "landed_at"]).withColumn("second", F.unix_seconds("landed_at"))
    before = Window.partitionBy("second").orderBy("landed_at", "path").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("second") * F.lit(1 << 32)
    held = F.coalesce(F.sum("elements").over(before), F.lit(0))
    order = sizes.select("path", "landed_at", "outcome", "elements", (base + F.count("path").over(before)).alias("doc_no"), (base + held).alias("seq_base"))
    return docs.join(order, ["path", "landed_at"])


@dataclass(frozen=True)
class Ingest:
    """One feed's job. Each micro-batch is safe to repeat.

    Slots: publishing the same content again changes nothing. Latest: a snapshot is
    only replaced by a strictly newer one. Ledger: a batch writes to a folder of its own
    number and so replaces itself. A document that fails is recorded and left
    out; it never touches other documents' data.

    `prepare` adds to the documents (path, body, landed_at) what the normalizer needs and
    what tells snapshots apart: `part` (a region, say; default: the layer), `as_of` (the
    time of the cycle or file; default: landing), `scheduled_at` (default: as_of).
    Documents of one part with the same as_of are pages of one snapshot. Records whose own
    time says nothing about their slot (intervals, file rows) take the document's:
    `time_column="ingested_at"`.
    """

    spark: SparkSession
    root: str
    layer: str
    container: str
    normalize: Callable[[DataFrame], DataFrame]
    rule: tuple[str, ...] = tuple(BY_REVISION)
    time_column: str = "occurred_at"
    prepare: Callable[[DataFrame], DataFrame] | None = None

    @property
    def table(self) -> SlotTable:
        return SlotTable(self.spark, f"{self.root}/slots")

    @property
    def snapshot(self) -> LatestTable:
        return LatestTable(self.spark, f"{self.root}/latest")

    def _save(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/n={batch_id}")

    def _prepared(self, docs: DataFrame) -> DataFrame:
        docs = numbered_documents(docs, self.container)
        docs = self.prepare(docs) if self.prepare else docs
        defaults = {"part": F.lit(self.layer), "as_of": F.col("landed_at")}
        docs = docs.withColumns({c: v for c, v in defaults.items() if c not in docs.columns})
        if "scheduled_at" not in docs.columns:
            docs = docs.withColumn("scheduled_at", F.col("as_of"))
        return docs.withColumn("ingested_at", F.col("as_of"))

    def batch(self, docs: DataFrame, batch_id: int) -> None:
        """`docs` has path, body, landed_at."""
        docs = self._prepared(docs).persist()
        rows = self.normalize(docs).join(docs.select("doc_no", "part", "as_of"), "doc_no").persist()
        try:
            outcomes = docs.select("path", "landed_at", "part", "as_of", "doc_no", "outcome", "elements")
            counts = rows.groupBy("doc_no").agg(
                F.count_if(F.col("verdict") == feeds.DROPPED).alias("dropped"), F.count_if(F.col("verdict") == feeds.SKIPPED).alias("skipped")
            )
            told = outcomes.join(counts, "doc_no", "left").na.fill(0, ["dropped", "skipped"])
            status = told.where((F.col("outcome") != "ok") | (F.col("dropped") > 0)).select(
                F.lit(self.layer).alias("layer"), slot_of("landed_at").alias("slot"), "landed_at", "path",
                F.when((F.col("outcome") == "ok") & (F.col("dropped") > 0), "partial").otherwise(F.col("outcome")).alias("outcome"),
                "elements", "dropped", "skipped",
            )
            self._save(status, "status", batch_id)
            own = rows.where(F.col("verdict") == feeds.OK).drop("verdict", "doc_no")
            records = own.drop("part", "as_of")
            placed = commit_window(with_slot(records, self.time_column), F.unix_seconds("ingested_at"))
            dropped = rows.agg(F.count_if(F.col("verdict") == feeds.DROPPED).alias("n")).first().n
            self.table.publish(placed.where("committed").drop("committed"), list(self.rule), dropped=dropped)
            header = outcomes.where(F.col("outcome") != "failed").groupBy("part").agg(F.max("as_of").alias("as_of"))
            # A part's snapshot is all pages of its newest cycle, each id once.
            newest = own.join(header, ["part", "as_of"], "left_semi").drop("as_of")
            newest = first_per_key(newest, ["part", "id"], [F.col("revision").desc(), F.col("arrival_seq").desc()])
            self.snapshot.publish(newest, header)
            late = placed.agg(
                F.count_if("committed").alias("committed"), F.count_if(~F.col("committed")).alias("too_late")
            )
            self._save(late, "lateness", batch_id)
        finally:
            rows.unpersist()
            docs.unpersist()

    def start(self, docs: DataFrame, checkpoint: str) -> StreamingQuery:
        """Process everything that has landed; call again (or on a schedule) for the rest."""
        return (
            docs.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(self.batch)
            .trigger(availableNow=True)
            .start()
        )

    def status(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/status").withColumn("dt", date_of_slot("slot"))


@dataclass(frozen=True)
class ArrivalLog:
    """Arrivals across successive snapshots, one snapshot per micro-batch."""

    spark: SparkSession
    root: str

    def _snapshot(self, batch_id: int) -> DataFrame | None:
        return read_table(self.spark, f"{self.root}/snapshots/n={batch_id}", [])

    def batch(self, snapshot: DataFrame, batch_id: int, arrived_ms: int) -> None:
        """`snapshot` has id. The first snapshot is backfill and brings no arrivals."""
        snapshot.select("id").write.mode("overwrite").parquet(f"{self.root}/snapshots/n={batch_id}")
        current = self._snapshot(batch_id)
        fresh = arrivals(self._snapshot(batch_id - 1), current, F.lit(arrived_ms).cast("bigint"))
        fresh.write.mode("overwrite").parquet(f"{self.root}/arrivals/n={batch_id}")

    def arrivals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/arrivals").drop("n")


def first_in_bucket(samples: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Stream of samples to the first per (entity, bucket); state ends with the watermark.

    For the last one per bucket use features.bucket_samples on the stored table.
    """
    bucket = F.window("sampled_at", "180 seconds")["start"]
    return (
        samples.withColumn("bucket", bucket)
        .withWatermark("sampled_at", delay)
        .dropDuplicatesWithinWatermark(["entity_id", "bucket"])
    )
