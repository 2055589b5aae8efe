"""Versioned 15-minute slots on plain parquet.

A slot table has three append-only parts below one root:

  bodies/    records, partitioned by layer and date, with slot, generation, publish_id
  manifest/  one row per published generation: hash and counts
  status/    ledger rows (see ledger.py)

The current generation of a slot is its highest manifest row; there is no separate
pointer to rewrite. Bodies are written before the manifest, and a reader joins on
publish_id too, so bodies of a job that died in between are never seen, and running
the job again publishes the same slots cleanly. One writer per layer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.functions.scalars import date_of_slot, digest_lanes, row_digest, slot_of, slot_of_seconds
from almagest.operators.keys import first_per_key
from almagest.operators.merge import BY_REVISION, merge
from almagest.schema import SLOT_SEC, STAGING_HOURS
from almagest.session import read_table

SLOT_KEY = ["layer", "slot"]
NOT_CONTENT = {"ingested_at", "generation", "publish_id", "dt", "slot", "layer", "slot_duration_sec", "arrival_seq"}


def with_slot(df: DataFrame, at: str = "occurred_at", width_sec: int = SLOT_SEC) -> DataFrame:
    return df.withColumns({"slot": slot_of(at, width_sec), "slot_duration_sec": F.lit(width_sec)})


def commit_window(df: DataFrame, scheduled_sec: Column, width_sec: int = SLOT_SEC) -> DataFrame:
    """Mark rows of the current and the previous slot; everything older is too late to write."""
    current = slot_of_seconds(scheduled_sec, width_sec)
    return df.withColumn("committed", F.col("slot").isin(current, current - width_sec))


def rebucket(df: DataFrame, width_sec: int = SLOT_SEC) -> DataFrame:
    """Bring slots of any stored width to one width; the stored width is authoritative."""
    return df.withColumns(
        {"slot": slot_of_seconds(F.col("slot"), width_sec), "stored_width_sec": F.col("slot_duration_sec")}
    ).withColumn("slot_duration_sec", F.lit(width_sec))


def fingerprint(df: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Content hash and record count per group.

    Equal groups give equal hashes in any row order. Only sums travel in the shuffle:
    a group that holds a third of all rows is summed where its rows are.
    """
    lanes = digest_lanes("__digest")
    names = [f"lane{i}" for i in range(len(lanes))]
    sums = (
        df.select(*keys, row_digest(content).alias("__digest"))
        .select(*keys, *lanes)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("records"), *[F.sum(F.col(n).cast("decimal(20,0)")).alias(n) for n in names])
    )
    return sums.select(*keys, "records", F.sha2(F.concat_ws(":", "records", *names), 256).alias("hash"))


def same_content(left: DataFrame, right: DataFrame, content: list[str]) -> DataFrame:
    """One row: whether two record sets are the same set."""
    both = fingerprint(
        left.select(F.lit(0).alias("side"), *content).unionByName(right.select(F.lit(1).alias("side"), *content)),
        ["side"],
        content,
    )
    # No row for an empty set: two empty sets are the same, one empty set is not.
    return both.agg(((F.count(F.lit(1)) != 1) & (F.count_distinct("hash") <= 1)).alias("same"))


def changed_slots(before: DataFrame, after: DataFrame, carry: dict[str, str] | None = None) -> DataFrame:
    """Fingerprints of `after` whose hash differs from the one published.

    `carry` names columns of `before` to bring along, under new names.
    """
    extra = [F.col(old).alias(new) for old, new in (carry or {}).items()]
    known = before.select(*SLOT_KEY, F.col("hash").alias("old_hash"), *extra)
    return (
        after.join(known, SLOT_KEY, "left")
        .where(~F.col("hash").eqNullSafe(F.col("old_hash")))
        .drop("old_hash")
    )


@dataclass(frozen=True)
class SlotTable:
    spark: SparkSession
    root: str

    @property
    def bodies_path(self) -> str:
        return f"{self.root}/bodies"

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/manifest"

    def _read(self, path: str) -> DataFrame | None:
        return read_table(self.spark, path, ["layer", "dt"])

    def manifest(self) -> DataFrame | None:
        """Every published generation."""
        return self._read(self.manifest_path)

    def pointers(self, dt: str | list[str] | None = None) -> DataFrame | None:
        """Current generation per slot; with dates, only those partitions are read.

        A slot lies in one date, so its generations are ranked within the date.
        """
        manifest = self.manifest()
        if manifest is None:
            return None
        if dt is not None:
            manifest = manifest.where(F.col("dt").isin([dt] if isinstance(dt, str) else dt))
        return first_per_key(manifest, ["dt", *SLOT_KEY], [F.col("generation").desc()])

    def read(self, layer: str | None = None, generation: int | None = None, known_at_ms: int | None = None) -> DataFrame | None:
        """Records of the current generation, of a pinned one, or as known at a time."""
        bodies, manifest = self._read(self.bodies_path), self.manifest()
        if bodies is None or manifest is None:
            return None
        if layer:
            bodies, manifest = bodies.where(F.col("layer") == layer), manifest.where(F.col("layer") == layer)
        if known_at_ms is not None:
            manifest = manifest.where(F.col("written_at") <= F.timestamp_millis(F.lit(known_at_ms)))
        if generation is not None:
            wanted = manifest.where(F.col("generation") == generation)
        else:
            wanted = first_per_key(manifest, SLOT_KEY, [F.col("generation").desc()])
        return self._of(bodies, wanted)

    @staticmethod
    def _of(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
        """Bodies of the wanted manifest rows; layer and date prune folders while joining."""
        key = ["layer", "dt", "slot", "generation", "publish_id"]
        return bodies.join(wanted.select(*key), key, "left_semi")

    def publish(
        self,
        incoming: DataFrame,
        rule: list[str] = BY_REVISION,
        ties: list[str] | None = None,
        dropped: int = 0,
        at_ms: int | None = None,
    ) -> DataFrame:
        """Merge incoming records into their slots and publish the slots that changed.

        `incoming` needs layer, slot, id, revision and arrival_seq. Only slots named by
        the incoming rows are read back. A slot whose content hash stays the same is
        not written. Returns the new manifest rows.
        """
        publish_id = uuid.uuid4().hex
        incoming = incoming.withColumn("dt", date_of_slot("slot"))
        content = sorted(set(incoming.columns) - NOT_CONTENT)
        # Their dates, at most one per folder of the table, prune what is read of it.
        dates = [r.dt for r in incoming.select("dt").distinct().collect()]
        bodies = self._read(self.bodies_path) if dates else None
        pointers = self.pointers(dates) if dates else None
        if bodies is None or pointers is None:
            merged = merge(incoming.limit(0), incoming, rule, [*SLOT_KEY, "id"], ties)
            pointers = self.spark.createDataFrame(
                [], "layer string, slot bigint, generation bigint, hash string"
            )
        else:
            # The manifest is cut to the touched slots before anything of it is ranked.
            touched = incoming.select("dt", *SLOT_KEY).distinct()
            rows = self.manifest().where(F.col("dt").isin(dates)).join(touched, ["dt", *SLOT_KEY], "left_semi")
            pointers = first_per_key(rows, ["dt", *SLOT_KEY], [F.col("generation").desc()])
            existing = self._of(bodies.where(F.col("dt").isin(dates)), pointers).drop("generation", "publish_id")
            merged = merge(existing, incoming, rule, [*SLOT_KEY, "id"], ties)
        # Used twice: once for the hashes, once for the rows to write.
        merged = merged.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            hashes = fingerprint(merged, SLOT_KEY, content)
            counts = incoming.groupBy(*SLOT_KEY).agg(F.count(F.lit(1)).alias("incoming"))
            fresh = (
                changed_slots(pointers, hashes, carry={"generation": "old_generation"})
                .join(counts, SLOT_KEY, "left")
                .select(
                    "layer",
                    date_of_slot("slot").alias("dt"),
                    "slot",
                    (F.coalesce("old_generation", F.lit(-1)) + 1).cast("bigint").alias("generation"),
                    "hash",
                    "records",
                    F.coalesce("incoming", F.lit(0)).cast("bigint").alias("incoming"),
                    F.lit(dropped).cast("bigint").alias("dropped"),
                    F.lit(publish_id).alias("publish_id"),
                    (F.timestamp_millis(F.lit(at_ms)) if at_ms is not None else F.current_timestamp()).alias("written_at"),
                )
                .persist(StorageLevel.MEMORY_AND_DISK)
            )
            try:
                changed = merged.join(
                    fresh.select("layer", "dt", "slot", "generation", "publish_id"), ["layer", "dt", "slot"]
                )
                # Rebalance: one date's rows meet in few files, and a hot date is still split.
                changed.hint("rebalance", "layer", "dt").write.partitionBy("layer", "dt").mode("append").parquet(self.bodies_path)
                fresh.write.partitionBy("layer", "dt").mode("append").parquet(self.manifest_path)
            finally:
                fresh.unpersist()
        finally:
            merged.unpersist()
        published = self.manifest()
        if published is None:  # nothing was ever written: no row, but the same columns
            return self.spark.createDataFrame([], fresh.schema)
        return published.where(F.col("publish_id") == publish_id)


def retained(df: DataFrame, date: str, now_ms: int, days: int) -> DataFrame:
    """Rows young enough to keep; `date` is a partition column, so old files are not opened."""
    oldest = F.date_format(F.timestamp_millis(F.lit(now_ms - days * 86_400_000)), "yyyy-MM-dd")
    return df.where(F.col(date) >= oldest)


def abandoned_cycles(staged: DataFrame, cycle_ms: str, now_ms: int, hours: int = STAGING_HOURS) -> DataFrame:
    """Staged rows of cycles that started too long ago to be finished."""
    return staged.where(F.col(cycle_ms) < now_ms - hours * 3_600_000)


def gaps(manifest: DataFrame, layer: str, from_slot: int, to_slot: int, width_sec: int = SLOT_SEC) -> DataFrame:
    """Slots without a published generation, as ranges per day: (dt, gap_from, gap_to, slots).

    Ranges are closed at midnight, so the window that finds them sees one day of slots.
    """
    expected = manifest.sparkSession.range(from_slot, to_slot, width_sec).withColumnRenamed("id", "slot")
    present = manifest.where(F.col("layer") == layer).select("slot").distinct()
    missing = expected.join(present, "slot", "left_anti").withColumn("dt", date_of_slot("slot"))
    island = F.col("slot") - F.row_number().over(Window.partitionBy("dt").orderBy("slot")) * width_sec
    return (
        missing.withColumn("island", island)
        .groupBy("dt", "island")
        .agg(F.min("slot").alias("gap_from"), F.max("slot").alias("gap_to"), F.count(F.lit(1)).alias("slots"))
        .drop("island")
    )
