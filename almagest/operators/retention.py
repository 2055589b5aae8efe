"""Vacuum of append-only tables that readers and pins may still be using."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.operators.keys import first_per_key
from almagest.operators.latest import LatestTable
from almagest.operators.slots import SLOT_KEY, SlotTable
from almagest.schema import DAY_MS, HOUR_MS, SLOT_DAYS, STAGING_HOURS
from almagest.session import read_table, work_root

GENERATION = ["layer", "dt", "slot", "generation", "publish_id"]
#: A file that stopped being current may be in use by a reader that started before.
GRACE_MS = 6 * HOUR_MS


def _delete(spark: SparkSession, paths: list[str]) -> int:
    """Delete files or folders through the cluster's file system; one that is gone is no error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    deleted = 0
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        deleted += bool(at.getFileSystem(conf).delete(at, True))
    return deleted


def _folders(spark: SparkSession, root: str, depth: int) -> list[str]:
    """Folders `depth` levels below the root; none if the root is not there."""
    conf = spark._jsc.hadoopConfiguration()
    found = [root]
    for _ in range(depth):
        below = []
        for path in found:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = at.getFileSystem(conf)
            if fs.exists(at):
                below += [s.getPath().toString() for s in fs.listStatus(at) if s.isDirectory()]
        found = below
    return found


def _value(path: str, name: str) -> str | None:
    """Value of a partition column in a folder's path."""
    for step in path.split("/"):
        if step.startswith(f"{name}="):
            return unquote(step[len(name) + 1 :])
    return None


@dataclass(frozen=True)
class Pins:
    """Copies by name: a pin names generations of slots, and vacuum leaves those alone.

    Nothing is copied. A pin is rows (pin_id, layer, dt, slot, generation, publish_id) in an
    append-only table; the last state of a pin is its newest row set or its removal, and a
    generation is kept as long as one pin that has not been removed names it.
    """

    table: SlotTable

    @property
    def path(self) -> str:
        return f"{self.table.root}/pins"

    def rows(self) -> DataFrame | None:
        """The generations of all pins that stand."""
        rows = read_table(self.table.spark, self.path, [])
        if rows is None:
            return None
        last = first_per_key(rows.select("pin_id", "pinned_at", "state").distinct(), ["pin_id"], [F.col("pinned_at").desc(), F.col("state").asc()])
        standing = last.where("state = 'pinned'").select("pin_id", "pinned_at")
        return rows.where("state = 'pinned'").join(standing, ["pin_id", "pinned_at"], "left_semi").drop("state", "pinned_at")

    def pin(self, pin_id: str, layers: list[str], from_slot: int, to_slot: int, at_ms: int) -> None:
        """Pin the current generation of all slots of the layers in [from_slot, to_slot)."""
        current = self.table.pointers()
        if current is None:
            raise ValueError("nothing is published")
        chosen = current.where(F.col("layer").isin(layers) & (F.col("slot") >= from_slot) & (F.col("slot") < to_slot))
        self._write(chosen.select(F.lit(pin_id).alias("pin_id"), *GENERATION), "pinned", at_ms)

    def unpin(self, pin_id: str, at_ms: int) -> None:
        empty = "layer string, dt string, slot bigint, generation bigint, publish_id string"
        row = self.table.spark.createDataFrame([(None,) * 5], empty)
        self._write(row.select(F.lit(pin_id).alias("pin_id"), *GENERATION), "removed", at_ms)

    def _write(self, rows: DataFrame, state: str, at_ms: int) -> None:
        stamped = rows.withColumns({"state": F.lit(state), "pinned_at": F.timestamp_millis(F.lit(at_ms))})
        stamped.write.mode("append").parquet(self.path)

    def read(self, pin_id: str) -> DataFrame | None:
        """Records of a pin, as they were when it was made."""
        pins, bodies = self.rows(), read_table(self.table.spark, self.table.bodies_path, ["layer", "dt"])
        if pins is None or bodies is None:
            return None
        return SlotTable._of(bodies, pins.where(F.col("pin_id") == pin_id))


def vacuum_slots(table: SlotTable, now_ms: int, days: int = SLOT_DAYS, grace_ms: int = GRACE_MS) -> int:
    """Delete body files that no reader can want any more; the number of files.

    A file is wanted while it holds a generation that is current and younger than `days`, that
    a pin names, that was superseded less than `grace_ms` ago, or that belongs to a publish
    not finished yet (no manifest row, and the file younger than `grace_ms`). Each publish
    writes files of its own, so superseded generations leave whole files. The manifest keeps
    its rows: it tells what there was. Which files go is found by one scan of four columns;
    only their names reach the driver.
    """
    spark = table.spark
    bodies, manifest = read_table(spark, table.bodies_path, ["layer", "dt"]), table.manifest()
    if bodies is None:
        return 0
    held = bodies.select(*GENERATION, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed")).distinct()
    recent = F.timestamp_millis(F.lit(now_ms - grace_ms))
    oldest = F.date_format(F.timestamp_millis(F.lit(now_ms - days * DAY_MS)), "yyyy-MM-dd")
    if manifest is None:
        wanted = held.withColumn("keep", F.col("changed") > recent)
    else:
        after = Window.partitionBy("dt", *SLOT_KEY).orderBy("generation", "written_at")
        until = manifest.select(*GENERATION, F.lead("written_at").over(after).alias("until"))
        keep = F.when(F.col("listed").isNull(), F.col("changed") > recent).otherwise(
            (F.col("until").isNull() & (F.col("dt") >= oldest)) | (F.col("until") > recent)
        )
        wanted = held.join(until.withColumn("listed", F.lit(True)), GENERATION, "left").withColumn("keep", F.coalesce(keep, F.lit(False)))
    pins = Pins(table).rows()
    if pins is not None:
        pinned = pins.select(*GENERATION).distinct().withColumn("pinned", F.lit(True))
        wanted = wanted.join(pinned, GENERATION, "left").withColumn("keep", F.col("keep") | F.coalesce("pinned", F.lit(False)))
    unused = wanted.groupBy("file").agg(F.bool_or("keep").alias("keep")).where(~F.col("keep"))
    # the file's column is an URI
    return _delete(spark, [unquote(r.file) for r in unused.select("file").collect()])


def vacuum_latest(table: LatestTable, now_ms: int, grace_ms: int = GRACE_MS) -> int:
    """Delete the folders of snapshots that were replaced more than `grace_ms` ago; their number.

    Folders without a header belong to a publish that died or still runs: they go by their age.
    """
    spark = table.spark
    folders = _folders(spark, table.records_path, 2)
    rows = read_table(spark, table.headers_path, [])
    if not folders:
        return 0
    known: dict[tuple[str, str], bool] = {}
    if rows is not None:
        current = table.headers().select("part", "publish_id", F.col("uploaded_at").alias("current_at"))
        by_part = current.select("part", F.col("publish_id").alias("current_id"), "current_at")
        told = rows.join(by_part, "part").select(
            F.col("part").cast("string"), "publish_id", ((F.col("publish_id") == F.col("current_id")) | (F.col("current_at") > F.timestamp_millis(F.lit(now_ms - grace_ms)))).alias("keep")
        )
        known = {(r[0], r[1]): r[2] for r in told.collect()}  # one row per folder
    old = []
    conf = spark._jsc.hadoopConfiguration()
    for folder in folders:
        name = (_value(folder, "part"), _value(folder, "publish_id"))
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        changed = at.getFileSystem(conf).getFileStatus(at).getModificationTime()
        if not known.get(name, changed > now_ms - grace_ms):
            old.append(folder)
    return _delete(spark, old)


def vacuum_staging(spark: SparkSession, root: str, now_ms: int, hours: int = STAGING_HOURS) -> int:
    """Delete staged cycles (seconds since 1970) that started too long ago to be finished; the number of folders.

    A folder holds the cycles of one hour and goes when all of that hour is too long ago.
    """
    folders = [f for name in ("records", "pages") for f in _folders(spark, f"{root}/staging/{name}", 1)]
    old = [f for f in folders if (h := _value(f, "cycle_hour")) is not None and h.lstrip("-").isdigit() and (int(h) + 1) * HOUR_MS <= now_ms - hours * HOUR_MS]
    return _delete(spark, old)


def vacuum_work(spark: SparkSession, now_ms: int, age_ms: int = DAY_MS) -> int:
    """Delete the intermediate tables of jobs that began more than `age_ms` ago; their number.

    Only folders with names that `session.shared_dir` gives are looked at. Jobs that run
    longer than that need a larger age.
    """
    conf, old = spark._jsc.hadoopConfiguration(), []
    for folder in _folders(spark, work_root(spark), 1):
        if re.fullmatch(r"[a-z0-9-]+-[0-9a-f]{32}", folder.rsplit("/", 1)[-1]):
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if at.getFileSystem(conf).getFileStatus(at).getModificationTime() < now_ms - age_ms:
                old.append(folder)
    return _delete(spark, old)


def vacuum_dates(spark: SparkSession, root: str, now_ms: int, days: int) -> int:
    """Delete date folders (dt=yyyy-MM-dd) right below the root that are older than `days`."""
    limit = spark.range(1).select(F.date_format(F.timestamp_millis(F.lit(now_ms - days * DAY_MS)), "yyyy-MM-dd")).first()[0]
    return _delete(spark, [f for f in _folders(spark, root, 1) if (_value(f, "dt") or limit) < limit])
