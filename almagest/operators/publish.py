"""Cycles of pages that are staged first and become visible only when they are whole."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.operators.keys import first_per_key
from almagest.operators.latest import LatestTable
from almagest.operators.ledger import cycle_gate, missing_chunks, page_progress
from almagest.session import read_table

PAGE_KEY = ["cycle", "level", "page"]
CYCLE_HOUR = "cycle_hour"
HOUR_SEC = 3600


@dataclass(frozen=True)
class GatedTable:
    """Staging, gate and latest snapshot of a source that is collected in cycles of pages.

    Append-only tables below one root:

      staging/records/cycle_hour=  records of the pages, staged as they come
      staging/pages/cycle_hour=    one row per page: features, current, failed
      decisions/decision=          one row per cycle that a publish decided on
      done/                        the decisions that were carried out

    A staging folder holds the cycles that began in one hour (cycles are seconds since 1970), so
    that neither files nor their listing grow with the number of cycles.

    and the latest snapshot (`LatestTable`) that readers see. A cycle passes when every level
    is complete or capped and each page it promises is staged. Of the passing cycles
    of a part the newest replaces the part's snapshot, if it is newer than that; a capped
    one does so too but is not ok. A withheld cycle leaves the older snapshot as it is,
    and is looked at again by the next publish, when more of its pages may be there.
    A halt row (see `ledger.halt_rows`) withholds everything.

    Records are written before the page rows that count them, and a decision counts once its
    snapshot is there. A job that dies in between is repeated without harm: the snapshot
    only moves to a newer time.
    """

    spark: SparkSession
    root: str

    @property
    def latest(self) -> LatestTable:
        return LatestTable(self.spark, f"{self.root}/latest")

    def _staged(self, name: str) -> DataFrame | None:
        found = read_table(self.spark, f"{self.root}/staging/{name}", [])
        if found is None:
            return None
        others = [c for c in found.columns if c not in ("cycle", CYCLE_HOUR)]
        return found.select(*others, F.col("cycle").cast("bigint").alias("cycle"))

    def stage(self, records: DataFrame, pages: DataFrame) -> None:
        """Add pages (cycle, level, page, features, current, failed) and their records.

        `records` has cycle, level, page, part, id and the payload. A page that is staged again
        counts once, with its last statistics; of its records each id counts once.
        """
        self._stage("records", records)
        self._stage("pages", pages.withColumn("staged_at", F.current_timestamp()))

    def _stage(self, name: str, rows: DataFrame) -> None:
        # Rebalance: an hour's rows meet in few files, and a large hour is still split.
        dated = rows.withColumn(CYCLE_HOUR, F.floor(F.col("cycle").cast("bigint") / HOUR_SEC))
        dated.hint("rebalance", CYCLE_HOUR).write.partitionBy(CYCLE_HOUR).mode("append").parquet(f"{self.root}/staging/{name}")

    def outcomes(self) -> DataFrame | None:
        """Every decision that was carried out."""
        rows, done = (read_table(self.spark, f"{self.root}/{name}", ["decision"]) for name in ("decisions", "done"))
        return None if rows is None or done is None else rows.join(done, "decision", "left_semi")

    def pending_pages(self) -> DataFrame | None:
        """Last statistics of the staged pages of cycles that are not published yet."""
        pages, done = self._staged("pages"), self.outcomes()
        if pages is None:
            return None
        if done is not None:
            pages = pages.join(done.where("publish").select("cycle").distinct(), "cycle", "left_anti")
        return first_per_key(pages, PAGE_KEY, [F.col("staged_at").desc(), F.col("failed").asc(), F.col("features").desc(), F.col("current").desc()])

    def decide(self, halt: DataFrame | None = None) -> DataFrame:
        """(cycle, unfinished, capped, missing, publish, ok, outcome) of the pending cycles.

        outcome: published, capped (published, not ok), withheld or halted.
        """
        pages = self.pending_pages()
        if pages is None:
            return self.spark.createDataFrame(
                [], "cycle bigint, unfinished bigint, capped bigint, missing bigint, publish boolean, ok boolean, outcome string"
            )
        progress = page_progress(pages)
        gate = cycle_gate(progress, missing_chunks(progress, self._present(pages)))
        halted = F.lit(halt is not None and not halt.isEmpty())
        passed = F.col("publish") & ~halted
        outcome = F.when(halted, "halted").when(~passed, "withheld").when(F.col("ok"), "published").otherwise("capped")
        return gate.withColumns({"outcome": outcome, "ok": F.col("ok") & passed, "publish": passed})

    def _present(self, pages: DataFrame) -> DataFrame:
        """Pages whose records are all there: as many as the page says."""
        told = pages.where(~F.col("failed")).select(*PAGE_KEY, "features")
        records = self._staged("records")
        if records is None:
            return told.where("features = 0")
        # the records of published cycles are not counted again
        held = records.join(told.select("cycle").distinct(), "cycle", "left_semi").groupBy(*PAGE_KEY).agg(F.count_distinct("id").alias("held"))
        return told.join(held, PAGE_KEY, "left").where(F.coalesce("held", F.lit(0)) >= F.col("features"))

    def publish(self, as_of: Column | None = None, halt: DataFrame | None = None) -> DataFrame:
        """Publish what may be published; the decisions on all pending cycles.

        `as_of` turns a cycle into its snapshot's time (default: seconds since 1970). Which
        cycles pass is decided once and kept before anything is read for the snapshot.
        """
        time = F.timestamp_seconds("cycle") if as_of is None else as_of
        decision = uuid.uuid4().hex
        path = f"{self.root}/decisions/decision={decision}"
        self.decide(halt).write.parquet(path)
        decided = self.spark.read.parquet(path)
        passing = decided.where("publish").select("cycle")
        records = self._staged("records")
        if records is not None and not passing.isEmpty():
            # One row per cycle and part tells the newest cycle of each part.
            parts = records.select("cycle", "part").distinct().join(passing, "cycle")
            newest = first_per_key(parts, ["part"], [F.col("cycle").desc()])
            own = first_per_key(records.join(newest, ["cycle", "part"], "left_semi"), ["part", "id"], [F.col("level").desc(), F.col("page").desc()])
            self.latest.publish(own, newest.select("part", time.alias("as_of")))
        self.spark.createDataFrame([(decision,)], "decision string").write.mode("append").parquet(f"{self.root}/done")
        return decided
