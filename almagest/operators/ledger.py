"""Ledger jobs: attempts, page progress, gates, freshness, capacity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.functions.scalars import date_of_slot
from almagest.operators.keys import numbered
from almagest.schema import (
    ALERT_RANK,
    BUDGET_SHARE,
    CAPACITY_LIMIT_BYTES,
    DAILY_BUDGET,
    PAGE_CAP,
    PAGE_SIZE,
    PAGES_PER_CYCLE,
    STALE_AFTER_MS,
)
from almagest.session import read_table

LEVELS = list(ALERT_RANK)


# --- status ledger -------------------------------------------------------------------


def attempts(entries: DataFrame, keys: list[str], chunk: Column, order: list[Column]) -> DataFrame:
    """Number repeated entries of one ledger key from 0."""
    return numbered(entries, keys, chunk, order, "attempt")


LEDGER_KEY = ["layer", "slot", "scheduled_ms"]


def outcome_of(failed: Column, elements: Column, dropped: Column, capped: Column) -> Column:
    """What a ledger row says of an attempt; null for one that needs none, a whole success.

    failed: nothing usable came; empty: a good answer without elements; partial: some of
    them were dropped; degraded: a cap cut the answer short.
    """
    return (
        F.when(failed, "failed").when(capped, "degraded").when(elements == 0, "empty").when(dropped > 0, "partial")
    )


@dataclass(frozen=True)
class StatusLedger:
    """Attempts on append-only parquet, numbered from 0 per (layer, slot, scheduled_ms).

    A batch writes to a folder of its own number, so a repeated batch replaces itself and
    gives no new row. It goes on from the highest number that the batches before it have stored
    for its keys; only folders of their dates are read. One writer at a time.
    """

    spark: SparkSession
    root: str

    def rows(self) -> DataFrame | None:
        return read_table(self.spark, self.root, ["dt"])

    def append(self, entries: DataFrame, batch_id: int, order: list[Column]) -> DataFrame:
        """Number and store the entries of a batch; `order` tells repeated attempts of one batch apart."""
        # one text per key, in which a null is no value but a key like others
        key = F.to_json(F.struct(*LEDGER_KEY))
        entries = entries.withColumns({"dt": date_of_slot("slot"), "ledger_key": key}).persist()
        try:
            fresh = attempts(entries, ["ledger_key"], F.col("slot"), order)
            stored = self.rows()
            if stored is not None:
                # at most one date per folder of the table
                dates = [r.dt for r in entries.select("dt").distinct().collect()]
                before = stored.where(F.col("dt").isin(dates) & (F.col("batch") < batch_id))
                marks = before.groupBy(key.alias("ledger_key")).agg((F.max("attempt") + 1).alias("next"))
                fresh = fresh.join(marks, "ledger_key", "left")
                fresh = fresh.withColumn("attempt", F.col("attempt") + F.coalesce("next", F.lit(0))).drop("next")
            path = f"{self.root}/batch={batch_id}"
            fresh.drop("ledger_key").write.partitionBy("dt").mode("overwrite").parquet(path)
        finally:
            entries.unpersist()
        return self.rows().where(F.col("batch") == batch_id)


def revisit_gap(visits: DataFrame, key: str, ms: str, tolerance_ms: int, cycle_ms: int, chunk_ms: int) -> DataFrame:
    """Largest time between two visits of a key, with the step over the cycle end.

    Gaps inside a time chunk are found there; between chunks only each chunk's first
    and last visit matter, so a busy key is spread over its chunks.
    """
    cut = visits.select(key, ms, F.floor(F.col(ms) / chunk_ms).alias("chunk"))
    inside = Window.partitionBy(key, "chunk").orderBy(ms)
    per_chunk = (
        cut.withColumn("gap", F.col(ms) - F.lag(ms).over(inside))
        .groupBy(key, "chunk")
        .agg(F.max("gap").alias("gap"), F.min(ms).alias("lo"), F.max(ms).alias("hi"), F.count(F.lit(1)).alias("n"))
    )
    across = F.col("lo") - F.lag("hi").over(Window.partitionBy(key).orderBy("chunk"))
    out = (
        per_chunk.withColumn("gap", F.greatest("gap", across))
        .groupBy(key)
        .agg(
            F.max("gap").alias("gap"),
            (F.min("lo") + F.lit(cycle_ms) - F.max("hi")).alias("wrap"),
            F.sum("n").alias("visits"),
        )
    )
    return out.select(
        key, "visits", F.greatest("gap", "wrap").alias("max_gap_ms"),
        (F.greatest("gap", "wrap") < tolerance_ms).alias("within"),
    )


# --- collection cycles ----------------------------------------------------------------


def page_progress(pages: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """State per (cycle, level) from page statistics (cycle, level, page, features, current, failed).

    The last page decides: a short page or one without current alerts completes the
    level, the page cap cuts it. When the cycle's budget is used up, levels still
    pending are cut too.
    """
    named = F.array(*[F.lit(level) for level in levels])
    every = pages.select("cycle").distinct().withColumn("level", F.explode(named))
    stats = pages.groupBy("cycle", "level").agg(
        F.count_if(~F.col("failed")).alias("pages"),
        F.coalesce(F.sum(F.when(~F.col("failed"), F.col("current"))), F.lit(0)).alias("current"),
        F.max_by("features", F.when(~F.col("failed"), F.col("page"))).alias("last_features"),
        F.max_by("current", F.when(~F.col("failed"), F.col("page"))).alias("last_current"),
        F.max(F.when(~F.col("failed"), F.col("page"))).alias("last_page"),
        F.bool_or("failed").alias("any_failed"),
    )
    state = (
        F.when(F.coalesce("any_failed", F.lit(False)), "failed")
        .when(F.col("last_page").isNull(), "pending")
        .when(F.col("last_features") < PAGE_SIZE, "complete")
        .when(F.col("last_current") == 0, "complete")
        .when(F.col("last_page") >= PAGE_CAP, "capped")
        .otherwise("pending")
    )
    # At most one row per level and cycle reaches this window.
    used = F.sum("pages").over(Window.partitionBy("cycle"))
    return (
        every.join(stats, ["cycle", "level"], "left")
        .withColumns({"pages": F.coalesce("pages", F.lit(0)), "current": F.coalesce("current", F.lit(0)), "state": state})
        .withColumn("used", used)
        .withColumn(
            "state",
            F.when((F.col("state") == "pending") & (F.col("used") >= PAGES_PER_CYCLE), "capped").otherwise(F.col("state")),
        )
        .select("cycle", "level", "pages", "current", "state")
    )


def missing_chunks(progress: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages that the progress table promises and the staged chunks lack."""
    expected = progress.where(F.col("pages") > 0).select(
        "cycle", "level", F.explode_outer(F.sequence(F.lit(1).cast("bigint"), F.col("pages").cast("bigint"))).alias("page")
    )
    return expected.join(chunks.select("cycle", "level", "page"), ["cycle", "level", "page"], "left_anti")


def cycle_gate(progress: DataFrame, missing: DataFrame) -> DataFrame:
    """Per cycle: may it be published, and is it whole.

    Publish only when every level is complete or capped and no page is missing; a
    capped cycle is published but not ok.
    """
    lost = missing.groupBy("cycle").agg(F.count(F.lit(1)).alias("missing"))
    levels = progress.groupBy("cycle").agg(
        F.count_if(~F.col("state").isin("complete", "capped")).alias("unfinished"),
        F.count_if(F.col("state") == "capped").alias("capped"),
    )
    publish = (F.col("unfinished") == 0) & (F.col("missing") == 0)
    return (
        levels.join(lost, "cycle", "left")
        .withColumn("missing", F.coalesce("missing", F.lit(0)))
        .withColumns({"publish": publish, "ok": publish & (F.col("capped") == 0)})
    )


# --- freshness -----------------------------------------------------------------------


def poll_summary(polls: DataFrame) -> DataFrame:
    """What the freshness rule needs per layer, from a poll log (layer, at, as_of_ms, outcome).

    Only maxima, so it is the same job for a table and for a stream, and the handful
    of layers is reduced where the rows are.
    """
    good = F.col("outcome") == "ok"
    reached = F.col("outcome").isin("ok", "not_modified")
    return polls.groupBy("layer").agg(
        F.max(F.when(good, F.col("at"))).alias("last_ok"),
        F.max(F.when(good, F.struct("at", "as_of_ms")))["as_of_ms"].alias("as_of_ms"),
        F.max(F.when(reached, F.col("at"))).alias("last_success"),
        F.max(F.when(F.col("outcome") == "schema_error", F.col("at"))).alias("last_schema_error"),
        F.max(F.when(F.col("outcome") == "error", F.col("at"))).alias("last_error"),
        F.bool_or(F.col("outcome") == "loading").alias("loading"),
    )


def error_counts(polls: DataFrame, summary: DataFrame) -> DataFrame:
    """Consecutive errors per layer since the last success that cleared them.

    The summaries have one row per layer, however many layers there are; Spark sends
    them to the poll log if they are small and splits a hot layer if they are not.

    A good answer always clears; "not modified" clears only while no schema error is
    open. So of the rows after the last good answer, those before the first schema
    error may still clear.
    """
    since = polls.join(summary.select("layer", "last_ok"), "layer").where(
        F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok"))
    )
    broken = since.groupBy("layer").agg(
        F.min(F.when(F.col("outcome") == "schema_error", F.col("at"))).alias("broken_at")
    )
    marked = since.join(broken, "layer")
    clears = (F.col("outcome") == "not_modified") & (F.col("broken_at").isNull() | (F.col("at") < F.col("broken_at")))
    cleared = marked.groupBy("layer").agg(F.max(F.when(clears, F.col("at"))).alias("cleared_at"))
    left = marked.join(cleared, "layer").where(F.col("cleared_at").isNull() | (F.col("at") > F.col("cleared_at")))
    return left.groupBy("layer").agg(F.count_if(F.col("outcome").isin("error", "schema_error")).alias("error_count"))


def layer_status(
    summary: DataFrame,
    now_ms: int,
    thresholds: dict[str, int] = STALE_AFTER_MS,
    polled_layers: tuple[str, ...] = ("earthquake",),
) -> DataFrame:
    """Status per layer at `now`: ready, stale, error, loading or idle.

    A schema error holds until the next good answer. A plain error does not demote a
    layer that ever succeeded; only time does. Age counts from the last poll for
    layers polled directly, from the data's own time for the others.
    """
    limit = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("layer")]
    last_ms = F.unix_millis(F.col("last_success").cast("timestamp"))
    basis = F.when(F.col("layer").isin(*polled_layers), last_ms).otherwise(F.col("as_of_ms"))
    schema_failed = F.col("last_schema_error").isNotNull() & (
        F.col("last_ok").isNull() | (F.col("last_schema_error") > F.col("last_ok"))
    )
    status = (
        F.when(schema_failed, "error")
        .when(
            F.col("last_success").isNull(),
            F.when(F.col("last_error").isNotNull(), "error").when(F.col("loading"), "loading").otherwise("idle"),
        )
        .when(basis.isNotNull() & (F.lit(now_ms) - basis > limit), "stale")
        .otherwise("ready")
    )
    return summary.select(
        "layer", status.alias("status"), schema_failed.alias("schema_failed"), "as_of_ms", last_ms.alias("last_success_ms")
    )


def pulse(status: DataFrame) -> DataFrame:
    """One row: live when any layer is ready, stale when any ever succeeded, else standby."""
    return status.agg(
        F.when(F.bool_or(F.col("status") == "ready"), "live")
        .when(F.bool_or(F.col("last_success_ms").isNotNull()), "stale")
        .otherwise("standby")
        .alias("pulse")
    )


# --- capacity --------------------------------------------------------------------------


def usage(objects: DataFrame, prefix: str, size: str, limit_bytes: int = CAPACITY_LIMIT_BYTES) -> DataFrame:
    """Bytes and objects per prefix and in total (prefix null), with the over-limit flag."""
    return (
        objects.rollup(prefix)
        .agg(F.sum(size).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("objects"), F.grouping(prefix).alias("g"))
        .select(
            F.when(F.col("g") == 1, F.lit("(total)")).otherwise(F.col(prefix)).alias("prefix"),
            "bytes",
            "objects",
            F.when(F.col("g") == 1, F.col("bytes") > limit_bytes).alias("over_limit"),
        )
    )


def halt_rows(usage_rows: DataFrame) -> DataFrame:
    """The row that stops later jobs; empty while usage is within its limit."""
    return usage_rows.where(F.coalesce("over_limit", F.lit(False)))


def budget_flag(requests: DataFrame, budget: int = DAILY_BUDGET, share: float = BUDGET_SHARE) -> DataFrame:
    """Per date: relaxed when the requests exceed the share of the budget, else cleared.

    A count of null is a query that failed: the date's flag is "unchanged", whatever else is known.
    """
    state = F.when(F.col("unknown") > 0, "unchanged").when(F.col("requests") > F.lit(budget * share), "relaxed").otherwise("cleared")
    sums = requests.groupBy("date").agg(F.sum("requests").cast("bigint").alias("requests"), F.count_if(F.col("requests").isNull()).alias("unknown"))
    return sums.select("date", "requests", state.alias("state"))
