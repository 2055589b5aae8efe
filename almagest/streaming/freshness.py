"""Freshness of layers as a keyed stream: a layer turns stale by time alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from almagest.operators.keys import first_per_key
from almagest.schema import STALE_AFTER_MS
from almagest.streaming.state import STATE_PROVIDER

STATE = "status string, seq bigint, ok_us bigint, as_of bigint, success bigint, broken_us bigint, errored boolean, loading boolean"


@dataclass
class Freshness:
    """What is known of one layer, and its status at any later clock time.

    Only maxima are kept, so the order in which polls of the same time come does not matter.
    """

    limit_ms: int | None
    by_poll: bool  # age counts from the last successful poll, else from the data's own time
    status: str = "idle"
    seq: int = 0  # changes of status so far
    ok_us: int | None = None
    as_of: int | None = None  # of the last good answer
    success: int | None = None
    broken_us: int | None = None
    errored: bool = False
    loading: bool = False

    def poll(self, at_us: int, as_of: int | None, outcome: str) -> None:
        low = -(1 << 62)
        if outcome == "ok" and (at_us, low if as_of is None else as_of) >= (self.ok_us if self.ok_us is not None else low, self.as_of if self.as_of is not None else low):
            self.ok_us, self.as_of = at_us, as_of
        if outcome in ("ok", "not_modified"):
            self.success = max(at_us // 1000, low if self.success is None else self.success)
        elif outcome == "schema_error":
            self.broken_us = max(at_us, low if self.broken_us is None else self.broken_us)
        self.errored |= outcome == "error"
        self.loading |= outcome == "loading"

    @property
    def schema_failed(self) -> bool:
        return self.broken_us is not None and (self.ok_us is None or self.broken_us > self.ok_us)

    @property
    def due(self) -> int | None:
        """The first clock time at which the layer is stale if nothing more comes."""
        basis = self.success if self.by_poll else self.as_of
        return None if basis is None or self.limit_ms is None else basis + self.limit_ms + 1

    def status_at(self, now: int) -> str:
        if self.schema_failed:
            return "error"
        if self.success is None:
            return "error" if self.errored else "loading" if self.loading else "idle"
        return "stale" if self.due is not None and now >= self.due else "ready"

    def advance(self, now: int) -> str | None:
        """The new status at `now` if it is another one."""
        before, self.status = self.status, self.status_at(now)
        self.seq += self.status != before
        return self.status if self.status != before else None


class LayerFreshness(StatefulProcessor):
    """Polls of one layer in, changes of its status out; eight values of state and one timer.

    The timer stands at the time the layer will be stale. It fires without any event, in
    event time when the watermark passes it, in processing time when the clock does.
    """

    def __init__(self, limits: dict[str, int], by_poll: tuple[str, ...]) -> None:
        self.limits, self.by_poll = limits, by_poll

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("layer", STATE)

    def _load(self, layer: str) -> Freshness:
        known = self.saved.get() if self.saved.exists() else ()
        return Freshness(self.limits.get(layer), layer in self.by_poll, *known)

    def _save(self, s: Freshness) -> None:
        self.saved.update((s.status, s.seq, s.ok_us, s.as_of, s.success, s.broken_us, s.errored, s.loading))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s.status == "ready" and s.due is not None:
            self.handle.registerTimer(s.due)

    def _changes(self, layer: str, changes: list[tuple[int, int, str]]) -> Iterator[pd.DataFrame]:
        if changes:
            at, seq, status = zip(*changes, strict=True)
            yield pd.DataFrame({"layer": layer, "at_ms": at, "seq": seq, "status": status})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        layer, state = key[0], self._load(key[0])
        # Polls of one layer in one micro-batch, which the trigger bounds.
        batch = pd.concat(list(rows))
        batch = batch.sort_values("at_us", kind="stable")
        changes: list[tuple[int, int, str]] = []
        current: int | None = None

        def close(now: int) -> None:
            if (status := state.advance(now)) is not None:
                changes.append((now, state.seq, status))

        for at_us, as_of, outcome in zip(batch["at_us"], batch["as_of_ms"], batch["outcome"], strict=True):
            at = int(at_us) // 1000
            if current is not None and at != current:
                close(current)
            if at != current and state.status == "ready" and state.due is not None and state.due < at:
                close(state.due)
            current = at
            state.poll(int(at_us), None if pd.isna(as_of) else int(as_of), outcome)
        if current is not None:
            close(current)
        self._save(state)
        yield from self._changes(layer, changes)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, now = self._load(key[0]), expiredTimerInfo.getExpiryTimeInMs()
        status = state.advance(now)
        self._save(state)
        yield from self._changes(key[0], [(now, state.seq, status)] if status else [])

    def close(self) -> None:
        pass


def freshness_stream(
    polls: DataFrame, limits: dict[str, int] = STALE_AFTER_MS, by_poll: tuple[str, ...] = ("earthquake",),
    delay: str | None = "1 hour",
) -> DataFrame:
    """Changes of status (layer, at_ms, seq, status) of a stream of polls (layer, at, as_of_ms, outcome).

    With a delay, time is the polls' own: polls that come later than that are dropped, and
    a layer turns stale when the watermark says so. Without one (`delay=None`) the clock of the
    cluster is used, and a layer turns stale while no poll arrives at all.
    """
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    rows = polls.where(F.col("layer").isNotNull() & F.col("at").isNotNull())
    timed = rows.withColumns({"at": F.col("at").cast("timestamp"), "at_us": F.unix_micros(F.col("at").cast("timestamp"))})
    if delay:
        timed = timed.withWatermark("at", delay)
    return timed.groupBy("layer").transformWithStateInPandas(
        statefulProcessor=LayerFreshness(limits, by_poll),
        outputStructType="layer string, at_ms bigint, seq bigint, status string",
        outputMode="Append",
        timeMode="EventTime" if delay else "ProcessingTime",
    )


def status_at(changes: DataFrame, clock_ms: list[int]) -> DataFrame:
    """(clock_ms, layer, status) from the changes up to each clock time; `clock_ms` is a short list."""
    asked = changes.withColumn("clock_ms", F.explode(F.array(*[F.lit(t).cast("bigint") for t in clock_ms])))
    known = asked.where(F.col("at_ms") <= F.col("clock_ms"))
    return first_per_key(known, ["clock_ms", "layer"], [F.col("at_ms").desc(), F.col("seq").desc()]).select("clock_ms", "layer", "status")
