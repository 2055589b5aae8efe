"""State of the world at an instant: one rule per temporal kind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.functions.geo import wrap_lon
from almagest.functions.scalars import epoch_ms, instant
from almagest.operators.keys import first_per_key
from almagest.schema import TEMPORAL_SPEC


def slice_occurrence(df: DataFrame, t_ms: int, window_ms: int, at: str = "occurred_at") -> DataFrame:
    """Events in [T - window, T], both ends included."""
    return df.where(F.col(at).between(instant(df, at, t_ms - window_ms), instant(df, at, t_ms)))


def slice_interval(df: DataFrame, t_ms: int, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Intervals that hold at T: valid_from <= T < valid_to, open when valid_to is null."""
    return df.where(
        (F.col(start) <= instant(df, start, t_ms))
        & (F.col(end).isNull() | (F.col(end) > instant(df, end, t_ms)))
    )


def visible(df: DataFrame) -> DataFrame:
    """Display policy after the time rule: cancelled intervals are hidden."""
    return df.where(~F.col("status").eqNullSafe("cancelled"))


def latest_per_entity(
    df: DataFrame,
    t_ms: int,
    tolerance_ms: int,
    entity: str = "entity_id",
    at: str = "sampled_at",
    seq: str = "arrival_seq",
) -> DataFrame:
    """Newest sample per entity with sampled_at <= T, plus a stale flag.

    Equal times: the first arrival wins. Samples after T do not exist yet.
    """
    seen = df.where(F.col(at) <= instant(df, at, t_ms))
    newest = first_per_key(seen, [entity], [F.col(at).desc(), F.col(seq).asc()])
    return newest.withColumn("stale", F.lit(t_ms) - epoch_ms(at) > tolerance_ms)


@dataclass(frozen=True)
class Instants:
    """Evenly spaced query instants: start, start + step, ... (count of them)."""

    start_ms: int
    step_ms: int
    count: int

    def at(self, index: Column) -> Column:
        return F.lit(self.start_ms) + index * F.lit(self.step_ms)

    def first_not_before(self, ms: Column) -> Column:
        """Index of the first instant at or after the time."""
        ahead = ms - F.lit(self.start_ms) + F.lit(self.step_ms - 1)
        return F.greatest((ahead - F.pmod(ahead, F.lit(self.step_ms))) / F.lit(self.step_ms), F.lit(0)).cast("bigint")


def latest_at_instants(
    df: DataFrame,
    instants: Instants,
    tolerance_ms: int,
    entity: str = "entity_id",
    at: str = "sampled_at",
    seq: str = "arrival_seq",
) -> DataFrame:
    """latest_per_entity for a whole axis of instants, without a range join.

    A sample can only be the newest one from the first instant at or after it, so the
    rows are first reduced to one per (entity, that instant). What is left per entity
    is at most one row per instant; each holds until the next one starts.
    """
    index = "instant_index"
    bucketed = df.withColumn(index, instants.first_not_before(epoch_ms(at))).where(
        F.col(index) < instants.count
    )
    newest = first_per_key(bucketed, [entity, index], [F.col(at).desc(), F.col(seq).asc()])
    following = F.lead(index).over(Window.partitionBy(entity).orderBy(index))
    held = newest.withColumn("__until", F.coalesce(following, F.lit(instants.count)) - 1)
    dense = held.withColumn(index, F.explode_outer(F.sequence(F.col(index), F.col("__until")))).drop("__until")
    return (
        dense.withColumn("instant_ms", instants.at(F.col(index)))
        .drop(index)
        .withColumn("stale", F.col("instant_ms") - epoch_ms(at) > tolerance_ms)
    )


def occurrences_at_instants(df: DataFrame, instants: Instants, window_ms: int, at: str = "occurred_at") -> DataFrame:
    """Occurrence slices for an axis of instants: each event names the instants that see it."""
    ms = epoch_ms(at)
    first = instants.first_not_before(ms)
    last = F.floor((ms + F.lit(window_ms) - F.lit(instants.start_ms)) / F.lit(instants.step_ms)).cast("bigint")
    last = F.least(last, F.lit(instants.count - 1).cast("bigint"))
    return (
        df.where(first <= last)
        .withColumn("__index", F.explode_outer(F.sequence(first, last)))
        .withColumn("instant_ms", instants.at(F.col("__index")))
        .drop("__index")
    )


def intervals_at_instants(df: DataFrame, instants: Instants, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Interval slices for an axis of instants: each interval names the instants it holds at.

    It holds from the first instant at or after its start up to the last one before its end,
    or to the end of the axis while it is open.
    """
    first = instants.first_not_before(epoch_ms(start))
    ended = F.when(F.col(end).isNotNull(), instants.first_not_before(epoch_ms(end)))
    last = F.coalesce(ended, F.lit(instants.count).cast("bigint")) - 1
    last = F.least(last, F.lit(instants.count - 1).cast("bigint"))
    return (
        df.where(first <= last)
        .withColumn("__index", F.explode_outer(F.sequence(first, last)))
        .withColumn("instant_ms", instants.at(F.col("__index")))
        .drop("__index")
    )


def positions_at_instants(
    df: DataFrame, instants: Instants, max_gap_ms: int, entity: str = "entity_id", at: str = "sampled_at", seq: str = "arrival_seq"
) -> DataFrame:
    """(entity, instant_ms, lon, lat): positions between samples at most `max_gap_ms` apart.

    Straight in longitude and latitude, the short way round the antimeridian. Only the
    first and the last sample between two instants can matter, so rows are reduced to
    these before anything is ordered. Equal times: the first arrival counts.
    """
    index = "__index"
    sample = F.struct(epoch_ms(at).alias("ms"), F.col(seq).alias("seq"), "lon", "lat")
    newest = F.struct(epoch_ms(at).alias("ms"), (-F.col(seq)).alias("seq"), "lon", "lat")
    ends = (
        df.withColumn(index, instants.first_not_before(epoch_ms(at)))
        .groupBy(entity, index)
        .agg(F.min(sample).alias("first"), F.max(newest).alias("last"))
    )
    order = Window.partitionBy(entity).orderBy(index)
    pairs = ends.select(entity, index, F.col("last").alias("a"), F.lead("first").over(order).alias("b"), F.lead(index).over(order).alias("until"))
    pairs = pairs.where((F.col("b.ms") - F.col("a.ms") <= max_gap_ms) & (F.col(index) < instants.count))
    until = F.least(F.col("until"), F.lit(instants.count).cast("bigint")) - 1
    dense = pairs.withColumn(index, F.explode(F.sequence(F.col(index), until))).withColumn("instant_ms", instants.at(F.col(index)))
    share = (F.col("instant_ms") - F.col("a.ms")) / (F.col("b.ms") - F.col("a.ms"))
    turn = wrap_lon(F.col("b.lon") - F.col("a.lon"))
    return dense.select(
        entity,
        "instant_ms",
        wrap_lon(F.col("a.lon") + turn * share).alias("lon"),
        (F.col("a.lat") + (F.col("b.lat") - F.col("a.lat")) * share).alias("lat"),
    )


def repair_legacy(df: DataFrame) -> DataFrame:
    """Repair alerts written under the old contract, on read; repeating it changes nothing.

    There an active alert carried the end of its observation data as valid_to. The
    combination (gdacs, active, valid_to set) can only come from there.
    """
    old = (F.col("source") == "gdacs") & (F.col("status") == "active") & F.col("valid_to").isNotNull()
    if "layer" in df.columns:
        old = old & (F.col("layer") == "weather")
    old = F.coalesce(old, F.lit(False))
    return df.withColumns(
        {
            "observed_until": F.when(
                old, F.coalesce(F.col("observed_until"), F.col("valid_to"))
            ).otherwise(F.col("observed_until")),
            "valid_to": F.when(old, F.lit(None)).otherwise(F.col("valid_to")),
        }
    )


def news_instant(now_ms: Column, as_of_ms: Column) -> Column:
    """A news file's time may be ahead of the clock; then the file's time counts."""
    return F.greatest(now_ms, as_of_ms)


def slice_files(df: DataFrame, now_ms: int, window_ms: int, at: str = "occurred_at", ingested: str = "ingested_at") -> DataFrame:
    """Records of files, whose time is the file's end and may be ahead of the clock.

    T is the later one of the clock and the newest file that is there: [T - window, T].
    Records ingested after the clock do not exist yet. The newest time is a scalar subquery.
    """
    known = df.where(F.col(ingested) <= instant(df, ingested, now_ms)) if ingested in df.columns else df
    t = news_instant(F.lit(now_ms), known.agg(F.max(epoch_ms(at)).alias("t")).scalar())
    return known.where(epoch_ms(at).between(t - window_ms, t))


SLICES: dict[str, Callable[[DataFrame, int, int | None], DataFrame]] = {
    "instant": lambda df, t, window: slice_occurrence(df, t, window).withColumn("stale", F.lit(False)),
    "file": lambda df, t, window: slice_files(df, t, window).withColumn("stale", F.lit(False)),
    "interval": lambda df, t, _: visible(slice_interval(df, t)).withColumn("stale", F.lit(False)),
    "sampled": lambda df, t, tolerance: latest_per_entity(df, t, tolerance),
}


def world_state(
    layers: dict[str, DataFrame],
    t_ms: int,
    spec: dict[str, tuple[str, int | None]] = TEMPORAL_SPEC,
) -> DataFrame:
    """Union of the slices of all given layers at T.

    The rule is looked up by the layer's temporal mode, so a new layer is one more
    entry in `spec`, and a new mode one more function in SLICES.
    """
    out: DataFrame | None = None
    for layer, df in layers.items():
        mode, length = spec[layer]
        part = SLICES[mode](df, t_ms, length).withColumn("layer", F.lit(layer))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    assert out is not None
    return out


def in_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Restrict to a box; west > east means that it crosses the antimeridian."""
    lon = F.col("lon")
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return df.where(across & F.col("lat").between(south, north))


def of_kind(df: DataFrame, kind: str, payload: str) -> DataFrame:
    """Narrow the mixed record table to one kind and open its payload."""
    return df.where(F.col("kind") == kind).select("id", "layer", f"{payload}.*")


def of_geometry(df: DataFrame, *types: str) -> DataFrame:
    return df.where(F.col("geometry.type").isin(*types))


def of_layers(df: DataFrame, enabled: list[str]) -> DataFrame:
    return df.where(F.col("layer").isin(enabled))


def lookup(df: DataFrame, record_id: str, priority: list[str], seq: str = "arrival_seq") -> DataFrame:
    """The record with this id; the first layer that has it wins, then the first arrival."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("layer"))
    return df.where((F.col("id") == record_id) & (order > 0)).orderBy(order, F.col(seq)).limit(1)
