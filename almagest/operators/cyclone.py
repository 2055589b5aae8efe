"""Applying cached cyclone geometry to alert records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.functions.scalars import epoch_ms
from almagest.operators.keys import first_per_key
from almagest.schema import GEOMETRY, TRACK_TTL_MS


def _ids(source_id: str = "source_id") -> tuple[Column, Column]:
    parts = F.split(source_id, ":")
    plain = F.col(source_id).rlike(r"^[0-9]+:[0-9]+$")
    return (
        F.when(plain, F.get(parts, F.lit(0)).try_cast("bigint")),
        F.when(plain, F.get(parts, F.lit(1)).try_cast("bigint")),
    )


def active_cyclones(alerts: DataFrame) -> DataFrame:
    """Active cyclone alerts with their ids; derived cone rows do not have two-part ids."""
    event, episode = _ids()
    return alerts.withColumns({"event_id": event, "episode_id": episode}).where(
        (F.col("alert.event_type") == "TC") & (F.col("status") == "active") & F.col("event_id").isNotNull()
    )


def cyclone_index(alerts: DataFrame) -> DataFrame:
    """The small table of cyclones whose geometry is worth fetching."""
    return active_cyclones(alerts).select("event_id", "episode_id", F.col("alert.event").alias("name"))


def newest_geometry(cache: DataFrame) -> DataFrame:
    """One cache row per (event, episode): the newest fetch."""
    return first_per_key(cache, ["event_id", "episode_id"], [F.col("fetched_at").desc()])


def match_geometry(
    active: DataFrame,
    cache: DataFrame,
    now: Column,
    ttl_ms: int = TRACK_TTL_MS,
) -> DataFrame:
    """Left join to the cache with outcome fresh, stale or missing.

    Freshness is judged after the join, not in its condition, so a stale row is told
    apart from a missing one. Geometry columns are null unless fresh.
    """
    hit = cache.select(
        "event_id", "episode_id", "fetched_at", "track", "cone", "centroid", F.lit(True).alias("__hit")
    )
    joined = active.join(hit, ["event_id", "episode_id"], "left")
    age = epoch_ms(now) - epoch_ms("fetched_at")
    outcome = (
        F.when(F.col("__hit").isNull(), "missing")
        .when(age.isNull() | (age > ttl_ms), "stale")
        .otherwise("fresh")
    )
    fresh = F.col("outcome") == "fresh"
    return joined.withColumn("outcome", outcome).withColumns(
        {c: F.when(fresh, F.col(c)) for c in ("track", "cone", "centroid")}
    ).drop("__hit")


def _line(points: Column) -> Column:
    g = {f.name: F.lit(None).cast(f.dataType) for f in GEOMETRY.fields}
    g |= {"type": F.lit("LineString"), "line": points}
    return F.struct(*[v.alias(k) for k, v in g.items()])


def _polygon(rings: Column) -> Column:
    g = {f.name: F.lit(None).cast(f.dataType) for f in GEOMETRY.fields}
    g |= {"type": F.lit("Polygon"), "polygon": rings}
    return F.struct(*[v.alias(k) for k, v in g.items()])


def apply_geometry(
    alerts: DataFrame, cache: DataFrame, now: Column, ttl_ms: int = TRACK_TTL_MS
) -> DataFrame:
    """Alert records with tracks in place of points, plus derived cone records.

    Records without fresh geometry keep their point. The cone repeats the record's
    times, rank and status, so both appear and disappear together.
    """
    event, episode = _ids()
    is_active = (F.col("alert.event_type") == "TC") & (F.col("status") == "active")
    # Most alerts are no cyclones. As one null key they would all meet in one task, so
    # they get negative keys, which no cache row has, spread by their id.
    elsewhere = F.lit(-1).cast("bigint") - F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    keyed = alerts.withColumns(
        {
            "event_id": F.coalesce(F.when(is_active, event), elsewhere),
            "episode_id": F.coalesce(F.when(is_active, episode), F.lit(-1).cast("bigint")),
        }
    )
    matched = match_geometry(keyed, cache, now, ttl_ms).withColumns(
        {
            "lon": F.coalesce(F.get("centroid", F.lit(0)), F.col("lon")),
            "lat": F.coalesce(F.get("centroid", F.lit(1)), F.col("lat")),
        }
    )
    extra = ["event_id", "episode_id", "fetched_at", "track", "cone", "centroid", "outcome"]
    has_track = F.col("track").isNotNull()
    # A record yields itself and, when it has a cone, one more row: no second scan or join.
    kinds = F.when(F.col("cone").isNotNull(), F.array(F.lit("self"), F.lit("cone"))).otherwise(F.array(F.lit("self")))
    rows = matched.withColumn("__row", F.explode_outer(kinds))
    is_cone = F.col("__row") == "cone"
    source_id = F.when(is_cone, F.concat("source_id", F.lit(":cone"))).otherwise(F.col("source_id"))
    kind = F.when(is_cone, "cone").when(has_track, "track").otherwise(F.col("alert.geometry_kind"))
    return rows.withColumns(
        {
            "geometry": F.when(is_cone, _polygon(F.col("cone")))
            .when(has_track, _line(F.col("track")))
            .otherwise(F.col("geometry")),
            "id": F.when(is_cone, F.concat(F.lit("gdacs:"), source_id)).otherwise(F.col("id")),
            "source_id": source_id,
            "alert": F.col("alert").withField("geometry_kind", kind),
        }
    ).drop(*extra, "__row")


def geometry_outcomes(matched: DataFrame) -> DataFrame:
    """Counts of fresh tracks, cones, stale and missing cache rows."""
    return matched.agg(
        F.count_if(F.col("track").isNotNull()).alias("tracks"),
        F.count_if(F.col("cone").isNotNull()).alias("cones"),
        F.count_if(F.col("outcome") == "stale").alias("stale"),
        F.count_if(F.col("outcome") == "missing").alias("missing"),
    )
