"""Applying cached cyclone geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.operators import cyclone
from almagest.sources.feeds import point

NOW = 1_700_000_000
HOUR = 3600


def test_outcomes_and_records(spark):
    rows = [("1:1", "TC", "active"), ("2:1", "TC", "active"), ("3:1", "TC", "active"), ("4:1", "TC", "expired"),
            ("5:1", "FL", "active"), ("9:9:cone", "TC", "active"), ("6:1", "TC", "active")]
    alerts = spark.createDataFrame(rows, "source_id string, t string, status string").select(
        F.concat(F.lit("gdacs:"), "source_id").alias("id"), "source_id", "status", point(F.lit(1.0), F.lit(2.0)).alias("geometry"),
        F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"),
        F.struct(F.col("t").alias("event_type"), F.lit("n").alias("event"), F.lit(None).cast("string").alias("geometry_kind")).alias("alert"),
    )
    line, cone = [[0.0, 1.0], [2.0, 3.0]], [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]
    cache = spark.createDataFrame(
        [(1, 1, NOW - 6 * HOUR, line, cone, [7.0, 8.0]), (1, 1, NOW - 9 * HOUR, None, None, None), (2, 1, NOW - 6 * HOUR - 1, line, cone, None),
         (4, 1, NOW, line, cone, None), (6, 1, NOW, None, None, [9.0, 9.0])],
        "event_id bigint, episode_id bigint, s bigint, track array<array<double>>, cone array<array<array<double>>>, centroid array<double>",
    ).withColumn("fetched_at", F.timestamp_seconds("s"))
    cache = cyclone.newest_geometry(cache)
    assert cache.count() == 4
    active = cyclone.active_cyclones(alerts)
    assert {r.event_id for r in active.collect()} == {1, 2, 3, 6}
    now = F.timestamp_seconds(F.lit(NOW))
    matched = cyclone.match_geometry(active, cache, now)
    assert {r.event_id: r.outcome for r in matched.collect()} == {1: "fresh", 2: "stale", 3: "missing", 6: "fresh"}
    c = cyclone.geometry_outcomes(matched).first()
    assert (c.tracks, c.cones, c.stale, c.missing) == (1, 1, 1, 1)
    out = {r.id: r for r in cyclone.apply_geometry(alerts, cache, now).collect()}
    assert len(out) == 8 and set(out["gdacs:1:1"].asDict()) == set(alerts.columns)
    t, k = out["gdacs:1:1"], out["gdacs:1:1:cone"]
    assert (t.geometry.type, t.alert.geometry_kind, t.lon, t.lat) == ("LineString", "track", 7.0, 8.0)
    assert out["gdacs:6:1"].geometry.type == "Point" and out["gdacs:6:1"].lon == 9.0
    for plain in ("2:1", "3:1", "4:1", "5:1"):
        assert out[f"gdacs:{plain}"].geometry.type == "Point" and out[f"gdacs:{plain}"].alert.geometry_kind is None
    assert k is not None
