"""Boundaries of the time rules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from almagest.operators import temporal

T = 1_700_000_000_000
W = 3_600_000


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_occurrence_includes_both_ends(spark):
    df = frame(spark, [(i, T + d) for i, d in enumerate([-W, -1, 0, -W - 1, 1])], "id int, ms bigint")
    df = df.withColumn("occurred_at", F.timestamp_millis("ms"))
    assert {r.id for r in temporal.slice_occurrence(df, T, W).collect()} == {0, 1, 2}


def test_interval_is_half_open(spark):
    rows = [(0, T, None), (1, T + 1, None), (2, T - 5, T), (3, T - 5, T + 1), (4, T, T)]
    df = frame(spark, rows, "id int, a bigint, b bigint").select(
        "id", F.timestamp_millis("a").alias("valid_from"), F.timestamp_millis("b").alias("valid_to")
    )
    assert {r.id for r in temporal.slice_interval(df, T).collect()} == {0, 3}


def test_cancelled_is_hidden_but_unknown_status_is_not(spark):
    df = frame(spark, [(0, "active"), (1, "cancelled"), (2, None)], "id int, status string")
    assert {r.id for r in temporal.visible(df).collect()} == {0, 2}


def samples(spark, rows):
    return frame(spark, rows, "entity_id string, ms bigint, arrival_seq bigint").withColumn(
        "sampled_at", F.timestamp_millis("ms")
    )


def test_latest_ties_future_and_stale(spark):
    rows = [
        ("a", T - 10, 1), ("a", T - 5, 3), ("a", T - 5, 2), ("a", T + 1, 4),  # first arrival of the newest time
        ("b", T + 1, 1),  # only in the future: gone
        ("c", T - 100, 1),  # exactly at the tolerance: fresh
        ("d", T - 101, 1),
    ]
    got = {r.entity_id: (r.arrival_seq, r.stale) for r in temporal.latest_per_entity(samples(spark, rows), T, 100).collect()}
    assert got == {"a": (2, False), "c": (1, False), "d": (1, True)}


def test_many_instants_equal_one_by_one(spark):
    rng = random.Random(3)
    # One entity owns a third of all rows; times repeat.
    rows = [("hot" if rng.random() < 0.33 else f"e{rng.randrange(6)}", T + rng.randrange(-20, 60) * 10, i) for i in range(400)]
    df = samples(spark, rows).repartition(5)
    axis = temporal.Instants(T, 70, 9)
    got = {
        (r.instant_ms, r.entity_id, r.arrival_seq, r.stale)
        for r in temporal.latest_at_instants(df, axis, 50).collect()
    }
    want = set()
    for i in range(axis.count):
        t = axis.start_ms + i * axis.step_ms
        best = {}
        for e, ms, seq in rows:
            if ms <= t and (e not in best or (ms, -seq) > (best[e][0], -best[e][1])):
                best[e] = (ms, seq)
        want |= {(t, e, seq, t - ms > 50) for e, (ms, seq) in best.items()}
    assert got == want


def test_occurrences_at_instants(spark):
    rows = [(i, T + i * 13 - 200) for i in range(60)]
    df = frame(spark, rows, "id int, ms bigint").withColumn("occurred_at", F.timestamp_millis("ms"))
    axis = temporal.Instants(T, 50, 7)
    got = {(r.instant_ms, r.id) for r in temporal.occurrences_at_instants(df, axis, 120).collect()}
    instants = [T + 50 * i for i in range(7)]
    assert got == {(t, i) for t in instants for i, ms in rows if t - 120 <= ms <= t}


def test_legacy_repair_is_idempotent_and_selective(spark):
    rows = [
        ("gdacs", "active", 5, None), ("gdacs", "active", 5, 4), ("gdacs", "active", None, 3),
        ("gdacs", "expired", 5, None), ("nws", "active", 5, None),
    ]
    df = frame(spark, rows, "source string, status string, v bigint, o bigint").select(
        "source", "status", F.timestamp_millis("v").alias("valid_to"), F.timestamp_millis("o").alias("observed_until")
    )
    once = temporal.repair_legacy(df)
    read = lambda d: sorted(map(str, d.collect()))
    assert read(temporal.repair_legacy(once)) == read(once)
    ms = lambda c: F.unix_millis(c)
    got = [tuple(r) for r in once.select("source", "status", ms("valid_to"), ms("observed_until")).collect()]
    assert got == [
        ("gdacs", "active", None, 5), ("gdacs", "active", None, 4), ("gdacs", "active", None, 3),
        ("gdacs", "expired", 5, None), ("nws", "active", 5, None),
    ]


def test_box_across_the_antimeridian(spark):
    df = frame(spark, [(0, 179.0, 0.0), (1, -179.0, 0.0), (2, 0.0, 0.0), (3, 180.0, 50.0)], "id int, lon double, lat double")
    assert {r.id for r in temporal.in_box(df, 170, -10, -170, 10).collect()} == {0, 1}
    assert {r.id for r in temporal.in_box(df, -10, -10, 10, 10).collect()} == {2}


def test_lookup_prefers_the_first_layer(spark):
    df = frame(spark, [("x", "news", 1), ("x", "flight", 2), ("y", "news", 3)], "id string, layer string, arrival_seq int")
    assert temporal.lookup(df, "x", ["earthquake", "flight", "weather", "news"]).collect()[0].layer == "flight"


def test_kind_is_narrowed_with_its_payload(spark):
    df = frame(spark, [("a", "occurrence"), ("b", "interval")], "id string, kind string").select(
        "id", "kind", F.lit("earthquake").alias("layer"), F.struct(F.lit(5.0).alias("magnitude")).alias("quake")
    )
    rows = temporal.of_kind(df, "occurrence", "quake").collect()
    assert [(r.id, r.magnitude) for r in rows] == [("a", 5.0)]


def test_world_state_takes_new_layers(spark):
    events = frame(spark, [(1, T), (2, T - 99)], "id int, ms bigint").withColumn("occurred_at", F.timestamp_millis("ms"))
    out = temporal.world_state({"tides": events}, T, {"tides": ("instant", 50)})
    assert [(r.layer, r.id, r.stale) for r in out.collect()] == [("tides", 1, False)]


def test_news_instant(spark):
    row = spark.range(1).select(temporal.news_instant(F.lit(5), F.lit(9)).alias("t")).first()
    assert row.t == 9


def test_news_files_ahead_of_the_clock(spark):
    rows = [(1, T + 300_000, T - 1), (2, T + 600_000, T + 1), (3, T - 100, T - 400_000), (4, T + 300_000 - 1_000, T - 5_000), (5, T + 300_000 - 1_001, T - 5_000)]
    df = spark.createDataFrame(rows, "id long, at long, seen long").select(
        "id", F.timestamp_millis("at").alias("occurred_at"), F.timestamp_millis("seen").alias("ingested_at")
    )
    # record 2 is not there yet; 1 moves T ahead, so that the window ends with it
    assert {r.id for r in temporal.slice_files(df, T, 1_000).collect()} == {1, 4}
    assert {r.id for r in temporal.slice_files(df, T + 10_000_000, 10_000_000).collect()} == {1, 2, 4, 5}
    assert temporal.slice_files(df.limit(0), T, 1_000).count() == 0
    assert {r.id for r in temporal.world_state({"news": df}, T).collect()} == {1, 3, 4, 5}
