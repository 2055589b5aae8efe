"""File streams: slots, freshness, ingest, arrivals, admission."""

from __future__ import annotations

import json
import os
import random
import time

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_ledger import bucket

from almagest.operators import ledger
from almagest.sources import feeds, landed
from almagest.streaming import arrived, freshness, jobs, state
from almagest.streaming.ingest import ArrivalLog, Ingest, first_in_bucket, numbered_documents

DAY0 = 1_767_312_000  # 2026-01-02


def test_slot_counts_over_many_batches(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/events.parquet")
    table.repartition(6).write.parquet(str(tmp_path / "in"))
    work = str(tmp_path / "work")
    events = jobs.stream_table(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    slot = F.window(F.col("ts").cast("timestamp"), "900 seconds")
    updates = events.groupBy(slot.alias("w")).agg(F.count(F.lit(1)).alias("records")).select(F.unix_seconds("w.start").alias("slot"), "records")
    jobs.run_updates(updates, work)
    assert len([d for d in os.listdir(f"{work}/updates") if d.startswith("n=")]) >= 6
    got = {r.slot: r.records for r in jobs.current_rows(spark, work, ["slot"]).collect()}
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    want = {r.s: r["count"] for r in table.groupBy((sec - F.pmod(sec, F.lit(900))).alias("s")).count().collect()}
    assert got == want


def test_poll_summary_stream_equals_the_batch(spark, tmp_path):
    rows = [("news", i, 1_700_000_000_000 + i, o) for i, o in enumerate(["ok", "error", "schema_error", "not_modified", "ok", "schema_error"])]
    df = spark.createDataFrame(rows, "layer string, s bigint, as_of_ms bigint, outcome string").select(
        "layer", F.timestamp_seconds("s").alias("at"), "as_of_ms", "outcome"
    )
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_table(spark, str(tmp_path / "in"), "*.parquet", 1)
    got = jobs.poll_summary_stream(stream, str(tmp_path / "work")).select(*sorted(ledger.poll_summary(df).columns)).collect()
    assert got == ledger.poll_summary(df).select(*sorted(got[0].asDict())).collect()


def land(folder, name, body, at):
    path = folder / name
    path.write_text(body if isinstance(body, str) else json.dumps(body))
    os.utime(path, (at, at))


def feature(key, at, mag, updated=0):
    return {"id": key, "properties": {"mag": mag, "time": at * 1000, "updated": at * 1000 + updated}, "geometry": {"coordinates": [10, 20, 5]}}


def test_ingest(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    job = Ingest(spark, str(tmp_path / "out"), "earthquake", "features", feeds.quakes)
    check = str(tmp_path / "check")

    def run(checkpoint=check):
        job.start(landed.stream_documents(spark, str(folder), 100), checkpoint).awaitTermination()

    land(folder, "a.json", {"features": [feature("q1", DAY0 - 60, 5.0), feature("old", DAY0 - 4000, 4.0), {"id": 1}]}, DAY0)
    land(folder, "b.json", {"error": "x"}, DAY0 + 1)
    land(folder, "c.json", {"features": []}, DAY0 + 2)
    run()
    table = job.table
    assert {r.id for r in table.read().collect()} == {"usgs:q1"}  # the old slot is outside the commit window
    assert {r.path[-6:]: r.outcome for r in job.status().collect()} == {"a.json": "partial", "b.json": "failed", "c.json": "empty"}
    assert job.snapshot.headers().select(F.unix_seconds("as_of").alias("s")).first().s == DAY0 + 2
    late = spark.read.parquet(f"{job.root}/lateness").agg(F.sum("committed").alias("c"), F.sum("too_late").alias("l")).first()
    assert (late.c, late.l) == (1, 1)

    # A correction republishes its slot, an older version does not.
    land(folder, "d.json", {"features": [feature("q1", DAY0 - 60, 6.0, updated=500)]}, DAY0 + 60)
    run()
    land(folder, "e.json", {"features": [feature("q1", DAY0 - 60, 4.0, updated=100)]}, DAY0 + 120)
    run()
    assert [(r.generation, r.records) for r in table.manifest().orderBy("generation").collect()] == [(0, 1), (1, 1)]
    assert table.read().first().quake.magnitude == 6.0

    # Everything once more from the start: no new generation, nothing lost, latest not moved back.
    before = job.snapshot.headers().collect()
    assert [r.quake.magnitude for r in job.snapshot.read("earthquake").collect()] == [4.0]  # as the newest document says
    run(str(tmp_path / "check-again"))
    assert table.manifest().count() == 2 and table.read().first().quake.magnitude == 6.0
    assert job.snapshot.headers().collect() == before


def aircraft(hex_code, lon=10.0):
    return {"hex": hex_code, "lon": lon, "lat": 5.0, "gs": 400}


def test_ingest_keeps_regions_apart(spark, tmp_path):
    """Two regions in one batch, one of them twice in the same second."""
    folder = tmp_path / "landing"
    folder.mkdir()

    def regions(docs):
        region = F.regexp_extract("path", r"region-([a-z]+)", 1)
        return docs.withColumns({"region_id": region, "part": F.concat(F.lit("flight-"), region)})

    job = Ingest(spark, str(tmp_path / "out"), "flight", "ac", feeds.aircraft, time_column="sampled_at", prepare=regions)
    land(folder, "region-a.json", {"ac": [aircraft("a1"), aircraft("a2"), {"hex": "broken"}]}, DAY0)
    land(folder, "region-b.json", {"ac": [aircraft("b1"), aircraft("b2")]}, DAY0 + 1)
    land(folder, "region-b-2.json", {"ac": [aircraft("b2", 20.0)]}, DAY0 + 1)
    job.start(landed.stream_documents(spark, str(folder), 100), str(tmp_path / "check")).awaitTermination()
    got = {(r.part, r.entity_id) for r in job.snapshot.read().collect()}
    assert got == {("flight-a", "a1"), ("flight-a", "a2"), ("flight-b", "b1"), ("flight-b", "b2")}
    seqs = [r.arrival_seq for r in job.snapshot.read().collect()]
    assert len(seqs) == len(set(seqs))
    assert {r.dropped for r in job.table.manifest().collect()} == {1}
    assert {(r.outcome, r.dropped) for r in job.status().collect()} == {("partial", 1)}
    # only region b moves on
    land(folder, "region-b-3.json", {"ac": [aircraft("b9")]}, DAY0 + 100)
    job.start(landed.stream_documents(spark, str(folder), 100), str(tmp_path / "check")).awaitTermination()
    assert {r.entity_id for r in job.snapshot.read("flight-b").collect()} == {"b9"}
    assert {r.entity_id for r in job.snapshot.read("flight-a").collect()} == {"a1", "a2"}


def alert(event, page_day):
    return {
        "properties": {"eventid": event, "episodeid": 1, "eventtype": "EQ", "alertlevel": "Red", "iscurrent": "true",
                       "fromdate": f"2025-12-{page_day:02d}T00:00:00", "todate": "2026-01-03T00:00:00", "datemodified": "2026-01-01T00:00:00"},
        "geometry": {"coordinates": [10, 20]},
    }


def test_ingest_of_intervals_uses_the_schedule(spark, tmp_path):
    """All pages of a cycle are one snapshot; alerts that began long ago are committed."""
    folder = tmp_path / "landing"
    folder.mkdir()

    def cycle(docs):
        at = F.to_timestamp(F.regexp_extract("path", r"cycle-(\d+)", 1).cast("bigint"))
        return docs.withColumns({"as_of": F.timestamp_seconds(F.unix_seconds(at))})

    job = Ingest(spark, str(tmp_path / "out"), "weather", "features", feeds.alerts, time_column="ingested_at", prepare=cycle)
    land(folder, f"cycle-{DAY0}-p1.json", {"features": [alert(1, 10), alert(2, 11)]}, DAY0 + 5)
    land(folder, f"cycle-{DAY0}-p2.json", {"features": [alert(3, 12)]}, DAY0 + 9)
    job.start(landed.stream_documents(spark, str(folder), 100), str(tmp_path / "check")).awaitTermination()
    assert {r.source_id for r in job.snapshot.read().collect()} == {"1:1", "2:1", "3:1"}
    assert {r.slot for r in job.table.read().collect()} == {DAY0} and job.table.read().count() == 3


def test_first_publish_may_be_empty(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    job = Ingest(spark, str(tmp_path / "out"), "earthquake", "features", feeds.quakes)
    land(folder, "old.json", {"features": [feature("old", DAY0 - 90_000, 4.0)]}, DAY0)
    job.start(landed.stream_documents(spark, str(folder), 100), str(tmp_path / "check")).awaitTermination()
    assert job.table.read() is None or job.table.read().count() == 0


def test_arrival_log(spark, tmp_path):
    log = ArrivalLog(spark, str(tmp_path / "log"))
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    log.batch(ids("a", "b"), 0, 100)
    log.batch(ids("b", "c"), 1, 200)
    log.batch(ids("b", "c"), 1, 200)  # a repeated batch replaces itself
    log.batch(ids("a", "c"), 2, 300)
    assert {(r.id, r.arrived_ms) for r in log.arrivals().collect()} == {("c", 200), ("a", 300)}


def test_first_in_bucket(spark, tmp_path):
    rows = [("a", 10, 1), ("a", 200, 3), ("b", 10, 4), ("a", 170, 2)]
    df = spark.createDataFrame(rows, "entity_id string, s bigint, arrival_seq bigint").withColumn("sampled_at", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = first_in_bucket(jobs.stream_table(spark, str(tmp_path / "in"), "*.parquet"))
    jobs_dir = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(jobs_dir).awaitTermination()
    got = [(r.entity_id, r.s // 180) for r in spark.read.parquet(jobs_dir).collect()]
    assert sorted(got) == [("a", 0), ("a", 1), ("b", 0)]


def test_token_bucket_stream(spark, tmp_path):
    rows = [("a", 1000 + i * 700) for i in range(80)] + [("b", 5000 * i) for i in range(10)]
    folder = tmp_path / "in"
    # Three files in time order, one micro-batch each: state is carried over.
    for n in range(3):
        part = [(k, t) for k, t in rows if n * 20_000 <= t < (n + 1) * 20_000 or (n == 2 and t >= 60_000)]
        spark.createDataFrame(part, "key string, ms bigint").coalesce(1).write.mode("append").parquet(str(folder))
    stream = jobs.stream_table(spark, str(folder), "*.parquet", 1)
    out = str(tmp_path / "out")
    state.token_bucket_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(
        availableNow=True
    ).start(out).awaitTermination()
    got = {(r.key, r.ms): r.accepted for r in spark.read.parquet(out).collect()}
    want = {}
    for key in "ab":
        times = sorted(t for k, t in rows if k == key)
        want |= {(key, t): ok for t, ok in zip(times, bucket(times, 15, 30, 60_000))}
    assert got == want and not all(want.values())


LIMITS = {"quake": 360_000, "news": 1_800_000}


def poll_rows():
    rng = random.Random(9)
    rows = []
    for layer in ("quake", "news", "other"):
        t = 1_700_000_000_000
        for _ in range(120):
            t += rng.choice([0, 1, 60_000, 400_000, 2_000_000])
            rows.append((layer, t, rng.choice([None, t - rng.randint(0, 900_000)]), rng.choice(["ok", "ok", "not_modified", "error", "schema_error", "loading"])))
    return rows


@pytest.mark.parametrize("files", [1, 5])
def test_freshness_stream_equals_the_batch_rule_at_any_clock(spark, tmp_path, files):
    rows = poll_rows()
    rows.append(("quake", max(r[1] for r in rows) + 10 * 3_600_000, None, "error"))  # moves the watermark far ahead
    rows.sort(key=lambda r: r[1])
    df = spark.createDataFrame([(la, t, a, o) for la, t, a, o in rows], "layer string, ms bigint, as_of_ms bigint, outcome string")
    polls = df.select("layer", F.timestamp_millis("ms").alias("at"), "as_of_ms", "outcome")
    per = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * per : (k + 1) * per], df.schema).select("layer", F.timestamp_millis("ms").alias("at"), "as_of_ms", "outcome")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = jobs.stream_table(spark, str(tmp_path / "in"), "*.parquet", 1)
    out = str(tmp_path / "out")
    freshness.freshness_stream(stream, LIMITS, ("quake",), "1 minute").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(
        availableNow=True
    ).start(out).awaitTermination()
    changes = spark.read.parquet(out)
    first, last = rows[0][1], rows[-2][1]
    clocks = [first + (last + 2_000_000 - first) * i // 15 for i in range(16)]
    got = {(r.clock_ms, r.layer): r.status for r in freshness.status_at(changes, clocks).collect()}
    want = {}
    for clock in clocks:
        known = polls.where(F.col("at") <= F.timestamp_millis(F.lit(clock)))
        for r in ledger.layer_status(ledger.poll_summary(known), clock, LIMITS, ("quake",)).collect():
            want[(clock, r.layer)] = r.status
    assert {k: v for k, v in want.items() if v != "idle"} == got
    assert {"stale", "ready", "error"} <= set(got.values())


def test_freshness_by_a_clock_of_our_own():
    layer = freshness.Freshness(1_000, by_poll=True)

    def poll(at, as_of, outcome):
        layer.poll(1000 * at, as_of, outcome)

    assert layer.status_at(5) == "idle" and layer.due is None
    poll(10, None, "error")
    assert layer.status_at(10) == "error"
    poll(20, 7, "ok")
    assert (layer.status_at(1_020), layer.status_at(1_021), layer.due) == ("ready", "stale", 1_021)
    poll(2_000, None, "error")  # demotes nothing by itself
    assert layer.status_at(1_020) == "ready"
    poll(2_000, None, "schema_error")
    poll(2_100, None, "not_modified")
    assert layer.status_at(2_100) == "error"  # sticky until the next good answer
    poll(2_200, 2_200, "ok")
    poll(2_200, None, "schema_error")  # of the same time: the good answer has the last word
    assert layer.status_at(2_200) == "ready"


def test_a_layer_turns_stale_by_the_clock_alone(spark, tmp_path):
    """Processing time: no poll comes any more, and the timer still fires."""
    now = int(time.time() * 1000)
    row = spark.createDataFrame([("quake", now, now, "ok")], "layer string, ms bigint, as_of_ms bigint, outcome string")
    row.select("layer", F.timestamp_millis("ms").alias("at"), "as_of_ms", "outcome").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_table(spark, str(tmp_path / "in"), "*.parquet", 1)
    seen = []
    running = (
        freshness.freshness_stream(stream, {"quake": 12_000}, ("quake",), delay=None)
        .writeStream.option("checkpointLocation", str(tmp_path / "check"))
        .foreachBatch(lambda df, n: seen.extend((r.at_ms, r.status) for r in df.collect()))
        .trigger(processingTime="1 second")
        .start()
    )
    try:
        for _ in range(90):
            if len(seen) >= 2:
                break
            time.sleep(0.5)
    finally:
        running.stop()
    assert seen == [(now, "ready"), (now + 12_001, "stale")]


def test_arrivals_and_their_boards(spark, tmp_path):
    rng = random.Random(3)
    there = {(la, i): [s for s in range(12) if rng.random() < 0.6] for la in ("earthquake", "weather", "x") for i in range(30)}
    hour = 3_600_000
    rows = [(la, str(i), s, (s + 1) * hour) for (la, i), ss in there.items() for s in ss for _ in range(rng.choice([1, 2]))]
    rows.sort(key=lambda r: r[2])
    for part in (rows[: len(rows) // 3], rows[len(rows) // 3 :]):
        df = spark.createDataFrame([*part, (None, "1", 1, 5), ("x", None, 1, 5)], "layer string, id string, snapshot bigint, ms bigint")
        df.select("layer", "id", "snapshot", F.timestamp_millis("ms").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = jobs.stream_table(spark, str(tmp_path / "in"), "*.parquet", 1)
    limits = {"earthquake": 20, "weather": 7}
    board = arrived.ArrivalBoard(spark, str(tmp_path / "board"), limits, 1000)
    board.start(arrived.arrival_stream(stream, 6 * hour)).awaitTermination()
    want = {la: sorted((-(s + 1) * hour, str(i)) for (a, i), ss in there.items() if a == la for s in ss if s and s - 1 not in ss) for la in ("earthquake", "weather", "x")}
    last = board.last_batch()
    got = {}
    for r in board.read(last).collect():
        got.setdefault(r.layer, []).append((-r.arrived_ms, r.id))
    assert {la: sorted(v) for la, v in got.items()} == {la: v[: limits.get(la, 1000)] for la, v in want.items()}
    now = 12 * hour
    alive = board.read(last, now + 600_000 - 1).where("layer = 'earthquake'").collect()
    assert alive and {r.arrived_ms for r in alive} == {now}
    assert board.read(last, now + 600_000).where("layer = 'earthquake'").count() == 0
    assert board.read(last, now + 600_000).where("layer = 'weather'").count() == 7


def test_slot_state_ends_and_late_rows_are_counted(spark, tmp_path):
    rng = random.Random(7)
    start, slots_n = 1_700_000_100, 40
    rows = []
    for batch in range(slots_n):
        for _ in range(30):
            landed = start + batch * 900 + rng.randrange(900)
            rows.append((landed - rng.choice([0, 5, 300, 900, 2_000, 9_000]), landed))
        part = spark.createDataFrame(rows[-30:], "t bigint, l bigint").select(F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds("l").alias("landed_at"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_table(spark, str(tmp_path / "in"), "*.parquet", 4)
    work = str(tmp_path / "work")
    on_time, late = jobs.bounded_slot_counts(stream, work)
    want = {"slots": {}, "late": {}}
    for t, landed in rows:
        now, slot = landed // 900 * 900, t // 900 * 900
        kind, key = ("slots", slot) if slot >= now - 900 else ("late", now)
        want[kind][key] = want[kind].get(key, 0) + 1
    for kind, counts in want.items():
        assert {r.slot: r.records for r in jobs.current_rows(spark, f"{work}/{kind}", ["slot"]).collect()} == counts
    for query in (on_time, late):
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert len(held) >= 10 and max(held) <= 12 < slots_n


def test_numbers_of_documents_of_one_second(spark):
    """However many documents and elements share a second, their numbers stay apart and in order."""
    docs = [(f"p{i:04d}", DAY0 + (i >= 5000), json.dumps({"features": [{}] * (i % 4)}) if i % 9 else "broken") for i in range(6000)]
    df = spark.createDataFrame(docs, "path string, s long, body string").select("path", "body", F.timestamp_seconds("s").alias("landed_at"))
    numbered = numbered_documents(df, "features")
    rows = feeds.elements(numbered, "features", ["path"]).select("path", "pos", "arrival_seq").orderBy("arrival_seq").collect()
    assert len({r.arrival_seq for r in rows}) == len(rows) == sum(i % 4 for i in range(6000) if i % 9)
    assert [(r.path, r.pos) for r in rows] == sorted((r.path, r.pos) for r in rows)
    assert numbered.select("doc_no").distinct().count() == 6000
