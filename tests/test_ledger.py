"""Attempts, pages, gates, freshness, capacity, rates."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from almagest.operators import arrivals as A, encode, ledger, rates
from almagest.operators.keys import numbered

NOW = 1_700_000_000_000
MIN = 60_000


def test_numbering_over_chunks_equals_numbering_at_once(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", rng.randrange(1000), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, t int, i int").repartition(6)
    out = numbered(df, ["k"], F.floor(F.col("t") / 90), [F.col("t").asc(), F.col("i").asc()], "n").collect()
    seen: dict[str, int] = {}
    want = {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + 1
    assert {r.i: r.n for r in out} == want


def status_of(spark, polls, now=NOW):
    df = spark.createDataFrame(
        [(layer, at, as_of, o) for layer, at, as_of, o in polls], "layer string, ms bigint, as_of_ms bigint, outcome string"
    ).withColumn("at", F.timestamp_millis("ms"))
    summary = ledger.poll_summary(df)
    counts = {r.layer: r.error_count for r in ledger.error_counts(df, summary).collect()}
    status = ledger.layer_status(summary, now)
    return {r.layer: (r.status, counts.get(r.layer, 0)) for r in status.collect()}, ledger.pulse(status).first().pulse


@pytest.mark.parametrize(
    "events, want",
    [
        ([(0, "loading")], ("loading", 0)),
        ([(0, "error"), (1, "error")], ("error", 2)),
        ([(0, "ok")], ("ready", 0)),
        ([(0, "ok"), (1, "error"), (2, "error")], ("ready", 2)),
        ([(0, "ok"), (1, "error"), (2, "not_modified")], ("ready", 0)),
        ([(0, "ok"), (1, "schema_error")], ("error", 1)),
        ([(0, "ok"), (1, "schema_error"), (2, "not_modified")], ("error", 1)),  # sticky
        ([(0, "ok"), (1, "schema_error"), (2, "error"), (3, "not_modified")], ("error", 2)),
        ([(0, "schema_error"), (1, "ok")], ("ready", 0)),
        ([(0, "error"), (1, "not_modified"), (2, "error")], ("ready", 1)),
    ],
)
def test_status_sequences(spark, events, want):
    polls = [("weather", NOW - 10 * MIN + i, NOW - 10 * MIN if o == "ok" else None, o) for i, o in events]
    assert status_of(spark, polls)[0]["weather"] == want


def test_staleness_is_strict_and_by_layer(spark):
    polls = [
        ("earthquake", NOW - 6 * MIN, NOW - 99 * MIN, "ok"),  # by poll time, exactly at the limit
        ("flight", NOW, NOW - 20 * MIN - 1, "ok"),  # by data time, one past the limit
        ("news", NOW, NOW - 30 * MIN, "ok"),
    ]
    status, pulse = status_of(spark, polls)
    assert {k: v[0] for k, v in status.items()} == {"earthquake": "ready", "flight": "stale", "news": "ready"}
    assert pulse == "live"
    assert status_of(spark, polls[1:2])[1] == "stale"
    assert status_of(spark, [("news", NOW, None, "error")])[1] == "standby"


def pages(spark, rows):
    return spark.createDataFrame(rows, "cycle bigint, level string, page bigint, features bigint, current bigint, failed boolean")


def test_page_states_and_gate(spark):
    full = lambda c, level, n, cur=5: [(c, level, p, 100, cur, False) for p in range(1, n + 1)]
    rows = [
        *full(1, "Green", 2), (1, "Green", 3, 40, 1, False), (1, "Orange", 1, 100, 0, False), (1, "Red", 1, 3, 3, False),
        *full(2, "Green", 8), (2, "Orange", 1, 9, 1, False), (2, "Red", 1, 9, 1, False),
        *full(3, "Green", 2), (3, "Orange", 1, 9, 1, False), (3, "Red", 1, 100, 0, True),
        *full(4, "Green", 7), *full(4, "Orange", 2), (4, "Red", 1, 9, 0, False),
    ]
    df = pages(spark, rows)
    progress = ledger.page_progress(df)
    got = {(r.cycle, r.level): (r.pages, r.state) for r in progress.collect()}
    assert got == {
        (1, "Green"): (3, "complete"), (1, "Orange"): (1, "complete"), (1, "Red"): (1, "complete"),
        (2, "Green"): (8, "capped"), (2, "Orange"): (1, "complete"), (2, "Red"): (1, "complete"),
        (3, "Green"): (2, "pending"), (3, "Orange"): (1, "complete"), (3, "Red"): (0, "failed"),
        (4, "Green"): (7, "capped"), (4, "Orange"): (2, "capped"), (4, "Red"): (1, "complete"),  # budget of ten used
    }
    chunks = df.where("not failed and not (cycle = 2 and page = 4)")
    missing = ledger.missing_chunks(progress, chunks)
    assert [(r.cycle, r.level, r.page) for r in missing.collect()] == [(2, "Green", 4)]
    gate = {r.cycle: (r.publish, r.ok) for r in ledger.cycle_gate(progress, missing).collect()}
    assert gate == {1: (True, True), 2: (False, False), 3: (False, False), 4: (True, False)}


def test_capacity_limit_is_strict(spark):
    df = spark.createDataFrame([("raw", 60), ("raw", 20), ("norm", 20)], "p string, b bigint")
    total = lambda limit: {r.prefix: (r.bytes, r.objects, r.over_limit) for r in ledger.usage(df, "p", "b", limit).collect()}
    assert total(100) == {"raw": (80, 2, None), "norm": (20, 1, None), "(total)": (100, 3, False)}
    assert total(99)["(total)"][2] is True
    assert ledger.halt_rows(ledger.usage(df, "p", "b", 99)).count() == 1
    assert ledger.halt_rows(ledger.usage(df, "p", "b", 100)).count() == 0


def test_budget_is_strict(spark):
    df = spark.createDataFrame([("d1", 80_000), ("d2", 80_001)], "date string, requests bigint")
    assert {r.date: r.state for r in ledger.budget_flag(df).collect()} == {"d1": "cleared", "d2": "relaxed"}


def test_revisit_gap(spark):
    rng = random.Random(4)
    visits = [(k, rng.randrange(100_000)) for k in "aab" for _ in range(40)] + [("one", 500)]
    df = spark.createDataFrame(visits, "k string, ms bigint")
    got = {r.k: (r.visits, r.max_gap_ms, r.within) for r in ledger.revisit_gap(df, "k", "ms", 9_000, 100_000, 7_000).collect()}
    for key in ("a", "b", "one"):
        ts = sorted(m for k, m in visits if k == key)
        gap = max([b - a for a, b in zip(ts, ts[1:])] + [ts[0] + 100_000 - ts[-1]])
        assert got[key] == (len(ts), gap, gap < 9_000)


def test_rate_statistics(spark):
    rng = random.Random(6)
    rows = []
    for key, n in (("hot", 900), ("b", 60), ("single", 1), ("sparse", 3)):
        t = 0
        for _ in range(n):
            gap = rng.choice([0, 5, 16, 16, 17, 33, 40, 250]) if key != "sparse" else 5000
            t += gap
            rows.append((key, t, float(gap)))
    df = spark.createDataFrame(rows, "k string, ms bigint, dt double").repartition(5)
    end = max(r[1] for r in rows)
    got = {r.k: r for r in rates.rate_stats(df, "k", -1000, end, 1000, 1000, 800, 3000, 7.0).collect()}
    for key in ("hot", "b", "single", "sparse"):
        s = [(t, d) for k, t, d in rows if k == key]
        if len(s) < 2:
            assert (got[key].samples, got[key].min_rate, got[key].p95_dt) == (1, 0.0, 0.0)
            continue
        dts = sorted(d for _, d in s)
        median = dts[len(dts) // 2]
        best, lo = float("inf"), 0
        for hi in range(len(s)):
            while s[hi][0] - s[lo][0] > 1000:
                lo += 1
            span = s[hi][0] - s[lo][0]
            if span >= 800:
                best = min(best, (hi - lo) / span * 1000)
        if best == float("inf"):
            best = 1000 / median
        r = got[key]
        assert r.samples == len(s) and r.min_rate == pytest.approx(best), key
        assert r.median_rate == pytest.approx(1000 / median)
        assert r.p95_dt == dts[min(len(dts) - 1, int(len(dts) * 0.95))]


def test_drops_after(spark):
    rng = random.Random(7)
    rows = [("a", rng.randrange(-500, 6000), rng.uniform(0, 60)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, ms bigint, dt double")
    got = {r.tick: r.drops for r in rates.drops_after(df, "k", 0, 700, 6, 1000, 33.4).collect()}
    want = {}
    for i in range(6):
        n = sum(1 for _, t, d in rows if i * 700 <= t <= i * 700 + 1000 and d > 33.4)
        if n:
            want[i] = n
    assert got == want


def bucket(times, sustained, burst, window):
    tokens, last, flags = float(burst), times[0], []
    for t in times:
        tokens = min(burst, tokens + (t - last) / window * sustained)
        last = t
        flags.append(tokens >= 1)
        tokens -= flags[-1]
    return flags


def test_maps_of_requests_compose():
    """Pieces of a run give what going through it gives, from every level; two levels never swap by a token."""
    rng = random.Random(5)
    for sustained, burst, window in ((15, 30, 60_000), (1, 3, 43_200), (7, 4, 100), (3, 2, 10)):
        unit, step, full = rates.bucket_units(sustained, burst, window)
        assert step * window == sustained * unit and full == burst * unit
        for _ in range(20):
            low = rng.randint(0, full)
            high = rng.randint(low, full)
            pieces, run = [(low, high, 1, low)], []
            for _ in range(120):
                run.append((int(rng.expovariate(1) * unit * rng.choice([0.2, 1, 3])), rng.choice([1, 1, 2, 5])))
                pieces = rates.admit_pieces(pieces, *run[-1], unit, full)

            def through(x):
                for added, n in run:
                    x = rates.admit(x, added, n, unit, full)[0]
                return x

            ends = through(0), through(full)
            for x in {low, high, *(rng.randint(low, high) for _ in range(20))}:
                assert through(x) == rates.apply_pieces(pieces, x)
                assert min(ends) - unit <= through(x) <= max(ends) + unit


@pytest.mark.parametrize("run_rows", [rates.RUN_ROWS, 7, 1])
def test_token_bucket(spark, run_rows):
    rng = random.Random(11)
    rows = []
    for key, n, pause in (("hot", 1500, True), ("busy", 1200, False), ("b", 200, True), ("c", 5, True)):
        t = 1_000_000
        for _ in range(n):
            t += rng.choice([0, 1, 40, 900, 5000]) if not pause or rng.random() < 0.98 else 300_000
            rows.append((key, t))
    df = spark.createDataFrame([*rows, (None, 5)], "k string, ms bigint").repartition(6)
    got = {(r.k, r.ms): (r.requests, r.accepted) for r in rates.token_bucket(df, "k", run_rows=run_rows).collect()}
    want: dict = {}
    for key in ("hot", "busy", "b", "c"):
        times = [t for k, t in rows if k == key]
        for t, ok in zip(times, bucket(times, 15, 30, 60_000)):
            n, a = want.get((key, t), (0, 0))
            want[(key, t)] = (n + 1, a + ok)
    assert got == want
    assert any(a < n for n, a in want.values())


def test_a_busy_key_is_many_runs(spark):
    df = spark.createDataFrame([("k", 1000 + 7 * i) for i in range(5000)], "key string, ms bigint")
    merged = df.groupBy("key", "ms").agg(F.count(F.lit(1)).alias("requests"))
    sizes = [r.n for r in rates.runs_of_requests(merged, "key", 1000, 64).select(F.size("rows").alias("n")).collect()]
    assert max(sizes) <= 64 and sum(sizes) == 5000


def test_arrivals(spark):
    now = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    before = spark.createDataFrame([("a",)], "id string")
    assert A.arrivals(None, now, NOW).count() == 0
    fresh = A.arrivals(before, now, NOW)
    assert {r.id for r in fresh.collect()} == {"b", "c"}
    assert A.alive(fresh, NOW + 10 * MIN).count() == 0 and A.alive(fresh, NOW + 10 * MIN - 1).count() == 2
    assert [r.id for r in A.newest(fresh, 1).collect()] == ["b"]
    assert {r.id for r in A.still_present(before, fresh).collect()} == set()


def test_labels(spark):
    df = spark.createDataFrame([(8.35, 3.0), (0.25, 2.5), (None, None), (-1.05, 1234.5), (7.0, 0.0)], "x double, y double")
    got = [tuple(r) for r in df.select(encode.magnitude_label("x"), encode.altitude_label("y", F.lit(False)), encode.speed_label("y")).collect()]
    assert got == [
        ("M8.3", "3 ft", "3 kt"), ("M0.3", "2.5 ft", "3 kt"), ("M?", "unknown", "unknown"),
        ("M-1.1", "1,234.5 ft", "1235 kt"), ("M7.0", "0 ft", "0 kt"),
    ]


def test_sizes(spark):
    r = spark.range(1).select(
        encode.flight_size(F.lit(0.0)).alias("f0"), encode.flight_size(F.lit(20.0)).alias("f20"), encode.square_size(F.lit(1.0)).alias("s1"),
        encode.news_scale(F.lit(100)).alias("n"), encode.quake_radius(F.lit(None).cast("double"), F.lit(1.0)).alias("q"),
        encode.quake_radius(F.lit(-3.0), F.lit(1.0)).alias("low"),
        encode.stale_badge(F.lit("stale"), F.lit(NOW - 1), NOW).alias("b1"), encode.stale_badge(F.lit("stale"), F.lit(NOW - 7 * MIN - 1), NOW).alias("b7"),
        encode.stale_badge(F.lit("ready"), F.lit(NOW), NOW).alias("b"),
    ).first()
    assert (r.f0, r.f20, r.s1, r.n, r.q, r.low) == (90_000.0, 1_500.0, 60_000.0, 1.75, 4.6, 3.0)
    assert (r.b1, r.b7, r.b) == ("1 min late", "7 min late", "ready")
