"""Related events against all pairs."""

from __future__ import annotations

import math
import random

import pytest

from almagest.operators.related import related_events
from almagest.schema import EARTH_KM

SCHEMA = "id long, ms long, lon double, lat double"


def km(a, b):
    p, q = math.radians(a[3]), math.radians(b[3])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


def brute(rows, within_km, within_ms):
    sound = [r for r in rows if None not in r[1:] and -180 <= r[2] <= 180 and -90 <= r[3] <= 90 and not (r[2] == 0 and r[3] == 0)]
    sound.sort(key=lambda r: (r[1], r[0]))
    out = set()
    for i, a in enumerate(sound):
        for b in sound[i + 1 :]:
            if b[1] - a[1] >= within_ms:
                break
            if km(a, b) < within_km:
                out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize(("within_km", "block_rows"), [(300.0, 2000), (300.0, 3), (2500.0, 20), (9000.0, 2000), (30000.0, 50)])
def test_pairs_equal_brute_force(spark, within_km, block_rows):
    rng = random.Random(within_km)
    rows = []
    for i in range(400):
        lon, lat = rng.choice([
            (rng.uniform(-180, 180), rng.uniform(-90, 90)),
            (rng.choice([-180.0, 180.0, 179.9, -179.95]), rng.uniform(-60, 60)),  # the date line
            (rng.uniform(-180, 180), rng.choice([89.5, -89.9, 90.0, -90.0, 87.2])),  # the poles
            (10 + rng.gauss(0, 2), 50 + rng.gauss(0, 1.5)),  # a crowd
        ])
        rows.append((i, rng.randrange(0, 6 * 3_600_000, rng.choice([1, 3_600_000])), lon, lat))
    rows += [(900, None, 1.0, 1.0), (901, 5, None, 1.0), (902, 5, 0.0, 0.0), (903, 5, 200.0, 3.0), (904, -5, 1.0, 1.0), (905, 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = related_events(df, "id", "ms", within_km=within_km, block_rows=block_rows).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} == brute(rows, within_km, 3_600_000)
    by_id = {r[0]: r for r in rows}
    assert all(r.km == pytest.approx(km(by_id[r.a], by_id[r.b]), abs=1e-6) and r.dt_ms == by_id[r.b][1] - by_id[r.a][1] for r in got)


def test_a_hot_cell_is_many_tasks_work(spark):
    """A third of all rows in one cell: its rows are dealt into blocks that no task has alone."""
    rng = random.Random(4)
    hot = [(i, 1000 + i, 10 + rng.random(), 50 + rng.random()) for i in range(300)]
    cold = [(1000 + i, 10_000_000 * i, rng.uniform(-180, 180), rng.uniform(-80, 80)) for i in range(600)]
    df = spark.createDataFrame(hot + cold, SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = related_events(df, "id", "ms", block_rows=20)
        sizes = [n for n in pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == len(brute(hot + cold, 300.0, 3_600_000)) and len(sizes) >= 5 and max(sizes) < 0.5 * sum(sizes)


def shuffled_rows(plan) -> int:
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_few_copies_of_a_row_are_shuffled(spark):
    """Six copies in the mean and one at home, each shuffled once; near the poles there are more."""
    rng = random.Random(6)
    rows = [(i, rng.randrange(100 * 3_600_000), rng.uniform(-180, 180), rng.uniform(-60, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "20000"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        pairs = related_events(df, "id", "ms")
        assert {(r.a, r.b) for r in pairs.collect()} == brute(rows, 300.0, 3_600_000)
        assert shuffled_rows(pairs._jdf.queryExecution().executedPlan()) < 9 * len(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
