"""Merging, fingerprints and versioned publishing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from almagest.operators import latest, merge, slots

SCHEMA = "layer string, slot bigint, id string, revision bigint, value double, arrival_seq bigint"
S0 = 1_700_000_100 // 900 * 900


def frame(spark, rows):
    return spark.createDataFrame([("earthquake", *r) for r in rows], SCHEMA)


def values(df):
    return {(r.slot, r.id): r.value for r in df.collect()}


def test_revision_beats_arrival(spark):
    """Every pair of revisions in either order, against the rule stated in words."""
    pairs = [(f"r{old}-{new}", old, new) for old in range(4) for new in range(4)]
    stored = frame(spark, [(S0, k, old, 1.0, i) for i, (k, old, _) in enumerate(pairs)])
    fresh = frame(spark, [(S0, k, new, 2.0, 100 + i) for i, (k, _, new) in enumerate(pairs)])
    key = ["layer", "slot", "id"]
    by_revision = values(merge.merge_by_revision(stored, fresh, keys=key))
    assert by_revision == {(S0, k): 1.0 if old > new else 2.0 for k, old, new in pairs}
    assert set(values(merge.merge_by_arrival(stored, fresh, keys=key)).values()) == {2.0}


def test_fingerprint_ignores_order_and_sees_every_change(spark):
    rows = [(S0, f"r{i}", 1, float(i), i) for i in range(500)]
    content = ["id", "revision", "value"]

    def hash_of(rs, parts=3):
        return slots.fingerprint(frame(spark, rs).repartition(parts, F.rand(1)), slots.SLOT_KEY, content).first().hash

    base = hash_of(rows)
    assert hash_of(list(reversed(rows)), 7) == base
    assert hash_of([(s, i, r, v, q + 9) for s, i, r, v, q in rows]) == base  # arrival order is no content
    assert hash_of([*rows[:-1], (S0, "r499", 1, 0.5, 499)]) != base
    assert hash_of(rows[:-1]) != base
    swapped = [(S0, "r0", 1, 1.0, 0), (S0, "r1", 1, 0.0, 1), *rows[2:]]
    assert hash_of(swapped) != base


@pytest.fixture()
def table(spark, tmp_path):
    return slots.SlotTable(spark, str(tmp_path / "table"))


def test_publish_twice_changes_nothing(spark, table):
    rows = [(S0, "a", 1, 1.0, 1), (S0 + 900, "b", 1, 2.0, 2)]
    assert table.read() is None and table.pointers() is None
    first = table.publish(frame(spark, rows), dropped=3)
    assert [(r.slot, r.generation, r.records, r.incoming, r.dropped) for r in first.orderBy("slot").collect()] == [
        (S0, 0, 1, 1, 3), (S0 + 900, 0, 1, 1, 3)]
    assert table.publish(frame(spark, rows)).count() == 0
    assert table.publish(frame(spark, list(reversed(rows)))).count() == 0
    assert table.manifest().count() == 2


def test_only_changed_slots_get_a_generation(spark, table):
    table.publish(frame(spark, [(S0, "a", 1, 1.0, 1), (S0 + 900, "b", 5, 2.0, 2)]))
    out = table.publish(frame(spark, [(S0, "c", 1, 9.0, 3), (S0 + 900, "b", 4, 8.0, 4)])).collect()
    assert [(r.slot, r.generation, r.records) for r in out] == [(S0, 1, 2)]
    assert values(table.read()) == {(S0, "a"): 1.0, (S0, "c"): 9.0, (S0 + 900, "b"): 2.0}
    assert values(table.read(generation=0)) == {(S0, "a"): 1.0, (S0 + 900, "b"): 2.0}
    assert {(r.slot, r.generation) for r in table.pointers().collect()} == {(S0, 1), (S0 + 900, 0)}
    day = table.pointers().first().dt
    assert table.pointers(dt=day).count() == 2 and table.pointers(dt="2001-01-01").count() == 0


def test_as_known_at(spark, table):
    table.publish(frame(spark, [(S0, "a", 1, 1.0, 1)]), at_ms=1000)
    table.publish(frame(spark, [(S0, "a", 2, 2.0, 2)]), at_ms=2000)
    assert values(table.read(known_at_ms=1500)) == {(S0, "a"): 1.0}
    assert values(table.read(known_at_ms=2000)) == {(S0, "a"): 2.0}


def test_bodies_without_manifest_are_never_seen(spark, table):
    table.publish(frame(spark, [(S0, "a", 1, 1.0, 1)]))
    # A job that died after its bodies: same slot, next generation, no manifest row.
    orphan = spark.read.parquet(table.bodies_path).withColumns(
        {"generation": F.lit(1).cast("bigint"), "publish_id": F.lit("dead"), "value": F.lit(99.0)}
    )
    orphan.write.partitionBy("layer", "dt").mode("append").parquet(table.bodies_path)
    assert values(table.read()) == {(S0, "a"): 1.0}
    table.publish(frame(spark, [(S0, "a", 2, 5.0, 2)]))
    assert values(table.read()) == {(S0, "a"): 5.0}


def test_same_content(spark):
    a, b = frame(spark, [(S0, "a", 1, 1.0, 1)]), frame(spark, [(S0, "a", 1, 2.0, 1)])
    none = a.limit(0)
    same = lambda x, y: slots.same_content(x, y, ["id", "value"]).first().same
    assert (same(a, a), same(a, b), same(a, none), same(none, none)) == (True, False, False, True)


def test_commit_window_and_rebucket(spark):
    df = frame(spark, [(S0 + d, str(d), 1, 0.0, 1) for d in (0, -900, -1800, 900)])
    out = slots.commit_window(df, F.lit(S0 + 30).cast("bigint")).where("committed").collect()
    assert {r.id for r in out} == {"0", "-900"}
    old = frame(spark, [(S0 + 60, "x", 1, 0.0, 1), (S0 + 180, "y", 1, 0.0, 1)]).withColumn("slot_duration_sec", F.lit(60))
    assert {r.slot for r in slots.rebucket(old).collect()} == {S0}


def test_gaps(spark):
    df = frame(spark, [(S0, "a", 1, 0.0, 1), (S0 + 2700, "b", 1, 0.0, 1)])
    got = [(r.gap_from - S0, r.gap_to - S0, r.slots) for r in slots.gaps(df, "earthquake", S0, S0 + 4500).orderBy("gap_from").collect()]
    assert sum(n for _, _, n in got) == 3 and got[0][0] == 900


def test_retention_and_leftovers(spark):
    df = spark.createDataFrame([("2026-01-01",), ("2026-01-03",), ("2026-01-10",)], "dt string")
    assert {r.dt for r in slots.retained(df, "dt", 1_768_003_200_000, 7).collect()} == {"2026-01-03", "2026-01-10"}
    cycles = spark.createDataFrame([(0,), (3_600_000,), (7_200_000,)], "cycle bigint")
    assert [r.cycle for r in slots.abandoned_cycles(cycles, "cycle", 3 * 3_600_000 + 1).collect()] == [0]


def heads(spark, rows):
    return spark.createDataFrame(rows, "part string, as_of bigint")


def test_latest_moves_only_forward(spark):
    old = heads(spark, [("a", 5), ("b", 5), ("c", 5)])
    new = heads(spark, [("a", 4), ("b", 5), ("c", 6), ("d", 1)])
    got = {r.part: (r.as_of, r.replaced) for r in latest.replace_newer(old, new).collect()}
    assert got == {"a": (5, False), "b": (5, False), "c": (6, True), "d": (1, True)}


@pytest.mark.parametrize(
    "parts, want",
    [
        ([("a", 1, True), ("b", 3, True)], (["c"], [], 3, 2, True)),
        ([("a", 1, True), ("b", 3, False)], (["c"], ["b"], 1, 1, False)),
        ([], (["a", "b", "c"], [], None, 0, False)),
    ],
)
def test_assembly(spark, parts, want):
    expected = spark.createDataFrame([(p,) for p in "abc"], "part string")
    df = spark.createDataFrame(parts, "part string, uploaded_at bigint, valid boolean")
    r = latest.assemble(df, expected).first()
    assert (r.partial, r.invalid, r.updated_at, r.present, r.publish) == want


def test_latest_table(spark, tmp_path):
    table = latest.LatestTable(spark, str(tmp_path / "latest"))
    rows = lambda *xs: spark.createDataFrame(xs, "part string, id string")
    assert table.read() is None and table.headers() is None
    table.publish(rows(("a", "1"), ("b", "2")), heads(spark, [("a", 5), ("b", 5)]))
    out = table.publish(rows(("a", "3"), ("b", "4"), ("c", "6")), heads(spark, [("a", 5), ("b", 6), ("c", 1)]))
    assert {r.part for r in out.collect()} == {"b", "c"}
    assert {(r.part, r.id) for r in table.read().collect()} == {("a", "1"), ("b", "4"), ("c", "6")}
    table.publish(rows(("x", "0")).limit(0), heads(spark, [("b", 9)]))  # an empty world is a result too
    assert {(r.part, r.id) for r in table.read().collect()} == {("a", "1"), ("c", "6")}
    assert [r.id for r in table.read("c").collect()] == ["6"]
    table.publish(rows(("01", "7")), heads(spark, [("01", 1)]))  # part names stay text
    assert [(r.part, r.id) for r in table.read("01").collect()] == [("01", "7")]


def test_body_check(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":',), ("{}",), ("[1,2]",), (None,)], "b string")
    assert [r.v for r in df.select(latest.body_is_object("b").alias("v")).collect()] == [True, False, False, False, False]


def test_changed_parts(spark):
    got = {r.part: r.change for r in latest.changed_parts(heads(spark, [("a", 1), ("b", 1), ("c", None)]), heads(spark, [("a", 1), ("b", 2), ("c", None), ("d", 1)])).collect()}
    assert got == {"b": "moved", "d": "added"}
