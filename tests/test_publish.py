"""Gated cycles, vacuum and pins."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from almagest.operators import ledger, retention, slots
from almagest.operators.latest import LatestDocument, LatestTable
from almagest.operators.ordered import OrderedTable
from almagest.operators.publish import GatedTable
from almagest.session import shared_dir, work_root
from test_slots import S0, frame, values

PAGES = "cycle bigint, level string, page bigint, features bigint, current bigint, failed boolean"
RECORDS = "cycle bigint, level string, page bigint, part string, id bigint, value double"
LEVELS = ["Green", "Orange", "Red"]
DAY = 86_400_000


def cycle(spark, number, part, capped=False, without=None, failed=None, n=3):
    """Three levels of one page each; a capped cycle has eight full pages of Green."""
    pages, records = [], []
    for level in LEVELS:
        for page in range(1, (8 if capped and level == "Green" else 1) + 1):
            size = 100 if capped and level == "Green" else n
            bad = (level, page) == failed
            pages.append((number, level, page, size, size, bad))
            if not bad and (level, page) != without:
                records += [(number, level, page, part, 10_000 * LEVELS.index(level) + 200 * page + i, float(number)) for i in range(size)]
    return spark.createDataFrame(records, RECORDS), spark.createDataFrame(pages, PAGES)


def shown(table):
    rows = table.latest.read()
    return {} if rows is None else {(r.part, r.cycle): r["count"] for r in rows.groupBy("part", "cycle").count().collect()}


def test_gate(spark, tmp_path):
    table = GatedTable(spark, str(tmp_path))
    assert table.publish().count() == 0 and shown(table) == {}
    for args in ((3600, "a"), (7200, "b", True), (10_800, "a", False, ("Red", 1)), (14_400, "b", False, None, ("Green", 1))):
        table.stage(*cycle(spark, *args))
    decided = {r.cycle: (r.outcome, r.ok, r.missing) for r in table.publish().collect()}
    assert decided == {3600: ("published", True, 0), 7200: ("capped", False, 0), 10_800: ("withheld", False, 1), 14_400: ("withheld", False, 0)}
    assert shown(table) == {("a", 3600): 9, ("b", 7200): 806}
    # the lost page comes after all; the other cycle stays withheld, the older snapshot visible
    records, pages = cycle(spark, 10_800, "a")
    table.stage(records.where("level = 'Red'"), pages.where("level = 'Red'"))
    assert {r.cycle: r.outcome for r in table.publish().collect()} == {10_800: "published", 14_400: "withheld"}
    assert shown(table) == {("a", 10_800): 9, ("b", 7200): 806}
    # staged twice counts once; an older cycle that becomes whole replaces nothing newer
    table.stage(*cycle(spark, 14_400, "b"))
    table.stage(*cycle(spark, 14_400, "b"))
    table.stage(*cycle(spark, 1800, "a"))
    assert {r.cycle: r.outcome for r in table.publish().collect()} == {14_400: "published", 1800: "published"}
    assert shown(table) == {("a", 10_800): 9, ("b", 14_400): 9}
    assert table.publish().count() == 0


def test_many_cycles_make_few_folders(spark, tmp_path):
    """Staged files grow with the rows: forty cycles of two hours lie in two folders."""
    table = GatedTable(spark, str(tmp_path))
    both = [cycle(spark, 7200 + 180 * i, f"p{i}") for i in range(40)]
    records, pages = (both[0][k] for k in (0, 1))
    for r, p in both[1:]:
        records, pages = records.unionByName(r), pages.unionByName(p)
    table.stage(records, pages)
    for name in ("records", "pages"):
        assert len([f for f in os.listdir(tmp_path / "staging" / name) if "=" in f]) == 2
    assert {r.outcome for r in table.publish().collect()} == {"published"}
    assert shown(table) == {(f"p{i}", 7200 + 180 * i): 9 for i in range(40)}
    assert set(table.latest.read().columns) == {"part", "publish_id", "cycle", "level", "page", "id", "value"}
    # an hour is kept until its last cycle is too old
    assert retention.vacuum_staging(spark, str(tmp_path), 10_800_000 + 3 * 3_600_000 - 1) == 0
    assert retention.vacuum_staging(spark, str(tmp_path), 10_800_000 + 3 * 3_600_000) == 2


def test_halt_row_withholds_everything(spark, tmp_path):
    table = GatedTable(spark, str(tmp_path))
    table.stage(*cycle(spark, 3600, "a"))
    objects = spark.createDataFrame([("x", 10), ("y", 20)], "prefix string, bytes bigint")
    over, within = (ledger.halt_rows(ledger.usage(objects, "prefix", "bytes", limit)) for limit in (29, 30))
    assert [(r.outcome, r.publish) for r in table.publish(halt=over).collect()] == [("halted", False)] and shown(table) == {}
    assert [r.outcome for r in table.publish(halt=within).collect()] == ["published"] and shown(table) == {("a", 3600): 9}


def files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_vacuum_respects_readers_and_pins(spark, tmp_path):
    table = slots.SlotTable(spark, str(tmp_path / "t"))
    now = (S0 + 900) * 1000
    assert retention.vacuum_slots(table, now) == 0
    table.publish(frame(spark, [(S0, "a", 1, 1.0, 1), (S0 + 86_400, "b", 1, 2.0, 2)]), at_ms=now)
    pins = retention.Pins(table)
    pins.pin("one", ["earthquake"], S0, S0 + 1, now + 1)
    table.publish(frame(spark, [(S0, "a", 2, 5.0, 3), (S0 + 86_400, "b", 2, 6.0, 4)]), at_ms=now + 10)
    table.publish(frame(spark, [(S0, "a", 3, 7.0, 5)]), at_ms=now + 20)
    before = files(table.bodies_path)
    assert retention.vacuum_slots(table, now + 30) == 0  # readers of a moment ago
    later = now + retention.GRACE_MS + 30
    assert retention.vacuum_slots(table, later) == 2 and len(files(table.bodies_path)) == len(before) - 2
    current = {(S0, "a"): 7.0, (S0 + 86_400, "b"): 6.0}
    assert values(table.read()) == current and values(pins.read("one")) == {(S0, "a"): 1.0}
    assert table.manifest().count() == 5 and values(table.read(generation=1)) == {(S0 + 86_400, "b"): 6.0}
    pins.unpin("one", now + 40)
    pins.pin("two", ["earthquake"], S0, S0 + 1, now + 41)
    assert pins.read("one").count() == 0
    assert retention.vacuum_slots(table, later) == 1 and values(pins.read("two")) == {(S0, "a"): 7.0}
    # too old by date: only what a pin names stays
    assert retention.vacuum_slots(table, now + 200 * DAY) == 1
    assert values(table.read()) == {(S0, "a"): 7.0} and retention.vacuum_slots(table, now + 200 * DAY) == 0


def test_vacuum_leaves_a_publish_under_way(spark, tmp_path):
    """Bodies without a manifest row go only when they are old."""
    table = slots.SlotTable(spark, str(tmp_path / "t"))
    table.publish(frame(spark, [(S0, "a", 1, 1.0, 1)]), at_ms=S0 * 1000)
    table.spark.read.parquet(table.bodies_path).withColumn("publish_id", F.lit("running")).write.partitionBy("layer", "dt").mode("append").parquet(table.bodies_path)
    written = int(max(os.path.getmtime(f) for f in files(table.bodies_path)) * 1000)
    assert retention.vacuum_slots(table, written, days=10_000) == 0
    assert retention.vacuum_slots(table, written + retention.GRACE_MS + 60_000, days=10_000) == 1
    assert values(table.read()) == {(S0, "a"): 1.0}


def test_vacuum_of_latest_snapshots(spark, tmp_path):
    table = LatestTable(spark, str(tmp_path / "latest"))
    assert retention.vacuum_latest(table, 0) == 0

    def publish(hour, parts, at):
        rows = [(p, f"{p}{i}", float(hour)) for p in parts for i in range(3)]
        headers = spark.createDataFrame([(p, hour) for p in parts], "part string, h bigint").select("part", F.timestamp_seconds(F.col("h") * 3600).alias("as_of"))
        table.publish(spark.createDataFrame(rows, "part string, id string, value double"), headers, at_ms=at)

    at = 1_700_000_000_000
    publish(1, ["a b", "01"], at)
    publish(2, ["a b"], at + 1)
    publish(3, ["a b"], at + 2)
    want = {("a b", 3.0), ("01", 1.0)}
    assert retention.vacuum_latest(table, at + 3) == 0
    assert retention.vacuum_latest(table, at + 3 + retention.GRACE_MS) == 2
    assert {(r.part, r.value) for r in table.read().collect()} == want and len(os.listdir(f"{table.records_path}/part=a b")) == 1


def test_vacuum_of_staging_and_dates(spark, tmp_path):
    table = GatedTable(spark, str(tmp_path))
    for c in (3600, 7200):
        table.stage(*cycle(spark, c, "a"))
    assert retention.vacuum_staging(spark, str(tmp_path), 7200 * 1000 + 3 * 3_600_000) == 2
    assert {r.cycle for r in table.pending_pages().collect()} == {7200}
    spark.createDataFrame([("2024-01-01", 1), ("2024-01-08", 2)], "dt string, x int").write.partitionBy("dt").parquet(str(tmp_path / "raw"))
    assert retention.vacuum_dates(spark, str(tmp_path / "raw"), 1_704_700_800_000 + 7 * DAY, 7) == 1  # seven days before 2024-01-15
    assert retention.vacuum_dates(spark, str(tmp_path / "none"), 0, 7) == 0
    assert os.listdir(tmp_path / "raw").count("dt=2024-01-08") == 1


def test_nothing_pinned_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        retention.Pins(slots.SlotTable(spark, str(tmp_path / "t"))).pin("x", ["earthquake"], 0, 1, 0)


def test_ledger_goes_on_from_the_batches_before(spark, tmp_path):
    log = ledger.StatusLedger(spark, str(tmp_path / "ledger"))
    schema = "layer string, slot bigint, scheduled_ms bigint, note string"

    def run(batch, *rows):
        stored = log.append(spark.createDataFrame(list(rows), schema), batch, [F.col("note").asc()])
        return sorted((r.layer, r.slot, r.note, r.attempt) for r in stored.collect())

    assert run(0, ("a", S0, 1, "x"), ("a", S0, 1, "y"), ("b", S0, None, "z")) == [("a", S0, "x", 0), ("a", S0, "y", 1), ("b", S0, "z", 0)]
    second = [("a", S0, 1, "again"), ("a", S0, 2, "other time"), ("b", S0, None, "again"), ("a", S0 + 86_400, 1, "other day")]
    want = [("a", S0, "again", 2), ("a", S0, "other time", 0), ("a", S0 + 86_400, "other day", 0), ("b", S0, "again", 1)]
    assert run(1, *second) == want and run(1, *second) == want
    assert log.rows().count() == 7


def test_outcomes(spark):
    cases = [(True, 0, 0, False), (False, 5, 0, True), (False, 0, 0, False), (False, 5, 1, False), (False, 5, 0, False)]
    df = spark.createDataFrame(cases, "f boolean, n int, d int, c boolean")
    got = [r.o for r in df.select(ledger.outcome_of(F.col("f"), F.col("n"), F.col("d"), F.col("c")).alias("o")).collect()]
    assert got == ["failed", "degraded", "empty", "partial", None]


def test_latest_document(spark, tmp_path):
    names = ("quake", 'a"b', "flight:x", "flight:y")
    table = LatestDocument(spark, str(tmp_path / "doc"), names)

    def publish(*parts):
        df = spark.createDataFrame([(p, b, 1_700_000_000 + i) for i, (p, b) in enumerate(parts)], "part string, body string, s bigint")
        return table.publish(df.select("part", "body", F.timestamp_seconds("s").alias("uploaded_at")))

    assert not publish() and table.read() is None
    assert not publish(("other", "{}x"))
    assert publish(("flight:y", '{"n": 1}'), ("quake", '{"n": 2}'), ("other", "broken"))
    one = json.loads(table.read().first().document)
    assert one == {"updatedAt": "2023-11-14T22:13:21.000Z", "partial": ['a"b', "flight:x"], "layers": {"quake": {"n": 2}, "flight": {"regions": {"y": {"n": 1}}}}}
    assert not publish(*((n, '{"n": 3}' if n != "flight:x" else '{"n": 3') for n in names))  # one broken part
    assert not publish() and json.loads(table.read().first().document) == one
    assert publish(*((n, '{"n": 4}') for n in names))
    assert json.loads(table.read().first().document)["layers"] == {"quake": {"n": 4}, 'a"b': {"n": 4}, "flight": {"regions": {"x": {"n": 4}, "y": {"n": 4}}}}
    assert table.rows().count() == 2


def test_canonical_order(spark, tmp_path):
    table = OrderedTable(spark, str(tmp_path / "t"), "id")
    ids = [f"k{i % 700}" for i in range(3000)] + ["hot"] * 900 + [None] * 5
    table.write(spark.createDataFrame([(k, i) for i, k in enumerate(ids)], "id string, n long").repartition(7), 300)
    assert table.is_sorted().first().sorted and table.bounds().count() > 8
    assert table.bounds().agg(F.sum("rows"), F.sum("nulls")).first() == (3905, 5)
    assert len(table.files("k55", "k55")) <= 2 and table.read("k55", "k55").count() == ids.count("k55")
    assert table.read("hot", "hot").count() == 900 and len(table.files("hot", "hot")) >= 3  # a hot key is not one file
    assert table.read("k1", "k2").count() == sum("k1" <= k <= "k2" for k in ids if k)
    assert table.read("x", "z").count() == 0 and table.files("x", "z") == []


def test_vacuum_of_intermediate_tables(spark):
    own, other = shared_dir(spark, "some-purpose"), f"{work_root(spark)}/not-one-of-ours"
    for path in (own, other):
        spark.range(3).write.parquet(path)
    now = int(os.path.getmtime(own) * 1000)
    assert retention.vacuum_work(spark, now) == 0 and os.path.exists(own)
    assert retention.vacuum_work(spark, now + DAY + 5_000, DAY) >= 1
    assert not os.path.exists(own) and os.path.exists(other)
