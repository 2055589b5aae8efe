"""Normalizers on hand-written documents."""

from __future__ import annotations

import datetime as dt
import io
import random
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from almagest.schema import WORLD_RECORD
from almagest.sources import feeds, landed

NOW = dt.datetime(2026, 1, 10, 12, 0, 0)


def docs(spark, *bodies, **more):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "doc_no bigint, body string")
    at = F.lit("2026-01-10 12:00:00").cast("timestamp")
    return df.withColumns({"ingested_at": at, "scheduled_at": at, "region_id": F.lit("tokyo"), **more})


def quake(**props):
    base = {"mag": 5.5, "magType": "mww", "place": "Here", "time": 1_767_000_000_000, "updated": 1_767_000_000_500,
            "tsunami": 1, "status": "reviewed", "url": "u"}
    return {"id": "q1", "properties": {**base, **props}, "geometry": {"type": "Point", "coordinates": [10.5, -20.25, 33.1]}}


def verdicts(rows):
    return [r.verdict for r in rows.orderBy("arrival_seq").collect()]


def test_quake_golden(spark):
    r = feeds.quakes(docs(spark, {"features": [quake()]})).first()
    assert (r.id, r.revision, r.lon, r.lat, r.verdict) == ("usgs:q1", 1_767_000_000_500, 10.5, -20.25, "ok")
    assert r.geometry.point == [10.5, -20.25, -33100.0]
    assert (r.severity.rank, r.severity.raw, r.severity.label) == (3, 5.5, "M5.5")
    assert r.quake.tsunami is True and r.quake.depth_km == 33.1


def test_quake_types_are_strict(spark):
    bad = [
        {**quake(), "id": 5}, {**quake(), "id": ""}, quake(time="1767000000000"), {**quake(), "geometry": {"coordinates": "x"}},
        {**quake(), "geometry": {"coordinates": [0, 0, 1]}}, {**quake(), "geometry": {"coordinates": ["1", 2]}}, {"id": "x"}, 7, None,
    ]
    odd = [quake(mag=None), quake(mag="6"), quake(tsunami="1", updated=None), {**quake(), "geometry": {"coordinates": [1, 2]}}]
    rows = feeds.quakes(docs(spark, {"features": [*bad, *odd]}))
    assert verdicts(rows) == ["dropped"] * 9 + ["ok"] * 4
    good = feeds.records(rows).orderBy("arrival_seq").collect()
    assert [r.severity.rank for r in good] == [0, 0, 3, 3]
    assert [r.quake.magnitude for r in good] == [None, None, 5.5, 5.5]
    assert good[2].revision == 1_767_000_000_000 and good[2].quake.tsunami is False
    assert good[3].geometry.point == [1.0, 2.0] and good[3].quake.depth_km is None
    assert good[0].severity.label is None


def test_missing_container_is_a_failure_and_empty_is_not(spark):
    d = docs(spark, {"features": []}, {"error": 1}, "nonsense", {"features": {"a": 1}}, {"features": [quake()]})
    got = {r.doc_no: r.outcome for r in feeds.document_status(d, "features").collect()}
    assert got == {0: "empty", 1: "failed", 2: "failed", 3: "failed", 4: "ok"}
    assert feeds.quakes(d).count() == 1


def test_records_fit_the_model(spark):
    model = {f.name: f.dataType for f in WORLD_RECORD.fields}
    for rows in (
        feeds.quakes(docs(spark, {"features": []})), feeds.aircraft(docs(spark, {"ac": []})), feeds.alerts(docs(spark, {"features": []}))
    ):
        for field in feeds.records(rows).schema.fields:
            assert field.name in model
            got, want = field.dataType.simpleString(), model[field.name].simpleString()
            assert got == want, (field.name, got, want)


def plane(**more):
    return {"hex": " ABC123 ", "lat": 35.0, "lon": 139.0, "alt_baro": 30000, "gs": 450.5, "track": 90, "flight": "ANA1  ",
            "t": "B738", "r": " ", "category": "A3", "seen_pos": 2.5, **more}


def test_aircraft(spark):
    body = {"now": 1_768_046_400_000, "ac": [plane(), plane(alt_baro="ground"), plane(lat=None), plane(lat=0, lon=0), plane(hex=" "), plane(alt_baro="low")]}
    rows = feeds.aircraft(docs(spark, body))
    assert verdicts(rows) == ["ok", "ok", "dropped", "dropped", "dropped", "ok"]
    a, g, odd = feeds.records(rows).orderBy("arrival_seq").collect()
    bucket = int(dt.datetime(2026, 1, 10, 12, tzinfo=dt.timezone.utc).timestamp()) // 180 * 180
    assert a.id == f"adsblol:abc123:{bucket}" and a.entity_id == "abc123"
    assert a.sampled_at == dt.datetime.fromtimestamp(1_768_046_397.5, dt.timezone.utc).replace(tzinfo=None) or a.sampled_at.timestamp() == 1_768_046_397.5
    assert (a.flight.callsign, a.flight.registration, a.flight.alt_baro_ft) == ("ANA1", None, 30000.0)
    assert (g.flight.on_ground, g.flight.alt_baro_ft) == (True, None)
    assert (odd.flight.on_ground, odd.flight.alt_baro_ft) == (False, None)


def alert(**p):
    base = {"eventtype": "TC", "eventid": 7, "episodeid": 2, "name": "N", "alertlevel": "Red", "fromdate": "2026-01-01T00:00:00",
            "todate": "2026-01-09T00:00:00", "datemodified": "2026-01-02T00:00:00", "iscurrent": "true", "country": "X",
            "severitydata": {"severity": 120.5, "severitytext": "fast"}, "url": {"report": "r"}}
    return {"properties": {**base, **p}, "geometry": {"type": "Point", "coordinates": [150.0, 10.0]}}


def test_alerts(spark):
    items = [
        alert(), alert(iscurrent=False), alert(iscurrent="false", todate="2026-01-08T11:59:59"), alert(iscurrent=False, todate=None),
        alert(alertlevel="Purple"), alert(eventid="7"), alert(fromdate="soon"), alert(datemodified="", fromdate="2026-01-01T02:00:00+02:00"),
        alert(iscurrent=False, todate="2026-01-08T12:00:00"),
    ]
    rows = feeds.alerts(docs(spark, {"features": items}))
    assert verdicts(rows) == ["ok", "ok", "skipped", "skipped", "dropped", "dropped", "dropped", "ok", "ok"]
    good = rows.where("verdict = 'ok'").select("*", F.unix_millis("valid_from").alias("f"), F.unix_millis("valid_to").alias("t")).orderBy("arrival_seq").collect()
    assert good[0].valid_to is None and good[0].status == "active" and good[0].alert.observed_until is not None
    assert good[1].t == 1_767_916_800_000 and good[1].status == "expired"
    assert (good[0].id, good[0].severity.rank, good[0].severity.label) == ("gdacs:7:2", 4, "TC Red")
    assert good[0].revision == 1_767_312_000_000 and good[2].revision == good[2].f == 1_767_225_600_000
    c = feeds.counters(rows).first()
    assert (c.incoming, c.records, c.dropped, c.skipped) == (9, 4, 3, 2)


def test_cyclone_geometry(spark):
    def feature(cls, kind, coordinates):
        return {"properties": {"Class": cls}, "geometry": {"type": kind, "coordinates": coordinates}}

    def box(lon, lat):
        return [[[lon - 1, lat], [lon + 1, lat], [lon, lat + 1], [lon - 1, lat]]]

    good = {"features": [
        feature("Point_Polygon_Point_10", "Polygon", box(30, 3)), feature("Point_Polygon_Point_2", "Polygon", box(20, 2)),
        feature("Point_Polygon_Point_1", "Polygon", box(10, 1)), feature("Point_Centroid", "Point", [5, 6]),
        feature("Poly_Cones", "Polygon", [[[0, 1], [1, 1], ["x", 2], [1, 0], [0, 1]]]), feature("Poly_Red", "Polygon", box(0, 1)),
        feature("Point_Polygon_Point_3", "LineString", box(40, 4)), {"properties": {}}, 3,
    ]}
    single = {"features": [feature("Point_Polygon_Point_1", "Polygon", box(10, 1)), feature("Poly_Cones", "Polygon", [[[0, 1], [1, 1]]])]}
    rows = {r.doc_no: r for r in feeds.cyclone_geometry(docs(spark, good, single, {"x": 1})).collect()}
    assert [round(p[0]) for p in rows[0].track] == [10, 20, 30]
    assert rows[0].cone == [[[0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [0.0, 1.0]]] and rows[0].centroid == [5.0, 6.0]
    assert rows[1].track is None and rows[1].cone is None and rows[1].centroid is None
    assert rows[2].track is None


def test_zip_exports(spark, tmp_path):
    def write(name, text):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.CSV", text)

    write("20260110120000.export.CSV.zip", "a\tb\nc\td\n")
    write("20260110121500.export.CSV.zip", "x" * 5000)
    (tmp_path / "20260110123000.export.CSV.zip").write_bytes(b"not a zip")
    buffer = io.BytesIO()
    zipfile.ZipFile(buffer, "w").close()
    (tmp_path / "20260110124500.export.CSV.zip").write_bytes(buffer.getvalue())
    lines, status = landed.unzip_exports(spark, str(tmp_path), limit_bytes=1000)
    assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == [(0, "a\tb"), (1, "c\td")]
    got = {r.path[-29:-15]: r.outcome for r in status.collect()}
    assert got == {"20260110120000": "ok", "20260110121500": "degraded", "20260110123000": "failed", "20260110124500": "failed"}
    stamped = lines.select(F.unix_seconds(landed.export_stamp("path")).alias("s")).first()
    assert stamped.s == 1_768_046_400
    # without a limit nothing is too large
    lines, status = landed.unzip_exports(spark, str(tmp_path))
    assert lines.count() == 3 and status.where("outcome = 'degraded'").count() == 0


def test_damaged_zip_gives_no_line(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(f"{rng.random()}\n" for _ in range(30_000))
    path = tmp_path / "20260110120000.export.CSV.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.CSV", text)
    raw = bytearray(path.read_bytes())
    raw[len(raw) * 9 // 10] ^= 0xFF
    path.write_bytes(raw)
    lines, status = landed.unzip_exports(spark, str(tmp_path))
    assert lines.count() == 0 and [r.outcome for r in status.collect()] == ["failed"]


def test_landing_archive_and_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"features":\n[]}')
    read = landed.read_documents(spark, str(tmp_path / "in"))
    assert read.first().body == '{"features":\n[]}'
    landed.archive_raw(read.withColumn("source", F.lit("usgs")), str(tmp_path / "raw"))
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert back.count() == 1 and {"source", "dt", "hour"} <= set(back.columns)
    assert [r.length for r in landed.listing(spark, str(tmp_path / "in")).collect()] == [16]


@pytest.mark.parametrize(
    "slot, date, g, ok",
    [
        (1_768_046_400, "2026-01-10", "0", True), (1_768_046_401, "2026-01-10", "0", False), (900, "2026-01-10", "0", False),
        (1_768_046_400, "2026-02-30", "0", False), (1_768_046_400, "2026-1-1", "0", False), (1_768_046_400, "2026-01-10", "00", False),
        (1_768_046_400, "2019-12-31", "0", False), (1_768_046_400, "2026-01-10", "1234567", False), (4_102_444_800, "2026-01-10", "1", False),
    ],
)
def test_addresses(spark, slot, date, g, ok):
    df = spark.createDataFrame([(slot, date, g)], "slot bigint, date string, g string")
    assert feeds.addressable(df, "slot", "date", "g").count() == int(ok)
