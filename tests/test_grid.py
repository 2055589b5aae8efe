"""News rows and grid cells."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from almagest.operators import grid
from almagest.sources import landed

SCHEMA = "file_sec bigint, line_no bigint, mentions string, articles string, place string, url string, lat string, lon string"


def fold(rows):
    """The rule as it is stated: walk the file, keep the running maximum."""
    cells = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        f, _, m, a, place, url, lat, lon = r
        if lat == "" or lon == "":
            continue
        x, y = float(lon), float(lat)
        if (x, y) == (0, 0) or abs(x) > 180 or abs(y) > 90:
            continue
        key = (f, int((-180 if x == 180 else x) // 0.5), min(int(y // 0.5), 179))
        cell = cells.setdefault(key, {"sum": 0.0, "top": -1.0, "place": None, "url": None, "n": 0})
        cell["n"] += 1
        articles = float(a or 0)
        cell["sum"] += articles if articles > 0 else 0
        mentions = float(m or 0)
        if mentions > cell["top"]:
            cell["top"] = mentions
            cell["url"] = url.strip() or cell["url"]
            cell["place"] = place.strip() or cell["place"]
    return {k: (c["sum"], c["n"], c["place"], c["url"]) for k, c in cells.items()}


def run(spark, rows, shuffle=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if shuffle:
        df = df.repartition(7, F.rand(4))
    typed = grid.news_rows(df)
    cells = grid.news_cells(typed.where("kept"))
    return {
        (r.file_sec, r.lon_idx, r.lat_idx): (r.article_sum, r.rows, r.place_name, r.sample_url) for r in cells.collect()
    }


def test_representative_follows_the_running_maximum(spark):
    rng = random.Random(9)
    rows = []
    for n in range(3000):
        hot = rng.random() < 0.34
        lon, lat = ("10.1", "20.1") if hot else (str(rng.choice([-180, 180, 0, 10.1, 999])), str(rng.choice([90, -90, 0, 20.1])))
        rows.append((
            rng.randrange(3), n, rng.choice(["", "0", "3", "7", "7", "12", "-2", str(rng.randrange(40))]), rng.choice(["", "2", "-1", "5"]),
            rng.choice(["", "  ", "A", "B"]), rng.choice(["", "u1", " u2\r"]), rng.choice([lat, lat, ""]), lon,
        ))
    want = fold(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, shuffle=True) == want


def test_later_greater_row_without_url_keeps_the_earlier_url(spark):
    rows = [(0, 0, "5", "1", "A", "u1", "1", "1"), (0, 1, "9", "1", "B", "", "1", "1"), (0, 2, "7", "1", "C", "u3", "1", "1")]
    assert list(run(spark, rows).values()) == [(3.0, 3, "B", "u1")]


def test_equal_mentions_keep_the_first(spark):
    rows = [(0, 0, "5", "1", "A", "u1", "1", "1"), (0, 1, "5", "1", "B", "u2", "1", "1")]
    assert list(run(spark, rows).values()) == [(2.0, 2, "A", "u1")]


def test_non_finite_mentions_never_win(spark):
    rows = [(0, 0, "NaN", "1", "A", "u1", "1", "1"), (0, 1, "1e999", "1", "B", "u2", "1", "1"), (0, 2, "0", "1", "C", "u3", "1", "1")]
    assert list(run(spark, rows).values()) == [(3.0, 3, "C", "u3")]


def test_meridian_and_pole(spark):
    rows = [(0, 0, "1", "1", "", "", "90", "180"), (0, 1, "1", "1", "", "", "89.9", "-180")]
    assert set(run(spark, rows)) == {(0, -360, 179)}


def test_lines(spark):
    def line(**at):
        cells = ["x"] * 61
        named = {"mentions": 31, "articles": 33, "place": 52, "lat": 56, "lon": 57, "url": 60}
        for k, v in {**dict(mentions="1", articles="2", place="P", lat="1", lon="2", url="u"), **at}.items():
            cells[named[k]] = v
        return "\t".join(cells)

    lines = [line(), line(lat=""), line() + "\r", "", "\r", "\t".join(["x"] * 60), line(lat="0", lon="0"), line(lon="abc")]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(lines)], "file_sec bigint, line_no bigint, line string")
    rows = grid.news_rows(landed.news_lines(df))
    assert [r.asDict() for r in grid.news_counters(rows).collect()] == [{"file_sec": 0, "rows": 6, "dropped": 4}]
    kept = {r.line_no: r.url for r in rows.where("kept").collect()}
    assert kept == {0: "u", 2: "u"}


def test_record_shape(spark):
    rows = [(1_700_000_100, 0, "1", "60", "Tokyo", "u", "35.6", "139.7")]
    cells = grid.news_cells(grid.news_rows(spark.createDataFrame(rows, SCHEMA)).where("kept"))
    r = grid.news_records(cells, F.timestamp_millis(F.lit(0))).first()
    assert r.id == "gdelt:1700000100:279:71" and (r.lon, r.lat) == (139.75, 35.75)
    assert (r.severity.rank, r.severity.label, r.severity.unit) == (3, "60 articles", "count")
    assert r.news.place_name == "Tokyo"
