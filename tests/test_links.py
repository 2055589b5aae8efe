"""View state in links."""

from __future__ import annotations

import random
from urllib.parse import quote_plus

import pytest

from almagest.operators import links

FIELDS = ("lat", "lng", "z", "t", "layers", "sel", "play", "rate", "pin")
DEFAULT = (20.0, 0.0, 1.8, None, ["earthquake", "weather", "flight", "news"], None, False, 1.0, None)


def parse(spark, *urls):
    rows = links.parse_links(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")).orderBy("i").collect()
    return [tuple(r[f] for f in FIELDS) for r in rows]


def changed(**kw):
    return tuple(kw.get(f, d) for f, d in zip(FIELDS, DEFAULT))


@pytest.mark.parametrize(
    "url, want",
    [
        ("/world", {}),
        ("/world?", {}),
        ("/world?lat=999&lng=-999&z=-1", {"lat": 90.0, "lng": -180.0, "z": 0.0}),
        ("/world?lat=&lng=abc&z=NaN", {}),
        ("/world?lat=%201.5%20", {"lat": 1.5}),
        ("/world?t=live", {}),
        ("/world?t=1755540000000", {"t": 1_755_540_000_000}),
        ("/world?t=-1", {}), ("/world?t=1.5", {}), ("/world?t=x", {}), ("/world?t=", {"t": 0}),
        ("/world?l=nw,eq,zz,eq", {"layers": ["earthquake", "news"]}),
        ("/world?l=", {"layers": []}),
        ("/world?sel=usgs%3Aabc&pin=a+b", {"sel": "usgs:abc", "pin": "a b"}),
        ("/world?play=1&rate=10", {"play": True, "rate": 10.0}),
        ("/world?play=yes&rate=", {}),
        ("/world?lat=1&lat=2#lat=3", {"lat": 1.0}),
        ("https://x.example/a?b=c&lat=5", {"lat": 5.0}),
    ],
)
def test_parse(spark, url, want):
    assert parse(spark, url) == [changed(**want)]


def test_round_trip(spark):
    """Writing and parsing again gives the same state, for states drawn at random."""
    rng = random.Random(11)
    some = lambda f: f() if rng.random() < 0.6 else None
    urls = ["?"]
    for _ in range(60):
        given = {
            "lat": some(lambda: rng.randrange(-900, 901) / 10),
            "lng": some(lambda: rng.randrange(-1800, 1801) / 10),
            "z": some(lambda: rng.randrange(0, 80) / 4),
            "t": some(lambda: rng.randrange(0, 2 * 10**12)),
            "l": some(lambda: ",".join(rng.sample(["eq", "nw"], rng.randrange(3)))),
            "sel": some(lambda: quote_plus(rng.choice(["x:1", "k&l=2", "ü ö", "100%"]))),
            "play": some(lambda: 1),
            "pin": some(lambda: quote_plus(rng.choice(["m n", "a=b", "#"]))),
        }
        urls.append("?" + "&".join(f"{k}={v}" for k, v in given.items() if v is not None))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    written = links.write_links(links.parse_links(df)).orderBy("i").collect()
    assert parse(spark, *["?" + r.query for r in written]) == parse(spark, *urls)
    assert written[0].query == ""
