"""View state in shared links: parsing and writing it over a table of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.functions.scalars import clamp, number_or, number_text, text_number
from almagest.operators.keys import computed_once
from almagest.schema import LAYER_KEYS, LINK_DEFAULTS

LAYERS = [layer for layer, _ in LAYER_KEYS]
SHORTS = [short for _, short in LAYER_KEYS]


def canonical(values: Column, order: list[str]) -> Column:
    """Known values in fixed order, each once; unknown ones are ignored."""
    return F.array_intersect(F.array(*[F.lit(v) for v in order]), values)


def short_to_layer(shorts: Column) -> Column:
    names = F.create_map(*[F.lit(x) for layer, short in LAYER_KEYS for x in (short, layer)])
    return F.transform(shorts, lambda s: names[s])


def layer_to_short(layers: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LAYER_KEYS for x in pair])
    return F.transform(layers, lambda s: names[s])


def _decoded(text: Column) -> Column:
    """Percent decoding; text without escapes is passed through, malformed text too."""
    return F.when(text.rlike("[%+]"), F.coalesce(F.try_url_decode(text), text)).otherwise(text)


def parse_links(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds lat, lng, z, t (null = live), layers, sel, play, rate, pin.

    Missing or unusable values fall back per field; the first of repeated parameters
    counts. An empty layer list is not the same as none given.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("name"),
            F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise("").alias("value"),
        ),
    )
    base = computed_once(df, df.columns, [pairs.alias("__params")])

    def param(name: str) -> Column:
        return F.get(F.filter("__params", lambda p: p["name"] == name), F.lit(0))["value"].alias(f"__{name}")

    names = ("lat", "lng", "z", "t", "l", "sel", "play", "rate", "pin")
    base = computed_once(base, df.columns, [param(n) for n in names])
    base = base.withColumns({f"__{n}": _decoded(F.col(f"__{n}")) for n in names})
    t = text_number("__t")
    whole = (t == F.floor(t)) & (t >= 0) & (t < 9e18)
    shorts = F.split("__l", ",")
    every = F.array(*[F.lit(v) for v in LAYERS])
    d = LINK_DEFAULTS
    out = base.withColumns(
        {
            "lat": clamp(number_or("__lat", d["lat"]), -90, 90),
            "lng": clamp(number_or("__lng", d["lng"]), -180, 180),
            "z": clamp(number_or("__z", d["z"]), 0, 22),
            "t": F.when((F.col("__t") != "live") & whole, t.cast("bigint")),
            "layers": F.when(F.col("__l").isNull(), every).otherwise(short_to_layer(canonical(shorts, SHORTS))),
            "sel": F.col("__sel"),
            "play": F.coalesce(F.col("__play") == "1", F.lit(False)),
            "rate": number_or("__rate", d["rate"]),
            "pin": F.col("__pin"),
        }
    )
    return out.drop(*[f"__{n}" for n in names])


def write_links(df: DataFrame, out: str = "query") -> DataFrame:
    """The inverse: query text of a state, with everything that equals its default left out."""
    d = LINK_DEFAULTS

    def number(name: str) -> Column:
        return F.when(F.col(name) != d[name], F.concat(F.lit(f"{name}="), number_text(name)))

    def text(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}="), F.url_encode(name)))

    layers = canonical(F.col("layers"), LAYERS)
    shorts = F.concat(F.lit("l="), F.url_encode(F.concat_ws(",", layer_to_short(layers))))
    parts = [
        number("lat"),
        number("lng"),
        number("z"),
        F.when(F.col("t").isNotNull(), F.concat(F.lit("t="), F.col("t").cast("string"))),
        F.when(F.size(layers) < len(LAYERS), shorts),
        text("sel"),
        F.when(F.col("play"), F.lit("play=1")),
        number("rate"),
        text("pin"),
    ]
    return df.withColumn(out, F.concat_ws("&", *parts))
