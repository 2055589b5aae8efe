"""Typed access to untyped JSON: a value counts only when it has the expected JSON type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almagest.functions.scalars import finite


def parse(body: Column | str) -> Column:
    return F.try_parse_json(body if isinstance(body, Column) else F.col(body))


def json_type(v: Column, path: str = "$") -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def number(v: Column, path: str = "$") -> Column:
    """A JSON number; text that looks like one is not."""
    # BIGINT, DOUBLE, FLOAT or DECIMAL(p,s); the type is looked at once.
    is_number = F.left(json_type(v, path), F.lit(3)).isin("BIG", "DOU", "FLO", "DEC")
    return F.when(is_number, finite(F.try_variant_get(v, path, "double")))


def text(v: Column, path: str = "$") -> Column:
    """A JSON string; numbers are not converted."""
    return F.when(json_type(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def elements(v: Column, path: str = "$") -> Column:
    """A JSON array as an array of variants; null when it is missing or another type."""
    return F.try_variant_get(v, path, "array<variant>")


def flag(v: Column, path: str = "$") -> Column:
    """True for JSON true or the text 'true', else false."""
    return F.coalesce(
        F.when(json_type(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean")),
        text(v, path) == "true",
        F.lit(False),
    )


def position(v: Column, path: str = "$") -> Column:
    """A JSON position as [lon, lat, alt], null where the entry is not a number."""
    return F.transform(elements(v, path), lambda e: number(e))


def ring(v: Column, path: str = "$") -> Column:
    """A JSON ring as an array of positions; entries that are not arrays become null."""
    return F.transform(elements(v, path), lambda p: F.transform(elements(p), lambda e: number(e)))
