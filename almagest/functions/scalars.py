"""Scalar column functions: text, numbers, time, slots, ranks, labels.

Everything here is a built-in expression, so it stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.schema import ALERT_RANK, SLOT_SEC

# The characters that count as white space around a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
NUMBER_PATTERN = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text ----------------------------------------------------------------------


def trimmed(c: Column | str) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.trim(col(c), F.lit(WHITE_SPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


# --- numbers --------------------------------------------------------------------


def finite(c: Column | str) -> Column:
    """The value, or null when it is NaN or infinite."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)  # NaN sorts above infinity


def text_number(c: Column | str) -> Column:
    """Number in a text field: blank text counts as 0, anything malformed is null.

    The text is named once per branch, which keeps the expression small where the
    optimizer repeats it in a filter.
    """
    c = col(c)
    return F.coalesce(
        F.regexp_extract(c, NUMBER_PATTERN, 1).try_cast("double"),
        F.when(c.rlike(r"^\s*$"), F.lit(0.0)),
    )


def number_or(c: Column | str, default: float) -> Column:
    """Number in a text field, with a default when it is absent, blank, malformed or infinite."""
    return F.coalesce(finite(F.regexp_extract(col(c), NUMBER_PATTERN, 1).try_cast("double")), F.lit(default))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c))


def number_text(c: Column | str) -> Column:
    """Shortest decimal text of a double; whole numbers carry no fraction."""
    c = col(c).cast("double")
    plain = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return (
        F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string"))
        .when((F.abs(c) >= 1e7) | (F.abs(c) < 1e-3), plain)
        .otherwise(c.cast("string"))
    )


def fixed1(c: Column | str) -> Column:
    """One decimal place, rounded on the exact binary value, halves upwards.

    20*x is split into a rounded sum and its exact remainder, so a value such as
    8.35 (stored slightly below) rounds to 8.3 and not to 8.4.
    """
    x = col(c).cast("double")
    mag = F.abs(x)
    a, b = mag * 16.0, mag * 4.0
    total = a + b
    part = total - a
    rest = (a - (total - part)) + (b - part)
    tenth = F.floor(total / 2.0)
    middle = tenth * 2.0 + 1.0
    up = (total > middle) | ((total == middle) & (rest >= 0))
    n = tenth + F.when(up, 1).otherwise(0)
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


# --- time -----------------------------------------------------------------------


def epoch_ms(c: Column | str) -> Column:
    return F.unix_millis(col(c).cast("timestamp"))


def from_ms(c: Column | str | int) -> Column:
    return F.timestamp_millis(F.lit(c) if isinstance(c, int) else col(c))


def instant(df: DataFrame, column: str, ms: int) -> Column:
    """Literal of the column's own time type, so that the comparison reaches the scan."""
    ts = F.timestamp_millis(F.lit(ms))
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return ts.cast("timestamp_ntz")
    return ts


def utc_time(c: Column | str) -> Column:
    """ISO text to time; text without a zone is UTC, unparsable text is null."""
    return blank_to_null(c).try_cast("timestamp")


def stamp_time(c: Column | str) -> Column:
    """14-digit UTC stamp (yyyyMMddHHmmss) to time."""
    return F.try_to_timestamp(col(c), F.lit("yyyyMMddHHmmss"))


def slot_of(c: Column | str, width_sec: int = SLOT_SEC) -> Column:
    """Start of the fixed-width slot that contains the time, in epoch seconds."""
    sec = F.unix_seconds(col(c).cast("timestamp"))
    return sec - F.pmod(sec, F.lit(width_sec).cast("bigint"))


def slot_of_seconds(sec: Column, width_sec: Column | int) -> Column:
    width = F.lit(width_sec).cast("bigint") if isinstance(width_sec, int) else width_sec
    return sec - F.pmod(sec, width)


def date_of_slot(slot: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(slot)), "yyyy-MM-dd")


def hour_of(c: Column | str) -> Column:
    return F.date_format(col(c), "HH")


# --- ranks ----------------------------------------------------------------------


def threshold_rank(c: Column | str, steps: list[tuple[float, int]], otherwise: int = 1, missing: int = 0) -> Column:
    """Rank of the first threshold reached; steps run from high to low.

    NaN is tested first because Spark orders it above every number.
    """
    c = col(c)
    out = F.when(c.isNull() | F.isnan(c), missing)
    for bound, rank in steps:
        out = out.when(c >= bound, rank)
    return out.otherwise(otherwise)


def quake_rank(c: Column | str) -> Column:
    return threshold_rank(c, [(7.0, 4), (5.5, 3), (4.0, 2)])


def news_rank(c: Column | str) -> Column:
    return threshold_rank(c, [(50.0, 3), (10.0, 2)], otherwise=1, missing=1)


def alert_rank(c: Column | str) -> Column:
    c = col(c)
    out = None
    for level, rank in ALERT_RANK.items():
        out = F.when(c == level, rank) if out is None else out.when(c == level, rank)
    return out


# --- hashing --------------------------------------------------------------------


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the row's canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def digest_lanes(digest: Column | str) -> list[Column]:
    """A digest as eight 32-bit numbers.

    Summing each lane over a set of rows is an order-independent fingerprint that
    Spark can build by partial aggregation, with no list of rows per group.
    """
    return [
        F.conv(F.substring(col(digest), 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"lane{i}")
        for i in range(8)
    ]
