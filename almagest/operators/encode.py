"""Visual encoding and labels of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.scalars import clamp, col, fixed1
from almagest.schema import RANK_COLOR, RANK_SIZE

ALERT_SQUARE_FACTOR = 4.0


def styles(spark: SparkSession) -> DataFrame:
    """(layer, rank) to colour and size factor; 20 fixed rows."""
    rows = [
        (layer, rank, colors[rank], RANK_SIZE[rank])
        for layer, colors in RANK_COLOR.items()
        for rank in RANK_SIZE
    ]
    return spark.createDataFrame(rows, "layer string, rank int, color string, size_factor double")


def with_style(df: DataFrame) -> DataFrame:
    """Join the fixed style table; it is a constant of the program, hence the broadcast."""
    return df.join(F.broadcast(styles(df.sparkSession)), ["layer", "rank"], "left")


def quake_radius(magnitude: Column | str, factor: Column | str) -> Column:
    return F.greatest(F.lit(3.0), 3.0 + F.coalesce(col(magnitude), F.lit(1.0)) * 1.6) * col(factor)


def news_scale(articles: Column | str) -> Column:
    return 0.75 + 0.5 * F.log10(F.greatest(F.lit(1.0), col(articles).cast("double")))


def flight_size(zoom: Column) -> Column:
    """Metres, by zoom level."""
    return clamp(F.lit(140_000.0) / F.pow(F.lit(2.0), zoom), 1_500, 90_000)


def square_size(zoom: Column) -> Column:
    return clamp(F.lit(120_000.0) / F.pow(F.lit(2.0), zoom), 1_200, 80_000)


def alert_size(zoom: Column, factor: Column | str) -> Column:
    return square_size(zoom) * ALERT_SQUARE_FACTOR * col(factor)


def orientation(track_deg: Column | str) -> Column:
    """Clockwise track to counter-clockwise yaw."""
    return -F.coalesce(col(track_deg), F.lit(0.0))


# --- labels ------------------------------------------------------------------------


def magnitude_label(magnitude: Column | str) -> Column:
    return F.when(col(magnitude).isNull(), "M?").otherwise(F.concat(F.lit("M"), fixed1(magnitude)))


def depth_label(depth: Column | str) -> Column:
    return F.when(col(depth).isNull(), "unknown").otherwise(F.concat(fixed1(depth), F.lit(" km")))


def altitude_label(feet: Column | str, on_ground: Column | str) -> Column:
    return (
        F.when(col(on_ground), "ground")
        .when(col(feet).isNull(), "unknown")
        .otherwise(F.concat(F.call_function("format_number", col(feet), F.lit("#,##0.###")), F.lit(" ft")))
    )


def speed_label(knots: Column | str) -> Column:
    """Whole knots, halves upwards."""
    whole = F.floor(col(knots) + 0.5).cast("string")
    return F.when(col(knots).isNull(), "unknown").otherwise(F.concat(whole, F.lit(" kt")))


def validity_label(start: Column | str, end: Column | str) -> Column:
    fmt = "yyyy-MM-dd HH:mm"
    until = F.when(col(end).isNull(), "open").otherwise(F.date_format(col(end), fmt))
    return F.concat(F.date_format(col(start), fmt), F.lit(" ~ "), until)


def grade_label(level: Column | str, cap: Column | str, rank: Column | str) -> Column:
    """Source grade first, the rank only as an addition."""
    raw = F.coalesce(col(level), col(cap))
    ranked = F.concat(F.lit("rank "), col(rank).cast("string"))
    return F.when(raw.isNull(), ranked).otherwise(F.concat(raw, F.lit(" ("), ranked, F.lit(")")))


def stale_badge(status: Column | str, as_of_ms: Column | str, now_ms: int) -> Column:
    """Minutes of delay for a stale layer, at least one; else the status itself."""
    minutes = F.greatest(F.lit(1).cast("bigint"), F.floor((F.lit(now_ms) - col(as_of_ms)) / 60_000))
    late = (col(status) == "stale") & col(as_of_ms).isNotNull()
    return F.when(late, F.concat(minutes.cast("string"), F.lit(" min late"))).otherwise(col(status))
