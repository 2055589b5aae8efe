"""Grid aggregation of news rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.functions.geo import valid_lon_lat
from almagest.functions.scalars import blank_to_null, finite, news_rank, number_text, slot_of, text_number
from almagest.operators.keys import computed_once
from almagest.schema import GRID_DEG, SLOT_SEC


def cell_index(lon: Column, lat: Column, deg: float = GRID_DEG) -> tuple[Column, Column]:
    """Cell of a position. +180 is the meridian of -180; the pole falls in the last row."""
    lon_idx = F.floor(F.when(lon == 180.0, F.lit(-180.0)).otherwise(lon) / deg)
    lat_idx = F.least(F.floor(lat / deg), F.lit(int(90 / deg) - 1).cast("bigint"))
    return lon_idx.cast("bigint"), lat_idx.cast("bigint")


def news_rows(lines: DataFrame) -> DataFrame:
    """Typed rows from the text columns, with `kept` telling whether the row counts.

    Blank coordinates are dropped before parsing: as a number they would be 0.
    """
    typed = computed_once(
        lines,
        ["file_sec", "line_no"],
        [
            text_number("mentions").alias("mentions"),
            text_number("articles").alias("articles"),
            blank_to_null("place").alias("place"),
            blank_to_null("url").alias("url"),
            F.when(F.col("lon") != "", text_number("lon")).alias("lon"),
            F.when(F.col("lat") != "", text_number("lat")).alias("lat"),
        ],
    )
    return typed.withColumn("kept", valid_lon_lat("lon", "lat"))


def news_cells(rows: DataFrame, deg: float = GRID_DEG) -> DataFrame:
    """Article sum and representative place/url per (file, cell).

    In file order a row sets a record when its mentions exceed all before it, and a
    record with a non-blank url (place) replaces the cell's url (place). A row of
    value m is therefore a record exactly when it is the first with that value and no
    greater value precedes it. So the rows are first reduced to one per (cell,
    mentions value) by partial aggregation, and only these few are put in order.
    """
    cell = ["file_sec", "lon_idx", "lat_idx"]
    lon_idx, lat_idx = cell_index(F.col("lon"), F.col("lat"), deg)
    articles = finite("articles")
    per_value = (
        rows.select(
            "file_sec",
            lon_idx.alias("lon_idx"),
            lat_idx.alias("lat_idx"),
            finite("mentions").alias("m"),
            "line_no",
            F.when(articles > 0, articles).otherwise(0.0).alias("a"),
            "url",
            "place",
        )
        .groupBy(*cell, "m")
        .agg(
            F.sum("a").alias("a"),
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("line_no", "url", "place")).alias("first"),
        )
    )
    greater = Window.partitionBy(*cell).orderBy(F.col("m").desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    earliest_greater = F.min("first.line_no").over(greater)
    record = (F.col("m") > -1.0) & (earliest_greater.isNull() | (F.col("first.line_no") < earliest_greater))
    marked = per_value.withColumn("rec", F.coalesce(record, F.lit(False)))

    def last_record(field: str) -> Column:
        return F.max_by(f"first.{field}", F.when(F.col("rec") & F.col(f"first.{field}").isNotNull(), F.col("m")))

    return marked.groupBy(*cell).agg(
        F.sum("a").alias("article_sum"),
        F.sum("n").alias("rows"),
        last_record("place").alias("place_name"),
        last_record("url").alias("sample_url"),
    )


def news_records(cells: DataFrame, ingested_at: Column, deg: float = GRID_DEG) -> DataFrame:
    """Cells as occurrence records at the cell centre, timed by their file."""
    lon = (F.col("lon_idx") + 0.5) * deg
    lat = (F.col("lat_idx") + 0.5) * deg
    source_id = F.concat_ws(":", "file_sec", "lon_idx", "lat_idx")
    at = F.timestamp_seconds("file_sec")
    return cells.select(
        F.concat(F.lit("gdelt:"), source_id).alias("id"),
        F.lit("gdelt").alias("source"),
        source_id.alias("source_id"),
        F.lit("news").alias("layer"),
        F.lit("occurrence").alias("kind"),
        F.lit(0).cast("bigint").alias("revision"),
        at.alias("observed_at"),
        ingested_at.alias("ingested_at"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.struct(
            news_rank("article_sum").alias("rank"),
            F.col("article_sum").alias("raw"),
            F.lit("count").alias("unit"),
            F.concat(number_text("article_sum"), F.lit(" articles")).alias("label"),
        ).alias("severity"),
        at.alias("occurred_at"),
        F.struct("place_name", F.col("article_sum").alias("article_count"), "sample_url").alias("news"),
    )


def news_counters(rows: DataFrame) -> DataFrame:
    """Rows and dropped rows per file."""
    return rows.groupBy("file_sec").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("kept")).alias("dropped")
    )


def cell_counts(df: DataFrame, degrees: float, at: str = "occurred_at", width_sec: int = SLOT_SEC) -> DataFrame:
    """(cell_x, cell_y, slot, records) of rows with a valid position."""
    x, y = cell_index(F.col("lon"), F.col("lat"), degrees)
    rows = df.where(valid_lon_lat("lon", "lat")).select(x.alias("cell_x"), y.alias("cell_y"), slot_of(at, width_sec).alias("slot"))
    return rows.groupBy("cell_x", "cell_y", "slot").agg(F.count(F.lit(1)).alias("records"))


def density_baseline(counts: DataFrame, width_sec: int = SLOT_SEC, reach_sec: int = 86_400) -> DataFrame:
    """`counts` with `baseline`: the mean count of the slots in the time before, empty ones too.

    A cell's history is worked on in pieces as long as the reach; every count is repeated
    once, in the next piece, so that a piece sees all it needs and no cell is one task.
    """
    piece = F.floor(F.col("slot") / reach_sec).cast("bigint")
    both = counts.withColumn("__piece", F.explode(F.array(piece, piece + 1)))
    window = Window.partitionBy("cell_x", "cell_y", "__piece").orderBy("slot").rangeBetween(-reach_sec, -width_sec)
    seen = both.withColumn("baseline", F.coalesce(F.sum("records").over(window), F.lit(0)) / (reach_sec // width_sec))
    return seen.where(F.col("__piece") == piece).drop("__piece")
