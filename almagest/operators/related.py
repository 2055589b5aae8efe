"""Pairs of events that are close in space and time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.functions.geo import valid_lon_lat
from almagest.schema import EARTH_KM, RELATED_KM, RELATED_MS
from almagest.session import shared_dir

#: Rows of one cell that one task compares with; a cell with more is dealt over several.
BLOCK_ROWS = 2_000
#: Cells and time buckets are so many times as wide as the distances asked for. Wider ones
#: send fewer copies of a row through the shuffle and compare more rows.
CELL_WIDTH = 2


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; exact for short distances too."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.sin((p2 - p1) / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_KM)


def _lon_cells(band: Column, height: float) -> Column:
    """How many cells a band of latitude has: none narrower than the height at its wider edge."""
    nearest = F.least(F.abs(band * height - 90.0), F.abs((band + 1) * height - 90.0))
    nearest = F.when((band * height - 90.0) * ((band + 1) * height - 90.0) <= 0, 0.0).otherwise(nearest)
    return F.greatest(F.floor(F.cos(F.radians(nearest)) * (360.0 / height)), F.lit(1))


def _cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * cells), cells)


def _spot(band: Column, cell: Column, bands: int) -> Column:
    """Band and cell as one number; a band has at most twice as many cells as there are bands, and a few."""
    return band.cast("bigint") * (2 * bands + 4) + cell


def _bucket(ms: Column, within_ms: int) -> Column:
    return F.floor(ms / (CELL_WIDTH * within_ms))


def related_events(
    events: DataFrame, event_id: str, ms: str, lon: str = "lon", lat: str = "lat",
    within_km: float = RELATED_KM, within_ms: int = RELATED_MS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(a, b, km, dt_ms): each pair with distance < within_km and time apart < within_ms, once.

    `a` is the earlier event (of equal times the smaller id). Ids must be unique; rows
    without a valid position or time have no pairs. Aircraft are left out by the caller: for
    them closeness says nothing.

    A band join on three keys: bands of latitude, cells inside a band, time buckets. The
    later event has one cell; the earlier one is sent to the cells that can hold its
    partners, six in the mean. Around a position these reach from lon - x to lon + x with
    sin x = sin d / cos lat, over the date line where that leads, or round the whole band
    near a pole. A cell with more than `block_rows` rows is dealt into blocks, and the
    earlier events are sent to every block, so a hot cell is many tasks' work; what is
    left of the square of its rows are the pairs it really has, or nearly so.
    """
    angle = math.degrees(within_km / EARTH_KM) * (1 + 1e-9)
    bands = max(1, math.floor(180.0 / (CELL_WIDTH * angle)))
    height = 180.0 / bands
    rows = events.where(valid_lon_lat(F.col(lon), F.col(lat)) & F.col(ms).isNotNull()).select(
        F.col(event_id).alias("id"), F.col(ms).cast("bigint").alias("ms"), F.col(lon).alias("lon"), F.col(lat).alias("lat")
    )
    band = F.least(F.floor((F.col("lat") + 90.0) / height), F.lit(bands - 1))
    placed = rows.withColumns({"band": band, "bucket": _bucket(F.col("ms"), within_ms)})
    key = ["bucket", "spot"]
    homes = placed.withColumn("spot", _spot(F.col("band"), _cell(F.col("lon"), _lon_cells(F.col("band"), height)), bands))
    counts = homes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    # Few cells need more than one block. They are written first, so that their size is known
    # and the rows sent out are not shuffled to meet them unless they are many.
    path = shared_dir(events.sparkSession, "related-crowded")
    found = counts.where(F.col("n") > block_rows).select(*key, F.ceil(F.col("n") / block_rows).alias("blocks"))
    found.write.parquet(path)
    crowded = events.sparkSession.read.schema(found.schema).parquet(path)
    homes = homes.join(crowded, key, "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)))).drop("blocks")

    reach = F.sin(F.radians(F.lit(angle))) / F.cos(F.radians("lat"))
    pole = (F.abs("lat") + angle >= 90.0) | (reach >= 1.0)
    span = F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * (1 + 1e-9) + 1e-9)
    south, north = (F.floor((F.col("lat") + side + 90.0) / height).cast("bigint") for side in (-angle - 1e-9, angle + 1e-9))
    near_bands = F.sequence(F.greatest(F.least(south, F.col("band")), F.lit(0)), F.least(F.greatest(north, F.col("band")), F.lit(bands - 1)))
    sent = placed.withColumn("span", span).withColumn("band", F.explode(near_bands))
    n = _lon_cells(F.col("band"), height)
    first = F.floor((F.col("lon") - F.col("span") + 180.0) / 360.0 * n)
    last = F.floor((F.col("lon") + F.col("span") + 180.0) / 360.0 * n)
    around = F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda c: _spot(F.col("band"), F.pmod(c, n), bands))
    sent = sent.withColumn("spot", F.explode(around))
    sent = sent.withColumn("bucket", F.explode(F.sequence(F.col("bucket"), _bucket(F.col("ms") + within_ms, within_ms))))
    sent = sent.join(crowded, key, "left")
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1)))

    a = sent.select(*key, "block", F.col("id").alias("a"), F.col("ms").alias("a_ms"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"))
    b = homes.select(*key, "block", F.col("id").alias("b"), F.col("ms").alias("b_ms"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
    dt = F.col("b_ms") - F.col("a_ms")
    km = haversine_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    order = (dt > 0) | ((dt == 0) & (F.col("a") < F.col("b")))
    # cheap tests first: the distance is computed for what is left
    near = F.abs(F.col("b_lat") - F.col("a_lat")) <= angle + 1e-9
    met = a.join(b, [*key, "block"]).where(order & (dt < within_ms) & near)
    return met.select("a", "b", km.alias("km"), dt.alias("dt_ms")).where(F.col("km") < within_km)
