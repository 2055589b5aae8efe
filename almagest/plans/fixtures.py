"""The given tables in the roles of the record model.

Expressions here and in oracle.py follow the same definitions, so that both engines
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.scalars import epoch_ms, slot_of
from almagest.session import use_utc

T_MS = 1_705_276_800_000  # 2024-01-15 00:00:00
T_ORDERS_MS = 896_659_200_000  # 1998-06-01 00:00:00
FIRST_INSTANT_MS = 1_704_153_600_000  # 2024-01-02 00:00:00
INSTANT_STEP_MS = 6 * 3_600_000
INSTANT_COUNT = 112
LAST_MS = 1_706_659_200_000  # 2024-01-31 00:00:00
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lon_lat(event_id: Column) -> tuple[Column, Column]:
    lon = F.when(event_id % 101 == 0, F.lit(0.0)).otherwise(((event_id * 7919) % 3600) / F.lit(10.0) - 180.0)
    lat = (
        F.when(event_id % 101 == 0, F.lit(0.0))
        .when(event_id % 103 == 0, F.lit(999.0))
        .otherwise(((event_id * 104729) % 1800) / F.lit(10.0) - 90.0)
    )
    return lon, lat


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a position."""
    lon, lat = lon_lat(F.col("event_id"))
    return table(spark, sf_dir, "events").withColumns({"lon": lon, "lat": lat})


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.col("ts").alias("occurred_at"), "value", "event_type", "lon", "lat"
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of users; the hour is the sample time, so equal times occur."""
    return events(spark, sf_dir).select(
        F.col("user_id").alias("entity_id"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("sampled_at"),
        F.col("event_id").alias("arrival_seq"),
        "lon",
        "lat",
        "value",
    )


def intervals(spark: SparkSession, sf_dir: str, legacy: bool = False) -> DataFrame:
    end = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 90).cast("int"))
    open_end = F.col("o_orderstatus") == "O"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("valid_from"),
        (end if legacy else F.when(~open_end, end)).alias("valid_to"),
        F.when(open_end, "active").when(F.col("o_orderstatus") == "P", "cancelled").otherwise("expired").alias("status"),
        "o_totalprice",
    )


def line_revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Existing (even part) and incoming (odd part) revisions of orders."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").cast("bigint").alias("revision"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        epoch_ms("l_shipdate").alias("ship_ms"),
    )
    return rows.where(F.col("l_partkey") % 2 == 0), rows.where(F.col("l_partkey") % 2 == 1)


LINE_TIES = ["l_partkey", "l_suppkey", "l_extendedprice", "ship_ms"]


def news_text(spark: SparkSession, sf_dir: str, file_sec: int = 900) -> DataFrame:
    """Events as the text columns of a news export."""
    e = F.col("event_id")
    coordinate = lambda c: F.when(e % 97 == 0, "").otherwise(F.col(c).cast("string"))
    return spread_events(spark, sf_dir).select(
        slot_of("ts", file_sec).alias("file_sec"),
        e.alias("line_no"),
        (e % 20).cast("string").alias("mentions"),
        (e % 7).cast("string").alias("articles"),
        F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("P"), (e % 50).cast("string"))).alias("place"),
        F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("u"), e.cast("string"))).alias("url"),
        coordinate("lat").alias("lat"),
        coordinate("lon").alias("lon"),
    )


def over_all_tasks(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all tasks, because documents and rings are rendered from them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = lon_lat(F.col("event_id"))
    return over_all_tasks(table(spark, sf_dir, "events")).withColumns({"lon": lon, "lat": lat})


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows rendered as 61-column lines; every 89th line is cut short."""
    named = {31: "mentions", 33: "articles", 52: "place", 56: "lat", 57: "lon", 60: "url"}
    cells = [F.col(named[i]) if i in named else F.lit(f"c{i}") for i in range(61)]
    whole = F.concat_ws("\t", *cells)
    cut = F.concat_ws("\t", *cells[:60])
    return news_text(spark, sf_dir).select(
        "file_sec", "line_no", F.when(F.col("line_no") % 89 == 0, cut).otherwise(F.concat(whole, F.lit("\r"))).alias("line")
    )


def documents(rows: DataFrame, doc_no: Column, item: Column, order: str, head: str, tail: str) -> DataFrame:
    """Render items into JSON documents; `doc_no` must bound the items per document."""
    return (
        rows.select(doc_no.alias("doc_no"), F.struct(order, item.alias("json")).alias("i"))
        .groupBy("doc_no")
        .agg(F.array_sort(F.collect_list("i")).alias("items"))
        .select(
            "doc_no",
            F.concat(
                F.lit(head), F.concat_ws(",", F.transform("items", lambda i: i["json"])), F.lit(tail)
            ).alias("body"),
        )
    )


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def news_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of 15-minute files, which are there five minutes before they end."""
    start = slot_of("ts")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.timestamp_seconds(start + 900).alias("occurred_at"), F.timestamp_seconds(start + 600).alias("ingested_at"), "lon", "lat"
    )


def as_polls(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as a poll log."""
    e = F.col("event_id") % 10
    outcome = (
        F.when(e == 0, "error").when(e == 1, "schema_error").when(e.isin(2, 3), "not_modified").otherwise("ok")
    )
    return events.select(
        F.col("event_type").alias("layer"),
        F.col("ts").alias("at"),
        (epoch_ms("ts") - F.col("event_id") % 7 * 60_000).alias("as_of_ms"),
        outcome.alias("outcome"),
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_polls(table(spark, sf_dir, "events"))


def box_centre(key: Column) -> tuple[Column, Column]:
    return F.pmod(key * 15, F.lit(360)).cast("double") - 180.0, F.pmod(key * 6, F.lit(145)).cast("double") - 72.0


def square(key: Column, lon: Column, lat: Column) -> Column:
    """Rings of the box that belongs to a key: closed, even keys with a hole."""

    def box(half: float) -> Column:
        corners = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]

        def fold(c: Column) -> Column:
            return F.when(c < -180.0, c + 360.0).when(c > 180.0, c - 360.0).otherwise(c)

        return F.array(*[F.array(fold(lon + dx), lat + dy) for dx, dy in corners])

    return F.when(key % 2 == 0, F.array(box(5.0), box(2.0))).otherwise(F.array(box(5.0)))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per customer; keys 0 and 24 modulo 24 touch the antimeridian."""
    key = F.col("c_custkey")
    lon, lat = box_centre(key)
    rows = over_all_tasks(table(spark, sf_dir, "customer").select("c_custkey")).select(key.alias("id"), lon.alias("lon"), lat.alias("lat"))
    return rows.select("id", square(F.col("id"), F.col("lon"), F.col("lat")).alias("rings"))


def day_paths(spark: SparkSession, sf_dir: str, days: int = 5) -> DataFrame:
    """Lines of users over spans of `days`, from bucketed samples."""
    from almagest.operators.features import track_view

    samples = events(spark, sf_dir).where(F.col("lat") <= 90.0).select(
        F.col("user_id").alias("entity_id"), F.col("ts").alias("sampled_at"), F.col("event_id").alias("arrival_seq"), "lon", "lat"
    )
    return track_view(samples, span_sec=days * 86_400)
