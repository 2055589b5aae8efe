"""Normalizers: landed JSON documents to records.

Every normalizer returns one row per feed element with a `verdict` of ok, dropped or
skipped, so that records and counters come from the same pass. A document without
the expected array is a schema failure, which is not the same as an empty array; see
`document_status`.

`arrival_seq` orders elements as they arrived: document number * 2^32 + position, or the
document's own `seq_base` + position where the documents have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.functions import variant as V
from almagest.functions.geo import ring_centroid, valid_lon_lat, valid_position, valid_ring
from almagest.functions.scalars import (
    alert_rank,
    blank_to_null,
    date_of_slot,
    epoch_ms,
    from_ms,
    number_text,
    quake_rank,
    slot_of_seconds,
    utc_time,
)
from almagest.operators.keys import computed_once, unnest
from almagest.schema import BUCKET_SEC, EXPIRED_GRACE_MS, GEOMETRY, SLOT_MAX_SEC, SLOT_MIN_SEC, SLOT_SEC

OK, DROPPED, SKIPPED = "ok", "dropped", "skipped"


def parsed(docs: DataFrame, container: str) -> DataFrame:
    """Parse each body once and open its container array (null = schema failure)."""
    doc = V.parse("body")
    return docs.withColumn("doc", doc).withColumn("items", V.elements(F.col("doc"), f"$.{container}"))


def document_status(docs: DataFrame, container: str, keep: list[str] | None = None) -> DataFrame:
    """Per document: failed (no array), empty, or ok, with the element count."""
    opened = parsed(docs, container)
    size = F.when(F.col("items").isNotNull(), F.size("items"))
    return opened.select(
        *(keep or ["doc_no"]),
        F.when(size.isNull(), "failed").when(size == 0, "empty").otherwise("ok").alias("outcome"),
        size.alias("elements"),
    )


def elements(docs: DataFrame, container: str, carry: list[Column | str]) -> DataFrame:
    """One row per element of every good document, carrying only the named columns."""
    opened = computed_once(docs, [c for c in docs.columns if c != "body"], [V.parse("body").alias("doc")])
    items = V.elements(F.col("doc"), f"$.{container}")
    base = F.col("seq_base") if "seq_base" in docs.columns else F.col("doc_no") * F.lit(2**32)
    rows = unnest(opened, items, [*carry, "doc_no", base.alias("seq_base")], "pos", "item")
    return rows.withColumn("arrival_seq", F.col("seq_base") + F.col("pos")).drop("seq_base")


def counters(rows: DataFrame) -> DataFrame:
    """Records, dropped and skipped per document."""
    return rows.groupBy("doc_no").agg(
        F.count(F.lit(1)).alias("incoming"),
        F.count_if(F.col("verdict") == OK).alias("records"),
        F.count_if(F.col("verdict") == DROPPED).alias("dropped"),
        F.count_if(F.col("verdict") == SKIPPED).alias("skipped"),
    )


def records(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("verdict") == OK).drop("verdict", "doc_no")


def point(*coordinates: Column) -> Column:
    """A Point geometry."""
    return F.struct(
        F.lit("Point").alias("type"),
        F.array_compact(F.array(*coordinates)).alias("point"),
        F.lit(None).cast(GEOMETRY["line"].dataType).alias("line"),
        F.lit(None).cast(GEOMETRY["polygon"].dataType).alias("polygon"),
        F.lit(None).cast(GEOMETRY["multi"].dataType).alias("multi"),
    )


def quakes(docs: DataFrame) -> DataFrame:
    """Earthquake documents (doc_no, body, ingested_at) to occurrences."""
    item = F.col("item")
    raw = computed_once(elements(docs, "features", ["ingested_at"]), ["doc_no", "arrival_seq", "ingested_at"], [
        F.nullif(V.text(item, "$.id"), F.lit("")).alias("source_id"),
        V.number(item, "$.properties.time").alias("time_ms"),
        V.number(item, "$.properties.updated").alias("updated_ms"),
        V.position(item, "$.geometry.coordinates").alias("pos"),
        V.number(item, "$.properties.mag").alias("magnitude"),
        V.text(item, "$.properties.magType").alias("mag_type"),
        V.text(item, "$.properties.place").alias("place"),
        V.number(item, "$.properties.tsunami").alias("tsunami"),
        V.text(item, "$.properties.status").alias("status_text"),
        V.text(item, "$.properties.url").alias("url"),
    ])
    lon, lat, depth = (F.get("pos", F.lit(i)) for i in range(3))
    good = F.col("source_id").isNotNull() & F.col("time_ms").isNotNull() & valid_lon_lat(lon, lat)
    at = from_ms(F.col("time_ms").cast("bigint"))
    return raw.select(
        F.concat(F.lit("usgs:"), F.col("source_id")).alias("id"),
        F.lit("usgs").alias("source"),
        "source_id",
        F.lit("earthquake").alias("layer"),
        F.lit("occurrence").alias("kind"),
        F.coalesce("updated_ms", "time_ms").cast("bigint").alias("revision"),
        at.alias("observed_at"),
        "ingested_at",
        point(lon, lat, depth * -1000.0).alias("geometry"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.struct(
            quake_rank("magnitude").alias("rank"),
            F.col("magnitude").alias("raw"),
            F.lit(None).cast("string").alias("unit"),
            F.concat(F.lit("M"), number_text("magnitude")).alias("label"),
        ).alias("severity"),
        at.alias("occurred_at"),
        F.struct(
            "magnitude",
            "mag_type",
            depth.alias("depth_km"),
            "place",
            F.coalesce(F.col("tsunami") == 1, F.lit(False)).alias("tsunami"),
            F.col("status_text").alias("status"),
            "url",
        ).alias("quake"),
        "arrival_seq",
        "doc_no",
        F.when(good, OK).otherwise(DROPPED).alias("verdict"),
    )


def aircraft(docs: DataFrame) -> DataFrame:
    """Aircraft documents (doc_no, body, ingested_at, scheduled_at, region_id) to observations."""
    item = F.col("item")
    now = F.coalesce(V.number(F.col("doc"), "$.now"), epoch_ms("ingested_at").cast("double"))
    rows = elements(docs, "ac", ["ingested_at", "scheduled_at", "region_id", now.alias("now_ms")])
    bucket = slot_of_seconds(F.unix_seconds("scheduled_at"), BUCKET_SEC).alias("bucket")
    raw = computed_once(rows, ["doc_no", "arrival_seq", "ingested_at", "region_id", "now_ms", bucket], [
        F.lower(blank_to_null(V.text(item, "$.hex"))).alias("hex"),
        V.number(item, "$.lon").alias("lon"),
        V.number(item, "$.lat").alias("lat"),
        V.number(item, "$.alt_baro").alias("alt_baro_ft"),
        F.coalesce(V.text(item, "$.alt_baro") == "ground", F.lit(False)).alias("on_ground"),
        V.number(item, "$.gs").alias("ground_speed_kt"),
        V.number(item, "$.track").alias("track_deg"),
        blank_to_null(V.text(item, "$.flight")).alias("callsign"),
        blank_to_null(V.text(item, "$.t")).alias("aircraft_type"),
        blank_to_null(V.text(item, "$.r")).alias("registration"),
        blank_to_null(V.text(item, "$.category")).alias("category"),
        V.number(item, "$.seen_pos").alias("seen_pos_sec"),
    ])
    source_id = F.concat_ws(":", "hex", "bucket")
    at = from_ms((F.col("now_ms") - F.coalesce("seen_pos_sec", F.lit(0.0)) * 1000.0).cast("bigint"))
    good = F.col("hex").isNotNull() & valid_lon_lat("lon", "lat")
    return raw.select(
        F.concat(F.lit("adsblol:"), source_id).alias("id"),
        F.lit("adsblol").alias("source"),
        source_id.alias("source_id"),
        F.lit("flight").alias("layer"),
        F.lit("observation").alias("kind"),
        F.lit(0).cast("bigint").alias("revision"),
        at.alias("observed_at"),
        "ingested_at",
        point(F.col("lon"), F.col("lat")).alias("geometry"),
        "lon",
        "lat",
        F.struct(
            F.lit(0).alias("rank"),
            F.lit(None).cast("double").alias("raw"),
            F.lit(None).cast("string").alias("unit"),
            F.lit(None).cast("string").alias("label"),
        ).alias("severity"),
        F.col("hex").alias("entity_id"),
        at.alias("sampled_at"),
        F.struct(
            "region_id", "callsign", "alt_baro_ft", "on_ground", "ground_speed_kt",
            "track_deg", "aircraft_type", "registration", "category", "seen_pos_sec",
        ).alias("flight"),
        "arrival_seq",
        "doc_no",
        F.when(good, OK).otherwise(DROPPED).alias("verdict"),
    )


def alerts(docs: DataFrame, grace_ms: int = EXPIRED_GRACE_MS) -> DataFrame:
    """Alert list pages (doc_no, body, ingested_at) to intervals.

    An alert that ended more than the grace time before ingest is skipped on purpose,
    which is not a drop.
    """
    item = F.col("item")
    p = "$.properties"
    raw = computed_once(elements(docs, "features", ["ingested_at"]), ["doc_no", "arrival_seq", "ingested_at"], [
        V.number(item, f"{p}.eventid").alias("event_id"),
        V.number(item, f"{p}.episodeid").alias("episode_id"),
        blank_to_null(V.text(item, f"{p}.eventtype")).alias("event_type"),
        blank_to_null(V.text(item, f"{p}.alertlevel")).alias("alert_level"),
        utc_time(V.text(item, f"{p}.fromdate")).alias("valid_from"),
        utc_time(V.text(item, f"{p}.todate")).alias("observed_until"),
        utc_time(V.text(item, f"{p}.datemodified")).alias("modified_at"),
        V.flag(item, f"{p}.iscurrent").alias("current"),
        V.position(item, "$.geometry.coordinates").alias("pos"),
        blank_to_null(V.text(item, f"{p}.name")).alias("event"),
        blank_to_null(V.text(item, f"{p}.severitydata.severitytext")).alias("headline"),
        V.number(item, f"{p}.severitydata.severity").alias("raw"),
        blank_to_null(V.text(item, f"{p}.country")).alias("area_desc"),
        blank_to_null(V.text(item, f"{p}.url.report")).alias("url"),
    ])
    lon, lat = F.get("pos", F.lit(0)), F.get("pos", F.lit(1))
    rank = alert_rank("alert_level")
    complete = (
        F.col("event_id").isNotNull()
        & F.col("episode_id").isNotNull()
        & F.col("event_type").isNotNull()
        & rank.isNotNull()
        & F.col("valid_from").isNotNull()
        & valid_lon_lat(lon, lat)
    )
    over = ~F.col("current") & (
        F.col("observed_until").isNull()
        | (epoch_ms("observed_until") < epoch_ms("ingested_at") - F.lit(grace_ms))
    )
    source_id = F.concat_ws(":", number_text("event_id"), number_text("episode_id"))
    observed = F.coalesce("modified_at", "valid_from")
    return raw.select(
        F.concat(F.lit("gdacs:"), source_id).alias("id"),
        F.lit("gdacs").alias("source"),
        source_id.alias("source_id"),
        F.lit("weather").alias("layer"),
        F.lit("interval").alias("kind"),
        epoch_ms(observed).alias("revision"),
        observed.alias("observed_at"),
        "ingested_at",
        point(lon, lat).alias("geometry"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.struct(
            rank.alias("rank"),
            "raw",
            F.lit(None).cast("string").alias("unit"),
            F.concat_ws(" ", "event_type", "alert_level").alias("label"),
        ).alias("severity"),
        "valid_from",
        F.when(~F.col("current"), F.col("observed_until")).alias("valid_to"),
        F.when(F.col("current"), "active").otherwise("expired").alias("status"),
        F.struct(
            "event", "headline", "area_desc", F.lit(None).cast("string").alias("cap_severity"), "alert_level",
            "event_type", "url", "observed_until", F.lit(None).cast("string").alias("geometry_kind"),
        ).alias("alert"),
        "arrival_seq",
        "doc_no",
        F.when(~complete, DROPPED).when(over, SKIPPED).otherwise(OK).alias("verdict"),
    )


def page_address(path: Column) -> tuple[Column, Column]:
    """Level and page of a list document, from the parameters in its path; page 1 if none is named."""
    level = F.nullif(F.regexp_extract(path, "alertlevel=([A-Za-z]+)", 1), F.lit(""))
    page = F.regexp_extract(path, r"pagenumber=(\d{1,9})", 1)
    return level, F.when(page == "", F.lit(1)).otherwise(page.cast("int")).cast("bigint")


def alert_pages(docs: DataFrame) -> DataFrame:
    """Page statistics of list documents (doc_no, cycle, path, body): what `ledger.page_progress` reads.

    (cycle, level, page, features, current, failed); a document without a list is a failed page.
    """
    level, page = page_address(F.col("path"))
    named = docs.withColumns({"level": level, "page": page})
    status = document_status(named, "features", ["doc_no", "cycle", "level", "page"])
    current = V.flag(F.col("item"), "$.properties.iscurrent")
    counts = elements(named, "features", []).groupBy("doc_no").agg(F.count_if(current).alias("current"))
    return status.join(counts, "doc_no", "left").select(
        "cycle", "level", "page", F.coalesce("elements", F.lit(0)).cast("bigint").alias("features"),
        F.coalesce("current", F.lit(0)).alias("current"), (F.col("outcome") == "failed").alias("failed"),
    )


def cyclone_geometry(docs: DataFrame) -> DataFrame:
    """Geometry documents to one row each: track, cone and current centre.

    The whole document is handled inside its row: the features are an array of that
    row, so no shuffle is needed to put a track together. Keeps the columns of `docs`
    except the body. Fewer than two track points give a null track.
    """
    opened = parsed(docs, "features").drop("doc")
    shaped = F.transform(
        "items",
        lambda f: F.struct(
            blank_to_null(V.text(f, "$.properties.Class")).alias("cls"),
            V.text(f, "$.geometry.type").alias("type"),
            f.alias("feature"),
        ),
    )
    opened = opened.withColumn("items", shaped)
    outer = lambda f: V.ring(f["feature"], "$.geometry.coordinates[0]")
    number = lambda f: F.regexp_extract(f["cls"], r"^Point_Polygon_Point_(\d+)$", 1)
    centres = F.filter("items", lambda f: (f["cls"] == "Point_Centroid") & (f["type"] == "Point"))
    cones = F.filter("items", lambda f: (f["cls"] == "Poly_Cones") & (f["type"] == "Polygon"))
    steps = F.filter("items", lambda f: f["cls"].rlike(r"^Point_Polygon_Point_\d+$") & (f["type"] == "Polygon"))
    placed = F.transform(
        steps,
        lambda f, i: F.struct(
            number(f).try_cast("bigint").alias("index"), i.alias("seq"), ring_centroid(outer(f)).alias("at")
        ),
    )
    ordered = F.array_sort(F.filter(placed, lambda s: s["at"].isNotNull()))
    centre = F.transform(centres, lambda f: V.position(f["feature"], "$.geometry.coordinates"))
    # The last centre wins, valid or not; of the cones the last valid one.
    last_centre = F.try_element_at(centre, F.lit(-1))
    valid_cones = F.filter(F.transform(cones, lambda f: valid_ring(outer(f))), lambda r: r.isNotNull())
    keep = [c for c in docs.columns if c != "body"]
    return (
        opened.withColumns({"steps": ordered, "centre": last_centre, "cone": F.try_element_at(valid_cones, F.lit(-1))})
        .select(
            *keep,
            F.when(
                F.size("steps") >= 2,
                F.transform("steps", lambda s: F.array(s["at"]["lon"], s["at"]["lat"])),
            ).alias("track"),
            F.when(F.col("cone").isNotNull(), F.array("cone")).alias("cone"),
            F.when(
                valid_position(F.col("centre")),
                F.slice("centre", 1, 2),
            ).alias("centroid"),
        )
    )


def addressable(df: DataFrame, slot: str = "slot", date: str | None = None, generation: str | None = None) -> DataFrame:
    """Keep rows with a well-formed address: aligned slot in range, real date, canonical generation."""
    s = F.col(slot)
    ok = (s % SLOT_SEC == 0) & (s >= SLOT_MIN_SEC) & (s < SLOT_MAX_SEC)
    if date:
        d = F.try_to_date(F.col(date), "yyyy-MM-dd")
        real = F.col(date).rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(d, "yyyy-MM-dd") == F.col(date))
        day = F.unix_seconds(d.cast("timestamp"))
        ok = ok & real & (day >= SLOT_MIN_SEC) & (day < SLOT_MAX_SEC)
    if generation:
        ok = ok & F.col(generation).rlike(r"^(0|[1-9]\d{0,5})$")
    return df.where(F.coalesce(ok, F.lit(False)))


def slot_date(df: DataFrame, slot: str = "slot") -> DataFrame:
    return df.withColumn("dt", date_of_slot(slot))
