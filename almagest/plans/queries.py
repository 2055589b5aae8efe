"""The registered queries: every operator over the given tables.

Each takes (spark, sf_dir) and returns a lazy DataFrame. Times leave as epoch
milliseconds and computed geometry rounded, so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions import geo, scalars as S
from almagest.operators import (
    arrivals as A,
    cyclone,
    encode,
    features,
    grid,
    latest,
    ledger,
    links,
    merge,
    ordered,
    publish,
    rates,
    related,
    retention as vacuum,
    slots,
    temporal,
)
from almagest.operators.keys import first_per_key, unnest
from almagest.plans import fixtures as X
from almagest.schema import REGIONS
from almagest.session import shared_dir
from almagest.sources import feeds, landed
from almagest.streaming import arrived, freshness, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VALUE_STEPS = [(200.0, 4), (100.0, 3), (50.0, 2)]
SPEC = {
    "earthquake": ("instant", 24 * X.HOUR_MS),
    "weather": ("interval", None),
    "flight": ("sampled", 12 * X.HOUR_MS),
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def ms(c: str, name: str) -> Column:
    return S.epoch_ms(c).alias(name)


def r6(c: Column | str, name: str) -> Column:
    """Rounded, with negative zero folded into zero."""
    return (F.round(S.col(c), 6) + F.lit(0.0)).alias(name)


def eid() -> Column:
    return F.col("event_id")


# --- time slices ----------------------------------------------------------------------


@query
def slice_occurrence(spark, sf):
    rows = temporal.slice_occurrence(X.occurrences(spark, sf), X.T_MS, 6 * X.HOUR_MS)
    return rows.select("id", ms("occurred_at", "occurred_ms"), S.threshold_rank("value", VALUE_STEPS).alias("rank"))


@query
def slice_interval(spark, sf):
    rows = temporal.visible(temporal.slice_interval(X.intervals(spark, sf), X.T_ORDERS_MS))
    return rows.select("id", ms("valid_from", "from_ms"), ms("valid_to", "to_ms"), "status")


@query
def latest_per_entity(spark, sf):
    rows = temporal.latest_per_entity(X.observations(spark, sf), X.T_MS, 12 * X.HOUR_MS)
    return rows.select("entity_id", ms("sampled_at", "sampled_ms"), "arrival_seq", "stale")


def instants() -> temporal.Instants:
    return temporal.Instants(X.FIRST_INSTANT_MS, X.INSTANT_STEP_MS, X.INSTANT_COUNT)


@query
def asof_many_instants(spark, sf):
    rows = temporal.latest_at_instants(X.observations(spark, sf), instants(), 12 * X.HOUR_MS)
    return rows.select("instant_ms", "entity_id", ms("sampled_at", "sampled_ms"), "arrival_seq", "stale")


@query
def occurrences_many_instants(spark, sf):
    rows = temporal.occurrences_at_instants(X.occurrences(spark, sf), instants(), 9 * X.HOUR_MS)
    return rows.select("instant_ms", "id", ms("occurred_at", "occurred_ms"))


@query
def intervals_many_instants(spark, sf):
    axis = temporal.Instants(X.T_ORDERS_MS - 180 * X.DAY_MS, 30 * X.DAY_MS, 12)
    return temporal.intervals_at_instants(X.intervals(spark, sf), axis).select("instant_ms", "id", "status")


@query
def interpolated_positions(spark, sf):
    rows = X.observations(spark, sf).where(F.col("lat") <= 90.0)
    out = temporal.positions_at_instants(rows, instants(), 5 * X.DAY_MS)
    return out.select("entity_id", "instant_ms", r6("lon", "lon"), r6("lat", "lat"))


@query
def cell_counts(spark, sf):
    return grid.cell_counts(X.occurrences(spark, sf), 10.0)


@query
def density_baseline(spark, sf):
    rows = grid.density_baseline(grid.cell_counts(X.occurrences(spark, sf), 45.0))
    return rows.select("cell_x", "cell_y", "slot", "records", r6("baseline", "baseline"))


def _world(spark, sf) -> DataFrame:
    layers = {
        "earthquake": X.occurrences(spark, sf).select("id", "occurred_at", "lon", "lat"),
        "weather": X.intervals(spark, sf).select("id", "valid_from", "valid_to", "status"),
        "flight": X.observations(spark, sf).withColumn("id", F.col("arrival_seq")),
    }
    return temporal.world_state(layers, X.T_MS, SPEC)


@query
def world_state(spark, sf):
    at = F.coalesce(S.epoch_ms("occurred_at"), S.epoch_ms("valid_from"), S.epoch_ms("sampled_at"))
    return _world(spark, sf).select("layer", "id", at.alias("at_ms"), "stale")


@query
def world_state_box(spark, sf):
    """World state inside a box that crosses the antimeridian."""
    boxed = temporal.in_box(_world(spark, sf), 120.0, -60.0, -60.0, 60.0)
    return boxed.select("layer", "id", r6("lon", "lon"), r6("lat", "lat"))


@query
def world_state_four(spark, sf):
    """All four layers; the newest news file is ahead of the clock."""
    at = F.coalesce(S.epoch_ms("occurred_at"), S.epoch_ms("valid_from"), S.epoch_ms("sampled_at"))
    layers = {
        "earthquake": X.occurrences(spark, sf).select("id", F.col("occurred_at").cast("timestamp").alias("occurred_at")),
        "weather": X.intervals(spark, sf).select("id", "valid_from", "valid_to", "status"),
        "flight": X.observations(spark, sf).withColumn("id", F.col("arrival_seq")),
        "news": X.news_records(spark, sf).select("id", "occurred_at", "ingested_at"),
    }
    rows = temporal.world_state(layers, X.T_MS + 700_000, SPEC | {"news": ("file", 2 * X.HOUR_MS)})
    return rows.select("layer", "id", at.alias("at_ms"), "stale")


@query
def legacy_repair(spark, sf):
    rows = X.intervals(spark, sf, legacy=True).withColumns(
        {"source": F.lit("gdacs"), "observed_until": F.lit(None).cast("timestamp_ntz")}
    )
    fixed = temporal.repair_legacy(temporal.repair_legacy(rows))
    held = (S.epoch_ms("valid_from") <= X.T_ORDERS_MS) & (
        F.col("valid_to").isNull() | (S.epoch_ms("valid_to") > X.T_ORDERS_MS)
    )
    return fixed.select("id", ms("valid_to", "to_ms"), ms("observed_until", "observed_ms"), held.alias("active_at_t"))


@query
def record_lookup(spark, sf):
    rows = X.table(spark, sf, "events").select(
        (eid() % 997).cast("string").alias("id"), F.col("event_type").alias("layer"), eid().alias("arrival_seq"), "value"
    )
    return temporal.lookup(rows, "421", ["purchase", "signup", "click", "view", "error"])


@query
def enabled_layers(spark, sf):
    rows = X.table(spark, sf, "events").withColumnRenamed("event_type", "layer")
    return temporal.of_layers(rows, ["click", "signup"]).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


# --- coordinates and geometry functions --------------------------------------------------


@query
def coord_validate(spark, sf):
    ok = geo.valid_lon_lat("lon", "lat")
    return X.events(spark, sf).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("incoming"), F.count_if(ok).alias("records"), F.count_if(~ok).alias("dropped")
    )


@query
def great_circle(spark, sf):
    rows = X.events(spark, sf).where(geo.valid_lon_lat("lon", "lat"))
    return features.distance_to(rows, 127.0, 37.5).select("event_id", r6("angle_deg", "angle_deg"))


@query
def dead_reckoning(spark, sf):
    rows = X.events(spark, sf).where(geo.valid_lon_lat("lon", "lat"))
    lon, lat = geo.dead_reckon(F.col("lon"), F.col("lat"), (eid() % 360).cast("double"), F.col("value") / 100.0)
    return rows.select("event_id", r6(lon, "lon"), r6(lat, "lat"))


@query
def unwrap_tracks(spark, sf):
    points = features.unwrapped_points(X.day_paths(spark, sf), ["entity_id", "span"])
    return points.select("entity_id", "span", "pos", r6("lon", "lon"), r6("lat", "lat"))


@query
def simplify_tracks(spark, sf):
    """Paths with as few points as a tolerance of 500 km allows."""
    rows = features.simplify_tracks(X.day_paths(spark, sf), ["entity_id", "span"], 500.0)
    return rows.select("entity_id", "span", "points", F.concat_ws(",", F.transform("kept", lambda i: i.cast("string"))).alias("kept"))


@query
def densify_tracks(spark, sf):
    points = features.densify(X.day_paths(spark, sf), ["entity_id", "span"], 10.0)
    return points.select("entity_id", "span", "leg", "step", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))


@query
def track_view(spark, sf):
    return X.day_paths(spark, sf).select(
        "entity_id", "span", F.size("samples").alias("points"),
        F.get("samples", F.lit(0))["ms"].alias("first_ms"),
        F.element_at("samples", -1)["ms"].alias("last_ms"),
    )


@query
def ring_centroid(spark, sf):
    c = geo.ring_centroid(F.col("rings")[0])
    return X.polygons(spark, sf).withColumn("c", c).select("id", r6("c.lon", "lon"), r6("c.lat", "lat"))


@query
def ring_bounds(spark, sf):
    rows = X.polygons(spark, sf).select("id", geo.unwrap_rings(F.col("rings")).alias("rings"))
    rows = rows.withColumn("b", geo.ring_bounds(F.col("rings")))
    return rows.select("id", r6("b.u_min", "u_min"), r6("b.u_max", "u_max"), r6("b.lon_span", "lon_span"), r6("b.lat_span", "lat_span"))


@query
def unwrap_polygons(spark, sf):
    rows = unnest(X.polygons(spark, sf), geo.unwrap_rings(F.col("rings")), ["id"], "ring", "line")
    points = features.points_of(rows, ["id", "ring"], F.col("line"))
    return points.select("id", "ring", "pos", r6("lon", "lon"), r6("lat", "lat"))


@query
def hatch_polygons(spark, sf):
    unwrapped = X.polygons(spark, sf).select("id", geo.unwrap_rings(F.col("rings")).alias("rings"))
    rows = unnest(unwrapped, geo.hatch(F.col("rings")), ["id"], "n", "s")
    return rows.select("id", "s.line", r6("s.lon0", "lon0"), r6("s.lat0", "lat0"), r6("s.lon1", "lon1"), r6("s.lat1", "lat1"))


@query
def geometry_features(spark, sf):
    """Polygons, two-part polygons and points as features, counted per record and kind."""
    null = {f.name: F.lit(None).cast(f.dataType) for f in feeds.GEOMETRY.fields}
    shape = (F.col("id") % 3).cast("int")

    def geometry(**member: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in {**null, **member}.items()])

    g = geometry(
        type=F.when(shape == 0, "Polygon").when(shape == 1, "MultiPolygon").otherwise("Point"),
        polygon=F.when(shape == 0, F.col("rings")),
        multi=F.when(shape == 1, F.array(F.col("rings"), F.col("other"))),
        point=F.when(shape == 2, F.col("rings")[0][0]),
    )
    rank = (F.col("id") % 5).cast("int")
    lon, lat = X.box_centre(F.col("id") + 7)
    rows = X.polygons(spark, sf).withColumns({"lon": lon, "lat": lat})
    rows = rows.withColumn("other", X.square(F.col("id") + 7, F.col("lon"), F.col("lat")))
    records = rows.select("id", g.alias("geometry"), F.struct(rank.alias("rank")).alias("severity"))
    return features.alert_features(records).groupBy("id", "rank", "kind", "part").agg(F.count(F.lit(1)).alias("n"))


@query
def geometry_split(spark, sf):
    """Records told apart by geometry type before they are drawn."""
    kind = F.when(eid() % 3 == 0, "Point").when(eid() % 3 == 1, "LineString").otherwise("Polygon")
    rows = X.events(spark, sf).select("event_id", F.struct(kind.alias("type")).alias("geometry"))
    areas = temporal.of_geometry(rows, "LineString", "Polygon")
    return areas.groupBy(F.col("geometry.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


# --- feeds --------------------------------------------------------------------------------


def _quake_docs(spark, sf) -> DataFrame:
    e = eid()
    item = F.concat(
        F.lit('{"id":'),
        F.when(e % 17 == 0, e.cast("string")).otherwise(X.quoted(F.concat(F.lit("e"), e.cast("string")))),
        F.lit(',"properties":{"mag":'),
        F.when(e % 19 == 0, "null").otherwise((F.col("value") / 10.0).cast("string")),
        F.lit(',"magType":"ml","place":"P","time":'),
        F.when(e % 13 == 0, X.quoted(S.epoch_ms("ts"))).otherwise(S.epoch_ms("ts").cast("string")),
        F.when(e % 7 == 0, "").otherwise(F.concat(F.lit(',"updated":'), (S.epoch_ms("ts") + e % 5 * 1000).cast("string"))),
        F.lit(',"tsunami":'),
        (e % 2).cast("string"),
        F.lit('},"geometry":{"type":"Point","coordinates":['),
        F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), F.when(e % 5 != 0, (e % 700).cast("string"))),
        F.lit("]}}"),
    )
    docs = X.documents(X.spread_events(spark, sf), (e / 50).cast("bigint"), item, "event_id", '{"features":[', "]}")
    broken = F.col("doc_no") % 29 == 28
    return docs.select(
        "doc_no",
        F.when(broken, F.regexp_replace("body", "^.{2}features", '{"error')).otherwise(F.col("body")).alias("body"),
        S.from_ms(X.T_MS).alias("ingested_at"),
    )


@query
def feed_quake(spark, sf):
    rows = feeds.records(feeds.quakes(_quake_docs(spark, sf)))
    return rows.select(
        "id", "revision", ms("occurred_at", "occurred_ms"), "lon", "lat", F.col("quake.depth_km").alias("depth_km"),
        F.col("quake.magnitude").alias("magnitude"), F.col("severity.rank").alias("rank"),
        F.col("severity.label").alias("label"), F.col("quake.tsunami").alias("tsunami"),
    )


def _aircraft_docs(spark, sf) -> DataFrame:
    e = eid()
    optional = lambda on, name, value: F.when(on, F.concat(F.lit(f'"{name}":'), value))
    item = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            optional(e % 23 != 0, "hex", X.quoted(F.concat(F.lit(" AB"), F.col("user_id").cast("string"), F.lit(" ")))),
            F.concat(F.lit('"lat":'), F.col("lat").cast("string")),
            optional(e % 31 != 0, "lon", F.col("lon").cast("string")),
            F.when(e % 4 == 0, '"alt_baro":"ground"').when(e % 4 < 3, F.concat(F.lit('"alt_baro":'), (e % 40000).cast("string"))),
            F.concat(F.lit('"gs":'), F.col("value").cast("string")),
            F.concat(F.lit('"flight":"CS'), e.cast("string"), F.lit('  "')),
            optional(e % 6 != 0, "seen_pos", (e % 60 / 2.0).cast("string")),
        ),
        F.lit("}"),
    )
    docs = X.documents(X.spread_events(spark, sf), (e / 50).cast("bigint"), item, "event_id", '{"ac":[', "]}")
    now = F.lit(1_704_067_200_000) + F.col("doc_no") * 60_000
    names = F.array(*[F.lit(r[0]) for r in REGIONS])
    return docs.select(
        "doc_no",
        F.when(F.col("doc_no") % 3 == 0, F.col("body"))
        .otherwise(F.concat(F.lit('{"now":'), now.cast("string"), F.lit(","), F.substr("body", F.lit(2))))
        .alias("body"),
        S.from_ms(X.T_MS).alias("ingested_at"),
        F.timestamp_millis(now).alias("scheduled_at"),
        F.get(names, (F.col("doc_no") % 6).cast("int")).alias("region_id"),
    )


@query
def feed_aircraft(spark, sf):
    rows = feeds.records(feeds.aircraft(_aircraft_docs(spark, sf)))
    return rows.select(
        "id", "entity_id", ms("sampled_at", "sampled_ms"), "lon", "lat", "flight.alt_baro_ft", "flight.on_ground",
        "flight.ground_speed_kt", "flight.callsign", "flight.region_id", "arrival_seq",
    )


def _alert_docs(spark, sf) -> DataFrame:
    e = eid()
    start = F.col("ts").cast("timestamp")
    iso = lambda c: X.quoted(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    end = start + F.make_dt_interval((e % 10).cast("int"))
    level = F.get(F.array(*[F.lit(v) for v in ("Green", "Orange", "Red", "Purple")]), (e % 4).cast("int"))
    current = F.get(F.array(*[F.lit(v) for v in ('"true"', "true", '"false"', "false", "1")]), (e % 5).cast("int"))
    item = F.concat(
        F.lit('{"properties":{"eventtype":'), F.when(e % 2 == 0, '"TC"').otherwise('"FL"'),
        F.lit(',"eventid":'), F.when(e % 17 == 0, X.quoted(e)).otherwise(e.cast("string")),
        F.lit(',"episodeid":'), (e % 5).cast("string"),
        F.lit(',"name":" N'), e.cast("string"), F.lit(' ","alertlevel":"'), level,
        F.lit('","fromdate":'), F.when(e % 37 == 0, '"soon"').otherwise(iso(start)),
        F.lit(',"todate":'), F.when(e % 41 == 0, '""').otherwise(iso(end)),
        F.when(e % 3 == 0, "").otherwise(F.concat(F.lit(',"datemodified":'), iso(start + F.expr("interval 1 hour")))),
        F.lit(',"iscurrent":'), current,
        F.lit(',"country":"","severitydata":{"severity":'), F.col("value").cast("string"),
        F.lit(',"severitytext":"s"},"url":{"report":"u"}},"geometry":{"type":"Point","coordinates":['),
        F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string")), F.lit("]}}"),
    )
    docs = X.documents(X.spread_events(spark, sf), (e / 100).cast("bigint"), item, "event_id", '{"features":[', "]}")
    return docs.withColumn("ingested_at", S.from_ms(X.T_MS))


@query
def feed_alert(spark, sf):
    rows = feeds.records(feeds.alerts(_alert_docs(spark, sf)))
    return rows.select(
        "id", "revision", ms("valid_from", "from_ms"), ms("valid_to", "to_ms"),
        S.epoch_ms("alert.observed_until").alias("observed_ms"), "status",
        F.col("severity.rank").alias("rank"), F.col("severity.raw").alias("raw"),
        F.col("severity.label").alias("label"), "alert.event", "alert.area_desc",
    )


@query
def alert_pages(spark, sf):
    """Page statistics by the addresses in the documents' paths."""
    doc = F.col("doc_no")
    level = F.get(F.array(*[F.lit(v) for v in ("Green", "Orange", "Red")]), (doc % 3).cast("int"))
    page = F.floor(doc / 3) % 8 + 1
    path = F.concat(F.lit("landing/list?alertlevel="), level, F.when(page == 1, "").otherwise(F.concat(F.lit("&pagenumber="), page.cast("string"))), F.lit("&pagesize=100"))
    body = F.when(doc % 19 == 7, '{"features":null}').otherwise(F.col("body"))
    return feeds.alert_pages(_alert_docs(spark, sf).withColumns({"path": path, "cycle": F.floor(doc / 24), "body": body}))


@query
def feed_counters(spark, sf):
    """Records, drops and skips of all three feeds, added up over their documents."""
    parts = {
        "aircraft": feeds.aircraft(_aircraft_docs(spark, sf)),
        "alert": feeds.alerts(_alert_docs(spark, sf)),
        "quake": feeds.quakes(_quake_docs(spark, sf)),
    }
    out = None
    for name, rows in parts.items():
        part = feeds.counters(rows).agg(*[F.sum(c).alias(c) for c in ("incoming", "records", "dropped", "skipped")])
        part = part.withColumn("feed", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def feed_status(spark, sf):
    """Documents per outcome: a missing container is a failure, not an empty feed."""
    status = feeds.document_status(_quake_docs(spark, sf), "features")
    return status.groupBy("outcome").agg(F.count(F.lit(1)).alias("docs"), F.sum("elements").alias("elements"))


def _cyclone_docs(spark, sf) -> DataFrame:
    e = eid()
    kind = e % 40
    num = lambda c: c.cast("string")
    fold = lambda c: F.when(c < -180.0, c + 360.0).when(c > 180.0, c - 360.0).otherwise(c)
    corners = [(-0.3, -0.3), (0.3, -0.3), (0.3, 0.3), (-0.3, 0.3), (-0.3, -0.3)]
    vertex = [
        F.concat(F.lit("["), num(fold(F.col("lon") + dx)), F.lit(","), num(F.col("lat") + dy), F.lit("]"))
        for dx, dy in corners
    ]
    ring = F.concat(F.lit("[["), F.concat_ws(",", *vertex), F.lit("]]"))
    cls = (
        F.when(kind == 0, "Point_Centroid").when(kind == 1, "Poly_Cones").when(kind == 2, "Line_Line_1")
        .otherwise(F.concat(F.lit("Point_Polygon_Point_"), num(e * 7 % 40)))
    )
    point = F.concat(F.lit("["), num(F.col("lon")), F.lit(","), num(F.col("lat")), F.lit("]"))
    item = F.concat(
        F.lit('{"properties":{"Class":"'), cls, F.lit('"},"geometry":{"type":"'),
        F.when(kind == 0, "Point").when(kind == 2, "LineString").otherwise("Polygon"),
        F.lit('","coordinates":'), F.when(kind == 0, point).otherwise(ring), F.lit("}}"),
    )
    return X.documents(X.spread_events(spark, sf), (e / 40).cast("bigint"), item, "event_id", '{"features":[', "]}")


@query
def cyclone_geometry(spark, sf):
    rows = feeds.cyclone_geometry(_cyclone_docs(spark, sf))
    return rows.select(
        "doc_no", F.coalesce(F.size("track"), F.lit(0)).alias("track_points"),
        F.coalesce(F.size(F.col("cone")[0]), F.lit(0)).alias("cone_points"),
        r6(F.col("centroid")[0], "lon"), r6(F.col("centroid")[1], "lat"),
    )


@query
def cyclone_track_points(spark, sf):
    rows = feeds.cyclone_geometry(_cyclone_docs(spark, sf))
    points = features.points_of(rows, ["doc_no"], F.col("track"))
    return points.select("doc_no", "pos", r6("lon", "lon"), r6("lat", "lat"))


def _active_alerts(spark, sf) -> DataFrame:
    key = F.col("s_suppkey")
    source_id = F.concat_ws(":", key.cast("string"), F.lit("1"))
    return X.table(spark, sf, "supplier").select(
        F.concat(F.lit("gdacs:"), source_id).alias("id"),
        source_id.alias("source_id"),
        feeds.point(F.lit(10.0), F.lit(20.0)).alias("geometry"),
        F.lit(10.0).alias("lon"),
        F.lit(20.0).alias("lat"),
        F.when(key % 11 == 0, "expired").otherwise("active").alias("status"),
        F.struct(
            F.when(key % 7 == 0, "FL").otherwise("TC").alias("event_type"),
            F.lit(None).cast("string").alias("geometry_kind"),
            F.col("s_name").alias("event"),
        ).alias("alert"),
    )


def _geometry_cache(spark, sf) -> DataFrame:
    key = F.col("p_partkey")
    line = F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(3.0)))
    ring = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))
    rows = X.table(spark, sf, "part").select(
        F.when(key % 30 == 0, (key / 30).cast("bigint")).otherwise(-key).alias("event_id"),
        F.lit(1).cast("bigint").alias("episode_id"),
        F.timestamp_millis(F.lit(X.T_MS) - F.col("p_size").cast("bigint") * X.HOUR_MS).alias("fetched_at"),
        F.when(key % 4 != 0, line).alias("track"),
        F.when(key % 9 != 0, F.array(ring)).alias("cone"),
        F.when(key % 5 != 0, F.array(F.lit(7.0), F.lit(8.0))).alias("centroid"),
    )
    return cyclone.newest_geometry(rows)


@query
def tc_cache_join(spark, sf):
    active = cyclone.active_cyclones(_active_alerts(spark, sf))
    rows = cyclone.match_geometry(active, _geometry_cache(spark, sf), S.from_ms(X.T_MS), 25 * X.HOUR_MS)
    return rows.select("id", "outcome", F.col("track").isNotNull().alias("has_track"), F.col("cone").isNotNull().alias("has_cone"))


@query
def tc_apply(spark, sf):
    rows = cyclone.apply_geometry(_active_alerts(spark, sf), _geometry_cache(spark, sf), S.from_ms(X.T_MS), 25 * X.HOUR_MS)
    return rows.select("id", F.col("geometry.type").alias("type"), F.col("alert.geometry_kind").alias("kind"), "lon", "lat", "status")


@query
def cyclone_index(spark, sf):
    return cyclone.cyclone_index(_active_alerts(spark, sf))


# --- news grid ----------------------------------------------------------------------------


def _cells(rows: DataFrame, deg: float) -> DataFrame:
    cells = grid.news_cells(rows.where(F.col("kept")), deg)
    rec = grid.news_records(cells, S.from_ms(X.T_MS), deg)
    return rec.select(
        "id", ms("occurred_at", "occurred_ms"), "lon", "lat", F.col("severity.rank").alias("rank"),
        F.col("severity.label").alias("label"), F.col("news.article_count").alias("article_count"),
        F.col("news.place_name").alias("place_name"), F.col("news.sample_url").alias("sample_url"),
    )


@query
def grid_cells(spark, sf):
    return _cells(grid.news_rows(X.news_text(spark, sf)), 0.5)


@query
def grid_representative(spark, sf):
    """Coarse cells and long files, so that many rows compete for the representative."""
    return _cells(grid.news_rows(X.news_text(spark, sf, file_sec=259_200)), 30.0)


@query
def tsv_grid(spark, sf):
    return _cells(grid.news_rows(landed.news_lines(X.export_lines(spark, sf))), 0.5)


@query
def tsv_counters(spark, sf):
    return grid.news_counters(grid.news_rows(landed.news_lines(X.export_lines(spark, sf))))


@query
def file_stamps(spark, sf):
    e = eid()
    name = F.concat(
        F.lit("120 abc http://x/"),
        F.date_format("ts", "yyyyMMddHHmmss"),
        F.when(e % 3 == 0, ".export.CSV.zip\nnext").when(e % 3 == 1, ".mentions.CSV.zip").otherwise(".export.CSV.zip"),
    )
    rows = X.table(spark, sf, "events").select("event_id", name.alias("body"))
    return landed.pointer_files(rows).select("event_id", "url", ms("file_at", "file_ms"))


@query
def put_if_absent(spark, sf):
    key = F.concat_ws("/", (F.col("user_id") % 7).cast("string"), S.slot_of("ts").cast("string"))
    rows = X.table(spark, sf, "events").select(key.alias("file_key"), "event_id")
    known = rows.where(eid() % 2 == 0)
    new = rows.where(eid() % 2 == 1).groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))
    return landed.absent_only(new, known, "file_key")


@query
def region_dimension(spark, sf):
    """Events per collection region, with the region's position."""
    names = F.array(*[F.lit(r[0]) for r in REGIONS])
    rows = X.table(spark, sf, "events").select(F.get(names, (F.col("user_id") % 6).cast("int")).alias("region_id"))
    counted = rows.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(landed.regions(spark), "region_id")


# --- merges and slots ---------------------------------------------------------------------


@query
def merge_revision(spark, sf):
    old, new = X.line_revisions(spark, sf)
    return merge.merge(old, new, ["revision", merge.SIDE], ["id"], X.LINE_TIES)


@query
def merge_last(spark, sf):
    old, new = X.line_revisions(spark, sf)
    return merge.merge(old, new, [merge.SIDE], ["id"], ["revision", *X.LINE_TIES])


@query
def dedupe_pages(spark, sf):
    old, new = X.line_revisions(spark, sf)
    rows = old.unionByName(new).withColumn("list_seq", F.col("l_suppkey") % 3)
    return merge.dedupe_lists(rows, ["id"], "list_seq", X.LINE_TIES)


def _slot_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Records of users in day slots: what is stored, and what arrives.

    On two days of three the arrivals repeat what is stored; on the third one half of
    the events is stored and the other half arrives.
    """
    rows = X.table(spark, sf, "events").select(
        F.lit("earthquake").alias("layer"), S.slot_of("ts", 86_400).alias("slot"), F.col("user_id").cast("string").alias("id"),
        (eid() % 7).alias("revision"), "value", eid().alias("arrival_seq"),
    )
    brings = (F.col("slot") / 86_400).cast("bigint") % 3 == 0
    even = F.col("arrival_seq") % 2 == 0
    stored = merge.dedupe_lists(rows.where(even | ~brings), ["layer", "slot", "id"], "arrival_seq", [])
    incoming = rows.where(~even | ~brings)
    return stored, incoming


@query
def slot_changed(spark, sf):
    stored, incoming = _slot_sides(spark, sf)
    key = [*slots.SLOT_KEY, "id"]
    merged = merge.merge(stored, incoming, merge.BY_REVISION, key)
    content = ["id", "revision", "value"]
    before = slots.fingerprint(stored, slots.SLOT_KEY, content)
    after = slots.fingerprint(merged, slots.SLOT_KEY, content)
    return slots.changed_slots(before, after).select("slot", "records")


@query
def slot_publish(spark, sf):
    """Two publishes into a slot table; the current generation of every slot."""
    stored, incoming = _slot_sides(spark, sf)
    table = slots.SlotTable(X.use_utc(spark), shared_dir(spark, "slots"))
    table.publish(stored, at_ms=X.T_MS)
    table.publish(incoming, at_ms=X.T_MS + 60_000)
    current = table.read("earthquake").groupBy("slot").agg(
        F.count(F.lit(1)).alias("records"), F.sum("revision").alias("revisions")
    )
    return current.join(table.pointers().select("slot", "generation"), "slot")


def _published_twice(spark, sf) -> slots.SlotTable:
    stored, incoming = _slot_sides(spark, sf)
    table = slots.SlotTable(X.use_utc(spark), shared_dir(spark, "slots"))
    table.publish(stored, at_ms=X.T_MS)
    table.publish(incoming, at_ms=X.T_MS + 60_000)
    return table


def _slot_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("slot").agg(F.count(F.lit(1)).alias("records"), F.sum("revision").alias("revisions"))


@query
def slot_manifest(spark, sf):
    """Every generation with its counts."""
    return _published_twice(spark, sf).manifest().select("slot", "generation", "records", "incoming", "dropped")


@query
def pointer_shard(spark, sf):
    """The slots of one date that exist, from that date's folder alone."""
    return _published_twice(spark, sf).pointers("2024-01-09").select("slot", "generation", "records")


@query
def slot_read_pinned(spark, sf):
    """The first generation of every slot, whenever it was published."""
    return _slot_sums(_published_twice(spark, sf).read("earthquake", generation=0))


@query
def slot_known_at(spark, sf):
    """What was known between the two publishes."""
    return _slot_sums(_published_twice(spark, sf).read("earthquake", known_at_ms=X.T_MS + 30_000))


@query
def vacuumed_slots(spark, sf):
    """Current rows after a vacuum, and how many rows of each slot are still stored."""
    table = _published_twice(spark, sf)
    vacuum.vacuum_slots(table, X.T_MS + X.DAY_MS)
    stored = spark.read.parquet(table.bodies_path).groupBy("slot").agg(F.count(F.lit(1)).alias("stored"))
    return _slot_sums(table.read("earthquake")).join(stored, "slot")


@query
def pinned_snapshot(spark, sf):
    """What was pinned between the two publishes, read after a vacuum."""
    stored, incoming = _slot_sides(spark, sf)
    table = slots.SlotTable(X.use_utc(spark), shared_dir(spark, "slots"))
    table.publish(stored, at_ms=X.T_MS)
    pins = vacuum.Pins(table)
    pins.pin("case", ["earthquake"], 0, 4_000_000_000, X.T_MS + 30_000)
    table.publish(incoming, at_ms=X.T_MS + 60_000)
    vacuum.vacuum_slots(table, X.T_MS + X.DAY_MS)
    return _slot_sums(pins.read("case"))


@query
def slot_distribution(spark, sf):
    return slots.with_slot(X.occurrences(spark, sf)).groupBy("slot").agg(F.count(F.lit(1)).alias("records"))


@query
def commit_slots(spark, sf):
    """Late rows: each event is processed up to 45 minutes after it happened."""
    scheduled = F.unix_seconds(F.col("occurred_at").cast("timestamp")) + F.col("id") % 4 * 900
    rows = slots.commit_window(slots.with_slot(X.occurrences(spark, sf)), scheduled)
    return rows.groupBy("event_type").agg(
        F.count_if("committed").alias("committed"), F.count_if(~F.col("committed")).alias("skipped")
    )


@query
def slot_rebucket(spark, sf):
    width = F.get(F.array(F.lit(60), F.lit(180), F.lit(900)), (F.col("id") % 3).cast("int")).cast("bigint")
    rows = X.occurrences(spark, sf).withColumn("slot_duration_sec", width)
    sec = F.unix_seconds(F.col("occurred_at").cast("timestamp"))
    rows = rows.withColumn("slot", S.slot_of_seconds(sec, F.col("slot_duration_sec")))
    return slots.rebucket(rows).groupBy("slot", "stored_width_sec").agg(F.count(F.lit(1)).alias("records"))


@query
def slot_addresses(spark, sf):
    e = eid()
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    slot = F.when(e % 10 == 3, sec + 3_155_760_000).when(e % 2 == 0, S.slot_of("ts")).otherwise(sec)
    date = F.when(e % 8 == 2, "2024-02-30").when(e % 8 == 4, "24-1-1").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    generation = F.get(F.array(*[F.lit(v) for v in ("0", "7", "01", "1234567", "12")]), (e % 5).cast("int"))
    rows = X.table(spark, sf, "events").select("event_id", slot.alias("slot"), date.alias("date"), generation.alias("g"))
    return feeds.addressable(rows, "slot", "date", "g").select("event_id", "slot", "date", "g")


@query
def retention(spark, sf):
    rows = X.table(spark, sf, "events").withColumn("dt", F.date_format("ts", "yyyy-MM-dd"))
    return slots.retained(rows, "dt", X.LAST_MS, 7).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


@query
def same_slices(spark, sf):
    """Whether a slice changes as the clock moves on."""
    rows = X.occurrences(spark, sf).select("id", "occurred_at", "value")
    out = None
    for name, later in (("same instant", 0), ("a day later", X.DAY_MS)):
        left = temporal.slice_occurrence(rows, X.T_MS, X.DAY_MS)
        right = temporal.slice_occurrence(rows, X.T_MS + later, X.DAY_MS)
        part = slots.same_content(left, right, ["id", "value"]).withColumn("case", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def gap_bands(spark, sf):
    rows = slots.with_slot(X.occurrences(spark, sf)).withColumnRenamed("event_type", "layer")
    return slots.gaps(rows, "purchase", 1_704_067_200, 1_706_659_200)


# --- latest -------------------------------------------------------------------------------


def _part_headers(spark, sf, side: int) -> DataFrame:
    part = F.concat_ws(":", "event_type", (F.col("user_id") % 6).cast("string"))
    rows = X.table(spark, sf, "events").where(eid() % 2 == side)
    return rows.groupBy(part.alias("part")).agg(S.epoch_ms(F.max("ts")).alias("as_of"))


@query
def publish_monotone(spark, sf):
    return latest.replace_newer(_part_headers(spark, sf, 0), _part_headers(spark, sf, 1))


@query
def latest_assembly(spark, sf):
    rows = X.table(spark, sf, "events").withColumn("part", F.concat_ws(":", "event_type", (F.col("user_id") % 6).cast("string")))
    last = first_per_key(rows, ["part"], [F.col("ts").desc()])
    body = F.when(eid() % 7 == 0, F.lit('{"asOf":')).otherwise(F.concat(F.lit('{"value":'), F.col("value").cast("string"), F.lit("}")))
    parts = last.withColumn("body", body).select(
        "part", F.col("ts").alias("uploaded_at"), latest.body_is_object("body").alias("valid")
    )
    suffix = F.explode(F.array(*[F.lit(str(i)) for i in range(7)]))
    expected = rows.select("event_type").distinct().select("event_type", suffix.alias("n")).select(
        F.concat_ws(":", "event_type", "n").alias("part")
    )
    out = latest.assemble(parts, expected)
    return out.select(
        F.array_join("partial", ",").alias("partial"), F.array_join("invalid", ",").alias("invalid"),
        ms("updated_at", "updated_ms"), "present", "publish",
    )


@query
def changed_parts(spark, sf):
    rows = X.table(spark, sf, "events")

    def snapshot(t: int) -> DataFrame:
        """Each user's newest event as of t."""
        seen = rows.where(F.col("ts") <= S.instant(rows, "ts", t))
        return seen.groupBy(F.col("user_id").alias("part")).agg(S.epoch_ms(F.max("ts")).alias("as_of"))

    return latest.changed_parts(snapshot(X.T_MS - X.DAY_MS), snapshot(X.T_MS))


@query
def latest_publish(spark, sf):
    """Two publishes of region snapshots; an older snapshot of a region leaves it as it was.

    The first one holds the even events. The second one holds the odd events, 40 days
    newer for regions 0 to 2 and 40 days older for the others.
    """
    region = (F.col("user_id") % 6).cast("string")
    rows = X.table(spark, sf, "events").select(region.alias("part"), "event_id", "ts", "value")
    at = S.epoch_ms(F.max("ts"))
    shift = F.when(F.col("part") < "3", 40 * X.DAY_MS).otherwise(-40 * X.DAY_MS)
    table = latest.LatestTable(X.use_utc(spark), shared_dir(spark, "latest"))
    first, second = rows.where(eid() % 2 == 0), rows.where(eid() % 2 == 1)
    table.publish(first, first.groupBy("part").agg(at.alias("as_of")), at_ms=X.T_MS)
    table.publish(second, second.groupBy("part").agg((at + shift).alias("as_of")), at_ms=X.T_MS + 60_000)
    counted = table.read().groupBy("part").agg(F.count(F.lit(1)).alias("records"), F.max("event_id").alias("last_id"))
    return counted.join(table.headers().select("part", "as_of"), "part")


@query
def region_survivors(spark, sf):
    """Newest sample per entity over all regions, told back to the region it came from."""
    rows = X.observations(spark, sf).withColumn("region", F.col("arrival_seq") % 6)
    kept = temporal.latest_per_entity(rows, X.T_MS, 12 * X.HOUR_MS)
    return kept.groupBy("region").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if("stale").alias("stale"), S.epoch_ms(F.max("sampled_at")).alias("freshest_ms")
    )


@query
def freshest_part(spark, sf):
    return latest.freshest(latest.replace_newer(_part_headers(spark, sf, 0), _part_headers(spark, sf, 1)))


DOCUMENT_PARTS = ("click", "error", "flight:purchase", "flight:signup", "view")


@query
def latest_document(spark, sf):
    """The document that readers see after each of four publishes: without one part, with a broken part, without any, whole."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    name = F.when(F.col("event_type").isin("purchase", "signup"), F.concat(F.lit("flight:"), "event_type")).otherwise(F.col("event_type"))
    parts = X.table(spark, sf, "events").groupBy(name.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max(day).alias("uploaded_at"))
    parts = parts.withColumn("body", F.concat(F.lit('{"records":'), F.col("n").cast("string"), F.lit("}")))
    broken = F.when(F.col("part") == "error", F.substring("body", 1, 9)).otherwise(F.col("body"))
    table = latest.LatestDocument(X.use_utc(spark), shared_dir(spark, "document"), DOCUMENT_PARTS)
    rounds = [parts.where("part <> 'click'"), parts.withColumn("body", broken), parts.limit(0), parts]
    out = None
    for i, given in enumerate(rounds):
        published = table.publish(given)
        shown = table.read().select(F.lit(i).alias("round"), F.lit(published).alias("published"), "number", "document")
        shown = spark.createDataFrame(shown.collect(), shown.schema)  # one row
        out = shown if out is None else out.unionByName(shown)
    return out


@query
def canonical_order(spark, sf):
    """Point reads of a table in order of its text ids, and how many files each opens."""
    rows = X.table(spark, sf, "events").select(F.concat(F.lit("e"), eid().cast("string")).alias("id"), "value")
    table = ordered.OrderedTable(X.use_utc(spark), shared_dir(spark, "ordered"), "id")
    table.write(rows, 1_000)
    out = table.is_sorted().select(F.lit("all").alias("id"), F.lit(0).alias("files"), F.lit(None).cast("double").alias("value"), "sorted")
    for key in ("e0", "e1234", "e77", "e5"):
        found = table.read(key, key).withColumn("files", F.lit(len(table.files(key, key)))).withColumn("sorted", F.lit(True))
        out = out.unionByName(found)
    return out


# --- arrivals -----------------------------------------------------------------------------


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = X.occurrences(spark, sf)
    return (
        temporal.slice_occurrence(rows, X.T_MS - 12 * X.HOUR_MS, X.DAY_MS),
        temporal.slice_occurrence(rows, X.T_MS, X.DAY_MS),
    )


@query
def arrivals(spark, sf):
    before, now = _snapshots(spark, sf)
    return A.arrivals(before, now, S.epoch_ms("occurred_at")).select("id", "arrived_ms")


@query
def recent_present(spark, sf):
    before, now = _snapshots(spark, sf)
    fresh = A.alive(A.arrivals(before, now, S.epoch_ms("occurred_at")), X.T_MS, 4 * X.HOUR_MS)
    return A.still_present(now, fresh).select("id", ms("occurred_at", "occurred_ms"))


@query
def newest_arrivals(spark, sf):
    before, now = _snapshots(spark, sf)
    return A.newest(A.arrivals(before, now, S.epoch_ms("occurred_at")), 100).select("id", "arrived_ms")


@query
def newest_present(spark, sf):
    before, now = _snapshots(spark, sf)
    return A.newest_present(now, A.arrivals(before, now, S.epoch_ms("occurred_at"))).select("id", "arrived_ms")


@query
def event_log(spark, sf):
    rows = X.occurrences(spark, sf)
    quakes = temporal.slice_occurrence(rows.where(F.col("event_type") != "error"), X.T_MS, X.DAY_MS)
    alerts = temporal.slice_occurrence(rows.where(F.col("event_type") == "error"), X.T_MS, X.DAY_MS)
    return A.event_log(quakes, alerts.withColumn("arrived_ms", S.epoch_ms("occurred_at")))


# --- freshness ----------------------------------------------------------------------------

POLL_LIMITS = {"click": 6 * 60_000, "error": 20 * 60_000, "purchase": 120 * 60_000, "signup": 30 * 60_000, "view": 6 * 60_000}


def _status(spark, sf) -> DataFrame:
    return ledger.layer_status(ledger.poll_summary(X.polls(spark, sf)), X.LAST_MS, POLL_LIMITS, ("click", "purchase"))


@query
def layer_status(spark, sf):
    polls = X.polls(spark, sf)
    summary = ledger.poll_summary(polls)
    counts = ledger.error_counts(polls, summary)
    status = ledger.layer_status(summary, X.LAST_MS, POLL_LIMITS, ("click", "purchase"))
    return status.join(counts, "layer", "left").withColumn("error_count", F.coalesce("error_count", F.lit(0)))


@query
def pulse(spark, sf):
    return ledger.pulse(_status(spark, sf))


@query
def stale_badges(spark, sf):
    return _status(spark, sf).select("layer", encode.stale_badge("status", "as_of_ms", X.LAST_MS).alias("badge"))


# --- encoding -----------------------------------------------------------------------------


@query
def encode_visual(spark, sf):
    e = eid()
    layer = F.get(F.array(*[F.lit(v) for v in ("earthquake", "weather", "news", "flight")]), (e % 4).cast("int"))
    rows = X.table(spark, sf, "events").select(
        "event_id", layer.alias("layer"), (F.col("user_id") % 5).cast("int").alias("rank"),
        F.when(e % 9 != 0, F.col("value") / 50.0).alias("magnitude"), (e % 200).alias("articles"),
        (e % 18).cast("double").alias("zoom"), F.when(e % 5 != 0, F.col("value")).alias("track"),
    )
    styled = encode.with_style(rows)
    zoom = F.col("zoom")
    size = (
        F.when(F.col("layer") == "earthquake", encode.quake_radius("magnitude", "size_factor"))
        .when(F.col("layer") == "news", encode.news_scale("articles") * encode.square_size(zoom))
        .when(F.col("layer") == "weather", encode.alert_size(zoom, "size_factor"))
        .otherwise(encode.flight_size(zoom))
    )
    return styled.select("event_id", "layer", "color", r6(size, "size"), r6(encode.orientation("track"), "yaw"))


@query
def detail_labels(spark, sf):
    e = eid()
    level = F.when(e % 4 == 0, "Red")
    cap = F.when(e % 3 == 0, "Severe")
    rows = X.spread_events(spark, sf)
    return rows.select(
        "event_id",
        encode.magnitude_label(F.when(e % 9 != 0, F.col("value"))).alias("magnitude"),
        encode.depth_label(F.when(e % 8 != 0, F.col("value") * 3)).alias("depth"),
        encode.altitude_label(F.when(e % 7 != 0, (e % 40_000).cast("double")), e % 5 == 0).alias("altitude"),
        encode.speed_label(F.when(e % 6 != 0, F.col("value"))).alias("speed"),
        encode.validity_label("ts", F.when(e % 2 == 0, F.col("ts"))).alias("validity"),
        encode.grade_label(level, cap, (e % 5).cast("int")).alias("grade"),
    )


# --- ledger -------------------------------------------------------------------------------


@query
def status_attempts(spark, sf):
    rows = X.table(spark, sf, "events").select("event_id", "event_type", "ts", S.slot_of("ts", 86_400).alias("slot"))
    numbered = ledger.attempts(rows, ["event_type", "slot"], S.slot_of("ts", 3600), [F.col("ts").asc(), eid().asc()])
    return numbered.select("event_id", "attempt")


@query
def ledger_attempts(spark, sf):
    """Attempts of two runs, the second one repeated: numbers go on and nothing counts twice."""
    e = eid()
    rows = X.table(spark, sf, "events").select(
        F.col("event_type").alias("layer"), S.slot_of("ts", 86_400).alias("slot"), (S.slot_of("ts", 86_400) * 1000).alias("scheduled_ms"), "event_id",
        F.coalesce(ledger.outcome_of(e % 10 == 0, e % 7, e % 3, e % 11 == 0), F.lit("ok")).alias("outcome"),
    )
    log = ledger.StatusLedger(X.use_utc(spark), shared_dir(spark, "ledger"))
    for batch, part in enumerate([rows.where(e % 2 == 0), rows.where(e % 2 == 1), rows.where(e % 2 == 1)]):
        log.append(part, min(batch, 1), [eid().asc()])
    return log.rows().select("event_id", "outcome", "attempt")


@query
def revisit_gap(spark, sf):
    rows = X.table(spark, sf, "events").select("user_id", S.epoch_ms("ts").alias("ms"))
    return ledger.revisit_gap(rows, "user_id", "ms", 60 * X.HOUR_MS, 30 * X.DAY_MS, X.DAY_MS)


def _page_rows(spark, sf) -> DataFrame:
    """Events in pages of 100. Of every 36 pages, 9 form one cycle and 27 the next."""
    e = eid()
    block, offset = (e / 3600).cast("bigint"), e % 3600
    small = offset < 900
    cycle = block * 2 + F.when(small, 0).otherwise(1)
    level_no = F.when(small, (offset / 300).cast("bigint")).otherwise(((offset - 900) / 900).cast("bigint"))
    page = F.when(small, (offset % 300 / 100).cast("bigint")).otherwise((offset % 900 / 100).cast("bigint")) + 1
    level = F.get(F.array(*[F.lit(v) for v in ("Green", "Orange", "Red")]), level_no.cast("int"))
    rows = X.table(spark, sf, "events").select(
        cycle.alias("cycle"), level.alias("level"), page.alias("page"), "event_id", "value"
    )
    return rows.withColumn("listed", (F.col("cycle") % 3 != 0) | (e % 100 < 90))


def _page_stats(spark, sf) -> DataFrame:
    e = eid()
    current = (F.col("value") > 20) & (F.col("cycle") % 4 != 2)
    return _page_rows(spark, sf).groupBy("cycle", "level", "page").agg(
        F.count_if("listed").alias("features"), F.count_if(current).alias("current"),
        F.bool_or(e % 4999 == 4998).alias("failed"),
    )


@query
def page_progress(spark, sf):
    return ledger.page_progress(_page_stats(spark, sf))


def _staged(pages: DataFrame) -> DataFrame:
    lost = (F.col("cycle") % 5 == 2) & (F.col("level") == "Red") & (F.col("page") == 1)
    return pages.where(~lost & ~F.col("failed"))


@query
def missing_chunks(spark, sf):
    pages = _page_stats(spark, sf)
    return ledger.missing_chunks(ledger.page_progress(pages), _staged(pages))


@query
def cycle_gate(spark, sf):
    pages = _page_stats(spark, sf)
    progress = ledger.page_progress(pages)
    return ledger.cycle_gate(progress, ledger.missing_chunks(progress, _staged(pages)))


@query
def gated_publish(spark, sf):
    """Snapshot per part after two publishes: some pages of withheld cycles come in between."""
    pages = _page_stats(spark, sf).persist()
    try:
        records = _page_rows(spark, sf).where("listed").join(pages.where("failed"), ["cycle", "level", "page"], "left_anti")
        records = records.select("cycle", "level", "page", (F.col("cycle") % 4).cast("string").alias("part"), eid().alias("id"), "value")
        lost = (F.col("cycle") % 5 == 2) & (F.col("level") == "Red") & (F.col("page") == 1)
        found = F.col("cycle") % 2 == 0
        table = publish.GatedTable(X.use_utc(spark), shared_dir(spark, "gated"))
        table.stage(records.where(~lost), pages)
        table.publish()
        table.stage(records.where(lost & found), pages.where(lost & found))
        table.publish()
    finally:
        pages.unpersist()
    decided = table.outcomes().where("publish").select("cycle", "ok", "outcome")
    shown = table.latest.read().groupBy("part", "cycle").agg(F.count(F.lit(1)).alias("records"))
    return shown.join(decided, "cycle")


@query
def usage_by_prefix(spark, sf):
    return ledger.usage(X.table(spark, sf, "documents"), "source", "n_chars", 1_000_000)


@query
def budget_unknown(spark, sf):
    """Some days have an hour whose count could not be asked for."""
    failed = (eid() % 500 == 499) & (F.dayofmonth("ts") % 3 == 0)
    rows = X.table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(~failed, eid() % 500).alias("requests"))
    return ledger.budget_flag(rows)


@query
def budget_flag(spark, sf):
    rows = X.table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), (eid() % 500).alias("requests"))
    return ledger.budget_flag(rows)


# --- related events -----------------------------------------------------------------------


@query
def related_events(spark, sf):
    """Views stand for aircraft, which take no part."""
    rows = X.events(spark, sf).where(F.col("event_type") != "view").withColumn("ms", S.epoch_ms("ts"))
    return related.related_events(rows, "event_id", "ms").select("a", "b", r6("km", "km"), "dt_ms")


# --- rates --------------------------------------------------------------------------------


def _samples(spark, sf) -> DataFrame:
    return X.table(spark, sf, "events").select("user_id", S.epoch_ms("ts").alias("ms"), F.col("value").alias("dt"))


@query
def rate_stats(spark, sf):
    rows = rates.rate_stats(
        _samples(spark, sf), "user_id", X.FIRST_INSTANT_MS - X.DAY_MS, X.LAST_MS, X.DAY_MS, 2 * X.DAY_MS,
        138_240_000, 4 * X.DAY_MS, 10.0,
    )
    per_day = 86_400.0
    return rows.select(
        "user_id", "samples", r6(F.col("min_rate") * per_day, "min_per_day"), r6("median_rate", "median_rate"), "p95_dt"
    )


@query
def rate_drops(spark, sf):
    return rates.drops_after(_samples(spark, sf), "user_id", X.FIRST_INSTANT_MS, X.DAY_MS, 28, 2 * X.DAY_MS, 60.0)


@query
def token_bucket(spark, sf):
    rows = rates.token_bucket(_samples(spark, sf).select("user_id", "ms"), "user_id", 1, 3, 12 * X.HOUR_MS)
    return rows.groupBy("user_id").agg(F.sum("requests").alias("requests"), F.sum("accepted").alias("accepted"))


# --- links --------------------------------------------------------------------------------


def _links(spark, sf) -> DataFrame:
    e = eid()
    rendered = X.spread_events(spark, sf).select(
        F.concat(F.lit("e"), e.cast("string")).alias("link_id"),
        F.concat(
            F.lit("/world?lat="), F.col("lat").cast("string"), F.lit("&lng="), F.col("lon").cast("string"),
            F.when(e % 3 == 0, "&l=nw,zz,eq").when(e % 3 == 1, "&l=").otherwise(""),
            F.when(e % 4 == 0, F.concat(F.lit("&t="), S.epoch_ms("ts").cast("string"))).when(e % 4 == 1, "&t=-5").when(e % 4 == 2, "&t=live").otherwise(""),
            F.when(e % 5 == 0, "&z=abc").when(e % 5 == 1, F.concat(F.lit("&z="), (e % 30).cast("string"))).otherwise(""),
            F.when(e % 6 == 0, "&play=1").when(e % 6 == 1, "&play=0").when(e % 6 == 2, "&play=x").otherwise(""),
            F.when(e % 7 == 0, "&rate=10").when(e % 7 == 1, "&rate=").otherwise(""),
            F.when(e % 2 == 0, F.concat(F.lit("&sel=usgs%3A"), e.cast("string"))).otherwise(""),
            F.when(e % 11 == 0, "#top").otherwise(""),
        ).alias("url"),
    )
    pages = X.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("link_id"), "url")
    return rendered.unionByName(pages)


@query
def link_state(spark, sf):
    return links.parse_links(_links(spark, sf)).select(
        "link_id", "lat", "lng", "z", "t", F.concat_ws(",", "layers").alias("layers"), "sel", "play", "rate"
    )


@query
def link_write(spark, sf):
    return links.write_links(links.parse_links(_links(spark, sf))).select("link_id", "query")


# --- streams ------------------------------------------------------------------------------


@query
def bucket_dedupe(spark, sf):
    rows = X.table(spark, sf, "events").select(
        F.col("user_id").alias("entity_id"), F.col("ts").alias("sampled_at"), eid().alias("arrival_seq")
    )
    return features.bucket_samples(rows, width_sec=21_600).select("entity_id", "bucket", "arrival_seq")


@query
def slot_tumbling_stream(spark, sf):
    return jobs.slot_counts(X.use_utc(spark), sf, "events.parquet", shared_dir(spark, "slot-stream"))


@query
def bounded_slot_stream(spark, sf):
    """Slots of rows that land in time, and rows that land too late by the slot they land in."""
    stream = jobs.stream_table(X.use_utc(spark), sf, "events.parquet")
    landed = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + eid() % 4 * 900)
    work = shared_dir(spark, "bounded-slots")
    jobs.bounded_slot_counts(stream.select("ts", landed.alias("landed_at")), work)
    kinds = [jobs.current_rows(spark, f"{work}/{k}", ["slot"]).withColumn("kind", F.lit(k)) for k in ("slots", "late")]
    return kinds[0].unionByName(kinds[1]).select("kind", "slot", "records")


@query
def poll_status_stream(spark, sf):
    polls = X.as_polls(jobs.stream_table(X.use_utc(spark), sf, "events.parquet"))
    summary = jobs.poll_summary_stream(polls, shared_dir(spark, "poll-stream"))
    return ledger.layer_status(summary, X.LAST_MS, POLL_LIMITS, ("click", "purchase"))


FRESHNESS_CLOCKS = [X.FIRST_INSTANT_MS + i * 41 * X.HOUR_MS + i * 7 * 60_000 for i in range(16)]


@query
def freshness_stream(spark, sf):
    """Status of every layer at several clock times, from the stream's changes."""
    polls = X.as_polls(jobs.stream_table(X.use_utc(spark), sf, "events.parquet"))
    changes = freshness.freshness_stream(polls, POLL_LIMITS, ("click", "purchase"))
    work = shared_dir(spark, "freshness")
    writer = changes.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint").option("path", f"{work}/changes")
    writer.trigger(availableNow=True).start().awaitTermination()
    return freshness.status_at(spark.read.parquet(f"{work}/changes"), FRESHNESS_CLOCKS)


SNAPSHOT_MS = 6 * X.HOUR_MS
ORIGIN_MS = X.FIRST_INSTANT_MS - X.DAY_MS
ARRIVAL_LIMITS = {"click": 100, "error": 50}
ARRIVAL_LIVES = {"click": 36 * X.HOUR_MS}


@query
def arrival_stream(spark, sf):
    """Users of six hours are a snapshot of their layer; the newest arrivals of every layer at the end."""
    stream = jobs.stream_table(X.use_utc(spark), sf, "events.parquet")
    snapshot = F.floor((S.epoch_ms("ts") - ORIGIN_MS) / SNAPSHOT_MS)
    sightings = stream.select(
        F.col("event_type").alias("layer"), F.col("user_id").alias("id"), snapshot.alias("snapshot"),
        F.timestamp_millis(F.lit(ORIGIN_MS) + snapshot * SNAPSHOT_MS).alias("at"),
    )
    board = arrived.ArrivalBoard(X.use_utc(spark), shared_dir(spark, "arrivals"), ARRIVAL_LIMITS)
    board.start(arrived.arrival_stream(sightings)).awaitTermination()
    return board.read(board.last_batch(), X.LAST_MS, ARRIVAL_LIVES)
