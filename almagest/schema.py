"""Record model: column types and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: durations -------------------------------------------------
MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
SLOT_SEC = 900  # storage slot, all layers
BUCKET_SEC = 180  # observation identity bucket
CYCLE_SEC = 3_600  # alert collection cycle
EXPIRED_GRACE_MS = 48 * HOUR_MS
TRACK_TTL_MS = 6 * HOUR_MS
ARRIVAL_LIFE_MS = 10 * MINUTE_MS
RELATED_MS = 60 * MINUTE_MS
RELATED_KM = 300.0
EARTH_KM = 6371.0088

# --- fixed values: slice rule per layer ---------------------------------------
TEMPORAL_SPEC = {
    "earthquake": ("instant", HOUR_MS),
    "news": ("file", 2 * HOUR_MS),
    "weather": ("interval", None),
    "flight": ("sampled", 20 * MINUTE_MS),
}

# --- fixed values: freshness thresholds per layer ------------------------------
STALE_AFTER_MS = {
    "earthquake": 6 * MINUTE_MS,
    "flight": 20 * MINUTE_MS,
    "weather": 120 * MINUTE_MS,
    "news": 30 * MINUTE_MS,
}

# --- fixed values: limits ------------------------------------------------------
MAX_QUAKE_ARRIVALS = 100
MAX_ALERT_ARRIVALS = 50
ARRIVAL_LIMITS = {"earthquake": MAX_QUAKE_ARRIVALS, "weather": MAX_ALERT_ARRIVALS}
LOG_ROWS = 50
PAGE_SIZE = 100
PAGE_CAP = 8
PAGES_PER_CYCLE = 10
OVERSIZE_BYTES = 2 * 1024 * 1024
CAPACITY_LIMIT_BYTES = 8 * 1024**3
DAILY_BUDGET = 100_000
BUDGET_SHARE = 0.8
RAW_DAYS = 7
SLOT_DAYS = 90
STAGING_HOURS = 3
SLOT_MIN_SEC = 1_577_836_800  # 2020-01-01
SLOT_MAX_SEC = 4_102_444_800  # 2100-01-01

# --- fixed values: collection regions ------------------------------------------
REGIONS = [
    ("seoul", 37.5, 127.0),
    ("tokyo", 35.68, 139.77),
    ("london", 51.51, -0.13),
    ("frankfurt", 50.0, 8.6),
    ("newyork", 40.71, -74.01),
    ("losangeles", 34.05, -118.25),
]

# --- fixed values: alert levels and their rank -----------------------------------
ALERT_RANK = {"Green": 1, "Orange": 2, "Red": 4}

# --- fixed values: display style per layer and rank -------------------------------
RANK_SIZE = {0: 1.0, 1: 1.15, 2: 1.3, 3: 1.45, 4: 1.6}
RANK_COLOR = {
    "earthquake": ["#f15400", "#ff6818", "#ff813e", "#ff9963", "#ffb289"],
    "weather": ["#ff3d3d", "#ff5454", "#ff6b6b", "#ff8282", "#ff9999"],
    "news": ["#b57f00", "#f0a800", "#ffc02d", "#ffd268", "#ffe3a3"],
    "flight": ["#4cc9f0"] * 5,
}

# --- fixed values: layer order and short keys in shared links ----------------------
LAYER_KEYS = [("earthquake", "eq"), ("weather", "wx"), ("flight", "fl"), ("news", "nw")]
LINK_DEFAULTS = {"lat": 20.0, "lng": 0.0, "z": 1.8, "rate": 1.0}

# --- fixed values: wanted columns of the 61-column news export (0-based) ------------
NEWS_COLUMNS = {"mentions": 31, "articles": 33, "place": 52, "lat": 56, "lon": 57, "url": 60}
GRID_DEG = 0.5

POSITION = T.ArrayType(T.DoubleType())
LINE = T.ArrayType(POSITION)
POLYGON = T.ArrayType(LINE)

GEOMETRY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("point", POSITION),
        T.StructField("line", LINE),
        T.StructField("polygon", POLYGON),
        T.StructField("multi", T.ArrayType(POLYGON)),
    ]
)

SEVERITY = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("raw", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

_TYPES = {
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _struct(fields: str) -> T.StructType:
    """A struct from 'name type, ...'; unlike the DDL parser it needs no session."""
    pairs = [field.split() for field in fields.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


QUAKE = _struct(
    "magnitude double, mag_type string, depth_km double, place string, tsunami boolean, status string, url string"
)
FLIGHT = _struct(
    "region_id string, callsign string, alt_baro_ft double, on_ground boolean, ground_speed_kt double, "
    "track_deg double, aircraft_type string, registration string, category string, seen_pos_sec double"
)
ALERT = _struct(
    "event string, headline string, area_desc string, cap_severity string, alert_level string, "
    "event_type string, url string, observed_until timestamp, geometry_kind string"
)
NEWS = _struct("place_name string, article_count double, sample_url string")

WORLD_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("revision", T.LongType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("geometry", GEOMETRY),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("severity", SEVERITY),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("valid_from", T.TimestampType()),
        T.StructField("valid_to", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("sampled_at", T.TimestampType()),
        T.StructField("quake", QUAKE),
        T.StructField("flight", FLIGHT),
        T.StructField("alert", ALERT),
        T.StructField("news", NEWS),
        T.StructField("arrival_seq", T.LongType()),
    ]
)
