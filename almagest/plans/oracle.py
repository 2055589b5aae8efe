"""SQL counterparts of the registered queries, over the same tables.

Written from the definitions, not from the Spark code: sequential rules are folded
with recursive queries, slices are plain predicates.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

T = 1705276800000
T_ORDERS = 896659200000
FIRST = 1704153600000
STEP = 21600000
COUNT = 112
LAST = 1706659200000
HOUR = 3600000
DAY = 86400000

EV = """ev AS (
  SELECT event_id, ts, (epoch_us(ts) // 1000) AS ms, user_id, event_type, value,
    CASE WHEN event_id % 101 = 0 THEN CAST(0 AS DOUBLE)
         ELSE CAST((event_id * 7919) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) END AS lon,
    CASE WHEN event_id % 101 = 0 THEN CAST(0 AS DOUBLE)
         WHEN event_id % 103 = 0 THEN CAST(999 AS DOUBLE)
         ELSE CAST((event_id * 104729) % 1800 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(90 AS DOUBLE) END AS lat
  FROM events)"""
VALID = "(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0))"
OBS = f"""{EV}, obs AS (
  SELECT user_id AS entity_id, epoch_ms(date_trunc('hour', ts)) AS sampled_ms, event_id AS arrival_seq, lon, lat FROM ev)"""
IV = """iv AS (
  SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS from_ms,
    CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + (o_orderkey % 90) * 86400000 END AS to_ms,
    epoch_ms(o_orderdate) + (o_orderkey % 90) * 86400000 AS any_to_ms,
    CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'cancelled' ELSE 'expired' END AS status
  FROM orders)"""
INSTANTS = f"ins AS (SELECT {FIRST} + i * {STEP} AS instant_ms FROM range({COUNT}) r(i))"
RANK_VALUE = "CASE WHEN value >= 200 THEN 4 WHEN value >= 100 THEN 3 WHEN value >= 50 THEN 2 ELSE 1 END"


def slot(width: int, c: str = "ts") -> str:
    return f"CAST(floor(epoch_us({c}) // 1000 / {width * 1000}) * {width} AS BIGINT)"


def num(expr: str) -> str:
    """Shortest text of a double; whole numbers without a fraction."""
    return f"CASE WHEN ({expr}) = floor({expr}) THEN CAST(CAST({expr} AS BIGINT) AS VARCHAR) ELSE CAST({expr} AS VARCHAR) END"


# --- time slices ----------------------------------------------------------------------

ORACLE["slice_occurrence"] = f"""
SELECT event_id AS id, (epoch_us(ts) // 1000) AS occurred_ms, {RANK_VALUE} AS rank FROM events
WHERE (epoch_us(ts) // 1000) >= {T - 6 * HOUR} AND ts <= make_timestamp({T} * 1000)"""

ORACLE["slice_interval"] = f"""
WITH {IV} SELECT id, from_ms, to_ms, status FROM iv
WHERE from_ms <= {T_ORDERS} AND (to_ms IS NULL OR {T_ORDERS} < to_ms) AND status <> 'cancelled'"""

ORACLE["intervals_many_instants"] = f"""
WITH {IV}, axis AS (SELECT {T_ORDERS - 180 * DAY} + i * {30 * DAY} AS instant_ms FROM range(12) r(i))
SELECT instant_ms, id, status FROM iv JOIN axis ON from_ms <= instant_ms AND (to_ms IS NULL OR instant_ms < to_ms)"""
ORACLE["interpolated_positions"] = f"""
WITH {OBS}, {INSTANTS}, s AS (SELECT * FROM obs WHERE lat <= 90 QUALIFY row_number() OVER (PARTITION BY entity_id, sampled_ms ORDER BY arrival_seq) = 1),
p AS (SELECT entity_id, sampled_ms AS t0, lon AS x0, lat AS y0, lead(sampled_ms) OVER w AS t1, lead(lon) OVER w AS x1, lead(lat) OVER w AS y1
  FROM s WINDOW w AS (PARTITION BY entity_id ORDER BY sampled_ms)),
f AS (SELECT entity_id, instant_ms, x0, y0, y1, (instant_ms - t0) / CAST(t1 - t0 AS DOUBLE) AS q,
    (x1 - x0 + 180) - floor((x1 - x0 + 180) / 360) * 360 - 180 AS turn
  FROM p JOIN ins ON instant_ms >= t0 AND instant_ms < t1 WHERE t1 - t0 <= {5 * DAY})
SELECT entity_id, instant_ms, round((x0 + turn * q + 180) - floor((x0 + turn * q + 180) / 360) * 360 - 180, 6) + 0 AS lon,
  round(y0 + (y1 - y0) * q, 6) + 0 AS lat FROM f"""
CELLS = f"""cc AS (SELECT CAST(floor(lon / %s) AS BIGINT) AS cell_x, CAST(floor(lat / %s) AS BIGINT) AS cell_y, {slot(900)} AS slot, count(*) AS records
  FROM ev WHERE {VALID} GROUP BY 1, 2, 3)"""
ORACLE["cell_counts"] = f"WITH {EV}, {CELLS % (10, 10)} SELECT * FROM cc"
ORACLE["density_baseline"] = f"""
WITH {EV}, {CELLS % (45, 45)} SELECT cell_x, cell_y, slot, records,
  round(coalesce(sum(records) OVER (PARTITION BY cell_x, cell_y ORDER BY slot RANGE BETWEEN 86400 PRECEDING AND 900 PRECEDING), 0) / 96.0, 6) AS baseline FROM cc"""
ORACLE["latest_per_entity"] = f"""
WITH {OBS} SELECT entity_id, sampled_ms, arrival_seq, {T} - sampled_ms > {12 * HOUR} AS stale
FROM obs WHERE sampled_ms <= {T}
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY sampled_ms DESC, arrival_seq) = 1"""

ORACLE["asof_many_instants"] = f"""
WITH {OBS}, {INSTANTS}
SELECT instant_ms, entity_id, sampled_ms, arrival_seq, instant_ms - sampled_ms > {12 * HOUR} AS stale
FROM ins JOIN obs ON sampled_ms <= instant_ms
QUALIFY row_number() OVER (PARTITION BY instant_ms, entity_id ORDER BY sampled_ms DESC, arrival_seq) = 1"""

ORACLE["occurrences_many_instants"] = f"""
WITH {EV}, {INSTANTS} SELECT instant_ms, event_id AS id, ms AS occurred_ms
FROM ins JOIN ev ON ms BETWEEN instant_ms - {9 * HOUR} AND instant_ms"""

WORLD = f"""{OBS}, {IV}, world AS (
  SELECT 'earthquake' AS layer, event_id AS id, ms AS at_ms, FALSE AS stale, lon, lat FROM ev
  WHERE ts >= make_timestamp({T - DAY} * 1000) AND ts <= make_timestamp({T} * 1000)
  UNION ALL SELECT 'weather', id, from_ms, FALSE, NULL, NULL FROM iv
  WHERE from_ms <= {T} AND (to_ms IS NULL OR {T} < to_ms) AND status <> 'cancelled'
  UNION ALL SELECT 'flight', arrival_seq, sampled_ms, {T} - sampled_ms > {12 * HOUR}, lon, lat FROM (
    SELECT * FROM obs WHERE sampled_ms <= {T}
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY sampled_ms DESC, arrival_seq) = 1))"""
ORACLE["world_state"] = f"WITH {WORLD} SELECT layer, id, at_ms, stale FROM world"
ORACLE["world_state_box"] = f"""
WITH {WORLD} SELECT layer, id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM world
WHERE (lon >= 120 OR lon <= -60) AND lat BETWEEN -60 AND 60"""

ORACLE["legacy_repair"] = f"""
WITH {IV}, fixed AS (
  SELECT id, from_ms, CASE WHEN status = 'active' THEN NULL ELSE any_to_ms END AS to_ms,
    CASE WHEN status = 'active' THEN any_to_ms END AS observed_ms FROM iv)
SELECT id, to_ms, observed_ms, from_ms <= {T_ORDERS} AND (to_ms IS NULL OR to_ms > {T_ORDERS}) AS active_at_t FROM fixed"""

ORACLE["record_lookup"] = """
SELECT CAST(event_id % 997 AS VARCHAR) AS id, event_type AS layer, event_id AS arrival_seq, value FROM events
WHERE event_id % 997 = 421
ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END, event_id
LIMIT 1"""

ORACLE["enabled_layers"] = "SELECT event_type AS layer, count(*) AS n FROM events WHERE event_type IN ('click', 'signup') GROUP BY 1"

# --- coordinates and geometry functions --------------------------------------------------

ORACLE["coord_validate"] = f"""
WITH {EV} SELECT event_type, count(*) AS incoming, count(*) FILTER ({VALID}) AS records, count(*) FILTER (NOT {VALID}) AS dropped
FROM ev GROUP BY event_type"""

ORACLE["great_circle"] = f"""
WITH {EV} SELECT event_id, round(degrees(acos(greatest(-1, least(1,
  sin(radians(lat)) * sin(radians(37.5)) + cos(radians(lat)) * cos(radians(37.5)) * cos(radians(127.0) - radians(lon)))))), 6) AS angle_deg
FROM ev WHERE {VALID}"""

ORACLE["dead_reckoning"] = f"""
WITH {EV}, moved AS (
  SELECT event_id, lon, radians(CAST(event_id % 360 AS DOUBLE)) AS rad, value / 100.0 AS dist,
    least(85.0, greatest(-85.0, lat + cos(radians(CAST(event_id % 360 AS DOUBLE))) * (value / 100.0))) AS lat2
  FROM ev WHERE {VALID}),
raw AS (SELECT event_id, lat2, lon + sin(rad) * dist / greatest(0.2, cos(radians(lat2))) + 180 AS x FROM moved)
SELECT event_id, round(x - 360 * floor(x / 360) - 180, 6) AS lon, round(lat2, 6) AS lat FROM raw"""

PATHS = f"""{EV}, bucketed AS (
  SELECT user_id AS entity_id, ms, event_id AS seq, lon, lat, CAST(floor(ms / 180000) * 180 AS BIGINT) AS bucket
  FROM ev WHERE lat <= 90
  QUALIFY row_number() OVER (PARTITION BY user_id, floor(ms / 180000) ORDER BY event_id DESC) = 1),
path AS (
  SELECT entity_id, CAST(floor(bucket / 432000) * 432000 AS BIGINT) AS span, ms, lon, lat,
    row_number() OVER (PARTITION BY entity_id, floor(bucket / 432000) ORDER BY ms, seq) - 1 AS pos FROM bucketed)"""
WALK = f"""{PATHS}, walk AS (
  SELECT entity_id, span, pos, lon, lat FROM path WHERE pos = 0
  UNION ALL
  SELECT p.entity_id, p.span, p.pos,
    CASE WHEN p.lon - w.lon > 180 THEN p.lon - 360 * ceil((p.lon - w.lon - 180) / 360)
         WHEN p.lon - w.lon < -180 THEN p.lon + 360 * ceil((w.lon - p.lon - 180) / 360) ELSE p.lon END, p.lat
  FROM walk w JOIN path p ON p.entity_id = w.entity_id AND p.span = w.span AND p.pos = w.pos + 1)"""
ORACLE["track_view"] = f"""
WITH {PATHS} SELECT entity_id, span, count(*) AS points, min(ms) AS first_ms, max(ms) AS last_ms FROM path GROUP BY 1, 2"""
ORACLE["unwrap_tracks"] = f"""
WITH RECURSIVE {WALK} SELECT entity_id, span, pos, round(lon, 6) AS lon, round(lat, 6) AS lat FROM walk"""
ORACLE["simplify_tracks"] = f"""
WITH RECURSIVE {PATHS}, vec AS (
  SELECT entity_id, span, pos, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM path),
stretch AS (
  SELECT entity_id, span, min(pos) AS a, max(pos) AS b FROM path GROUP BY 1, 2
  UNION ALL
  SELECT entity_id, span, CASE WHEN side = 0 THEN a ELSE far END, CASE WHEN side = 0 THEN far ELSE b END
  FROM (
    SELECT entity_id, span, a, b, arg_max(pos, (d, -pos)) AS far, max(d) AS d FROM (
      SELECT entity_id, span, a, b, pos, CASE
        WHEN size >= 1e-12 AND ((ny * az - nz * ay) * x + (nz * ax - nx * az) * y + (nx * ay - ny * ax) * z) > 0
          AND ((by_ * nz - bz * ny) * x + (bz * nx - bx * nz) * y + (bx * ny - by_ * nx) * z) > 0
        THEN asin(least(1, abs(x * nx + y * ny + z * nz) / size))
        ELSE 2 * asin(least(1, sqrt(least((x - ax) ** 2 + (y - ay) ** 2 + (z - az) ** 2, (x - bx) ** 2 + (y - by_) ** 2 + (z - bz) ** 2)) / 2)) END AS d
      FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM (
        SELECT s.entity_id, s.span, s.a, s.b, p.pos, p.x, p.y, p.z, f.x AS ax, f.y AS ay, f.z AS az, t.x AS bx, t.y AS by_, t.z AS bz,
          f.y * t.z - f.z * t.y AS nx, f.z * t.x - f.x * t.z AS ny, f.x * t.y - f.y * t.x AS nz
        FROM stretch s JOIN vec p ON p.entity_id = s.entity_id AND p.span = s.span AND p.pos > s.a AND p.pos < s.b
        JOIN vec f ON f.entity_id = s.entity_id AND f.span = s.span AND f.pos = s.a
        JOIN vec t ON t.entity_id = s.entity_id AND t.span = s.span AND t.pos = s.b)))
    GROUP BY 1, 2, 3, 4), (VALUES (0), (1)) sides(side)
  WHERE d * 6371.0088 > 500),
ends AS (SELECT entity_id, span, a AS pos FROM stretch UNION SELECT entity_id, span, b FROM stretch)
SELECT entity_id, span, points, kept FROM (SELECT entity_id, span, count(*) AS points FROM path GROUP BY 1, 2)
JOIN (SELECT entity_id, span, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS kept FROM ends GROUP BY 1, 2) USING (entity_id, span)"""
ORACLE["densify_tracks"] = f"""
WITH RECURSIVE {WALK}, leg AS (
  SELECT a.entity_id, a.span, b.pos AS leg, a.lon AS lon_a, radians(a.lon) AS l0, radians(a.lat) AS p0, radians(b.lon) AS l1, radians(b.lat) AS p1
  FROM walk a JOIN walk b ON a.entity_id = b.entity_id AND a.span = b.span AND b.pos = a.pos + 1),
vec AS (SELECT *, cos(p0) * cos(l0) AS ax, cos(p0) * sin(l0) AS ay, sin(p0) AS az,
  cos(p1) * cos(l1) AS bx, cos(p1) * sin(l1) AS by_, sin(p1) AS bz FROM leg),
ang AS (SELECT *, acos(greatest(-1, least(1, ax * bx + ay * by_ + az * bz))) AS om FROM vec),
st AS (SELECT *, greatest(1, CAST(ceil(degrees(om) / 10) AS INTEGER)) AS steps FROM ang),
cut AS (SELECT *, unnest(range(1, steps + 1)) AS step FROM st),
k AS (SELECT *, CASE WHEN om < 1e-9 THEN 0 ELSE sin((1 - step / CAST(steps AS DOUBLE)) * om) / sin(om) END AS k0,
  CASE WHEN om < 1e-9 THEN 1 ELSE sin(step / CAST(steps AS DOUBLE) * om) / sin(om) END AS k1 FROM cut),
pt AS (SELECT entity_id, span, leg, step, lon_a,
  round(degrees(atan2(ay * k0 + by_ * k1, ax * k0 + bx * k1)), 9) AS lon,
  degrees(asin(greatest(-1, least(1, az * k0 + bz * k1)))) AS lat FROM k)
SELECT entity_id, span, leg, step, round(CASE WHEN lon - lon_a > 180 THEN lon - 360 * ceil((lon - lon_a - 180) / 360)
  WHEN lon - lon_a < -180 THEN lon + 360 * ceil((lon_a - lon - 180) / 360) ELSE lon END, 4) AS lon, round(lat, 4) AS lat FROM pt
UNION ALL SELECT entity_id, span, 0, 0, round(lon, 4), round(lat, 4) FROM walk WHERE pos = 0"""

BOX = """boxes AS (
  SELECT c_custkey AS id, CAST((c_custkey * 15) % 360 AS DOUBLE) - 180 AS clon, CAST((c_custkey * 6) % 145 AS DOUBLE) - 72 AS clat FROM customer),
corner AS (SELECT * FROM (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) c(pos, sx, sy)),
part AS (SELECT * FROM (VALUES (0, 5.0), (1, 2.0)) r(ring, half)),
vertex AS (
  SELECT id, ring, pos, CASE WHEN x < -180 THEN x + 360 WHEN x > 180 THEN x - 360 ELSE x END AS lon, y AS lat FROM (
    SELECT id, ring, pos, clon + sx * CAST(half AS DOUBLE) AS x, clat + sy * CAST(half AS DOUBLE) AS y
    FROM boxes, corner, part WHERE ring = 0 OR id % 2 = 0))"""
RINGS = f"""{BOX}, unw AS (
  SELECT id, ring, pos, lon, lat FROM vertex WHERE ring = 0 AND pos = 0
  UNION ALL
  SELECT v.id, v.ring, v.pos, CASE WHEN v.lon - w.lon > 180 THEN v.lon - 360 WHEN v.lon - w.lon < -180 THEN v.lon + 360 ELSE v.lon END, v.lat
  FROM unw w JOIN vertex v ON v.id = w.id AND ((v.ring = w.ring AND v.pos = w.pos + 1) OR (w.ring = 0 AND w.pos = 0 AND v.ring = 1 AND v.pos = 0)))"""
ORACLE["ring_centroid"] = f"""
WITH {BOX} SELECT id, round(degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))), 6) AS lon, round(avg(lat), 6) AS lat
FROM vertex WHERE ring = 0 AND pos < 4 GROUP BY id
HAVING NOT (abs(avg(lat)) = 0 AND degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))) = 0)"""
ORACLE["ring_centroid"] = f"""
WITH {BOX}, c AS (
  SELECT id, degrees(atan2(sum(sin(radians(lon)) ORDER BY pos), sum(cos(radians(lon)) ORDER BY pos))) AS lon, sum(lat ORDER BY pos) / 4 AS lat
  FROM vertex WHERE ring = 0 AND pos < 4 GROUP BY id)
SELECT id, CASE WHEN {VALID} THEN round(lon, 6) END AS lon, CASE WHEN {VALID} THEN round(lat, 6) END AS lat FROM c"""
ORACLE["unwrap_polygons"] = f"WITH RECURSIVE {RINGS} SELECT id, ring, pos, round(lon, 6) AS lon, round(lat, 6) AS lat FROM unw"
ORACLE["ring_bounds"] = f"""
WITH RECURSIVE {RINGS} SELECT id, round(min(lat - lon), 6) AS u_min, round(max(lat - lon), 6) AS u_max,
  round(max(lon) - min(lon), 6) AS lon_span, round(max(lat) - min(lat), 6) AS lat_span FROM unw GROUP BY id"""


def hatch_of(rings: str) -> str:
    """Relational scanline clip over a vertex table (id, ring, pos, lon, lat)."""
    return f"""
edge AS (
  SELECT id, lat - lon AS ua, lat + lon AS va,
    coalesce(lead(lat - lon) OVER w, first_value(lat - lon) OVER w) AS ub, coalesce(lead(lat + lon) OVER w, first_value(lat + lon) OVER w) AS vb
  FROM {rings} WINDOW w AS (PARTITION BY id, ring ORDER BY pos)),
bound AS (SELECT id, min(lat - lon) AS lo, max(lat - lon) AS hi FROM {rings} GROUP BY id
  HAVING max(lat - lon) > min(lat - lon)),
scan AS (SELECT id, k AS line, lo + (hi - lo) / 13 * k AS u FROM bound, range(1, 13) r(k)),
cross_ AS (
  SELECT s.id, s.line, s.u, e.va + (s.u - e.ua) / (e.ub - e.ua) * (e.vb - e.va) AS v
  FROM scan s JOIN edge e ON e.id = s.id AND s.u >= least(e.ua, e.ub) AND s.u < greatest(e.ua, e.ub)),
pair AS (
  SELECT id, line, u, v AS v0, lead(v) OVER w AS v1, row_number() OVER w AS n FROM cross_ WINDOW w AS (PARTITION BY id, line ORDER BY v)),
seg AS (
  SELECT id, line, (v0 - u) / 2 AS lon0, (v0 + u) / 2 AS lat0, (v1 - u) / 2 AS lon1, (v1 + u) / 2 AS lat1 FROM pair WHERE n % 2 = 1 AND v1 > v0)"""


ORACLE["hatch_polygons"] = f"""
WITH RECURSIVE {RINGS}, {hatch_of('unw')}
SELECT id, line, round(lon0, 6) AS lon0, round(lat0, 6) AS lat0, round(lon1, 6) AS lon1, round(lat1, 6) AS lat1 FROM seg"""

SHAPES = RINGS.replace(
    "SELECT c_custkey AS id, CAST((c_custkey * 15) % 360 AS DOUBLE) - 180 AS clon, CAST((c_custkey * 6) % 145 AS DOUBLE) - 72 AS clat FROM customer",
    "SELECT c_custkey * 10 + p AS id, CAST(((c_custkey + 7 * p) * 15) % 360 AS DOUBLE) - 180 AS clon, "
    "CAST(((c_custkey + 7 * p) * 6) % 145 AS DOUBLE) - 72 AS clat FROM customer, range(2) r(p) WHERE p <= CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END",
).replace("id % 2 = 0", "(id // 10 + 7 * (id % 10)) % 2 = 0")
ORACLE["geometry_features"] = f"""
WITH RECURSIVE {SHAPES}, {hatch_of('unw')}
SELECT id // 10 AS id, CAST((id // 10) % 5 AS INTEGER) AS rank, 'cone' AS kind, CAST(id % 10 AS INTEGER) AS part, 1 AS n FROM boxes
UNION ALL SELECT id // 10, CAST((id // 10) % 5 AS INTEGER), 'hatch', CAST(id % 10 AS INTEGER), count(*) FROM seg GROUP BY id"""

ORACLE["geometry_split"] = """
SELECT CASE WHEN event_id % 3 = 1 THEN 'LineString' ELSE 'Polygon' END AS type, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1"""

# --- feeds --------------------------------------------------------------------------------

ORACLE["feed_quake"] = f"""
WITH {EV}, q AS (
  SELECT *, CASE WHEN event_id % 19 <> 0 THEN value / CAST(10 AS DOUBLE) END AS mag FROM ev
  WHERE event_id % 17 <> 0 AND event_id % 13 <> 0 AND (event_id // 50) % 29 <> 28 AND {VALID})
SELECT 'usgs:e' || event_id AS id, CASE WHEN event_id % 7 = 0 THEN ms ELSE ms + event_id % 5 * 1000 END AS revision, ms AS occurred_ms, lon, lat,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 700 AS DOUBLE) END AS depth_km, mag AS magnitude,
  CASE WHEN mag IS NULL THEN 0 WHEN mag >= 7 THEN 4 WHEN mag >= 5.5 THEN 3 WHEN mag >= 4 THEN 2 ELSE 1 END AS rank,
  'M' || ({num('mag')}) AS label, event_id % 2 = 1 AS tsunami FROM q"""

ORACLE["feed_aircraft"] = f"""
WITH {EV}, a AS (
  SELECT *, event_id // 50 AS doc, 1704067200000 + (event_id // 50) * 60000 AS sched FROM ev
  WHERE event_id % 23 <> 0 AND event_id % 31 <> 0 AND {VALID})
SELECT 'adsblol:ab' || user_id || ':' || CAST(floor(sched / 180000) * 180 AS BIGINT) AS id, 'ab' || user_id AS entity_id,
  CAST((CASE WHEN doc % 3 = 0 THEN {T} ELSE sched END) - CASE WHEN event_id % 6 = 0 THEN 0 ELSE (event_id % 60) * 500 END AS BIGINT) AS sampled_ms,
  lon, lat, CASE WHEN event_id % 4 IN (1, 2) THEN CAST(event_id % 40000 AS DOUBLE) END AS alt_baro_ft, event_id % 4 = 0 AS on_ground,
  value AS ground_speed_kt, 'CS' || event_id AS callsign,
  CASE doc % 6 WHEN 0 THEN 'seoul' WHEN 1 THEN 'tokyo' WHEN 2 THEN 'london' WHEN 3 THEN 'frankfurt' WHEN 4 THEN 'newyork' ELSE 'losangeles' END AS region_id,
  doc * 4294967296 + event_id % 50 AS arrival_seq FROM a"""

ALERT = f"""{EV}, al AS (
  SELECT *, CASE WHEN event_id % 37 = 0 THEN NULL ELSE floor(ms / 1000) * 1000 END AS from_ms,
    CASE WHEN event_id % 41 = 0 THEN NULL ELSE floor(ms / 1000) * 1000 + event_id % 10 * {DAY} END AS until_ms,
    event_id % 5 < 2 AS cur, CASE event_id % 4 WHEN 0 THEN 'Green' WHEN 1 THEN 'Orange' WHEN 2 THEN 'Red' ELSE 'Purple' END AS level FROM ev),
verdict AS (SELECT *, CASE WHEN event_id % 17 = 0 OR level = 'Purple' OR from_ms IS NULL OR NOT {VALID} THEN 'dropped'
    WHEN NOT cur AND (until_ms IS NULL OR until_ms < {T} - 48 * {HOUR}) THEN 'skipped' ELSE 'ok' END AS v FROM al)"""
ORACLE["feed_alert"] = f"""
WITH {ALERT}
SELECT 'gdacs:' || event_id || ':' || event_id % 5 AS id,
  CAST(CASE WHEN event_id % 3 = 0 THEN from_ms ELSE from_ms + {HOUR} END AS BIGINT) AS revision, CAST(from_ms AS BIGINT) AS from_ms,
  CAST(CASE WHEN NOT cur THEN until_ms END AS BIGINT) AS to_ms, CAST(until_ms AS BIGINT) AS observed_ms,
  CASE WHEN cur THEN 'active' ELSE 'expired' END AS status, CASE level WHEN 'Green' THEN 1 WHEN 'Orange' THEN 2 ELSE 4 END AS rank,
  value AS raw, CASE WHEN event_id % 2 = 0 THEN 'TC' ELSE 'FL' END || ' ' || level AS label, 'N' || event_id AS event, CAST(NULL AS VARCHAR) AS area_desc
FROM verdict WHERE v = 'ok'"""

ORACLE["feed_counters"] = f"""
WITH {ALERT}
SELECT 'quake' AS feed, count(*) AS incoming, count(*) FILTER (event_id % 17 <> 0 AND event_id % 13 <> 0 AND {VALID}) AS records,
  count(*) FILTER (NOT (event_id % 17 <> 0 AND event_id % 13 <> 0 AND {VALID})) AS dropped, 0 AS skipped FROM ev WHERE (event_id // 50) % 29 <> 28
UNION ALL SELECT 'aircraft', count(*), count(*) FILTER (event_id % 23 <> 0 AND event_id % 31 <> 0 AND {VALID}),
  count(*) FILTER (NOT (event_id % 23 <> 0 AND event_id % 31 <> 0 AND {VALID})), 0 FROM ev
UNION ALL SELECT 'alert', count(*), count(*) FILTER (v = 'ok'), count(*) FILTER (v = 'dropped'), count(*) FILTER (v = 'skipped') FROM verdict"""

ORACLE["feed_status"] = """
SELECT CASE WHEN doc % 29 = 28 THEN 'failed' ELSE 'ok' END AS outcome, count(*) AS docs, CAST(sum(CASE WHEN doc % 29 <> 28 THEN n END) AS BIGINT) AS elements
FROM (SELECT event_id // 50 AS doc, count(*) AS n FROM events GROUP BY 1) GROUP BY 1"""

CYC = f"""{EV}, feat AS (SELECT *, event_id // 40 AS doc_no, event_id % 40 AS kind, (event_id * 7) % 40 AS idx FROM ev),
ringv AS (
  SELECT event_id, pos, CASE WHEN lon + dx < -180 THEN lon + dx + 360 WHEN lon + dx > 180 THEN lon + dx - 360 ELSE lon + dx END AS vlon, lat + dy AS vlat
  FROM feat, (VALUES (0, CAST(-0.3 AS DOUBLE), CAST(-0.3 AS DOUBLE)), (1, CAST(0.3 AS DOUBLE), CAST(-0.3 AS DOUBLE)),
    (2, CAST(0.3 AS DOUBLE), CAST(0.3 AS DOUBLE)), (3, CAST(-0.3 AS DOUBLE), CAST(0.3 AS DOUBLE))) c(pos, dx, dy)),
cent AS (
  SELECT event_id, degrees(atan2(sum(sin(radians(vlon)) ORDER BY pos), sum(cos(radians(vlon)) ORDER BY pos))) AS lon, sum(vlat ORDER BY pos) / 4 AS lat
  FROM ringv GROUP BY event_id),
step AS (SELECT f.doc_no, f.idx, f.event_id, c.lon, c.lat FROM feat f JOIN cent c USING (event_id)
  WHERE kind > 2 AND c.lon BETWEEN -180 AND 180 AND c.lat BETWEEN -90 AND 90 AND NOT (c.lon = 0 AND c.lat = 0)),
track AS (SELECT *, count(*) OVER (PARTITION BY doc_no) AS n, row_number() OVER (PARTITION BY doc_no ORDER BY idx, event_id) - 1 AS pos FROM step)"""
ORACLE["cyclone_track_points"] = f"""
WITH {CYC} SELECT doc_no, pos, round(lon, 6) AS lon, round(lat, 6) AS lat FROM track WHERE n >= 2"""
ORACLE["cyclone_geometry"] = f"""
WITH {CYC}, docs AS (SELECT DISTINCT doc_no FROM feat),
tp AS (SELECT doc_no, max(n) AS n FROM track WHERE n >= 2 GROUP BY 1),
cone AS (SELECT f.doc_no, count(*) FILTER (vlat BETWEEN -90 AND 90 AND NOT (vlon = 0 AND vlat = 0)) AS ok,
    count(*) FILTER (pos = 0 AND vlat BETWEEN -90 AND 90 AND NOT (vlon = 0 AND vlat = 0)) AS again
  FROM feat f JOIN ringv USING (event_id) WHERE kind = 1 GROUP BY 1),
ctr AS (SELECT doc_no, lon, lat FROM feat WHERE kind = 0 AND {VALID})
SELECT d.doc_no, coalesce(tp.n, 0) AS track_points, CASE WHEN ok + again >= 3 THEN ok + again ELSE 0 END AS cone_points,
  round(ctr.lon, 6) AS lon, round(ctr.lat, 6) AS lat
FROM docs d LEFT JOIN tp USING (doc_no) LEFT JOIN cone USING (doc_no) LEFT JOIN ctr USING (doc_no)"""
ORACLE["cyclone_geometry"] = ORACLE["cyclone_geometry"].replace(
    "CASE WHEN ok + again >= 3 THEN ok + again ELSE 0 END", "coalesce(CASE WHEN ok + again >= 3 THEN ok + again END, 0)"
)

TC = """al AS (
  SELECT s_suppkey AS k, 'gdacs:' || s_suppkey || ':1' AS id, s_name, CASE WHEN s_suppkey % 11 = 0 THEN 'expired' ELSE 'active' END AS status,
    s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AS tc FROM supplier),
hit AS (
  SELECT al.*, p_partkey, CASE WHEN NOT tc OR p_partkey IS NULL THEN 'missing' WHEN p_size > 25 THEN 'stale' ELSE 'fresh' END AS outcome
  FROM al LEFT JOIN part ON p_partkey = k * 30),
geo AS (SELECT *, outcome = 'fresh' AND p_partkey % 4 <> 0 AS has_track, outcome = 'fresh' AND p_partkey % 9 <> 0 AS has_cone,
  outcome = 'fresh' AND p_partkey % 5 <> 0 AS has_centre FROM hit)"""
ORACLE["tc_cache_join"] = f"WITH {TC} SELECT id, outcome, has_track, has_cone FROM geo WHERE tc"
ORACLE["tc_apply"] = f"""
WITH {TC} SELECT id, CASE WHEN has_track THEN 'LineString' ELSE 'Point' END AS type, CASE WHEN has_track THEN 'track' END AS kind,
  CASE WHEN has_centre THEN 7 ELSE 10 END AS lon, CASE WHEN has_centre THEN 8 ELSE 20 END AS lat, status FROM geo
UNION ALL SELECT id || ':cone', 'Polygon', 'cone', CASE WHEN has_centre THEN 7 ELSE 10 END, CASE WHEN has_centre THEN 8 ELSE 20 END, status
FROM geo WHERE has_cone"""
ORACLE["tc_apply"] = (
    ORACLE["tc_apply"]
    .replace("THEN 7 ELSE 10 END", "THEN CAST(7 AS DOUBLE) ELSE 10 END")
    .replace("THEN 8 ELSE 20 END", "THEN CAST(8 AS DOUBLE) ELSE 20 END")
)
ORACLE["cyclone_index"] = f"WITH {TC} SELECT k AS event_id, CAST(1 AS BIGINT) AS episode_id, s_name AS name FROM al WHERE tc"

# --- news grid ----------------------------------------------------------------------------


def cells(file_sec: int, deg: str, extra: str = "TRUE") -> str:
    """Grid aggregate; the representative follows the running maximum in file order."""
    return f"""
WITH {EV}, r AS (
  SELECT {slot(file_sec)} AS f, event_id AS n, event_id % 20 AS m, event_id % 7 AS a,
    CASE WHEN event_id % 11 <> 0 THEN 'P' || event_id % 50 END AS place, CASE WHEN event_id % 3 <> 0 THEN 'u' || event_id END AS url,
    CAST(floor(CASE WHEN lon = 180 THEN -180 ELSE lon END / CAST({deg} AS DOUBLE)) AS BIGINT) AS x,
    CAST(least(floor(lat / CAST({deg} AS DOUBLE)), 90 / CAST({deg} AS DOUBLE) - 1) AS BIGINT) AS y
  FROM ev WHERE event_id % 97 <> 0 AND {VALID} AND {extra}),
run AS (SELECT *, coalesce(max(m) OVER (PARTITION BY f, x, y ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM r),
c AS (SELECT f, x, y, sum(a) AS s, max_by(place, n) FILTER (m > top AND place IS NOT NULL) AS place_name,
  max_by(url, n) FILTER (m > top AND url IS NOT NULL) AS sample_url FROM run GROUP BY f, x, y)
SELECT 'gdelt:' || f || ':' || x || ':' || y AS id, f * 1000 AS occurred_ms, (x + CAST(0.5 AS DOUBLE)) * CAST({deg} AS DOUBLE) AS lon,
  (y + CAST(0.5 AS DOUBLE)) * CAST({deg} AS DOUBLE) AS lat, CASE WHEN s >= 50 THEN 3 WHEN s >= 10 THEN 2 ELSE 1 END AS rank,
  CAST(s AS VARCHAR) || ' articles' AS label, CAST(s AS DOUBLE) AS article_count, place_name, sample_url FROM c"""


ORACLE["grid_cells"] = cells(900, "0.5")
ORACLE["grid_representative"] = cells(259200, "30")
ORACLE["tsv_grid"] = cells(900, "0.5", "event_id % 89 <> 0")
ORACLE["tsv_counters"] = f"""
WITH {EV} SELECT {slot(900)} AS file_sec, count(*) AS rows,
  count(*) FILTER (NOT (event_id % 97 <> 0 AND event_id % 89 <> 0 AND {VALID})) AS dropped FROM ev GROUP BY 1"""
ORACLE["file_stamps"] = """
SELECT event_id, 'http://x/' || strftime(ts, '%Y%m%d%H%M%S') || '.export.CSV.zip' AS url, epoch_ms(date_trunc('second', ts)) AS file_ms
FROM events WHERE event_id % 3 <> 1"""
ORACLE["put_if_absent"] = f"""
WITH k AS (SELECT event_id, user_id % 7 || '/' || {slot(900)} AS file_key FROM events)
SELECT file_key, count(*) AS n FROM k WHERE event_id % 2 = 1 AND file_key NOT IN (SELECT file_key FROM k WHERE event_id % 2 = 0) GROUP BY 1"""
ORACLE["region_dimension"] = """
WITH r(i, region_id, lat, lon) AS (VALUES (0, 'seoul', 37.5, 127.0), (1, 'tokyo', 35.68, 139.77), (2, 'london', 51.51, -0.13),
  (3, 'frankfurt', 50.0, 8.6), (4, 'newyork', 40.71, -74.01), (5, 'losangeles', 34.05, -118.25))
SELECT region_id, count(*) AS n, CAST(any_value(lat) AS DOUBLE) AS lat, CAST(any_value(lon) AS DOUBLE) AS lon
FROM events JOIN r ON user_id % 6 = i GROUP BY region_id"""

# --- merges and slots ---------------------------------------------------------------------

LINE = """li AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS revision, l_partkey, l_suppkey, l_extendedprice,
  epoch_ms(l_shipdate) AS ship_ms, l_partkey % 2 AS side FROM lineitem)"""
LINE_COLS = "id, revision, l_partkey, l_suppkey, l_extendedprice, ship_ms"
LINE_TIES = "l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, ship_ms DESC"
ORACLE["merge_revision"] = f"""
WITH {LINE} SELECT {LINE_COLS} FROM li
QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC, side DESC, {LINE_TIES}) = 1"""
ORACLE["merge_last"] = f"""
WITH {LINE} SELECT {LINE_COLS} FROM li
QUALIFY row_number() OVER (PARTITION BY id ORDER BY side DESC, revision DESC, {LINE_TIES}) = 1"""
ORACLE["dedupe_pages"] = f"""
WITH {LINE} SELECT {LINE_COLS}, l_suppkey % 3 AS list_seq FROM li
QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC, l_suppkey % 3 DESC, {LINE_TIES}) = 1"""

SIDES = f"""u AS (SELECT {slot(86400)} AS slot, user_id AS id, event_id % 7 AS revision, value, event_id AS seq FROM events),
stored AS (SELECT * FROM u WHERE seq % 2 = 0 OR (slot // 86400) % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY slot, id ORDER BY revision DESC, seq DESC) = 1),
incoming AS (SELECT * FROM u WHERE seq % 2 = 1 OR (slot // 86400) % 3 <> 0),
merged AS (SELECT * FROM (SELECT *, 0 AS side FROM stored UNION ALL SELECT *, 1 FROM incoming)
  QUALIFY row_number() OVER (PARTITION BY slot, id ORDER BY revision DESC, side DESC, seq DESC) = 1),
diff AS (
  SELECT DISTINCT slot FROM (SELECT slot, id, revision, value FROM merged EXCEPT SELECT slot, id, revision, value FROM stored)
  UNION SELECT DISTINCT slot FROM (SELECT slot, id, revision, value FROM stored EXCEPT SELECT slot, id, revision, value FROM merged))"""
ORACLE["slot_changed"] = f"WITH {SIDES} SELECT slot, count(*) AS records FROM merged WHERE slot IN (SELECT slot FROM diff) GROUP BY slot"
ORACLE["slot_publish"] = f"""
WITH {SIDES} SELECT slot, count(*) AS records, CAST(sum(revision) AS BIGINT) AS revisions,
  CASE WHEN slot IN (SELECT slot FROM diff) AND slot IN (SELECT slot FROM stored) THEN 1 ELSE 0 END AS generation FROM merged GROUP BY slot"""
ORACLE["slot_read_pinned"] = f"""
WITH {SIDES}, first AS (SELECT slot, revision FROM stored UNION ALL SELECT slot, revision FROM merged WHERE slot NOT IN (SELECT slot FROM stored))
SELECT slot, count(*) AS records, CAST(sum(revision) AS BIGINT) AS revisions FROM first GROUP BY slot"""
ORACLE["slot_known_at"] = f"WITH {SIDES} SELECT slot, count(*) AS records, CAST(sum(revision) AS BIGINT) AS revisions FROM stored GROUP BY slot"
ORACLE["slot_distribution"] = f"SELECT {slot(900)} AS slot, count(*) AS records FROM events GROUP BY 1"
ORACLE["commit_slots"] = f"""
WITH c AS (SELECT event_type, {slot(900)} AS slot, CAST(floor((floor((epoch_us(ts) // 1000) / 1000) + event_id % 4 * 900) / 900) * 900 AS BIGINT) AS cur FROM events)
SELECT event_type, count(*) FILTER (slot IN (cur, cur - 900)) AS committed, count(*) FILTER (slot NOT IN (cur, cur - 900)) AS skipped FROM c GROUP BY 1"""
ORACLE["slot_rebucket"] = f"""
SELECT {slot(900)} AS slot, CAST(CASE event_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 180 ELSE 900 END AS BIGINT) AS stored_width_sec, count(*) AS records
FROM events GROUP BY 1, 2"""
ORACLE["slot_addresses"] = f"""
WITH a AS (
  SELECT event_id, CASE WHEN event_id % 10 = 3 THEN CAST(floor((epoch_us(ts) // 1000) / 1000) AS BIGINT) + 3155760000
      WHEN event_id % 2 = 0 THEN {slot(900)} ELSE CAST(floor((epoch_us(ts) // 1000) / 1000) AS BIGINT) END AS slot,
    CASE WHEN event_id % 8 = 2 THEN '2024-02-30' WHEN event_id % 8 = 4 THEN '24-1-1' ELSE strftime(ts, '%Y-%m-%d') END AS date,
    CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN '7' WHEN 2 THEN '01' WHEN 3 THEN '1234567' ELSE '12' END AS g FROM events)
SELECT * FROM a WHERE slot % 900 = 0 AND slot >= 1577836800 AND slot < 4102444800 AND event_id % 8 NOT IN (2, 4) AND event_id % 5 NOT IN (2, 3)"""
ORACLE["retention"] = """
SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-24' GROUP BY 1"""
ORACLE["same_slices"] = f"""
WITH s AS (SELECT count(*) FILTER ((epoch_us(ts) // 1000) BETWEEN {T - DAY} AND {T}) AS a, count(*) FILTER ((epoch_us(ts) // 1000) BETWEEN {T} AND {T + DAY}) AS b FROM events)
SELECT 'same instant' AS "case", TRUE AS same FROM s UNION ALL SELECT 'a day later', a = 0 AND b = 0 FROM s"""
ORACLE["gap_bands"] = f"""
WITH miss AS (
  SELECT slot, strftime(make_timestamp(slot * 1000000), '%Y-%m-%d') AS dt FROM (SELECT 1704067200 + i * 900 AS slot FROM range(2880) r(i))
  WHERE slot NOT IN (SELECT {slot(900)} FROM events WHERE event_type = 'purchase')),
isl AS (SELECT *, slot - row_number() OVER (PARTITION BY dt ORDER BY slot) * 900 AS g FROM miss)
SELECT dt, min(slot) AS gap_from, max(slot) AS gap_to, count(*) AS slots FROM isl GROUP BY dt, g"""

# --- latest -------------------------------------------------------------------------------

PARTS = f"""hd AS (SELECT event_type || ':' || user_id % 6 AS part, event_id % 2 AS side, (epoch_us(max(ts)) // 1000) AS as_of FROM events GROUP BY 1, 2)"""
ORACLE["publish_monotone"] = f"""
WITH {PARTS} SELECT part, as_of, side = 1 AS replaced FROM hd QUALIFY row_number() OVER (PARTITION BY part ORDER BY as_of DESC, side) = 1"""
ORACLE["latest_publish"] = f"""
WITH {EV}, e AS (SELECT CAST(user_id % 6 AS VARCHAR) AS part, event_id, ts, ms FROM ev),
o AS (SELECT *, event_id % 2 AS n FROM e),
h AS (SELECT part, n, max(ms) + CASE WHEN n = 0 THEN 0 WHEN part < '3' THEN {40 * DAY} ELSE {-40 * DAY} END AS as_of FROM o GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY as_of DESC, n) = 1)
SELECT part, count(*) AS records, max(event_id) AS last_id, any_value(as_of) AS as_of FROM o JOIN h USING (part, n) GROUP BY part"""
ORACLE["region_survivors"] = f"""
WITH {OBS}, k AS (SELECT *, {T} - sampled_ms > {12 * HOUR} AS stale FROM obs WHERE sampled_ms <= {T}
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY sampled_ms DESC, arrival_seq) = 1)
SELECT arrival_seq % 6 AS region, count(*) AS entities, count(*) FILTER (stale) AS stale, max(sampled_ms) AS freshest_ms FROM k GROUP BY 1"""
ORACLE["freshest_part"] = f"WITH {PARTS} SELECT max(as_of) AS as_of FROM hd"
ORACLE["latest_assembly"] = """
WITH last AS (SELECT event_type || ':' || user_id % 6 AS part, ts, event_id % 7 <> 0 AS valid FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 6 ORDER BY ts DESC) = 1),
ex AS (SELECT DISTINCT event_type || ':' || i AS part FROM events, range(7) r(i)),
j AS (SELECT ex.part, ts, valid FROM ex LEFT JOIN last USING (part))
SELECT coalesce(string_agg(part, ',' ORDER BY part) FILTER (ts IS NULL), '') AS partial, coalesce(string_agg(part, ',' ORDER BY part) FILTER (NOT valid), '') AS invalid,
  (epoch_us(max(ts) FILTER (valid)) // 1000) AS updated_ms, count(*) FILTER (valid) AS present,
  count(*) FILTER (NOT valid) = 0 AND count(*) FILTER (valid) > 0 AS publish FROM j"""
ORACLE["changed_parts"] = f"""
WITH {EV}, a AS (SELECT user_id AS part, max(ms) AS v FROM ev WHERE ms <= {T - DAY} GROUP BY 1),
b AS (SELECT user_id AS part, max(ms) AS v FROM ev WHERE ms <= {T} GROUP BY 1)
SELECT coalesce(a.part, b.part) AS part, a.v AS old_as_of, b.v AS as_of, CASE WHEN a.part IS NULL THEN 'added' WHEN b.part IS NULL THEN 'removed' ELSE 'moved' END AS change
FROM a FULL OUTER JOIN b ON a.part = b.part WHERE a.v IS DISTINCT FROM b.v"""

# --- arrivals -----------------------------------------------------------------------------

FRESH = f"""{EV}, fresh AS (SELECT event_id AS id, ms AS arrived_ms, event_type FROM ev
  WHERE ts <= make_timestamp({T} * 1000) AND ts > make_timestamp({T - 12 * HOUR} * 1000))"""
ORACLE["arrivals"] = f"WITH {FRESH} SELECT id, arrived_ms FROM fresh"
ORACLE["recent_present"] = f"WITH {FRESH} SELECT id, arrived_ms AS occurred_ms FROM fresh WHERE {T} - arrived_ms < {4 * HOUR}"
ORACLE["newest_arrivals"] = f"WITH {FRESH} SELECT id, arrived_ms FROM fresh ORDER BY arrived_ms DESC, id LIMIT 100"
ORACLE["newest_present"] = f"WITH {FRESH} SELECT id, arrived_ms FROM fresh ORDER BY arrived_ms DESC, id LIMIT 1"
ORACLE["event_log"] = f"""
WITH {EV} SELECT CASE WHEN event_type = 'error' THEN 'alert' ELSE 'quake' END AS kind, ms AS sort_ms, CAST(event_id AS VARCHAR) AS id FROM ev
WHERE ts >= make_timestamp({T - DAY} * 1000) AND ts <= make_timestamp({T} * 1000) ORDER BY sort_ms DESC, kind DESC, id LIMIT 50"""

# --- freshness ----------------------------------------------------------------------------

STATUS = f"""pl AS (
  SELECT event_type AS layer, ts, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) - event_id % 7 * 60000 AS as_of,
    CASE event_id % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'schema_error' WHEN 2 THEN 'same' WHEN 3 THEN 'same' ELSE 'ok' END AS o FROM events),
sm AS (SELECT layer, max(ts) FILTER (o = 'ok') AS ok_at, max_by(as_of, ts) FILTER (o = 'ok') AS as_of_ms, max(ms) FILTER (o IN ('ok', 'same')) AS last_success_ms,
  max(ts) FILTER (o = 'schema_error') AS sch_at FROM pl GROUP BY layer),
st AS (SELECT *, coalesce(sch_at > ok_at, FALSE) AS schema_failed,
  CASE layer WHEN 'click' THEN 360000 WHEN 'error' THEN 1200000 WHEN 'purchase' THEN 7200000 WHEN 'signup' THEN 1800000 ELSE 360000 END AS lim,
  CASE WHEN layer IN ('click', 'purchase') THEN last_success_ms ELSE as_of_ms END AS basis FROM sm),
status AS (SELECT *, CASE WHEN schema_failed THEN 'error' WHEN {LAST} - basis > lim THEN 'stale' ELSE 'ready' END AS status FROM st)"""
ORACLE["layer_status"] = f"""
WITH {STATUS}, since AS (SELECT pl.*, min(pl.ts) FILTER (o = 'schema_error') OVER (PARTITION BY pl.layer) AS broken FROM pl JOIN sm USING (layer) WHERE pl.ts > ok_at),
clr AS (SELECT layer, max(ts) FILTER (o = 'same' AND (broken IS NULL OR ts < broken)) AS cleared FROM since GROUP BY layer),
err AS (SELECT layer, count(*) FILTER (o IN ('error', 'schema_error')) AS n FROM since JOIN clr USING (layer) WHERE cleared IS NULL OR ts > cleared GROUP BY layer)
SELECT layer, status, schema_failed, as_of_ms, last_success_ms, coalesce(n, 0) AS error_count FROM status LEFT JOIN err USING (layer)"""
ORACLE["pulse"] = f"""
WITH {STATUS} SELECT CASE WHEN bool_or(status = 'ready') THEN 'live' WHEN bool_or(last_success_ms IS NOT NULL) THEN 'stale' ELSE 'standby' END AS pulse FROM status"""
ORACLE["stale_badges"] = f"""
WITH {STATUS} SELECT layer, CASE WHEN status = 'stale' THEN CAST(greatest(1, CAST(floor(({LAST} - as_of_ms) / 60000) AS BIGINT)) AS VARCHAR) || ' min late' ELSE status END AS badge FROM status"""
ORACLE["poll_status_stream"] = f"WITH {STATUS} SELECT layer, status, schema_failed, as_of_ms, last_success_ms FROM status"

# --- encoding -----------------------------------------------------------------------------

ORACLE["encode_visual"] = """
WITH e AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'earthquake' WHEN 1 THEN 'weather' WHEN 2 THEN 'news' ELSE 'flight' END AS layer, user_id % 5 AS rank,
    CASE WHEN event_id % 9 <> 0 THEN value / CAST(50 AS DOUBLE) END AS mag, event_id % 200 AS art, CAST(event_id % 18 AS DOUBLE) AS z,
    CASE WHEN event_id % 5 <> 0 THEN value END AS track FROM events),
s AS (SELECT *, CASE rank WHEN 0 THEN 1.0 WHEN 1 THEN 1.15 WHEN 2 THEN 1.3 WHEN 3 THEN 1.45 ELSE 1.6 END::DOUBLE AS mul,
  greatest(1200, least(80000, CAST(120000 AS DOUBLE) / pow(2, z))) AS sq FROM e)
SELECT event_id, layer, CASE layer
    WHEN 'earthquake' THEN ['#f15400', '#ff6818', '#ff813e', '#ff9963', '#ffb289'][rank + 1]
    WHEN 'weather' THEN ['#ff3d3d', '#ff5454', '#ff6b6b', '#ff8282', '#ff9999'][rank + 1]
    WHEN 'news' THEN ['#b57f00', '#f0a800', '#ffc02d', '#ffd268', '#ffe3a3'][rank + 1] ELSE '#4cc9f0' END AS color,
  round(CASE layer WHEN 'earthquake' THEN greatest(3, 3 + coalesce(mag, 1) * CAST(1.6 AS DOUBLE)) * mul
    WHEN 'news' THEN (CAST(0.75 AS DOUBLE) + CAST(0.5 AS DOUBLE) * log10(greatest(1, art))) * sq WHEN 'weather' THEN sq * 4 * mul
    ELSE greatest(1500, least(90000, CAST(140000 AS DOUBLE) / pow(2, z))) END, 6) AS size,
  round(0 - coalesce(track, 0), 6) AS yaw FROM s"""


def fixed1(x: str) -> str:
    """One decimal, exact on the binary value; only exact halves need a hand."""
    return (
        f"CASE WHEN ({x}) * 4 = floor(({x}) * 4) AND CAST(({x}) * 4 AS BIGINT) % 2 = 1 "
        f"THEN printf('%.1f', (floor(({x}) * 10) + 1) / 10) ELSE printf('%.1f', {x}) END"
    )


ORACLE["detail_labels"] = f"""
SELECT event_id,
  CASE WHEN event_id % 9 = 0 THEN 'M?' ELSE 'M' || {fixed1('value')} END AS magnitude,
  CASE WHEN event_id % 8 = 0 THEN 'unknown' ELSE {fixed1('value * 3')} || ' km' END AS depth,
  CASE WHEN event_id % 5 = 0 THEN 'ground' WHEN event_id % 7 = 0 THEN 'unknown' ELSE format('{{:,}}', event_id % 40000) || ' ft' END AS altitude,
  CASE WHEN event_id % 6 = 0 THEN 'unknown' ELSE CAST(CAST(floor(value + 0.5) AS BIGINT) AS VARCHAR) || ' kt' END AS speed,
  strftime(ts, '%Y-%m-%d %H:%M') || ' ~ ' || CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE 'open' END AS validity,
  CASE WHEN event_id % 4 = 0 THEN 'Red (rank ' || event_id % 5 || ')' WHEN event_id % 3 = 0 THEN 'Severe (rank ' || event_id % 5 || ')'
    ELSE 'rank ' || event_id % 5 END AS grade
FROM events"""

# --- ledger -------------------------------------------------------------------------------

ORACLE["status_attempts"] = f"""
SELECT event_id, row_number() OVER (PARTITION BY event_type, {slot(86400)} ORDER BY ts, event_id) - 1 AS attempt FROM events"""
ORACLE["revisit_gap"] = f"""
WITH {EV}, g AS (SELECT user_id, ms, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS gap FROM ev)
SELECT user_id, count(*) AS visits, greatest(max(gap), min(ms) + {30 * DAY} - max(ms)) AS max_gap_ms,
  greatest(max(gap), min(ms) + {30 * DAY} - max(ms)) < {60 * HOUR} AS within FROM g GROUP BY user_id"""

PAGES = """o AS (SELECT event_id, value, event_id // 3600 AS b, event_id % 3600 AS off FROM events),
pg AS (
  SELECT event_id, value, b * 2 + CASE WHEN off < 900 THEN 0 ELSE 1 END AS cycle,
    CASE CASE WHEN off < 900 THEN off // 300 ELSE (off - 900) // 900 END WHEN 0 THEN 'Green' WHEN 1 THEN 'Orange' ELSE 'Red' END AS level,
    CASE WHEN off < 900 THEN off % 300 // 100 ELSE off % 900 // 100 END + 1 AS page FROM o),
st AS (
  SELECT cycle, level, page, count(*) FILTER (cycle % 3 <> 0 OR event_id % 100 < 90) AS features,
    count(*) FILTER (value > 20 AND cycle % 4 <> 2) AS cur, bool_or(event_id % 4999 = 4998) AS failed FROM pg GROUP BY 1, 2, 3),
every AS (SELECT DISTINCT cycle, lv AS level FROM st, (VALUES ('Green'), ('Orange'), ('Red')) l(lv)),
lvl AS (
  SELECT e.cycle, e.level, count(*) FILTER (NOT failed) AS pages, coalesce(CAST(sum(cur) FILTER (NOT failed) AS BIGINT), 0) AS current,
    max_by(features, page) FILTER (NOT failed) AS lf, max_by(cur, page) FILTER (NOT failed) AS lc, max(page) FILTER (NOT failed) AS lp, coalesce(bool_or(failed), FALSE) AS bad
  FROM every e LEFT JOIN st USING (cycle, level) GROUP BY 1, 2),
s1 AS (SELECT *, CASE WHEN bad THEN 'failed' WHEN lp IS NULL THEN 'pending' WHEN lf < 100 THEN 'complete' WHEN lc = 0 THEN 'complete' WHEN lp >= 8 THEN 'capped' ELSE 'pending' END AS s,
  sum(pages) OVER (PARTITION BY cycle) AS used FROM lvl),
prog AS (SELECT cycle, level, pages, current, CASE WHEN s = 'pending' AND used >= 10 THEN 'capped' ELSE s END AS state FROM s1),
miss AS (
  SELECT cycle, level, page FROM (SELECT cycle, level, unnest(range(1, pages + 1)) AS page FROM prog) p
  WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.cycle = p.cycle AND st.level = p.level AND st.page = p.page AND NOT st.failed
    AND NOT (st.cycle % 5 = 2 AND st.level = 'Red' AND st.page = 1)))"""
ORACLE["page_progress"] = f"WITH {PAGES} SELECT cycle, level, pages, current, state FROM prog"
ORACLE["missing_chunks"] = f"WITH {PAGES} SELECT cycle, level, page FROM miss"
ORACLE["cycle_gate"] = f"""
WITH {PAGES}, g AS (
  SELECT cycle, count(*) FILTER (state NOT IN ('complete', 'capped')) AS unfinished, count(*) FILTER (state = 'capped') AS capped FROM prog GROUP BY cycle),
m AS (SELECT cycle, count(*) AS n FROM miss GROUP BY cycle)
SELECT cycle, unfinished, capped, coalesce(n, 0) AS missing, unfinished = 0 AND coalesce(n, 0) = 0 AS publish,
  unfinished = 0 AND coalesce(n, 0) = 0 AND capped = 0 AS ok FROM g LEFT JOIN m USING (cycle)"""
ORACLE["usage_by_prefix"] = """
SELECT source AS prefix, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS objects, CAST(NULL AS BOOLEAN) AS over_limit FROM documents GROUP BY source
UNION ALL SELECT '(total)', CAST(sum(n_chars) AS BIGINT), count(*), sum(n_chars) > 1000000 FROM documents"""
ORACLE["budget_flag"] = """
SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(sum(event_id % 500) AS BIGINT) AS requests,
  CASE WHEN sum(event_id % 500) > 80000 THEN 'relaxed' ELSE 'cleared' END AS state FROM events GROUP BY 1"""

ORACLE["gated_publish"] = f"""
WITH {PAGES.replace("AND st.page = 1)", "AND st.page = 1 AND st.cycle % 2 = 1)")}, g AS (
  SELECT cycle, count(*) FILTER (state NOT IN ('complete', 'capped')) AS unfinished, count(*) FILTER (state = 'capped') AS capped FROM prog GROUP BY cycle),
passed AS (SELECT cycle % 4 AS part, max(cycle) AS cycle FROM g WHERE unfinished = 0 AND cycle NOT IN (SELECT cycle FROM miss) GROUP BY 1)
SELECT CAST(part AS VARCHAR) AS part, cycle, capped = 0 AS ok, CASE WHEN capped = 0 THEN 'published' ELSE 'capped' END AS outcome,
  (SELECT CAST(sum(features) AS BIGINT) FROM st WHERE st.cycle = passed.cycle AND NOT failed) AS records
FROM passed JOIN g USING (cycle)"""

# --- related events -----------------------------------------------------------------------

ORACLE["related_events"] = f"""
WITH {EV}, p AS (SELECT event_id AS id, ms, radians(lon) AS x, radians(lat) AS y FROM ev WHERE event_type <> 'view' AND {VALID}),
m AS (SELECT a.id AS a, b.id AS b, b.ms - a.ms AS dt_ms,
    2 * CAST(6371.0088 AS DOUBLE) * asin(sqrt(least(1, sin((b.y - a.y) / 2) ** 2 + cos(a.y) * cos(b.y) * sin((b.x - a.x) / 2) ** 2))) AS km
  FROM p a JOIN p b ON b.ms >= a.ms AND b.ms < a.ms + {HOUR} WHERE b.ms > a.ms OR a.id < b.id)
SELECT a, b, round(km, 6) AS km, dt_ms FROM m WHERE km < 300"""

# --- rates --------------------------------------------------------------------------------

ORACLE["rate_stats"] = f"""
WITH {EV}, s AS (SELECT user_id, ms, value AS dt, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n
  FROM ev WHERE ms BETWEEN {FIRST} AND {LAST}),
w AS (SELECT user_id, ms, min(ms) OVER t AS start, count(*) OVER t AS c FROM s
  WINDOW t AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW)),
low AS (SELECT user_id, min((c - 1) / CAST(ms - start AS DOUBLE) * 1000.0) AS rate FROM w WHERE ms - start >= 138240000 GROUP BY user_id),
q AS (SELECT user_id, any_value(n) AS n, max(dt) FILTER (r = n // 2) AS med, max(dt) FILTER (r = least(n - 1, CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT))) AS p95 FROM s GROUP BY user_id)
SELECT user_id, n AS samples, round(CASE WHEN n < 2 THEN 0 ELSE coalesce(rate, 1000.0 / med) END * 86400, 6) AS min_per_day,
  round(CASE WHEN n < 2 THEN 0 ELSE 1000.0 / med END, 6) AS median_rate, CASE WHEN n < 2 THEN 0 ELSE p95 END AS p95_dt FROM q LEFT JOIN low USING (user_id)"""
ORACLE["rate_drops"] = f"""
WITH {EV} SELECT user_id, i AS tick, count(*) AS drops FROM ev JOIN range(28) r(i)
ON ms BETWEEN {FIRST} + i * {DAY} AND {FIRST} + i * {DAY} + {2 * DAY} WHERE value > 60 GROUP BY 1, 2"""
ORACLE["token_bucket"] = f"""
WITH RECURSIVE {EV}, q AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM ev),
run AS (
  SELECT user_id, n, ms, CAST(2 AS DOUBLE) AS tokens, 1 AS ok FROM q WHERE n = 1
  UNION ALL
  SELECT q.user_id, q.n, q.ms, CASE WHEN x >= 1 THEN x - 1 ELSE x END, CASE WHEN x >= 1 THEN 1 ELSE 0 END
  FROM run JOIN q ON q.user_id = run.user_id AND q.n = run.n + 1,
    LATERAL (SELECT least(CAST(3 AS DOUBLE), run.tokens + (q.ms - run.ms) / CAST({12 * HOUR} AS DOUBLE)) AS x) l)
SELECT user_id, count(*) AS requests, CAST(sum(ok) AS BIGINT) AS accepted FROM run GROUP BY user_id"""

# --- links --------------------------------------------------------------------------------

LINKS = f"""{EV}, lk AS (
  SELECT 'e' || event_id AS link_id, least(90, lat) AS lat, lon AS lng,
    CASE WHEN event_id % 5 = 1 THEN least(22, CAST(event_id % 30 AS DOUBLE)) ELSE CAST(1.8 AS DOUBLE) END AS z,
    CASE WHEN event_id % 4 = 0 THEN ms END AS t,
    CASE event_id % 3 WHEN 0 THEN 'earthquake,news' WHEN 1 THEN '' ELSE 'earthquake,weather,flight,news' END AS layers,
    CASE WHEN event_id % 2 = 0 THEN 'usgs:' || event_id END AS sel, event_id % 6 = 0 AS play,
    CASE WHEN event_id % 7 = 0 THEN CAST(10 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS rate FROM ev
  UNION ALL SELECT 'p' || page_id, 20, 0, CAST(1.8 AS DOUBLE), NULL, 'earthquake,weather,flight,news', NULL, FALSE, 1 FROM pages)"""
ORACLE["link_state"] = f"WITH {LINKS} SELECT link_id, lat, lng, z, t, layers, sel, play, rate FROM lk"
ORACLE["link_write"] = f"""
WITH {LINKS} SELECT link_id, concat_ws('&', CASE WHEN lat <> 20 THEN 'lat=' || ({num('lat')}) END, CASE WHEN lng <> 0 THEN 'lng=' || ({num('lng')}) END,
  CASE WHEN z <> CAST(1.8 AS DOUBLE) THEN 'z=' || ({num('z')}) END, CASE WHEN t IS NOT NULL THEN 't=' || t END,
  CASE layers WHEN '' THEN 'l=' WHEN 'earthquake,news' THEN 'l=eq%2Cnw' END, CASE WHEN sel IS NOT NULL THEN replace('sel=' || sel, ':', '%3A') END,
  CASE WHEN play THEN 'play=1' END, CASE WHEN rate <> 1 THEN 'rate=' || ({num('rate')}) END) AS query FROM lk"""

# --- streams ------------------------------------------------------------------------------

ORACLE["bucket_dedupe"] = f"""
SELECT user_id AS entity_id, {slot(21600)} AS bucket, max(event_id) AS arrival_seq FROM events GROUP BY 1, 2"""
ORACLE["slot_tumbling_stream"] = f"SELECT {slot(900)} AS slot, count(*) AS records, max(value) AS max_value FROM events GROUP BY 1"
ORACLE["vacuumed_slots"] = f"SELECT slot, records, revisions, records AS stored FROM ({ORACLE['slot_publish']})"
ORACLE["pinned_snapshot"] = ORACLE["slot_known_at"]
CLOCKS = ", ".join(f"({FIRST + i * 41 * HOUR + i * 7 * 60000})" for i in range(16))
ORACLE["freshness_stream"] = f"""
WITH clocks AS (SELECT CAST(c AS BIGINT) AS clock_ms FROM (VALUES {CLOCKS}) v(c)), pl AS (
  SELECT clock_ms, event_type AS layer, ts, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) - event_id % 7 * 60000 AS as_of,
    CASE event_id % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'schema_error' WHEN 2 THEN 'same' WHEN 3 THEN 'same' ELSE 'ok' END AS o
  FROM events JOIN clocks ON epoch_us(ts) // 1000 <= clock_ms),
sm AS (SELECT clock_ms, layer, max(ts) FILTER (o = 'ok') AS ok_at, max_by(as_of, (ts, as_of)) FILTER (o = 'ok') AS as_of_ms,
  max(ms) FILTER (o IN ('ok', 'same')) AS last_ms, max(ts) FILTER (o = 'schema_error') AS sch_at FROM pl GROUP BY ALL),
st AS (SELECT *, CASE layer WHEN 'click' THEN 360000 WHEN 'error' THEN 1200000 WHEN 'purchase' THEN 7200000 WHEN 'signup' THEN 1800000 ELSE 360000 END AS lim,
  CASE WHEN layer IN ('click', 'purchase') THEN last_ms ELSE as_of_ms END AS basis FROM sm)
SELECT clock_ms, layer, CASE WHEN sch_at IS NOT NULL AND coalesce(sch_at > ok_at, TRUE) THEN 'error' WHEN last_ms IS NULL THEN 'error'
  WHEN clock_ms - basis > lim THEN 'stale' ELSE 'ready' END AS status FROM st"""
ORACLE["arrival_stream"] = f"""
WITH s AS (SELECT DISTINCT event_type AS layer, CAST(user_id AS VARCHAR) AS id, ((epoch_us(ts) // 1000) - {FIRST - DAY}) // {6 * HOUR} AS snapshot FROM events),
p AS (SELECT *, lag(snapshot) OVER (PARTITION BY layer, id ORDER BY snapshot) AS before FROM s),
n AS (SELECT layer, id, CAST({FIRST - DAY} + snapshot * {6 * HOUR} AS BIGINT) AS arrived_ms FROM p WHERE snapshot > 0 AND (before IS NULL OR before < snapshot - 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY arrived_ms DESC, id) AS place FROM n)
SELECT layer, id, arrived_ms FROM r WHERE place <= CASE layer WHEN 'click' THEN 100 ELSE 50 END
  AND (layer <> 'click' OR {LAST} - arrived_ms < {36 * HOUR})"""
TN = T + 700000
ORACLE["world_state_four"] = f"""
WITH {WORLD.replace(str(T - DAY), str(TN - DAY)).replace(str(T), str(TN))}, files AS (
  SELECT event_id AS id, ({slot(900)} + 900) * 1000 AS at_ms FROM events WHERE ({slot(900)} + 600) * 1000 <= {TN}),
newest AS (SELECT greatest({TN}, max(at_ms)) AS t FROM files)
SELECT layer, id, at_ms, stale FROM world
UNION ALL SELECT 'news', id, at_ms, FALSE FROM files, newest WHERE at_ms BETWEEN t - {2 * HOUR} AND t"""
ORACLE["ledger_attempts"] = f"""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'degraded' WHEN event_id % 7 = 0 THEN 'empty'
    WHEN event_id % 3 > 0 THEN 'partial' ELSE 'ok' END AS outcome,
  row_number() OVER (PARTITION BY event_type, {slot(86400)} ORDER BY event_id % 2, event_id) - 1 AS attempt FROM events"""
ORACLE["latest_document"] = """
WITH p AS (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'flight:' || event_type ELSE event_type END AS part, count(*) AS n,
    date_trunc('day', max(ts)) AS up FROM events GROUP BY 1),
b AS (SELECT *, CASE part WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'flight:purchase' THEN 2 WHEN 'flight:signup' THEN 3 ELSE 4 END AS i FROM p),
d AS (SELECT k, '{"updatedAt":"' || strftime(max(up), '%Y-%m-%dT%H:%M:%S') || '.000Z",' || CASE k WHEN 0 THEN '"partial":["click"],' ELSE '' END || '"layers":{' ||
    string_agg('"' || part || '":{"records":' || n || '}', ',' ORDER BY i) FILTER (part NOT LIKE 'flight:%') || ',"flight":{"regions":{' ||
    string_agg('"' || part[8:] || '":{"records":' || n || '}', ',' ORDER BY i) FILTER (part LIKE 'flight:%') || '}}}}' AS document
  FROM b, range(2) r(k) WHERE k = 1 OR part <> 'click' GROUP BY k)
SELECT r.k AS round, r.k IN (0, 3) AS published, CASE WHEN r.k = 3 THEN 1 ELSE 0 END AS number, document
FROM range(4) r(k) JOIN d ON d.k = CASE WHEN r.k = 3 THEN 1 ELSE 0 END"""
ORACLE["canonical_order"] = """
SELECT 'all' AS id, 0 AS files, CAST(NULL AS DOUBLE) AS value, TRUE AS sorted
UNION ALL SELECT 'e' || event_id, 1, value, TRUE FROM events WHERE event_id IN (0, 1234, 77, 5)"""
ORACLE["bounded_slot_stream"] = f"""
WITH c AS (SELECT {slot(900)} AS slot, CAST(floor((floor((epoch_us(ts) // 1000) / 1000) + event_id % 4 * 900) / 900) * 900 AS BIGINT) AS landed FROM events)
SELECT 'slots' AS kind, slot, count(*) AS records FROM c WHERE slot >= landed - 900 GROUP BY slot
UNION ALL SELECT 'late', landed, count(*) FROM c WHERE slot < landed - 900 GROUP BY landed"""
ORACLE["alert_pages"] = """
WITH d AS (SELECT event_id // 100 AS doc, count(*) AS n, count(*) FILTER (event_id % 5 < 2) AS cur FROM events GROUP BY 1)
SELECT doc // 24 AS cycle, CASE doc % 3 WHEN 0 THEN 'Green' WHEN 1 THEN 'Orange' ELSE 'Red' END AS level, doc // 3 % 8 + 1 AS page,
  CASE WHEN doc % 19 = 7 THEN 0 ELSE n END AS features, CASE WHEN doc % 19 = 7 THEN 0 ELSE cur END AS current, doc % 19 = 7 AS failed FROM d"""
ORACLE["slot_manifest"] = f"""
WITH {SIDES}, s AS (SELECT slot, count(*) AS n FROM stored GROUP BY 1), m AS (SELECT slot, count(*) AS n FROM merged GROUP BY 1),
i AS (SELECT slot, count(*) AS n FROM incoming GROUP BY 1)
SELECT slot, 0 AS generation, n AS records, n AS incoming, 0 AS dropped FROM s
UNION ALL SELECT slot, CASE WHEN slot IN (SELECT slot FROM s) THEN 1 ELSE 0 END, m.n, i.n, 0 FROM m JOIN i USING (slot)
  WHERE slot IN (SELECT slot FROM diff)"""
ORACLE["pointer_shard"] = f"""
WITH {SIDES} SELECT slot, CASE WHEN slot IN (SELECT slot FROM diff) AND slot IN (SELECT slot FROM stored) THEN 1 ELSE 0 END AS generation,
  count(*) AS records FROM merged WHERE slot = 1704758400 GROUP BY slot"""
ORACLE["budget_unknown"] = """
WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 500 = 499 AND day(ts) % 3 = 0 THEN NULL ELSE event_id % 500 END AS n FROM events)
SELECT date, CAST(sum(n) AS BIGINT) AS requests, CASE WHEN count(*) > count(n) THEN 'unchanged' WHEN sum(n) > 80000 THEN 'relaxed' ELSE 'cleared' END AS state FROM r GROUP BY 1"""
