"""Spherical and planar geometry on columns.

Lines and rings are arrays inside a row, as a record carries them, so these
functions are narrow: no row leaves its partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from almagest.functions.scalars import clamp, col

# --- fixed values -----------------------------------------------------------------
MEAN_LON_EPS = 1e-9
HATCH_LINES = 12
DEAD_RECKON_LAT_LIMIT = 85.0
DEAD_RECKON_MIN_COS = 0.2

UNWRAP_CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so that it is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- points -------------------------------------------------------------------------


def valid_lon_lat(lon: Column | str, lat: Column | str) -> Column:
    """Finite, on the globe, and not exactly (0, 0); a single zero axis is fine."""
    lon, lat = col(lon), col(lat)
    ok = (
        ~F.isnan(lon)
        & ~F.isnan(lat)
        & lon.between(-180.0, 180.0)
        & lat.between(-90.0, 90.0)
        & ~((lon == 0.0) & (lat == 0.0))
    )
    return F.coalesce(ok, F.lit(False))


def valid_position(pos: Column) -> Column:
    """valid_lon_lat of a [lon, lat, ...] array.

    The argument is bound to a lambda variable, so a costly expression is evaluated once
    even where the optimizer moves the test into a filter.
    """
    return F.coalesce(
        F.exists(F.array(pos), lambda p: valid_lon_lat(F.get(p, F.lit(0)), F.get(p, F.lit(1)))), F.lit(False)
    )


def angular_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle angle in degrees by the spherical law of cosines."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(F.radians(lon2) - F.radians(lon1))
    return F.degrees(F.acos(clamp(cosine, -1, 1)))


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)


def vector_position(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(clamp(z, -1, 1)))


def wrap_lon(lon: Column) -> Column:
    """Longitude folded into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def dead_reckon(lon: Column, lat: Column, heading: Column, distance: Column) -> tuple[Column, Column]:
    """Position after moving `distance` degrees along `heading`."""
    rad = F.radians(heading)
    new_lat = clamp(lat + F.cos(rad) * distance, -DEAD_RECKON_LAT_LIMIT, DEAD_RECKON_LAT_LIMIT)
    widen = F.greatest(F.lit(DEAD_RECKON_MIN_COS), F.cos(F.radians(new_lat)))
    return wrap_lon(lon + F.sin(rad) * distance / widen), new_lat


# --- lines and rings ---------------------------------------------------------------


def unwrap_near(lon: Column, ref: Column) -> Column:
    """Shift by whole turns until within 180 degrees of ref; exactly 180 stays."""
    gap = lon - ref
    return (
        F.when(gap > 180.0, lon - F.ceil((gap - 180.0) / 360.0) * 360.0)
        .when(gap < -180.0, lon + F.ceil((-gap - 180.0) / 360.0) * 360.0)
        .otherwise(lon)
    )


def unwrap_line(line: Column, anchor: Column | None = None) -> Column:
    """Make a line continuous across the antimeridian.

    Every point is placed next to its already shifted predecessor; the first one
    next to the anchor when there is one.
    """
    start = F.lit(None).cast("double") if anchor is None else anchor
    empty = F.array().cast("array<array<double>>")

    def step(acc: Column, p: Column) -> Column:
        return let(
            F.coalesce(unwrap_near(p[0], acc["prev"]), p[0]),
            lambda x: F.struct(x.alias("prev"), F.concat(acc["out"], F.array(F.array(x, p[1]))).alias("out")),
        )

    def fold(points: Column, prev: Column) -> Column:
        return F.aggregate(points, F.struct(prev.alias("prev"), empty.alias("out")), step)

    def chunk(acc: Column, at: Column) -> Column:
        return let(
            fold(F.slice(line, at, UNWRAP_CHUNK), acc["prev"]),
            lambda part: F.struct(part["prev"].alias("prev"), F.concat(acc["out"], part["out"]).alias("out")),
        )

    # A fold copies what it has built at every step, so it works on short chunks, and
    # only whole chunks are appended to the long result.
    starts = F.sequence(F.lit(1), F.size(line), F.lit(UNWRAP_CHUNK))
    whole = F.aggregate(starts, F.struct(start.alias("prev"), empty.alias("out")), chunk, lambda acc: acc["out"])
    return F.when(F.size(line) > 0, whole).otherwise(line)


def unwrap_rings(rings: Column) -> Column:
    """Unwrap the outer ring on its own and every hole next to the outer ring's first point."""

    def with_holes(outer: Column) -> Column:
        anchor = F.get(F.get(outer, F.lit(0)), F.lit(0))
        holes = F.transform(F.slice(rings, 2, F.size(rings) - 1), lambda r: unwrap_line(r, anchor))
        return F.concat(F.array(outer), holes)

    return F.when(F.size(rings) > 0, let(unwrap_line(rings[0]), with_holes)).otherwise(rings)


def ring_centroid(ring: Column) -> Column:
    """Mean position of a closed ring as struct(lon, lat), null when there is none.

    The closing vertex is left out and so is every vertex without numbers. Longitude
    is the direction of the summed unit vectors, so a ring across the antimeridian
    keeps its place; opposite vertices cancel and then the first vertex decides.
    """
    zero = F.lit(0.0)

    def mean(pts: Column) -> Column:
        return F.aggregate(
            pts,
            F.struct(zero.alias("x"), zero.alias("y"), zero.alias("lat")),
            lambda a, p: F.struct(
                (a["x"] + F.cos(F.radians(p[0]))).alias("x"),
                (a["y"] + F.sin(F.radians(p[0]))).alias("y"),
                (a["lat"] + p[1]).alias("lat"),
            ),
            lambda a: F.struct(
                F.when(F.hypot(a["x"], a["y"]) < MEAN_LON_EPS, F.get(F.get(pts, F.lit(0)), F.lit(0)))
                .otherwise(F.degrees(F.atan2(a["y"], a["x"])))
                .alias("lon"),
                F.try_divide(a["lat"], F.size(pts)).alias("lat"),
            ),
        )

    def vertices(r: Column) -> Column:
        open_ring = F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))
        return F.filter(open_ring, lambda p: F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())

    def checked(m: Column) -> Column:
        return F.when(valid_lon_lat(m["lon"], m["lat"]), m)

    return let(
        ring,
        lambda r: F.when(
            F.size(r) >= 3, let(vertices(r), lambda pts: F.when(F.size(pts) > 0, let(mean(pts), checked)))
        ),
    )


def valid_ring(ring: Column) -> Column:
    """The ring's valid vertices; null when fewer than three remain."""
    kept = F.transform(
        F.filter(ring, lambda p: valid_lon_lat(F.get(p, F.lit(0)), F.get(p, F.lit(1)))),
        lambda p: F.array(p[0], p[1]),
    )
    return let(kept, lambda k: F.when(F.size(k) >= 3, k))


def hatch(rings: Column, max_segments: int | None = None, span_limit: float | None = None) -> Column:
    """Clip a family of 45-degree lines to a polygon.

    All segments are returned; a renderer's limits apply only where the caller sets them.

    In u = lat - lon and v = lat + lon the lines are u = const, so each is a
    scanline: its crossings with the edges are sorted by v and paired, which cuts
    holes out by itself. Returns an array of struct(line, lon0, lat0, lon1, lat1).
    """
    nothing = F.array().cast("array<struct<line:int,lon0:double,lat0:double,lon1:double,lat1:double>>")

    def edge(ring: Column, p: Column, i: Column) -> Column:
        return let(
            ring[(i + 1) % F.size(ring)],
            lambda q: F.struct(
                (p[1] - p[0]).alias("ua"),
                (p[1] + p[0]).alias("va"),
                (q[1] - q[0]).alias("ub"),
                (q[1] + q[0]).alias("vb"),
            ),
        )

    def crossings(fr: Column, u: Column) -> Column:
        hit = F.filter(
            fr["edges"],
            lambda e: (u >= F.least(e["ua"], e["ub"])) & (u < F.greatest(e["ua"], e["ub"])),
        )
        return F.array_sort(
            F.transform(hit, lambda e: e["va"] + (u - e["ua"]) / (e["ub"] - e["ua"]) * (e["vb"] - e["va"]))
        )

    def pairs(line: Column, u: Column, v: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")
        starts = F.when(half > 0, F.sequence(F.lit(0), half - 1)).otherwise(F.array().cast("array<int>"))
        real = F.filter(starts, lambda j: v[j * 2 + 1] - v[j * 2] > 0)
        return F.transform(
            real,
            lambda j: F.struct(
                line.alias("line"),
                ((v[j * 2] - u) / 2).alias("lon0"),
                ((v[j * 2] + u) / 2).alias("lat0"),
                ((v[j * 2 + 1] - u) / 2).alias("lon1"),
                ((v[j * 2 + 1] + u) / 2).alias("lat1"),
            ),
        )

    def scan(fr: Column) -> Column:
        lines = F.transform(
            F.sequence(F.lit(1), F.lit(HATCH_LINES)),
            lambda k: F.struct(k.alias("k"), (fr["low"] + fr["spacing"] * k).alias("u")),
        )
        crossed = F.transform(
            lines, lambda s: F.struct(s["k"].alias("k"), s["u"].alias("u"), crossings(fr, s["u"]).alias("v"))
        )
        return F.flatten(F.transform(crossed, lambda c: pairs(c["k"], c["u"], c["v"])))

    def clip(usable: Column, b: Column) -> Column:
        drawable = b["u_max"] > b["u_min"]
        if span_limit is not None:
            drawable = drawable & (b["lon_span"] <= span_limit) & (b["lat_span"] <= span_limit)
        edges = F.flatten(F.transform(usable, lambda r: F.transform(r, lambda p, i: edge(r, p, i))))
        frame = F.struct(
            b["u_min"].alias("low"),
            ((b["u_max"] - b["u_min"]) / float(HATCH_LINES + 1)).alias("spacing"),
            edges.alias("edges"),
        )
        segments = let(frame, scan)
        return F.when(drawable, segments if max_segments is None else F.slice(segments, 1, max_segments))

    usable_rings = F.filter(rings, lambda r: F.size(r) >= 3)
    clipped = let(usable_rings, lambda u: let(_bounds(F.flatten(u)), lambda b: clip(u, b)))
    return F.coalesce(clipped, nothing)


def _bounds(vertices: Column) -> Column:
    def of(v: Column) -> Column:
        u = F.transform(v, lambda p: p[1] - p[0])
        lon = F.transform(v, lambda p: p[0])
        lat = F.transform(v, lambda p: p[1])
        return F.struct(
            F.array_min(u).alias("u_min"),
            F.array_max(u).alias("u_max"),
            (F.array_max(lon) - F.array_min(lon)).alias("lon_span"),
            (F.array_max(lat) - F.array_min(lat)).alias("lat_span"),
        )

    return let(vertices, of)


def ring_bounds(rings: Column) -> Column:
    """struct(u_min, u_max, lon_span, lat_span) over all usable rings."""
    return _bounds(F.flatten(F.filter(rings, lambda r: F.size(r) >= 3)))
