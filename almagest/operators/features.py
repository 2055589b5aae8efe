"""Lines and areas of records as drawable features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.functions.geo import (
    angular_distance,
    hatch,
    unit_vector,
    unwrap_line,
    unwrap_near,
    unwrap_rings,
    vector_position,
)
from almagest.functions.scalars import clamp, epoch_ms, slot_of_seconds
from almagest.operators.keys import first_per_key, unnest
from almagest.schema import BUCKET_SEC, EARTH_KM


def alert_features(records: DataFrame) -> DataFrame:
    """One row per track, cone part and hatch segment: (id, rank, kind, part, line, rings).

    Points give nothing. Rings are unwrapped before hatching; otherwise a cone across
    the antimeridian would look 340 degrees wide and lose its hatch.
    """
    geometry = F.col("geometry")
    parts = F.when(geometry["type"] == "Polygon", F.array(geometry["polygon"])).when(
        geometry["type"] == "MultiPolygon", geometry["multi"]
    )
    base = records.select("id", F.col("severity.rank").alias("rank"), "geometry")
    tracks = base.where(geometry["type"] == "LineString").select(
        "id", "rank", F.lit("track").alias("kind"), F.lit(0).alias("part"),
        unwrap_line(geometry["line"]).alias("line"),
        F.lit(None).cast("array<array<array<double>>>").alias("rings"),
    )
    areas = unnest(
        base.where(geometry["type"].isin("Polygon", "MultiPolygon")), parts, ["id", "rank"], "part", "raw"
    ).select("id", "rank", "part", unwrap_rings(F.col("raw")).alias("rings"))
    drawn = F.concat(
        F.array(
            F.struct(
                F.lit("cone").alias("kind"),
                F.lit(None).cast("array<array<double>>").alias("line"),
                F.col("rings").alias("rings"),
            )
        ),
        F.transform(
            hatch(F.col("rings")),
            lambda s: F.struct(
                F.lit("hatch").alias("kind"),
                F.array(F.array(s["lon0"], s["lat0"]), F.array(s["lon1"], s["lat1"])).alias("line"),
                F.lit(None).cast("array<array<array<double>>>").alias("rings"),
            ),
        ),
    )
    filled = unnest(areas, drawn, ["id", "rank", "part"], "n", "f").select(
        "id", "rank", "f.kind", "part", "f.line", "f.rings"
    )
    return tracks.unionByName(filled)


def bucket_samples(
    samples: DataFrame, entity: str = "entity_id", at: str = "sampled_at", seq: str = "arrival_seq",
    width_sec: int = BUCKET_SEC,
) -> DataFrame:
    """One sample per entity and identity bucket; the last arrival wins."""
    bucket = slot_of_seconds(F.unix_seconds(F.col(at).cast("timestamp")), width_sec)
    return first_per_key(samples.withColumn("bucket", bucket), [entity, "bucket"], [F.col(seq).desc()])


def track_view(
    samples: DataFrame, entity: str = "entity_id", at: str = "sampled_at", seq: str = "arrival_seq",
    span_sec: int = 86_400, width_sec: int = BUCKET_SEC,
) -> DataFrame:
    """Observations folded into ordered lines, one per entity and time span.

    After bucketing a span holds at most span / width samples (480 a day), so the list
    that is collected has a fixed bound however many samples an entity has.
    """
    one = bucket_samples(samples, entity, at, seq, width_sec).select(
        entity,
        slot_of_seconds(F.col("bucket"), span_sec).alias("span"),
        F.struct(epoch_ms(at).alias("ms"), F.col(seq).alias("seq"), "lon", "lat").alias("p"),
    )
    return (
        one.groupBy(entity, "span")
        .agg(F.array_sort(F.collect_list("p")).alias("samples"))
        .withColumn("line", F.transform("samples", lambda p: F.array(p["lon"], p["lat"])))
    )


def points_of(lines: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """One row per vertex: keys, pos, lon, lat."""
    return unnest(lines, line, keys, "pos", "p").select(
        *keys, "pos", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat")
    )


def unwrapped_points(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    return points_of(lines, keys, unwrap_line(F.col(line)))


def densify(lines: DataFrame, keys: list[str], step_deg: float, line: str = "line") -> DataFrame:
    """Split every leg along its great circle into steps of at most step_deg.

    Returns keys, leg, step, lon, lat. Leg 0 step 0 is the first vertex. Each leg is
    interpolated on its own: the start of a leg is already unwrapped, and no point of a
    leg is more than half a turn from its start.
    """
    flat = unwrap_line(F.col(line))
    legs = F.transform(
        F.sequence(F.lit(1), F.size("__flat") - 1),
        lambda i: F.struct(
            i.alias("leg"),
            F.get("__flat", i - 1).alias("a"),
            F.get("__flat", i).alias("b"),
        ),
    )
    first = F.array(
        F.struct(F.lit(0).alias("leg"), F.get("__flat", F.lit(0)).alias("a"), F.get("__flat", F.lit(0)).alias("b"))
    )
    # A line of n vertices has n - 1 legs; the first vertex is added as leg 0.
    cut = (
        lines.withColumn("__flat", flat)
        .where(F.size(line) > 0)
        .withColumn("__legs", F.when(F.size("__flat") > 1, F.concat(first, legs)).otherwise(first))
        .select(*keys, F.explode_outer("__legs").alias("l"))
        .select(
            *keys, "l.leg",
            F.get("l.a", F.lit(0)).alias("lon_a"), F.get("l.a", F.lit(1)).alias("lat_a"),
            F.get("l.b", F.lit(0)).alias("lon_b"), F.get("l.b", F.lit(1)).alias("lat_b"),
        )
    )
    # Everything that belongs to a leg is computed before the leg is split into steps.
    va = unit_vector(F.col("lon_a"), F.col("lat_a"))
    vb = unit_vector(F.col("lon_b"), F.col("lat_b"))
    ends = {f"a{i}": v for i, v in enumerate(va)} | {f"b{i}": v for i, v in enumerate(vb)}
    leg = cut.withColumns(ends)
    angle = F.acos(clamp(F.col("a0") * F.col("b0") + F.col("a1") * F.col("b1") + F.col("a2") * F.col("b2"), -1, 1))
    leg = leg.withColumn("angle", angle).withColumns(
        {
            "sine": F.sin("angle"),
            "steps": F.greatest(F.lit(1), F.ceil(F.degrees("angle") / step_deg).cast("int")),
        }
    )
    numbers = F.when(F.col("leg") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("steps")))
    step = leg.withColumn("step", F.explode_outer(numbers)).withColumn("t", F.col("step") / F.col("steps"))
    step = step.withColumns(
        {
            "k0": F.try_divide(F.sin((1 - F.col("t")) * F.col("angle")), F.col("sine")),
            "k1": F.try_divide(F.sin(F.col("t") * F.col("angle")), F.col("sine")),
        }
    )
    short = F.col("angle") < 1e-9
    step = step.withColumns(
        {
            f"p{i}": F.when(short, F.col(f"b{i}")).otherwise(F.col(f"a{i}") * F.col("k0") + F.col(f"b{i}") * F.col("k1"))
            for i in range(3)
        }
    )
    lon, lat = vector_position(F.col("p0"), F.col("p1"), F.col("p2"))
    # Rounding to 1e-9 degree keeps the last bits of the trigonometry from deciding
    # which way a leg over a pole is unwrapped.
    step = step.withColumns({"lon": F.floor(lon * 1e9 + 0.5) / 1e9, "lat": lat})
    is_first = F.col("leg") == 0
    return step.select(
        *keys, "leg", "step",
        F.when(is_first, F.col("lon_a")).otherwise(unwrap_near(F.col("lon"), F.col("lon_a"))).alias("lon"),
        F.when(is_first, F.col("lat_a")).otherwise(F.col("lat")).alias("lat"),
    )


def distance_to(df: DataFrame, lon: float, lat: float) -> DataFrame:
    """Great-circle angle from every record to one position."""
    return df.withColumn("angle_deg", angular_distance(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)))


def kept_points(lon: np.ndarray, lat: np.ndarray, tolerance_km: float) -> np.ndarray:
    """Positions of the points to keep so that every dropped one is within the tolerance.

    The farthest point of a stretch is kept while it lies farther from the great circle
    segment between the stretch's ends than the tolerance (Douglas and Peucker), with an
    explicit list of stretches instead of recursion.
    """
    n = len(lon)
    x, y = np.radians(lon), np.radians(lat)
    v = np.column_stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])
    keep = np.zeros(n, dtype=bool)
    keep[[0, n - 1]] = True
    open_ = [(0, n - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        d = segment_angle(v[a + 1 : b], v[a], v[b])
        far = int(d.argmax())
        if d[far] * EARTH_KM > tolerance_km:
            keep[a + 1 + far] = True
            open_ += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.flatnonzero(keep)


def segment_angle(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between unit vectors p and the great circle segment from a to b."""

    def angle(u: np.ndarray) -> np.ndarray:
        return 2 * np.arcsin(np.minimum(np.linalg.norm(p - u, axis=1) / 2, 1.0))

    ends = np.minimum(angle(a), angle(b))
    normal = np.cross(a, b)
    size = np.linalg.norm(normal)
    if size < 1e-12:  # no length, or half the globe
        return ends
    normal /= size
    inside = (np.cross(normal, a) @ p.T > 0) & (np.cross(b, normal) @ p.T > 0)
    return np.where(inside, np.arcsin(np.minimum(np.abs(p @ normal), 1.0)), ends)


def simplify_tracks(tracks: DataFrame, keys: list[str], tolerance_km: float, samples: str = "samples") -> DataFrame:
    """Lines with as few points as an error bound allows: keys, points, kept (positions), line.

    `samples` is an array of structs with lon and lat, as `track_view` makes it: one time
    chunk of an entity, of bounded length. The ends of a chunk are always kept, so the chunks
    of a track join as before and the bound holds for the whole of it.
    """
    lists = tracks.where(F.size(samples) > 0).select(
        F.struct(*keys).alias("key"), F.transform(samples, lambda p: p["lon"]).alias("lon"), F.transform(samples, lambda p: p["lat"]).alias("lat")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [kept_points(np.array(x), np.array(y), tolerance_km).tolist() for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.list_(pa.int32()))], names=["key", "lon", "lat", "kept"])

    schema = T.StructType([*lists.schema.fields, T.StructField("kept", T.ArrayType(T.IntegerType()))])
    line = F.transform("kept", lambda i: F.array(F.get("lon", i), F.get("lat", i)))
    return lists.mapInArrow(run, schema).select("key.*", F.size("lon").alias("points"), "kept", line.alias("line"))
