"""Rates over (key, time) tables: sliding windows, order statistics, token buckets."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from almagest.operators.keys import numbered


# --- sliding rate -------------------------------------------------------------------


def min_window_rate(samples: DataFrame, key: str, window_ms: int, min_span_ms: int, chunk_ms: int) -> DataFrame:
    """Lowest rate over trailing windows, per key: (samples - 1) / span, per second.

    Samples of the same millisecond are merged first. Time is cut into chunks, and the
    last `window_ms` of a chunk is repeated at the start of the next, so every window
    is whole inside one chunk and a busy key runs on many tasks.
    """
    assert chunk_ms >= window_ms
    merged = samples.groupBy(key, "ms").agg(F.count(F.lit(1)).alias("n"))
    own = F.floor(F.col("ms") / chunk_ms)
    reach = F.floor((F.col("ms") + window_ms) / chunk_ms)
    haloed = merged.withColumn("own", own).withColumn(
        "chunk", F.explode_outer(F.when(reach > own, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    trailing = Window.partitionBy(key, "chunk").orderBy("ms")
    before = F.coalesce(F.sum("n").over(trailing.rangeBetween(-window_ms, -1)), F.lit(0))
    start = F.min("ms").over(trailing.rangeBetween(-window_ms, 0))
    span = F.col("ms") - F.col("start")
    return (
        haloed.withColumns({"before": before, "start": start})
        .where((F.col("chunk") == F.col("own")) & (span >= min_span_ms))
        .groupBy(key)
        .agg(F.min(F.col("before") / span * 1000.0).alias("min_rate"))
    )


def order_statistics(df: DataFrame, key: str, value: str, ranks: dict[str, Column], bucket_width: float) -> DataFrame:
    """Exact n-th smallest values per key; `ranks` are 0-based, in terms of the count `n`.

    First values are counted per coarse bucket to find the bucket a rank falls in; then
    only that bucket's rows are looked at. No task ever holds all values of a key.
    """
    bucket = F.floor(F.col(value) / bucket_width).cast("bigint")
    counts = df.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(key)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), r.cast("bigint").alias("rank")) for k, r in ranks.items()]))
    located = (
        counts.withColumns({"below": F.coalesce(F.sum("c").over(upto), F.lit(0)), "n": F.sum("c").over(total)})
        .withColumn("w", wanted)
        .where((F.col("w.rank") >= F.col("below")) & (F.col("w.rank") < F.col("below") + F.col("c")))
        .select(key, "bucket", "n", "w.stat", (F.col("w.rank") - F.col("below")).alias("rest"))
    )
    upto_value = Window.partitionBy(key, "stat").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        df.select(key, bucket.alias("bucket"), F.col(value).alias("v"))
        .join(located, [key, "bucket"])
        .groupBy(key, "stat", "n", "rest", "v")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("seen", F.sum("c").over(upto_value))
    )
    hit = inside.where((F.col("rest") < F.col("seen")) & (F.col("rest") >= F.col("seen") - F.col("c")))
    return hit.groupBy(key).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("stat") == k, F.col("v"))).alias(k) for k in ranks]
    )


def rate_stats(
    samples: DataFrame, key: str, from_ms: int, to_ms: int, warmup_ms: int = 1_000, window_ms: int = 1_000,
    min_span_ms: int = 800, chunk_ms: int = 60_000, bucket_width: float = 1.0,
) -> DataFrame:
    """Per key: sample count, lowest window rate, median rate and 95th percentile gap.

    `samples` has key, ms and dt (gap before the sample). The first `warmup_ms` are cut.
    Fewer than two samples give zeros; without any window of enough span the median
    rate stands in for the lowest rate.
    """
    used = samples.where(F.col("ms").between(from_ms + warmup_ms, to_ms))
    n = F.col("n")
    stats = order_statistics(
        used, key, "dt",
        {"median_dt": F.floor(n / 2), "p95_dt": F.least(n - 1, F.floor(n * 0.95))},
        bucket_width,
    )
    slow = min_window_rate(used, key, window_ms, min_span_ms, chunk_ms)
    median_rate = F.try_divide(F.lit(1000.0), F.col("median_dt"))
    few = n < 2
    zero = F.lit(0.0)
    return stats.join(slow, key, "left").select(
        key,
        n.alias("samples"),
        F.when(few, zero).otherwise(F.coalesce("min_rate", median_rate)).alias("min_rate"),
        F.when(few, zero).otherwise(median_rate).alias("median_rate"),
        F.when(few, zero).otherwise(F.col("p95_dt")).alias("p95_dt"),
    )


def drops_after(
    samples: DataFrame, key: str, first_tick_ms: int, tick_step_ms: int, ticks: int, window_ms: int, limit: float
) -> DataFrame:
    """Per key and tick: samples within window_ms after the tick whose gap exceeds the limit.

    Ticks are evenly spaced, so a sample computes the ticks it belongs to.
    """
    rel = F.col("ms") - F.lit(first_tick_ms)
    lo = F.greatest(F.ceil((rel - window_ms) / tick_step_ms), F.lit(0).cast("bigint"))
    hi = F.least(F.floor(rel / tick_step_ms), F.lit(ticks - 1).cast("bigint"))
    return (
        samples.where(F.col("dt") > limit)
        .where(lo <= hi)
        .withColumn("tick", F.explode_outer(F.sequence(lo, hi)))
        .groupBy(key, "tick")
        .agg(F.count(F.lit(1)).alias("drops"))
    )


# --- token bucket -----------------------------------------------------------------------
#
# Tokens are counted in whole units: a token has `unit` of them, a millisecond adds `step`.
# One merged request (ms, n) turns a level x into
#
#     y = min(full, x + step * wait)        y - unit * min(n, y // unit)
#
# A run of requests is a map of the level before it to the level after it. It is kept as
# pieces of the levels it can be entered with: on each the result is a constant, or the
# level plus a constant. Runs of a key can so be summarised in parallel, put one after the
# other, and then be gone through again with the right level at their start.

Piece = tuple[int, int, int, int]  # levels lo .. hi lead to value + slope * (level - lo)
RUN_ROWS = 4096


def bucket_units(sustained: int, burst: int, window_ms: int) -> tuple[int, int, int]:
    """(unit, step, full): units of a token, units added per millisecond, units of a full bucket."""
    g = math.gcd(sustained, window_ms)
    return window_ms // g, sustained // g, burst * (window_ms // g)


def admit(x: int, added: int, n: int, unit: int, full: int) -> tuple[int, int]:
    """Level and admitted requests after `added` units and n requests."""
    y = min(full, x + added)
    taken = min(n, y // unit)
    return y - unit * taken, taken


def _merged(pieces: list[Piece]) -> list[Piece]:
    """Neighbours that are one piece, joined."""
    out: list[Piece] = []
    for p in pieces:
        if out:
            lo, hi, slope, value = out[-1]
            if slope == p[2] and p[3] == value + slope * (p[0] - lo):
                out[-1] = (lo, p[1], slope, value)
                continue
            if lo == hi and p[3] == value and p[2] == 0:  # a single level is constant too
                out[-1] = (lo, p[1], 0, value)
                continue
        out.append(p)
    return out


def admit_pieces(pieces: list[Piece], added: int, n: int, unit: int, full: int) -> list[Piece]:
    """The map of a run, with one more request behind it."""
    out: list[Piece] = []
    for lo, hi, slope, value in pieces:
        y = value + added
        if not slope:
            out.append((lo, hi, 0, admit(value, added, n, unit, full)[0]))
            continue
        top = y + hi - lo
        if y >= full:
            out.append((lo, hi, 0, full - unit * min(n, full // unit)))
            continue
        end = hi if top < full else lo + (full - 1 - y)
        at = lo
        while at <= end:  # whole tokens in the bucket: one piece each until n are there
            level = y + at - lo
            taken = min(n, level // unit)
            stop = end if taken == n else min(end, at + unit - 1 - level % unit)
            out.append((at, stop, 1, level - unit * taken))
            at = stop + 1
        if end < hi:
            out.append((end + 1, hi, 0, full - unit * min(n, full // unit)))
    return _merged(out)


def apply_pieces(pieces: list[Piece], x: int) -> int:
    """The level after a run that is entered with level x."""
    k = bisect_right(pieces, x, key=lambda p: p[0]) - 1
    lo, _, slope, value = pieces[k]
    return value + slope * (x - lo)


def runs_of_requests(merged: DataFrame, key: str, span_ms: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """(key, run, rows): merged requests in runs of at most `run_rows`, each an array in time order.

    `rows` has ms, n and wait, the time since the key's request before (null: none).
    """
    placed = numbered(merged, [key], F.floor(F.col("ms") / span_ms), [F.col("ms").asc()], "place")
    run = F.floor(F.col("place") / run_rows)
    grouped = placed.groupBy(key, run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("ms", F.col("requests").alias("n")))).alias("rows"))
    ends = grouped.select(key, "run", F.element_at("rows", -1)["ms"].alias("last"))
    before = F.lag("last").over(Window.partitionBy(key).orderBy("run"))
    linked = grouped.join(ends.select(key, "run", before.alias("before")), [key, "run"])

    def with_wait(r: Column, i: Column) -> Column:
        previous = F.when(i == 0, F.col("before")).otherwise(F.get("rows", i - 1)["ms"])
        return F.struct(r["ms"].alias("ms"), r["n"].alias("n"), (r["ms"] - previous).alias("wait"))

    return linked.select(key, "run", F.transform("rows", with_wait).alias("rows"))


def token_bucket(
    requests: DataFrame, key: str, sustained: int = 15, burst: int = 30, window_ms: int = 60_000, run_rows: int = RUN_ROWS
) -> DataFrame:
    """Admission per (key, millisecond): requests and how many were accepted.

    The refill is cut off at `burst` after every request, so the rule is sequential. Runs of
    at most `run_rows` requests work on their own all the same, however busy a key is:

    1. each run is gone through from an empty and from a full bucket. Two levels never
       swap their order by a whole token or more, so this bounds the level at its end;
    2. each run is turned into pieces over the levels that the run before can leave;
    3. the starts of all runs follow by passing a level through one row per run;
    4. each run is gone through from its start.

    Levels are whole units, so the outcome is exact. Requests without a key are left out.
    """
    unit, step, full = bucket_units(sustained, burst, window_ms)
    key_type = requests.schema[key].dataType
    merged = requests.where(F.col(key).isNotNull()).groupBy(key, "ms").agg(F.count(F.lit(1)).alias("requests"))
    refill_ms = -(-full // step)
    runs = runs_of_requests(merged, key, max(refill_ms, 1), run_rows)
    head = [T.StructField(key, key_type), T.StructField("run", T.LongType())]

    def each(df: DataFrame, make, *fields: T.StructField) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [make(*r) for r in batch.itertuples(index=False)]
                columns = list(zip(*out, strict=True)) or [[] for _ in fields]
                yield pd.DataFrame({key: batch[key], "run": batch["run"], **{f.name: list(c) for f, c in zip(fields, columns, strict=True)}})

        return df.mapInPandas(run, T.StructType([*head, *fields]))

    def bounds(_key, _run, rows):
        low, high = 0, full
        for r in rows:
            added = full if r["wait"] is None else step * r["wait"]
            low, high = admit(low, added, r["n"], unit, full)[0], admit(high, added, r["n"], unit, full)[0]
        return max(0, min(low, high) - unit), min(full, max(low, high) + unit)

    long = T.LongType()
    ends = each(runs, bounds, T.StructField("low", long), T.StructField("high", long))
    entry = Window.partitionBy(key).orderBy("run")
    entered = ends.select(
        key, "run", F.coalesce(F.lag("low").over(entry), F.lit(full)).alias("low"), F.coalesce(F.lag("high").over(entry), F.lit(full)).alias("high")
    )

    def pieces(_key, _run, rows, low, high):
        now: list[Piece] = [(low, high, 1, low)]
        for r in rows:
            now = admit_pieces(now, full if r["wait"] is None else step * r["wait"], r["n"], unit, full)
        return (list(now),)

    kind = T.ArrayType(T.ArrayType(long))
    maps = each(runs.join(entered, [key, "run"]).select(key, "run", "rows", "low", "high"), lambda *r: ([list(p) for p in pieces(*r)[0]],), T.StructField("pieces", kind))

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level = None, full
        for batch in batches:
            out = []
            for k, r, ps in zip(batch[key], batch["run"], batch["pieces"], strict=True):
                if r == 0 or k != current:
                    current, level = k, full
                out.append(level)
                level = apply_pieces([tuple(p) for p in ps], level)
            yield pd.DataFrame({key: batch[key], "run": batch["run"], "start": out})

    in_order = maps.repartition(F.col(key)).sortWithinPartitions(key, "run")
    begun = in_order.mapInPandas(starts, T.StructType([*head, T.StructField("start", long)]))

    def replay(_key, _run, rows, level):
        taken = []
        for r in rows:
            level, n = admit(level, full if r["wait"] is None else step * r["wait"], r["n"], unit, full)
            taken.append(n)
        return ([[r["ms"], r["n"], n] for r, n in zip(rows, taken, strict=True)],)

    done = each(runs.join(begun, [key, "run"]).select(key, "run", "rows", "start"), replay, T.StructField("rows", kind))
    out = done.select(key, F.explode("rows").alias("r"))
    return out.select(key, F.get("r", F.lit(0)).alias("ms"), F.get("r", F.lit(1)).alias("requests"), F.get("r", F.lit(2)).alias("accepted"))
