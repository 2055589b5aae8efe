"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.session import shared_dir

#: White space of the word definition used throughout: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 8 * 1024**2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settled(df: DataFrame, purpose: str, *folders: str) -> DataFrame:
    """Write a table to the cluster's shared folder, in folders by columns if asked, and read it back.

    Cuts the lineage: whatever is lost later is read again from the shared folder
    and not computed again from the start.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """`base`, lengthened until the frame has no column of that name (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def free_names(df: DataFrame, *bases: str) -> list[str]:
    """Names for helper columns that no column of the frame has."""
    return [free_name(df, base) for base in bases]


def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about `limit` bytes of a text column.

    A single longer text is a piece by itself: texts are never cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after the other, and the n + 1 offsets of its rows.

    Null counts as empty.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (two rounds of multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of an odd base modulo 2**64, and of its inverse."""

    def run(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie end to end, and the text of each word."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    out = np.empty(len(at), dtype=np.uint64)
    done = 0
    while done < len(at):  # in blocks of whole words, so that long texts need no long tables
        first = at[done]
        until = max(done + 1, int(np.searchsorted(to, first + _BLOCK, side="right")))
        part = data[first : to[until - 1]].astype(np.uint64) + np.uint64(1)
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up, out=sums[1:])
        a, b = at[done:until] - first, to[done:until] - first
        out[done:until] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        done = until
    return mixed(out), np.searchsorted(offsets, at, side="right") - 1


def shingles(words: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words, and the n + 1 offsets of the texts.

    A text with fewer words has one shingle of all of them, a text without words none.
    """
    counts = np.bincount(text, minlength=n_texts)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    have = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate(([0], np.cumsum(have)))
    owner = np.repeat(np.arange(n_texts), have)
    first = np.arange(len(owner)) - out_offsets[owner] + offsets[owner]
    short = counts[owner] < size
    h = np.zeros(len(owner), dtype=np.uint64)
    for i in range(size):
        there = ~short | (i < counts[owner])
        word = words[np.minimum(first + i, max(len(words) - 1, 0))] if len(words) else h
        h = np.where(there, (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word, h)
    return mixed(h), out_offsets


def labelled(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes joined with how often they occurred before in the same text."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = mixed(h + owner.astype(np.uint64) * np.uint64(_BASE))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, dtype=bool)
    run = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, dtype=np.int64)
    out = h.copy()
    again = run > 0
    out[order[again]] = mixed(h[order[again]] + run[again].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the connected components of (a, b); label is the smallest node.

    Minimum labels travel along edges and then jump to the label's label, so the number
    of rounds grows with the logarithm of a component's width. Only a count per round
    reaches the driver.
    """
    both = settled(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges"
    )
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "component-labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).alias("old"))
        told = heard.unionByName(labels.withColumn("old", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        target = labels.select(F.col("node").alias("t_node"), F.col("label").alias("t_label"))
        jumped = told.join(target, F.col("label") == F.col("t_node")).select("node", "old", F.least("label", "t_label").alias("label"))
        after = settled(jumped, "component-labels")
        labels = after.drop("old")
        if after.where("old <> label").isEmpty():
            return labels


#: A key with more than one in so many rows is hot; there are at most so many hot keys.
HOT_SHARE = 1000


def per_key(rows: DataFrame, key: str, name: str, total: Column) -> DataFrame:
    """The frame with the column `name`, an aggregate over the rows of equal key, nulls together.

    Totals of hot keys, at most `HOT_SHARE` rows, are broadcast, so that no task gets all
    rows of such a key; the others meet their totals by a shuffle.
    """
    totals = settled(rows.groupBy(F.col(key).alias("total_key")).agg(F.count(F.lit(1)).alias("total_rows"), total.alias("total")), "totals")
    n = totals.agg(F.coalesce(F.sum("total_rows"), F.lit(0))).first()[0]
    hot = totals.where(F.col("total_rows") * HOT_SHARE > n).drop("total_rows").withColumn("hot", F.lit(True))
    rest = totals.where(F.col("total_rows") * HOT_SHARE <= n).drop("total_rows")
    same = F.col(key).eqNullSafe(F.col("total_key"))
    met = rows.join(F.broadcast(hot), same, "left")
    done = met.where("hot").drop("hot", "total_key").withColumnRenamed("total", name)
    cold = met.where("hot is null").drop("hot", "total_key", "total").join(rest, same).drop("total_key").withColumnRenamed("total", name)
    return done.unionByName(cold)
