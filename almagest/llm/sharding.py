"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A document's place on the ring is the hash of its text, so copies lie together. The
ring is cut into cells; the virtual nodes of the shards sit on cells by the hash of
their names. A cell's rows belong to the first node clockwise. A shard takes its exact
fair share and no row more; rows of a full shard go on clockwise to the next shard with
room. Shares differ by one row at most, so the law is `rows`.

Only counts per cell (at most `cells` of them, whatever the input's size) reach the
driver, which turns them into runs (cell, ranks from, to) -> (shard, first slot). Rows
are ranked inside (cell, salt), where the salt is a hash of the id and a cell has as many
salts as its count asks for: a text with a third of all rows is one cell but many groups of
about `group_rows` rows.

Defined cases. A null text is an empty one of size 8. A null id hashes like any value.
Repeated rows each get a slot of their own. An empty table gives an empty result. Other
columns pass through; the result columns replace inputs of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.llm.common import settled, text_or_empty

CELL_BITS = 16
NODES = 64
#: Rows that are ranked in one group; larger cells are dealt into several.
GROUP_ROWS = 50_000


def node_cells(shards: int, nodes: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all virtual nodes in ring order, and the shard of each."""
    places = []
    for s in range(shards):
        for v in range(nodes):
            digest = hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest()
            places.append((int.from_bytes(digest, "big") >> (64 - bits), s, v))
    places.sort()
    return np.array([p[0] for p in places]), np.array([p[1] for p in places])


def assign(counts: dict[int, int], shards: int, nodes: int = NODES, bits: int = CELL_BITS) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, end rank, shard, first slot) for the rows of all cells.

    First every cell claims room in the shard that owns it, in ring order. Rows without
    room walk on clockwise, node by node, until all have a place.
    """
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    cells, owners = node_cells(shards, nodes, bits)
    taken: dict[int, list[tuple[int, int]]] = {}
    pending = []
    for cell in sorted(counts):
        at = int(np.searchsorted(cells, cell)) % len(cells)
        got = min(counts[cell], free[owners[at]])
        free[owners[at]] -= got
        taken[cell] = [(int(owners[at]), got)]
        if got < counts[cell]:
            pending.append((cell, at, counts[cell] - got))
    for cell, at, left in pending:
        while left:
            at = (at + 1) % len(cells)
            if got := min(left, free[owners[at]]):
                free[owners[at]] -= got
                taken[cell].append((int(owners[at]), got))
                left -= got
    slots, runs = [0] * shards, []
    for cell in sorted(taken):
        rank = 0
        for shard, n in taken[cell]:
            if n:
                runs.append((cell, rank, rank + n, shard, slots[shard]))
                slots[shard] += n
                rank += n
    return runs


def shard(df: DataFrame, shards: int = 24, nodes: int = NODES, bits: int = CELL_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All rows of (doc_id, text, ...) with size, text_crc32, law, shard, slot, grown_shard.

    Small columns travel through the shuffle together with the rest of the row, so
    callers that need no text should select it away: see `places`.
    """
    out = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in df.columns if c.lower() not in out]
    ring = F.xxhash64(text_or_empty())
    # the row is one column, so none of its names can clash with those used here
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col("doc_id").alias("id"),
        (F.octet_length(text_or_empty()).cast("long") + 8).alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        ring.alias("ring"),
        F.shiftrightunsigned(ring, 64 - bits).cast("int").alias("cell"),
    )
    return _placed(rows, shards, nodes, bits, group_rows)


def _placed(rows: DataFrame, shards: int, nodes: int, bits: int, group_rows: int) -> DataFrame:
    spark = rows.sparkSession
    # one row per cell of the ring: bounded by 2**bits
    counts = {r[0]: r[1] for r in rows.groupBy("cell").agg(F.count(F.lit(1))).collect()}
    crowded = [(c, -(-n // group_rows)) for c, n in counts.items() if n > group_rows]
    crowded = F.broadcast(spark.createDataFrame(crowded, "cell int, salts int"))
    salt = F.pmod(F.xxhash64(F.lit("salt"), F.col("id")), F.coalesce("salts", F.lit(1))).cast("int")
    rows = rows.join(crowded, "cell", "left").withColumn("salt", salt).drop("salts")
    groups = settled(rows.groupBy("cell", "salt").agg(F.count(F.lit(1)).alias("n")), "ring-groups")
    before = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("cell", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    runs = spark.createDataFrame(assign(counts, shards, nodes, bits), "cell int, low long, high long, shard int, first long")
    inside = Window.partitionBy("cell", "salt").orderBy("ring", "id", "size", "text_crc32")
    ranked = rows.withColumn("place", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, ["cell", "salt"])
        .withColumn("place", F.col("place") + F.col("offset"))
        # 2**bits runs and a few per shard: a proven bound
        .join(F.broadcast(runs), "cell")
        .where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
        .select(
            "row.*",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("first") + F.col("place") - F.col("low")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def places(df: DataFrame, shards: int = 24, **options) -> DataFrame:
    """As `shard`, without any other column than doc_id: no text is shuffled."""
    return shard(df.select("doc_id", "text"), shards, **options).drop("text")
