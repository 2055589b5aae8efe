"""Vector codes by parts, learned with adaptive distance bounds (after Drake and Hamerly).

A vector is cut into `PARTS` consecutive parts; each part position has a codebook of
`ENTRIES` entries, learned in `ROUNDS` rounds of integer k-means. Between rounds, every part
keeps its entry, an upper bound of the distance to it, the b next closest entries with their
ordered lower bounds, and one outer bound below the distance of all the others. When the
entries have moved, the bounds are shifted by how far:

* if the upper bound is below every lower bound, the entry stays and no distance is computed;
* if it is below the bounds from the i-th on, only the entries before are compared;
* only if it reaches the outer bound, all entries are.

Bounds are doubles, shifted towards the careful side by more than their rounding. Whatever
they leave open is decided by exact integer distances, ties by the lower index, so codes and
codebooks equal those of the plain algorithm. b starts at half of the entries and shrinks to
the most bounds that one in `RARELY` parts needed in the round before; parts that would have
needed more compare all entries.

Work. State travels with the vectors in one table per round (`common.settled`); only sums per
entry, 8 x 16 rows of numbers, go through the driver. Nothing is shuffled but those sums.

Defined cases. Null vectors and those with null, NaN or infinite components are dropped. All
kept vectors should have one length, a multiple of `PARTS`; those of another length than the
first (by vec_id) that has one, or with a component beyond 2**15, stay in the result with a
null code and error and teach nothing. A null id comes last. Rows of equal id are ordered by
their vector; repeated rows count each. With fewer than 16 vectors the codebook is as small.
Labels that are null are one group. An empty table gives an empty result. Other columns are
never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.llm.common import per_key, settled

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
LARGEST = 2**15
#: One part in so many may need more bounds than are kept.
RARELY = 64
#: Far above the rounding of a distance in double.
SLACK = 1e-6
_ROWS = 4096


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, x): components as integers, of the vectors that are kept."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    floors = F.transform(x, lambda v: F.floor(F.least(F.greatest(v, F.lit(-2.0 * LARGEST)), F.lit(2.0 * LARGEST)) * SCALE).cast("int"))
    return df.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), floors.alias("x"))


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """(parts, entries, width) from the smallest ids; None without any usable vector."""
    usable = vectors.where((F.size("x") > 0) & (F.size("x") % parts == 0) & in_range())
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    first = usable.orderBy(*order).select("x").first()
    if first is None:
        return None
    rows = usable.where(F.size("x") == len(first[0])).orderBy(*order).select("x").limit(entries).collect()
    return np.array([r[0] for r in rows], dtype=np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def in_range(x: str = "x"):
    return ~F.exists(x, lambda v: F.abs(v) > LARGEST * SCALE)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of (n, width) to (entries, width)."""
    d = x[:, None, :] - book[None, :, :]
    return np.einsum("nkw,nkw->nk", d, d)


class Bounds:
    """State of n parts of one position: entry, upper bound, b next entries with lower bounds, outer bound."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray) -> None:
        self.entry, self.upper, self.near, self.lower, self.outer = entry, upper, near, lower, outer

    @staticmethod
    def fresh(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
        """All distances; ties to the lower index."""
        exact = squared(x, book)
        order = np.argsort(exact, axis=1, kind="stable")
        d = np.sqrt(np.take_along_axis(exact, order, axis=1).astype(float))
        b = min(b, book.shape[0] - 1)
        outer = d[:, b + 1] * (1 - SLACK) if b + 1 < book.shape[0] else np.full(len(x), np.inf)
        return Bounds(order[:, 0], d[:, 0] * (1 + SLACK), order[:, 1 : b + 1], d[:, 1 : b + 1] * (1 - SLACK), outer)

    def moved(self, drift: np.ndarray) -> None:
        """Shift the bounds by how far the entries went."""
        careful = drift * (1 + SLACK)
        self.upper = self.upper + careful[self.entry]
        self.lower = self.lower - careful[self.near]
        self.outer = self.outer - careful.max(initial=0.0)

    def settle(self, x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, int]:
        """Assign again after `moved`; returns how many bounds each part needed, and distances computed.

        Afterwards b entries are kept (fewer than before: the closest ones).
        """
        n, kept = self.near.shape
        k = book.shape[0]
        # bounds from the i-th on are at least the smallest of them, the outer one included
        tail = np.minimum.accumulate(np.column_stack([self.lower, self.outer])[:, ::-1], axis=1)[:, ::-1]
        need = (self.upper[:, None] >= tail).sum(axis=1)
        computed = 0
        for i in range(1, kept + 1):
            rows = np.flatnonzero(need == i)
            if not len(rows):
                continue
            options = np.column_stack([self.entry[rows], self.near[rows, :i]])
            d = x[rows][:, None, :] - book[options]
            exact = np.einsum("nkw,nkw->nk", d, d)
            computed += exact.size
            order = np.lexsort((options, exact), axis=1)
            options, exact = np.take_along_axis(options, order, axis=1), np.take_along_axis(exact, order, axis=1)
            distance = np.sqrt(exact.astype(float))
            self.entry[rows], self.upper[rows] = options[:, 0], distance[:, 0] * (1 + SLACK)
            self.near[rows, :i], self.lower[rows, :i] = options[:, 1:], distance[:, 1:] * (1 - SLACK)
        rows = np.flatnonzero(need > kept)
        if len(rows):
            computed += len(rows) * k
            new = Bounds.fresh(x[rows], book, kept)
            self.entry[rows], self.upper[rows], self.near[rows], self.lower[rows], self.outer[rows] = new.entry, new.upper, new.near, new.lower, new.outer
        if b < kept:
            # the entries given up move behind the outer bound
            order = np.argsort(self.lower, axis=1, kind="stable")
            self.near, self.lower = np.take_along_axis(self.near, order, axis=1), np.take_along_axis(self.lower, order, axis=1)
            self.outer = np.minimum(self.outer, self.lower[:, b])
            self.near, self.lower = self.near[:, :b], self.lower[:, :b]
        return need, computed


def _down(v: np.ndarray) -> np.ndarray:
    return np.nextafter(v.astype(np.float32), np.float32(-np.inf))


def packed(states: list[Bounds]) -> np.ndarray:
    """Bytes of n rows: per part entry, upper, outer, near and lower; rounded to the careful side."""
    columns = []
    for s in states:
        n = len(s.entry)
        up = np.nextafter(s.upper.astype(np.float32), np.float32(np.inf))
        numbers = np.column_stack([up, _down(s.outer), _down(s.lower)]).astype("<f4")
        columns += [s.entry.astype(np.uint8)[:, None], s.near.astype(np.uint8), numbers.view(np.uint8).reshape(n, -1)]
    return np.ascontiguousarray(np.hstack(columns))


def unpacked(raw: np.ndarray, parts: int = PARTS) -> list[Bounds]:
    """The states in rows of bytes, each of 1 + b + 4 * (2 + b) bytes a part."""
    per = raw.shape[1] // parts
    b = (per - 9) // 5
    out = []
    for p in range(parts):
        part = raw[:, p * per : (p + 1) * per]
        numbers = np.ascontiguousarray(part[:, 1 + b :]).view("<f4").astype(float)
        out.append(Bounds(part[:, 0].astype(np.int64), numbers[:, 0], part[:, 1 : 1 + b].astype(np.int64), numbers[:, 2:], numbers[:, 1]))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _advance(table: DataFrame, books: np.ndarray, drift: np.ndarray | None, b: int) -> DataFrame:
    """The table with states after one more assignment; `needs` counts parts by bounds needed."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                x = _matrix(batch.column(2)).reshape(batch.num_rows, parts, -1)
                if drift is None:
                    states = [Bounds.fresh(x[:, p], books[p], b) for p in range(parts)]
                    need = np.zeros((batch.num_rows, parts), dtype=np.uint8)
                else:
                    raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                    states, need = unpacked(raw, parts), np.zeros((batch.num_rows, parts), dtype=np.uint8)
                    for p, s in enumerate(states):
                        s.moved(drift[p])
                        need[:, p], _ = s.settle(x[:, p], books[p], b)
                rows = [r.tobytes() for r in packed(states)]
                needs = [r.tobytes() for r in need]
                columns = [*batch.columns[:3], pa.array(rows, pa.binary()), pa.array(needs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "state", "needs"])

    fields = [table.schema[c] for c in ("vec_id", "label", "x")]
    schema = T.StructType([*fields, T.StructField("state", T.BinaryType()), T.StructField("needs", T.BinaryType())])
    return table.mapInArrow(run, schema)


def _sums(table: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per part and entry: sums of components and counts; and how many parts needed 0, 1, ... bounds."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((parts, k, width + 1), dtype=np.int64)
        needed = np.zeros(k + 1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0)).reshape(batch.num_rows, parts, width)
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            entry = raw[:, :: raw.shape[1] // parts][:, :parts]
            for p in range(parts):
                np.add.at(got[p, :, :width], entry[:, p], x[:, p])
                got[p, :, width] += np.bincount(entry[:, p], minlength=k)
            needed += np.bincount(np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8), minlength=k + 1)
        flat = np.concatenate((got.ravel(), needed))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    size = parts * k * (width + 1)
    rows = table.select("x", "state", "needs").mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v")).collect()
    flat = np.zeros(size + k + 1, dtype=np.int64)
    for i, v in rows:
        flat[i] = v
    got = flat[:size].reshape(parts, k, width + 1)
    return got[:, :, :width], got[:, :, width], flat[size:]


def next_b(needed: np.ndarray, b: int, rarely: int = RARELY) -> int:
    """The fewest bounds that all but one in `rarely` parts can do with; never more than now."""
    total = needed.sum()
    if not total:
        return b
    enough = int(np.searchsorted(np.cumsum(needed), total * (1 - 1 / rarely)))
    return min(b, max(1, enough))


def learn(vectors: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """The last table of states, the final codebooks, and b of all rounds."""
    parts, k, width = books.shape
    table = vectors.where((F.size("x") == parts * width) & in_range())
    b = max(1, k // 2)
    kept = [b]
    state = settled(_advance(table, books, None, b), "code-states")
    for _ in range(rounds):
        sums, counts, needed = _sums(state, books)
        b = next_b(needed, b) if len(kept) > 1 else b
        kept.append(b)
        moved = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        drift = np.sqrt(((moved - books) ** 2).sum(axis=2).astype(float))
        books = moved
        state = settled(_advance(state, books, drift, b), "code-states")
    return state, books, kept


def codes(df: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, **names: str) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every kept row, and the codebooks."""
    vectors = settled(integer_vectors(df, **names), "code-vectors")
    books = first_codebooks(vectors, parts, entries)
    none = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    if books is None:
        return vectors.select("vec_id", "label", *none), None
    state, books, _ = learn(vectors, books, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2)).reshape(batch.num_rows, parts, -1)
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            entry = np.ascontiguousarray(raw[:, :: raw.shape[1] // parts][:, :parts])
            d = x - books[np.arange(parts), entry]
            error = np.einsum("npw,npw->n", d, d)
            columns = [batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in entry]), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    fields = [vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    done = state.select("vec_id", "label", "x", "state").mapInArrow(run, T.StructType(fields))
    other = vectors.where((F.size("x") != books.shape[0] * books.shape[2]) | ~in_range()).select("vec_id", "label", *none)
    return done.unionByName(other), books


def books_sha256(books: np.ndarray | None) -> str:
    numbers = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def coded(df: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row."""
    rows, books = codes(df, **options)
    rows = settled(rows, "code-rows")
    with_sums = per_key(rows, "label", "label_error", F.sum("error"))
    return with_sums.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    ctes = [
        """kept AS (
    SELECT vec_id, label, [floor(4096 * v::DOUBLE)::BIGINT for v in embedding] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len([v for v in embedding if v IS NULL OR isnan(v) OR isinf(v)]) = 0)""",
        """parts AS MATERIALIZED (
    SELECT vec_id, label, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS y FROM kept, range(8) AS r(p))""",
        """book_0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, y AS c FROM parts
    QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 16)""",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""near_{i} AS MATERIALIZED (
    SELECT vec_id, label, p, min([d, e]) AS best, any_value(y) AS y FROM (
        SELECT vec_id, label, p, e, y, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(y, c)])::BIGINT AS d
        FROM parts JOIN book_{i} USING (p)) GROUP BY vec_id, label, p)"""
        )
        if i < rounds:
            ctes.append(
                f"""mean_{i} AS (
    SELECT p, e, list(c ORDER BY k) AS c FROM (
        SELECT p, best[2] AS e, k, floor(sum(y[k])::DOUBLE / count(*))::BIGINT AS c
        FROM near_{i}, range(1, 4096) AS r(k) WHERE k <= len(y) GROUP BY ALL) GROUP BY p, e)"""
            )
            ctes.append(
                f"""book_{i + 1} AS MATERIALIZED (
    SELECT p, e, coalesce(m.c, b.c) AS c FROM book_{i} b LEFT JOIN mean_{i} m USING (p, e))"""
            )
    ctes.append(
        f"""coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error
    FROM near_{rounds} GROUP BY vec_id, label)"""
    )
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book_{rounds}) AS codebooks_sha256
FROM coded"""


#: For tables whose ids are unique and whose vectors have one length.
SQL = _sql()
