"""Ranked lexical search over norm-ordered buckets of impact vectors.

Every document is a sparse vector of integer impacts of the terms that queries use, times
the terms' weights; a query holds how often it names a term, so the inner product is the
score. The vectors are put in order of their length and cut into buckets:

* Between buckets, the Cauchy-Schwarz inequality: a bucket whose longest vector has length l
  holds nothing for a query of length |q| once |q| * l is below the query's `top`-th best score.
* Inside, bounds on coordinates: for the coordinates F in which a query is heaviest, the
  products are summed; the rest is at most |q outside F| * |p outside F|. First F is a few
  coordinates, and queries that nothing of the bucket can reach go; then F is nearly all.
* What survives both is scored again exactly, in 64-bit integers.

Bounds are doubles with a margin far above their rounding; a document whose bound *equals* the
best score so far survives, as a smaller id may put it first. So results are exact.

Work. Lengths are cut at a few quantiles, the longest 1/64 first, each further part about twice
as large. A part is one job: its tasks go through their buckets from the longest on, keep
the `top` best per query in arrays of fixed size, and start from the best scores of the parts
before; only these scores, a number per query, pass through the driver. Queries are taken in
blocks whose distinct texts are bounded (`BLOCK_BYTES`), so that what is sent to the tasks is
bounded too; more queries mean more blocks. Copies of a text are vectors like others and cost
at most `top` rows per query and task.

Defined cases. A null or empty text has no terms and is no hit. A query without terms gets no
rows. Rows of the queries repeated in full count once; those of one id with different texts
are queries of their own, and a null id is an id. Repeated document rows are ranked each (equal
rows next to each other). Equal scores go by ascending doc_id, null last. Empty tables give
empty results. Other columns are never looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.llm.common import settled, sliced, text_or_empty

TOP = 10
#: Bound of the texts of one block of queries.
BLOCK_BYTES = 4 * 1024**2
#: Vectors in a bucket, and coordinates of the queries that are taken against it at once.
BUCKET_ROWS, COLUMNS = 256, 16384
#: Heaviest coordinates of a query that the first and the second bound look at.
FOCUS = (8, 4096)
SCALE = 1_000_000_000
#: Far above the rounding of sums of doubles.
MARGIN = 1.0 + 1e-9
_STEP = 4 << 20
_NO_ID = np.iinfo(np.int64).max

#: Bytes outside of terms become spaces, A-Z small letters; all of UTF-8 beyond ASCII stays.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


@dataclass
class Block:
    """Queries of bounded size: (number, term, times) triples ordered by query, and the terms' weights."""

    names: list[tuple]  # (item_id, text)
    terms: dict[bytes, int]
    query: np.ndarray
    term: np.ndarray
    times: np.ndarray
    weight: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.names)
        self.first = np.searchsorted(self.query, np.arange(n + 1))
        self.length = np.sqrt(np.bincount(self.query, weights=self.times.astype(float) ** 2, minlength=n))
        # heaviest coordinates: what a query asks for, times what the term can bring
        order = np.lexsort((-self.times * self.weight[self.term], self.query))
        rank = np.arange(len(order)) - self.first[self.query[order]]
        self.focus, self.outside = [], []
        for size in FOCUS:
            self.focus.append(np.sort(order[rank < size]))
            rest = order[rank >= size]
            self.outside.append(np.sqrt(np.bincount(self.query[rest], weights=self.times[rest].astype(float) ** 2, minlength=n)))

    def groups(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """Queries in groups that have at most `COLUMNS` coordinates in focus, or of one query."""
        ends = np.cumsum(np.minimum(np.diff(self.first)[queries], FOCUS[-1]))
        start = 0
        while start < len(queries):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + COLUMNS, side="right")))
            yield queries[start:end]
            start = end


def blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The distinct (item_id, text) rows with terms, in lists of bounded size."""
    text = text_or_empty()
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).distinct()
    rows = settled(rows.withColumn("bytes", F.octet_length("text") + 64), "search-queries")
    total, largest = rows.agg(F.sum("bytes"), F.max("bytes")).first()
    n = -(-(total or 0) // block_bytes)
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    # hashing spreads the rows; where a block turns out too large, all are halved
    while n > 1 and rows.groupBy(number).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] > 2 * max(block_bytes, largest):
        n *= 2
        number = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        got = rows.where(number == k).select("item_id", "text").collect()
        block = sorted(((r[0], r[1]) for r in got if terms_of(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if block:
            yield block


def _parsed(names: list[tuple]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    terms: dict[bytes, int] = {}
    triples = []
    for q, (_, text) in enumerate(names):
        for t, times in Counter(terms_of(text)).items():
            triples.append((q, terms.setdefault(t, len(terms)), times))
    query, term, times = (np.array(c, dtype=np.int64) for c in zip(*triples, strict=True))
    return terms, query, term, times


def counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): number of all terms, and those of the block with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, _STEP):
            n, ends, term, tf = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                n.append(len(words))
                here = sorted((terms[w], c) for w, c in Counter(words).items() if w in terms)
                term += [t for t, _ in here]
                tf += [c for _, c in here]
                ends.append(len(term))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>").where("n > 0")


def weighted(rows: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, length, term, impact): weighted impacts of documents that hold a term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], dtype=np.int64)
            term = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            impact = weight[term] * (SCALE * tf // (1000 * tf + 8 * m[owner]))
            length = np.sqrt(np.bincount(owner, weights=impact.astype(float) ** 2, minlength=batch.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(impact))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), batch.column(2), lists], names=["doc_id", "length", "term", "impact"])

    return rows.mapInArrow(run, "doc_id long, length double, term array<int>, impact array<long>").where("length > 0")


class Best:
    """The `top` best (score, doc_id) per query, in arrays of fixed size."""

    def __init__(self, floor: np.ndarray, top: int) -> None:
        self.score = np.zeros((len(floor), top), dtype=np.int64)
        self.doc = np.full((len(floor), top), _NO_ID)
        self.floor = floor.copy()  # nothing below can be a result

    def add(self, q: int, score: np.ndarray, doc: np.ndarray) -> None:
        s, d = np.concatenate((self.score[q], score)), np.concatenate((self.doc[q], doc))
        order = np.lexsort((d, -s))[: self.score.shape[1]]
        self.score[q], self.doc[q] = s[order], d[order]
        self.floor[q] = max(self.floor[q], self.score[q, -1])


def scan(block: Block, doc: np.ndarray, length: np.ndarray, first: np.ndarray, term: np.ndarray, impact: np.ndarray, best: Best, counts: np.ndarray | None = None) -> None:
    """Take one bucket of vectors (first: their offsets in term and impact) against all queries.

    `counts` collects (pairs, pairs in buckets not pruned, pairs scored).
    """
    n, n_terms = len(doc), len(block.weight)
    owner = np.repeat(np.arange(n), np.diff(first))
    keys = owner * n_terms + term  # ascending
    alive = np.flatnonzero(block.length * length.max() * MARGIN >= best.floor)
    if counts is not None:
        counts += (n * len(best.floor), n * len(alive), 0)
    place = np.full(n_terms, -1)

    def bounds(chosen: np.ndarray, focus: np.ndarray, outside: np.ndarray) -> np.ndarray:
        at = focus[np.isin(block.query[focus], chosen)]
        columns = np.unique(block.term[at])
        place[columns] = np.arange(len(columns))
        held = np.flatnonzero(place[term] >= 0)
        vectors = np.zeros((n, len(columns)))
        vectors[owner[held], place[term[held]]] = impact[held]
        heavy, inside = np.zeros((len(columns), len(chosen))), np.zeros((len(columns), len(chosen)))
        row, column = place[block.term[at]], np.searchsorted(chosen, block.query[at])
        heavy[row, column] = block.times[at]
        inside[row, column] = 1.0
        place[columns] = -1
        out = vectors @ heavy
        if outside[chosen].any():
            rest = np.maximum((length * length)[:, None] * MARGIN - (vectors * vectors) @ inside, 0.0)
            out += np.sqrt(rest) * outside[chosen]
        return out * MARGIN

    for chosen in block.groups(alive):
        for focus, outside in zip(block.focus, block.outside, strict=True):
            bound = bounds(chosen, focus, outside)
            left = (bound >= best.floor[chosen]).any(axis=0)
            chosen, bound = chosen[left], bound[:, left]
        for k in np.flatnonzero((bound >= best.floor[chosen]).any(axis=0)):
            q = chosen[k]
            rows = np.flatnonzero(bound[:, k] >= best.floor[q])
            mine = slice(block.first[q], block.first[q + 1])
            wanted = rows[:, None] * n_terms + block.term[mine]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            score = np.where(keys[found] == wanted, impact[found], 0) @ block.times[mine]
            hit = (score > 0) & (score >= best.floor[q])
            best.add(q, score[hit], doc[rows[hit]])
            if counts is not None:
                counts[2] += len(rows)


def searched(vectors: DataFrame, block: Block, floor: np.ndarray, top: int) -> DataFrame:
    """(query, score, doc_id): each task's best of its vectors, which lie in order of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(floor, top)
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET_ROWS):
                part = batch.slice(start, BUCKET_ROWS)
                doc = part.column(0).fill_null(_NO_ID).to_numpy()
                counts = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
                term = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                impact = part.column(3).flatten().to_numpy(zero_copy_only=False)
                scan(block, doc, part.column(1).to_numpy(), np.append(0, np.cumsum(counts)), term, impact, best)
        q, r = np.nonzero(best.score)
        ids = best.doc[q, r]
        columns = [pa.array(q), pa.array(best.score[q, r]), pa.array(ids, mask=ids == _NO_ID)]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "score", "doc_id"])

    return vectors.mapInArrow(run, "query long, score long, doc_id long")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, names: list[tuple], top: int) -> DataFrame:
    terms, query, term, times = _parsed(names)
    rows = settled(counted(docs, terms), "search-terms")
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(terms), dtype=np.int64)
    # one number per term of a block of bounded size
    for r in rows.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        df[r[0]] = r[1]
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    block = Block(names, terms, query, term, times, weight)
    vectors = weighted(rows, weight, n_docs, n_terms or 1)
    edges = [1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2]
    cuts = vectors.agg(F.percentile_approx("length", [1 - e for e in edges], 1000)).first()[0] or []
    vectors = vectors.withColumn("part", sum((F.col("length") < c).cast("int") for c in sorted(set(cuts), reverse=True)) if cuts else F.lit(0))
    # no shuffle: every task puts its own vectors in order, so each part is spread over all tasks
    ordered = settled(vectors.sortWithinPartitions("part", F.desc("length")), "search-vectors", "part")
    found, floor = None, np.ones(len(names), dtype=np.int64)
    for part in range(len(set(cuts)) + 1):
        fresh = searched(ordered.where(F.col("part") == part).drop("part"), block, floor, top)
        fresh = fresh if found is None else fresh.unionByName(found)
        found = settled(_ranked(fresh, top).drop("rank"), "search-best")
        # one number per query of a block of bounded size
        for r in found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= top).collect():
            floor[r[0]] = max(floor[r[0]], r[2])
    ids = docs.sparkSession.createDataFrame([(k, r[0]) for k, r in enumerate(names)], "number long, item_id long")
    # a block of bounded size
    return _ranked(found, top).join(F.broadcast(ids), F.col("query") == F.col("number")).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents (doc_id, text) for each query (item_id, text)."""
    out = None
    for names in blocks(queries, block_bytes):
        part = _search_block(docs, names, top)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


SQL = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
times AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, totals GROUP BY term),
impacts AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS impact
    FROM tf JOIN sizes USING (doc_id) JOIN weights USING (term), totals),
scores AS (
    SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score
    FROM times JOIN impacts USING (term) GROUP BY ALL HAVING sum(times * impact) > 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""
