"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector x: the counts of its words hashed to `BUCKETS` places (of
length 1 together), statistics of its structure, and metadata columns. The machine has one
weight per place and, for the pairs, one vector of `FACTORS` numbers per place:

    y = b + sum_i w_i x_i + sum_(i<j) <v_i, v_j> x_i x_j

The double sum is never formed: it equals half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2,
so that a score costs time in proportion to the places a document uses. The score is the
logistic function of y.

Learning. At most `MAX_LABELLED` labelled rows (the first in the order of a hash) are turned
into vectors in tasks, of at most `BUCKETS` words each; these bounded vectors are what the
machine is learned from (AdaGrad on the log loss). All documents are scored in Arrow batches.

Defined cases. A null or empty text has no words: its score comes from the bias, its
statistics (zeros) and metadata. Metadata that is null, no number or infinite counts as the
mean of what was learned from. Labels other than 0 and 1, and those of one id that contradict
each other, are not used; of several rows of an id the smallest text is learned from. With
labels of one kind only, all scores are the smoothed share of ones (0.5 without labels). An
id of null is held out. Repeated rows get equal scores. An empty table gives an empty result.
Columns other than text and metadata are carried along and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.llm.common import bytes_of, free_name, sliced, text_or_empty, word_hashes

BUCKETS = 4096
FACTORS = 8
#: Bound of the labelled sample that the machine is learned from.
MAX_LABELLED = 6_000
METADATA = ("n_chars",)
FOLDS = 5
THRESHOLD = 0.3

#: Groups of characters whose number per word is a statistic.
GROUPS = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "shouts": b"!?",
    "stops": b".,;:",
    "bars": b"|<>",
    "signs": b"#*$%&",
    "brackets": b"()[]{}",
    "lines": b"\n",
}
STRUCTURE = ("words", *GROUPS, "other_bytes", "word_length", "distinct_words", "largest_count")
_STEP = 2 << 20


@dataclass
class Sparse:
    """Hashed words of n texts as (text, place, value) triples, and their dense statistics."""

    text: np.ndarray
    place: np.ndarray
    value: np.ndarray
    dense: np.ndarray

    def rows(self, chosen: np.ndarray) -> Sparse:
        """The texts of these numbers, in this order; triples must be ordered by text."""
        counts = np.bincount(self.text, minlength=len(self.dense))
        first = np.cumsum(counts) - counts
        n = counts[chosen]
        at = np.repeat(first[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Sparse(np.repeat(np.arange(len(chosen)), n), self.place[at], self.value[at], self.dense[chosen])


def vectors_of(texts: pa.Array) -> Sparse:
    """Hashed words and raw statistics of a column of texts."""
    data, offsets = bytes_of(texts)
    n = len(offsets) - 1
    words, text = word_hashes(data, offsets)
    n_words = np.bincount(text, minlength=n).astype(float)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    # equal words of a text lie side by side after sorting
    order = np.lexsort((words, text))
    w, t = words[order], text[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(w)))
    largest = np.zeros(n)
    np.maximum.at(largest, t[starts], sizes)
    distinct = np.bincount(t[starts], minlength=n)
    kind = np.zeros(256, dtype=np.uint8)
    for i, chars in enumerate(GROUPS.values()):
        kind[list(chars)] = i + 1
    kind[128:] = len(GROUPS) + 1
    kinds = kind[data]
    some = np.maximum(n_words, 1.0)
    shares = [np.log1p(per_text(kinds == i + 1) / some) for i in range(len(GROUPS) + 1)]
    visible = per_text((data > 32) | ((data < 32) & ((data < 9) | (data > 13))))
    dense = np.column_stack([np.log1p(n_words), *shares, np.log1p(visible / some), distinct / some, largest / some])

    key, at = np.unique(t[starts] * BUCKETS + (w[starts] & np.uint64(BUCKETS - 1)).astype(np.int64), return_inverse=True)
    counts = np.log1p(np.bincount(at, weights=sizes, minlength=len(key)))
    owner, place = key // BUCKETS, key % BUCKETS
    length = np.sqrt(np.bincount(owner, weights=counts * counts, minlength=n))
    return Sparse(owner, place, counts / length[owner], dense)


@dataclass
class Machine:
    """Parameters; places are the hashed words, then the statistics, then the metadata."""

    metadata: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    bias: float = 0.0
    weights: np.ndarray = field(default=None)
    factors: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        size = BUCKETS + len(self.mean)
        if self.weights is None:
            self.weights, self.factors = np.zeros(size), np.zeros((size, FACTORS))

    def dense(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.mean) / self.scale, -5.0, 5.0)
        return np.where(np.isfinite(z), z, 0.0) / np.sqrt(raw.shape[1])

    def sums(self, x: Sparse, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """y of all texts, and sum_i v_if x_i."""
        n, v, d = len(dense), self.factors, self.factors[BUCKETS:]
        y = self.bias + np.bincount(x.text, weights=self.weights[x.place] * x.value, minlength=n) + dense @ self.weights[BUCKETS:]
        s, q = dense @ d, (dense * dense) @ (d * d)
        for f in range(v.shape[1]):
            part = v[x.place, f] * x.value
            s[:, f] += np.bincount(x.text, weights=part, minlength=n)
            q[:, f] += np.bincount(x.text, weights=part * part, minlength=n)
        return y + 0.5 * (s * s - q).sum(axis=1), s

    def scores(self, x: Sparse) -> np.ndarray:
        return logistic(self.sums(x, self.dense(x.dense))[0])


def logistic(y: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(y, -35.0, 35.0)))


def learn(x: Sparse, label: np.ndarray, metadata: tuple[str, ...], epochs: int = 12, batch: int = 256, rate: float = 0.15, ridge: float = 1e-5, min_steps: int = 300) -> Machine:
    """A machine from labelled vectors, whose dense part ends with the metadata.

    Small samples are gone through more often than `epochs` says, for `min_steps` steps.
    """
    width = len(STRUCTURE) + len(metadata)
    n = len(label)
    finite = np.where(np.isfinite(x.dense), x.dense, np.nan)
    known = np.isfinite(finite).any(axis=0) if n else np.zeros(width, dtype=bool)
    mean, scale = np.zeros(width), np.ones(width)
    if known.any():
        mean[known] = np.nanmean(finite[:, known], axis=0)
        scale[known] = np.maximum(np.nanstd(finite[:, known], axis=0), 1e-3)
    model = Machine(metadata, mean, scale)
    ones = float(label.sum())
    model.bias = float(np.log((ones + 1.0) / (n - ones + 1.0)))
    if ones in (0.0, float(n)):
        return model
    rng = np.random.default_rng(11)
    model.factors = rng.normal(0.0, 0.05, model.factors.shape)
    size = len(model.weights)
    g_bias, g_weights, g_factors = 1e-8, np.full(size, 1e-8), np.full(model.factors.shape, 1e-8)
    for _ in range(max(epochs, -(-min_steps // -(-n // batch)))):
        order = rng.permutation(n)
        for start in range(0, n, batch):
            chosen = order[start : start + batch]
            part = x.rows(chosen)
            dense = model.dense(part.dense)
            y, s = model.sums(part, dense)
            g = (logistic(y) - label[chosen]) / len(chosen)
            gx = g[part.text] * part.value
            step = np.concatenate((np.bincount(part.place, weights=gx, minlength=BUCKETS), dense.T @ g)) + ridge * model.weights
            squares = np.concatenate((np.bincount(part.place, weights=gx * part.value, minlength=BUCKETS), (dense * dense).T @ g))
            steps = ridge * model.factors - model.factors * squares[:, None]
            steps[BUCKETS:] += (dense * g[:, None]).T @ s
            for f in range(FACTORS):
                steps[:BUCKETS, f] += np.bincount(part.place, weights=gx * s[part.text, f], minlength=BUCKETS)
            g_bias += g.sum() ** 2
            model.bias -= rate * g.sum() / np.sqrt(g_bias)
            g_weights += step * step
            model.weights -= rate * step / np.sqrt(g_weights)
            g_factors += steps * steps
            model.factors -= 0.3 * rate * steps / np.sqrt(g_factors)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves no remainder."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _numbers(df: DataFrame, metadata: tuple[str, ...]) -> Column:
    """Metadata columns as doubles; those that the frame lacks are null."""
    there = {c.lower() for c in df.columns}
    log = [F.log1p(F.abs(F.col(f"`{c}`").try_cast("double"))) if c.lower() in there else F.lit(None).cast("double") for c in metadata]
    return F.array(*log) if log else F.array().cast("array<double>")


def _with_metadata(x: Sparse, column: pa.Array, width: int) -> Sparse:
    numbers = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)
    return Sparse(x.text, x.place, x.value, np.hstack([x.dense, numbers]))


def fit(df: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = METADATA, max_labelled: int = MAX_LABELLED) -> Machine:
    """Learn from documents (doc_id, text, metadata) and labels (doc_id, quality) that are not held out."""
    usable = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where(F.col("label") == F.col("other"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(max_labelled)
        .select("labelled", F.col("label").cast("double").alias("label"))
    )
    texts = df.select(F.col("doc_id").alias("document"), text_or_empty().alias("text"), _numbers(df, metadata).alias("numbers"))
    # at most max_labelled rows of two numbers: a proven bound
    chosen = texts.join(F.broadcast(usable), F.col("document") == F.col("labelled"))
    chosen = chosen.groupBy("labelled", "label").agg(F.min(F.struct("text", "numbers")).alias("row"))
    rows = chosen.select(F.col("labelled").cast("long").alias("labelled"), "label", "row.text", "row.numbers")
    width = len(metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, _STEP):
            x = _with_metadata(vectors_of(batch.column(2)), batch.column(3), width)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(x.text, minlength=batch.num_rows))).astype(np.int32))
            dense = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * x.dense.shape[1]), pa.array(x.dense.ravel()))
            places = pa.ListArray.from_arrays(ends, pa.array(x.place.astype(np.int32)))
            values = pa.ListArray.from_arrays(ends, pa.array(x.value.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places, values, dense], names=["labelled", "label", "place", "value", "dense"])

    schema = "labelled long, label double, place array<int>, value array<float>, dense array<double>"
    got = rows.mapInArrow(run, schema).toArrow().sort_by("labelled").combine_chunks()
    n, full = len(got), len(STRUCTURE) + width

    def flat(name: str) -> np.ndarray:
        return pa.concat_arrays(got[name].chunks).flatten().to_numpy(zero_copy_only=False) if n else np.zeros(0)

    counts = np.array([len(p) for p in got["place"]], dtype=np.int64)
    x = Sparse(np.repeat(np.arange(n), counts), flat("place").astype(np.int64), flat("value").astype(float), flat("dense").reshape(n, full))
    return learn(x, got["label"].to_numpy() if n else np.zeros(0), metadata)


def scored(df: DataFrame, model: Machine, columns: list[str] | None = None, name: str | None = None) -> DataFrame:
    """The frame's columns (or those named) and the score of every row.

    The score's column is `name`, by default `score` or the next free name.
    """
    kept = df.columns if columns is None else columns
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    frame = df.select(row.alias("row"), text_or_empty().alias("text"), _numbers(df, model.metadata).alias("numbers"))
    width = len(model.metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, _STEP):
            score = model.scores(_with_metadata(vectors_of(batch.column(1)), batch.column(2), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["row", "score"])

    out = frame.mapInArrow(run, T.StructType([frame.schema["row"], T.StructField("score", T.DoubleType())]))
    return out.select("row.*", F.col("score").alias(name or free_name(df, "score")))


def digest(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a machine learned from `labels`."""
    rows = scored(df, fit(df, labels, **options), ["doc_id"], "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
