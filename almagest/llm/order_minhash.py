"""Near-duplicate classes by Order MinHash and banded alignment.

Sketch. A text's runs of five words are labelled with their occurrence number. Each of
`sketches` hash functions picks the `picked` smallest of them; read in text order they
are one value. Two texts share a value if the smallest runs are common to both and stand
in the same order, so the chance follows edit similarity, not only common content. At a
similarity of 0.8 a long pair misses all 20 values of 4 runs with a chance below 1 in 30,000,
texts of 4 and 5 runs with one of 1 in 87.

Verification. The labelled runs of both texts are aligned in order, inside a band: an
alignment that reaches the threshold can't shift a run by more than the number of runs it
leaves out, so the band loses nothing. As labels make runs unique within a text, the best
alignment is the longest increasing sequence of common runs. The similarity is aligned
runs over all runs of both.

Work. Texts with equal words are one node. In every bucket all nodes are compared with
the one that shares the most values overall, which is the text that the others were made
from, and with the one that shares the fewest. Verified links make components, and only a
bucket with more than one of them stays open: mostly texts that share a passage and little
else. Their nodes get finer sketches: `FINE_SKETCHES` values of more runs, as many as leave
two texts just at the similarity a chance of `FINE_CHANCE` each, so that a shared passage
alone hardly makes a bucket. How many depends on a text's number of runs, in tiers that
overlap so far that two similar texts always have one in common. In the fine buckets every
node is compared with the best node, the best one of another component, and the last, and
once more with what is then the best of another component. Rows grow with the members
of the buckets there, never with their pairs.

What the pivots leave apart is searched exactly: all pairs of nodes of open buckets that are
still in different components and can reach the threshold. Two such texts share one of their
rarest labelled runs, the first fifth and one more in an order common to all (prefix filter),
and for the first shared one the runs after it must suffice in both (positional filter).
So every two similar texts that share a value of the first sketches are in one class. The
answer is one class per document; copies never appear in pairs.

Defined cases. A null text is an empty one; all texts without words are one class. Texts
of fewer than five words are one run and equal only to copies. The class is the smallest
id, null only if all ids are. Repeated rows are in one class. An empty table gives an empty
result. Other columns don't matter to the classes and pass through `keep_one`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.llm.common import (
    bytes_of,
    components,
    free_names,
    labelled,
    mixed,
    settled,
    shingles,
    sliced,
    text_or_empty,
    word_hashes,
)

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 20
PICKED = 4
#: Second pass: values per tier, chance that two texts just at the similarity share one of them,
#: width of a tier of numbers of runs, rounds of comparisons.
FINE_SKETCHES = 40
FINE_CHANCE = 0.2
TIER = 1.6
FINE_ROUNDS = 2
#: Rows of one run that one task compares with; a run with more is dealt over several.
BLOCK_ROWS = 2_000
_STEP = 2 << 20


def order_sketches(runs: np.ndarray, offsets: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """One row of values per text from its labelled runs."""
    n_texts = len(offsets) - 1
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(n_texts), counts)
    place = np.arange(len(runs)) - offsets[owner]
    need = np.minimum(counts, picked)
    # the smallest few of n hashes lie below this part of the range but for rare texts
    share = np.minimum(1.0, 16.0 / np.maximum(counts, 1))
    limit = np.where(share >= 1, np.uint64(0xFFFFFFFFFFFFFFFF), (share * 2.0**63).astype(np.uint64) << np.uint64(1))[owner]
    out = np.zeros((n_texts, sketches), dtype=np.uint64)
    for s in range(sketches):
        seed = np.uint64((s + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
        v = mixed(runs ^ seed)
        low = np.flatnonzero(v <= limit)
        few = np.flatnonzero(np.bincount(owner[low], minlength=n_texts) < need)
        if len(few):
            low = np.union1d(low, np.concatenate([np.arange(offsets[t], offsets[t + 1]) for t in few]))
        low = low[np.lexsort((v[low], owner[low]))]
        got = np.bincount(owner[low], minlength=n_texts)
        rank = np.arange(len(low)) - np.repeat(np.cumsum(got) - got, got)
        low = low[rank < picked]
        low = low[np.lexsort((place[low], owner[low]))]
        rank = np.arange(len(low)) - np.repeat(np.cumsum(need) - need, need)
        value = np.full(n_texts, seed, dtype=np.uint64)
        for i in range(picked):
            at = low[rank == i]
            t = owner[at]
            value[t] = (value[t] ^ (value[t] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + runs[at]
        out[:, s] = mixed(value)
    return out


def runs_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled runs and their offsets, word hashes and their offsets."""
    data, offsets = bytes_of(column)
    words, text = word_hashes(data, offsets)
    h, at = shingles(words, text, len(column), size)
    return labelled(h, at), at, words, np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(column)))))


def sketched(keyed: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, print, node, n_runs, values): node names the sequence of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in sliced(batches, 2, _STEP):
            runs, at, words, word_at = runs_of(batch.column(2), size)
            values = order_sketches(runs, at).view(np.int64)
            names = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(word_at[:-1], word_at[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(np.diff(at)), lists],
                names=["doc_id", "print", "node", "n_runs", "values"],
            )

    return keyed.mapInArrow(run, "doc_id long, print long, node binary, n_runs long, values array<long>")


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> int:
    """Length of the best in-order alignment of labelled runs inside the band."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    band = int((len(a) + len(b)) * (1 - similarity) / (1 + similarity)) + 1
    j = j[np.abs(i - j) <= band]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int = WORDS) -> DataFrame:
    """(a, b, similar) for pairs of nodes, from the texts that stand for the nodes."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, _STEP):
            a_runs, a_at, _, _ = runs_of(batch.column(2), size)
            b_runs, b_at, _, _ = runs_of(batch.column(3), size)
            found = []
            for k in range(batch.num_rows):
                x, y = a_runs[a_at[k] : a_at[k + 1]], b_runs[b_at[k] : b_at[k + 1]]
                n = aligned(x, y, similarity)
                found.append(n >= similarity * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], names=["a", "b", "similar"])

    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")
    return rows.mapInArrow(run, "a binary, b binary, similar boolean")


def tier_of(number: int, similarity: float) -> tuple[int, int, int]:
    """Tier `number`: the fewest runs of its texts, the runs that end it, and how many are picked.

    A text is in all tiers with lowest <= n_runs and similarity * n_runs < end, so that of two
    similar texts the longer one is in the tier that the shorter one begins.
    """
    lows, x = [], 1.0
    while len(lows) < number + 2:
        if not lows or ceil(x) > lows[-1]:
            lows.append(ceil(x))
        x *= TIER
    low, end = lows[number], lows[number + 1]
    union = max(low, ceil(1 / (1 - similarity) - 1e-9)) if similarity < 1 else low
    common = ceil(similarity * union - 1e-9)
    picked = max([k for k in range(1, min(low, 16) + 1) if comb(common, k) >= FINE_CHANCE * comb(union, k)], default=1)
    return low, end, picked


def fine_sketches(runs: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) entries of all tiers of the texts."""
    counts = np.diff(at)
    texts, values = [], []
    number = 0
    while counts.size and tier_of(number, similarity)[0] <= counts.max():
        low, end, picked = tier_of(number, similarity)
        inside = np.flatnonzero((counts >= low) & (similarity * counts < end))
        if len(inside):
            n = counts[inside]
            ends = np.append(0, np.cumsum(n))
            own = runs[np.repeat(at[inside] - ends[:-1], n) + np.arange(ends[-1])]
            got = order_sketches(mixed(own + np.uint64(number + 1)), ends, FINE_SKETCHES, picked)
            texts.append(np.repeat(inside, FINE_SKETCHES))
            values.append(got.ravel())
        number += 1
    if not texts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(texts), np.concatenate(values)


def _fine_entries(texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """(node, band, value) of texts (node, text) by their finer sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, _STEP):
            runs, at, _, _ = runs_of(batch.column(1), size)
            text, value = fine_sketches(runs, at, similarity)
            nodes = batch.column(0).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(np.full(len(text), -1, dtype=np.int32)), pa.array(value.view(np.int64))], names=["node", "band", "value"])

    return texts.select("node", "text").mapInArrow(run, "node binary, band int, value long")


def _buckets(entries: DataFrame) -> DataFrame:
    """(band, value, node, at) of the buckets with two nodes or more.

    `at` orders a bucket: a text that others were made from shares more values than they
    do, so the largest is the best pivot.
    """
    shared = entries.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = settled(entries.join(shared, ["band", "value"]), "omh-shared")
    scores = members.groupBy("node").agg(F.sum("n").alias("score"))
    return settled(members.join(scores, "node").withColumn("at", F.struct("score", "node")).drop("n", "score"), "omh-members")


def _pairs(near: DataFrame) -> DataFrame:
    return near.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _star(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of every member with its bucket's best and last pivot."""
    pivots = members.groupBy("band", "value").agg(F.max("at").alias("most"), F.min("at").alias("least"))
    both = F.explode(F.array_distinct(F.array("most.node", "least.node")))
    return _pairs(members.join(pivots, ["band", "value"]).select("node", both.alias("pivot")))


def _stars_across(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of every member with three pivots of its bucket that are in other components.

    The pivots are the best member, the best of those in another component, and the last.
    """
    member = F.struct("at.score", "at.node", "label")
    pivots = placed.groupBy("band", "value").agg(F.max(member).alias("most"), F.min(member).alias("least"))
    met = settled(placed.join(pivots, ["band", "value"]), "omh-met")
    second = met.where("label <> most.label").groupBy("band", "value").agg(F.max(member).alias("second"))
    # a bucket of one component has no second pivot and drops out
    three = met.join(second, ["band", "value"]).select("node", "label", F.explode(F.array("most", "second", "least")).alias("p"))
    return _pairs(three.where("label <> p.label").select("node", F.col("p.node").alias("pivot")))


def _placed(members: DataFrame, good: DataFrame) -> DataFrame:
    """Members with their component."""
    labels = components(good).withColumnRenamed("node", "l_node")
    placed = members.join(labels, F.col("node") == F.col("l_node"), "left").drop("l_node")
    return settled(placed.withColumn("label", F.coalesce("label", "node")), "omh-placed")


def _open_nodes(placed: DataFrame) -> DataFrame:
    """Nodes in buckets that hold more than one component."""
    several = placed.groupBy("band", "value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return settled(placed.join(several.select("band", "value"), ["band", "value"], "left_semi").select("node").distinct(), "omh-open")


def _node_runs(texts: DataFrame, size: int) -> DataFrame:
    """(node, n_runs, run) of texts (node, text): their labelled runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, _STEP):
            runs, at, _, _ = runs_of(batch.column(1), size)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(runs.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), lists], names=["node", "n_runs", "runs"])

    lists = texts.select("node", "text").mapInArrow(run, "node binary, n_runs long, runs array<long>")
    return lists.select("node", "n_runs", F.explode("runs").alias("run"))


def _reach(similarity: float) -> Column:
    """Whether two texts with a run at their places l_place and r_place can reach the similarity, if it is the first they share.

    With the runs after it, as many as l_runs + r_runs - n times the similarity must be
    common. Texts too different in length fail too.
    """
    most = F.least(F.col("l_runs") - F.col("l_place"), F.col("r_runs") - F.col("r_place")) + 1
    return most * (1 + similarity) >= (F.col("l_runs") + F.col("r_runs")) * similarity - 1e-6


def _rare_pairs(texts: DataFrame, labels: DataFrame, similarity: float, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): all pairs of nodes with different labels whose labelled runs can reach the similarity.

    Of n runs that reach it with another text's, all but (1 - similarity) * n are common, so
    two texts share a run among their first (1 - similarity) * n + 1 in any common order.
    The order is by the number of texts that have the run.
    """
    runs = settled(_node_runs(texts, size), "omh-runs")
    often = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # counted from the end, as the runs of one text only come first and meet nothing
    back = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("run")))
    first = F.floor(F.col("n_runs") * (1 - similarity) + 1e-6) + 1
    shared = runs.join(often, "run").withColumn("place", F.col("n_runs") - back + 1).where(F.col("place") <= first)
    kept = settled(shared.join(labels, "node"), "omh-rare")
    # one row per run, component and length is paired first, so that members of one component never meet
    groups = kept.groupBy("run", "label", "n_runs").agg(F.min("place").alias("place"), F.any_value("n").alias("n"))
    blocks = F.ceil(F.col("n") / block_rows)
    left = groups.select(
        "run", F.col("label").alias("l_label"), F.col("n_runs").alias("l_runs"), F.col("place").alias("l_place"),
        F.pmod(F.xxhash64("label", "n_runs"), blocks).alias("block"),
    )
    right = groups.select(
        "run", F.col("label").alias("r_label"), F.col("n_runs").alias("r_runs"), F.col("place").alias("r_place"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"),
    )
    met = left.join(right, (left["run"] == right["run"]) & (left["block"] == right["block"]) & (F.col("l_label") < F.col("r_label")) & _reach(similarity))
    met = settled(met.select(left["run"], "l_label", "l_runs", "r_label", "r_runs"), "omh-groups")
    a = kept.select("run", F.col("label").alias("l_label"), F.col("n_runs").alias("l_runs"), F.col("node").alias("l_node"), F.col("place").alias("l_place"))
    b = kept.select("run", F.col("label").alias("r_label"), F.col("n_runs").alias("r_runs"), F.col("node").alias("r_node"), F.col("place").alias("r_place"))
    both = met.join(a, ["run", "l_label", "l_runs"]).join(b, ["run", "r_label", "r_runs"]).where(_reach(similarity))
    return both.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")).distinct()


def links(nodes: DataFrame, keyed: DataFrame, similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """Verified (a, b) pairs of nodes with different words, whose components are the classes."""
    members = _buckets(nodes.where("n_runs > 0").select("node", F.posexplode("values").alias("band", "value")))
    wanted = members.select(F.col("node").alias("w_node")).distinct()
    stand_in = nodes.join(wanted, F.col("node") == F.col("w_node"), "left_semi").select(
        "node", F.col("doc_id").alias("n_doc"), F.col("print").alias("n_print")
    )
    texts = (
        keyed.join(stand_in, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("print") == F.col("n_print")))
        .select("node", "text")
        .dropDuplicates(["node"])
    )
    texts = settled(texts, "omh-texts")
    done = settled(verified(_star(members), texts, similarity, size), "omh-pairs")
    open_ = _open_nodes(_placed(members, done.where("similar")))
    if not open_.isEmpty():
        fine = _buckets(_fine_entries(texts.join(open_, "node", "left_semi"), similarity, size))
        for _ in range(FINE_ROUNDS):
            pairs = _stars_across(_placed(fine, done.where("similar")))
            fresh = settled(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), "omh-fresh")
            if fresh.isEmpty():
                break
            done = done.unionByName(settled(verified(fresh, texts, similarity, size), "omh-pairs"))
        # what the pivots left apart
        labels = components(done.where("similar")).withColumnRenamed("node", "l_node")
        known = open_.join(labels, F.col("node") == F.col("l_node"), "left").select("node", F.coalesce("label", "node").alias("label"))
        pairs = _rare_pairs(texts.join(open_, "node", "left_semi"), settled(known, "omh-known"), similarity, size)
        fresh = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        done = done.unionByName(settled(verified(fresh, texts, similarity, size), "omh-pairs"))
    return done.where("similar").select("a", "b")


def classes(df: DataFrame, similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """(doc_id, print, class_id, class_print, class_size) for every row."""
    text = text_or_empty()
    keyed = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))
    rows = settled(sketched(keyed, size), "omh-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first")
    nodes = settled(
        rows.groupBy("node")
        .agg(first, F.any_value("n_runs").alias("n_runs"), F.any_value("values").alias("values"))
        .select("node", "first.doc_id", "first.print", "n_runs", "values"),
        "omh-nodes",
    )
    labels = components(links(nodes, keyed, similarity, size)).withColumnRenamed("node", "c_node")
    placed = settled(
        rows.select("doc_id", "print", "node")
        .join(labels, F.col("node") == F.col("c_node"), "left")
        .select("doc_id", "print", F.coalesce("label", "node").alias("label")),
        "omh-labels",
    )
    heads = placed.groupBy("label").agg(first, F.count(F.lit(1)).alias("class_size"))
    heads = heads.select(F.col("label").alias("h_label"), F.col("first.doc_id").alias("class_id"), F.col("first.print").alias("class_print"), "class_size")
    return placed.join(heads, F.col("label") == F.col("h_label")).select("doc_id", "print", "class_id", "class_print", "class_size")


def near_duplicates(df: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, class_size) for every row of (doc_id, text)."""
    return classes(df, **options).select("doc_id", "class_id", "class_size")


def keep_one(df: DataFrame, **options) -> DataFrame:
    """The frame with one row per class: that of the smallest id."""
    doc, print_, shown, number = free_names(df, "head_doc", "head_print", "omh_print", "omh_number")
    heads = classes(df, **options).select(F.col("class_id").alias(doc), F.col("class_print").alias(print_)).distinct()
    rows = df.withColumn(shown, F.xxhash64(text_or_empty()))
    kept = rows.join(heads, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(shown) == F.col(print_)), "left_semi")
    # rows repeated in full are alike; one of them stays
    order = Window.partitionBy("doc_id", shown).orderBy(shown)
    return kept.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(shown, number)
