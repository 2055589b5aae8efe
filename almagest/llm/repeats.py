"""Removal of repeated byte strings by a common-prefix interval tree.

A sampled, bidirectional form of the enhanced suffix array:

1.  Anchors. In every window of `length` bytes the k-mer with the smallest hash (the
    leftmost of equals) is an anchor. The choice depends on the window's bytes alone, so
    two equal windows have their anchor at the same place. Only anchors whose k-mer
    occurs again can lie in a repeat.
2.  Contexts. Around such an anchor lie `length - k` bytes to the left and `length` to the
    right: all that a repeated window holding the anchor can cover. Equal contexts are
    one class with a count, so copies never meet each other pairwise.
3.  The tree. The contexts of one k-mer, sorted by their right parts, are the suffix array
    with its common-prefix lengths. A stack scan yields the prefix intervals. Inside an
    interval the left parts are sorted and scanned the same way: an interval of left
    extensions whose members differ in the next byte to the left, and which do not all lie
    in one child to the right, is a maximal repeat with all its occurrences.
4.  A repeat of at least `length` bytes covers its bytes at every occurrence.

K-mers with more than `max_classes` different contexts would be one large group; what they
cover is resolved exactly by counting windows, which aggregates before it shuffles. Their
repeats are listed by the tree all the same, for which one task holds all their contexts.

Defined cases. A null text is empty. Ids play no part: rows may share one or have none, and
rows of equal texts repeat each other entirely. Texts below
`length` bytes lose nothing. An empty table gives an empty result. Other columns are not
read. Matches never cross texts; strings are judged on the input alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import bytes_of, mixed, powers, settled, sliced, text_or_empty

LENGTH = 200
K = 48
MAX_CLASSES = 20_000
BLOCK = 1 << 20


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes that start at every position; depends on the bytes alone."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[:n])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = w - span
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows of texts that lie end to end."""
    where, hashes = [], []
    low = np.uint64((1 << 21) - 1)
    for a in range(0, len(data) - length + 1, BLOCK):
        b = min(a + BLOCK, len(data) - length + 1)
        h = kmer_hashes(data[a : b + length - 1], k)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least = sliding_min(packed, length - k + 1)
        starts = np.arange(a, b)
        text_end = ends[np.searchsorted(ends, starts, side="right")]
        at = np.unique((least[starts + length <= text_end] & low).astype(np.int64))
        where.append(at + a)
        hashes.append(h[at])
    if not where:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    positions, first = np.unique(np.concatenate(where), return_index=True)
    return positions, np.concatenate(hashes)[first]


KEY = ["k1", "k2"]


def _keyed(df: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text): what is removed depends on the text alone, so texts are
    known by two hashes and equal ones are handled once, with their number."""
    text = text_or_empty()
    keys = F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, text.alias("text"))


def find_anchors(keyed: DataFrame, length: int, k: int) -> DataFrame:
    """(tid, k1, k2, anchors): one row per text; tid is a number, short to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, 2):
            data, offsets = bytes_of(batch.column(2))
            at, h = anchors(data, offsets[1:], length, k)
            bounds = np.searchsorted(at, offsets)
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            pairs = pa.StructArray.from_arrays([pa.array((at - offsets[text]).astype(np.int64)), pa.array(h.view(np.int64))], names=["pos", "kmer"])
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pairs)
            tids = pa.array(np.arange(number, number + batch.num_rows))
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([tids, batch.column(0), batch.column(1), lists], names=["tid", *KEY, "anchors"])

    rows = keyed.select(*KEY, "text")
    return rows.mapInArrow(run, "tid long, k1 long, k2 long, anchors array<struct<pos:long,kmer:long>>")


def _around(text: bytes, p: int, length: int, k: int) -> tuple[bytes, int]:
    """Bytes around an anchor at byte p and how many of them lie before it."""
    start = max(0, p - (length - k))
    return text[start : p + length], p - start


def _listed(batch: pa.RecordBatch, text: int, at: int, length: int, k: int) -> tuple[list[int], list[bytes], list[int], pa.StructArray]:
    """Row, bytes and bytes before the anchor of all anchors listed in a batch."""
    owner, contexts, lefts = [], [], []
    lists = batch.column(at)
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    pos = flat.field("pos").to_numpy().tolist()
    for i, t in enumerate(batch.column(text).to_pylist()):
        data = t.encode()
        for j in range(ends[i], ends[i + 1]):
            context, left = _around(data, pos[j], length, k)
            owner.append(i)
            contexts.append(context)
            lefts.append(left)
    return owner, contexts, lefts, flat


def find_classes(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(tid, copies, pos, kmer, class, lo, hi) of the anchors listed in `at`: the class names
    the bytes around the anchor, lo before and hi from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, 1 << 20):
            owner, contexts, lefts, flat = _listed(batch, 2, 3, length, k)
            names = b"".join(hashlib.blake2b(c + p.to_bytes(4, "little"), digest_size=8).digest() for c, p in zip(contexts, lefts, strict=True))
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    flat.field("pos"),
                    flat.field("kmer"),
                    pa.array(np.frombuffer(names, dtype=np.int64)),
                    pa.array(lefts, pa.int32()),
                    pa.array([len(c) - p for c, p in zip(contexts, lefts, strict=True)], pa.int32()),
                ],
                names=["tid", "copies", "pos", "kmer", "class", "lo", "hi"],
            )

    rows = texts.select("tid", "copies", "text", "at")
    return rows.mapInArrow(run, "tid long, copies long, pos long, kmer long, class long, lo int, hi int")


def find_contexts(texts: DataFrame, classes: DataFrame, length: int, k: int) -> DataFrame:
    """(kmer, class, n, left, context): the bytes of classes, from one occurrence of each."""
    row = F.struct(F.col("first.pos").alias("pos"), "kmer", "class", "n")
    per_text = classes.groupBy(F.col("first.tid").alias("tid")).agg(F.collect_list(row).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, 1 << 20):
            _, contexts, lefts, flat = _listed(batch, 0, 1, length, k)
            yield pa.RecordBatch.from_arrays(
                [flat.field("kmer"), flat.field("class"), flat.field("n"), pa.array(lefts, pa.int32()), pa.array(contexts, pa.binary())],
                names=["kmer", "class", "n", "left", "context"],
            )

    rows = texts.select("tid", "text").join(per_text, "tid").select("text", "at")
    return rows.mapInArrow(run, "kmer long, class long, n long, left int, context binary")


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `width` bytes padded with zeros, and the true lengths."""
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    padded = b"".join(p.ljust(width, b"\0") for p in parts)
    return np.frombuffer(padded, dtype=np.uint8).reshape(len(parts), width), lengths


def _order(group: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order by group, then bytes, then length."""
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    return np.lexsort((lengths, *words.T[::-1], group))


def common_prefixes(group: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common-prefix length of every row with the one before it; -1 across groups."""
    out = np.full(len(rows), -1, dtype=np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        n = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
        out[1:] = np.where(group[1:] == group[:-1], n, -1)
    return out


def prefix_intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(common length, first row, last row) of all intervals of the tree from `least` on."""
    found, stack = [], []
    for i, n in enumerate([*lcp[1:], -1], start=1):
        start = i - 1
        while stack and stack[-1][0] > n:
            size, start = stack.pop()
            if size >= least:
                found.append((size, start, i - 1))
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, start))
    return found


def maximal_repeats(
    group: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int, k: int, context_left: int
) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes to the left, bytes to the right, members) of the maximal repeats of a chunk.

    `lefts` are reversed. Members are positions in the input lists; all are different
    (group, left, right) triples, and groups do not mix.
    """
    R, r_len = _matrix(rights, length)
    L, l_len = _matrix(lefts, context_left)
    order = _order(group, R, r_len)
    lcp = common_prefixes(group[order], R[order], r_len[order])
    nodes = prefix_intervals(lcp.tolist(), k)
    if not nodes:
        return
    left_rank = np.empty(len(L), dtype=np.int64)
    left_rank[_order(np.zeros(len(L), dtype=np.int64), L, l_len)] = np.arange(len(L))
    lengths, first, last = (np.array(c) for c in zip(*nodes, strict=True))
    budget = 60_000  # rows that are compared at once
    begin = 0
    while begin < len(nodes):
        sizes = np.cumsum(last[begin:] - first[begin:] + 1)
        end = begin + max(1, int(np.searchsorted(sizes, budget, side="right")))
        part = slice(begin, end)
        size = last[part] - first[part] + 1
        node = np.repeat(np.arange(begin, end), size)
        row = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[part], size)
        member = order[row]
        inner = np.lexsort((left_rank[member], node))
        node, row, member = node[inner], row[inner], member[inner]
        shared = common_prefixes(node, L[member], l_len[member])
        # only extensions that make a repeat long enough matter
        need = np.maximum(length - lengths[node], 0)
        cut = np.where(shared >= need, shared, -1)
        for extension, a, b in prefix_intervals(cut.tolist(), 0):
            right = int(lengths[node[a]])
            rows = np.sort(row[a : b + 1])
            # all in one child to the right: the child has the longer repeat
            if lcp[rows[0] + 1 : rows[-1] + 1].min() > right:
                continue
            yield int(extension), right, member[a : b + 1]
        begin = end


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole k-mers of a partition sorted by k-mer, about `rows` contexts at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            kmers = table.column("kmer").to_numpy()
            cut = int(np.searchsorted(kmers, kmers[-1], side="left"))
            if cut:
                yield table.slice(0, cut)
            held, count = table.slice(cut).to_batches(), table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


def _tree(classes: DataFrame, length: int, k: int, groups: bool) -> DataFrame:
    """Coverage of every class by maximal repeats, or with `groups` their memberships."""
    context_left = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, 4096):
            kmers = table.column("kmer").to_numpy()
            cut, contexts = table.column("left").to_pylist(), table.column("context").to_pylist()
            copies = table.column("n").to_numpy()
            lefts = [c[:p][::-1] for c, p in zip(contexts, cut, strict=True)]
            rights = [c[p:] for c, p in zip(contexts, cut, strict=True)]
            own = [np.flatnonzero(copies >= 2)]
            whole = ((len(lefts[i]), len(rights[i]), np.array([i])) for i in own[0] if len(contexts[i]) >= length)
            lo, hi = np.zeros(len(kmers), dtype=np.int64), np.zeros(len(kmers), dtype=np.int64)
            rows: list[tuple] = []
            for source in (whole, maximal_repeats(kmers, lefts, rights, length, k, context_left)):
                for left, right, members in source:
                    lo[members] = np.maximum(lo[members], left)
                    hi[members] = np.maximum(hi[members], right)
                    if groups:
                        i = int(members[0])
                        string = contexts[i][cut[i] - left : cut[i] + right]
                        name = hashlib.blake2b(string, digest_size=16).digest()
                        rows += [(int(m), name, left, right) for m in members]
            names = table.column("class").combine_chunks()
            if groups:
                m, name, left, right = zip(*rows, strict=True) if rows else ((), (), (), ())
                take = pa.array(m, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kmers).take(take), names.take(take), pa.array(name, pa.binary()), pa.array(left, pa.int32()), pa.array(right, pa.int32())],
                    names=["kmer", "class", "repeat", "lo", "hi"],
                )
            else:
                take = pa.array(np.flatnonzero(hi))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kmers).take(take), names.take(take), pa.array(lo, pa.int32()).take(take), pa.array(hi, pa.int32()).take(take)],
                    names=["kmer", "class", "lo", "hi"],
                )

    kind = "kmer long, class long, " + ("repeat binary, lo int, hi int" if groups else "lo int, hi int")
    rows = classes.select("kmer", "class", "left", "context", "n")
    return rows.repartition("kmer").sortWithinPartitions("kmer").mapInArrow(run, kind)


def _by_windows(classes: DataFrame, length: int, k: int) -> DataFrame:
    """Coverage of classes by counting every window: for k-mers with very many contexts."""
    size = F.octet_length("context")
    offsets = F.sequence(F.lit(0), F.lit(length - k))
    rows = classes.select("kmer", "class", "left", "context", "n", F.explode(offsets).alias("x"))
    rows = rows.where((F.col("x") <= F.col("left")) & (F.col("left") - F.col("x") + length <= size))
    window = F.substring(F.col("context"), F.col("left") - F.col("x") + 1, F.lit(length))
    rows = rows.select("kmer", "class", "n", "x", F.xxhash64(window).alias("w1"), F.xxhash64(F.lit(7), window).alias("w2"))
    keys = ["kmer", "x", "w1", "w2"]
    again = rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    return rows.join(again, keys).groupBy("kmer", "class").agg(
        F.max("x").cast("int").alias("lo"), F.max(length - F.col("x")).cast("int").alias("hi")
    )


class RepeatIndex:
    """Anchors that occur again, and the classes of their contexts, as written tables."""

    def __init__(self, df: DataFrame, length: int = LENGTH, k: int = K, max_classes: int = MAX_CLASSES):
        self.length, self.k = length, k
        self.keyed = _keyed(df)
        found = settled(find_anchors(self.keyed, length, k), "repeat-anchors")
        each = found.select("tid", F.inline("anchors"))
        again = each.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kmer")
        listed = each.join(again, "kmer", "left_semi").groupBy("tid").agg(F.collect_list(F.struct("pos", "kmer")).alias("at"))
        # equal texts list equal anchors; one of them stands for all
        listed = listed.join(found.select("tid", *KEY), "tid").groupBy(*KEY).agg(F.min(F.struct("tid", "at")).alias("one"))
        # from here on only the texts that hold such an anchor are needed
        once = self.keyed.groupBy(*KEY).agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        self.texts = settled(once.join(listed, KEY).select(*KEY, "one.tid", "copies", "text", "one.at"), "repeat-texts")
        self.members = settled(find_classes(self.texts, length, k), "repeat-members")
        # contexts that are equal are counted, so copies are one row
        names = self.members.groupBy("kmer", "class").agg(
            F.sum("copies").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct("tid", "pos")).alias("first")
        )
        names = settled(names, "repeat-names")
        per_kmer = names.groupBy("kmer").agg(F.count(F.lit(1)).alias("n_classes"))
        self.classes = settled(names.join(per_kmer, "kmer"), "repeat-classes")
        self.alone = self.classes.where("n_classes = 1")
        self.usual = self.classes.where(F.col("n_classes").between(2, max_classes))
        self.large = self.classes.where(F.col("n_classes") > max_classes)

    def _contexts(self, classes: DataFrame) -> DataFrame:
        return find_contexts(self.texts, classes, self.length, self.k)

    def coverage(self) -> DataFrame:
        """(kmer, class, lo, hi): bytes before and after the anchor that repeats cover."""
        # the only context of a k-mer is a leaf of the tree: all its occurrences are equal
        whole = self.alone.where((F.col("n") > 1) & (F.col("lo") + F.col("hi") >= self.length)).select("kmer", "class", "lo", "hi")
        tree = _tree(self._contexts(self.usual), self.length, self.k, False)
        out = whole.unionByName(tree)
        return out if self.large.isEmpty() else out.unionByName(_by_windows(self._contexts(self.large), self.length, self.k))

    def groups(self) -> DataFrame:
        """Maximal repeats: (repeat, length, doc_id, start), one row per occurrence.

        `repeat` names the repeated bytes. Repeats longer than the reach around an anchor
        appear as overlapping pieces. K-mers above `max_classes` are listed too; one task
        holds the contexts of a k-mer, which is memory in proportion to their number.
        """
        rows = self.members.select("tid", "pos", "kmer", "class").join(_tree(self._contexts(self.classes), self.length, self.k, True), ["kmer", "class"])
        rows = rows.select("repeat", (F.col("lo") + F.col("hi")).alias("length"), "tid", (F.col("pos") - F.col("lo")).alias("start")).distinct()
        documents = self.keyed.select("doc_id", *KEY).join(self.texts.select("tid", *KEY), KEY)
        return rows.join(documents.select("doc_id", "tid"), "tid").select("repeat", "length", "doc_id", "start")

    def spans(self) -> DataFrame:
        """(tid, spans): all covered stretches of a text, not yet merged."""
        rows = self.members.select("tid", "pos", "kmer", "class").join(self.coverage(), ["kmer", "class"])
        span = F.struct((F.col("pos") - F.col("lo")).alias("from"), (F.col("pos") + F.col("hi")).alias("to"))
        return rows.groupBy("tid").agg(F.collect_set(span).alias("spans"))

    def changed(self) -> DataFrame:
        """(k1, k2, kept, removed): remaining bytes and removed stretches of every text that
        loses something."""
        rows = self.texts.select("tid", *KEY, "text").join(self.spans(), "tid")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stretch = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            for batch in sliced(batches, 2):
                kept, removed = [], []
                for text, pairs in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                    data, pairs = text.encode(), pairs.values
                    a, b = merged(pairs.field("from").to_numpy(), pairs.field("to").to_numpy())
                    edges = [0, *np.column_stack((a, b)).ravel().tolist(), len(data)]
                    kept.append(b"".join(data[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)))
                    removed.append([{"from": x, "to": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(removed, stretch)],
                    names=[*KEY, "kept", "removed"],
                )

        kind = "k1 long, k2 long, kept binary, removed array<struct<from:long,to:long>>"
        return rows.select(*KEY, "text", "spans").mapInArrow(run, kind)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches; those that touch become one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.concatenate((new[1:], [True]))]


def remove_repeats(df: DataFrame, **options) -> DataFrame:
    """(doc_id, kept, removed) of every row: remaining bytes and removed stretches."""
    index = RepeatIndex(df, **options)
    rows = index.keyed.join(index.changed(), KEY, "left")
    none = F.array().cast("array<struct<from:long,to:long>>")
    return rows.select("doc_id", F.coalesce("kept", F.col("text").cast("binary")).alias("kept"), F.coalesce("removed", none).alias("removed"))


def digests(df: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Texts that lose nothing
    are digested where they are read and take no part in a shuffle."""
    index = RepeatIndex(df, **options)
    changed = index.changed().select(
        *KEY,
        F.octet_length("kept").cast("long").alias("n_kept"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    size, whole = F.octet_length("text").cast("long"), F.sha2(F.col("text").cast("binary"), 256)
    rows = index.keyed.select("doc_id", *KEY, size.alias("n_bytes"), whole.alias("whole_sha256"))
    return rows.join(changed, KEY, "left").select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )
