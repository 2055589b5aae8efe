"""Factorisation machine, norm-bucket search and vector codes against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from almagest.llm import factorisation, norm_buckets, part_codes
from tests.llm.helpers import SCHEMA, frame, odd_rows, values

SMALL = "/root/testdata/sf0.01"


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(1)
    texts = pa.array(["a b a c! D", "", None, "x " * 50, "é #1 #2 (a|b)\nc"])
    x = factorisation.vectors_of(texts)
    width = x.dense.shape[1]
    model = factorisation.Machine((), np.zeros(width), np.ones(width), 0.3)
    model.weights, model.factors = rng.normal(size=model.weights.shape), rng.normal(size=model.factors.shape)
    dense = model.dense(x.dense)
    for i, y in enumerate(model.sums(x, dense)[0]):
        full = np.zeros(len(model.weights))
        full[x.place[x.text == i]] = x.value[x.text == i]
        full[factorisation.BUCKETS :] = dense[i]
        used = np.flatnonzero(full)
        pairs = sum(model.factors[a] @ model.factors[b] * full[a] * full[b] for k, a in enumerate(used) for b in used[:k])
        assert y == pytest.approx(0.3 + full @ model.weights + pairs)


def test_statistics_do_not_depend_on_neighbours():
    texts = [t for _, t in odd_rows()]
    together = factorisation.vectors_of(pa.array(texts))
    for i, t in enumerate(texts):
        alone = factorisation.vectors_of(pa.array([t], pa.string()))
        assert np.allclose(alone.dense[0], together.dense[i])
        assert alone.place.tolist() == together.place[together.text == i].tolist()


def test_quality_on_rows_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in factorisation.digest(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for d, r in got.items())
    seen = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in seen if q == 1], [s for s, q in seen if q == 0]
    better = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert better > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.97


def test_labels_held_out_teach_nothing(spark):
    rows = [(i, ("calm words here " if i % 2 else "LOUD!! WORDS!! HERE!! ") * (3 + i % 7)) for i in range(200)]
    labels = [(i, i % 2) for i in range(200)]
    schema = "doc_id long, quality int"
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q) for d, q in labels]
    a, b = (factorisation.digest(frame(spark, rows), spark.createDataFrame(x, schema)) for x in (labels, turned))
    assert values(a, "doc_id", "score") == values(b, "doc_id", "score")
    assert {(r.doc_id % 2, r.predicted) for r in a.collect()} == {(0, 0), (1, 1)}


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, 0), (5, 1), (6, 1), (None, 1), (20, None), (21, 7), (90, 0), (91, 1)], "doc_id long, quality int")
    rows = odd_rows()
    got = factorisation.digest(frame(spark, rows), labels).collect()
    assert sorted((repr(r.doc_id) for r in got)) == sorted(repr(d) for d, _ in rows)
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    clashing = frame(spark, rows).selectExpr("doc_id", "text", "'x' AS n_chars", "1 AS score", "2 AS row", "3 AS numbers", "4 AS document", "5 AS labelled")
    out = factorisation.scored(clashing, factorisation.fit(clashing, labels))
    assert out.columns == [*clashing.columns, "score_"] and out.count() == len(rows)
    empty, no_labels = spark.createDataFrame([], SCHEMA), labels.limit(0)
    assert factorisation.digest(empty, labels).count() == 0
    assert {r.score for r in factorisation.digest(frame(spark, rows), no_labels).collect()} == {0.5}


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL_LETTERS = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_search(rows, items, top=10):
    docs = [(d, Counter(TERM.findall((t or "").translate(SMALL_LETTERS)))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for i, text in {(i, t or "") for i, t in items}:
        asked = TERM.findall(text.translate(SMALL_LETTERS))
        hits = []
        for d, c in docs:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked if c[t]}
            score = sum(weights[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score:
                hits.append((-score, d is None, d))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:top])]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark):
    rng = random.Random(2)
    rows = odd_rows() + [(1000 + i, " ".join(rng.choice("ab cd ef gh É1 xyz Don't".split()) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    rows += [(2000 + i, "ab cd ab cd") for i in range(30)] + [(None, "ab cd ab cd")] * 3
    items = [(1, "ab cd"), (2, "AB, ab; ab gh!"), (3, None), (4, ""), (5, "nothing there"), (6, "é1 É1 xyz"), (7, rows[8][1]), (7, "one line"), (None, "don t"), (1, "ab cd"), (8, "w1 w2 w3 w4 w5 w6 w7 w8")]
    queries = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, rank string")
    expected = brute_search(rows, items)
    for block_bytes in (norm_buckets.BLOCK_BYTES, 100):
        got = values(norm_buckets.search(frame(spark, rows), queries, block_bytes=block_bytes), "item_id", "rank", "doc_id", "score")
        assert got == expected


def test_search_of_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert norm_buckets.search(none, items).count() == 0
    assert norm_buckets.search(frame(spark, odd_rows()), items.limit(0)).count() == 0


def test_buckets_and_coordinates_prune():
    """Far fewer pairs are scored than exist, and the best stay the best."""
    rng = np.random.default_rng(4)
    n_terms, n, top = 400, 8000, 5
    weight = rng.integers(1, 9000, n_terms)
    query = np.repeat(np.arange(20), 12)
    term = np.concatenate([np.sort(rng.choice(n_terms, 12, replace=False)) for _ in range(20)])
    block = norm_buckets.Block([(q, "") for q in range(20)], {}, query, term, rng.integers(1, 4, len(query)), weight)
    terms = [np.sort(rng.choice(n_terms, rng.integers(1, 12), replace=False)) for _ in range(n)]
    impacts = [weight[t] * rng.integers(1, 1000, len(t)) for t in terms]
    length = np.array([math.sqrt(float((i.astype(float) ** 2).sum())) for i in impacts])
    order = np.argsort(-length)
    best, counts = norm_buckets.Best(np.ones(20, dtype=np.int64), top), np.zeros(3, dtype=np.int64)
    for start in range(0, n, norm_buckets.BUCKET_ROWS):
        rows = order[start : start + norm_buckets.BUCKET_ROWS]
        first = np.append(0, np.cumsum([len(terms[r]) for r in rows]))
        norm_buckets.scan(block, rows, length[rows], first, np.concatenate([terms[r] for r in rows]), np.concatenate([impacts[r] for r in rows]), best, counts)
    assert counts[1] < 0.95 * counts[0] and counts[2] < 0.1 * counts[1]
    for q in range(20):
        asked = dict(zip(term[query == q], block.times[query == q], strict=True))
        scores = [(-sum(asked.get(t, 0) * i for t, i in zip(terms[d], impacts[d], strict=True)), d) for d in range(n)]
        assert [(-s, d) for s, d in sorted(scores)[:top] if s] == [(s, d) for s, d in zip(best.score[q], best.doc[q], strict=True) if s]


def brute_codes(vectors, parts=8, entries=16, rounds=6):
    """Rows of (vec_id, label, integers) in any order -> codes, errors, codebooks."""
    first = sorted(vectors, key=lambda v: (v[0] is None, v[0] or 0, v[2]))
    width = len(first[0][2]) // parts
    cut = [[tuple(v[2][p * width : (p + 1) * width]) for p in range(parts)] for v in vectors]
    books = [[tuple(v[2][p * width : (p + 1) * width]) for v in first[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), e) for e, c in enumerate(books[p])) for p, y in enumerate(v)] for v in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, n in zip(cut, near, strict=True) if n[p][1] == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    near = assign()
    return [("".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n)) for n in near], np.array(books)


@pytest.mark.parametrize(("n", "spread", "seed"), [(400, 400, 1), (300, 3, 2), (9, 50, 3), (250, 0, 4)])
def test_codes_equal_brute_force(spark, n, spread, seed):
    rng = random.Random(seed)
    middles = [[rng.randint(-spread, spread) for _ in range(16)] for _ in range(30)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        rows.append((rng.choice([i, i, i // 2]), [(c + rng.randint(-spread // 9, spread // 9)) / 4096 for c in m], rng.choice([0, 1, None])))
    odd = [(-1, None, 1), (-2, [None, *[0.0] * 15], 1), (-3, [float("nan"), *[0.0] * 15], 1), (-4, [float("inf"), *[0.0] * 15], 1), (None, rows[0][1], 5)]
    odd += [(10**6, [0.5] * 15, 3), (10**6 + 1, [], 3), (10**6 + 2, [1e30] * 16, 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS code", "'x' AS x", "2 AS state")
    kept = [(v, lab, [math.floor(4096 * c) for c in e]) for v, e, lab in [*rows, odd[4]]]
    expected, books = brute_codes(kept)
    sums = Counter()
    for (_, lab, _), (_, error) in zip(kept, expected, strict=True):
        sums[lab] += error
    got = values(part_codes.coded(df), "vec_id", "code", "error", "label_error", "codebooks_sha256")
    digest = part_codes.books_sha256(books)
    want = [(v, c, e, sums[lab], digest) for (v, lab, _), (c, e) in zip(kept, expected, strict=True)]
    want += [(10**6 + k, None, None, None, digest) for k in range(3)]
    assert got == sorted(want, key=repr)


def test_bounds_save_distances():
    """Most parts keep their entry without any distance, and b shrinks."""
    rng = np.random.default_rng(3)
    x = (rng.integers(-3000, 3000, (16, 8))[rng.integers(0, 16, 4000)] + rng.integers(-200, 200, (4000, 8))).astype(np.int64)
    book, b = x[:16].copy(), 8
    state, computed, needed = part_codes.Bounds.fresh(x, book, b), 0, None
    for _ in range(6):
        moved = np.array([x[state.entry == e].sum(axis=0) // max(1, (state.entry == e).sum()) if (state.entry == e).any() else book[e] for e in range(16)])
        state.moved(np.sqrt(((moved - book) ** 2).sum(axis=1).astype(float)))
        book = moved
        if needed is not None:
            b = part_codes.next_b(np.bincount(needed, minlength=17), b)
        needed, some = state.settle(x, book, b)
        computed += some
        exact = part_codes.squared(x, book)
        assert (state.entry == exact.argmin(axis=1)).all()
        assert (state.upper**2 >= exact[np.arange(len(x)), state.entry]).all()
        again = part_codes.unpacked(part_codes.packed([state]), 1)[0]
        assert (again.upper >= state.upper).all() and (again.lower <= state.lower).all() and (again.outer <= state.outer).all()
    assert computed < 0.5 * 6 * 16 * len(x) and b < 8


def test_codes_of_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert part_codes.coded(spark.createDataFrame([], schema)).count() == 0
    assert part_codes.coded(spark.createDataFrame([(1, None, 2)], schema)).count() == 0
