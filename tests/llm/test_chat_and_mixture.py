"""Reply trees, soft mixtures and the pipeline's stages."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almagest.llm import decontamination, mixture, order_minhash, reply_trees, sharding
from almagest.llm.common import settled
from tests.llm.helpers import SCHEMA, frame, odd_rows

TURNS = "conv_id long, turn long, role string, text string, msg string"
MESSAGES = "conv_id long, msg long, parent long, role string, text string, score double"


def digests(spark, rows):
    df = spark.createDataFrame([(*r, "own") for r in rows], TURNS)
    messages = settled(reply_trees.by_turn(df), "test-messages")
    written = settled(reply_trees.formatted(messages, reply_trees.paths(messages, 1)), "test-texts")
    return {r.conv_id: r for r in reply_trees.read_back(written).collect()}


def test_formatting_is_reversible(spark):
    rng = random.Random(2)
    bits = ["<", "s>", "</s>", "[INST]", "[", "/INST]", "\\", "<<SYS>>", "<</SYS>>", " ", "é", "\n", "<<", "ROLE>>", "/", "漢"]
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, None, None), (-8, 1, "assistant", "")]
    rows += [(-9, 1, "assistant", "same"), (-9, 1, "assistant", "same"), (-9, None, "user", "first")]
    roles = ["user", "assistant", "system", "tool", "", "<<ROLE>>", None]
    for conv in range(80):
        rows += [(conv, t, rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for t in range(rng.randint(1, 6))]
    rows += [(200, t, "user" if t % 2 else "assistant", "x" * 2_000) for t in range(40)]
    got = digests(spark, rows)
    for conv in {r[0] for r in rows}:
        turns = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out = got[conv]
        assert (out.n_turns, out.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (out.loss_chars, out.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_trees_give_ranked_paths(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0),
        (1, 2, 1, "assistant", "a", 1.0),
        (1, 3, 1, "assistant", "b", 2.0),
        (1, 4, 2, "user", "aa", 5.0),
        (1, 5, 9, "user", "orphan", None),
        (1, 3, 1, "assistant", "b", 2.0),  # repeated in full
        (2, 1, 2, "user", "circle", 1.0),
        (2, 2, 1, "user", "circle", 1.0),
        (3, 7, 7, "user", "itself", 1.0),
        (4, 1, None, "user", "low", 0.0),  # one id, other texts: the higher score counts, then the smaller role and text
        (4, 1, None, "user", "high", 3.0),
        (4, 1, None, "tool", "high", 3.0),
        (4, 1, None, "tool", "higher", 3.0),
    ]
    messages = spark.createDataFrame(rows, MESSAGES)
    found = {(r.conv_id, r["rank"]): r.path for r in reply_trees.paths(messages).collect()}
    assert found == {(1, 1): [1, 2, 4], (1, 2): [1, 3], (1, 3): [5], (3, 1): [7], (4, 1): [1]}
    assert reply_trees.formatted(messages, reply_trees.paths(messages)).where("conv_id = 4").first().text == "<<ROLE>>tool<</ROLE>>high<</SYS>>"
    best = reply_trees.formatted(messages, reply_trees.paths(messages, 1)).where("conv_id = 1").first()
    assert best.text == "[INST] root [/INST]<s>a</s>[INST] aa [/INST]"
    assert [best.text[s.start : s.end] for s in best.loss] == ["a"]


def test_deep_chains_need_few_rounds(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(150)]
    [path] = reply_trees.paths(spark.createDataFrame(rows, MESSAGES)).collect()
    assert path.path == list(range(150))


def test_a_conversation_of_twenty_thousand_turns(spark):
    n = 20_000
    chain = spark.range(n).selectExpr(
        "1L conv_id", "id msg", "if(id > 0, id - 1, null) parent", "if(id % 2 = 0, 'user', 'assistant') role", "cast(id as string) text", "1.0D score"
    )
    found = reply_trees.steps(chain, 1)
    assert found.where("pos <> msg OR leaf <> 19999 OR score <> 20000.0D").isEmpty()
    assert (found.count(), found.distinct().count()) == (n, n)


def brute_paths(rows):
    """Root-to-leaf paths of a conversation {msg: (parent, score)}, best first."""
    above = {m: p if p in rows and p != m else None for m, (p, _) in rows.items()}
    out = []
    for leaf in set(rows) - set(above.values()):
        path = [leaf]
        while above[path[-1]] is not None and len(path) <= len(rows):
            path.append(above[path[-1]])
        if len(path) <= len(rows):
            out.append((-sum(rows[m][1] for m in path), leaf, path[::-1]))
    return [path for _, _, path in sorted(out)]


def test_random_trees_and_cycles_against_brute_force(spark):
    rng = random.Random(12)
    convs = {}
    for conv in [None, *range(40)]:
        n = rng.choice([1, 3, 8, 40])
        near = rng.choice([1, 2, n])  # the nearer the parents, the deeper the trees
        rows = {m: (rng.choice([max(0, m - rng.randint(1, near)), None, 99]) if rng.random() < 0.2 else max(0, m - rng.randint(1, near)), float(rng.randint(0, 3))) for m in range(n)}
        if rng.random() < 0.5:
            rows[rng.randrange(n)] = (rng.randrange(n), 1.0)  # maybe a cycle
        convs[conv] = rows
    messages = spark.createDataFrame([(c, m, p, "user", "", s) for c, rows in convs.items() for m, (p, s) in rows.items()], MESSAGES)
    got = {}
    for r in reply_trees.paths(messages).collect():
        got.setdefault(r.conv_id, {})[r["rank"]] = r.path
    assert {c: [p[i] for i in sorted(p)] for c, p in got.items()} == {c: b for c, rows in convs.items() if (b := brute_paths(rows))}


def test_no_conversations(spark):
    assert digests(spark, []) == {}


def test_parse_refuses_other_text():
    with pytest.raises(ValueError):
        reply_trees.parse("[INST] a [/INST] b")


def brute_rates(p, t, targets, rounds=4_000):
    """Weighted nonnegative least squares in the metric of the token counts."""
    r, expected = np.ones(len(p)), (p * t[:, None]).sum(axis=0)
    for _ in range(rounds):
        r = np.maximum(0, r - 0.2 * (p @ (((r * t) @ p - targets) / expected)))
    return r


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(0, 500, 400)
    rows = [(i, i, int(n), [float(v) for v in q]) for i, (q, n) in enumerate(zip(p, t, strict=True))]
    member = spark.createDataFrame(rows, "doc_id long, print long, n_tokens long, p array<double>")
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    rates = mixture.fit_rates(member, list(weights), weights, rounds=200, tolerance=1e-9)
    assert np.allclose(rates.totals, rates.targets, rtol=0.02)
    got = np.array([r.rate for r in rates.applied(member).orderBy("doc_id").collect()])
    assert (got >= 0).all() and np.allclose((got * t) @ p, rates.totals)
    best = brute_rates(p, t.astype(float), rates.targets)
    assert np.abs((best * t) @ p - rates.targets).max() <= 0.02 * rates.targets.max()


def corpus(n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(["vile", "nasty", "horrid", "awful"], 3):
                words[rng.randrange(60)] = w
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_posteriors_on_held_out_rows_and_mixing(spark):
    rows, labels = corpus()
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    weights = {"clean": 1.0, "toxic": 0.0}
    rated, _ = mixture.rated(docs, mixture.quality_domains(table), weights)
    out = {r.doc_id: r for r in rated.collect()}
    held = [i for i in range(400) if i % 2]
    right = sum((out[i].p[1] > 0.5) == (i % 5 == 0) for i in held) / len(held)
    assert right >= 0.9
    mixed = mixture.mix(docs, mixture.quality_domains(table), weights)
    assert mixed.columns == docs.columns
    kept = {r.doc_id for r in mixed.collect()}
    assert sum(i in kept for i in held if i % 5 == 0) <= 4
    assert sum(i in kept for i in held if i % 5) >= 0.95 * sum(i % 5 != 0 for i in held)


def test_mixture_of_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, domain string")
    docs = frame(spark, odd_rows())
    out, _ = mixture.rated(docs, labels, {"a": 1.0, "b": 1.0})
    assert out.count() == docs.count() and out.where("rate < 0 OR copies IS NULL").count() == 0
    assert mixture.mix(spark.createDataFrame([], SCHEMA), labels, {"a": 1.0}).count() == 0


def test_copies_follow_the_rates(spark):
    """Totals of tokens keep to the rates in every domain, and each number is one of the two nearest."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(6000):
        p = rng.dirichlet([8.0, 0.3, 0.3])[rng.permutation(3)]
        rows.append((i, i, int(rng.integers(0, 400)), [float(v) for v in p], float([1.3, 0.96, 0.4][int(p.argmax())])))
    rows += [(-1, 5, 100, [1.0, 0.0, 0.0], 2.5)] * 3 + [(None, 7, 50, [0.0, 1.0, 0.0], 1.0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, print long, n_tokens long, p array<double>, rate double")
    got = mixture.with_copies(df, group_rows=1000).collect()
    assert len(got) == len(rows) and len({r.copies for r in got if r.doc_id == -1}) == 1 and {r.copies for r in got if r.doc_id is None} == {1}
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    t, p = np.array([r.n_tokens for r in got]), np.array([r.p for r in got])
    wanted, given = (np.array([getattr(r, c) for r in got]) * t @ p for c in ("rate", "copies"))
    assert np.allclose(given, wanted, rtol=0.005)
    empty = [r for r in got if r.n_tokens == 0]
    assert len(empty) > 5 and {r.copies - int(r.rate) for r in empty} == {0, 1}


def three_domains():
    rng = random.Random(4)
    words = {d: [f"{d}{i}" for i in range(40)] for d in "abc"}
    rows, labels = [], []
    for i in range(900):
        d = "aaaabbbbc"[i % 9]
        rows.append((i, " ".join(rng.choice(words[d]) if rng.random() < 0.7 else f"n{rng.randrange(500)}" for _ in range(rng.randint(20, 200)))))
        if i % 2:
            labels.append((i, d))
    return rows, labels


def test_copies_meet_the_targets(spark):
    """Realised tokens within 2 % of the targets in every domain: planted domains and the given tables."""
    rows, labels = three_domains()
    small = "/root/testdata/sf0.01"
    given, table = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    cases = [
        (frame(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string"), {"a": 0.3, "b": 0.5, "c": 0.2}),
        (given, mixture.quality_domains(table), mixture.WEIGHTS),
    ]
    for docs, domains, weights in cases:
        out, rates = mixture.rated(docs, domains, weights)
        got = out.collect()
        total = np.array([r.copies * r.n_tokens for r in got]) @ np.array([r.p for r in got])
        sought = rates.targets > 0
        assert np.allclose(total[sought], rates.targets[sought], rtol=0.02)
        assert total[~sought].sum() <= 0.02 * rates.targets.sum()


def test_languages_are_domains(spark):
    docs = spark.createDataFrame([(1, "en"), (2, "fr"), (3, None), (4, "en"), (5, "de")], "doc_id long, lang string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, None), (9, 0), (None, 0)], "doc_id long, toxic int")
    assert {(r.doc_id, r.domain) for r in mixture.language_domains(docs, labels).collect()} == {(1, "en"), (2, "toxic"), (3, None), (4, None)}


CLASHES = "head_doc head_print omh_print omh_number leak_doc leak_print bench_print mix_doc mix_print mix_copies mixture_print row id size ring cell salt salts place offset low high first node label print run value band text_crc32"


def test_no_helper_column_clashes(spark):
    """Frames that have the names of all helper columns pass through with their own values."""
    docs = frame(spark, odd_rows()).drop("size", "print")
    names = [c for c in CLASHES.split() if c not in docs.columns]
    df = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    labels = spark.createDataFrame([(20, "a"), (100, "b")], "doc_id long, domain string")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    kept = order_minhash.keep_one(df)
    out = [kept, decontamination.drop_leaks(df, items), mixture.mix(df, labels, {"a": 1.0, "b": 1.0})]
    for o in out:
        assert o.columns == df.columns
        first = o.first()
        assert [first[c] for c in names] == list(range(len(names)))
    placed = sharding.shard(df, 5)
    assert placed.columns == [c for c in df.columns if c not in ("size", "text_crc32")] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert placed.count() == df.count() and out[1].count() == df.count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settled(stage(spark, docs, folder), f"test-{name}")
        assert out.columns == docs.columns
        left = {r.doc_id for r in out.collect()}
        assert left and left <= ids
        docs, ids = out, left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == docs.count() and {r.shard for r in last} <= set(range(24))
