"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives every document its posteriors over
domains, p_dk. Rates r_d >= 0 are sought so that the expected tokens of the domains,
sum_d r_d t_d p_dk, meet the targets T_k: nonnegative least squares, each domain's error
relative to its size. Projected gradient in the metric of the token counts starts at rate
1 and steps

    R_k = (sum_d r_d t_d p_dk - T_k) / E_k        E_k: expected tokens at rate 1
    z_d = max(-DEAD, z_d - step * sum_k p_dk R_k)

where the rate r_d is z_d brought nearer to 1 by DEAD, and 1 where that reaches it. Documents
that the targets hardly ask to change so keep the rate 1 exactly, and the others make up
for them, as the residuals are those of the rates and not of z. A rate is a function of the
document's posteriors and the few residuals so far. A round is one pass that sums K numbers;
nothing per document is kept between rounds, and a lost executor only repeats its part of
the pass.

A rate becomes the whole number of copies below or above it. Documents are dealt by a hash of
the id into groups of one leading domain and about `GROUP_ROWS` rows; a group is gone through
from its longest document to its shortest, and each rounds to the side that brings the tokens
given so far closest to those that the rates ask for. What is lost in a group is so at most half of
one of its shortest documents, and the copies' totals keep to the totals of the rates.

Defined cases. Null texts are empty: no tokens, posteriors of an empty text; documents without
tokens round by a hash. Labels that are null or contradict each other are not used; with
fewer than two labelled domains every document belongs to the only one (or to the first
target). Repeated rows get equal rates and copies. An empty table gives an empty result. Other
columns pass through `mix`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import WORD, free_names, settled, sliced, text_or_empty
from almagest.llm.quality_rules import RATIOS, STATISTICS, features, statistics_of

#: Bounds of what the classifier is learned from: labelled rows and words of its vocabulary.
MAX_LABELLED = 8_000
MAX_VOCABULARY = 160
MARKS = ".,;:!?\"'()[]{}«»¿¡*#$%&|<>"
ROUNDS = 60
#: Part of a rate's distance from 1 that is not followed.
DEAD = 0.1
GROUP_ROWS = 8192
_WORDS = re.compile(WORD)


def plain_words(text: str) -> set[str]:
    return {w.strip(MARKS) for w in set(text.lower().split())} - {""}


def _matrix(texts: list[str], vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and numbers of words of texts."""
    stats = np.array([statistics_of(t) for t in texts], dtype=float).reshape(len(texts), len(STATISTICS))
    named = {c: stats[:, i] for i, c in enumerate(STATISTICS)}
    ratios = np.column_stack([features(named)[f] for f in RATIOS] + [np.log1p(named["n_words"])])
    place = {w: i for i, w in enumerate(vocabulary)}
    words = np.zeros((len(texts), len(vocabulary)))
    for i, t in enumerate(texts):
        for w in plain_words(t) & place.keys():
            words[i, place[w]] = 1.0
    return np.hstack([ratios, words]), named["n_words"].astype(np.int64)


@dataclass
class Classifier:
    domains: list[str]
    vocabulary: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (features + 1, domains)

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        x, n_words = _matrix(texts, self.vocabulary)
        return softmax(self._design(x) @ self.weights), n_words

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sample(df: DataFrame, labelled: DataFrame, max_labelled: int) -> DataFrame:
    """(doc, domain, text): at most `max_labelled` labelled ids, in the order of a hash."""
    usable = (
        labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull())
        .groupBy(F.col("doc_id").alias("doc"))
        .agg(F.min("domain").alias("domain"), F.max("domain").alias("other"))
        .where(F.col("domain") == F.col("other"))
        .orderBy(F.xxhash64("doc"), "doc")
        .limit(max_labelled)
        .select("doc", "domain")
    )
    texts = df.select(F.col("doc_id").alias("d"), text_or_empty().alias("text"))
    # at most max_labelled rows of two values: a proven bound
    rows = texts.join(F.broadcast(usable), F.col("d") == F.col("doc")).groupBy("doc", "domain").agg(F.min("text").alias("text"))
    return settled(rows, "mixture-sample")


def learn(df: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = MAX_LABELLED, max_vocabulary: int = MAX_VOCABULARY) -> Classifier:
    """Multinomial logistic regression over text statistics and telling words."""
    sample = _sample(df, labelled.where(F.col("domain").isin(domains)), max_labelled)
    sizes = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 1 << 20):
            rows = [(d, w) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in plain_words(t)]
            if rows:
                d, w = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(w)], names=["domain", "word"])

    vocabulary: list[str] = []
    if len(sizes) > 1:
        counts = sample.select("domain", "text").mapInArrow(words, "domain string, word string").groupBy("word").pivot("domain", list(sizes)).count().na.fill(0)
        total = sum(sizes.values())
        seen = sum((F.col(f"`{d}`") for d in sizes), F.lit(0))

        def telling(d: str) -> Column:
            inside = (F.col(f"`{d}`") + 0.5) / (sizes[d] + 1.0)
            outside = (seen - F.col(f"`{d}`") + 0.5) / (total - sizes[d] + 1.0)
            return F.col(f"`{d}`") * F.log(inside / outside)

        # every domain names its share of the words, so that none crowds out another's
        scores = settled(counts.select("word", *[telling(d).alias(f"s{i}") for i, d in enumerate(sizes)]), "mixture-words")
        # and none that chance may name among so many: the score is half a likelihood ratio's logarithm
        chance = 2 * np.log(max(scores.count(), 2))
        for i in range(len(sizes)):
            top = scores.where(F.col(f"s{i}") > float(chance)).orderBy(F.desc(f"s{i}"), "word").limit(max_vocabulary // len(sizes))
            vocabulary += [r[0] for r in top.collect()]
        vocabulary = sorted(set(vocabulary))

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, 1 << 20):
            x, _ = _matrix(batch.column(2).to_pylist(), vocabulary)
            flat = pa.array(x.astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc", "domain", "x"])

    rows = sample.select(F.col("doc").cast("long").alias("doc"), "domain", "text").mapInArrow(design, "doc long, domain string, x array<float>").toPandas().sort_values("doc")
    width = len(RATIOS) + 1 + len(vocabulary)
    if not len(rows):
        flat = np.zeros((width + 1, len(domains)))
        flat[-1, 0] = 30.0
        return Classifier(domains, vocabulary, np.zeros(width), np.ones(width), flat)
    x = np.stack(rows["x"].to_numpy()).astype(float)
    y = np.array([domains.index(d) for d in rows["domain"]])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    model = Classifier(domains, vocabulary, mean, scale, np.zeros((width + 1, len(domains))))
    model.weights = _fit_softmax(model._design(x), y, len(domains))
    return model


def _fit_softmax(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    target = np.eye(k)[y]
    there = target.any(axis=0)
    w, speed = np.zeros((x.shape[1], k)), np.zeros((x.shape[1], k))
    w[-1, ~there] = -30.0  # a domain without labels is never predicted
    step = rate * 4 / np.linalg.norm(x, 2) ** 2 * len(x)
    for _ in range(rounds):
        ahead = w + 0.9 * speed
        g = x.T @ (softmax(x @ ahead) - target) / len(x) + ridge * ahead
        g[:, ~there] = 0
        speed = 0.9 * speed - step * g
        w = w + speed
    return w


def posteriors(df: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, print, n_tokens, p): tokens are words; p is in the order of the domains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, 2 << 20):
            p, n = model.posteriors(batch.column(2).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), lists], names=["doc_id", "print", "n_tokens", "p"])

    text = text_or_empty()
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, print long, n_tokens long, p array<double>")


def replay(p: np.ndarray, residuals: list[np.ndarray], step: float) -> np.ndarray:
    """Rates of documents with posteriors p after the rounds that left these residuals."""
    z = np.ones(len(p))
    for g in residuals:
        z = np.maximum(-DEAD, z - step * (p @ g))
    return 1 + np.sign(z - 1) * np.maximum(np.abs(z - 1) - DEAD, 0.0)


def _lists(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), k)


@dataclass
class Rates:
    domains: list[str]
    residuals: list[np.ndarray]
    step: float
    targets: np.ndarray
    totals: np.ndarray  # expected tokens at the last rates

    def applied(self, member: DataFrame) -> DataFrame:
        """`member` with its rate."""
        k, residuals, step = len(self.domains), self.residuals, self.step

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r = replay(_lists(batch.column(3), k), residuals, step)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])

        return member.mapInArrow(run, "doc_id long, print long, n_tokens long, p array<double>, rate double")


def fit_rates(member: DataFrame, domains: list[str], weights: dict[str, float], budget: float | None = None, rounds: int = ROUNDS, tolerance: float = 1e-3) -> Rates:
    """Least-squares rates for token targets `budget * weights`.

    Without a budget it is as large as the domain with the largest weight allows at rate 1.
    Rounds end when every domain is within `tolerance` of its target (within a hundredth of the
    budget, where the target is 0: posteriors are never quite 0), or where targets can't
    be met, when the totals stand still.
    """
    k = len(domains)
    share = np.array([weights.get(d, 0.0) for d in domains])
    share = share / share.sum()

    def totals(residuals: list[np.ndarray], step: float) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got, gram = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    p = _lists(batch.column(3), k)
                    t = batch.column(2).to_numpy().astype(float)
                    got += (replay(p, residuals, step) * t) @ p
                    gram += (p * t[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate((got, gram.ravel())))], names=["i", "v"])

        sums = {r[0]: r[1] for r in member.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        return np.array([sums.get(i, 0.0) for i in range(k + k * k)])

    first = totals([], 0.0)
    expected, gram = np.maximum(first[:k], 1e-9), first[k:].reshape(k, k)
    if budget is None:
        largest = int(share.argmax())
        budget = expected[largest] / share[largest]
    targets = budget * share
    # the step that fits the steepest direction of the problem at rate 1
    steepest = np.linalg.eigvals(gram / expected[:, None]).real.max() if expected.sum() > 1e-6 else 1.0
    step = 1.0 / max(float(steepest), 1e-9)
    residuals: list[np.ndarray] = []
    now = first[:k]
    for _ in range(rounds):
        r = (now - targets) / expected
        residuals.append(r)
        after = totals(residuals, step)[:k]
        moved = np.abs(after - now).max() / max(expected.sum(), 1e-9)
        now = after
        if (np.abs(now - targets) <= np.where(targets > 0, tolerance * targets, 0.01 * budget)).all() or moved < tolerance / 100:
            break
    return Rates(domains, residuals, step, targets, now)


def with_copies(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (doc_id, print, n_tokens, p, rate) with their whole numbers of copies.

    Rows that are equal in doc_id and print get equal numbers.
    """
    once = rows.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("times"), F.first(F.struct("n_tokens", "p", "rate")).alias("v"))
    once = settled(once.select("doc_id", "print", "times", "v.*"), "mixture-once")
    groups = max(1, -(-once.count() // group_rows))
    lead = F.array_position("p", F.array_max("p"))
    group = F.pmod(F.xxhash64(F.lit("group"), "doc_id", "print"), F.lit(groups))
    dealt = once.withColumns({"lead": lead, "group": group}).repartition("lead", "group")
    ordered = dealt.sortWithinPartitions("lead", "group", F.desc("n_tokens"), F.xxhash64(F.lit("copies"), "doc_id", "print"), "doc_id", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, missing = None, 0.0
        for batch in batches:
            out = []
            tokens, rate, times = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_tokens", "rate", "times"))
            lead, group, chance = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lead", "group", "chance"))
            for t, r, n, k, u in zip(tokens, rate, times, zip(lead, group, strict=True), chance, strict=True):
                if k != current:
                    current, missing = k, 0.0
                low = int(r)
                if r == low:
                    out.append(low)
                    continue
                if t == 0:
                    out.append(low + (u < r - low))
                    continue
                want = missing + (r - low) * t * n
                more = want * 2 > t * n
                missing = want - more * t * n
                out.append(low + more)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.int64())], names=[*batch.schema.names[:6], "copies"])

    chance = F.shiftrightunsigned(F.xxhash64(F.lit("copies"), "doc_id", "print"), 11) * F.lit(2.0**-53)
    columns = ordered.select("doc_id", "print", "times", "n_tokens", "p", "rate", "lead", "group", chance.alias("chance"))
    out = columns.mapInArrow(run, "doc_id long, print long, times long, n_tokens long, p array<double>, rate double, copies long")
    return settled(out, "mixture-copies").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("time", "times")


def rated(df: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None) -> tuple[DataFrame, Rates]:
    """(doc_id, print, n_tokens, p, rate, copies) of all rows, and the fitted rates.

    `labelled` has (doc_id, domain); `weights` the wanted share of tokens per domain.
    """
    domains = list(weights)
    member = settled(posteriors(df, learn(df, labelled, domains)), "mixture-members")
    rates = fit_rates(member, domains, weights, budget)
    return with_copies(rates.applied(member)), rates


def mix(df: DataFrame, labelled: DataFrame, weights: dict[str, float], **options) -> DataFrame:
    """The frame with every row as often as its rate says: dropped, kept or repeated."""
    rows, _ = rated(df, labelled, weights, **options)
    doc, print_, number, name = free_names(df, "mix_doc", "mix_print", "mix_copies", "mixture_print")
    wanted = rows.where(F.col("copies") > 0).select(F.col("doc_id").alias(doc), F.col("print").alias(print_), F.col("copies").alias(number)).distinct()
    out = df.withColumn(name, F.xxhash64(text_or_empty()))
    kept = out.join(wanted, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(name) == F.col(print_)))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(number)))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns], again.alias(name)).drop(name)


def quality_domains(labels: DataFrame) -> DataFrame:
    """Domains of a table of labels (doc_id, quality, toxic)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "rough").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def language_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Domains of labelled documents: toxic, or else the language that `docs` names."""
    langs = docs.select(F.col("doc_id").alias("lang_doc"), F.col("lang").alias("lang"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, F.col("lang"))
    return labels.join(langs, F.col("doc_id") == F.col("lang_doc")).select("doc_id", domain.alias("domain"))


#: Shares of tokens that the registered query aims at.
WEIGHTS = {"clean": 0.97, "rough": 0.03, "toxic": 0.0}
