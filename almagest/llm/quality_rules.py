"""Quality rules as a learned decision list.

Statistics of whole texts are computed in Arrow batches. From labelled rows, sequential
covering learns an ordered list of rules, each a conjunction of thresholds: a rule is
grown condition by condition on one part of the labels (information gain), pruned from
its end on the other part, and kept only while it is precise there; the rows it covers
are then set aside. The list leaves as one ordered Spark conditional expression, so the
verdict on all documents is a native column.

Defined cases. A null text has no words and fails the base rule. Labels that are null,
or that exist several times for a document with different values, are not used. Without
usable labels of both kinds the list is empty and only the base rule decides. Equal
rows get equal verdicts. All other columns of the input pass through untouched, also
those whose names clash with the statistics (they live in one struct, renamed if needed).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.llm.common import WORD, free_name, sliced

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Bound of the labelled sample that is brought to the driver to learn from.
MAX_LABELLED = 20_000

STATISTICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_chars",
    "n_lines",
    "n_distinct_words",
    "n_top_word",
    "n_upper",
    "n_digits",
    "n_marks",
)
STATISTICS_TYPE = T.StructType([T.StructField(c, T.LongType(), False) for c in STATISTICS])

#: Features of the rules: statistic over statistic.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "top_word_share": ("n_top_word", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}

_WORDS = re.compile(WORD)
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"


def repeated_windows(words: list[str], size: int = 3) -> int:
    """Words lying in a window of `size` words that occurs twice or more in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(STATISTICS)
    words = _WORDS.findall(text)
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, len(text), 0, 0, 0, 0, 0, 0)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    counts = Counter(words)
    plain = text.encode("ascii", "ignore")
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_windows(words),
        len(text),
        len(lines),
        len(counts),
        max(counts.values()),
        len(plain) - len(plain.translate(None, _UPPER)),
        len(plain) - len(plain.translate(None, _DIGITS)),
        text.count("!") + text.count("?"),
    )


def with_statistics(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """The frame with the struct column `name` of whole-text statistics."""
    if df.schema[text].dataType != T.StringType():
        df = df.withColumn(text, F.col(text).cast("string"))
    at = df.columns.index(text)
    kind = pa.struct([pa.field(c, pa.int64(), False) for c in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            rows = [statistics_of(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            stats = pa.StructArray.from_arrays(columns, fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, STATISTICS_TYPE, True)]))


def base_failed(stats: str) -> Column:
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # > threshold, else <=
    threshold: float

    def column(self, stats: str) -> Column:
        a, b = (F.col(f"{stats}.{c}").cast("double") for c in RATIOS[self.feature])
        value = F.when(b > 0, a / b).otherwise(F.lit(0.0))
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def features(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, (a, b) in RATIOS.items():
        top, bottom = stats[a].astype(float), stats[b].astype(float)
        out[name] = np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)
    return out


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, cuts: int) -> tuple[float, Condition | None]:
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    before = np.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (1e-9, None)
    for name, values in x.items():
        v, y = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        ends = np.flatnonzero(np.diff(v))  # a cut lies between two different values
        if not len(ends):
            continue
        if len(ends) > cuts:
            ends = ends[np.unique(np.linspace(0, len(ends) - 1, cuts).astype(int))]
        low = np.cumsum(y)[ends].astype(float)
        for above, p, total in ((False, low, ends + 1.0), (True, p0 - low, len(v) - ends - 1.0)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / total) - before), -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                middle = float((v[ends[k]] + v[ends[k] + 1]) / 2)
                best = (float(gain[k]), Condition(name, above, middle))
    return best


def learn(
    stats: dict[str, np.ndarray],
    bad: np.ndarray,
    fold: np.ndarray,
    max_rules: int = 20,
    max_conditions: int = 5,
    min_precision: float = 0.95,
    min_covered: int = 5,
    cuts: int = 256,
) -> list[Rule]:
    """Ordered rules whose rows are bad. `fold` (0, 1, 2) sends a third to pruning."""
    x = features(stats)
    open_rows = np.ones(len(bad), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = open_rows & (fold != 2), open_rows & (fold == 2)
        inside, rule = grow.copy(), []
        while len(rule) < max_conditions and bad[inside].any() and not bad[inside].all():
            _, condition = _best_condition(x, bad, inside, cuts)
            if condition is None:
                break
            rule.append(condition)
            inside &= condition.holds(x)
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            hit = covers(r, x, len(bad)) & prune
            p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        options = [tuple(rule[:k]) for k in range(len(rule), 0, -1)]
        chosen = max(options, key=worth)
        hit = covers(chosen, x, len(bad)) & open_rows
        seen = hit & prune
        precise = bad[hit].mean() >= min_precision if hit.any() else False
        if not precise or hit.sum() < min_covered or (seen.any() and bad[seen].mean() < min_precision):
            break
        rules.append(chosen)
        open_rows &= ~hit
    return rules


def labelled_statistics(df: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict, np.ndarray, np.ndarray]:
    """Statistics of a bounded, hash-ordered sample of labelled documents, on the driver.

    The sample has at most `max_labelled` rows of numbers, whatever the tables' sizes.
    """
    usable = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__doc"))
        .agg(F.min("quality").alias("__low"), F.max("quality").alias("__high"))
        .where(F.col("__low") == F.col("__high"))
        .orderBy(F.xxhash64("__doc"), "__doc")
        .limit(max_labelled)
    )
    texts = df.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("text"))
    # at most max_labelled pairs of two numbers: a proven bound
    chosen = texts.join(F.broadcast(usable), F.col("__id") == F.col("__doc")).select("__doc", "__low", "text")
    seen = (
        with_statistics(chosen, "__s")
        .groupBy("__doc")
        .agg(F.min("__low").alias("__low"), F.min("__s").alias("__s"))
        .where(~base_failed("__s"))
        .select("__doc", "__low", "__s.*")
        .toPandas()
        .sort_values("__doc")
    )
    fold = (seen["__doc"].to_numpy().astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(3)
    return {c: seen[c].to_numpy() for c in STATISTICS}, (seen["__low"].to_numpy() == 0), fold.astype(int)


def fit(df: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Learn the decision list from documents (doc_id, text) and labels (doc_id, quality)."""
    stats, bad, fold = labelled_statistics(df, labels, max_labelled)
    return learn(stats, bad, fold, **options) if len(bad) and bad.any() and not bad.all() else []


def verdict(rules: list[Rule], stats: str) -> Column:
    """Number of the first rule that rejects the row, 0 if none does: one ordered CASE."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        condition = F.lit(True)
        for c in rules[k - 1]:
            condition = condition & c.column(stats)
        out = F.when(condition, F.lit(k)).otherwise(out)
    return out


def judged(df: DataFrame, rules: list[Rule], name: str | None = None) -> tuple[DataFrame, str]:
    """The frame with a struct of statistics and verdicts, and that struct's name."""
    stats = name or free_name(df, "quality_stats")
    out = with_statistics(df, stats)
    failed, rule = base_failed(stats), verdict(rules, stats)
    extra = {"base_failed": failed, "rule": F.when(failed, F.lit(0)).otherwise(rule), "kept": ~failed & (rule == 0)}
    column = F.col(stats)
    for field, value in extra.items():
        column = column.withField(field, value)
    return out.withColumn(stats, column), stats


def keep_good(df: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Documents that pass the base rule and the learned list, with their own columns."""
    out, stats = judged(df, fit(df, labels) if rules is None else rules)
    return out.where(F.col(f"{stats}.kept")).drop(stats)
