"""Small tables of documents with all the odd cases in them."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, size string, print int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(d, t, "en", "own", 7) for d, t in rows], SCHEMA)


def odd_rows():
    rng = random.Random(5)
    base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(260))
    rows = [(None, "an id of null"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "é ü 漢字\nline\nline\n"), (6, base), (6, base), (6, "other text")]
    for i in range(12):
        words = base.split(" ")
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        rows.append((20 + i, " ".join(words)))
    rows.append((90, "x" * 30_000))
    rows.append((91, "long " * 6_000))
    for i in range(30):
        rows.append((100 + i, "".join(rng.choice("abc dé\n#!A1 ") for _ in range(rng.randint(0, 500)))))
    return rows


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
