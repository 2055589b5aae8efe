"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

Every benchmark item is looked for in all windows of its own number of words. Texts are cut
into runs of five words where they are read, and a run leaves the scan only if the benchmark
has it; it carries the items that have it. Per text and item the places of such runs tell how
many a window at any start holds. Below the number that the similarity needs a window can't
be a leak, so those starts alone are left out, and the others are listed wherever they lie.
The windows get a 64-bit SimHash of their runs, weighted by how often they occur. The
fingerprints of a window and its items are cut into RADIUS + 1 blocks; at most RADIUS bits
apart, at least one block is equal. Pairs within the radius are verified by exact weighted
similarity: the sum of the smaller weights over the sum of the larger.

At a similarity of 0.8 the distance is about 10 bits with a deviation of 3, so RADIUS 20
misses one in some thousand pairs just at the threshold, and fewer above it.

Words are maximal runs of letters and digits in lower case. Defined cases: null or empty
texts have no windows; items of fewer than five words have no run of five and are not
searched; texts shorter than an item are one shorter window. Equal items are reported
each. Repeated rows are reported once; a null doc_id is an id of its own, and so is a null
item_id. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import free_names, settled, text_or_empty

SIZE = 5
SIMILARITY = 0.8
BITS = 64
RADIUS = 20
#: Benchmarks of up to so many runs are sent to every executor (20 bytes each).
BROADCAST_RUNS = 2_000_000
NO_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NO_WORD), "")


def run_hashes(words: Column, first: Column, last: Column) -> Column:
    """Hashes of the runs that start at words first .. last; none if last < first."""
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SIZE)]))


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("weight"))


def fingerprints(features: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash and total weight per key of (keys, run, weight)."""
    votes = [
        F.sum(F.when(F.shiftright("run", b).bitwiseAND(F.lit(1)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}")
        for b in range(BITS)
    ]
    out = features.groupBy(*keys).agg(F.sum("weight").alias("total"), *votes)
    print_ = F.lit(0).cast("long")
    for b in range(BITS):
        print_ = print_.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return out.select(*keys, "total", print_.alias("simhash"))


def block_equal(a: Column, b: Column, radius: int) -> Column:
    """Whether one of RADIUS + 1 blocks of nearly equal width is equal in both fingerprints."""
    n = radius + 1
    edges = [BITS * i // n for i in range(n + 1)]
    differs = a.bitwiseXOR(b)
    same = F.lit(False)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        mask = ((1 << (high - low)) - 1) << low
        mask -= (1 << BITS) if mask >> (BITS - 1) else 0
        same = same | (differs.bitwiseAND(F.lit(mask).cast("long")) == 0)
    return same


def window_starts(places: Column, runs: Column, last: Column, least: Column) -> Column:
    """All starts 0 .. last of windows of `runs` runs that hold at least `least` of the sorted
    places, each once: those whose first place is the j-th reach from behind the one before it,
    or from where the window ends at the least-th place, up to the j-th."""
    none = F.array().cast("array<int>")

    def reach(j: Column) -> Column:
        before = F.when(j > 0, F.get(places, j - 1) + 1).otherwise(0)
        low = F.greatest(before, F.get(places, j + least - 1) - runs + 1)
        high = F.least(F.get(places, j), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    firsts = F.when(F.size(places) >= least, F.sequence(F.lit(0), F.size(places) - least)).otherwise(none)
    return F.flatten(F.transform(firsts, reach))


def leaks(df: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, print, item_id, start, similarity): the best window per text and item.

    `start` is the window's first word; of equally good windows, one in which a shared run is
    at its place in the item, then the first. `print` tells texts of one id apart.
    """
    items = benchmark.select("item_id", words_of(text_or_empty()).alias("words"))
    items = items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.size("words").alias("n")).where(F.col("n") >= SIZE)
    item_runs = settled(
        items.dropDuplicates(["item", "item_id"]).select(
            "item", "item_id", "n", F.posexplode(run_hashes(F.col("words"), F.lit(0), F.col("n") - SIZE)).alias("offset", "run")
        ),
        "bench-runs",
    )
    rows = df.select("doc_id", text_or_empty().alias("text"))
    texts = rows.select("doc_id", F.xxhash64("text").alias("print"), words_of(F.col("text")).alias("words"))
    runs = texts.select(
        "doc_id", "print", F.size("words").alias("n_words"),
        F.posexplode(run_hashes(F.col("words"), F.lit(0), F.size("words") - SIZE)).alias("pos", "run"),
    )
    has = item_runs.groupBy("run", "item", "item_id", "n").agg(F.collect_list("offset").alias("offsets"))
    small = has.count() <= BROADCAST_RUNS
    seeds = runs.join(F.broadcast(has) if small else has, "run")
    per_item = seeds.groupBy("doc_id", "print", "n_words", "item", "item_id", "n").agg(
        F.array_sort(F.collect_set(F.struct("pos", "offsets"))).alias("places")
    )
    n_runs, i_runs = F.least("n", "n_words") - SIZE + 1, F.col("n") - SIZE + 1
    # both / (window + item - both) >= similarity; a little less, as products are rounded
    least = F.greatest(F.lit(1), F.ceil(F.lit(similarity / (1 + similarity)) * (n_runs + i_runs) - 1e-6).cast("int"))
    last = F.greatest(F.lit(0), F.col("n_words") - F.col("n"))
    starts = window_starts(F.col("places.pos"), n_runs, last, least)
    aligned = F.flatten(
        F.transform("places", lambda p: F.transform(p["offsets"], lambda o: F.greatest(F.lit(0), F.least(p["pos"] - o, last))))
    )
    listed = per_item.select("doc_id", "print", "item", "item_id", "n", starts.alias("starts"), aligned.alias("at")).where(F.size("starts") > 0)
    marked = F.concat(
        F.transform(F.array_intersect("starts", "at"), lambda x: F.struct(x.alias("start"), F.lit(True).alias("aligned"))),
        F.transform(F.array_except("starts", "at"), lambda x: F.struct(x.alias("start"), F.lit(False).alias("aligned"))),
    )
    places = settled(listed.select("doc_id", "print", "item", "item_id", "n", F.inline(marked)), "bench-places")
    windows = settled(places.select("doc_id", "print", "start", "n").distinct(), "bench-windows")

    per_text = windows.groupBy(F.col("doc_id").alias("w_doc"), F.col("print").alias("w_print")).agg(
        F.collect_list(F.struct("start", "n")).alias("at")
    )
    per_text = settled(per_text, "bench-texts")
    hit = texts.join(per_text, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("print") == F.col("w_print")))
    cut = hit.select("doc_id", "print", "words", F.explode("at").alias("w")).select(
        "doc_id", "print", "w.*", F.slice("words", F.col("w.start") + 1, F.col("w.n")).alias("words")
    )
    key = ["doc_id", "print", "start", "n"]
    window_runs = cut.dropDuplicates(key).select(*key, F.explode(run_hashes(F.col("words"), F.lit(0), F.size("words") - SIZE)).alias("run"))
    window_features = settled(_counted(window_runs, key), "bench-features")
    item_features = _counted(item_runs, ["item", "item_id", "n"])
    w = fingerprints(window_features, key).select(
        F.col("doc_id").alias("p_doc"), F.col("print").alias("p_print"), F.col("start").alias("p_start"), F.col("n").alias("p_n"),
        F.col("total").alias("w_total"), "simhash",
    )
    b = fingerprints(item_features, ["item", "item_id", "n"]).select(
        F.col("item").alias("b_item"), F.col("item_id").alias("b_id"), F.col("total").alias("i_total"), F.col("simhash").alias("i_simhash")
    )
    at = (
        F.col("doc_id").eqNullSafe(F.col("p_doc"))
        & (F.col("print") == F.col("p_print"))
        & (F.col("start") == F.col("p_start"))
        & (F.col("n") == F.col("p_n"))
    )
    near = (
        places.join(w, at)
        .join(b, (F.col("item") == F.col("b_item")) & F.col("item_id").eqNullSafe(F.col("b_id")))
        .where(block_equal(F.col("simhash"), F.col("i_simhash"), radius))
        .where(F.bit_count(F.col("simhash").bitwiseXOR(F.col("i_simhash"))) <= radius)
        .select(*key, "aligned", "w_total", "item", "item_id", "i_total")
    )
    near = settled(near, "bench-candidates")
    c = near.select(F.col("doc_id").alias("c_doc"), F.col("print").alias("c_print"), F.col("start").alias("c_start"), F.col("n").alias("c_n"), "aligned", "item", "item_id", "w_total", "i_total")
    there = (
        F.col("doc_id").eqNullSafe(F.col("c_doc"))
        & (F.col("print") == F.col("c_print"))
        & (F.col("start") == F.col("c_start"))
        & (F.col("n") == F.col("c_n"))
    )
    of_item = item_features.select(F.col("item").alias("f_item"), F.col("item_id").alias("f_id"), F.col("run").alias("f_run"), F.col("weight").alias("f_weight"))
    common = (
        window_features.join(c, there)
        .join(of_item, (F.col("item") == F.col("f_item")) & F.col("item_id").eqNullSafe(F.col("f_id")) & (F.col("run") == F.col("f_run")))
        .groupBy(*key, "aligned", "item", "item_id", "w_total", "i_total")
        .agg(F.sum(F.least("weight", "f_weight")).alias("both"))
    )
    value = F.col("both") / (F.col("w_total") + F.col("i_total") - F.col("both"))
    found = common.select("doc_id", "print", "item_id", "start", "aligned", value.alias("similarity")).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("back")))
    return found.groupBy("doc_id", "print", "item_id").agg(best.alias("best")).select(
        "doc_id", "print", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity")
    )


def drop_leaks(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The frame without the rows whose text holds a benchmark item."""
    doc, print_, name = free_names(df, "leak_doc", "leak_print", "bench_print")
    found = settled(leaks(df, benchmark, **options).select(F.col("doc_id").alias(doc), F.col("print").alias(print_)).distinct(), "bench-leaks")
    rows = df.withColumn(name, F.xxhash64(text_or_empty()))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(name) == F.col(print_)), "left_anti").drop(name)


SQL = rf"""
WITH items AS (SELECT item_id, w, len(w) AS n FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) >= 5),
item_runs AS (SELECT item_id, n, i - 1 AS off, array_to_string(w[i:i+4], ' ') AS run
  FROM (SELECT item_id, n, w, unnest(range(1, n - 3)) AS i FROM items)),
texts AS (SELECT doc_id, w, len(w) AS m FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents)),
doc_runs AS (SELECT doc_id, m, i - 1 AS pos, array_to_string(w[i:i+4], ' ') AS run
  FROM (SELECT doc_id, m, w, unnest(range(1, m - 3)) AS i FROM texts)),
windows AS (SELECT DISTINCT d.doc_id, b.item_id, b.n, greatest(0, least(d.pos - b.off, d.m - b.n)) AS s
  FROM doc_runs d JOIN item_runs b USING (run)),
w_runs AS (SELECT x.doc_id, x.item_id, x.s, r.run, count(*) AS c
  FROM windows x JOIN doc_runs r ON r.doc_id = x.doc_id AND r.pos BETWEEN x.s AND x.s + x.n - 5 GROUP BY ALL),
i_runs AS (SELECT item_id, run, count(*) AS c FROM item_runs GROUP BY ALL),
totals AS (SELECT doc_id, item_id, s, sum(c) AS t FROM w_runs GROUP BY ALL),
i_totals AS (SELECT item_id, sum(c) AS t FROM i_runs GROUP BY ALL),
common AS (SELECT w.doc_id, w.item_id, w.s, sum(least(w.c, i.c)) AS both
  FROM w_runs w JOIN i_runs i ON w.item_id = i.item_id AND w.run = i.run GROUP BY ALL),
scored AS (SELECT c.doc_id, c.item_id, c.s, c.both::DOUBLE / (t.t + i.t - c.both) AS sim
  FROM common c JOIN totals t USING (doc_id, item_id, s) JOIN i_totals i USING (item_id))
SELECT doc_id, item_id, (arg_max(s, sim * 1000000 - s / 1000000.0))::INT AS start, round(max(sim), 6) AS similarity
FROM scored WHERE sim >= 0.8 GROUP BY doc_id, item_id
"""
