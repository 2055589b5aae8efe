"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm import (
    decontamination,
    factorisation,
    mixture,
    norm_buckets,
    order_minhash,
    part_codes,
    quality_rules,
    repeats,
    reply_trees,
    secret_links,
    sharding,
    token_counts,
    token_files,
)
from almagest.llm.common import documents, settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_files(spark, sf):
    import public_tokenizers

    manifest = token_files.write_tokens(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_quality_rules(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = documents(spark, sf)
    rules = quality_rules.fit(docs, labels)
    rows, s = quality_rules.judged(docs.select("doc_id", "text"), rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return rows.select("doc_id", *[f"{s}.{c}" for c in counts])


@query
def op8_shard_ring(spark, sf):
    return sharding.places(documents(spark, sf), 24)


@query
def op6_secret_links(spark, sf):
    return secret_links.scan(documents(spark, sf))


ORACLE["op6_secret_links"] = secret_links.SQL


@query
def op5_repeat_removal(spark, sf):
    return repeats.digests(documents(spark, sf))


@query
def op9_order_minhash(spark, sf):
    return order_minhash.near_duplicates(documents(spark, sf))


@query
def op10_decontamination(spark, sf):
    found = decontamination.leaks(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


ORACLE["op10_decontamination"] = decontamination.SQL


@query
def op2_soft_mixture(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows, _ = mixture.rated(documents(spark, sf), mixture.quality_domains(labels), mixture.WEIGHTS)
    parts = [F.round(F.col("p")[i], 6).alias(f"p_{d}") for i, d in enumerate(mixture.WEIGHTS)]
    return rows.select("doc_id", "n_tokens", *parts, F.round("rate", 4).alias("rate"), "copies")


@query
def op4_reply_trees(spark, sf):
    conversations = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], conversations.schema)
    messages = settled(reply_trees.by_turn(conversations.unionByName(extra)), "tree-messages")
    written = settled(reply_trees.formatted(messages, reply_trees.steps(messages, per_tree=1)), "tree-texts")
    return reply_trees.read_back(written)


ORACLE["op4_reply_trees"] = reply_trees.SQL


@query
def op7_token_counts(spark, sf):
    import public_tokenizers

    docs = documents(spark, sf).select("doc_id", "text")
    return token_counts.with_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


@query
def op11_factorisation_machine(spark, sf):
    return factorisation.digest(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query
def op12_norm_buckets(spark, sf):
    return norm_buckets.search(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


ORACLE["op12_norm_buckets"] = norm_buckets.SQL


@query
def op13_part_codes(spark, sf):
    return part_codes.coded(spark.read.parquet(f"{sf}/embeddings.parquet"))


ORACLE["op13_part_codes"] = part_codes.SQL
