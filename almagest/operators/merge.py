"""Merging existing and incoming records by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.operators.keys import first_per_key

SIDE = "__side"

# Winner rules; each is a total order, best row first. Incoming wins against existing
# on equal terms, and a later arrival against an earlier one.
BY_REVISION = ["revision", SIDE, "arrival_seq"]
BY_ARRIVAL = [SIDE, "arrival_seq"]


def merge(
    existing: DataFrame,
    incoming: DataFrame,
    rule: list[str],
    keys: list[str] | None = None,
    ties: list[str] | None = None,
) -> DataFrame:
    """Union of both sides, one winner per key.

    A union with a rank, not a full outer join: each side is reduced to one row per
    key and task before it is shuffled.
    """
    both = existing.withColumn(SIDE, F.lit(0)).unionByName(
        incoming.withColumn(SIDE, F.lit(1)), allowMissingColumns=True
    )
    order: list[Column] = [F.col(c).desc() for c in [*rule, *(ties or [])]]
    return first_per_key(both, keys or ["id"], order).drop(SIDE)


def merge_by_revision(existing: DataFrame, incoming: DataFrame, **kw) -> DataFrame:
    """The higher revision wins, so a correction is kept and an old version cannot return."""
    return merge(existing, incoming, BY_REVISION, **kw)


def merge_by_arrival(existing: DataFrame, incoming: DataFrame, **kw) -> DataFrame:
    """The last arrival wins."""
    return merge(existing, incoming, BY_ARRIVAL, **kw)


def dedupe_lists(rows: DataFrame, keys: list[str], list_seq: str, ties: list[str]) -> DataFrame:
    """One row per id over all lists: highest revision, then the later list."""
    return first_per_key(rows, keys, [F.col(c).desc() for c in ["revision", list_seq, *ties]])
