"""Plans that scale: what is pushed down, reduced early, and never multiplied."""

from __future__ import annotations

import contextlib
import io

import pytest
from conftest import SMALL

from almagest.plans.queries import QUERIES

STREAMS = {
    "slot_tumbling_stream", "poll_status_stream", "slot_publish", "latest_publish",
    "freshness_stream", "arrival_stream", "gated_publish", "vacuumed_slots", "pinned_snapshot",
    "ledger_attempts", "latest_document", "canonical_order", "bounded_slot_stream", "slot_manifest", "pointer_shard",
}


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_or_nested_loop_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_window_over_everything(spark, name):
    """A window without keys would pull the table into one task."""
    plan = plan_of(QUERIES[name](spark, SMALL))
    for block in plan.split("\n\n"):
        if ") Window" in block:
            keys = block.split("Arguments:")[-1]
            assert "], [" in keys, block
    assert "Exchange SinglePartition" not in plan or "Window" not in plan.split("SinglePartition")[0][-400:]


@pytest.mark.parametrize("name", ["slice_occurrence", "arrivals", "event_log"])
def test_time_filter_reaches_the_scan(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan


def test_interval_filter_reaches_the_scan(spark):
    assert "LessThanOrEqual(o_orderdate," in plan_of(QUERIES["slice_interval"](spark, SMALL))


@pytest.mark.parametrize(
    "name", ["latest_per_entity", "asof_many_instants", "merge_revision", "merge_last", "dedupe_pages", "world_state"]
)
def test_winner_is_cut_down_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_columns_are_pruned(spark):
    plan = plan_of(QUERIES["merge_revision"](spark, SMALL))
    assert "l_comment" not in plan and "l_tax" not in plan


@pytest.mark.parametrize("name", ["hatch_polygons", "unwrap_polygons", "ring_centroid", "link_state", "detail_labels"])
def test_row_local_work_does_not_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    # The fixture deals its rows out once; nothing is hashed or sorted into place.
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["newest_arrivals", "event_log", "record_lookup"])
def test_top_k_is_bounded_per_task(spark, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SMALL))
