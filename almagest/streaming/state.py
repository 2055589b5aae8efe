"""Stateful streams that the built-in aggregations cannot express."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TokenBucket(StatefulProcessor):
    """Admission flags per key: two numbers of state, carried from batch to batch."""

    def __init__(self, sustained: int, burst: int, window_ms: int) -> None:
        self.sustained, self.burst, self.window_ms = sustained, burst, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, updated bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Rows of one micro-batch, which the trigger bounds, in time order.
        batch = pd.concat(list(rows)).sort_values("ms", kind="stable")
        tokens, updated = self.bucket.get() if self.bucket.exists() else (float(self.burst), None)
        flags = []
        for ms in batch["ms"].tolist():
            since = 0 if updated is None else ms - updated
            tokens = min(float(self.burst), tokens + since / self.window_ms * self.sustained)
            flags.append(tokens >= 1)
            tokens -= tokens >= 1
            updated = ms
        self.bucket.update((tokens, int(updated)))
        yield pd.DataFrame({"key": [key[0]] * len(batch), "ms": batch["ms"].tolist(), "accepted": flags})

    def close(self) -> None:
        pass


def token_bucket_stream(
    requests: DataFrame, sustained: int = 15, burst: int = 30, window_ms: int = 60_000
) -> DataFrame:
    """Requests (key string, ms bigint) as a stream to (key, ms, accepted)."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    return requests.groupBy("key").transformWithStateInPandas(
        statefulProcessor=TokenBucket(sustained, burst, window_ms),
        outputStructType="key string, ms bigint, accepted boolean",
        outputMode="Append",
        timeMode="None",
    )
