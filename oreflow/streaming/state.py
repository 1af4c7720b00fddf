"""State on the stream: dedup that expires with event time, token buckets.

The token buckets need the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``; the dedup runs on either store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from oreflow.functions.events import parse_events
from oreflow.operators.rate import REPLAY_SCHEMA, spend
from oreflow.plans.layers import with_event_date

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Fixed value: columns that all copies of an event share; which copy passes is not decided by more than arrival.
PAYLOAD = (
    "event_id event_time event_type user_id api_key_prefix client_ip correlation_id input_number output_roman range_min range_max "
    "result_count page_offset page_limit response_time_nanos status"
).split()


def unique_events(records: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Events of a topic stream, each id once, by Spark's own event-time state.

    An id is held until the watermark, the newest event time less ``delay``, has passed its event time by
    ``delay`` again, and is then forgotten: the state is bounded by the events of twice that time, and no output
    is ever read back. Copies carry the event's own time, so within the delay none passes twice. Rows behind the
    watermark are dropped and counted by Spark (``dropped_behind_watermark``). Rows without an event time cannot be
    placed and are left to the dead letters.
    """
    events = parse_events(records, F.col("kafka_timestamp")).filter(F.col("event_time").isNotNull())
    kept = events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])
    return with_event_date(kept.select(*PAYLOAD))


def start_unique(records: DataFrame, path: str, checkpoint: str, delay: str = "24 hours", available_now: bool = False) -> StreamingQuery:
    """Write the unique events as Parquet by day. Spark's file sink commits a batch once, repeated or not."""
    writer = (
        unique_events(records, delay).writeStream.format("parquet").outputMode("append").partitionBy("event_date")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def progress_of(query: StreamingQuery) -> list[dict]:
    """(batch, ids held, rows dropped behind the watermark) of the batches of a query that progress is kept of."""
    return [
        {"batch_id": p["batchId"], "held": s["numRowsTotal"], "dropped": s["numRowsDroppedByWatermark"]}
        for p in query.recentProgress for s in p["stateOperators"][:1]
    ]


class TokenBucket(StatefulProcessor):
    """A bucket per client; the state is its level and the last second."""

    def __init__(self, capacity: int, period_seconds: int):
        self.capacity, self.period = capacity, period_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "level long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for part in rows:  # one number per second, not one row per request
            for second, asked in part["second"].value_counts().items():
                counts[second] = counts.get(second, 0) + asked
        level, last = self.bucket.get() if self.bucket.exists() else (0, None)
        out = []
        for second in sorted(counts):
            asked = int(counts[second])
            elapsed = None if last is None else max(0, int(second) - last)
            level, allowed = spend(level, elapsed, asked, self.capacity, self.period)
            last = int(second) if last is None else max(last, int(second))
            denied = asked - allowed
            wait = -(-(self.period - level) // self.capacity) if denied else 0
            out.append((key[0], int(second), asked, allowed, denied, level // self.period, wait))
        self.bucket.update((level, last))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in REPLAY_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def rate_limit(events: DataFrame, client: str, time: str, capacity: int, period_seconds: int) -> DataFrame:
    """Allow or deny requests on the stream, per client and second."""
    rows = events.select(F.col(client).alias("client"), F.unix_seconds(time).alias("second")).filter(
        F.col("client").isNotNull() & F.col("second").isNotNull()
    )
    return rows.groupBy("client").transformWithStateInPandas(
        statefulProcessor=TokenBucket(capacity, period_seconds),
        outputStructType=REPLAY_SCHEMA,
        outputMode="append",
        timeMode="None",
    )
