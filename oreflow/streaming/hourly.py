"""Hourly metrics on the stream.

Every micro-batch adds one row of sums per hour of its new events, once; readers add the rows up. The
sums are mergeable, so no state is kept and no hour is ever read again. Events beyond the allowed
lateness are not lost: the bronze step writes them to its ``too_late`` table and counts them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.functions.events import nanos_to_millis
from oreflow.session import steps_removed
from oreflow.sources.batches import BatchTable
from oreflow.streaming.bronze import BronzeStream

PARTIAL_SCHEMA = (
    "hour_key timestamp, total_requests bigint, success_count bigint, error_count bigint, timed bigint, "
    "sum_nanos bigint, max_nanos bigint, batch_id bigint"
)


def partial_table(spark: SparkSession, path: str, **layout) -> BatchTable:
    return BatchTable(spark, path, PARTIAL_SCHEMA, "hour_key", **layout)


def by_hour(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", "event_time").alias("hour_key"))


def partial_sums(events: DataFrame, batch_id: int) -> DataFrame:
    nanos = F.col("response_time_nanos")
    return by_hour(events).agg(
        F.count("*").alias("total_requests"),
        F.count_if(F.col("status") == "SUCCESS").alias("success_count"),
        F.count_if(F.col("status") != "SUCCESS").alias("error_count"),
        F.count(nanos).alias("timed"),
        F.sum(nanos).alias("sum_nanos"),
        F.max(nanos).alias("max_nanos"),
    ).withColumn("batch_id", F.lit(batch_id).cast("long"))


def hourly(partials: DataFrame) -> DataFrame:
    """The metrics of all batches so far, one row per hour."""
    counts = ("total_requests", "success_count", "error_count")
    return partials.groupBy("hour_key").agg(
        *[F.sum(name).alias(name) for name in counts],
        nanos_to_millis(F.try_divide(F.sum("sum_nanos"), F.sum("timed"))).alias("avg_response_time_ms"),
        nanos_to_millis(F.max("max_nanos")).alias("max_response_time_ms"),
    )


def late_by_hour(too_late: DataFrame) -> DataFrame:
    """How many events of each hour came too late to be counted in it."""
    return by_hour(too_late).agg(F.count("*").alias("late_requests"))


@dataclass
class HourlyStream:
    """The ``foreachBatch`` step: ingest into bronze, then the sums of the rows that were new and in time."""

    ingest: BronzeStream
    partials: BatchTable

    def __call__(self, records: DataFrame, batch_id: int) -> None:
        with steps_removed(records.sparkSession):
            accepted = self.ingest.run(records, batch_id)
            self.partials.write(partial_sums(accepted, batch_id), batch_id)
            if self.partials.closes(batch_id):
                self.partials.close(batch_id // self.partials.block - 1)
