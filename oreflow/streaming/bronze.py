"""Streaming bronze ingest with lateness, dead letters and counters.

Each micro-batch is parsed, deduplicated (first copy wins) and written to its own folder in every output table, so a
batch that is run again after a failure adds nothing twice. What a batch must know of the past is in the counters of
the batch before it: its work does not grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oreflow.functions.events import dead_letters, parse_events
from oreflow.operators.dedup import first_arrived
from oreflow.operators.merge import new_rows
from oreflow.plans.layers import BRONZE_SCHEMA, with_event_date
from oreflow.session import materialize, materialize_counted, steps_removed
from oreflow.sources.batches import BatchTable

# Out-of-orderness, state time-to-live and trigger of the stream.
WATERMARK_DELAY = timedelta(minutes=5)
STATE_TTL = timedelta(hours=24)
TRIGGER = "10 seconds"

STREAM_SCHEMA = BRONZE_SCHEMA + ", is_late_arrival boolean, batch_id bigint"
DEAD_SCHEMA = (
    "original_payload string, error_type string, error_message string, failed_at timestamp, kafka_partition int, "
    "kafka_offset bigint, batch_id bigint"
)
COUNTER_SCHEMA = (
    "batch_id bigint, received bigint, malformed bigint, processed bigint, duplicates bigint, late bigint, too_late bigint, "
    "max_event_time timestamp, live array<struct<block: bigint, started: timestamp>>"
)


@dataclass
class StreamTables:
    """Outputs of the stream below one root."""

    bronze: BatchTable
    late: BatchTable
    too_late: BatchTable
    dead: BatchTable
    counters: BatchTable

    @classmethod
    def under(cls, spark: SparkSession, root: str, **layout) -> "StreamTables":
        make = lambda name, ddl, order=None: BatchTable(spark, f"{root}/{name}", ddl, order, **layout)
        return cls(
            make("bronze", STREAM_SCHEMA, "event_time"),
            make("late", STREAM_SCHEMA, "event_time"),
            make("too_late", STREAM_SCHEMA, "event_time"),
            make("dead_letters", DEAD_SCHEMA),
            make("counters", COUNTER_SCHEMA),
        )

    def close(self, number: int) -> None:
        """Rewrite a block of all outputs into few files."""
        for table in (self.bronze, self.late, self.too_late, self.dead, self.counters):
            table.close(number)


@dataclass
class Past:
    """What is known of the batches before one: the newest event time, and the first moment of each block of
    batches that may hold ids still counting as seen."""

    newest: datetime | None
    live: list[tuple[int, datetime]]


@dataclass
class BronzeStream:
    """The ``foreachBatch`` step.

    ``ttl`` forgets ids that long after they were written (None: never);
    ``allowed_lateness`` sends rows later than that to their own table
    (None: keep all late rows, only flagged). ``clock`` gives the processing
    time of a batch.
    """

    tables: StreamTables
    ttl: timedelta | None = STATE_TTL
    allowed_lateness: timedelta | None = None
    clock: Callable[[int], datetime] = lambda batch_id: datetime.now(timezone.utc)

    def past(self, batch_id: int, now: datetime) -> Past:
        """From the one counters row of the batch before; blocks that ended before the time-to-live are left out."""
        before = self.tables.counters.batch(batch_id - 1).select(
            "max_event_time", F.transform("live", lambda b: F.struct(b.block, F.unix_micros(b.started).alias("at"))).alias("live")
        )
        row = before.select(F.unix_micros("max_event_time").alias("newest"), "live").first() if batch_id else None
        if row is None:
            return Past(None, [])
        moment = lambda micros: datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=micros)
        starts = [(b["block"], moment(b["at"])) for b in row["live"]]
        ends = [start for _, start in starts[1:]] + [None]
        live = [(b, t) for (b, t), end in zip(starts, ends) if self.ttl is None or end is None or end > now - self.ttl]
        return Past(None if row["newest"] is None else moment(row["newest"]), live)

    def _written(self, table: BatchTable, past: Past, now: datetime) -> DataFrame:
        """Rows whose ids still count as seen; only blocks young enough are opened."""
        rows = table.blocks([block for block, _ in past.live])
        return rows if self.ttl is None else rows.filter(F.col("ingested_at") > F.lit(now - self.ttl))

    def __call__(self, records: DataFrame, batch_id: int) -> None:
        with steps_removed(records.sparkSession):
            self.run(records, batch_id)

    def run(self, records: DataFrame, batch_id: int) -> DataFrame:
        """Write a batch; returns its new rows that were not too late."""
        spark = records.sparkSession
        now = self.clock(batch_id)
        past = self.past(batch_id, now)
        mark = past.newest - WATERMARK_DELAY if past.newest else None
        time = F.col("event_time")
        late = F.lit(False) if mark is None else F.coalesce(time < F.lit(mark), F.lit(False))
        too_late = F.lit(False)
        if mark is not None and self.allowed_lateness is not None:
            too_late = F.coalesce(time < F.lit(mark - self.allowed_lateness), F.lit(False))

        parsed = with_event_date(parse_events(records, now)).withColumns(
            {"is_late_arrival": late, "batch_id": F.lit(batch_id).cast("long"), "_too_late": too_late}
        )
        # Counted on the way to the first and the second written step.
        read, taken, bad = Observation(), Observation(), Observation()
        parsed = parsed.observe(read, F.count(F.lit(1)).alias("good"), F.unix_micros(F.max("event_time")).alias("newest"))
        fresh = first_arrived(parsed)
        if past.live:
            known = self._written(self.tables.bronze, past, now)
            if self.allowed_lateness is not None:
                known = known.unionByName(self._written(self.tables.too_late, past, now))
            unique, rows = materialize_counted(spark, fresh)
            fresh = new_rows(unique, known.filter(F.col("batch_id") < batch_id), ["event_id"], rows)
        fresh = fresh.observe(
            taken, F.count(F.lit(1)).alias("fresh"), F.count_if("is_late_arrival").alias("late"),
            F.count_if("_too_late").alias("too_late"),
        )
        # Only where rows go to two tables is there a step before them.
        if mark is not None and self.allowed_lateness is not None:
            fresh = materialize(spark, fresh)

        tables = self.tables
        tables.bronze.write(fresh.filter(~F.col("_too_late")).drop("_too_late"), batch_id)
        accepted = tables.bronze.batch(batch_id)
        seen, new = read.get, taken.get
        if new["late"] > new["too_late"]:
            tables.late.write(accepted.filter("is_late_arrival"), batch_id)
        if new["too_late"]:
            tables.too_late.write(fresh.filter("_too_late").drop("_too_late"), batch_id)
        dead = dead_letters(records, now).observe(bad, F.count(F.lit(1)).alias("rows"))
        tables.dead.write(dead, batch_id)
        malformed = bad.get["rows"]
        # Last: the next batch takes what it must know from the counters.
        counts = {
            "received": seen["good"] + malformed,
            "malformed": malformed,
            "processed": new["fresh"] - new["too_late"],
            "duplicates": seen["good"] - new["fresh"],
            "late": new["late"] - new["too_late"],
            "too_late": new["too_late"],
        }
        row = [F.lit(value).cast("long").alias(name) for name, value in counts.items()]
        before = None if past.newest is None else F.lit(past.newest)
        newest = F.greatest(before if before is not None else F.lit(None).cast("timestamp"), F.timestamp_micros(F.lit(seen["newest"]).cast("long")))
        block = batch_id // tables.bronze.block
        live = past.live if any(b == block for b, _ in past.live) else [*past.live, (block, now)]
        known_blocks = F.array(*[F.struct(F.lit(b).cast("long").alias("block"), F.lit(t).cast("timestamp").alias("started")) for b, t in live])
        tables.counters.write(spark.range(1).select(*row, newest.alias("max_event_time"), known_blocks.alias("live")), batch_id)
        if tables.bronze.closes(batch_id):
            tables.close(block - 1)
        return accepted


def start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run the step on a topic stream; offsets and progress live in ``checkpoint``."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)
    return writer.start()


def append_parsed(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Plain append: parse, drop malformed rows and write Parquet by day."""
    events = with_event_date(parse_events(stream, F.col("kafka_timestamp")))
    writer = (
        events.writeStream.format("parquet").outputMode("append").partitionBy("event_date")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)
    return writer.start()


def print_events(stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Debug sink: one line per event on the console."""
    from oreflow.functions.events import describe_event

    lines = parse_events(stream, F.col("kafka_timestamp")).select(describe_event().alias("line"))
    writer = lines.writeStream.format("console").option("truncate", False).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)).start()
