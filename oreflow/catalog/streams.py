"""Streaming queries: the topic arrives in three segments, each a micro-batch."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from oreflow.catalog.base_sql import BRONZE_COLUMNS, SEGMENTS, with_events
from oreflow.catalog.gold import HOURLY_SQL
from oreflow.catalog.keys import BUCKET_SQL
from oreflow.catalog.registry import query
from oreflow.functions.events import parse_events
from oreflow.schemas import BRONZE_COLUMNS as COLUMNS
from oreflow.session import work_path
from oreflow.sources import bindings
from oreflow.sources.batches import BatchTable
from oreflow.sources.topic import append_log, stream_log
from oreflow.streaming import bronze as job
from oreflow.streaming import hourly, state

SEGMENT_COUNT = 3


def _clock(batch_id: int) -> datetime:
    """Batches twelve hours apart."""
    return datetime(2024, 2, 1, tzinfo=timezone.utc) + timedelta(hours=12 * batch_id)


@contextmanager
def _state_per_core(spark):
    """State partitions are fixed for a stream's life: one per core here."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _feed(spark, folder, run):
    """Write one segment after another and run the stream on what is new. Records are made where their segment is
    asked for: the filter goes below their JSON, so no row is shuffled or written twice before the stream reads it."""
    records = bindings.segmented_topic(spark, folder)
    path = work_path(spark, "topic")
    for segment in range(SEGMENT_COUNT):
        append_log(records.filter(F.col("segment") == segment), path)
        run(stream_log(spark, path)).awaitTermination()


_RUNS: dict[tuple, job.StreamTables] = {}


def _bronze_run(spark, folder, ttl=None) -> job.StreamTables:
    key = (spark.sparkContext.applicationId, folder, ttl)
    if key not in _RUNS:
        tables = job.StreamTables.under(spark, work_path(spark, "stream"))
        step = job.BronzeStream(tables, ttl, None, _clock)
        checkpoint = work_path(spark, "checkpoint")
        _feed(spark, folder, lambda stream: job.start(stream, step, checkpoint, available_now=True))
        _RUNS[key] = tables
    return _RUNS[key]


STREAM_SQL = (
    SEGMENTS
    + """
, marks AS (
  SELECT s.seg, max(g.event_time) - INTERVAL 5 MINUTE AS mark
  FROM generate_series(0, 2) AS s(seg) LEFT JOIN seg_good g ON g.seg < s.seg GROUP BY 1),
firsts AS (SELECT * FROM seg_good QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seg, kafka_offset, kafka_partition) = 1),
flagged AS (
  SELECT f.* , TIMESTAMP '2024-02-01' + to_hours(CAST(12 * f.seg AS INTEGER)) AS ingested_at,
    coalesce(event_time < mark, false) AS is_late_arrival, coalesce(event_time < mark - INTERVAL 1 HOUR, false) AS too_late
  FROM firsts f JOIN marks m ON m.seg = f.seg)
"""
)


@query("stream_bronze", with_events(f"SELECT {BRONZE_COLUMNS}, is_late_arrival, seg AS batch_id FROM flagged", STREAM_SQL))
def stream_bronze(spark, folder):
    """First copies, late ones flagged and kept."""
    return _bronze_run(spark, folder).bronze.read().select(*COLUMNS, "is_late_arrival", "batch_id")


@query("stream_late", with_events("SELECT event_id, event_time, seg AS batch_id FROM flagged WHERE is_late_arrival", STREAM_SQL))
def stream_late(spark, folder):
    """The side output of late rows."""
    return _bronze_run(spark, folder).late.read().select("event_id", "event_time", "batch_id")


@query(
    "stream_dead_letter",
    with_events(
        "SELECT original_payload, error_type, kafka_partition, kafka_offset, CAST(seg AS BIGINT) AS batch_id FROM seg_bad", SEGMENTS
    ),
)
def stream_dead_letter(spark, folder):
    rows = _bronze_run(spark, folder).dead.read()
    return rows.select("original_payload", "error_type", "kafka_partition", "kafka_offset", "batch_id")


@query(
    "stream_counters",
    with_events(
        """
, g AS (SELECT seg, count(*) AS good FROM seg_good GROUP BY 1), b AS (SELECT seg, count(*) AS bad FROM seg_bad GROUP BY 1),
f AS (SELECT seg, count(*) AS processed, count(*) FILTER (is_late_arrival) AS late FROM flagged GROUP BY 1)
SELECT CAST(g.seg AS BIGINT) AS batch_id, good + coalesce(bad, 0) AS received, coalesce(bad, 0) AS malformed, processed,
  good - processed AS duplicates, late
FROM g LEFT JOIN b ON b.seg = g.seg JOIN f ON f.seg = g.seg""",
        STREAM_SQL,
    ),
)
def stream_counters(spark, folder):
    rows = _bronze_run(spark, folder).counters.read()
    return rows.select("batch_id", "received", "malformed", "processed", "duplicates", "late")


@query(
    "stream_allowed_lateness",
    with_events(
        "SELECT event_id, CASE WHEN too_late THEN 'TOO_LATE' WHEN is_late_arrival THEN 'LATE' ELSE 'ON_TIME' END AS route FROM flagged",
        STREAM_SQL,
    ),
)
def stream_allowed_lateness(spark, folder):
    """Rows at most one hour late are accepted, later ones are routed away."""
    tables = _hourly_run(spark, folder)[0]
    kept = tables.bronze.read().select("event_id", F.when(F.col("is_late_arrival"), "LATE").otherwise("ON_TIME").alias("route"))
    return kept.unionByName(tables.too_late.read().select("event_id", F.lit("TOO_LATE").alias("route")))


@query(
    "stream_dedup_ttl",
    with_events(
        """
, copies AS (SELECT DISTINCT event_id, seg FROM seg_good),
placed AS (SELECT event_id, seg, min(seg) OVER (PARTITION BY event_id) AS first_seg FROM copies)
SELECT event_id, seg AS batch_id FROM placed WHERE seg = first_seg OR (seg - first_seg) * 12 >= 18""",
        SEGMENTS,
    ),
)
def stream_dedup_ttl(spark, folder):
    """Ids are forgotten after 18 hours, so a copy a day later passes again."""
    return _bronze_run(spark, folder, ttl=timedelta(hours=18)).bronze.read().select("event_id", "batch_id")


STATE_DELAY = "24 hours"
STATE_SQL = (
    SEGMENTS
    + """
, marks AS (
  SELECT s.seg, date_trunc('millisecond', max(g.event_time)) - INTERVAL 24 HOUR AS mark
  FROM generate_series(0, 2) AS s(seg) LEFT JOIN seg_good g ON g.seg < s.seg GROUP BY 1),
placed AS (SELECT g.*, coalesce(event_time <= mark, false) AS behind FROM seg_good g JOIN marks m ON m.seg = g.seg)
"""
)

_STATE_RUNS: dict[tuple, tuple] = {}


def _state_run(spark, folder) -> tuple[str, list]:
    """Path of the unique events, and what each segment's query told of its state."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STATE_RUNS:
        path, checkpoint, told = work_path(spark, "unique"), work_path(spark, "checkpoint"), []

        def run(stream):
            with _state_per_core(spark):
                query = state.start_unique(stream, path, checkpoint, STATE_DELAY, available_now=True)
                query.awaitTermination()
            told.append(state.progress_of(query))
            return query

        _feed(spark, folder, run)
        _STATE_RUNS[key] = path, told
    return _STATE_RUNS[key]


PAYLOAD_SQL = ", ".join(state.PAYLOAD)


@query("stream_state_dedup", with_events(f"SELECT DISTINCT {PAYLOAD_SQL} FROM placed WHERE NOT behind", STATE_SQL))
def stream_state_dedup(spark, folder):
    """Each event once, by state that expires with the watermark; no output is read back."""
    return spark.read.parquet(_state_run(spark, folder)[0]).select(*state.PAYLOAD)


@query(
    "stream_state_dropped",
    with_events("SELECT CAST(seg AS BIGINT) AS segment, count(*) FILTER (behind) AS dropped FROM placed GROUP BY 1", STATE_SQL),
)
def stream_state_dropped(spark, folder):
    """Rows that came behind the watermark, per segment, as the stream itself counted them."""
    told = _state_run(spark, folder)[1]
    rows = [(segment, sum(p["dropped"] for p in progress)) for segment, progress in enumerate(told)]
    return spark.createDataFrame(rows, "segment long, dropped long")


@query("stream_append", with_events(f"SELECT {BRONZE_COLUMNS} FROM (SELECT *, arrival AS ingested_at FROM delivered)"))
def stream_append(spark, folder):
    """Plain parse-and-append ingest, duplicates included."""
    path, checkpoint = work_path(spark, "appended"), work_path(spark, "checkpoint")
    _feed(spark, folder, lambda stream: job.append_parsed(stream, path, checkpoint, available_now=True))
    return spark.read.parquet(path).select(*COLUMNS)


_HOURLY_RUNS: dict[tuple, tuple] = {}


def _hourly_run(spark, folder) -> tuple[job.StreamTables, BatchTable]:
    """The whole topic with one hour of allowed lateness: bronze outputs and hourly sums."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _HOURLY_RUNS:
        tables = job.StreamTables.under(spark, work_path(spark, "stream"))
        partials = hourly.partial_table(spark, work_path(spark, "hourly"))
        step = hourly.HourlyStream(job.BronzeStream(tables, None, timedelta(hours=1), _clock), partials)
        checkpoint = work_path(spark, "checkpoint")
        _feed(spark, folder, lambda stream: job.start(stream, step, checkpoint, available_now=True))
        _HOURLY_RUNS[key] = tables, partials
    return _HOURLY_RUNS[key]


@query("stream_hourly", with_events(HOURLY_SQL.format(table="flagged WHERE NOT too_late"), STREAM_SQL))
def stream_hourly(spark, folder):
    """Hourly metrics of first copies that come at most one hour late."""
    return hourly.hourly(_hourly_run(spark, folder)[1].read())


@query(
    "stream_hourly_late",
    with_events(
        "SELECT date_trunc('hour', event_time) AS hour_key, count(*) AS late_requests FROM flagged WHERE too_late GROUP BY 1",
        STREAM_SQL,
    ),
)
def stream_hourly_late(spark, folder):
    """The rest: first copies that came later than that, per hour."""
    return hourly.late_by_hour(_hourly_run(spark, folder)[0].too_late.read())


FIRST_COPIES = f"offset % {bindings.KINDS} = {bindings.FIRST}"


@query(
    "stream_rate_limit",
    with_events(
        """
, seconds AS (SELECT client_ip AS client, CAST(epoch(date_trunc('second', arrival)) AS BIGINT) AS second, count(*) AS requests
              FROM ev GROUP BY 1, 2)"""
        + BUCKET_SQL
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def stream_rate_limit(spark, folder):
    """Token buckets kept as stream state over the requests in arrival order."""
    out, checkpoint, path = (work_path(spark, name) for name in ("limited", "checkpoint", "topic"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, state.ROCKSDB)
    records = bindings.segmented_topic(spark, folder).filter(FIRST_COPIES)
    edges = [None, "2024-01-11", "2024-01-21", None]
    for start, end in zip(edges, edges[1:]):
        since = F.lit(True) if start is None else F.col("timestamp") >= F.lit(start).cast("timestamp")
        until = F.lit(True) if end is None else F.col("timestamp") < F.lit(end).cast("timestamp")
        append_log(records.filter(since & until), path)
        events = parse_events(stream_log(spark, path), F.col("kafka_timestamp"))
        limited = state.rate_limit(events, "client_ip", "ingested_at", 2, 86_400)
        writer = (
            limited.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True)
        )
        try:
            with _state_per_core(spark):
                writer.start().awaitTermination()
        finally:
            spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return spark.read.parquet(out)
