"""Queries of the bronze layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreflow.catalog.base_sql import BRONZE_COLUMNS, with_events
from oreflow.catalog.inputs import RUN_TS, ingest_time, parsed, topic
from oreflow.catalog.registry import query
from oreflow.functions.events import (
    date_parts,
    dead_letters,
    describe_event,
    effective_time,
    half_open,
    normalize_mixed,
    payload_preview,
    status_class,
    topic_key,
)
from oreflow.operators import dedup, metrics
from oreflow.plans import bronze as plan
from oreflow.plans import layers
from oreflow.schemas import BRONZE_COLUMNS as COLUMNS
from oreflow.session import work_path
from oreflow.sources import bindings
from oreflow.sources.topic import append_log, read_log


@query("bronze_parse", with_events(f"SELECT {BRONZE_COLUMNS} FROM parsed"))
def bronze_parse(spark, folder):
    return parsed(spark, folder)


@query(
    "bronze_dead_letter",
    with_events(
        "SELECT original_payload, error_type, error_message, TIMESTAMP '2024-03-01' AS failed_at, kafka_partition, kafka_offset "
        "FROM malformed"
    ),
)
def bronze_dead_letter(spark, folder):
    return dead_letters(topic(spark, folder), RUN_TS)


@query("bronze_dedup", with_events(f"SELECT {BRONZE_COLUMNS} FROM bronze"))
def bronze_dedup(spark, folder):
    return dedup.highest_offset(parsed(spark, folder))


@query(
    "dedup_first_wins",
    with_events(
        f"SELECT {BRONZE_COLUMNS} FROM parsed QUALIFY row_number() OVER "
        "(PARTITION BY event_id ORDER BY ingested_at, kafka_offset, kafka_partition) = 1"
    ),
)
def dedup_first_wins(spark, folder):
    return dedup.first_arrived(parsed(spark, folder))


@query(
    "dedup_latest",
    with_events(
        f"SELECT {BRONZE_COLUMNS} FROM parsed QUALIFY row_number() OVER "
        "(PARTITION BY event_id ORDER BY ingested_at DESC, kafka_offset DESC, kafka_partition DESC) = 1"
    ),
)
def dedup_latest(spark, folder):
    return dedup.latest_ingested(parsed(spark, folder))


@query(
    "dedup_by_input",
    with_events(
        "SELECT input_number, event_id, event_time, event_type, status FROM parsed WHERE status = 'SUCCESS' AND delivery = 0 "
        "QUALIFY row_number() OVER (PARTITION BY input_number ORDER BY event_time DESC, event_id DESC) = 1"
    ),
)
def dedup_by_input(spark, folder):
    first = dedup.first_arrived(parsed(spark, folder)).filter(F.col("status") == "SUCCESS")
    rows = first.select("input_number", "event_id", "event_time", "event_type", "status")
    return dedup.latest_per_input(rows, "input_number", "event_time", "event_id")


def _new_bronze(spark):
    return layers.bronze(spark, work_path(spark, "bronze"))


@query("bronze_incremental", with_events(f"SELECT {BRONZE_COLUMNS} FROM parsed WHERE delivery = 0"))
def bronze_incremental(spark, folder):
    """Two runs over a growing topic log: the second sees the rest and copies."""
    path = work_path(spark, "topic")
    records, table = topic(spark, folder), _new_bronze(spark)
    early = F.col("timestamp") < F.lit("2024-01-15").cast("timestamp")
    append_log(records.filter(early & bindings.first_delivery()), path)
    plan.ingest(read_log(spark, path), table, ingest_time())
    append_log(records.filter(~early | ~bindings.first_delivery()), path)
    plan.ingest(read_log(spark, path).filter(bindings.first_delivery()), table, ingest_time())
    plan.ingest(read_log(spark, path), table, ingest_time())
    return table.read().select(*COLUMNS)


@query(
    "bronze_backfill",
    with_events(
        f"SELECT {BRONZE_COLUMNS} FROM bronze WHERE event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-20'"
    ),
)
def bronze_backfill(spark, folder):
    table = _new_bronze(spark)
    plan.backfill(topic(spark, folder), table, ingest_time(), "2024-01-05", "2024-01-20")
    return table.read().select(*COLUMNS)


@query(
    "topic_serialize",
    with_events(
        """
SELECT event_id, CASE WHEN input_number IS NOT NULL THEN event_type || '-' || input_number
         ELSE event_type || '-' || coalesce(CAST(range_min AS VARCHAR), 'null') || '-' || coalesce(CAST(range_max AS VARCHAR), 'null')
       END AS record_key,
       strftime(event_time, '%Y-%m-%dT%H:%M:%S.%fZ') AS event_time_text, input_number, status
FROM ev"""
    ),
)
def topic_serialize(spark, folder):
    """Keys of the records, and fields read back from their JSON."""
    from oreflow.functions.events import to_topic_record
    from oreflow.schemas import EVENT_JSON

    records = to_topic_record(bindings.conversion_events(spark, folder)).select(
        F.col("key").cast("string").alias("record_key"), F.from_json(F.col("value").cast("string"), EVENT_JSON).alias("e")
    )
    return records.select(
        F.col("e.eventId").alias("event_id"), "record_key", F.col("e.eventTime").alias("event_time_text"),
        F.col("e.inputNumber").alias("input_number"), F.col("e.status").alias("status"),
    )


@query(
    "event_shape",
    with_events(
        """
SELECT event_id, event_type, CASE WHEN status <> 'SUCCESS' THEN 'ERROR' ELSE event_type END AS kind,
  CASE WHEN status = 'SUCCESS' AND event_type = 'SINGLE' THEN input_number END AS input_number,
  CASE WHEN status = 'SUCCESS' AND event_type = 'RANGE' THEN range_min END AS range_min,
  CASE WHEN status = 'SUCCESS' AND event_type = 'RANGE' THEN range_max END AS range_max,
  CASE WHEN status <> 'SUCCESS' THEN 0 ELSE response_time_nanos END AS response_time_nanos, status,
  CASE WHEN status <> 'SUCCESS' THEN event_type || '-null-null'
       WHEN event_type = 'RANGE' THEN event_type || '-' || range_min || '-' || range_max
       ELSE event_type || '-' || input_number END AS record_key
FROM ev"""
    ),
)
def event_shape(spark, folder):
    return bindings.shaped_events(spark, folder).select(
        "event_id", "event_type", "kind", "input_number", "range_min", "range_max", "response_time_nanos", "status",
        topic_key().alias("record_key"),
    )


@query(
    "normalize_event_shape",
    with_events(
        """
SELECT event_id, event_time, event_type, user_id, api_key_prefix, client_ip,
  CASE WHEN n % 2 = 1 THEN correlation_id END AS correlation_id, input_number, output_roman, range_min, range_max,
  CASE WHEN n % 2 = 1 OR status = 'SUCCESS' THEN result_count END AS result_count,
  CASE WHEN n % 2 = 1 THEN response_time_nanos END AS response_time_nanos, status, kafka_partition, kafka_offset
FROM ev"""
    ),
)
def normalize_event_shape(spark, folder):
    rows = normalize_mixed(bindings.legacy_topic(spark, folder), RUN_TS)
    return rows.drop("ingested_at", "page_offset", "page_limit")


@query(
    "event_audit_columns",
    with_events(
        """
SELECT event_id, kafka_offset, CAST(year(event_time) AS INTEGER) AS year, CAST(month(event_time) AS INTEGER) AS month,
  CAST(day(event_time) AS INTEGER) AS day,
  strftime(event_time, '%Y-%m-%d') AS event_date, event_time AS effective_time, status,
  CASE WHEN status = 'SUCCESS' THEN 'SUCCESS' WHEN starts_with(status, 'ERROR') THEN 'ERROR' ELSE 'UNKNOWN' END AS status_class,
  response_time_nanos / 1000000.0 AS response_time_ms,
  'BRONZE_EVENT: id=' || event_id || ', type=' || event_type || ', input=' || coalesce(CAST(input_number AS VARCHAR), 'null')
    || ', output=' || coalesce(output_roman, 'null') AS line,
  left(event_id || '/' || client_ip || '/' || correlation_id, 40) AS preview
FROM parsed"""
    ),
)
def event_audit_columns(spark, folder):
    from oreflow.functions.events import event_date_text, nanos_to_millis

    return parsed(spark, folder).select(
        "event_id", "kafka_offset", *date_parts(RUN_TS), event_date_text().alias("event_date"),
        effective_time(RUN_TS).alias("effective_time"), "status", status_class().alias("status_class"),
        nanos_to_millis(F.col("response_time_nanos")).alias("response_time_ms"), describe_event().alias("line"),
        payload_preview(F.concat_ws("/", "event_id", "client_ip", "correlation_id"), 40).alias("preview"),
    )


@query(
    "high_water_marks",
    with_events("SELECT kafka_partition, max(kafka_offset) AS max_offset FROM bronze GROUP BY 1"),
)
def high_water_marks(spark, folder):
    return metrics.high_water_mark(dedup.highest_offset(parsed(spark, folder)))


@query(
    "consumer_lag",
    with_events(
        """
, ends AS (SELECT kafka_partition, max(o) AS end_offset FROM (
    SELECT kafka_partition, kafka_offset AS o FROM delivered UNION ALL SELECT kafka_partition, kafka_offset FROM malformed)
  GROUP BY 1),
marks AS (SELECT kafka_partition, max(kafka_offset) AS m FROM delivered WHERE delivery = 0
          AND arrival < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT kafka_partition, end_offset, coalesce(m, -1) AS ingested_offset, end_offset - coalesce(m, -1) AS lag
FROM ends LEFT JOIN marks USING (kafka_partition)"""
    ),
)
def consumer_lag(spark, folder):
    """Lag of a bronze table loaded with first copies up to 20 January."""
    seen = parsed(spark, folder).filter(
        half_open("ingested_at", None, "2024-01-20 00:05:00") & bindings.first_delivery("kafka_offset")
    )
    return metrics.consumer_lag(topic(spark, folder), seen)


@query(
    "batch_metrics",
    with_events("SELECT count(*) AS rows, max(kafka_offset) AS max_offset FROM bronze"),
)
def batch_metrics(spark, folder):
    """Row count and highest offset of one ingest run, taken while it runs."""
    from pyspark.sql import Observation

    from oreflow.session import materialize

    seen = Observation()
    rows = dedup.highest_offset(parsed(spark, folder)).select("kafka_offset")
    materialize(spark, rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("kafka_offset").alias("max_offset")))
    return spark.createDataFrame([(seen.get["rows"], seen.get["max_offset"])], "rows long, max_offset long")
