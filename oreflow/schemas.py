"""Record layouts of the topic, the layers and the legacy stream."""

from __future__ import annotations

from pyspark.sql import types as T

# JSON field, column name and type of a conversion event.
EVENT_FIELDS = [
    ("eventId", "event_id", T.StringType()),
    ("eventTime", "event_time", T.StringType()),
    ("eventType", "event_type", T.StringType()),
    ("userId", "user_id", T.LongType()),
    ("apiKeyPrefix", "api_key_prefix", T.StringType()),
    ("clientIp", "client_ip", T.StringType()),
    ("correlationId", "correlation_id", T.StringType()),
    ("inputNumber", "input_number", T.IntegerType()),
    ("outputRoman", "output_roman", T.StringType()),
    ("rangeMin", "range_min", T.IntegerType()),
    ("rangeMax", "range_max", T.IntegerType()),
    ("resultCount", "result_count", T.IntegerType()),
    ("pageOffset", "page_offset", T.IntegerType()),
    ("pageLimit", "page_limit", T.IntegerType()),
    ("responseTimeNanos", "response_time_nanos", T.LongType()),
    ("status", "status", T.StringType()),
]
EVENT_JSON = T.StructType([T.StructField(name, kind) for name, _, kind in EVENT_FIELDS])

# JSON field and type of the older stream event.
LEGACY_FIELDS = [
    ("eventId", T.StringType()),
    ("timestamp", T.StringType()),
    ("userId", T.StringType()),
    ("apiKeyId", T.StringType()),
    ("clientIp", T.StringType()),
    ("userAgent", T.StringType()),
    ("conversionType", T.StringType()),
    ("inputValue", T.IntegerType()),
    ("outputValue", T.StringType()),
    ("minRange", T.IntegerType()),
    ("maxRange", T.IntegerType()),
    ("rangeResults", T.StringType()),
    ("errorType", T.StringType()),
    ("errorMessage", T.StringType()),
]
LEGACY_JSON = T.StructType([T.StructField(name, kind) for name, kind in LEGACY_FIELDS])

TOPIC = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# Columns of the bronze table.
BRONZE_COLUMNS = [column for _, column, _ in EVENT_FIELDS] + ["ingested_at", "kafka_partition", "kafka_offset"]

# Columns of the silver fact table.
FACT_COLUMNS = [
    "event_id",
    "event_time",
    "event_type",
    "user_id",
    "client_ip",
    "correlation_id",
    "input_number",
    "output_roman",
    "range_min",
    "range_max",
    "result_count",
    "response_time_nanos",
    "status",
    "conversion_count",
    "processed_at",
]

# Container log envelope, application log line and lineage run event.
DOCKER_LOG = T.StructType([T.StructField(n, T.StringType()) for n in ("log", "stream", "time")])
APP_LOG = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("timestamp", "level", "thread", "correlationId", "logger", "logger_name", "message")]
)
LINEAGE_RUN = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("job_name", T.StringType()),
        T.StructField("inputs", T.ArrayType(T.StringType())),
        T.StructField("outputs", T.ArrayType(T.StringType())),
    ]
)
