"""Tables of the three layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.schemas import LINEAGE_RUN
from oreflow.sources.tables import SnapshotTable

# Users are spread over this many buckets, the rewrite unit of user tables.
USER_BUCKETS = 64

BRONZE_SCHEMA = (
    "event_id string, event_time timestamp, event_type string, user_id bigint, api_key_prefix string, client_ip string, "
    "correlation_id string, input_number int, output_roman string, range_min int, range_max int, result_count int, "
    "page_offset int, page_limit int, response_time_nanos bigint, status string, ingested_at timestamp, "
    "kafka_partition int, kafka_offset bigint, event_date date"
)
FACT_SCHEMA = (
    "event_id string, event_time timestamp, event_type string, user_id bigint, client_ip string, correlation_id string, "
    "input_number int, output_roman string, range_min int, range_max int, result_count int, response_time_nanos bigint, "
    "status string, conversion_count bigint, processed_at timestamp, event_date date"
)
USER_SNAPSHOT_SCHEMA = (
    "user_id bigint, last_client_ip string, total_requests bigint, last_activity timestamp, valid_from timestamp, "
    "valid_to timestamp, is_current boolean, version int, bucket int"
)
USER_HISTORY_SCHEMA = (
    "user_id bigint, client_ip string, valid_from timestamp, valid_to timestamp, is_current boolean, version bigint, bucket int"
)
DAILY_SCHEMA = (
    "event_date string, total_conversions bigint, total_numbers_converted bigint, single_conversions bigint, "
    "range_conversions bigint, max_number_converted int, min_number_converted int, avg_response_time_ns double, "
    "generated_at timestamp"
)
USER_METRICS_SCHEMA = (
    "user_id bigint, total_requests bigint, total_numbers bigint, avg_input_value double, last_activity timestamp, "
    "generated_at timestamp, bucket int"
)
USER_DAY_SCHEMA = (
    "user_id bigint, event_date date, requests bigint, numbers bigint, input_sum bigint, inputs bigint, last_activity timestamp"
)
USER_TOTAL_SCHEMA = (
    "user_id bigint, requests bigint, numbers bigint, input_sum bigint, inputs bigint, last_activity timestamp, "
    "generated_at timestamp, bucket int"
)
POPULAR_SCHEMA = "input_number int, output_roman string, request_count bigint, generated_at timestamp"


def user_bucket() -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(USER_BUCKETS)).cast("int")


def with_event_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("event_time"))


def with_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", user_bucket())


def _table(
    spark: SparkSession, root: str, name: str, ddl: str, part: str | None, key: tuple, fixed: bool = False, summary: bool = False
) -> SnapshotTable:
    return SnapshotTable(spark, f"{root}/{name}", ddl, part, key, fixed, summary)


def bronze(spark: SparkSession, root: str, fixed_time: bool = False) -> SnapshotTable:
    """``fixed_time``: producers never resend an event id with another time, so
    merges look for known ids in the days of the new rows only. Without it they
    look in the days whose bitmap of keys meets that of the new rows."""
    return _table(spark, root, "bronze/raw_conversion_events", BRONZE_SCHEMA, "event_date", ("event_id",), fixed_time, True)


def fact(spark: SparkSession, root: str, fixed_time: bool = False) -> SnapshotTable:
    """See :func:`bronze` for ``fixed_time``."""
    return _table(spark, root, "silver/fact_conversions", FACT_SCHEMA, "event_date", ("event_id",), fixed_time, True)


def user_snapshot(spark: SparkSession, root: str) -> SnapshotTable:
    return _table(spark, root, "silver/dim_users", USER_SNAPSHOT_SCHEMA, "bucket", ("user_id",), True)


def user_history(spark: SparkSession, root: str) -> SnapshotTable:
    return _table(spark, root, "silver/dim_users_history", USER_HISTORY_SCHEMA, "bucket", ("user_id", "version"), True)


def daily(spark: SparkSession, root: str) -> SnapshotTable:
    return _table(spark, root, "gold/daily_conversion_summary", DAILY_SCHEMA, "event_date", ("event_date",), True)


def user_metrics(spark: SparkSession, root: str) -> SnapshotTable:
    return _table(spark, root, "gold/user_metrics", USER_METRICS_SCHEMA, "bucket", ("user_id",), True)


def user_days(spark: SparkSession, root: str) -> SnapshotTable:
    return _table(spark, root, "gold/user_days", USER_DAY_SCHEMA, "event_date", ("user_id", "event_date"), True)


def user_totals(spark: SparkSession, root: str) -> SnapshotTable:
    return _table(spark, root, "gold/user_totals", USER_TOTAL_SCHEMA, "bucket", ("user_id",), True)


def popular(spark: SparkSession, root: str) -> SnapshotTable:
    return _table(spark, root, "gold/popular_numbers", POPULAR_SCHEMA, None, ("input_number", "output_roman"))


def quarantined(spark: SparkSession, root: str) -> SnapshotTable:
    """Rows, as JSON, that kept a run from being published."""
    return SnapshotTable(spark, f"{root}/quality/quarantined", "suite string, row string, reasons array<string>, found_at timestamp")


def lineage(spark: SparkSession, root: str) -> SnapshotTable:
    return SnapshotTable(spark, f"{root}/lineage/runs", LINEAGE_RUN)
