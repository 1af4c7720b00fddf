"""Parsing, shaping and serialising of conversion events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.schemas import BRONZE_COLUMNS, EVENT_FIELDS, EVENT_JSON, FACT_COLUMNS, LEGACY_JSON

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def instant(value: str | datetime | Column) -> Column:
    """A timestamp literal from ISO text or a datetime; Columns pass through."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def half_open(column: str, start=None, end=None) -> Column:
    """``start <= column < end`` with each bound optional."""
    test = F.lit(True)
    if start is not None:
        test = test & (F.col(column) >= instant(start))
    if end is not None:
        test = test & (F.col(column) < instant(end))
    return test


def decode_envelope(topic: DataFrame) -> DataFrame:
    """Bytes to text and the five source columns under their table names."""
    return topic.select(
        F.col("key").cast("string").alias("kafka_key"),
        F.col("value").cast("string").alias("raw_value"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
    )


def _decoded(topic: DataFrame) -> DataFrame:
    """Envelope columns and one column per JSON field, all NULL if malformed.

    ``inline`` keeps a later filter on a field above the parsing; pushed below
    it, the filter would parse each payload a second time.
    """
    event = F.from_json("raw_value", EVENT_JSON)
    return decode_envelope(topic).select("*", F.inline(F.array(event)))


def _flatten(event=F.col) -> list[Column]:
    """The event's columns; ``event`` gives the Column of a JSON field."""
    columns = []
    for field, column, _ in EVENT_FIELDS:
        value = event(field)
        columns.append((F.try_to_timestamp(value) if column == "event_time" else value).alias(column))
    return columns


def parse_events(topic: DataFrame, ingested_at) -> DataFrame:
    """Topic rows to the 19 bronze columns; malformed rows are dropped here
    and kept by :func:`dead_letters`."""
    stamp = instant(ingested_at).alias("ingested_at")
    return (
        _decoded(topic)
        .filter(F.col("eventId").isNotNull())
        .select(*_flatten(), stamp, "kafka_partition", "kafka_offset")
    )


def dead_letters(topic: DataFrame, failed_at) -> DataFrame:
    """Rows :func:`parse_events` drops, with the reason."""
    broken = F.get_json_object("raw_value", "$").isNull()
    return (
        _decoded(topic)
        .filter(F.col("eventId").isNull())
        .select(
            F.col("raw_value").alias("original_payload"),
            F.when(broken, "MALFORMED_JSON").otherwise("MISSING_EVENT_ID").alias("error_type"),
            F.when(broken, "payload is not a JSON object").otherwise("eventId is null").alias("error_message"),
            instant(failed_at).alias("failed_at"),
            "kafka_partition",
            "kafka_offset",
        )
    )


def topic_key() -> Column:
    """``TYPE-input``, else ``TYPE-min-max`` with missing parts as ``null``."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("null"))
    return F.when(
        F.col("input_number").isNotNull(), F.concat_ws("-", "event_type", text("input_number"))
    ).otherwise(F.concat_ws("-", "event_type", text("range_min"), text("range_max")))


def to_topic_record(events: DataFrame) -> DataFrame:
    """Event columns to a keyed JSON record; NULL fields are left out."""
    fields = []
    for field, column, _ in EVENT_FIELDS:
        value = F.date_format(column, ISO_MICROS) if column == "event_time" else F.col(column)
        fields.append(value.alias(field))
    return events.withColumn("key", topic_key().cast("binary")).withColumn(
        "value", F.to_json(F.struct(*fields)).cast("binary")
    )


def shape_by_kind(requests: DataFrame) -> DataFrame:
    """Null out the columns that do not belong to a request's kind.

    ``kind`` is SINGLE, RANGE or ERROR; an error keeps only the request and
    takes its status from ``error_status``.
    """
    single, ranged, failed = (F.col("kind") == k for k in ("SINGLE", "RANGE", "ERROR"))
    keep = {
        "input_number": single,
        "output_roman": single,
        "range_min": ranged,
        "range_max": ranged,
        "result_count": ranged,
        "page_offset": ranged,
        "page_limit": ranged,
    }
    shaped = requests.withColumns({name: F.when(test, F.col(name)) for name, test in keep.items()})
    return shaped.withColumns(
        {
            "response_time_nanos": F.when(failed, F.lit(0)).otherwise(F.col("response_time_nanos")).cast("long"),
            "status": F.when(failed, F.col("error_status")).otherwise("SUCCESS"),
        }
    )


def conversion_count(event_type: str = "event_type", low: str = "range_min", high: str = "range_max") -> Column:
    """Numbers converted by one event, in long arithmetic."""
    width = F.col(high).cast("long") - F.col(low).cast("long") + 1
    return F.when(F.upper(event_type) == "RANGE", width).otherwise(F.lit(1).cast("long"))


def event_date(column: str | Column = "event_time") -> Column:
    return F.to_date(column)


def event_date_text(column: str | Column = "event_time") -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def effective_time(run_ts, column: str = "event_time") -> Column:
    """Event time, or the processing time where it is missing."""
    return F.coalesce(F.col(column), instant(run_ts))


def date_parts(run_ts, column: str = "event_time") -> list[Column]:
    moment = effective_time(run_ts, column)
    return [F.year(moment).alias("year"), F.month(moment).alias("month"), F.dayofmonth(moment).alias("day")]


def status_class(status: str | Column = "status") -> Column:
    """SUCCESS, ERROR for every error text, else UNKNOWN."""
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status == "SUCCESS", "SUCCESS").when(status.startswith("ERROR"), "ERROR").otherwise("UNKNOWN")


def nanos_to_millis(nanos: Column) -> Column:
    return nanos / F.lit(1_000_000.0)


def describe_event() -> Column:
    """One printable line per bronze row."""
    return F.format_string(
        "BRONZE_EVENT: id=%s, type=%s, input=%s, output=%s",
        "event_id",
        "event_type",
        F.coalesce(F.col("input_number").cast("string"), F.lit("null")),
        F.coalesce("output_roman", F.lit("null")),
    )


def payload_preview(payload: str | Column, width: int = 100) -> Column:
    return F.left(payload, F.lit(width))


def to_fact(events: DataFrame, processed_at) -> DataFrame:
    """Successful bronze events to the silver fact columns (no dedup)."""
    return events.withColumns(
        {"conversion_count": conversion_count(), "processed_at": instant(processed_at)}
    ).select(*FACT_COLUMNS)


def normalize_mixed(topic: DataFrame, ingested_at) -> DataFrame:
    """Records of the current and of the older event shape as bronze rows.

    A record is of the older shape when it carries ``conversionType``.
    """
    both = decode_envelope(topic).withColumns(
        {"event": F.from_json("raw_value", EVENT_JSON), "old": F.from_json("raw_value", LEGACY_JSON)}
    )
    old, kind = F.col("old"), F.upper("old.conversionType")
    legacy = old["conversionType"].isNotNull()
    failed = kind == "ERROR"
    ranged = old["minRange"].isNotNull()
    none = lambda t: F.lit(None).cast(t)
    values = {
        "event_id": old["eventId"],
        "event_time": F.try_to_timestamp(old["timestamp"]),
        "event_type": F.when(failed & ranged, "RANGE").when(failed, "SINGLE").otherwise(kind),
        "user_id": F.expr("try_cast(old.userId AS BIGINT)"),
        "api_key_prefix": old["apiKeyId"],
        "client_ip": old["clientIp"],
        "correlation_id": none("string"),
        "input_number": old["inputValue"],
        "output_roman": old["outputValue"],
        "range_min": old["minRange"],
        "range_max": old["maxRange"],
        "result_count": F.when(~failed & ranged, old["maxRange"] - old["minRange"] + 1),
        "page_offset": none("int"),
        "page_limit": none("int"),
        "response_time_nanos": none("long"),
        "status": F.when(failed, F.concat_ws("_", F.lit("ERROR"), old["errorType"])).otherwise("SUCCESS"),
    }
    current = dict(zip([c for _, c, _ in EVENT_FIELDS], _flatten(lambda field: F.col("event")[field])))
    merged = [F.when(legacy, values[c]).otherwise(current[c]).alias(c) for c in values]
    return (
        both.filter(F.coalesce("event.eventId", "old.eventId").isNotNull())
        .select(*merged, instant(ingested_at).alias("ingested_at"), "kafka_partition", "kafka_offset")
        .select(*BRONZE_COLUMNS)
    )
