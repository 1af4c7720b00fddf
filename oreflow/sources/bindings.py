"""The service's inputs, derived from the given star and event tables.

Everything is a deterministic projection of whole tables, so the work of every
registered query grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.functions.events import ISO_MICROS, shape_by_kind, to_topic_record
from oreflow.functions.requests import key_hash
from oreflow.functions.roman import to_roman
from oreflow.session import prepare

# Fixed values of the fixture: offsets of a topic partition interleave the kinds of records, so they
# stay unique for event ids of any size.
KINDS = 4
FIRST, COPY, NOT_JSON, NO_ID = range(KINDS)


def position(kind: int) -> Column:
    """Offset of a record of the event number ``n``."""
    return F.expr("n div 3") * KINDS + kind


def first_delivery(offset: str = "offset") -> Column:
    """Whether a record of the topic is the first delivery of an event."""
    return F.col(offset) % KINDS == FIRST


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _event_uuid(digest: Column) -> Column:
    cut = lambda start, size: F.substring(digest, start, size)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def conversion_events(spark: SparkSession, folder: str) -> DataFrame:
    """One conversion event per source row, with its topic position."""
    source = table(spark, folder, "events").select(
        F.col("event_id").alias("n"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("u"),
        F.col("event_type").alias("et"),
        F.col("value").alias("v"),
        F.md5(F.col("event_id").cast("string")).alias("h"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    n, u = F.col("n"), F.col("u")
    ranged = F.col("et") == "purchase"
    low, number = (F.col("k") % 100 + 1).cast("int"), F.floor("v").cast("int") + 1
    high = (F.col("k") % 100 + 1 + F.col("k") % 50 + 1).cast("int")
    raw = source.select(
        "n",
        _event_uuid(F.col("h")).alias("event_id"),
        F.when(n % 50 == 0, F.col("ts") - F.expr("interval 10 minutes")).otherwise(F.col("ts")).alias("event_time"),
        F.when(ranged, "RANGE").otherwise("SINGLE").alias("event_type"),
        F.when(F.col("et") != "view", u).alias("user_id"),
        F.when(u % 3 != 0, F.left(F.concat(F.lit("rns_"), F.md5(u.cast("string"))), F.lit(12))).alias("api_key_prefix"),
        F.concat_ws(".", F.lit("10"), u % 4, n % 7, u % 250 + 1).alias("client_ip"),
        F.left("h", F.lit(8)).alias("correlation_id"),
        F.when(~ranged, F.when(n % 5 == 0, ((n * 37) % 3999 + 1).cast("int")).otherwise(number)).alias("input_number"),
        F.when(ranged, low).alias("range_min"),
        F.when(ranged, high).alias("range_max"),
        F.round(F.col("v") * 1_000_000).cast("long").alias("response_time_nanos"),
        F.when(F.col("et") == "error", "ERROR_VALIDATION").otherwise("SUCCESS").alias("status"),
        (n % 3).cast("int").alias("partition"),
        position(FIRST).alias("offset"),
        F.col("ts").alias("timestamp"),
    )
    numeral = F.when(n % 211 == 0, "IIII").otherwise(to_roman(F.col("input_number")))
    good = (F.col("status") == "SUCCESS") & F.col("input_number").isNotNull()
    return raw.withColumns(
        {
            "output_roman": F.when(good, numeral),
            "result_count": F.col("range_max") - F.col("range_min") + 1,
            "page_offset": F.when(F.col("range_min").isNotNull(), 0),
            "page_limit": F.when(F.col("range_min").isNotNull(), 100),
        }
    )


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Events as delivered: every tenth one arrives again a day later."""
    first = conversion_events(spark, folder).withColumn("delivery", F.lit(0))
    again = (
        first.filter(F.col("n") % 10 == 0)
        .withColumns(
            {
                "offset": position(COPY),
                "timestamp": F.col("timestamp") + F.expr("interval 1 day"),
                "delivery": F.lit(1),
            }
        )
    )
    return first.unionByName(again)


def malformed_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records that are not JSON, and records without an event id."""
    n = F.col("event_id")
    base = table(spark, folder, "events").select(
        n.alias("n"), F.lit(None).cast("binary").alias("key"), (n % 3).cast("int").alias("partition"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    broken = base.filter(F.col("n") % 97 == 0).withColumns(
        {"value": F.lit("not json").cast("binary"), "offset": position(NOT_JSON)}
    )
    nameless = base.filter(F.col("n") % 101 == 0).withColumns(
        {"value": F.lit('{"eventType":"SINGLE"}').cast("binary"), "offset": position(NO_ID)}
    )
    return broken.unionByName(nameless)


TOPIC_COLUMNS = ["key", "value", "partition", "offset", "timestamp"]


def topic_log(spark: SparkSession, folder: str) -> DataFrame:
    """The topic: deliveries as keyed JSON, plus malformed records."""
    records = to_topic_record(deliveries(spark, folder)).select(*TOPIC_COLUMNS)
    return records.unionByName(malformed_records(spark, folder).select(*TOPIC_COLUMNS))


def segmented_topic(spark: SparkSession, folder: str) -> DataFrame:
    """The topic in three arrival segments, for streams.

    Segments follow the calendar (days 1-10, 11-20, rest); an event that is
    late by construction arrives one segment later, and copies arrive up to two
    segments after the original.
    """
    day = F.dayofmonth(F.col("timestamp") - F.when(F.col("delivery") == 1, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day")))
    calendar = F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
    late = F.when((F.col("n") % 50 == 0) & (F.col("delivery") == 0), 1).otherwise(0)
    copy = F.when(F.col("delivery") == 1, F.expr("n div 10") % 3).otherwise(0)
    segment = F.least(F.lit(2), calendar + late + copy).cast("int")
    good = to_topic_record(deliveries(spark, folder)).withColumn("segment", segment)
    bad_day = F.dayofmonth("timestamp")
    bad = malformed_records(spark, folder).withColumn(
        "segment", F.when(bad_day <= 10, 0).when(bad_day <= 20, 1).otherwise(2).cast("int")
    )
    return good.select(*TOPIC_COLUMNS, "segment").unionByName(bad.select(*TOPIC_COLUMNS, "segment"))


def legacy_topic(spark: SparkSession, folder: str) -> DataFrame:
    """Events in two shapes: even ones in the older shape, odd ones as now."""
    events = conversion_events(spark, folder)
    failed = F.col("status") != "SUCCESS"
    old = F.to_json(
        F.struct(
            F.col("event_id").alias("eventId"),
            F.date_format("event_time", ISO_MICROS).alias("timestamp"),
            F.col("user_id").cast("string").alias("userId"),
            F.col("api_key_prefix").alias("apiKeyId"),
            F.col("client_ip").alias("clientIp"),
            F.lit("agent").alias("userAgent"),
            F.when(failed, "error").otherwise(F.lower("event_type")).alias("conversionType"),
            F.col("input_number").alias("inputValue"),
            F.col("output_roman").alias("outputValue"),
            F.col("range_min").alias("minRange"),
            F.col("range_max").alias("maxRange"),
            F.when(failed, "VALIDATION").alias("errorType"),
        )
    ).cast("binary")
    current = to_topic_record(events)
    return current.withColumn("value", F.when(F.col("n") % 2 == 0, old).otherwise(F.col("value"))).select(*TOPIC_COLUMNS)


def service_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Raw requests before the service shapes them into events by kind."""
    events = conversion_events(spark, folder)
    return events.withColumns(
        {
            "kind": F.when(F.col("status") != "SUCCESS", "ERROR").otherwise(F.col("event_type")),
            "error_status": F.when(F.col("status") != "SUCCESS", F.col("status")),
            "output_roman": to_roman(F.col("input_number")),
            "range_min": F.coalesce("range_min", F.lit(1)),
            "range_max": F.coalesce("range_max", F.lit(2)),
        }
    )


def shaped_events(spark: SparkSession, folder: str) -> DataFrame:
    return shape_by_kind(service_requests(spark, folder))


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("segment")
    )


def _raw_key(number: Column) -> Column:
    return F.concat(F.lit("rns_"), number.cast("string"))


def api_keys(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("id"),
        F.left(F.concat(F.lit("rns_"), F.md5(key.cast("string"))), F.lit(12)).alias("key_prefix"),
        key_hash(_raw_key(key)).alias("key_hash"),
        (key % 150).alias("user_id"),
        (F.lit("2023-06-01").cast("timestamp") + F.make_dt_interval(days=(key % 200).cast("int"))).alias("created_at"),
        F.when(key % 7 == 0, F.lit("2024-01-15").cast("timestamp")).alias("expires_at"),
        F.when(key % 11 == 0, F.lit("2024-01-10").cast("timestamp")).alias("revoked_at"),
        (key % 13 != 0).alias("active"),
        F.when(key % 5 == 0, F.lit("2023-12-31").cast("timestamp")).alias("last_used_at"),
        F.when(key % 17 == 0, F.lit(10)).alias("rate_limit_override"),
    )


def key_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that present a key: some none, blank, foreign or unknown."""
    n = F.col("event_id")
    presented = (
        F.when(n % 9 == 0, F.lit(None).cast("string"))
        .when(n % 9 == 1, "  ")
        .when(n % 9 == 2, F.concat(F.lit("key_"), n.cast("string")))
        .when(n % 9 == 3, F.concat(F.lit(" "), _raw_key(F.col("user_id")), F.lit(" ")))
        .when(n % 9 == 4, _raw_key(n + 10_000_000))
        .otherwise(_raw_key(F.col("user_id")))
    )
    return table(spark, folder, "events").select(
        n.alias("request_id"), presented.alias("presented_key"), F.col("ts").cast("timestamp").alias("requested_at")
    )


def http_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with headers, before addresses and ids are resolved."""
    n, u = F.col("event_id"), F.col("user_id")
    remote = F.concat_ws(".", F.lit("172.16"), u % 200, n % 200)
    hop = F.concat_ws(".", F.lit("10"), u % 4, n % 7, u % 250 + 1)
    path = (
        F.when(n % 20 == 0, "/actuator/health")
        .when(n % 20 == 1, "/actuator/prometheus")
        .when(n % 20 == 2, "/swagger-ui/index.html")
        .otherwise(F.concat(F.lit("/romannumeral?query="), (F.floor("value").cast("long") + 1).cast("string")))
    )
    return table(spark, folder, "events").select(
        n.alias("request_id"),
        F.col("ts").cast("timestamp").alias("requested_at"),
        F.when(n % 4 == 0, F.concat(hop, F.lit(", 192.168.0.1"))).when(n % 4 == 1, hop).when(n % 4 == 2, "").alias("forwarded_for"),
        remote.alias("remote_addr"),
        F.when(n % 3 == 0, F.left(F.md5(n.cast("string")), F.lit(8))).when(n % 3 == 1, " ").alias("correlation_header"),
        path.alias("path"),
        F.when(F.col("event_type") == "error", F.when(n % 2 == 0, 400).otherwise(500)).otherwise(200).alias("status"),
        F.floor("value").cast("int").alias("duration_ms"),
    )


def container_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Container log lines: access lines, plain lines and broken lines."""
    n = F.col("event_id")
    when = F.col("ts").cast("timestamp")
    trace = F.left(F.md5(n.cast("string")), F.lit(8))
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    message = F.when(
        n % 10 == 9, F.concat(F.lit("Converted number "), F.floor("value").cast("string"))
    ).otherwise(
        F.concat(F.lit("method=GET path=/romannumeral?query="), F.floor("value").cast("string"), F.lit(" status="), status,
                 F.lit(" duration="), F.floor("value").cast("string"), F.lit("ms correlationId="), trace)
    )
    level = F.when(F.col("event_type") == "error", "WARN").otherwise("INFO")
    app = F.to_json(
        F.struct(
            F.date_format(when, "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"),
            level.alias("level"),
            F.lit("http-1").alias("thread"),
            trace.alias("correlationId"),
            F.lit("access").alias("logger"),
            message.alias("message"),
        )
    )
    envelope = F.to_json(
        F.struct(app.alias("log"), F.lit("stdout").alias("stream"), F.date_format(when, ISO_MICROS).alias("time"))
    )
    line = F.when(n % 61 == 0, F.concat(F.lit("plain text "), n.cast("string"))).otherwise(envelope)
    container = F.left(F.sha2((n % 5).cast("string"), 256), F.lit(64))
    path = F.concat(F.lit("/var/lib/docker/containers/"), container, F.lit("/"), container, F.lit("-json.log"))
    return table(spark, folder, "events").select(line.alias("value"), path.alias("file_path"))


def range_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Range requests over the order lines, valid and invalid."""
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    low = F.when((key + number) % 19 == 0, F.lit(None)).when(key % 23 == 0, 0).otherwise(F.col("l_partkey") % 3900 + 1)
    width = F.when(key % 29 == 0, 0).otherwise(F.col("l_quantity").cast("long"))
    return table(spark, folder, "lineitem").select(
        key.alias("order_key"),
        number.alias("line_number"),
        low.cast("int").alias("range_min"),
        F.when(key % 31 == 0, 4000 + number).otherwise(F.col("l_partkey") % 3900 + 1 + width).cast("int").alias("range_max"),
    )


def lineage_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Lineage run events of two kinds of jobs over the star tables.

    A job per part reads its suppliers and writes the part; a job per order
    reads its parts and writes the customer.
    """
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    name = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))
    supply = items.select("l_partkey", "l_suppkey").distinct().select(
        F.lit("2024-01-01").cast("timestamp").alias("event_time"),
        F.lit("COMPLETE").alias("event_type"),
        F.concat_ws("-", F.lit("run"), "l_partkey", "l_suppkey").alias("run_id"),
        name("supply", "l_partkey").alias("job_name"),
        F.array(name("supplier", "l_suppkey")).alias("inputs"),
        F.array(name("part", "l_partkey")).alias("outputs"),
    )
    sales = items.select("l_orderkey", "l_partkey").distinct().join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.when(F.col("o_orderstatus") == "P", "FAIL").otherwise("COMPLETE").alias("event_type"),
        F.concat_ws("-", F.lit("run"), F.lit("order"), "l_orderkey", "l_partkey").alias("run_id"),
        name("order", "o_orderkey").alias("job_name"),
        F.array(name("part", "l_partkey")).alias("inputs"),
        F.array(name("customer", "o_custkey")).alias("outputs"),
    )
    return supply.unionByName(sales)
