"""Joins against keys, users, numerals, logs and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.functions import requests as rq
from oreflow.functions.roman import MAX_NUMBER, MIN_NUMBER, to_roman
from oreflow.operators.sizing import sized_side

# Spread of rows without a usable key over join partitions.
KEYLESS_BUCKETS = 1024


def validate_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests with the outcome of their API key as of the request time.

    ``requests`` has request_id, presented_key, requested_at; ``keys`` has
    key_hash, key_prefix, active, revoked_at, expires_at. Requests whose key is
    refused before the lookup carry a spread placeholder hash, so they do not
    meet in one join partition.
    """
    refused = rq.key_reject_reason(F.col("presented_key"))
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64("request_id"), F.lit(KEYLESS_BUCKETS)).cast("string"))
    asked = requests.withColumn("_refused", refused).withColumn(
        "key_hash", F.when(F.col("_refused").isNull(), rq.key_hash(F.trim("presented_key"))).otherwise(spread)
    )
    known = sized_side(
        keys.select("key_hash", "key_prefix", "active", "revoked_at", "expires_at", F.lit(True).alias("_known"))
    )
    at = F.col("requested_at")
    outcome = (
        F.when(F.col("_refused").isNotNull(), F.col("_refused"))
        .when(F.col("_known").isNull(), "UNKNOWN_KEY")
        .when(F.col("revoked_at") <= at, "REVOKED")
        .when(~F.col("active"), "INACTIVE")
        .when(F.col("expires_at") < at, "EXPIRED")
        .otherwise("VALID")
    )
    return asked.join(known, "key_hash", "left").select(
        "request_id", "requested_at", F.col("key_prefix"), outcome.alias("outcome")
    )


def keys_with_users(keys: DataFrame, users: DataFrame, only_active: bool = False) -> DataFrame:
    """Keys with the name of their owner."""
    wanted = keys.filter("active") if only_active else keys
    return wanted.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "inner")


def numeral_table(spark) -> DataFrame:
    """All numbers with their numeral: 3,999 rows, whatever the data size."""
    return spark.range(MIN_NUMBER, MAX_NUMBER + 1).select(
        F.col("id").cast("int").alias("number"), to_roman(F.col("id").cast("int")).alias("numeral")
    )


def lookup_numerals(numbers: DataFrame, column: str) -> DataFrame:
    """Numbers with their numeral by broadcast join; NULL outside the domain."""
    table = F.broadcast(numeral_table(numbers.sparkSession))
    return numbers.join(table, F.col(column) == F.col("number"), "left").drop("number")


def match_logs_to_events(logs: DataFrame, events: DataFrame) -> DataFrame:
    """Per correlation id: log lines, events and who is missing.

    Both sides are counted per id before the join, so an id with many lines
    and many events gives one row and not their product.
    """
    lines = logs.filter(F.col("correlation_id").isNotNull()).groupBy("correlation_id").agg(
        F.count("*").alias("log_lines"), F.max("duration_ms").alias("max_duration_ms")
    )
    sent = events.filter(F.col("correlation_id").isNotNull()).groupBy("correlation_id").agg(
        F.count("*").alias("events"), F.max("response_time_nanos").alias("max_response_time_nanos")
    )
    side = F.when(F.col("events").isNull(), "LOG_ONLY").when(F.col("log_lines").isNull(), "EVENT_ONLY").otherwise("MATCHED")
    return lines.join(sent, "correlation_id", "full_outer").select(
        "correlation_id",
        F.coalesce("log_lines", F.lit(0)).alias("log_lines"),
        F.coalesce("events", F.lit(0)).alias("events"),
        "max_duration_ms",
        "max_response_time_nanos",
        side.alias("match_state"),
    )


def touch_last_used(keys: DataFrame, used: DataFrame) -> DataFrame:
    """Keys with ``last_used_at`` moved forward to the latest use.

    ``used`` has key_prefix and used_at; it is reduced to one row per key
    before the join.
    """
    latest = used.groupBy("key_prefix").agg(F.max("used_at").alias("_used"))
    return keys.join(latest, "key_prefix", "left").withColumn(
        "last_used_at", F.greatest("last_used_at", "_used")
    ).drop("_used")


def revoke_keys(keys: DataFrame, revocations: DataFrame, revoked_at) -> DataFrame:
    """Keys with the listed prefixes switched off; earlier revocations stay."""
    listed = sized_side(revocations.select("key_prefix").distinct().withColumn("_listed", F.lit(True)))
    hit = F.col("_listed").isNotNull()
    return (
        keys.join(listed, "key_prefix", "left")
        .withColumn("revoked_at", F.when(hit, F.coalesce("revoked_at", F.lit(revoked_at).cast("timestamp"))).otherwise(F.col("revoked_at")))
        .withColumn("active", F.col("active") & ~hit)
        .drop("_listed")
    )


def star(facts: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Facts joined to dimensions given as {fact column: (dimension, column)}."""
    joined = facts
    for column, (dim, dim_key) in dims.items():
        side = sized_side(dim.withColumnRenamed(dim_key, column))
        joined = joined.join(side, column, "left")
    return joined
