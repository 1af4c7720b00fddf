"""Summary tables: pre-aggregated group-bys, exact everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreflow.functions.events import event_date, event_date_text, half_open, instant, nanos_to_millis
from oreflow.functions.roman import roundness, size_bucket
from oreflow.operators.quantiles import cell_of, exact_percentiles
from oreflow.operators.sizing import sized_side
from oreflow.session import materialize

POPULAR_LIMIT = 100


def _count_type(kind: str) -> Column:
    return F.count_if(F.upper("event_type") == kind)


# ------------------------------------------------------------ gold tables
def daily_summary(facts: DataFrame, generated_at) -> DataFrame:
    return (
        facts.groupBy(event_date_text().alias("event_date"))
        .agg(
            F.count("*").alias("total_conversions"),
            F.sum("conversion_count").alias("total_numbers_converted"),
            _count_type("SINGLE").alias("single_conversions"),
            _count_type("RANGE").alias("range_conversions"),
            F.max("input_number").alias("max_number_converted"),
            F.min("input_number").alias("min_number_converted"),
            F.avg("response_time_nanos").alias("avg_response_time_ns"),
        )
        .withColumn("generated_at", instant(generated_at))
    )


def daily_summary_of_interval(facts: DataFrame, start, end, generated_at) -> DataFrame:
    """Summary of the days touched by facts processed in the interval.

    ``facts`` should have a partition column ``event_date``: the span of the
    touched days prunes files when planning, the semi join prunes the days
    between them while running.
    """
    touched = sized_side(facts.filter(half_open("processed_at", start, end)).select("event_date").distinct())
    first, last = touched.agg(F.min("event_date"), F.max("event_date")).first()
    span = F.col("event_date").between(F.lit(first), F.lit(last))
    days = facts.filter(span).join(touched.filter(span), "event_date", "left_semi")
    return daily_summary(days, generated_at)


def _user_aggregates() -> list[Column]:
    return [
        F.count("*").alias("total_requests"),
        F.sum("conversion_count").alias("total_numbers"),
        F.avg("input_number").alias("avg_input_value"),
        F.max("event_time").alias("last_activity"),
    ]


def user_metrics(facts: DataFrame, generated_at) -> DataFrame:
    return (
        facts.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(*_user_aggregates())
        .withColumn("generated_at", instant(generated_at))
    )


def user_metrics_of_interval(facts: DataFrame, start, end, generated_at) -> DataFrame:
    """Metrics of the users touched in the interval, over all their facts.

    Whether a user is touched is one more aggregate of the same pass: the facts
    are read once and no join is needed.
    """
    return (
        facts.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(*_user_aggregates(), F.bool_or(half_open("processed_at", start, end)).alias("_touched"))
        .filter("_touched")
        .drop("_touched")
        .withColumn("generated_at", instant(generated_at))
    )


def user_day_sums(facts: DataFrame) -> DataFrame:
    """Mergeable sums per user and day, from which :func:`user_sums` adds up any span of days."""
    numbers = F.col("input_number")
    return (
        facts.filter(F.col("user_id").isNotNull())
        .groupBy("user_id", "event_date")
        .agg(
            F.count("*").alias("requests"),
            F.sum("conversion_count").alias("numbers"),
            F.sum(numbers).alias("input_sum"),
            F.count(numbers).alias("inputs"),
            F.max("event_time").alias("last_activity"),
        )
    )


def changed_sums(before: DataFrame, after: DataFrame, totals: DataFrame, days: DataFrame) -> DataFrame:
    """The new totals of the users whose sums per day changed.

    ``before`` and ``after`` are the sums of the same days, ``totals`` holds the users' sums so far and ``days`` all
    current sums per day. Counts and sums change by the difference. The last activity is the newer one, unless
    the days have lost the event that was the last: only such users' other days are read. Users without any
    request left come with 0 requests.
    """
    sums = ["requests", "numbers", "input_sum", "inputs"]
    signed = lambda rows, sign: rows.select("user_id", *[(F.col(c) * sign).alias(c) for c in sums],
                                            F.when(F.lit(sign > 0), F.col("last_activity")).alias("_new"),
                                            F.when(F.lit(sign < 0), F.col("last_activity")).alias("_old"))
    change = signed(after, 1).unionByName(signed(before, -1)).groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("_new").alias("_new"), F.max("_old").alias("_old")
    )
    change = sized_side(change)
    held = totals.select("user_id", *[F.col(c).alias(f"_{c}") for c in sums], F.col("last_activity").alias("_last"))
    both = change.join(held, "user_id", "left")
    added = [(F.coalesce(f"_{c}", F.lit(0)) + F.coalesce(c, F.lit(0))).alias(c) for c in sums]
    lost = (F.col("_old") == F.col("_last")) & F.coalesce(F.col("_new") < F.col("_last"), F.lit(True))
    found = both.select("user_id", *added, F.greatest("_last", "_new").alias("last_activity"), F.coalesce(lost, F.lit(False)).alias("_lost"))
    again = sized_side(found.filter("_lost").select("user_id"))
    ends = days.join(again, "user_id", "left_semi").groupBy("user_id").agg(F.max("last_activity").alias("_end"))
    known = found.join(ends, "user_id", "left")
    last = F.when(F.col("_lost"), F.col("_end")).otherwise(F.col("last_activity"))
    return known.withColumn("last_activity", last).drop("_lost", "_end")


def user_sums(days: DataFrame) -> DataFrame:
    """Totals per user of the sums per day."""
    sums = ["requests", "numbers", "input_sum", "inputs"]
    return days.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in sums], F.max("last_activity").alias("last_activity"))


def metrics_of_sums(totals: DataFrame) -> DataFrame:
    """The user metrics that the totals stand for."""
    return totals.select(
        "user_id",
        F.col("requests").alias("total_requests"),
        F.col("numbers").alias("total_numbers"),
        F.try_divide(F.col("input_sum").cast("double"), F.col("inputs")).alias("avg_input_value"),
        "last_activity",
        "generated_at",
    )


def popular_numbers(facts: DataFrame, generated_at, limit: int = POPULAR_LIMIT) -> DataFrame:
    """The most requested numbers; ties go to the smaller number."""
    return (
        facts.filter(F.col("input_number").isNotNull())
        .groupBy("input_number", "output_roman")
        .agg(F.count("*").alias("request_count"))
        .orderBy(F.desc("request_count"), "input_number", "output_roman")
        .limit(limit)
        .withColumn("generated_at", instant(generated_at))
    )


def user_snapshot(facts: DataFrame, run_ts) -> DataFrame:
    """One row per user with placeholder version columns."""
    return (
        facts.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.max("client_ip").alias("last_client_ip"),
            F.count("*").alias("total_requests"),
            F.max("event_time").alias("last_activity"),
        )
        .withColumns(
            {
                "valid_from": instant(run_ts),
                "valid_to": instant(run_ts),
                "is_current": F.lit(True),
                "version": (F.col("total_requests") % 100 + 1).cast("int"),
            }
        )
    )


# -------------------------------------------------------- declared tables
def daily_stats(events: DataFrame) -> DataFrame:
    """Daily statistics with exact latency percentiles, errors included.

    One scan counts by (day, user) and by (day, latency cell); counts, distinct users and ranks follow from those
    rows, so one day with a third of the events is shared. Only the cells that hold a wanted rank are read again.
    """
    nanos = F.col("response_time_nanos")
    dated = events.withColumn("date_key", event_date())
    keys = ["date_key", "user_id", "_cell"]
    counted = dated.withColumn("_cell", cell_of(nanos)).groupingSets([keys[:2], [keys[0], keys[2]]], *keys).agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("_n"),
        _count_type("SINGLE").alias("_single"),
        _count_type("RANGE").alias("_range"),
        F.sum(nanos).alias("_nanos"),
        F.count(nanos).alias("_timed"),
        F.count_if(F.col("status") != "SUCCESS").alias("_errors"),
    )
    counted = materialize(events.sparkSession, counted)
    by_user, by_cell = counted.filter("_set = 1"), counted.filter("_set = 2")
    plain = by_user.groupBy("date_key").agg(
        F.sum("_n").alias("total_conversions"),
        F.sum("_single").alias("single_conversions"),
        F.sum("_range").alias("range_conversions"),
        F.count("user_id").alias("unique_users"),
        nanos_to_millis(F.try_divide(F.sum("_nanos").cast("double"), F.sum("_timed"))).alias("avg_response_time_ms"),
        F.sum("_errors").alias("error_count"),
    )
    cells = by_cell.select("date_key", "_cell", "_n")
    marks = exact_percentiles(dated, ["date_key"], nanos, [0.5, 0.95, 0.99], per_cell=cells)
    timed = marks.select(
        "date_key", *[nanos_to_millis(F.col(p)).alias(f"{p}_response_time_ms") for p in ("p50", "p95", "p99")]
    )
    return plain.join(timed, "date_key", "left").withColumn("error_rate", F.col("error_count") / F.col("total_conversions"))


def number_popularity(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("input_number").isNotNull()).groupBy("input_number").agg(
        F.count("*").alias("conversion_count"), F.max("event_time").alias("last_converted_at")
    )


def hourly_aggregates() -> list[Column]:
    """Hourly measures, the same for batch and stream."""
    return [
        F.count("*").alias("total_requests"),
        F.count_if(F.col("status") == "SUCCESS").alias("success_count"),
        F.count_if(F.col("status") != "SUCCESS").alias("error_count"),
        nanos_to_millis(F.avg("response_time_nanos")).alias("avg_response_time_ms"),
        nanos_to_millis(F.max("response_time_nanos")).alias("max_response_time_ms"),
    ]


def hourly_metrics(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", "event_time").alias("hour_key")).agg(*hourly_aggregates())


def user_activity_daily(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("user_id").isNotNull()).groupBy("user_id", event_date().alias("activity_date")).agg(
        F.count("*").alias("requests"),
        F.sum("conversion_count").alias("numbers_converted"),
        _count_type("SINGLE").alias("single_conversions"),
        _count_type("RANGE").alias("range_conversions"),
        F.max("event_time").alias("last_activity"),
    )


def date_dimension(events: DataFrame) -> DataFrame:
    """Every calendar day between the first and the last event."""
    bounds = events.agg(F.min("event_time").alias("lo"), F.max("event_time").alias("hi"))
    days = bounds.select(F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"), F.expr("interval 1 day"))).alias("date_key"))
    return days.select(
        "date_key",
        F.year("date_key").alias("year"),
        F.quarter("date_key").alias("quarter"),
        F.month("date_key").alias("month"),
        F.dayofmonth("date_key").alias("day"),
        (F.weekday("date_key") + 1).alias("iso_weekday"),
        (F.weekday("date_key") >= 5).alias("is_weekend"),
    )


def conversion_type_dimension(events: DataFrame) -> DataFrame:
    """Event types with a key derived from the name, stable between runs."""
    return (
        events.filter(F.col("event_type").isNotNull())
        .select("event_type")
        .distinct()
        .select(F.left(F.sha2("event_type", 256), F.lit(16)).alias("conversion_type_key"), "event_type",
                (F.col("event_type") == "RANGE").alias("is_range"))
    )


# ------------------------------------------------------ ad-hoc analytics
def number_range_distribution(popular: DataFrame) -> DataFrame:
    """Requests per size class and their share, ordered by size."""
    classes = popular.groupBy(size_bucket(F.col("input_number")).alias("number_range")).agg(
        F.sum("request_count").alias("total_requests"), F.min("input_number").alias("_first")
    )
    total = popular.agg(F.sum("request_count")).scalar()
    return (
        classes.withColumn("percentage", F.round(F.col("total_requests") * 100.0 / total, 2))
        .orderBy("_first")
        .select("number_range", "total_requests", "percentage")
    )


def longest_numerals(popular: DataFrame, limit: int = 10) -> DataFrame:
    length = F.length("output_roman").alias("numeral_length")
    return popular.select("input_number", "output_roman", length, "request_count").orderBy(
        F.desc("numeral_length"), F.desc("request_count"), "input_number"
    ).limit(limit)


def round_number_preference(popular: DataFrame) -> DataFrame:
    return popular.groupBy(roundness(F.col("input_number")).alias("number_type")).agg(
        F.count("*").alias("unique_numbers"), F.sum("request_count").alias("total_requests")
    ).orderBy(F.desc("total_requests"), "number_type")


def user_activity_summary(users: DataFrame) -> DataFrame:
    return users.agg(
        F.count("*").alias("total_users"),
        F.sum("total_requests").alias("total_requests"),
        F.round(F.avg("total_requests"), 2).alias("avg_requests_per_user"),
        F.max("total_requests").alias("max_requests_by_user"),
    )


# ------------------------------------------------------------ operations
def high_water_mark(bronze: DataFrame, per_partition: bool = True) -> DataFrame:
    """Highest offset already ingested; -1 for an empty table (global form)."""
    if per_partition:
        return bronze.groupBy("kafka_partition").agg(F.max("kafka_offset").alias("max_offset"))
    return bronze.agg(F.coalesce(F.max("kafka_offset"), F.lit(-1)).alias("max_offset"))


def consumer_lag(topic: DataFrame, bronze: DataFrame) -> DataFrame:
    """Per topic partition: end offset, ingested offset and the difference.

    Both sides have one row per topic partition before the join.
    """
    ends = topic.groupBy(F.col("partition").alias("kafka_partition")).agg(F.max("offset").alias("end_offset"))
    marks = high_water_mark(bronze)
    return ends.join(marks, "kafka_partition", "left").select(
        "kafka_partition",
        "end_offset",
        F.coalesce("max_offset", F.lit(-1)).alias("ingested_offset"),
        (F.col("end_offset") - F.coalesce("max_offset", F.lit(-1))).alias("lag"),
    )


def key_summary(keys: DataFrame) -> DataFrame:
    return keys.agg(
        F.count("*").alias("total_keys"),
        F.count_if("active").alias("active_keys"),
        F.count_if(~F.col("active")).alias("inactive_keys"),
        F.count_if(F.col("revoked_at").isNotNull()).alias("revoked_keys"),
        F.max("last_used_at").alias("last_used_at"),
    )


def active_keys_per_user(keys: DataFrame, limit: int) -> DataFrame:
    return keys.groupBy("user_id").agg(F.count_if("active").alias("active_keys")).withColumn(
        "over_limit", F.col("active_keys") > limit
    )


def latency_report(events: DataFrame, slo_ms: list[int], p95_limit_ms: float, error_limit: float) -> DataFrame:
    """One row: latency and range-size percentiles, cumulative SLO buckets,
    error rate and whether the thresholds hold.

    One scan counts by latency cell and by range size; only the cells with a wanted rank are read again."""
    nanos = F.col("response_time_nanos")
    spread = F.when(F.col("range_max").isNotNull(), F.col("range_max").cast("long") - F.col("range_min") + 1)
    counted = events.withColumns({"_cell": cell_of(nanos), "_spread": spread})
    counted = counted.groupingSets([["_cell"], ["_spread"]], "_cell", "_spread").agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("_n"),
        F.sum(nanos).alias("_nanos"),
        F.count(nanos).alias("_timed"),
        F.max(nanos).alias("_max"),
        *[F.count_if(nanos <= ms * 1_000_000).alias(f"_within_{ms}") for ms in slo_ms],
        F.count_if(F.col("status") != "SUCCESS").alias("_errors"),
    )
    counted = materialize(events.sparkSession, counted)
    by_cell, by_spread = counted.filter("_set = 1"), counted.filter("_set = 2")
    one = F.lit(1).alias("_one")
    requests = F.coalesce(F.sum("_n"), F.lit(0))
    base = by_cell.agg(
        one,
        requests.alias("requests"),
        nanos_to_millis(F.try_divide(F.sum("_nanos").cast("double"), F.sum("_timed"))).alias("avg_ms"),
        nanos_to_millis(F.max("_max")).alias("max_ms"),
        *[F.coalesce(F.sum(f"_within_{ms}"), F.lit(0)).alias(f"within_{ms}_ms") for ms in slo_ms],
        F.try_divide(F.sum("_errors"), requests).alias("error_rate"),
    )
    probs = [0.5, 0.95, 0.99]
    time = exact_percentiles(events, [], nanos, probs, per_cell=by_cell.select("_cell", "_n")).select(
        one, *[nanos_to_millis(F.col(p)).alias(f"{p}_ms") for p in ("p50", "p95", "p99")]
    )
    sizes = by_spread.select(F.col("_spread").alias("_cell"), "_n")
    size = exact_percentiles(events, [], spread, probs, cell_bits=0, per_cell=sizes).select(
        one, *[F.col(p).alias(f"range_size_{p}") for p in ("p50", "p95", "p99")]
    )
    # Three one-row tables side by side.
    return (
        base.join(F.broadcast(time), "_one", "left")
        .join(F.broadcast(size), "_one", "left")
        .drop("_one")
        .withColumn("latency_ok", F.col("p95_ms") < p95_limit_ms)
        .withColumn("errors_ok", F.col("error_rate") < error_limit)
    )


def requests_per_minute(access: DataFrame) -> DataFrame:
    """Requests, status classes and p95 duration per minute.

    Lines are read once: they are counted by duration first, and sums and ranks come from those counts.
    """
    status, duration = F.col("status"), F.col("duration_ms")
    timed = access.filter(status.isNotNull()).withColumn("minute", F.window("logged_at", "1 minute")["start"])
    classes = {"ok_2xx": 200, "client_4xx": 400, "server_5xx": 500}
    values = timed.groupBy("minute", "duration_ms").agg(
        F.count("*").alias("requests"),
        *[F.count_if((status >= low) & (status < low + 100)).alias(name) for name, low in classes.items()],
    )
    counted = F.sum(F.when(duration.isNotNull(), F.col("requests")))
    minute = Window.partitionBy("minute")
    ranked = values.withColumns(
        {"_upto": counted.over(minute.orderBy("duration_ms")), "_spot": F.lit(0.95) * (counted.over(minute) - 1)}
    )
    low, high = (F.min(F.when(F.col("_upto") > rank, duration)) for rank in (F.floor("_spot"), F.ceil("_spot")))
    share = F.max(F.col("_spot") - F.floor("_spot"))
    return ranked.groupBy("minute").agg(
        *[F.sum(name).alias(name) for name in ("requests", *classes)],
        (F.sum("ok_2xx") / F.sum("requests")).alias("availability"),
        (low + (high - low) * share).cast("double").alias("p95_ms"),
    )
