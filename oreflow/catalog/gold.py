"""Queries of the gold layer and the ad-hoc analytics."""

from __future__ import annotations

from oreflow.catalog.base_sql import POPULAR, with_events, with_facts
from oreflow.catalog.inputs import RUN_TS, bronze, facts, popular
from oreflow.catalog.registry import query
from oreflow.catalog.silver import HISTORY_SQL, stored_history
from oreflow.operators import lookups, metrics
from oreflow.plans import gold as plan
from oreflow.plans import layers, reports
from oreflow.session import work_path
from pyspark.sql import functions as F

STAMP = "TIMESTAMP '2024-03-01' AS generated_at"

DAILY_SQL = f"""
SELECT strftime(event_time, '%Y-%m-%d') AS event_date, count(*) AS total_conversions,
  CAST(sum(conversion_count) AS BIGINT) AS total_numbers_converted,
  count(*) FILTER (event_type = 'SINGLE') AS single_conversions, count(*) FILTER (event_type = 'RANGE') AS range_conversions,
  max(input_number) AS max_number_converted, min(input_number) AS min_number_converted,
  avg(response_time_nanos) AS avg_response_time_ns, {STAMP}
FROM fact {{where}} GROUP BY 1"""

USER_SQL = f"""
SELECT user_id, count(*) AS total_requests, CAST(sum(conversion_count) AS BIGINT) AS total_numbers,
  avg(input_number) AS avg_input_value, max(event_time) AS last_activity, {STAMP}
FROM fact WHERE user_id IS NOT NULL {{more}} GROUP BY 1"""

INTERVAL = "processed_at >= TIMESTAMP '2024-01-14' AND processed_at < TIMESTAMP '2024-01-16'"
START, END = "2024-01-14", "2024-01-16"


@query("daily_summary", with_facts(DAILY_SQL.format(where="")))
def daily_summary(spark, folder):
    return metrics.daily_summary(facts(spark, folder), RUN_TS)


@query(
    "daily_summary_incremental",
    with_facts(DAILY_SQL.format(where=f"WHERE event_date IN (SELECT event_date FROM fact WHERE {INTERVAL})")),
)
def daily_summary_incremental(spark, folder):
    return metrics.daily_summary_of_interval(facts(spark, folder), START, END, RUN_TS)


@query("user_metrics", with_facts(USER_SQL.format(more="")))
def user_metrics(spark, folder):
    return metrics.user_metrics(facts(spark, folder), RUN_TS)


@query(
    "user_metrics_incremental",
    with_facts(USER_SQL.format(more=f"AND user_id IN (SELECT user_id FROM fact WHERE {INTERVAL})")),
)
def user_metrics_incremental(spark, folder):
    return metrics.user_metrics_of_interval(facts(spark, folder), START, END, RUN_TS)


@query("popular_numbers", with_facts(f"SELECT *, {STAMP} FROM popular", POPULAR))
def popular_numbers(spark, folder):
    return metrics.popular_numbers(facts(spark, folder), RUN_TS)


@query("gold_daily_runs", with_facts(DAILY_SQL.format(where="")))
def gold_daily_runs(spark, folder):
    """The published daily table after a full run and an interval run."""
    rows, table = facts(spark, folder), layers.daily(spark, work_path(spark, "gold"))
    early = rows.filter(F.col("processed_at") < F.lit(START).cast("timestamp"))
    plan.run_daily(early, table, None, None, RUN_TS)
    plan.run_daily(rows, table, START, "2024-03-01", RUN_TS)
    return table.read()


@query("gold_user_runs", with_facts(USER_SQL.format(more="")))
def gold_user_runs(spark, folder):
    """The users' totals after a full run, two interval runs and one of these again."""
    rows, root = facts(spark, folder), work_path(spark, "gold")
    days, totals = layers.user_days(spark, root), layers.user_totals(spark, root)
    processed = F.col("processed_at")
    until = lambda moment: rows.filter(processed < F.lit(moment).cast("timestamp"))
    plan.run_user_totals(until(START), days, totals, None, None, RUN_TS)
    plan.run_user_totals(until("2024-01-22"), days, totals, START, "2024-01-22", RUN_TS)
    for _ in range(2):
        plan.run_user_totals(rows, days, totals, "2024-01-22", "2024-03-01", RUN_TS)
    return metrics.metrics_of_sums(totals.read())


@query("gold_user_metrics_runs", with_facts(USER_SQL.format(more="")))
def gold_user_metrics_runs(spark, folder):
    """The published user table after a full run and an interval run that reads all facts."""
    rows, table = facts(spark, folder), layers.user_metrics(spark, work_path(spark, "gold"))
    early = rows.filter(F.col("processed_at") < F.lit(START).cast("timestamp"))
    plan.run_user_metrics(early, table, None, None, RUN_TS)
    plan.run_user_metrics(rows, table, START, "2024-03-01", RUN_TS)
    return table.read().drop("bucket")


@query("gold_popular_runs", with_facts(f"SELECT *, {STAMP} FROM popular", POPULAR))
def gold_popular_runs(spark, folder):
    """The published ranking after it was replaced."""
    rows, table = facts(spark, folder), layers.popular(spark, work_path(spark, "gold"))
    plan.run_popular(rows.filter(F.col("processed_at") < F.lit(START).cast("timestamp")), table, RUN_TS)
    plan.run_popular(rows, table, RUN_TS)
    return table.read()


@query(
    "daily_stats",
    with_events(
        """
SELECT CAST(event_time AS DATE) AS date_key, count(*) AS total_conversions,
  count(*) FILTER (event_type = 'SINGLE') AS single_conversions, count(*) FILTER (event_type = 'RANGE') AS range_conversions,
  count(DISTINCT user_id) AS unique_users, avg(response_time_nanos) / 1000000.0 AS avg_response_time_ms,
  round(quantile_cont(response_time_nanos, 0.5) / 1000000.0, 6) AS p50_response_time_ms,
  round(quantile_cont(response_time_nanos, 0.95) / 1000000.0, 6) AS p95_response_time_ms,
  round(quantile_cont(response_time_nanos, 0.99) / 1000000.0, 6) AS p99_response_time_ms,
  count(*) FILTER (status <> 'SUCCESS') AS error_count, count(*) FILTER (status <> 'SUCCESS') / count(*) AS error_rate
FROM bronze GROUP BY 1"""
    ),
)
def daily_stats(spark, folder):
    rows = metrics.daily_stats(bronze(spark, folder))
    marks = [c for c in rows.columns if c[0] == "p" and c[1:3].isdigit()]
    return rows.withColumns({c: F.round(c, 6) for c in marks})


@query(
    "number_popularity",
    with_facts(
        "SELECT input_number, count(*) AS conversion_count, max(event_time) AS last_converted_at FROM fact "
        "WHERE input_number IS NOT NULL GROUP BY 1"
    ),
)
def number_popularity(spark, folder):
    return metrics.number_popularity(facts(spark, folder))


HOURLY_SQL = """
SELECT date_trunc('hour', event_time) AS hour_key, count(*) AS total_requests,
  count(*) FILTER (status = 'SUCCESS') AS success_count, count(*) FILTER (status <> 'SUCCESS') AS error_count,
  avg(response_time_nanos) / 1000000.0 AS avg_response_time_ms, max(response_time_nanos) / 1000000.0 AS max_response_time_ms
FROM {table} GROUP BY 1"""


@query("hourly_metrics", with_events(HOURLY_SQL.format(table="bronze")))
def hourly_metrics(spark, folder):
    return metrics.hourly_metrics(bronze(spark, folder))


ACTIVITY_SQL = """
SELECT user_id, CAST(event_time AS DATE) AS activity_date, count(*) AS requests,
  CAST(sum(conversion_count) AS BIGINT) AS numbers_converted, count(*) FILTER (event_type = 'SINGLE') AS single_conversions,
  count(*) FILTER (event_type = 'RANGE') AS range_conversions, max(event_time) AS last_activity
FROM fact WHERE user_id IS NOT NULL GROUP BY 1, 2"""


@query("user_activity_daily", with_facts(ACTIVITY_SQL))
def user_activity_daily(spark, folder):
    return metrics.user_activity_daily(facts(spark, folder))


DATES_SQL = """
SELECT CAST(d AS DATE) AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
  CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) AS INTEGER) AS iso_weekday,
  isodow(d) >= 6 AS is_weekend
FROM generate_series((SELECT CAST(min(event_time) AS DATE) FROM bronze)::TIMESTAMP,
                     (SELECT CAST(max(event_time) AS DATE) FROM bronze)::TIMESTAMP, INTERVAL 1 DAY) AS t(d)"""


@query("dim_date", with_events(DATES_SQL))
def dim_date(spark, folder):
    return metrics.date_dimension(bronze(spark, folder))


TYPES_SQL = """
SELECT DISTINCT left(sha256(event_type), 16) AS conversion_type_key, event_type, event_type = 'RANGE' AS is_range
FROM bronze WHERE event_type IS NOT NULL"""


@query("dim_conversion_type", with_events(TYPES_SQL))
def dim_conversion_type(spark, folder):
    return metrics.conversion_type_dimension(bronze(spark, folder))


@query(
    "star_join",
    with_facts(
        HISTORY_SQL
        + f"""
, daily AS (SELECT CAST(event_time AS DATE) AS date_key, event_type, user_id, count(*) AS requests,
            CAST(sum(conversion_count) AS BIGINT) AS numbers_converted FROM fact GROUP BY ALL),
dates AS ({DATES_SQL}), types AS ({TYPES_SQL})
SELECT f.date_key, f.event_type, f.user_id, f.requests, f.numbers_converted, d.iso_weekday, d.is_weekend,
  t.conversion_type_key, h.client_ip AS current_ip, h.version AS current_version
FROM daily f LEFT JOIN dates d USING (date_key) LEFT JOIN types t USING (event_type)
LEFT JOIN history h ON h.user_id = f.user_id AND h.is_current"""
    ),
)
def star_join(spark, folder):
    """Daily facts with date, conversion type and current user."""
    rows = facts(spark, folder)
    daily = rows.groupBy(F.to_date("event_time").alias("date_key"), "event_type", "user_id").agg(
        F.count("*").alias("requests"), F.sum("conversion_count").alias("numbers_converted")
    )
    events = bronze(spark, folder)
    current = stored_history(spark, folder).filter("is_current").select(
        "user_id", F.col("client_ip").alias("current_ip"), F.col("version").alias("current_version")
    )
    return lookups.star(
        daily,
        {
            "date_key": (metrics.date_dimension(events).select("date_key", "iso_weekday", "is_weekend"), "date_key"),
            "event_type": (metrics.conversion_type_dimension(events).drop("is_range"), "event_type"),
            "user_id": (current, "user_id"),
        },
    )


BUCKET = """CASE WHEN input_number <= 10 THEN '1-10 (Small)' WHEN input_number <= 100 THEN '11-100 (Medium)'
    WHEN input_number <= 1000 THEN '101-1000 (Large)' ELSE '1001-3999 (Very Large)' END"""


@query(
    "number_range_distribution",
    with_facts(
        f"""
SELECT {BUCKET} AS number_range, CAST(sum(request_count) AS BIGINT) AS total_requests,
  CAST(round(sum(request_count) * 100.0 / (SELECT sum(request_count) FROM popular), 2) AS DOUBLE) AS percentage
FROM popular GROUP BY 1 ORDER BY min(input_number)""",
        POPULAR,
    ),
)
def number_range_distribution(spark, folder):
    rows = metrics.number_range_distribution(popular(spark, folder))
    return rows.withColumn("percentage", F.col("percentage").cast("double"))


@query(
    "longest_numerals",
    with_facts(
        "SELECT input_number, output_roman, length(output_roman) AS numeral_length, request_count FROM popular "
        "ORDER BY numeral_length DESC, request_count DESC, input_number LIMIT 10",
        POPULAR,
    ),
)
def longest_numerals(spark, folder):
    rows = metrics.longest_numerals(popular(spark, folder))
    return rows.withColumn("numeral_length", F.col("numeral_length").cast("long"))


@query(
    "round_number_preference",
    with_facts(
        """
SELECT CASE WHEN input_number % 100 = 0 THEN 'Multiple of 100' WHEN input_number % 50 = 0 THEN 'Multiple of 50'
  WHEN input_number % 10 = 0 THEN 'Multiple of 10' WHEN input_number % 5 = 0 THEN 'Multiple of 5' ELSE 'Other' END AS number_type,
  count(*) AS unique_numbers, CAST(sum(request_count) AS BIGINT) AS total_requests FROM popular GROUP BY 1""",
        POPULAR,
    ),
)
def round_number_preference(spark, folder):
    return metrics.round_number_preference(popular(spark, folder))


@query(
    "single_symbol_numerals",
    with_facts(
        """
SELECT input_number, output_roman, request_count FROM popular
WHERE regexp_matches(output_roman, '^(I{1,3}|V|X{1,3}|L|C{1,3}|D|M{1,3})$') OR output_roman IN ('III', 'XXX', 'CCC', 'MMM')
ORDER BY request_count DESC, input_number LIMIT 10""",
        POPULAR,
    ),
)
def single_symbol_numerals(spark, folder):
    return reports.single_symbol_numerals(popular(spark, folder))


@query(
    "user_activity_summary",
    with_facts(
        """
, users AS (SELECT user_id, count(*) AS r FROM fact WHERE user_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS total_users, CAST(sum(r) AS BIGINT) AS total_requests, round(avg(r), 2) AS avg_requests_per_user,
  max(r) AS max_requests_by_user FROM users"""
    ),
)
def user_activity_summary(spark, folder):
    return metrics.user_activity_summary(metrics.user_metrics(facts(spark, folder), RUN_TS))


@query("event_type_counts", with_events("SELECT event_type, count(*) AS events FROM bronze GROUP BY 1"))
def event_type_counts(spark, folder):
    return reports.event_type_counts(bronze(spark, folder))


@query(
    "latency_report",
    with_events(
        """
SELECT count(*) AS requests, avg(response_time_nanos) / 1000000.0 AS avg_ms, max(response_time_nanos) / 1000000.0 AS max_ms,
  count(*) FILTER (response_time_nanos <= 50000000) AS within_50_ms, count(*) FILTER (response_time_nanos <= 100000000) AS within_100_ms,
  count(*) FILTER (response_time_nanos <= 200000000) AS within_200_ms, count(*) FILTER (response_time_nanos <= 500000000) AS within_500_ms,
  count(*) FILTER (status <> 'SUCCESS') / count(*) AS error_rate,
  round(quantile_cont(response_time_nanos, 0.5) / 1000000.0, 6) AS p50_ms, round(quantile_cont(response_time_nanos, 0.95) / 1000000.0, 6) AS p95_ms,
  round(quantile_cont(response_time_nanos, 0.99) / 1000000.0, 6) AS p99_ms,
  round(quantile_cont(range_max - range_min + 1, 0.5), 6) AS range_size_p50, round(quantile_cont(range_max - range_min + 1, 0.95), 6) AS range_size_p95,
  round(quantile_cont(range_max - range_min + 1, 0.99), 6) AS range_size_p99,
  quantile_cont(response_time_nanos, 0.95) / 1000000.0 < 100 AS latency_ok,
  count(*) FILTER (status <> 'SUCCESS') / count(*) < 0.01 AS errors_ok
FROM bronze"""
    ),
)
def latency_report(spark, folder):
    """Report against the thresholds of the load test (p95 < 100 ms, errors < 1 %)."""
    rows = metrics.latency_report(bronze(spark, folder), [50, 100, 200, 500], 100.0, 0.01)
    marks = [c for c in rows.columns if c.startswith(("p50", "p95", "p99", "range_size"))]
    return rows.withColumns({c: F.round(c, 6) for c in marks})


@query(
    "preview_rows",
    with_facts(
        "SELECT event_id, event_time, input_number, output_roman FROM fact ORDER BY event_time DESC, event_id LIMIT 20"
    ),
)
def preview_rows(spark, folder):
    rows = facts(spark, folder).select("event_id", "event_time", "input_number", "output_roman")
    return reports.preview(rows, [F.desc("event_time"), "event_id"], 20)
