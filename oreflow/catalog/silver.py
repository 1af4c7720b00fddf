"""Queries of the silver layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreflow.catalog import inputs
from oreflow.catalog.base_sql import COUNT, FACT_COLUMNS, with_events, with_facts
from oreflow.catalog.inputs import RUN_TS, bronze, facts, parsed, silver, silver_run
from oreflow.catalog.registry import query
from oreflow.operators import dedup, metrics, scd2
from oreflow.operators.merge import upsert
from oreflow.operators.quality import ValidationFailed
from oreflow.plans import layers
from oreflow.plans import silver as plan
from oreflow.schemas import FACT_COLUMNS as COLUMNS
from oreflow.session import work_path

HISTORY_SQL = """
, runs AS (
  SELECT user_id, client_ip, event_time, event_id,
    lag(client_ip) OVER w IS DISTINCT FROM client_ip OR row_number() OVER w = 1 AS starts
  FROM fact WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id)),
history AS (
  SELECT user_id, client_ip, event_time AS valid_from,
    coalesce(lead(event_time) OVER w, TIMESTAMP '9999-12-31') AS valid_to,
    lead(event_time) OVER w IS NULL AS is_current, row_number() OVER w AS version
  FROM runs WHERE starts WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id))
"""


@query("silver_fact", with_facts(f"SELECT {FACT_COLUMNS} FROM fact"))
def silver_fact(spark, folder):
    return silver(spark, folder).select(*COLUMNS)


@query(
    "silver_interval",
    with_events(
        f"""
SELECT {FACT_COLUMNS} FROM (
  SELECT *, CAST({COUNT} AS BIGINT) AS conversion_count, TIMESTAMP '2024-03-01' AS processed_at FROM parsed
  WHERE status = 'SUCCESS' AND ingested_at >= TIMESTAMP '2024-01-10' AND ingested_at < TIMESTAMP '2024-01-12'
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC, kafka_offset DESC, kafka_partition DESC) = 1)"""
    ),
)
def silver_interval(spark, folder):
    return plan.interval_facts(parsed(spark, folder), "2024-01-10", "2024-01-12", RUN_TS).select(*COLUMNS)


@query("silver_upsert", with_facts(f"SELECT {FACT_COLUMNS} FROM fact"))
def silver_upsert(spark, folder):
    """Facts of first copies, upserted with the facts of all later rows."""
    rows = parsed(spark, folder)
    old = plan.interval_facts(rows, None, "2024-01-15", silver_run())
    new = plan.interval_facts(rows, "2024-01-15", None, silver_run())
    return upsert(old, new, ["event_id"]).select(*COLUMNS)


@query("silver_runs", with_facts(f"SELECT {FACT_COLUMNS} FROM fact"))
def silver_runs(spark, folder):
    """Three interval runs merging into the published fact table."""
    rows, table = parsed(spark, folder), layers.fact(spark, work_path(spark, "silver"))
    edges = [None, "2024-01-12", "2024-01-22", None]
    for start, end in zip(edges, edges[1:]):
        plan.run_facts(rows, table, start, end, silver_run())
    return table.read().select(*COLUMNS)


STRICT = [{"rule": "unique", "column": "event_id"}, {"rule": "between", "column": "conversion_count", "max": 30}]


@query(
    "silver_gated_runs",
    with_facts(
        """
SELECT event_id, 'PUBLISHED' AS state FROM fact WHERE ingested_at < TIMESTAMP '2024-01-12'
UNION ALL SELECT event_id, 'QUARANTINED' FROM fact WHERE ingested_at >= TIMESTAMP '2024-01-22' AND conversion_count > 30"""
    ),
)
def silver_gated_runs(spark, folder):
    """A run that passes its rules, and one that a rule refuses: its bad rows are kept, none is published."""
    rows, root = parsed(spark, folder), work_path(spark, "silver")
    table, bad = layers.fact(spark, root), layers.quarantined(spark, root)
    latest = dedup.latest_ingested(rows.filter("status = 'SUCCESS'"))
    plan.run_facts(latest, table, None, "2024-01-12", silver_run(), rules=STRICT[:1], bad_rows=bad)
    try:
        plan.run_facts(latest, table, "2024-01-22", None, silver_run(), rules=STRICT, bad_rows=bad)
    except ValidationFailed:
        pass
    kept = table.read().select("event_id", F.lit("PUBLISHED").alias("state"))
    return kept.unionByName(bad.read().select(F.get_json_object("row", "$.event_id").alias("event_id"), F.lit("QUARANTINED").alias("state")))


@query("silver_full_refresh", with_facts(f"SELECT {FACT_COLUMNS} FROM fact"))
def silver_full_refresh(spark, folder):
    """A table that held half of the facts, replaced by all of them in one publish."""
    rows, table = parsed(spark, folder), layers.fact(spark, work_path(spark, "silver"))
    plan.run_facts(rows, table, None, "2024-01-12", silver_run())
    plan.run_facts(rows, table, None, None, silver_run(), full_refresh=True)
    return table.read().select(*COLUMNS)


@query(
    "dim_users_snapshot",
    with_facts(
        """
SELECT user_id, max(client_ip) AS last_client_ip, count(*) AS total_requests, max(event_time) AS last_activity,
  TIMESTAMP '2024-03-01' AS valid_from, TIMESTAMP '2024-03-01' AS valid_to, true AS is_current,
  CAST(count(*) % 100 + 1 AS INTEGER) AS version
FROM fact WHERE user_id IS NOT NULL GROUP BY 1"""
    ),
)
def dim_users_snapshot(spark, folder):
    return metrics.user_snapshot(facts(spark, folder), RUN_TS)


def history(spark, folder):
    return scd2.build_history(facts(spark, folder), "user_id", **plan.HISTORY)


def stored_history(spark, folder):
    return inputs.stored(spark, folder, "user_history", history)


@query("dim_users_scd2", with_facts(HISTORY_SQL + "SELECT * FROM history"))
def dim_users_scd2(spark, folder):
    return history(spark, folder)


@query("dim_users_scd2_merge", with_facts(HISTORY_SQL + "SELECT * FROM history"))
def dim_users_scd2_merge(spark, folder):
    """History of early facts, then merged with the users of late ones."""
    rows = facts(spark, folder)
    early = rows.filter(F.col("processed_at") < F.lit("2024-01-20").cast("timestamp"))
    late = rows.filter(F.col("processed_at") >= F.lit("2024-01-20").cast("timestamp"))
    old = scd2.build_history(early, "user_id", **plan.HISTORY)
    return scd2.merge_history(old, rows, late, "user_id", **plan.HISTORY)


@query("dim_users_history_table", with_facts(HISTORY_SQL + "SELECT * FROM history"))
def dim_users_history_table(spark, folder):
    """The same through two runs on the published table."""
    rows, table = facts(spark, folder), layers.user_history(spark, work_path(spark, "silver"))
    cut = F.col("processed_at") < F.lit("2024-01-20").cast("timestamp")
    plan.run_user_history(rows.filter(cut), table, None, None)
    plan.run_user_history(rows, table, "2024-01-20", None)
    return table.read().drop("bucket")


@query(
    "scd2_asof_join",
    with_facts(
        HISTORY_SQL
        + """
SELECT b.event_id, b.user_id, b.event_time, b.status, h.version AS user_version, h.client_ip AS version_ip
FROM bronze b LEFT JOIN history h ON b.user_id = h.user_id AND b.event_time >= h.valid_from AND b.event_time < h.valid_to"""
    ),
)
def scd2_asof_join(spark, folder):
    """All bronze rows, failed ones too, with the user version at their time."""
    rows = bronze(spark, folder).select("event_id", "user_id", "event_time", "status")
    versions = stored_history(spark, folder).withColumnsRenamed({"version": "user_version", "client_ip": "version_ip"})
    return scd2.as_of(rows, versions, "user_id", "event_time", "event_id", ["user_version", "version_ip"])


@query(
    "scd2_integrity",
    with_facts(
        HISTORY_SQL
        + """
, users AS (SELECT user_id, count(*) FILTER (is_current) AS c, count(*) AS n, min(version) AS lo, max(version) AS hi,
            count(DISTINCT version) AS d FROM history GROUP BY 1),
next AS (SELECT valid_to, lead(valid_from) OVER (PARTITION BY user_id ORDER BY version) AS nxt FROM history),
checks AS (
  SELECT 'one_current_row' AS rule, count(*) FILTER (c <> 1) AS violations FROM users UNION ALL
  SELECT 'versions_increase', count(*) FILTER (lo <> 1 OR hi <> n OR d <> n) FROM users UNION ALL
  SELECT 'end_not_before_start', count(*) FILTER (valid_to < valid_from) FROM history UNION ALL
  SELECT 'open_end_is_current', count(*) FILTER (is_current <> (valid_to = TIMESTAMP '9999-12-31')) FROM history UNION ALL
  SELECT 'no_gap_or_overlap', count(*) FILTER (valid_to <> nxt) FROM next)
SELECT rule, violations, violations = 0 AS success FROM checks"""
    ),
)
def scd2_integrity(spark, folder):
    return scd2.integrity(stored_history(spark, folder), "user_id")
