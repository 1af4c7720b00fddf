"""Queries over container logs."""

from __future__ import annotations

from oreflow.catalog.base_sql import LOGS, with_events
from oreflow.catalog.inputs import bronze, stored
from oreflow.catalog.registry import query
from oreflow.functions.logs import parse_container_logs
from oreflow.operators import lookups, metrics
from oreflow.session import work_path
from oreflow.sources import bindings
from oreflow.sources.files import read_log_lines
from pyspark.sql import functions as F

WITH_LOGS = "WITH " + LOGS


_FILES: dict[tuple, str] = {}


def log_files(spark, folder) -> str:
    """The lines as text files below one folder per container; returns the pattern of their paths."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FILES:
        root, lines = work_path(spark, "logs"), stored(spark, folder, "logs", bindings.container_logs)
        for (path,) in lines.select("file_path").distinct().collect():  # the fixture has five containers
            lines.filter(F.col("file_path") == path).select("value").write.text(root + path)
        _FILES[key] = f"{root}/var/lib/docker/containers/*/*.log"
    return _FILES[key]


def access(spark, folder):
    return parse_container_logs(read_log_lines(spark, log_files(spark, folder)))


@query("access_log_parse", WITH_LOGS + "SELECT * FROM access")
def access_log_parse(spark, folder):
    return access(spark, folder)


@query(
    "access_log_minutely",
    WITH_LOGS
    + """
SELECT date_trunc('minute', logged_at) AS minute, count(*) AS requests,
  count(*) FILTER (status BETWEEN 200 AND 299) AS ok_2xx, count(*) FILTER (status BETWEEN 400 AND 499) AS client_4xx,
  count(*) FILTER (status BETWEEN 500 AND 599) AS server_5xx,
  count(*) FILTER (status BETWEEN 200 AND 299) / count(*) AS availability,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms
FROM access WHERE status IS NOT NULL GROUP BY 1""",
)
def access_log_minutely(spark, folder):
    rows = metrics.requests_per_minute(access(spark, folder))
    return rows.withColumn("p95_ms", F.round("p95_ms", 6))


@query(
    "log_event_match",
    with_events(
        """
, l AS (SELECT correlation_id, count(*) AS log_lines, max(duration_ms) AS max_duration_ms FROM access
        WHERE correlation_id IS NOT NULL GROUP BY 1),
e AS (SELECT correlation_id, count(*) AS events, max(response_time_nanos) AS max_response_time_nanos FROM bronze
      WHERE status = 'SUCCESS' AND correlation_id IS NOT NULL GROUP BY 1)
SELECT correlation_id, coalesce(log_lines, 0) AS log_lines, coalesce(events, 0) AS events, max_duration_ms, max_response_time_nanos,
  CASE WHEN events IS NULL THEN 'LOG_ONLY' WHEN log_lines IS NULL THEN 'EVENT_ONLY' ELSE 'MATCHED' END AS match_state
FROM l FULL JOIN e USING (correlation_id)""",
        LOGS,
    ),
)
def log_event_match(spark, folder):
    good = bronze(spark, folder).filter(F.col("status") == "SUCCESS")
    return lookups.match_logs_to_events(access(spark, folder), good)
