"""Queries over API keys, requests and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreflow.catalog.base_sql import KEYS, with_events
from oreflow.catalog.inputs import RUN_TS, bronze
from oreflow.catalog.registry import query
from oreflow.functions import requests as rq
from oreflow.operators import lookups, metrics, rate
from oreflow.sources import bindings

WITH_KEYS = "WITH " + KEYS


@query("key_validation", WITH_KEYS + "SELECT * FROM checked")
def key_validation(spark, folder):
    return lookups.validate_keys(bindings.key_requests(spark, folder), bindings.api_keys(spark, folder))


@query("key_outcomes", WITH_KEYS + "SELECT outcome, count(*) AS requests FROM checked GROUP BY 1")
def key_outcomes(spark, folder):
    checked = lookups.validate_keys(bindings.key_requests(spark, folder), bindings.api_keys(spark, folder))
    return checked.groupBy("outcome").agg(F.count("*").alias("requests"))


@query(
    "key_cleaning",
    WITH_KEYS
    + """
SELECT request_id, CASE WHEN starts_with(trim(presented_key), 'rns_') THEN trim(presented_key) END AS clean_key,
  CASE WHEN starts_with(trim(presented_key), 'rns_') THEN sha256(trim(presented_key)) END AS key_hash,
  CASE WHEN presented_key IS NULL OR trim(presented_key) = '' THEN 'MISSING'
       WHEN NOT starts_with(trim(presented_key), 'rns_') THEN 'BAD_PREFIX' END AS reject_reason
FROM key_requests""",
)
def key_cleaning(spark, folder):
    key = F.col("presented_key")
    clean = rq.clean_key(key)
    return bindings.key_requests(spark, folder).select(
        "request_id", clean.alias("clean_key"), rq.key_hash(clean).alias("key_hash"),
        rq.key_reject_reason(key).alias("reject_reason"),
    )


@query(
    "key_summary",
    WITH_KEYS
    + """
SELECT count(*) AS total_keys, count(*) FILTER (active) AS active_keys, count(*) FILTER (NOT active) AS inactive_keys,
  count(revoked_at) AS revoked_keys, max(last_used_at) AS last_used_at FROM api_keys""",
)
def key_summary(spark, folder):
    return metrics.key_summary(bindings.api_keys(spark, folder))


@query(
    "active_keys_per_user",
    WITH_KEYS
    + "SELECT user_id, count(*) FILTER (active) AS active_keys, count(*) FILTER (active) > 9 AS over_limit FROM api_keys GROUP BY 1",
)
def active_keys_per_user(spark, folder):
    return metrics.active_keys_per_user(bindings.api_keys(spark, folder), 9)


@query(
    "key_last_used",
    WITH_KEYS
    + """
, used AS (SELECT key_prefix, max(requested_at) AS used_at FROM checked WHERE outcome = 'VALID' GROUP BY 1)
SELECT k.id, k.key_prefix, greatest(k.last_used_at, u.used_at) AS last_used_at
FROM api_keys k LEFT JOIN used u USING (key_prefix)""",
)
def key_last_used(spark, folder):
    keys = bindings.api_keys(spark, folder)
    valid = lookups.validate_keys(bindings.key_requests(spark, folder), keys).filter(F.col("outcome") == "VALID")
    used = valid.select("key_prefix", F.col("requested_at").alias("used_at"))
    return lookups.touch_last_used(keys, used).select("id", "key_prefix", "last_used_at")


@query(
    "key_revocation",
    WITH_KEYS
    + """
, listed AS (SELECT DISTINCT key_prefix FROM checked WHERE outcome = 'EXPIRED')
SELECT k.id, k.key_prefix, k.active AND l.key_prefix IS NULL AS active,
  CASE WHEN l.key_prefix IS NOT NULL THEN coalesce(k.revoked_at, TIMESTAMP '2024-03-01') ELSE k.revoked_at END AS revoked_at
FROM api_keys k LEFT JOIN listed l ON k.key_prefix = l.key_prefix""",
)
def key_revocation(spark, folder):
    """Revoke every key that was presented after it expired."""
    keys = bindings.api_keys(spark, folder)
    expired = lookups.validate_keys(bindings.key_requests(spark, folder), keys).filter(F.col("outcome") == "EXPIRED")
    return lookups.revoke_keys(keys, expired, RUN_TS).select("id", "key_prefix", "active", "revoked_at")


@query(
    "keys_of_users",
    WITH_KEYS
    + """
SELECT k.user_id, u.c_name AS username, k.id, k.key_prefix, k.created_at
FROM api_keys k JOIN customer u ON u.c_custkey = k.user_id WHERE k.active""",
)
def keys_of_users(spark, folder):
    joined = lookups.keys_with_users(bindings.api_keys(spark, folder), bindings.users(spark, folder), only_active=True)
    return joined.select("user_id", "username", "id", "key_prefix", "created_at").orderBy(F.desc("created_at"), "id")


@query(
    "request_headers",
    """
WITH r AS (
  SELECT event_id AS request_id, '10.' || (user_id % 4) || '.' || (event_id % 7) || '.' || (user_id % 250 + 1) AS hop,
    '172.16.' || (user_id % 200) || '.' || (event_id % 200) AS remote, event_id % 4 AS a, event_id % 3 AS b,
    event_id % 20 AS c, floor(value) AS v, event_id AS n FROM events)
SELECT request_id, CASE WHEN a IN (0, 1) THEN hop ELSE remote END AS client_ip,
  CASE WHEN b = 0 THEN left(md5(CAST(n AS VARCHAR)), 8) ELSE left(sha256(CAST(n AS VARCHAR)), 8) END AS correlation_id,
  c > 2 AS is_api, c IN (0, 1) AS is_internal
FROM r""",
)
def request_headers(spark, folder):
    """Client address, correlation id and route class of each request."""
    return bindings.http_requests(spark, folder).select(
        "request_id",
        rq.client_ip(F.col("forwarded_for"), F.col("remote_addr")).alias("client_ip"),
        rq.correlation_id(F.col("correlation_header"), F.col("request_id").cast("string")).alias("correlation_id"),
        rq.is_api_path(F.col("path")).alias("is_api"),
        rq.is_internal_path(F.col("path")).alias("is_internal"),
    )


SECONDS_SQL = """
, seconds AS (SELECT client_ip AS client, CAST(epoch(date_trunc('second', event_time)) AS BIGINT) AS second, count(*) AS requests
              FROM bronze GROUP BY 1, 2)
"""


@query(
    "rolling_rate_audit",
    with_events(
        SECONDS_SQL
        + """
, rolled AS (SELECT *, sum(requests) OVER (PARTITION BY client ORDER BY second RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS r
             FROM seconds)
SELECT client, second, requests, CAST(r AS BIGINT) AS rolling_requests, r > 2 AS over_limit FROM rolled"""
    ),
)
def rolling_rate_audit(spark, folder):
    """More than two requests of a client within a day."""
    return rate.rolling_audit(bronze(spark, folder), "client_ip", "event_time", 86_400, 2)


BUCKET_SQL = """
, ordered AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY second) AS rn FROM seconds),
replay AS (
  SELECT client, second, requests, rn, 2 * 86400 - least(requests, 2) * 86400 AS level, least(requests, 2) AS allowed
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.client, o.second, o.requests, o.rn,
    least(172800, p.level + (o.second - p.second) * 2)
      - least(o.requests, least(172800, p.level + (o.second - p.second) * 2) // 86400) * 86400,
    least(o.requests, least(172800, p.level + (o.second - p.second) * 2) // 86400)
  FROM replay p JOIN ordered o ON o.client = p.client AND o.rn = p.rn + 1)
SELECT client, second, requests, CAST(allowed AS BIGINT) AS allowed, CAST(requests - allowed AS BIGINT) AS denied,
  CAST(level // 86400 AS BIGINT) AS remaining,
  CAST(CASE WHEN requests > allowed THEN ceil((86400 - level) / 2.0) ELSE 0 END AS BIGINT) AS retry_after_seconds
FROM replay"""


@query("rate_limit_replay", with_events(SECONDS_SQL + BUCKET_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def rate_limit_replay(spark, folder):
    """A bucket of two requests per day and client."""
    return rate.token_bucket(bronze(spark, folder), "client_ip", "event_time", 2, 86_400)
