"""Shared WITH clauses of the check SQL: the service's inputs and layers."""

ROMAN = (
    "(['','M','MM','MMM'])[({x}) // 1000 + 1] || "
    "(['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'])[({x}) // 100 % 10 + 1] || "
    "(['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[({x}) // 10 % 10 + 1] || "
    "(['','I','II','III','IV','V','VI','VII','VIII','IX'])[({x}) % 10 + 1]"
)


def roman(x: str) -> str:
    return "(" + ROMAN.format(x=x) + ")"


EVENTS = f"""
source AS (
  SELECT event_id AS n, ts, user_id AS u, event_type AS et, value AS v,
         md5(CAST(event_id AS VARCHAR)) AS h, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
shaped AS (
  SELECT n, ts,
    substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12) AS event_id,
    CASE WHEN n % 50 = 0 THEN ts - INTERVAL 10 MINUTE ELSE ts END AS event_time,
    CASE WHEN et = 'purchase' THEN 'RANGE' ELSE 'SINGLE' END AS event_type,
    CASE WHEN et <> 'view' THEN u END AS user_id,
    CASE WHEN u % 3 <> 0 THEN left('rns_' || md5(CAST(u AS VARCHAR)), 12) END AS api_key_prefix,
    '10.' || (u % 4) || '.' || (n % 7) || '.' || (u % 250 + 1) AS client_ip,
    left(h, 8) AS correlation_id,
    CASE WHEN et <> 'purchase' THEN
      CASE WHEN n % 5 = 0 THEN CAST((n * 37) % 3999 + 1 AS INTEGER) ELSE CAST(floor(v) AS INTEGER) + 1 END END AS input_number,
    CASE WHEN et = 'purchase' THEN CAST(k % 100 + 1 AS INTEGER) END AS range_min,
    CASE WHEN et = 'purchase' THEN CAST(k % 100 + 1 + k % 50 + 1 AS INTEGER) END AS range_max,
    CAST(round(v * 1000000) AS BIGINT) AS response_time_nanos,
    CASE WHEN et = 'error' THEN 'ERROR_VALIDATION' ELSE 'SUCCESS' END AS status,
    CAST(n % 3 AS INTEGER) AS kafka_partition, n // 3 * 4 AS kafka_offset, ts AS arrival
  FROM source),
ev AS (
  SELECT *,
    CASE WHEN status = 'SUCCESS' AND input_number IS NOT NULL THEN
      CASE WHEN n % 211 = 0 THEN 'IIII' ELSE {roman('input_number')} END END AS output_roman,
    range_max - range_min + 1 AS result_count,
    CASE WHEN range_min IS NOT NULL THEN 0 END AS page_offset,
    CASE WHEN range_min IS NOT NULL THEN 100 END AS page_limit
  FROM shaped),
delivered AS (
  SELECT *, 0 AS delivery FROM ev
  UNION ALL BY NAME
  SELECT * REPLACE (kafka_offset + 1 AS kafka_offset, arrival + INTERVAL 1 DAY AS arrival), 1 AS delivery
  FROM ev WHERE n % 10 = 0),
parsed AS (SELECT *, arrival + INTERVAL 5 MINUTE AS ingested_at FROM delivered),
malformed AS (
  SELECT event_id AS n, 'not json' AS original_payload, 'MALFORMED_JSON' AS error_type,
         'payload is not a JSON object' AS error_message, CAST(event_id % 3 AS INTEGER) AS kafka_partition,
         event_id // 3 * 4 + 2 AS kafka_offset, ts AS arrival FROM events WHERE event_id % 97 = 0
  UNION ALL
  SELECT event_id, '{{"eventType":"SINGLE"}}', 'MISSING_EVENT_ID', 'eventId is null', CAST(event_id % 3 AS INTEGER),
         event_id // 3 * 4 + 3, ts FROM events WHERE event_id % 101 = 0),
bronze AS (
  SELECT * FROM parsed
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY kafka_offset DESC, kafka_partition DESC) = 1)
"""

BRONZE_COLUMNS = (
    "event_id, event_time, event_type, user_id, api_key_prefix, client_ip, correlation_id, input_number, output_roman, "
    "range_min, range_max, result_count, page_offset, page_limit, response_time_nanos, status, ingested_at, "
    "kafka_partition, kafka_offset"
)

COUNT = "CASE WHEN event_type = 'RANGE' THEN CAST(range_max AS BIGINT) - range_min + 1 ELSE 1 END"

FACT_COLUMNS = (
    "event_id, event_time, event_type, user_id, client_ip, correlation_id, input_number, output_roman, range_min, "
    "range_max, result_count, response_time_nanos, status, conversion_count, processed_at"
)

# Silver: processed by the run of the hour after ingestion.
FACTS = f"""
fact AS (
  SELECT *, CAST({COUNT} AS BIGINT) AS conversion_count,
         date_trunc('hour', ingested_at) + INTERVAL 1 HOUR AS processed_at, CAST(event_time AS DATE) AS event_date
  FROM parsed WHERE status = 'SUCCESS'
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC, kafka_offset DESC, kafka_partition DESC) = 1)
"""

POPULAR = """
popular AS (
  SELECT input_number, output_roman, count(*) AS request_count FROM fact WHERE input_number IS NOT NULL
  GROUP BY 1, 2 ORDER BY request_count DESC, input_number, output_roman LIMIT 100)
"""

KEYS = """
api_keys AS (
  SELECT c_custkey AS id, left('rns_' || md5(CAST(c_custkey AS VARCHAR)), 12) AS key_prefix,
    sha256('rns_' || CAST(c_custkey AS VARCHAR)) AS key_hash, c_custkey % 150 AS user_id,
    TIMESTAMP '2023-06-01' + to_days(CAST(c_custkey % 200 AS INTEGER)) AS created_at,
    CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-01-15' END AS expires_at,
    CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2024-01-10' END AS revoked_at,
    c_custkey % 13 <> 0 AS active,
    CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2023-12-31' END AS last_used_at
  FROM customer),
key_requests AS (
  SELECT event_id AS request_id, ts AS requested_at, CASE
    WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN '  '
    WHEN event_id % 9 = 2 THEN 'key_' || event_id
    WHEN event_id % 9 = 3 THEN ' rns_' || user_id || ' '
    WHEN event_id % 9 = 4 THEN 'rns_' || (event_id + 10000000)
    ELSE 'rns_' || user_id END AS presented_key
  FROM events),
checked AS (
  SELECT r.request_id, r.requested_at, k.key_prefix, CASE
    WHEN r.presented_key IS NULL OR trim(r.presented_key) = '' THEN 'MISSING'
    WHEN NOT starts_with(trim(r.presented_key), 'rns_') THEN 'BAD_PREFIX'
    WHEN k.key_hash IS NULL THEN 'UNKNOWN_KEY'
    WHEN k.revoked_at <= r.requested_at THEN 'REVOKED'
    WHEN NOT k.active THEN 'INACTIVE'
    WHEN k.expires_at < r.requested_at THEN 'EXPIRED'
    ELSE 'VALID' END AS outcome
  FROM key_requests r LEFT JOIN api_keys k ON k.key_hash = sha256(trim(r.presented_key)))
"""

LOGS = r"""
log_lines AS (
  SELECT event_id AS n, date_trunc('millisecond', ts) AS logged_at, left(md5(CAST(event_id AS VARCHAR)), 8) AS trace,
    CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END AS level,
    CASE WHEN event_id % 10 = 9 THEN 'Converted number ' || CAST(floor(value) AS BIGINT)
         ELSE 'method=GET path=/romannumeral?query=' || CAST(floor(value) AS BIGINT) || ' status=' ||
              CASE WHEN event_type = 'error' THEN '500' ELSE '200' END || ' duration=' || CAST(floor(value) AS BIGINT) ||
              'ms correlationId=' || left(md5(CAST(event_id AS VARCHAR)), 8) END AS message,
    event_id % 61 = 0 AS plain, sha256(CAST(event_id % 5 AS VARCHAR)) AS container
  FROM events),
access AS (
  SELECT regexp_extract('/var/lib/docker/containers/' || container || '/' || container || '-json.log',
           '/var/lib/docker/containers/([a-f0-9]{12})[a-f0-9]*/.*\.log', 1) AS container_id,
    CASE WHEN NOT plain THEN 'stdout' END AS stream,
    CASE WHEN NOT plain THEN logged_at END AS logged_at,
    CASE WHEN NOT plain THEN level END AS level,
    CASE WHEN NOT plain THEN 'access' END AS logger,
    CASE WHEN NOT plain THEN trace END AS correlation_id,
    CASE WHEN plain THEN 'plain text ' || n ELSE message END AS message,
    CASE WHEN NOT plain THEN nullif(regexp_extract(message, 'method=(\S+)', 1), '') END AS method,
    CASE WHEN NOT plain THEN nullif(regexp_extract(message, 'path=(\S+)', 1), '') END AS path,
    CASE WHEN NOT plain THEN TRY_CAST(nullif(regexp_extract(message, 'status=(\d+)', 1), '') AS INTEGER) END AS status,
    CASE WHEN NOT plain THEN TRY_CAST(nullif(regexp_extract(message, 'duration=(\d+)ms', 1), '') AS INTEGER) END AS duration_ms
  FROM log_lines)
"""

SEGMENTS = """
seg_good AS (
  SELECT *, CAST(least(2,
      CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END
      + CASE WHEN n % 50 = 0 AND delivery = 0 THEN 1 ELSE 0 END
      + CASE WHEN delivery = 1 THEN (n // 10) % 3 ELSE 0 END) AS BIGINT) AS seg
  FROM delivered),
seg_bad AS (
  SELECT *, CASE WHEN day(arrival) <= 10 THEN 0 WHEN day(arrival) <= 20 THEN 1 ELSE 2 END AS seg FROM malformed)
"""


def with_events(body: str, *more: str) -> str:
    return "WITH " + ",".join([EVENTS, *more]) + body


def with_facts(body: str, *more: str) -> str:
    return with_events(body, FACTS, *more)
