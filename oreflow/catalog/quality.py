"""Queries of the data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreflow.catalog.base_sql import with_events, with_facts
from oreflow.catalog.inputs import facts, ingest_time, topic
from oreflow.catalog.registry import query
from oreflow.catalog.silver import HISTORY_SQL, stored_history
from oreflow.functions.events import parse_events, status_class
from oreflow.operators.quality import quarantine, summarize, validate
from oreflow.plans import suites


def _late_marked(spark, folder):
    """Bronze rows before dedup, flagged when five minutes behind arrival."""
    rows = parse_events(topic(spark, folder), ingest_time())
    return rows.withColumn("is_late_arrival", F.col("event_time") < F.col("ingested_at") - F.expr("interval 10 minutes"))


def _rule(suite, rule, column, judged, bad, table, mostly="1.0", success=None):
    """One result row of the check SQL."""
    judged, bad = f"CAST({judged} AS BIGINT)", f"CAST({bad} AS BIGINT)"
    ok = success or f"({judged} = 0 OR {judged} - {bad} >= {mostly} * {judged})"
    return (
        f"SELECT '{suite}' AS suite, '{rule}' AS rule, '{column}' AS column_name, {judged} AS element_count, "
        f"{bad} AS unexpected_count, CASE WHEN {judged} > 0 THEN round({bad} * 100.0 / {judged}, 4) ELSE 0.0 END "
        f"AS unexpected_percent, {ok} AS success FROM {table}"
    )


def _suite_sql(suite: str, rules: list[dict], table: str) -> str:
    rows = []
    for rule in rules:
        kind, column = rule["rule"], rule.get("column", "")
        if kind == "row_count":
            rows.append(_rule(suite, kind, "", "count(*)", f"CASE WHEN count(*) >= {rule['min']} THEN 0 ELSE 1 END", table,
                              success=f"count(*) >= {rule['min']}"))
        elif kind in ("columns_in_set", "column_exists", "of_type"):
            rows.append(_rule(suite, kind, column, "0", "0", "(SELECT 1)", success="true"))
        elif kind in ("unique", "compound_unique"):
            keys = ",".join(rule.get("columns", [column]))
            grouped = f"(SELECT count(*) AS n FROM {table} WHERE ({keys}) IS NOT NULL GROUP BY {keys})"
            rows.append(_rule(suite, kind, keys, "coalesce(sum(n), 0)", "coalesce(sum(n) FILTER (n > 1), 0)", grouped,
                              success="coalesce(sum(n) FILTER (n > 1), 0) = 0"))
        else:
            judged = f"{column} IS NOT NULL"
            if kind == "not_null":
                judged, bad = "true", f"{column} IS NULL"
            elif kind == "in_set":
                bad = f"{column} NOT IN ({', '.join(repr(v) for v in rule['values'])})"
            elif kind == "regex":
                bad = f"NOT regexp_matches({column}, '{rule['pattern']}')"
            elif kind == "between":
                bounds = [f"{column} < {rule['min']}"] + ([f"{column} > {rule['max']}"] if rule.get("max") else [])
                bad = "(" + " OR ".join(bounds) + ")"
            else:
                column, judged = rule["a"], f"{rule['a']} IS NOT NULL AND {rule['b']} IS NOT NULL"
                bad = f"{rule['a']} < {rule['b']}"
            rows.append(_rule(suite, kind, column, f"count(*) FILTER ({judged})", f"count(*) FILTER ({judged} AND {bad})",
                              table, str(rule.get("mostly", 1.0))))
    return " UNION ALL ".join(rows)


FACT_STATUS = """
, graded AS (SELECT * REPLACE (CASE WHEN status = 'SUCCESS' THEN 'SUCCESS' WHEN starts_with(status, 'ERROR') THEN 'ERROR'
             ELSE 'UNKNOWN' END AS status) FROM fact)
"""
BRONZE_RESULTS = _suite_sql("bronze", suites.BRONZE, "parsed")
FACT_RESULTS = _suite_sql("fact", suites.FACT, "graded")
USER_RESULTS = _suite_sql("dim_users", suites.DIM_USERS, "history")


def _graded(spark, folder):
    return facts(spark, folder).withColumn("status", status_class())


@query("dq_bronze", with_events(BRONZE_RESULTS))
def dq_bronze(spark, folder):
    return validate(_late_marked(spark, folder), "bronze", suites.BRONZE)


@query("dq_fact", with_facts(FACT_STATUS + FACT_RESULTS))
def dq_fact(spark, folder):
    return validate(_graded(spark, folder), "fact", suites.FACT)


@query("dq_dim_users", with_facts(HISTORY_SQL + USER_RESULTS))
def dq_dim_users(spark, folder):
    return validate(stored_history(spark, folder), "dim_users", suites.DIM_USERS)


# Copies are still in the topic, so this rule fails there by design.
STRICT = [{"rule": "unique", "column": "event_id"}, {"rule": "not_null", "column": "user_id"}]


@query("dq_topic_strict", with_events(_suite_sql("topic", STRICT, "parsed")))
def dq_topic_strict(spark, folder):
    """Rules that fail on the topic: ids repeat, and users may be anonymous."""
    return validate(_late_marked(spark, folder), "topic", STRICT)


@query(
    "dq_checkpoint",
    with_facts(
        FACT_STATUS
        + HISTORY_SQL
        + f"""
, results AS ({BRONZE_RESULTS} UNION ALL {FACT_RESULTS} UNION ALL {USER_RESULTS} UNION ALL {_suite_sql("topic", STRICT, "parsed")})
SELECT count(*) AS evaluated, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
  round(count(*) FILTER (success) * 100.0 / count(*), 2) AS success_percent,
  string_agg(CASE WHEN NOT success THEN suite || '.' || rule || '.' || column_name END, ', '
             ORDER BY suite || '.' || rule || '.' || column_name) AS failed_rules
FROM results"""
    ),
)
def dq_checkpoint(spark, folder):
    """Totals over all suites."""
    rows = _late_marked(spark, folder)
    results = (
        validate(rows, "bronze", suites.BRONZE)
        .unionByName(validate(_graded(spark, folder), "fact", suites.FACT))
        .unionByName(validate(stored_history(spark, folder), "dim_users", suites.DIM_USERS))
        .unionByName(validate(rows, "topic", STRICT))
    )
    return summarize(results).withColumn("success_percent", F.col("success_percent").cast("double"))


# Rules of the quarantine over bronze rows.
ROW_RULES = [
    {"rule": "not_null", "column": "user_id"},
    {"rule": "regex", "column": "output_roman", "pattern": "^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"},
    {"rule": "between", "column": "input_number", "min": 1, "max": 3000},
    {"rule": "in_set", "column": "status", "values": ["SUCCESS"]},
]


@query(
    "dq_quarantine",
    with_events(
        """
, marked AS (SELECT event_id, kafka_offset,
    CASE WHEN user_id IS NULL THEN 'not_null:user_id' END AS r1,
    CASE WHEN NOT regexp_matches(output_roman, '^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$') THEN 'regex:output_roman' END AS r2,
    CASE WHEN input_number < 1 OR input_number > 3000 THEN 'between:input_number' END AS r3,
    CASE WHEN status <> 'SUCCESS' THEN 'in_set:status' END AS r4 FROM parsed)
SELECT event_id, kafka_offset, concat_ws(',', r1, r2, r3, r4) AS reasons FROM marked
WHERE coalesce(r1, r2, r3, r4) IS NOT NULL"""
    ),
)
def dq_quarantine(spark, folder):
    rows = quarantine(_late_marked(spark, folder), ROW_RULES)
    return rows.select("event_id", "kafka_offset", F.array_join("reasons", ",").alias("reasons"))
