"""Time the headline queries; prints one JSON line.

Settings: BENCH_SF_DIR (folder of the tables), BENCH_CPUS (local cores).
Layer inputs (topic, bronze, facts) are written once before timing, as each
job reads the published output of the job before it.
"""

from __future__ import annotations

import json
import os
import time

from oreflow.catalog import QUERIES, inputs, logs
from oreflow.catalog.silver import stored_history
from oreflow.session import local_session

HEADLINE = [
    "bronze_dedup",
    "bronze_incremental",
    "silver_fact",
    "silver_runs",
    "daily_summary",
    "daily_summary_incremental",
    "user_metrics",
    "user_metrics_incremental",
    "popular_numbers",
    "daily_stats",
    "hourly_metrics",
    "latency_report",
    "dim_users_scd2",
    "scd2_asof_join",
    "dq_bronze",
    "dq_fact",
    "roman_encode",
    "range_expand",
    "key_validation",
    "rolling_rate_audit",
    "rate_limit_replay",
    "access_log_minutely",
    "lineage_impact",
    "page_info",
    "stream_bronze",
    "stream_hourly",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    begin = time.perf_counter()
    for prepare in (inputs.topic, inputs.bronze, inputs.facts, inputs.popular, stored_history, logs.access):
        prepare(spark, folder)
    setup = time.perf_counter() - begin
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "setup_sec": round(setup, 3),
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
