"""Bronze to silver: the fact table and the user dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.functions.events import half_open, to_fact
from oreflow.operators.dedup import latest_ingested
from oreflow.operators.metrics import user_snapshot
from oreflow.operators.quality import checked_step
from oreflow.operators.scd2 import build_history, first_touched, splice_history
from oreflow.plans.layers import with_bucket, with_event_date
from oreflow.session import materialize
from oreflow.sources.tables import SnapshotTable

HISTORY = {"attributes": ["client_ip"], "time": "event_time", "tie": "event_id"}


def interval_facts(bronze: DataFrame, start, end, processed_at) -> DataFrame:
    """Facts of the bronze rows ingested in the interval.

    Errors go first and copies second: a later failed copy never hides an
    earlier success.
    """
    taken = bronze.filter(half_open("ingested_at", start, end)).filter(F.col("status") == "SUCCESS")
    return with_event_date(to_fact(latest_ingested(taken), processed_at))


def run_facts(
    bronze: DataFrame, table: SnapshotTable, start, end, processed_at, full_refresh=False, committed_at=None, rules=None,
    bad_rows: SnapshotTable | None = None,
) -> int:
    """Merge the facts of the interval. With ``rules`` they are checked while they are computed: where one fails
    nothing is published, and the rows that break it go to ``bad_rows``."""
    facts = interval_facts(bronze, start, end, processed_at)
    facts = checked_step(facts, "fact", rules, bad_rows, committed_at) if rules else materialize(bronze.sparkSession, facts)
    if full_refresh:
        return table.overwrite(facts, committed_at)
    # One row per event id is left by the dedup, so keys need no second check.
    return table.merge(facts, committed_at, check=False)


def run_user_snapshot(facts: DataFrame, table: SnapshotTable, run_ts, committed_at=None) -> int:
    return table.overwrite(with_bucket(user_snapshot(facts, run_ts)), committed_at)


def run_user_history(facts: DataFrame, table: SnapshotTable, start, end, committed_at=None, full_refresh=False) -> int:
    """Bring the history up to the facts processed in the interval.

    Each touched user's history is rebuilt from its earliest touched fact on; days before the earliest of all
    are not read. Other users, and buckets without touched users, stay as they are. A user without a stored
    history has no facts before its first touched one, so it is rebuilt whole. ``full_refresh`` rebuilds
    everything, which is needed only after facts were given another time.
    """
    if full_refresh:
        return table.overwrite(with_bucket(build_history(facts, "user_id", **HISTORY)), committed_at)
    touched = first_touched(facts.filter(half_open("processed_at", start, end)), "user_id", HISTORY["time"])
    first = touched.agg(F.min("_since").cast("date")).first()[0]
    if first is None:
        return table.overwrite_partitions(table.read().limit(0), committed_at, "merge")
    recent = facts.filter(F.col("event_date") >= F.lit(first))
    buckets = [str(r[0]) for r in with_bucket(touched).select("bucket").distinct().collect()]
    spliced = splice_history(table.read_parts(buckets).drop("bucket"), recent, touched, "user_id", **HISTORY)
    return table.overwrite_partitions(with_bucket(spliced), committed_at, "merge", buckets)
