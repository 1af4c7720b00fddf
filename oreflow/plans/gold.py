"""Silver to gold: summaries of an interval or of everything."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from oreflow.functions.events import half_open, instant
from oreflow.operators import metrics
from oreflow.operators.quality import checked_step
from oreflow.operators.sizing import sized_side
from oreflow.plans.layers import with_bucket
from oreflow.session import materialize
from oreflow.sources.tables import SnapshotTable

STANDS_ON = "days-"


def run_daily(
    facts: DataFrame, table: SnapshotTable, start, end, generated_at, committed_at=None, rules=None,
    bad_rows: SnapshotTable | None = None,
) -> int:
    """Recompute the touched days from all facts and merge them, if they pass the ``rules``."""
    whole = start is None or end is None
    days = metrics.daily_summary(facts, generated_at) if whole else metrics.daily_summary_of_interval(facts, start, end, generated_at)
    days = checked_step(days, "daily", rules, bad_rows, committed_at) if rules else materialize(facts.sparkSession, days)
    return table.overwrite(days, committed_at) if whole else table.merge(days, committed_at, check=False)


def run_user_metrics(facts: DataFrame, table: SnapshotTable, start, end, generated_at, committed_at=None) -> int:
    """Recompute the touched users from all facts and merge them."""
    if start is None or end is None:
        return table.overwrite(with_bucket(metrics.user_metrics(facts, generated_at)), committed_at)
    users = with_bucket(metrics.user_metrics_of_interval(facts, start, end, generated_at))
    return table.merge(materialize(facts.sparkSession, users), committed_at, check=False)


def run_user_totals(
    facts: DataFrame, days: SnapshotTable, totals: SnapshotTable, start, end, generated_at, committed_at=None
) -> int:
    """Bring the sums per user and day, and from them the users' totals, up to the facts of the interval.

    Days with facts processed in the interval are summed anew from the facts of those days; users' totals then change
    by the difference, so no run reads all days of a user. The totals' publish names the publish of the sums
    that it stands on: a run that died between the two is made good by the next one, and a run that is
    repeated changes nothing.
    """
    if start is None or end is None:
        moved = days.overwrite(metrics.user_day_sums(facts), committed_at)
        whole = metrics.user_sums(days.read()).withColumn("generated_at", instant(generated_at))
        return totals.overwrite(with_bucket(whole), committed_at, f"{STANDS_ON}{moved}")
    touched = facts.filter(half_open("processed_at", start, end)).select("event_date").distinct()
    dates = sorted(row[0] for row in touched.collect() if row[0] is not None)
    recent = facts.filter(F.col("event_date").isin(dates))
    moved = days.overwrite_partitions(metrics.user_day_sums(recent), committed_at, touched=[str(d) for d in dates])
    base = max((int(o[len(STANDS_ON):]) for o in totals.operations() if o.startswith(STANDS_ON)), default=0)
    parts = days.parts_changed(base)
    before, after = days.read_parts(parts, base), days.read_parts(parts)
    changed = metrics.changed_sums(before, after, totals.read(), days.read()).withColumn("generated_at", instant(generated_at))
    changed = materialize(facts.sparkSession, with_bucket(changed))
    buckets = [str(row[0]) for row in changed.select("bucket").distinct().collect()]
    kept = totals.read_parts(buckets).join(sized_side(changed.select("user_id")), "user_id", "left_anti")
    result = kept.unionByName(changed.filter("requests > 0"))
    return totals.overwrite_partitions(result, committed_at, f"{STANDS_ON}{moved}", buckets)


def run_popular(facts: DataFrame, table: SnapshotTable, generated_at, committed_at=None) -> int:
    """The ranking is replaced as a whole in one publish."""
    return table.overwrite(metrics.popular_numbers(facts, generated_at), committed_at)
