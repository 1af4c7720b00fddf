"""Topic to bronze: incremental runs and validated backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from oreflow.functions.events import half_open, parse_events
from oreflow.operators.dedup import highest_offset
from oreflow.operators.merge import new_rows
from oreflow.operators.metrics import high_water_mark
from oreflow.operators.quality import gate, validate
from oreflow.plans.layers import with_event_date
from oreflow.session import materialize
from oreflow.sources.tables import SnapshotTable
from oreflow.sources.topic import after_global_mark, after_marks


def _collected(events: DataFrame) -> tuple[DataFrame, dict]:
    """The batch, computed once, with its metrics taken on the way."""
    seen = Observation("ingest")
    measured = events.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("kafka_offset").alias("max_offset"))
    batch = materialize(events.sparkSession, measured)
    return batch, seen.get


def ingest(topic: DataFrame, table: SnapshotTable, ingested_at, committed_at=None, per_partition: bool = True) -> dict:
    """One incremental run: messages above the ingested offsets, parsed,
    deduplicated (highest offset wins) and inserted unless already there."""
    marks = high_water_mark(table.read(), per_partition)
    fresh = after_marks(topic, marks) if per_partition else after_global_mark(topic, marks)
    events = with_event_date(highest_offset(parse_events(fresh, ingested_at)))
    batch, metrics = _collected(events)
    snapshot = table.insert_new(batch, committed_at)
    return {**metrics, "snapshot_id": snapshot}


def backfill(
    topic: DataFrame, table: SnapshotTable, ingested_at, start=None, end=None, rules=None, committed_at=None,
    report_only: bool = False,
) -> dict:
    """Re-read the whole topic for ``start <= event_time < end``.

    Rows are staged, checked against the rules and only then published, so a
    bad backfill never becomes visible.
    """
    events = parse_events(topic, ingested_at).filter(half_open("event_time", start, end))
    batch, metrics = _collected(with_event_date(highest_offset(events)))
    missing = new_rows(batch, table.read_holding(batch), list(table.key))
    token, staged = table.stage(missing)
    passed = gate(validate(staged, "staged", rules), report_only) if rules else True
    snapshot = table.publish(token, committed_at=committed_at)
    return {**metrics, "snapshot_id": snapshot, "passed": passed}
