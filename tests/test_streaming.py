"""Streams: three micro-batches, restarts, late rows and keyed state."""

import json
from datetime import datetime, timedelta, timezone

from oreflow.schemas import TOPIC
from oreflow.session import shared_dir, subfolders, work_path
from oreflow.sources.batches import BatchTable
from oreflow.sources.topic import append_log, stream_log
from oreflow.streaming import bronze as job
from oreflow.streaming import hourly, state

START = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def record(event_id, minutes, offset):
    time_text = (START + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%SZ")
    value = json.dumps({"eventId": event_id, "eventTime": time_text, "eventType": "SINGLE", "status": "SUCCESS"}).encode()
    return (bytearray(b"k"), bytearray(value), 0, offset, START)


# On time; then a copy, a copy inside the file and a row one hour late; then a row two hours late.
FILES = [
    [record("a", 0, 1), record("b", 30, 2), record("c", 120, 3)],
    [record("a", 0, 4), record("d", 125, 5), record("d", 125, 6), record("e", 60, 7)],
    [record("f", 5, 8), record("c", 120, 9)],
]


def run(spark, step, path, checkpoint):
    job.start(stream_log(spark, path), step, checkpoint, available_now=True).awaitTermination()


def test_three_batches_and_restart(spark, root):
    tables = job.StreamTables.under(spark, root)
    step = job.BronzeStream(tables, clock=lambda i: START + timedelta(minutes=i))
    path, checkpoint = work_path(spark, "topic"), work_path(spark, "checkpoint")
    for rows in FILES:
        append_log(spark.createDataFrame(rows, TOPIC), path)
        run(spark, step, path, checkpoint)
    got = {r["event_id"]: r["is_late_arrival"] for r in tables.bronze.read().collect()}
    assert got == {"a": False, "b": False, "c": False, "d": False, "e": True, "f": True}
    assert {r["event_id"] for r in tables.late.read().collect()} == {"e", "f"}
    counters = [tuple(r) for r in tables.counters.read().orderBy("batch_id").select("received", "processed", "duplicates", "late").collect()]
    assert counters == [(3, 3, 0, 0), (4, 2, 2, 1), (2, 1, 1, 1)]
    run(spark, step, path, checkpoint)
    assert tables.bronze.read().count() == 6


def test_repeated_batch_adds_nothing(spark, root):
    tables = job.StreamTables.under(spark, root)
    step = job.BronzeStream(tables, clock=lambda i: START)
    rows = spark.createDataFrame(FILES[0], TOPIC)
    step(rows, 0)
    step(rows, 0)
    assert tables.bronze.read().count() == 3 and tables.counters.read().count() == 1


def test_allowed_lateness(spark, root):
    tables = job.StreamTables.under(spark, root)
    step = job.BronzeStream(tables, allowed_lateness=timedelta(hours=1), clock=lambda i: START)
    for i, rows in enumerate(FILES):
        step(spark.createDataFrame(rows, TOPIC), i)
    assert {r["event_id"] for r in tables.late.read().collect()} == {"e"}
    assert {r["event_id"] for r in tables.too_late.read().collect()} == {"f"}
    assert "f" not in {r["event_id"] for r in tables.bronze.read().collect()}


def test_hours_and_late_rows_are_all_rows(spark, root):
    tables, partials = job.StreamTables.under(spark, root), hourly.partial_table(spark, f"{root}/hourly")
    ingest = job.BronzeStream(tables, allowed_lateness=timedelta(hours=1), clock=lambda i: START)
    step = hourly.HourlyStream(ingest, partials)
    for i, rows in enumerate(FILES):
        step(spark.createDataFrame(rows, TOPIC), i)
    step(spark.createDataFrame(FILES[-1], TOPIC), len(FILES) - 1)  # as after a failure
    hours = {r["hour_key"].hour: r["total_requests"] for r in hourly.hourly(partials.read()).collect()}
    late = {r["hour_key"].hour: r["late_requests"] for r in hourly.late_by_hour(tables.too_late.read()).collect()}
    assert hours == {12: 2, 13: 1, 14: 2} and late == {12: 1}


def test_state_holds_no_more_than_the_delay(spark, root):
    """Ids leave the state as the watermark passes; a copy within the delay is caught, a row behind it counted."""
    path, checkpoint = work_path(spark, "topic"), work_path(spark, "checkpoint")
    held, dropped = [], []

    def feed(rows):
        append_log(spark.createDataFrame(rows, TOPIC), path)
        query = state.start_unique(stream_log(spark, path), root, checkpoint, "60 minutes", available_now=True)
        query.awaitTermination()
        held.append(state.progress_of(query)[-1]["held"])
        dropped.append(sum(p["dropped"] for p in state.progress_of(query)))

    for hour in range(6):
        rows = [record(f"{hour}-{i}", 60 * hour + i, 100 * hour + i) for i in range(40)]
        feed(rows + [record(f"{hour}-0", 60 * hour, 100 * hour + 90)] + ([record(f"{hour - 1}-39", 60 * hour - 21, 0)] if hour else []))
    feed([record("old", 0, 999)])
    assert spark.read.parquet(root).count() == 240
    assert max(held) <= 130 and dropped == [0] * 6 + [1]


def test_batches_are_written_once_and_closed(spark, root):
    table = BatchTable(spark, root, "k int, batch_id bigint", "k", block=3)
    rows = lambda *values: spark.createDataFrame([(v,) for v in values], "k int")
    assert table.read().collect() == [] and table.batch(0).collect() == []
    for i in range(5):
        table.write(rows(i, 10 * i), i)
    table.write(rows(4, 44), 4)  # as after a failure
    whole = sorted(map(tuple, table.read().collect()))
    assert whole == [(0, 0), (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (10, 1), (20, 2), (30, 3), (44, 4)]
    assert [i for i in range(9) if table.closes(i)] == [4, 7]
    assert table.close(0) and not table.close(0)
    assert sorted(map(tuple, table.read().collect())) == whole
    assert subfolders(spark, f"{root}/open") == ["block=1"]
    assert table.blocks([0]).count() == 6 and table.blocks([1]).count() == 4 and table.blocks([7]).count() == 0
    assert table.batch(4).count() == 2


def test_work_of_a_batch_does_not_grow(spark, root):
    """Twelve batches in blocks of two: steps are removed, old blocks are few files and are not opened again."""
    tables = job.StreamTables.under(spark, root, block=2)
    step = job.BronzeStream(tables, ttl=timedelta(minutes=5), clock=lambda i: START + timedelta(minutes=i))
    steps = lambda: [n for n in subfolders(spark, f"{shared_dir(spark)}/oreflow") if n.startswith("step-")]
    before = len(steps())
    for i in range(12):
        step(spark.createDataFrame([record("same", 0, 100), record(f"e{i}", i, 100 + i)], TOPIC), i)
    assert len(steps()) == before
    assert sorted(subfolders(spark, f"{root}/bronze/open")) == ["block=5"]
    live = tables.counters.batch(11).first()["live"]
    assert [b["block"] for b in live] == [3, 4, 5]
    counts = [tuple(r) for r in tables.counters.read().orderBy("batch_id").select("batch_id", "received", "processed").collect()]
    # "same" passes in batches 0, 5 and 10: each time five minutes have gone by
    assert counts == [(i, 2, 2 if i % 5 == 0 else 1) for i in range(12)]
    assert tables.bronze.read().count() == 15


def test_parsed_events_are_printed(spark):
    path = work_path(spark, "topic")
    append_log(spark.createDataFrame(FILES[0], TOPIC), path)
    query = job.print_events(stream_log(spark, path), work_path(spark, "checkpoint"), available_now=True)
    query.awaitTermination()
    told = query.recentProgress[0]
    assert told["numInputRows"] == 3 and "Console" in told["sink"]["description"]


def test_a_batch_is_written_once_and_its_keys_not_at_all(spark, root, monkeypatch):
    from oreflow import session

    steps, fresh_path = [], session.work_path
    monkeypatch.setattr(session, "work_path", lambda s, name: steps.append(name) or fresh_path(s, name))
    tables = job.StreamTables.under(spark, root)
    step = job.BronzeStream(tables, clock=lambda i: START)
    for rows, written in zip(FILES, ([], ["step"], ["step"])):  # nothing to compare with, then the unique rows
        steps.clear()
        step(spark.createDataFrame(rows, TOPIC), tables.counters.read().count())
        assert steps == written
    assert {r["event_id"] for r in tables.bronze.read().collect()} == set("abcdef")


def test_segments_are_not_stored_before_the_stream(spark, folder):
    from oreflow.catalog import inputs, streams

    streams.stream_append(spark, folder)
    assert not any(name == "segments" for _, _, name in inputs._STORED)
