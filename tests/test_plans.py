"""Layer jobs: repeated and split runs give the same tables."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oreflow.catalog import inputs
from oreflow.operators import keysets, lineage, metrics, scd2
from oreflow.operators.quality import ValidationFailed
from oreflow.plans import bronze, gold, jobs, layers, reports, silver, suites
from oreflow.schemas import FACT_COLUMNS
from oreflow.session import work_path
from oreflow.sources.files import list_catalog_tables, read_log_lines
from oreflow.sources.tables import SnapshotTable
from oreflow.sources.topic import after_global_mark, after_marks, append_log, starting_offsets

RUN_TS = "2024-03-01"


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_backfill_then_incremental_is_one_load(spark, folder, root):
    topic = inputs.topic(spark, folder)
    table = layers.bronze(spark, root)
    part = bronze.backfill(topic, table, RUN_TS, end="2024-01-02")
    rest = bronze.ingest(topic.filter("offset >= 0"), table, RUN_TS)
    again = bronze.ingest(topic, table, RUN_TS)
    whole = layers.bronze(spark, work_path(spark, "whole"))
    bronze.backfill(topic, whole, RUN_TS)
    assert part["rows"] > 0 and rest["snapshot_id"] == 2 and again["rows"] == 0
    assert table.read().select("event_id").distinct().count() == table.read().count()
    ids = {r[0] for r in whole.read().select("event_id").collect()}
    assert {r[0] for r in table.read().select("event_id").collect()} <= ids
    bronze.backfill(topic, table, RUN_TS)
    assert {r[0] for r in table.read().select("event_id").collect()} == ids


def test_failed_backfill_is_invisible(spark, folder, root):
    table = layers.bronze(spark, root)
    rules = [{"rule": "not_null", "column": "user_id"}]
    with pytest.raises(ValidationFailed):
        bronze.backfill(inputs.topic(spark, folder), table, RUN_TS, rules=rules)
    assert table.read().count() == 0
    bronze.backfill(inputs.topic(spark, folder), table, RUN_TS, rules=[r for r in suites.BRONZE if r.get("column") != "is_late_arrival" and r["rule"] != "columns_in_set"])
    assert table.read().count() > 0


def test_marks(spark):
    topic = spark.createDataFrame([(p, o) for p in (0, 1) for o in range(5)], "partition int, offset long").withColumns(
        {"key": F.lit(None).cast("binary"), "value": F.lit(None).cast("binary"), "timestamp": F.lit(None).cast("timestamp")}
    )
    marks = spark.createDataFrame([(0, 3)], "kafka_partition int, max_offset long")
    assert sorted((r["partition"], r["offset"]) for r in after_marks(topic, marks).collect()) == [(0, 4)] + [(1, o) for o in range(5)]
    assert after_global_mark(topic, spark.createDataFrame([(3,)], "max_offset long")).count() == 2
    assert starting_offsets("t", {1: 4, 0: 7}) == '{"t": {"0": 8, "1": 5}}'
    assert starting_offsets("t", None) == "earliest"


def test_silver_and_gold_runs_repeat(spark, folder, root):
    rows = inputs.parsed(spark, folder)
    table = layers.fact(spark, f"{root}/a")
    silver.run_facts(rows, table, None, None, RUN_TS)
    first = rows_of(table.read(), FACT_COLUMNS)
    silver.run_facts(rows, table, None, None, RUN_TS)
    assert rows_of(table.read(), FACT_COLUMNS) == first
    silver.run_facts(rows, table, None, None, RUN_TS, full_refresh=True)
    assert rows_of(table.read(), FACT_COLUMNS) == first

    users = layers.user_snapshot(spark, root)
    silver.run_user_snapshot(table.read(), users, RUN_TS)
    assert users.read().count() == table.read().select("user_id").dropna().distinct().count()

    days = layers.daily(spark, root)
    gold.run_daily(table.read(), days, None, None, RUN_TS)
    whole = rows_of(days.read(), days.read().columns)
    gold.run_daily(table.read(), days, "2024-03-01", "2024-03-02", RUN_TS)
    assert rows_of(days.read(), days.read().columns) == whole


def test_semi_join_prunes_days(spark, folder):
    """The touched days reach the fact scan as a partition filter."""
    from oreflow.operators.metrics import daily_summary_of_interval

    daily = daily_summary_of_interval(inputs.facts(spark, folder), "2024-01-01", "2024-01-03", RUN_TS)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_catalog_tables(spark, folder):
    name = "lake_" + work_path(spark, "x").rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name}")
    popular = inputs.popular(spark, folder)
    popular.write.saveAsTable(f"{name}.gold_popular")
    assert [r["row_count"] for r in list_catalog_tables(spark, name).collect()] == [popular.count()]
    with pytest.raises(Exception):
        popular.write.mode("errorifexists").saveAsTable(f"{name}.gold_popular")


def test_log_files(spark, root):
    import os

    folder = root + "/containers/0123456789abcdef"
    os.makedirs(folder)
    with open(folder + "/x-json.log", "w") as out:
        out.write('{"log":"hello","stream":"stderr"}\nplain\n')
    rows = read_log_lines(spark, root + "/containers/*/*.log")
    assert rows.count() == 2 and rows.filter(F.col("file_path").contains("0123456789abcdef")).count() == 2


def test_analytics_pack(spark, folder):
    popular = inputs.popular(spark, folder)
    users = spark.createDataFrame([(1, 4), (2, 8)], "user_id long, total_requests long")
    pack = reports.analytics_pack(popular, users)
    assert pack["user_activity_summary"].first()["avg_requests_per_user"] == 6.0
    shares = [r["percentage"] for r in pack["number_range_distribution"].collect()]
    assert sum(shares) == pytest.approx(100, abs=0.1)


def test_merges_read_the_days_whose_keys_meet(spark, root):
    """Thirty days of keys; a batch of new ids, one that is known, and one that has moved to another day."""
    row = "concat('e', id) AS event_id, date_add(DATE'2024-01-01', cast(id % 30 AS int)) AS day, 'old' AS v"
    table = SnapshotTable(spark, root, "event_id string, day date, v string", "day", ("event_id",), key_summary=True)
    table.append(spark.sql(f"SELECT {row} FROM range(3000)"))
    batch = spark.createDataFrame(
        [(f"n{i}", date(2024, 2, 1), "new") for i in range(50)] + [("e7", date(2024, 1, 8), "new"), ("e3", date(2024, 1, 20), "new")],
        "event_id string, day date, v string",
    )
    days = {r[0] for r in table.read_holding(batch).select("day").distinct().collect()}
    assert {date(2024, 1, 8), date(2024, 1, 4)} <= days and len(days) <= 6
    paths = {f.split("part_key=")[1][:10] for f in table.read_holding(batch).inputFiles()}
    assert paths == {str(d) for d in days}
    table.insert_new(batch)
    assert table.read().count() == 3050
    table.merge(batch)
    moved = {r["event_id"]: (r["day"], r["v"]) for r in table.read().filter("event_id IN ('e3', 'e7')").collect()}
    assert moved == {"e3": (date(2024, 1, 20), "new"), "e7": (date(2024, 1, 8), "new")}
    assert table.read().count() == 3050 and table.read().select("event_id").distinct().count() == 3050


def test_bitmaps_miss_no_key(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("part"), F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "x").alias("w"))
    for bits in (64, 1 << 20, 1 << 40):
        met = keysets.groups_met(keysets.key_bitmaps(rows, ["k", "w"], ["part"], bits), keysets.key_bitmaps(rows.filter("k IN (8, 4996)"), ["k", "w"], [], bits), ["part"])
        found = {r[0] for r in met.collect()}
        assert {8 % 7, 4996 % 7} <= found and (bits < 100 or len(found) == 2)


def test_totals_stand_on_sums_of_days(spark, root):
    """Facts change, move to another day and vanish; a run that died after its first publish is made good."""
    layout = "user_id long, event_date date, event_time timestamp, conversion_count long, input_number int, processed_at timestamp"

    def facts(rows):
        return spark.createDataFrame([(u, date(2024, 1, d), datetime(2024, 1, d, h), 1, n, datetime(2024, 2, p)) for u, d, h, n, p in rows], layout)

    def check(rows):
        want = metrics.user_metrics(rows, RUN_TS)
        assert rows_of(metrics.metrics_of_sums(totals.read()), want.columns) == rows_of(want, want.columns)

    days, totals = layers.user_days(spark, root), layers.user_totals(spark, root)
    rows = [(1, 1, 5, 10, 1), (1, 2, 6, None, 1), (2, 1, 7, 30, 1), (3, 3, 8, 5, 1), (None, 1, 1, 1, 1)]
    gold.run_user_totals(facts(rows), days, totals, None, None, RUN_TS)
    check(facts(rows))
    rows += [(1, 1, 9, 20, 2), (4, 4, 1, 7, 2)]
    gold.run_user_totals(facts(rows), days, totals, "2024-02-02", "2024-02-03", RUN_TS)
    check(facts(rows))
    # user 3's only fact is gone, user 1's last one too; another fact of their days was processed
    rows = [r for r in rows if r[:3] not in ((3, 3, 8), (1, 2, 6))] + [(2, 3, 1, 1, 3), (2, 2, 1, 1, 3)]
    gold.run_user_totals(facts(rows), days, totals, "2024-02-03", "2024-02-04", RUN_TS)
    check(facts(rows))
    # a run dies after the sums are published
    rows += [(5, 2, 2, 2, 4)]
    days.overwrite_partitions(metrics.user_day_sums(facts(rows).filter("event_date = DATE'2024-01-02'")))
    rows += [(6, 6, 2, 2, 5)]
    gold.run_user_totals(facts(rows), days, totals, "2024-02-05", "2024-02-06", RUN_TS)
    check(facts(rows))
    gold.run_user_totals(facts(rows), days, totals, "2024-02-05", "2024-02-06", RUN_TS)
    check(facts(rows))


def test_history_is_spliced(spark, root):
    """Late facts inside old versions, at their borders and before the first one; days before are not read."""
    draw = random.Random(4)
    layout = "user_id long, client_ip string, event_time timestamp, event_id string, event_date date, processed_at timestamp"
    rows = []
    for i in range(400):
        moment = datetime(2024, 1, 1) + timedelta(hours=draw.randrange(600))
        rows.append((draw.randrange(12) or None, f"ip{draw.randrange(3)}", moment, f"e{i:03}", moment.date(), datetime(2024, 3, 1 + draw.randrange(4))))
    facts = spark.createDataFrame(rows, layout)
    table = layers.user_history(spark, root)
    for run in range(4):
        seen = facts.filter(F.col("processed_at") < F.lit(datetime(2024, 3, 2 + run)))
        silver.run_user_history(seen, table, f"2024-03-0{1 + run}", f"2024-03-0{2 + run}")
        want = scd2.build_history(seen, "user_id", **silver.HISTORY)
        assert rows_of(table.read(), want.columns) == rows_of(want, want.columns)
    version = table.manifest().agg(F.max("snapshot_id")).first()[0]
    silver.run_user_history(facts, table, "2025-01-01", None)
    assert table.manifest().agg(F.max("snapshot_id")).first()[0] == version + 1
    assert rows_of(table.read(), want.columns) == rows_of(want, want.columns)
    silver.run_user_history(facts, table, None, None, full_refresh=True)
    assert rows_of(table.read(), want.columns) == rows_of(want, want.columns)


def test_jobs_are_recorded_and_gated(spark, folder, root, capsys):
    """Bronze, silver and gold as programs; a run that the rules refuse leaves a FAIL record and its rows."""
    path = work_path(spark, "topic")
    append_log(inputs.topic(spark, folder), path)
    common = ["--root", root, "--run-ts", RUN_TS]
    assert jobs.main(["bronze", "--topic", path, *common], spark) == jobs.DONE
    assert jobs.main(["gold", *common], spark) == jobs.REFUSED  # no facts, so no day
    assert jobs.main(["silver", *common], spark) == jobs.DONE
    assert jobs.main(["gold", *common], spark) == jobs.DONE
    facts = layers.fact(spark, root)
    before = facts.read().count()
    with pytest.raises(ValidationFailed):
        jobs.run_silver(spark, root, None, None, RUN_TS, rules=[{"rule": "between", "column": "conversion_count", "max": 1}])
    assert before > 0 and facts.read().count() == before
    bad = layers.quarantined(spark, root).read().filter("suite = 'fact'")
    assert bad.count() == facts.read().filter("conversion_count > 1").count() > 0
    assert {tuple(r["reasons"]) for r in bad.collect()} == {("between:conversion_count",)}
    runs = layers.lineage(spark, root).read().collect()
    states = sorted((r["job_name"], r["event_type"]) for r in runs)
    assert states.count(("silver.facts", "FAIL")) == 1 and states.count(("gold.daily", "FAIL")) == 1
    assert all(states.count((job, "COMPLETE")) == 1 for job in ("bronze.ingest", "silver.facts", "silver.users", "gold.daily", "gold.users", "gold.popular"))
    reached = {r["node"] for r in lineage.impact(lineage.edges(layers.lineage(spark, root).read()), spark.createDataFrame([(path,)], "node string")).collect()}
    assert {facts.path, layers.user_history(spark, root).path, layers.user_totals(spark, root).path} <= reached
    with pytest.raises(SystemExit):
        jobs.main(["bronze", "--root", root], spark)
    assert jobs.main(["bronze", "--root", root, "--topic", path + "/none"], spark) == jobs.FAILED
