"""Properties of merges, ordered helpers, percentiles, quality and lineage."""

import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from oreflow.functions.events import dead_letters, parse_events
from oreflow.functions.logs import container_id, parse_container_logs
from oreflow.operators import dedup, lineage, metrics, ordered, quality, scd2
from oreflow.operators.lookups import match_logs_to_events, validate_keys
from oreflow.operators.merge import DuplicateKeys, new_rows, require_unique, upsert
from oreflow.operators.quantiles import exact_percentiles
from oreflow.operators.rate import rolling_audit
from oreflow.sources.tables import SnapshotTable


def rows_of(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_broken_json(spark):
    rows = spark.createDataFrame(
        [(b"k", b'{"eventId":"a","eventTime":"2024-01-01T00:00:00Z","inputNumber":"x"}', 0, 1), (b"k", b"{broken", 0, 2),
         (b"k", b'{"eventType":"SINGLE"}', 0, 3), (b"k", b'{"eventId":"b","eventTime":"soon","extra":1}', 0, 4), (None, None, 0, 5)],
        "key binary, value binary, partition int, offset long",
    ).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    good = parse_events(rows, "2024-01-01").collect()
    assert [(r["event_id"], r["event_time"] is None, r["input_number"]) for r in good] == [("a", False, None), ("b", True, None)]
    dead = {r["kafka_offset"]: r["error_type"] for r in dead_letters(rows, "2024-01-01").collect()}
    assert dead == {2: "MALFORMED_JSON", 3: "MISSING_EVENT_ID", 5: "MALFORMED_JSON"}


def test_dedup_ignores_input_order(spark):
    data = [(f"e{i % 7}", i, i % 3) for i in range(60)]
    layout = "event_id string, kafka_offset long, kafka_partition int"
    first = rows_of(dedup.highest_offset(spark.createDataFrame(data, layout)))
    random.Random(1).shuffle(data)
    assert rows_of(dedup.highest_offset(spark.createDataFrame(data, layout))) == first
    assert len(first) == 7


def test_dedup_limits_groups_before_the_shuffle(spark):
    rows = spark.createDataFrame([("a", 1, 0)], "event_id string, kafka_offset long, kafka_partition int")
    plan = dedup.highest_offset(rows)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below


def test_merge_twice_is_merge_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    source = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    once = upsert(target, source, ["id"])
    assert rows_of(once, "id", "v") == [(1, "a"), (2, "B"), (3, "c")]
    assert rows_of(upsert(once, source, ["id"]), "id", "v") == rows_of(once, "id", "v")
    assert rows_of(new_rows(source, target, ["id"]), "id") == [(3,)]
    with pytest.raises(DuplicateKeys):
        require_unique(source.union(source), ["id"])


def test_table_merge_keeps_untouched_files(spark, root):
    table = SnapshotTable(spark, root, "id long, v string, day int", "day", ("id",))
    table.append(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, v string, day int"))
    before = {(r["part_key"], r["file_path"]) for r in table.files().collect()}
    table.merge(spark.createDataFrame([(2, "B", 3), (4, "d", 3)], "id long, v string, day int"))
    assert rows_of(table.read(), "id", "v", "day") == [(1, "a", 1), (2, "B", 3), (4, "d", 3)]
    after = {(r["part_key"], r["file_path"]) for r in table.files().collect()}
    assert {p for p, _ in after} == {"1", "3"}
    assert [f for p, f in before if p == "1"] == [f for p, f in after if p == "1"]
    assert rows_of(table.read(snapshot_id=1), "id", "v") == [(1, "a"), (2, "b")]
    again = table.merge(spark.createDataFrame([(2, "B", 3), (4, "d", 3)], "id long, v string, day int"))
    assert again == 3 and rows_of(table.read(), "id", "v") == [(1, "a"), (2, "B"), (4, "d")]
    with pytest.raises(DuplicateKeys):
        table.merge(spark.createDataFrame([(2, "x", 3), (2, "y", 3)], "id long, v string, day int"))


def test_unpublished_files_stay_invisible(spark, root):
    table = SnapshotTable(spark, root, "id long, day int", "day", ("id",))
    rows = spark.createDataFrame([(1, 1)], "id long, day int")
    token, staged = table.stage(rows)
    assert staged.count() == 1 and table.read().count() == 0
    table.publish(token)
    assert table.read().count() == 1
    table.append(rows)
    assert table.read().count() == 2
    table.overwrite(rows.limit(0))
    assert table.read().count() == 0 and table.read(snapshot_id=2).count() == 2
    assert [r["is_current"] for r in table.history().orderBy("snapshot_id").collect()] == [False, False, True]


def test_table_filter_prunes_folders(spark, root):
    table = SnapshotTable(spark, root, "id long, day date", "day", ("id",))
    table.append(spark.sql("SELECT id, date_add(DATE'2024-01-01', cast(id % 5 AS int)) AS day FROM range(50)"))
    plan = table.read().filter("day = DATE'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "part_key" in filters


def brute_history(events):
    out = {}
    for user, ip, t, e in sorted(events, key=lambda r: (r[0], r[2], r[3])):
        runs = out.setdefault(user, [])
        if not runs or runs[-1][0] != ip:
            runs.append((ip, t))
    return sorted((u, ip, t, v + 1, v + 1 == len(runs)) for u, runs in out.items() for v, (ip, t) in enumerate(runs))


def test_history_of_a_hot_user(spark):
    pick = random.Random(3)
    events = [(pick.choice([1, 1, 1, 2, 3]), pick.choice(["x", "y"]), 1_700_000_000 + pick.randrange(800_000), f"e{i}") for i in range(600)]
    rows = spark.createDataFrame(events, "user_id long, client_ip string, t long, event_id string").withColumn("event_time", F.timestamp_seconds("t"))
    history = scd2.build_history(rows, "user_id", ["client_ip"], "event_time", "event_id")
    got = sorted((r["user_id"], r["client_ip"], int(r["s"]), r["version"], r["is_current"])
                 for r in history.withColumn("s", F.unix_seconds("valid_from")).collect())
    assert got == brute_history(events)
    assert all(r["success"] for r in scd2.integrity(history, "user_id").collect())
    asked = rows.select("event_id", "user_id", "event_time", "client_ip")
    found = scd2.as_of(asked, history.withColumnRenamed("client_ip", "ip"), "user_id", "event_time", "event_id", ["ip"])
    assert found.count() == 600
    seen = {}  # equal times: the last one of a moment decides
    for user, ip, t, e in sorted(events, key=lambda r: (r[2], r[3])):
        seen[(user, t)] = ip
    unique = found.groupBy("user_id", "event_time").agg(F.count("*").alias("n")).filter("n = 1").join(found, ["user_id", "event_time"])
    assert unique.filter(~F.col("ip").eqNullSafe(F.col("client_ip"))).count() == 0


def test_integrity_finds_faults(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-01", "2024-01-05", False, 1), (1, "2024-01-06", "9999-12-31", True, 2), (2, "2024-01-01", "9999-12-31", True, 1),
         (2, "2024-01-02", "9999-12-31", True, 2)],
        "user_id long, a string, b string, is_current boolean, version long",
    ).withColumns({"valid_from": F.col("a").cast("timestamp"), "valid_to": F.col("b").cast("timestamp")})
    bad = {r["rule"]: r["violations"] for r in scd2.integrity(rows, "user_id").collect()}
    assert bad["no_gap_or_overlap"] == 2 and bad["one_current_row"] == 1 and bad["versions_increase"] == 0


@pytest.mark.parametrize("bits", [0, 4, 20])
def test_percentiles_equal_builtin(spark, bits):
    pick = random.Random(5)
    data = [(pick.choice("aab"), int(pick.lognormvariate(8, 2))) for _ in range(997)] + [("c", 5), ("d", None)]
    rows = spark.createDataFrame(data, "g string, v long")
    got = {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in exact_percentiles(rows, ["g"], F.col("v"), [0.5, 0.95, 0.99], bits).collect()}
    want = {r["g"]: tuple(r["p"]) for r in rows.filter("v is not null").groupBy("g").agg(F.expr("percentile(v, array(0.5, 0.95, 0.99))").alias("p")).collect()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g])
    whole = exact_percentiles(rows, [], F.col("v"), [0.5], bits).first()["p50"]
    assert whole == pytest.approx(rows.agg(F.expr("percentile(v, 0.5)")).first()[0])


def test_global_position(spark):
    rows = spark.range(3000).select((F.col("id") * 7 % 3000).alias("k"), F.lit(1).alias("hot"))
    placed = ordered.global_position(rows, ["hot", "k"], "p")
    assert placed.filter(F.col("k") != F.col("p")).count() == 0 and placed.count() == 3000


def test_rolling_counts_cross_days(spark):
    pick = random.Random(7)
    times = sorted(pick.randrange(0, 400_000) for _ in range(300))
    rows = spark.createDataFrame([("hot", t) for t in times], "ip string, t long").withColumn("t", F.timestamp_seconds("t"))
    got = {r["second"]: r["rolling_requests"] for r in rolling_audit(rows, "ip", "t", 3600, 3).collect()}
    assert got == {t: sum(t - 3600 <= s <= t for s in times) for t in times}


def _plain_report(spark, rows):
    kinds = "event_time timestamp, event_type string, status string, user_id string, response_time_nanos long, range_min int, range_max int"
    return spark.createDataFrame(rows, kinds)


def test_reports_from_one_count(spark):
    draw = random.Random(5)
    rows = [
        (
            datetime(2024, 1, 1 + draw.randrange(3), 12) if draw.random() > 0.05 else None,
            draw.choice(["SINGLE", "RANGE"]),
            draw.choice(["SUCCESS", "SUCCESS", "ERROR"]),
            draw.choice([None, "a", "b", "c"]),
            None if draw.random() < 0.1 else draw.choice([5, 2**20 - 1, 2**20, draw.randrange(2**31)]),
            1,
            draw.choice([None, 1, 7, 3999]),
        )
        for _ in range(400)
    ]
    events = _plain_report(spark, rows)
    found = {str(r.date_key): r for r in metrics.daily_stats(events).collect()}
    for day in {r[0] and r[0].date() for r in rows}:
        mine = [r for r in rows if (r[0] and r[0].date()) == day]
        times = sorted(r[4] for r in mine if r[4] is not None)
        got = found[str(day)]
        assert got.total_conversions == len(mine) and got.unique_users == len({r[3] for r in mine} - {None})
        assert got.error_count == sum(r[2] != "SUCCESS" for r in mine)
        assert got.single_conversions == sum(r[1] == "SINGLE" for r in mine)
        assert got.avg_response_time_ms == pytest.approx(sum(times) / len(times) / 1e6)
        if day:
            assert got.p50_response_time_ms == pytest.approx(statistics.median(times) / 1e6)
    assert len(found) == 4
    report = metrics.latency_report(events, [1, 5], 100.0, 0.5).collect()
    times = [r[4] for r in rows if r[4] is not None]
    sizes = [r[6] for r in rows if r[6] is not None]
    assert len(report) == 1 and report[0].requests == len(rows)
    assert report[0].p50_ms == pytest.approx(statistics.median(times) / 1e6)
    assert report[0].range_size_p50 == statistics.median(sizes)
    assert report[0].within_5_ms == sum(t <= 5_000_000 for t in times)
    empty = metrics.latency_report(_plain_report(spark, []), [1], 100.0, 0.5).collect()
    assert len(empty) == 1 and empty[0].requests == 0 and empty[0].p95_ms is None and empty[0].error_rate is None
    assert metrics.daily_stats(_plain_report(spark, [])).collect() == []


@pytest.mark.parametrize("bits", [0, 2])
def test_ranks_across_many_ranges(spark, bits):
    rows = spark.range(0, 40_000, 7).select(F.col("id").alias("v"))
    got = exact_percentiles(rows, [], F.col("v"), [0.0, 0.333, 1.0], bits).first()
    want = rows.agg(F.expr("percentile(v, array(0.0, 0.333, 1.0))")).first()[0]
    assert list(got) == pytest.approx(want)


def test_quality_null_handling(spark):
    rows = spark.createDataFrame([("I",), ("x",), (None,), (None,)], "r string")
    rule = {"rule": "regex", "column": "r", "pattern": "^[MDCLXVI]+$"}
    strict = quality.validate(rows, "s", [rule]).first()
    assert (strict["element_count"], strict["unexpected_count"], strict["unexpected_percent"], strict["success"]) == (2, 1, 50.0, False)
    assert quality.validate(rows, "s", [{**rule, "mostly": 0.5}]).first()["success"]
    assert quality.validate(rows.limit(0), "s", [rule]).first()["success"]
    with pytest.raises(quality.ValidationFailed):
        quality.gate(quality.validate(rows, "s", [rule]))
    assert quality.gate(quality.validate(rows, "s", [rule]), report_only=True) is False
    kinds = [{"rule": "column_exists", "column": "zz"}, {"rule": "of_type", "column": "r", "type": "string"},
             {"rule": "columns_in_set", "columns": ["r"], "exact": True}, {"rule": "row_count", "min": 5}]
    assert [r["success"] for r in quality.validate(rows, "s", kinds).collect()] == [False, True, True, False]


def test_key_outcomes(spark):
    from hashlib import sha256

    digest = lambda k: sha256(k.encode()).hexdigest()
    layout = "key_hash string, key_prefix string, active boolean, revoked_at timestamp, expires_at timestamp"
    import datetime as dt

    past, future = datetime(2024, 1, 1), dt.datetime(2025, 1, 1)
    keys = spark.createDataFrame(
        [(digest("rns_ok"), "a", True, None, None), (digest("rns_later"), "b", True, None, future),
         (digest("rns_old"), "c", True, None, past), (digest("rns_gone"), "d", True, past, None), (digest("rns_off"), "e", False, None, None)],
        layout,
    )
    asked = [None, "", "  ", "abc", "rns_none", "rns_old", "rns_gone", "rns_off", " rns_ok ", "rns_later"]
    at = datetime(2024, 6, 1)
    requests = spark.createDataFrame([(i, k, at) for i, k in enumerate(asked)], "request_id long, presented_key string, requested_at timestamp")
    got = [r["outcome"] for r in validate_keys(requests, keys).orderBy("request_id").collect()]
    assert got == ["MISSING", "MISSING", "MISSING", "BAD_PREFIX", "UNKNOWN_KEY", "EXPIRED", "REVOKED", "INACTIVE", "VALID", "VALID"]


def test_log_lines(spark):
    path = "/var/lib/docker/containers/0123456789abcdef/0123456789abcdef-json.log"
    line = ('{"log":"{\\"timestamp\\":\\"2024-01-01 00:00:01.500\\",\\"level\\":\\"WARN\\",\\"correlationId\\":\\"c1\\",\\"logger\\":\\"x\\",'
            '\\"message\\":\\"method=GET path=/romannumeral?query=42 status=400 duration=3ms correlationId=c1\\"}","stream":"stdout"}')
    rows = spark.createDataFrame([(line, path), ("plain", "/tmp/other.log")], "value string, file_path string")
    got = parse_container_logs(rows).collect()
    assert (got[0]["container_id"], got[0]["level"], got[0]["status"], got[0]["duration_ms"], got[0]["path"]) == (
        "0123456789ab", "WARN", 400, 3, "/romannumeral?query=42")
    assert got[1]["message"] == "plain" and got[1]["level"] is None
    assert rows.select(container_id(F.col("file_path"))).collect()[1][0] is None


def test_hot_correlation_id_gives_one_row(spark):
    logs = spark.createDataFrame([("c", 1)] * 50 + [("l", 2)], "correlation_id string, duration_ms int")
    events = spark.createDataFrame([("c", 9)] * 40 + [("e", 3), (None, 1)], "correlation_id string, response_time_nanos long")
    got = {r["correlation_id"]: (r["log_lines"], r["events"], r["match_state"]) for r in match_logs_to_events(logs, events).collect()}
    assert got == {"c": (50, 40, "MATCHED"), "l": (1, 0, "LOG_ONLY"), "e": (0, 1, "EVENT_ONLY")}


def test_seeded_lineage(spark):
    """The three jobs of the platform and their datasets."""
    run = lambda job, ins, outs, state="COMPLETE": lineage.run_event(spark, job, f"r-{job}", ins, outs, state, None)
    facts, users = "silver.fact_conversions", "silver.dim_users"
    runs = (
        run("bronze-ingestion", ["topic"], ["bronze.raw_conversion_events"])
        .unionByName(run("silver-elt", ["bronze.raw_conversion_events"], [facts, users]))
        .unionByName(run("gold-elt", [facts, users], ["gold.user_metrics"]))
        .unionByName(run("broken", ["gold.user_metrics"], ["never"], "FAIL"))
    )
    graph = lineage.edges(runs)
    down = {r["node"]: r["hops"] for r in lineage.impact(graph, spark.createDataFrame([("topic",)], "node string")).collect()}
    assert down["gold.user_metrics"] == 6 and "never" not in down
    up = lineage.impact(graph, spark.createDataFrame([("gold.user_metrics",)], "node string"), downstream=False)
    assert {r["node"] for r in up.collect()} >= {"topic", facts, users}


def test_recorded_runs(spark, root):
    from datetime import datetime

    from oreflow.plans import layers

    table = layers.lineage(spark, root)
    for state in ("START", "COMPLETE"):
        lineage.record_run(table, "silver-elt", "r1", ["bronze"], ["fact", "users"], state, datetime(2024, 1, 1))
    assert table.read().count() == 2 and lineage.edges(table.read()).count() == 3
    with pytest.raises(ValueError):
        lineage.record_run(table, "silver-elt", "r1", [], [], "DONE", None)


def test_cycle_ends(spark):
    graph = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = {r["node"]: r["hops"] for r in lineage.impact(graph, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_minute_report_with_and_without_durations(spark):
    rows = [(datetime(2024, 1, 1), 200, d) for d in (1, 2, 3, 10, None)] + [(datetime(2024, 1, 1, 0, 1), 500, None)]
    report = metrics.requests_per_minute(spark.createDataFrame(rows, "logged_at timestamp, status int, duration_ms int"))
    got = {r["minute"].minute: (r["requests"], r["ok_2xx"], r["server_5xx"], r["p95_ms"]) for r in report.collect()}
    assert got[0][:3] == (5, 5, 0) and abs(got[0][3] - 8.95) < 1e-9
    assert got[1] == (1, 0, 1, None)


def test_only_hot_keys_are_cut_into_chunks(spark, monkeypatch):
    from oreflow.operators import ordered

    rows = spark.range(40).select(
        F.when(F.col("id") < 30, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"),
        F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"), (F.col("id") * 900).cast("timestamp").alias("t"),
    )
    results = {}
    for limit, names in ((1000, ["k", "n", "v", "t"]), (10, ["_hour", "k", "n", "v", "t"])):
        monkeypatch.setattr(ordered, "HOT_ROWS", limit)
        cut, chunk = ordered.cut_hot_keys(rows, ["k"], F.date_trunc("hour", "t"), "_hour")
        assert sorted(cut.columns) == sorted(names) and (chunk is None) == (limit == 1000)
        if chunk:  # one chunk for each small key, one per hour for the hot one
            assert cut.groupBy("k").agg(F.countDistinct("_hour").alias("h")).filter("h > 1").count() == 1
        last = ordered.carry_last(cut, ["k"], chunk, ["t"], "v", "before", include_current=False)
        placed = ordered.number_and_next(last, ["k"], chunk, ["t"], "n", "number", "following")
        results[limit] = sorted(map(str, placed.select("k", "n", "before", "number", "following").collect()))
        assert dict(placed.dtypes)["number"] == "bigint"
    assert results[1000] == results[10]


def test_histories_agree_whether_keys_are_cut_or_not(spark, folder, monkeypatch):
    from oreflow.catalog import QUERIES
    from oreflow.operators import ordered

    kept = [sorted(map(str, QUERIES["dim_users_scd2"](spark, folder).collect())), sorted(map(str, QUERIES["scd2_asof_join"](spark, folder).collect()))]
    monkeypatch.setattr(ordered, "HOT_ROWS", 5)
    cut = [sorted(map(str, QUERIES["dim_users_scd2"](spark, folder).collect())), sorted(map(str, QUERIES["scd2_asof_join"](spark, folder).collect()))]
    assert kept == cut


def test_beyond_the_limit_small_files_are_not_broadcast(spark, monkeypatch):
    from oreflow.operators import merge, sizing

    keys, rows = spark.range(50), spark.range(0, 100, 2)
    for join in (lambda: rows.join(sizing.sized_side(keys, 10), "id", "left_anti"), lambda: merge.new_rows(rows, keys, ["id"], 500_001)):
        joined = join()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and joined.count() == 25


def test_impact_needs_no_grouped_edges(spark):
    layout = "event_type string, job_name string, inputs array<string>, outputs array<string>"
    runs = spark.createDataFrame([("COMPLETE", "j", ["a"], ["b"]), ("COMPLETE", "j", ["a"], ["b"]), ("COMPLETE", "k", ["b"], ["c"])], layout)
    loose, grouped = lineage.edges(runs, repeats=True), lineage.edges(runs)
    assert "Aggregate" not in loose._jdf.queryExecution().executedPlan().toString() and (loose.count(), grouped.count()) == (6, 4)
    seeds = spark.createDataFrame([("a",)], "node string")
    reached = [sorted(map(tuple, lineage.impact(graph, seeds).collect())) for graph in (loose, grouped)]
    assert reached[0] == reached[1] == [("a", 0), ("b", 2), ("c", 4), ("job:j", 1), ("job:k", 3)]


def test_inputs_are_stored_as_they_are_made(spark, folder):
    from oreflow.catalog import inputs

    made = inputs.stored(spark, folder, "probe", lambda s, f: s.range(0, 90, 1, 3))
    assert made.count() == 90 and len(made.inputFiles()) == 3
