"""Golden values of numerals, ranges, pages, requests and buckets."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreflow.functions import requests as rq
from oreflow.functions.events import conversion_count, topic_key
from oreflow.functions.roman import range_reject_reason, roundness, size_bucket, to_roman
from oreflow.operators import paging, rate
from oreflow.operators.lookups import numeral_table

# Numbers with their numerals, and numbers without one.
NUMERALS = {
    1: "I", 4: "IV", 9: "IX", 40: "XL", 42: "XLII", 90: "XC", 99: "XCIX", 255: "CCLV", 400: "CD", 499: "CDXCIX",
    900: "CM", 1994: "MCMXCIV", 2023: "MMXXIII", 3888: "MMMDCCCLXXXVIII", 3999: "MMMCMXCIX",
}
REJECTED = [0, -1, -100, 4000, 5000, 2**31 - 1, -(2**31)]


def test_numerals(spark):
    rows = spark.createDataFrame([(n,) for n in [*NUMERALS, *REJECTED]], "n int").select("n", to_roman(F.col("n")).alias("r"))
    got = {r["n"]: r["r"] for r in rows.collect()}
    assert got == {**NUMERALS, **{n: None for n in REJECTED}}


def test_numeral_table_reads_back(spark):
    worth = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    rows = numeral_table(spark).collect()
    assert len(rows) == 3999
    for row in rows:
        digits = [worth[c] for c in row["numeral"]]
        total = sum(-d if d < after else d for d, after in zip(digits, [*digits[1:], 0]))
        assert total == row["number"]


@pytest.mark.parametrize(
    "low,high,reason",
    [(1, 2, None), (1, 3999, None), (None, 2, "MISSING_BOUND"), (0, 5, "MIN_OUT_OF_RANGE"), (5, 4000, "MAX_OUT_OF_RANGE"),
     (5, 5, "MIN_NOT_BELOW_MAX"), (9, 3, "MIN_NOT_BELOW_MAX")],
)
def test_range_rules(spark, low, high, reason):
    row = spark.createDataFrame([(low, high)], "a int, b int").select(range_reject_reason(F.col("a"), F.col("b")).alias("r"))
    assert row.first()["r"] == reason


def test_classes(spark):
    rows = spark.createDataFrame([(10,), (100,), (150,), (55,), (7,), (1001,)], "n int")
    got = [tuple(r) for r in rows.select(size_bucket(F.col("n")), roundness(F.col("n"))).collect()]
    assert got == [
        ("1-10 (Small)", "Multiple of 10"), ("11-100 (Medium)", "Multiple of 100"), ("101-1000 (Large)", "Multiple of 50"),
        ("11-100 (Medium)", "Multiple of 5"), ("1-10 (Small)", "Other"), ("1001-3999 (Very Large)", "Other"),
    ]


def test_wide_range_does_not_overflow(spark):
    row = spark.createDataFrame([("RANGE", -(2**31), 2**31 - 1)], "event_type string, range_min int, range_max int")
    assert row.select(conversion_count().alias("c")).first()["c"] == 2**32


def test_topic_keys(spark):
    rows = spark.createDataFrame(
        [("SINGLE", 42, None, None), ("RANGE", None, 1, 10), ("SINGLE", None, None, None)],
        "event_type string, input_number int, range_min int, range_max int",
    )
    assert [r[0] for r in rows.select(topic_key()).collect()] == ["SINGLE-42", "RANGE-1-10", "SINGLE-null-null"]


def test_pages():
    assert paging.page_bounds(1000) == (0, 100)
    assert paging.page_bounds(3999, 0, 500) == (0, 500)
    assert paging.page_bounds(3999, 10, 900) == (10, 500)
    assert paging.page_bounds(100, 100, 10) == (0, 10)
    assert paging.page_bounds(100, -5, 0) == (0, 1)
    assert not paging.needs_paging(100, None, None)
    assert paging.needs_paging(501, None, None)


def test_page_info(spark):
    info = paging.page_info(spark.range(1, 1001), ["id"]).orderBy("current_page").collect()
    assert len(info) == 10
    first, last = info[0], info[-1]
    assert (first["total_items"], first["total_pages"], first["has_next"], first["has_previous"]) == (1000, 10, True, False)
    assert (last["offset"], last["has_next"], last["first_key"], last["last_key"]) == (900, False, 901, 1000)


def test_pages_at_any_depth(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("wide"))
    for start in (0, 10, 4000, 4980):
        assert [r["k"] for r in paging.page_rows(rows, ["k"], start, 50).collect()] == list(range(start, min(start + 50, 5000)))
    assert paging.page_rows(rows.filter("k < 0"), ["k"], 0, 50).count() == 0


def test_pages_of_ordered_pairs_with_nulls(spark):
    pairs = [(a, b) for a in (None, 1, 2) for b in range(40)]
    rows = spark.createDataFrame(pairs, "a int, b int")
    found = [tuple(r) for start in range(0, 120, 30) for r in paging.page_rows(rows, ["a", "b"], start, 30).collect()]
    assert found == pairs


def test_request_fields(spark):
    rows = spark.createDataFrame(
        [("1.1.1.1, 2.2.2.2", "9.9.9.9", "abc", " rns_1 "), ("", "9.9.9.9", " ", "key_1"), (None, "9.9.9.9", None, "  ")],
        "xff string, addr string, cid string, key string",
    )
    got = rows.select(
        rq.client_ip(F.col("xff"), F.col("addr")), rq.correlation_id(F.col("cid"), F.lit("seed")), rq.clean_key(F.col("key")),
        rq.key_reject_reason(F.col("key")), F.length(rq.key_hash(F.col("key"))),
    ).collect()
    assert [r[0] for r in got] == ["1.1.1.1", "9.9.9.9", "9.9.9.9"]
    assert got[0][1] == "abc" and got[1][1] == got[2][1] and len(got[1][1]) == 8
    assert [r[2] for r in got] == ["rns_1", None, None]
    assert [r[3] for r in got] == [None, "BAD_PREFIX", "MISSING"]
    assert {r[4] for r in got} == {64}


def test_request_101_is_denied(spark):
    """100 per minute: of 101 requests at once the last is denied; other clients are not affected."""
    asked = [("a", 1_700_000_000) for _ in range(101)] + [("b", 1_700_000_005)]
    rows = spark.createDataFrame(asked, "ip string, t long").withColumn("t", F.timestamp_seconds("t"))
    out = rate.token_bucket(rows, "ip", "t", 100, 60).groupBy("client").agg(F.sum("denied").alias("d")).collect()
    assert {r["client"]: r["d"] for r in out} == {"a": 1, "b": 0}


def test_override_limit(spark):
    asked = [("a", 1_700_000_000)] * 5 + [("b", 1_700_000_000)] * 5
    rows = spark.createDataFrame(asked, "ip string, t long").withColumn("t", F.timestamp_seconds("t"))
    limits = spark.createDataFrame([("b", 3)], "client string, capacity long")
    out = rate.token_bucket(rows, "ip", "t", 10, 60, limits).collect()
    assert {r["client"]: r["allowed"] for r in out} == {"a": 5, "b": 3}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 6)), min_size=1, max_size=40), st.integers(1, 5), st.integers(1, 40))
def test_spend_keeps_its_bounds(steps, capacity, period):
    level, first = 0, True
    for elapsed, asked in steps:
        level, allowed = rate.spend(level, None if first else elapsed, asked, capacity, period)
        first = False
        assert 0 <= allowed <= min(asked, capacity)
        assert 0 <= level <= capacity * period


def test_pause_splits_a_client(spark):
    """Cutting at full-refill pauses gives the same as one uncut replay."""
    seconds = [0, 1, 2, 70, 71, 400, 401, 402, 461, 90_000, 90_001]
    rows = spark.createDataFrame([("a", s) for s in seconds for _ in range(2)], "ip string, t long").withColumn("t", F.timestamp_seconds("t"))
    got = [(r["second"], r["allowed"]) for r in rate.token_bucket(rows, "ip", "t", 3, 60).orderBy("second").collect()]
    level, last, want = 0, None, []
    for s in seconds:
        level, allowed = rate.spend(level, None if last is None else s - last, 2, 3, 60)
        last = s
        want.append((s, allowed))
    assert got == want


def test_pages_of_ties(spark, root):
    """A thousand equal order values lie over both borders of the page; pages neither overlap nor miss a row."""
    rows = spark.range(3000).select(
        (F.col("id") / 1000).cast("int").alias("k"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, "x").alias("w")
    )
    whole = sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or ""))
    assert sorted(map(tuple, paging.page_rows(rows, ["k"], 900, 500).collect()), key=str) == sorted(whole[900:1400], key=str)
    index = paging.PageIndex.build(rows, ["k"], root, 700)
    pages = [list(map(tuple, index.page(start, 500).collect())) for start in range(0, 3000, 500)]
    assert [sorted(p, key=str) for p in pages] == [sorted(whole[i : i + 500], key=str) for i in range(0, 3000, 500)]
    assert sorted(map(tuple, index.page(9999, 500).collect()), key=str) == sorted(whole[:500], key=str)
    plan = index.page(1500, 10)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(_position,1500)" in plan
    assert paging.PageIndex.build(rows.limit(0), ["k"], root + "-none").page(0, 10).count() == 0
