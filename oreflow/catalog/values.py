"""Queries over numerals, ranges, pages and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreflow.catalog.base_sql import roman, with_events
from oreflow.catalog.inputs import parsed
from oreflow.catalog.registry import query
from oreflow.functions.roman import audit_reason, to_roman
from oreflow.operators import lineage, lookups, paging, ranges
from oreflow.session import work_path
from oreflow.sources import bindings

LINE_NUMBER = "CAST((l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 4200 AS INTEGER)"
NUMBERS_SQL = f"""
WITH numbers AS (SELECT l_orderkey, l_partkey, l_linenumber, {LINE_NUMBER} AS number FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, number, CASE WHEN number BETWEEN 1 AND 3999 THEN {roman('number')} END AS numeral
FROM numbers"""


def _line_numbers(spark, folder):
    """A number per order line; a few are outside the numeral domain."""
    key = F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")
    return bindings.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", (key % 4200).cast("int").alias("number")
    )


@query("roman_encode", NUMBERS_SQL)
def roman_encode(spark, folder):
    return _line_numbers(spark, folder).withColumn("numeral", to_roman(F.col("number")))


@query("roman_lookup_join", NUMBERS_SQL)
def roman_lookup_join(spark, folder):
    lines = _line_numbers(spark, folder).withColumnRenamed("number", "n")
    return lookups.lookup_numerals(lines, "n").withColumnRenamed("n", "number")


@query(
    "roman_audit",
    with_events(
        f"""
SELECT event_date, reason, count(*) AS events FROM (
  SELECT CAST(event_time AS DATE) AS event_date, CASE
    WHEN output_roman IS NULL AND input_number IS NULL THEN NULL
    WHEN output_roman IS NULL THEN 'MISSING'
    WHEN NOT regexp_matches(output_roman, '^[MDCLXVI]+$') THEN 'BAD_ALPHABET'
    WHEN output_roman IS DISTINCT FROM {roman('input_number')} THEN 'MISMATCH' END AS reason
  FROM parsed) WHERE reason IS NOT NULL GROUP BY 1, 2"""
    ),
)
def roman_audit(spark, folder):
    reason = audit_reason(F.col("input_number"), F.col("output_roman"))
    marked = parsed(spark, folder).select(F.to_date("event_time").alias("event_date"), reason.alias("reason"))
    return marked.filter(F.col("reason").isNotNull()).groupBy("event_date", "reason").agg(F.count("*").alias("events"))


REQUESTS_SQL = """
WITH requests AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_number,
    CAST(CASE WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN NULL WHEN l_orderkey % 23 = 0 THEN 0
         ELSE l_partkey % 3900 + 1 END AS INTEGER) AS range_min,
    CAST(CASE WHEN l_orderkey % 31 = 0 THEN 4000 + l_linenumber
         ELSE l_partkey % 3900 + 1 + CASE WHEN l_orderkey % 29 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END END AS INTEGER) AS range_max
  FROM lineitem),
checked AS (
  SELECT *, CASE WHEN range_min IS NULL OR range_max IS NULL THEN 'MISSING_BOUND'
    WHEN range_min NOT BETWEEN 1 AND 3999 THEN 'MIN_OUT_OF_RANGE' WHEN range_max NOT BETWEEN 1 AND 3999 THEN 'MAX_OUT_OF_RANGE'
    WHEN range_min >= range_max THEN 'MIN_NOT_BELOW_MAX' END AS reject_reason FROM requests)
"""


@query("range_validate", REQUESTS_SQL + "SELECT * FROM checked")
def range_validate(spark, folder):
    return ranges.check_ranges(bindings.range_requests(spark, folder))


@query(
    "range_expand",
    REQUESTS_SQL
    + f"""
, numbers AS (SELECT order_key, line_number, unnest(generate_series(range_min, range_max)) AS x FROM checked WHERE reject_reason IS NULL)
SELECT CAST(x AS INTEGER) AS number, {roman('x')} AS numeral, count(*) AS requests FROM numbers GROUP BY 1, 2""",
)
def range_expand(spark, folder):
    """Every number of every valid range, counted per number."""
    return ranges.count_numbers(bindings.range_requests(spark, folder))


@query(
    "page_rows",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1200",
)
def page_rows(spark, folder):
    rows = bindings.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return paging.page_rows(rows, ["o_orderkey"], 1200, 700)


DEEP = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"
DEEP_SQL = f"SELECT {DEEP} FROM lineitem ORDER BY {DEEP} LIMIT 500 OFFSET (SELECT count(*) // 2 FROM lineitem)"


def _lines(spark, folder):
    return bindings.table(spark, folder, "lineitem").select(*DEEP.split(", "))


@query("page_rows_deep", DEEP_SQL)
def page_rows_deep(spark, folder):
    """The page in the middle of the table; the order alone leaves ties."""
    rows = _lines(spark, folder)
    return paging.page_rows(rows, ["l_orderkey", "l_linenumber"], rows.count() // 2, 500)


@query("page_index_rows", DEEP_SQL)
def page_index_rows(spark, folder):
    """The same page from a kept index."""
    index = paging.PageIndex.build(_lines(spark, folder), ["l_orderkey", "l_linenumber"], work_path(spark, "pages"), 10_000)
    return index.page(index.total // 2, 500)


@query(
    "page_info",
    """
WITH placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS t FROM orders)
SELECT CAST(p // 100 * 100 AS BIGINT) AS "offset", CAST(100 AS BIGINT) AS "limit", CAST(max(t) AS BIGINT) AS total_items,
  CAST(ceil(max(t) / 100.0) AS BIGINT) AS total_pages, CAST(p // 100 + 1 AS BIGINT) AS current_page,
  p // 100 * 100 + 100 < max(t) AS has_next, p // 100 > 0 AS has_previous, count(*) AS items,
  min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM placed GROUP BY p // 100""",
)
def page_info(spark, folder):
    return paging.page_info(bindings.table(spark, folder, "orders"), ["o_orderkey"])


LINEAGE_SQL = """
WITH RECURSIVE
sales AS (SELECT DISTINCT l_orderkey, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          WHERE o_orderstatus <> 'P'),
links AS (
  SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'job:supply:' || l_partkey AS dst FROM lineitem UNION
  SELECT 'job:supply:' || l_partkey, 'part:' || l_partkey FROM lineitem UNION
  SELECT 'part:' || l_partkey, 'job:order:' || l_orderkey FROM sales UNION
  SELECT 'job:order:' || l_orderkey, 'customer:' || o_custkey FROM sales),
reach AS ({seed} UNION SELECT {to_}, hops + 1 FROM reach JOIN links ON links.{from_} = reach.node)
SELECT node, min(hops) AS hops FROM reach GROUP BY 1"""


@query(
    "lineage_impact",
    LINEAGE_SQL.format(
        seed="SELECT 'supplier:' || s_suppkey AS node, 0 AS hops FROM supplier WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier)",
        to_="links.dst", from_="src",
    ),
)
def lineage_impact(spark, folder):
    """Everything downstream of the supplier with the highest balance."""
    suppliers = bindings.table(spark, folder, "supplier")
    best = suppliers.filter(F.col("s_acctbal") == suppliers.agg(F.max("s_acctbal")).scalar())
    seeds = best.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"))
    return lineage.impact(lineage.edges(bindings.lineage_runs(spark, folder), repeats=True), seeds)


@query(
    "lineage_sources",
    LINEAGE_SQL.format(
        seed="SELECT 'customer:' || c_custkey AS node, 0 AS hops FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)",
        to_="links.src", from_="dst",
    ),
)
def lineage_sources(spark, folder):
    """Everything upstream of the customer with the highest balance."""
    customers = bindings.table(spark, folder, "customer")
    best = customers.filter(F.col("c_acctbal") == customers.agg(F.max("c_acctbal")).scalar())
    seeds = best.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))
    return lineage.impact(lineage.edges(bindings.lineage_runs(spark, folder), repeats=True), seeds, downstream=False)


@query(
    "lineage_runs",
    """
WITH items AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
sales AS (SELECT DISTINCT l_orderkey, l_partkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'supply' AS job_kind, 'COMPLETE' AS event_type, count(*) AS runs FROM items
UNION ALL SELECT 'order', CASE WHEN o_orderstatus = 'P' THEN 'FAIL' ELSE 'COMPLETE' END, count(*) FROM sales GROUP BY 2""",
)
def lineage_runs(spark, folder):
    """Lineage records per kind of job and state."""
    runs = bindings.lineage_runs(spark, folder)
    return runs.groupBy(F.split("job_name", ":")[0].alias("job_kind"), "event_type").agg(F.count("*").alias("runs"))
