"""Queries of published tables: merges, snapshots, time travel, upkeep."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from oreflow.catalog.base_sql import POPULAR, with_facts
from oreflow.catalog.inputs import bronze, facts, popular
from oreflow.catalog.registry import query
from oreflow.operators.quality import ValidationFailed, gate, validate
from oreflow.plans.reports import verification
from oreflow.session import work_path
from oreflow.sources import bindings
from oreflow.sources.tables import SnapshotTable

ORDERS = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string, o_year int"
NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
         "pages", "benchmark", "labels", "conversations"]


def _orders(spark, folder):
    return bindings.table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("o_year")
    )


ORDERS_SQL = """
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders),
split AS (SELECT CAST(median(o_year) AS INTEGER) AS y FROM o),
v1 AS (SELECT * FROM o WHERE o_year < (SELECT y FROM split)),
v2 AS (SELECT * FROM o),
v3 AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice) FROM v2),
v4 AS (SELECT * FROM v3 WHERE o_orderstatus <> 'P')
"""


def _day(n: int) -> datetime:
    return datetime(2024, 1, n, tzinfo=timezone.utc)


_TABLES: dict[tuple, SnapshotTable] = {}


def _published(spark, folder) -> SnapshotTable:
    """Orders in five publishes: older years, the rest, a merge that doubles
    the price of finished orders, a delete of pending ones, a compaction."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TABLES:
        rows = _orders(spark, folder)
        table = SnapshotTable(spark, work_path(spark, "orders"), ORDERS, "o_year", ("o_orderkey",))
        middle = rows.agg(F.median("o_year").cast("int")).first()[0]
        table.append(rows.filter(F.col("o_year") < middle), _day(1))
        table.insert_new(rows, _day(2))
        done = rows.filter(F.col("o_orderstatus") == "F")
        table.merge(done.withColumn("o_totalprice", F.col("o_totalprice") * 2), _day(3))
        table.delete_keys(rows.filter(F.col("o_orderstatus") == "P").select("o_orderkey"), _day(4))
        table.compact(_day(5))
        _TABLES[key] = table
    return _TABLES[key]


@query(
    "snapshot_history",
    ORDERS_SQL
    + """
SELECT CAST(1 AS BIGINT) AS snapshot_id, TIMESTAMP '2024-01-01' AS committed_at, 'append' AS operation, (SELECT count(*) FROM v1) AS total_records
UNION ALL SELECT 2, TIMESTAMP '2024-01-02', 'insert', (SELECT count(*) FROM v2)
UNION ALL SELECT 3, TIMESTAMP '2024-01-03', 'merge', (SELECT count(*) FROM v3)
UNION ALL SELECT 4, TIMESTAMP '2024-01-04', 'delete', (SELECT count(*) FROM v4)
UNION ALL SELECT 5, TIMESTAMP '2024-01-05', 'compact', (SELECT count(*) FROM v4)""",
)
def snapshot_history(spark, folder):
    return _published(spark, folder).snapshots()


@query(
    "table_history",
    """
SELECT CAST(i AS BIGINT) AS snapshot_id, TIMESTAMP '2024-01-01' + to_days(CAST(i - 1 AS INTEGER)) AS made_current_at,
  CASE WHEN i > 1 THEN CAST(i - 1 AS BIGINT) END AS parent_id, i = 5 AS is_current
FROM generate_series(1, 5) AS t(i) WHERE (SELECT count(*) FROM orders) > 0""",
)
def table_history(spark, folder):
    return _published(spark, folder).history()


@query("read_version_as_of", ORDERS_SQL + "SELECT * FROM v2")
def read_version_as_of(spark, folder):
    return _published(spark, folder).read(snapshot_id=2)


@query("read_timestamp_as_of", ORDERS_SQL + "SELECT * FROM v3")
def read_timestamp_as_of(spark, folder):
    return _published(spark, folder).read(as_of="2024-01-03 12:00:00")


@query("read_current", ORDERS_SQL + "SELECT * FROM v4")
def read_current(spark, folder):
    """After merge, delete and compaction."""
    return _published(spark, folder).read()


@query(
    "table_files",
    ORDERS_SQL + "SELECT CAST(o_year AS VARCHAR) AS part_key, count(*) AS record_count, true AS sized FROM v4 GROUP BY 1",
)
def table_files(spark, folder):
    """Live files, summed per partition."""
    files = _published(spark, folder).files()
    return files.groupBy("part_key").agg(
        F.sum("record_count").alias("record_count"), (F.min("file_size") > 0).alias("sized")
    )


@query("overwrite_partitions", ORDERS_SQL + "SELECT * FROM v2 WHERE o_year <> (SELECT max(o_year) FROM o) OR o_orderstatus = 'O'")
def overwrite_partitions(spark, folder):
    """The newest year is replaced by its open orders; other years stay."""
    rows = _orders(spark, folder)
    table = SnapshotTable(spark, work_path(spark, "orders"), ORDERS, "o_year", ("o_orderkey",))
    table.append(rows)
    newest = rows.filter(F.col("o_year") == rows.agg(F.max("o_year")).scalar())
    table.overwrite_partitions(newest.filter(F.col("o_orderstatus") == "O"))
    return table.read()


@query("staged_backfill", ORDERS_SQL + "SELECT * FROM v1")
def staged_backfill(spark, folder):
    """Two staged loads: one passes its rules, one fails and stays invisible."""
    rows = _orders(spark, folder)
    middle = rows.agg(F.median("o_year").cast("int")).first()[0]
    table = SnapshotTable(spark, work_path(spark, "orders"), ORDERS, "o_year", ("o_orderkey",))
    old, new = rows.filter(F.col("o_year") < middle), rows.filter(F.col("o_year") >= middle)
    rules = [{"rule": "unique", "column": "o_orderkey"}, {"rule": "not_null", "column": "o_custkey"}]
    for load in (old, new.withColumn("o_custkey", F.lit(None).cast("long"))):
        token, staged = table.stage(load)
        try:
            gate(validate(staged, "staged", rules))
            table.publish(token, replace=True)
        except ValidationFailed:
            continue
    return table.read()


@query(
    "schema_evolution_read",
    ORDERS_SQL
    + """
SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_year >= (SELECT y FROM split) THEN o_orderstatus END AS o_orderstatus, o_year
FROM o""",
)
def schema_evolution_read(spark, folder):
    """Files written before a column was added, read with those after."""
    rows, path = _orders(spark, folder), work_path(spark, "evolving")
    middle = rows.agg(F.median("o_year").cast("int")).first()[0]
    rows.filter(F.col("o_year") < middle).drop("o_orderstatus").write.mode("append").parquet(path)
    rows.filter(F.col("o_year") >= middle).write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", "true").parquet(path)


@query(
    "layer_counts",
    with_facts(
        """
SELECT 'bronze.raw_conversion_events' AS table_name, count(*) AS row_count FROM bronze UNION ALL
SELECT 'silver.fact_conversions', count(*) FROM fact UNION ALL
SELECT 'gold.popular_numbers', count(*) FROM popular""",
        POPULAR,
    ),
)
def layer_counts(spark, folder):
    return verification(
        {
            "bronze.raw_conversion_events": bronze(spark, folder),
            "silver.fact_conversions": facts(spark, folder),
            "gold.popular_numbers": popular(spark, folder),
        }
    )


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in NAMES))
def table_counts(spark, folder):
    return verification({name: bindings.table(spark, folder, name) for name in NAMES})
