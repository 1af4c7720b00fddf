"""Snapshot tables whose partition values need escaping in folder names."""

from pyspark.sql import types as T

from oreflow.sources.tables import SnapshotTable


def test_escaped_partition_values(spark, root):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("p", T.StringType())])
    table = SnapshotTable(spark, root, schema, "p", ("id",))
    values = ["2024-01-01 05:00:00", "a/b", "50%", "plain", "x=y", None]
    rows = spark.createDataFrame(list(enumerate(values)), schema)
    table.append(rows)
    table.append(rows.selectExpr("id + 10 AS id", "p"))
    found = sorted((r.id, r.p) for r in table.read().filter("p IS NOT NULL").collect())
    assert [p for _, p in found if p != "none"] == values[:5] * 2
