"""Database tables and log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, low, high, parts: int, properties: dict | None = None
) -> DataFrame:
    """A database table read by ``parts`` tasks over ranges of ``column``."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts,
                           properties=properties or {})


def list_jdbc_tables(spark: SparkSession, url: str, schema: str = "public", properties: dict | None = None) -> DataFrame:
    """Names of a database schema's tables."""
    query = f"(SELECT table_name FROM information_schema.tables WHERE table_schema = '{schema}') t"
    return spark.read.jdbc(url, query, properties=properties or {})


def list_catalog_tables(spark: SparkSession, database: str) -> DataFrame:
    """Tables of a catalog database with their row counts, in one job."""
    from oreflow.sources.tables import table_counts

    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    if not names:
        return spark.createDataFrame([], "table_name string, row_count long")
    return table_counts({f"{database}.{n}": spark.table(f"{database}.{n}") for n in names})


def read_log_lines(spark: SparkSession, glob: str) -> DataFrame:
    """Log lines with the path they come from."""
    return spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("file_path"))


def stream_log_lines(spark: SparkSession, glob: str) -> DataFrame:
    return spark.readStream.text(glob).select("value", F.col("_metadata.file_path").alias("file_path"))
