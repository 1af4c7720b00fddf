"""Pages of a keyed table and page metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oreflow.operators.ordered import global_position

# Page limits of the service.
DEFAULT_PAGE = 100
MAX_PAGE = 500


def page_bounds(total: int, offset: int | None = None, limit: int | None = None) -> tuple[int, int]:
    """Offset and limit after clamping; an offset past the end restarts at 0."""
    size = min(max(1, DEFAULT_PAGE if limit is None else limit), MAX_PAGE)
    start = max(0, offset or 0)
    return (0 if start >= total else start), size


def needs_paging(total: int, offset: int | None, limit: int | None) -> bool:
    """Paging applies when asked for, or when the result is too long."""
    return offset is not None or limit is not None or total > MAX_PAGE


def _total_order(df: DataFrame, order: list[str]) -> list[str]:
    """The order with all other columns behind it: rows that still tie are equal in every column."""
    return [*order, *[c for c in df.columns if c not in order]]


def page_rows(df: DataFrame, order: list[str], offset: int | None = None, limit: int | None = None) -> DataFrame:
    """One page of the table by position, for a single look; ``PageIndex`` serves many.

    Rows are ordered by ``order`` and then by their other columns. Positions give the first and the last row of
    the page and how many rows equal to each belong to it; the rows come from a scan between the two. So no task
    holds the rows before the page, however deep it is, and ties at its borders, a third of the table even, cost
    nothing: rows that tie are equal, and any of them will do.
    """
    start, size = page_bounds(df.count(), offset, limit)
    whole = _total_order(df, order)
    placed = global_position(df, whole, "_position")
    at = F.struct(*whole)
    page = placed.filter(F.col("_position").between(start, start + size - 1))
    edges = page.agg(F.min_by(at, "_position").alias("first"), F.max_by(at, "_position").alias("last"))
    found = page.crossJoin(F.broadcast(edges)).groupBy("first", "last").agg(
        F.count_if(at == F.col("first")).alias("heads"), F.count_if(at == F.col("last")).alias("tails")
    ).first()
    if found is None:
        return df.limit(0)
    bound = lambda row: F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in whole])
    first, last = bound(found["first"]), bound(found["last"])
    lead, low, high = F.col(order[0]), found["first"][order[0]], found["last"][order[0]]
    near = df if low is None else df.filter(lead.between(low, high))  # a plain range reaches the scan
    heads = near.filter(at == first).limit(found["heads"])
    if found["first"] == found["last"]:  # equal rows alone
        return heads
    inner = near.filter((at > first) & (at < last))
    return heads.unionByName(inner).unionByName(near.filter(at == last).limit(found["tails"])).orderBy(*whole)


@dataclass(frozen=True)
class PageIndex:
    """A copy of a table in a total order, cut into ranges of equal row counts that pages open by number.

    Row ``p`` of the order lies in the folder of range ``p // rows_per_range``, so a page opens one or two
    folders, and only the row groups there that hold its positions. The order is fixed when the index is
    built: pages never overlap and never miss a row, whatever ties.
    """

    spark: SparkSession
    path: str
    schema: StructType
    total: int
    rows_per_range: int

    @classmethod
    def build(cls, df: DataFrame, order: list[str], path: str, rows_per_range: int = 1_000_000) -> "PageIndex":
        seen = Observation()
        placed = global_position(df, _total_order(df, order), "_position")
        ranged = placed.withColumn("_range", F.floor(F.col("_position") / rows_per_range))
        ranged = ranged.repartition("_range").sortWithinPartitions("_range", "_position")
        ranged = ranged.observe(seen, F.count(F.lit(1)).alias("rows"))
        ranged.write.mode("overwrite").partitionBy("_range").parquet(path)
        return cls(df.sparkSession, path, ranged.schema, seen.get["rows"], rows_per_range)

    def page(self, offset: int | None = None, limit: int | None = None) -> DataFrame:
        """The rows of one page; an offset past the end restarts at 0."""
        start, size = page_bounds(self.total, offset, limit)
        stop = start + size
        opened = list(range(start // self.rows_per_range, (stop - 1) // self.rows_per_range + 1))
        rows = self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("_range").isin(opened))
        rows = rows.filter((F.col("_position") >= start) & (F.col("_position") < stop))
        return rows.orderBy("_position").drop("_range", "_position")


def page_info(df: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Metadata of every page of the table."""
    _, size = page_bounds(1, 0, limit)
    total = df.count()
    pages = -(-total // size)
    placed = global_position(df.select(*order), order, "_position")
    number = F.floor(F.col("_position") / size)
    return (
        placed.groupBy(number.alias("_page"))
        .agg(F.count("*").alias("items"), F.min(order[0]).alias("first_key"), F.max(order[0]).alias("last_key"))
        .select(
            (F.col("_page") * size).alias("offset"),
            F.lit(size).cast("long").alias("limit"),
            F.lit(total).cast("long").alias("total_items"),
            F.lit(pages).cast("long").alias("total_pages"),
            (F.col("_page") + 1).alias("current_page"),
            (F.col("_page") * size + size < total).alias("has_next"),
            (F.col("_page") > 0).alias("has_previous"),
            "items",
            "first_key",
            "last_key",
        )
    )
