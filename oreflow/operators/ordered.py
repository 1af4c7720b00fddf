"""Ordered per-key computations that split a hot key over many tasks.

A plain window over a key puts all rows of the key into one task. Here each key
is cut into chunks (for instance days); windows run per (key, chunk), and what
crosses a chunk border comes from a summary with one row per (key, chunk),
whose size is the number of chunks and not the number of rows. Keys and chunks
must not be NULL: the join of the summary then reuses the windows' partitioning.
Only hot keys are worth it (:func:`cut_hot_keys`): where keys are many and small, nearly
every row is a chunk of its own, and the summary would be as large as the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreflow.session import materialize, materialize_counted

# Fixed value: a key with more rows is cut into chunks. There are at most rows / HOT_ROWS such keys.
HOT_ROWS = 500_000


def cut_hot_keys(df: DataFrame, keys: list[str], chunk: Column, name: str) -> tuple[DataFrame, str | None]:
    """The rows with ``chunk`` as column ``name`` for keys of many rows, and one chunk for any other key.

    Without such a key the rows come back as they are, and None for the name: windows then run per key alone.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot, found = materialize_counted(df.sparkSession, sizes.filter(F.col("_rows") > HOT_ROWS).select(*keys, F.lit(True).alias("_hot")))
    if not found:
        return df, None
    whole = F.lit(0).cast("timestamp")
    return df.join(F.broadcast(hot), keys, "left").withColumn(name, F.when(F.col("_hot"), chunk).otherwise(whole)).drop("_hot"), name


def carry_last(
    df: DataFrame, keys: list[str], chunk: str | None, order: list[str], value: str, name: str, include_current: bool
) -> DataFrame:
    """Latest non-NULL ``value`` up to (or strictly before) each row of its key."""
    cells = [*keys, chunk] if chunk else keys
    stop = Window.currentRow if include_current else -1
    local = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
    if not chunk:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(local))
    position = F.when(F.col(value).isNotNull(), F.struct(*order))
    summary = df.groupBy(*cells).agg(F.max_by(value, position).alias("_chunk_last"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*cells, F.last("_chunk_last", ignorenulls=True).over(earlier).alias("_carried"))
    marked = df.withColumn("_local", F.last(value, ignorenulls=True).over(local))
    return (
        marked.join(carried, cells, "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_local", "_carried")
    )


def number_and_next(
    df: DataFrame, keys: list[str], chunk: str | None, order: list[str], value: str, number: str, following: str
) -> DataFrame:
    """1-based position of each row in its key, and ``value`` of the next row.

    ``value`` must not be NULL; ``following`` is NULL on a key's last row.
    """
    cells = [*keys, chunk] if chunk else keys
    local = Window.partitionBy(*cells).orderBy(*order)
    if not chunk:
        return df.withColumns({number: F.row_number().over(local).cast("long"), following: F.lead(value).over(local)})
    summary = df.groupBy(*cells).agg(
        F.count("*").alias("_rows"), F.min_by(value, F.struct(*order)).alias("_chunk_first")
    )
    across = Window.partitionBy(*keys).orderBy(chunk)
    borders = summary.select(
        *cells,
        (F.sum("_rows").over(across) - F.col("_rows")).alias("_offset"),
        F.lead("_chunk_first").over(across).alias("_ahead"),
    )
    marked = df.withColumns({"_local": F.row_number().over(local), "_lead": F.lead(value).over(local)})
    return (
        marked.join(borders, cells, "left")
        .withColumns({number: F.col("_offset") + F.col("_local"), following: F.coalesce("_lead", "_ahead")})
        .drop("_local", "_lead", "_offset", "_ahead")
    )


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based position of each row in a total order over the whole table.

    The sort range-partitions the table; positions inside a partition come from
    the id Spark hands out, partition starts from one row per partition. The
    sorted rows are materialized so that both uses see the same partitions.
    """
    ids = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    ids = materialize(df.sparkSession, ids)
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    placed = ids.withColumns({"_part": part, "_within": within})
    sizes = placed.groupBy("_part").agg((F.max("_within") + 1).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: bounded by the shuffle partition count.
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_id", "_part", "_within", "_start")
    )
