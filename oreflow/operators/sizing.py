"""Broadcasts behind a check of the real row count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.session import materialize_counted

BROADCAST_ROWS = 500_000


def sized_side(keys: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join side of a few narrow columns, computed once and counted.

    Up to ``max_rows`` rows it carries a broadcast hint; beyond that it asks
    for a shuffle, where adaptive execution splits skewed partitions.
    """
    kept, rows = materialize_counted(keys.sparkSession, keys)
    return hinted(kept, rows, max_rows)


def hinted(side: DataFrame, rows: int, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint when its counted rows allow it, else with one that forbids it.

    Left to itself Spark goes by the size of the files: ten million keys fit its limit when they compress well.
    """
    return F.broadcast(side) if rows <= max_rows else side.hint("merge")
