"""Merges as joins: insert-only, upsert and duplicate checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.operators.sizing import BROADCAST_ROWS, sized_side
from oreflow.session import materialize_counted


class DuplicateKeys(ValueError):
    """The merge source holds a key more than once."""


def new_rows(source: DataFrame, target: DataFrame, key: list[str], rows: int | None = None) -> DataFrame:
    """Source rows whose key the target does not hold yet. ``rows`` is the size of a source that is stored already:
    its keys are read from it and not written again.

    An anti join cannot broadcast its left side. While the source is small, the
    target's key column is first cut down to the source's keys by a broadcast
    semi join, without a shuffle of the target. Beyond that it is one anti join.
    """
    wanted = source.select(*key)
    if rows is None:
        wanted, rows = materialize_counted(source.sparkSession, wanted)
    if rows > BROADCAST_ROWS:  # nor is the target's key column broadcast because its files are small
        return source.join(target.select(*key).hint("merge"), key, "left_anti")
    known = target.select(*key).join(F.broadcast(wanted), key, "left_semi")
    return source.join(known, key, "left_anti")


def require_unique(source: DataFrame, key: list[str]) -> None:
    """Refuse a source with repeated keys; one pre-aggregated count."""
    repeated = source.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    if not repeated.isEmpty():
        raise DuplicateKeys(f"duplicate merge keys on {key}")


def upsert(target: DataFrame, source: DataFrame, key: list[str], keys: DataFrame | None = None) -> DataFrame:
    """Target with matching rows replaced by, and others joined with, the source.

    The anti join's right side is the source's key list (``keys`` when it is
    there already), broadcast while it is small. Columns missing on one side
    are filled with NULL.
    """
    if keys is None:
        keys = sized_side(source.select(*key))
    return target.join(keys, key, "left_anti").unionByName(source, allowMissingColumns=True)
