"""Every query of the library under a name, over the given tables."""

from oreflow.catalog import bronze, gold, keys, logs, quality, silver, streams, tables, values  # noqa: F401
from oreflow.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
