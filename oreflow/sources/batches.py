"""Output tables of streams: one folder per micro-batch.

A batch writes its own folder and nothing else (dynamic partition overwrite), so a batch that runs again after a
failure replaces what it wrote before. No manifest is kept: which folders a reader needs follows from batch numbers.

Layout: ``<path>/open/block=<batch_id // BLOCK>/batch_id=<n>`` and, once all batches of a block are done,
``<path>/closed/block=<b>`` with the same rows in few files. Where a block is closed its open folder is not read
any more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreflow.session import discard, exists, subfolders

BLOCK = 360
"""Batches of a block: an hour at the stream's trigger of ten seconds."""


@dataclass
class BatchTable:
    """A table at ``path`` that a stream writes batch by batch. ``order`` sorts the rows of closed blocks, so that
    readers who filter by it skip row groups."""

    spark: SparkSession
    path: str
    schema: T.StructType | str
    order: str | None = None
    block: int = BLOCK

    def __post_init__(self) -> None:
        if isinstance(self.schema, str):
            self.schema = T.StructType.fromDDL(self.schema)
        if self.block < 2:
            raise ValueError("a block has two batches at least")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of a batch, in place of what it wrote before."""
        own = [F.col(f.name).cast(f.dataType) for f in self.schema.fields if f.name != "batch_id"]
        number = F.lit(batch_id).cast("long").alias("batch_id")
        placed = rows.select(*own, F.lit(batch_id // self.block).cast("long").alias("block"), number)
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("block", "batch_id").parquet(f"{self.path}/open")

    def _numbers(self, kind: str) -> set[int]:
        return {int(name.split("=")[1]) for name in subfolders(self.spark, f"{self.path}/{kind}") if name.startswith("block=")}

    def _rows(self, folders: list[str], base: str) -> DataFrame:
        """Rows of some folders below ``base``; columns and order are those of the schema."""
        names = self.schema.fieldNames()
        full = T.StructType([*[f for f in self.schema.fields if f.name != "batch_id"], T.StructField("block", T.LongType()),
                             T.StructField("batch_id", T.LongType())])
        if not folders:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in full.fields]
            return self.spark.range(0).select(*none).filter(F.lit(False)).select(*names)
        return self.spark.read.schema(full).option("basePath", base).parquet(*folders).select(*names)

    def batch(self, batch_id: int) -> DataFrame:
        """The rows of one batch that is not closed yet: one folder is looked at."""
        folder = f"{self.path}/open/block={batch_id // self.block}/batch_id={batch_id}"
        return self._rows([folder] if exists(self.spark, folder) else [], f"{self.path}/open")

    def blocks(self, numbers: list[int]) -> DataFrame:
        """The rows of some blocks; no other folder is listed or opened."""
        closed = [b for b in numbers if exists(self.spark, f"{self.path}/closed/block={b}")]
        opened = [b for b in numbers if b not in closed and exists(self.spark, f"{self.path}/open/block={b}")]
        return self._read(opened, closed)

    def read(self) -> DataFrame:
        """All rows."""
        closed = self._numbers("closed")
        return self._read(sorted(self._numbers("open") - closed), sorted(closed))

    def _read(self, opened: list[int], closed: list[int]) -> DataFrame:
        parts = [self._rows([f"{self.path}/{kind}/block={b}" for b in numbers], f"{self.path}/{kind}")
                 for kind, numbers in (("open", opened), ("closed", closed)) if numbers]
        return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else self._rows([], "")

    def closes(self, batch_id: int) -> bool:
        """Whether a batch is the second of its block: then the first one is done, and nothing reads the last
        batches of the block before any more, not even a batch that runs again."""
        return batch_id > self.block and batch_id % self.block == 1

    def close(self, number: int) -> bool:
        """Rewrite a block, all of whose batches are done, into few files; False if there is nothing to do.

        The closed folder replaces one that an earlier attempt left, and appears as a whole with its commit. The
        open folder goes last.
        """
        opened = f"{self.path}/open/block={number}"
        if not exists(self.spark, opened):
            return False
        rows = self._rows([opened], f"{self.path}/open").withColumns(
            {"block": F.lit(number).cast("long"), "batch_id": F.col("batch_id") if "batch_id" in self.schema.fieldNames() else F.lit(None).cast("long")}
        )
        rows = rows.hint("rebalance")
        rows = rows.sortWithinPartitions(self.order) if self.order else rows
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("block").parquet(f"{self.path}/closed")
        discard(self.spark, opened)
        return True
