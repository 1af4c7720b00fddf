"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job relies on (UTC above all)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str, cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A one-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is used, but only on a
    local master: on a cluster a machine-local folder would lose data.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = context.getCheckpointDir() or tempfile.mkdtemp(prefix="oreflow-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "oreflow", f"{name}-{uuid.uuid4().hex[:12]}")


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a folder; none if it is missing."""
    store, place = _store(spark, path)
    return [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that this job has written."""
    store, place = _store(spark, path)
    store.delete(place, True)


_SCOPES = threading.local()


@contextmanager
def steps_removed(spark: SparkSession) -> Iterator[None]:
    """Steps that are materialized inside are removed at the end, failed or not: what a micro-batch
    leaves in the shared folder must not grow with the number of batches."""
    outer = getattr(_SCOPES, "paths", None)
    _SCOPES.paths = []
    try:
        yield
    finally:
        for path in _SCOPES.paths:
            discard(spark, path)
        _SCOPES.paths = outer


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside are removed as each job ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Buckets:
    """A table in the shared folder with one bucket for each value of a column from 0 on, so that grouping it by that
    column needs no shuffle. Rows can be added until ``close``, which takes its name out of the catalog; ``drop`` removes it all."""

    def __init__(self, spark: SparkSession, column: str, count: int):
        self.spark, self.column, self.count = spark, column, count
        self.path = work_path(spark, "buckets")
        self.name = f"oreflow_{uuid.uuid4().hex}"
        self.whole: DataFrame | None = None

    def add(self, df: DataFrame) -> None:
        write = df.write.mode("append").format("parquet").bucketBy(self.count, self.column)
        write.option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name) if self.whole is None else self.whole

    def close(self) -> None:
        self.whole = self.spark.table(self.name)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)


def materialize_counted(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, int]:
    """Compute once into a Parquet table in the shared folder; returns the
    table and its row count, taken while writing.

    This cuts the lineage like a checkpoint, but stays columnar: later steps
    read only their columns, and Spark knows the real size when it joins.
    """
    path = work_path(spark, "step")
    if getattr(_SCOPES, "paths", None) is not None:
        _SCOPES.paths.append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


def materialize_at(spark: SparkSession, df: DataFrame, *by: str) -> tuple[str, DataFrame]:
    """A step that the caller discards, with its path; with a folder for each value of the columns ``by``, the last ones."""
    path = work_path(spark, "step")
    df.write.partitionBy(*by).parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    return materialize_counted(spark, df)[0]
