"""Topic logs: Kafka where its connector is present, else Parquet files with
the same five columns (key, value, partition, offset, timestamp)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.schemas import TOPIC


def _kafka(reader, servers: str, topic: str, group: str | None, **options):
    reader = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if group:
        reader = reader.option("kafka.group.id", group)
    return reader.options(**options).load().select(*TOPIC.fieldNames())


def starting_offsets(topic: str, marks: dict[int, int] | None) -> str:
    """Kafka start position after the ingested offsets; earliest without any."""
    if not marks:
        return "earliest"
    return json.dumps({topic: {str(p): offset + 1 for p, offset in sorted(marks.items())}})


def read_kafka(spark: SparkSession, servers: str, topic: str, group: str | None = None, marks=None) -> DataFrame:
    """Bounded read up to the latest offset; ``marks`` skips ingested offsets
    at the broker. It must name every partition of the topic, or none."""
    return _kafka(
        spark.read, servers, topic, group, startingOffsets=starting_offsets(topic, marks), endingOffsets="latest"
    )


def stream_kafka(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    options = {"startingOffsets": "earliest", "kafka.isolation.level": "read_committed"}
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return _kafka(spark.readStream, servers, topic, None, **options)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOPIC).parquet(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TOPIC)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


# Fixed value: a task reads whole row groups, so a log's are small enough for many tasks a file.
LOG_ROW_GROUP = 16 << 20


def append_log(records: DataFrame, path: str) -> None:
    """Append keyed records to a topic log."""
    writer = records.select(*TOPIC.fieldNames()).write.mode("append").option("parquet.block.size", LOG_ROW_GROUP)
    writer.parquet(path)


def after_marks(topic: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages above the ingested offset of their own partition.

    A single global maximum would lose rows of a partition that lags behind.
    ``marks`` has one row per topic partition. It is computed once, and its
    rows become plain bounds that skip old row groups of the log.
    """
    known = {row["kafka_partition"]: row["max_offset"] for row in marks.collect()}
    if not known:
        return topic
    fresh = ~F.col("partition").isin(*known)
    for partition, offset in sorted(known.items()):
        fresh = fresh | ((F.col("partition") == partition) & (F.col("offset") > offset))
    return topic.filter(fresh)


def after_global_mark(topic: DataFrame, mark: DataFrame) -> DataFrame:
    """Messages above the one global maximum offset."""
    return topic.filter(F.col("offset") > mark.select("max_offset").scalar())
