"""Parsing of container and access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.schemas import APP_LOG, DOCKER_LOG

# Fixed value: where the container id sits in a log path.
CONTAINER_PATTERN = r"/var/lib/docker/containers/([a-f0-9]{12})[a-f0-9]*/.*\.log"
# Keys of an access line.
ACCESS_PATTERNS = {
    "method": r"method=(\S+)",
    "path": r"path=(\S+)",
    "status": r"status=(\d+)",
    "duration_ms": r"duration=(\d+)ms",
}


def container_id(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, CONTAINER_PATTERN, 1), F.lit(""))


def _field(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, ACCESS_PATTERNS[name], 1), F.lit(""))


def parse_container_logs(lines: DataFrame, value: str = "value", path: str = "file_path") -> DataFrame:
    """Envelope, application line and access fields of each log line.

    Lines that are not JSON keep their text in ``message`` and NULL labels.
    """
    outer = lines.withColumn("envelope", F.from_json(value, DOCKER_LOG))
    text = F.coalesce("envelope.log", value)
    inner = outer.withColumn("log", text).withColumn("app", F.from_json("log", APP_LOG))
    message = F.coalesce("app.message", "log")
    return inner.select(
        container_id(F.col(path)).alias("container_id"),
        F.col("envelope.stream").alias("stream"),
        F.try_to_timestamp(F.coalesce("app.timestamp", "envelope.time")).alias("logged_at"),
        F.col("app.level").alias("level"),
        F.coalesce("app.logger", "app.logger_name").alias("logger"),
        F.col("app.correlationId").alias("correlation_id"),
        message.alias("message"),
        _field(message, "method").alias("method"),
        _field(message, "path").alias("path"),
        _field(message, "status").cast("int").alias("status"),
        _field(message, "duration_ms").cast("int").alias("duration_ms"),
    )
