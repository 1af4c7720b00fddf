"""Range requests: validation and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.functions.roman import range_reject_reason, to_roman


def check_ranges(requests: DataFrame, low: str = "range_min", high: str = "range_max") -> DataFrame:
    """Requests with their reject reason, NULL where valid."""
    return requests.withColumn("reject_reason", range_reject_reason(F.col(low), F.col(high)))


def expand_ranges(requests: DataFrame, low: str = "range_min", high: str = "range_max") -> DataFrame:
    """One row per number of each valid range, with its numeral.

    A valid range has at most 3,999 numbers, which bounds the fan-out per row.
    """
    valid = check_ranges(requests, low, high).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rows = valid.withColumn("number", F.explode(F.sequence(F.col(low), F.col(high))))
    return rows.withColumn("numeral", to_roman(F.col("number")))


def count_numbers(requests: DataFrame, low: str = "range_min", high: str = "range_max") -> DataFrame:
    """How many valid ranges hold each number.

    Equal ranges are counted before they are expanded, and numerals are made for at most 3,999 numbers.
    """
    valid = check_ranges(requests, low, high).filter(F.col("reject_reason").isNull())
    ranges = valid.groupBy(low, high).agg(F.count("*").alias("_requests"))
    numbers = ranges.select(F.explode(F.sequence(F.col(low), F.col(high))).alias("number"), "_requests")
    return numbers.groupBy("number").agg(F.sum("_requests").alias("requests")).withColumn("numeral", to_roman(F.col("number")))
