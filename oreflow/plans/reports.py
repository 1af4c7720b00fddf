"""Post-load checks and the ad-hoc analytics pack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.functions.roman import SINGLE_SYMBOL_PATTERN
from oreflow.operators import metrics
from oreflow.sources.tables import table_counts


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"))


def single_symbol_numerals(popular: DataFrame, limit: int = 10) -> DataFrame:
    """Most requested numerals made of one repeated symbol."""
    # Numerals always included.
    always = ["III", "XXX", "CCC", "MMM"]
    hit = F.col("output_roman").rlike(SINGLE_SYMBOL_PATTERN) | F.col("output_roman").isin(always)
    return popular.filter(hit).select("input_number", "output_roman", "request_count").orderBy(
        F.desc("request_count"), "input_number"
    ).limit(limit)


def preview(df: DataFrame, order: list, rows: int = 5) -> DataFrame:
    """The first rows under an order, small enough for a client."""
    return df.orderBy(*order).limit(rows)


def verification(tables: dict[str, DataFrame]) -> DataFrame:
    """Labelled row counts of the given tables."""
    return table_counts(tables)


def analytics_pack(popular: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    return {
        "number_range_distribution": metrics.number_range_distribution(popular),
        "longest_numerals": metrics.longest_numerals(popular),
        "round_number_preference": metrics.round_number_preference(popular),
        "single_symbol_numerals": single_symbol_numerals(popular),
        "user_activity_summary": metrics.user_activity_summary(users),
    }
