"""Rule suites of the layers.

Fixed values: rule kinds, value sets, patterns and thresholds.
"""

from __future__ import annotations

from oreflow.functions.roman import MAX_NUMBER, MIN_NUMBER, NUMERAL_PATTERN
from oreflow.schemas import BRONZE_COLUMNS

UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
IP_PATTERN = (
    "^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
    "|^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"
)
EVENT_TYPES = ["SINGLE", "RANGE"]
STATUSES = ["SUCCESS", "ERROR", "UNKNOWN"]

BRONZE = [
    {"rule": "row_count", "min": 0},
    {"rule": "columns_in_set", "columns": [*BRONZE_COLUMNS, "is_late_arrival"], "exact": False},
    {"rule": "not_null", "column": "event_id"},
    {"rule": "not_null", "column": "event_time"},
    {"rule": "not_null", "column": "ingested_at"},
    {"rule": "in_set", "column": "event_type", "values": EVENT_TYPES},
    {"rule": "regex", "column": "event_id", "pattern": UUID_PATTERN},
    {"rule": "regex", "column": "client_ip", "pattern": IP_PATTERN, "mostly": 0.95},
    {"rule": "of_type", "column": "is_late_arrival", "type": "boolean"},
]

FACT = [
    {"rule": "row_count", "min": 1},
    {"rule": "column_exists", "column": "event_id"},
    {"rule": "column_exists", "column": "event_time"},
    {"rule": "column_exists", "column": "event_type"},
    {"rule": "column_exists", "column": "status"},
    {"rule": "not_null", "column": "event_id"},
    {"rule": "unique", "column": "event_id"},
    {"rule": "not_null", "column": "event_time"},
    {"rule": "not_null", "column": "event_type"},
    {"rule": "in_set", "column": "event_type", "values": EVENT_TYPES},
    {"rule": "in_set", "column": "status", "values": STATUSES},
    {"rule": "between", "column": "input_number", "min": MIN_NUMBER, "max": MAX_NUMBER, "mostly": 0.99},
    {"rule": "regex", "column": "output_roman", "pattern": NUMERAL_PATTERN, "mostly": 0.95},
    {"rule": "between", "column": "conversion_count", "min": MIN_NUMBER, "max": MAX_NUMBER},
    {"rule": "of_type", "column": "conversion_count", "type": "bigint"},
]

DIM_USERS = [
    {"rule": "row_count", "min": 0},
    {"rule": "column_exists", "column": "user_id"},
    {"rule": "column_exists", "column": "valid_from"},
    {"rule": "column_exists", "column": "valid_to"},
    {"rule": "column_exists", "column": "is_current"},
    {"rule": "column_exists", "column": "version"},
    {"rule": "not_null", "column": "user_id"},
    {"rule": "not_null", "column": "valid_from"},
    {"rule": "not_null", "column": "valid_to"},
    {"rule": "not_null", "column": "is_current"},
    {"rule": "of_type", "column": "is_current", "type": "boolean"},
    {"rule": "between", "column": "version", "min": 1},
    {"rule": "pair_greater", "a": "valid_to", "b": "valid_from", "or_equal": True},
    {"rule": "compound_unique", "columns": ["user_id", "version"]},
]

DAILY = [
    {"rule": "row_count", "min": 1},
    {"rule": "not_null", "column": "event_date"},
    {"rule": "unique", "column": "event_date"},
    {"rule": "between", "column": "total_conversions", "min": 1},
    {"rule": "pair_greater", "a": "max_number_converted", "b": "min_number_converted", "or_equal": True},
]
