"""Per-request rules of the conversion service as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key prefix and API route.
KEY_PREFIX = "rns_"
API_ROUTE = "/romannumeral"
# Paths of health and metrics traffic.
INTERNAL_PATHS = ("/actuator/health", "/actuator/prometheus")


def key_hash(key: Column) -> Column:
    """SHA-256 of a key as 64 hex digits."""
    return F.sha2(key, 256)


def clean_key(key: Column) -> Column:
    """Trimmed key, NULL when blank or without the key prefix."""
    text = F.trim(key)
    return F.when((text != "") & text.startswith(KEY_PREFIX), text)


def key_reject_reason(key: Column) -> Column:
    """Why a presented key is refused before any lookup."""
    text = F.trim(key)
    return F.when(text.isNull() | (text == ""), "MISSING").when(~text.startswith(KEY_PREFIX), "BAD_PREFIX")


def client_ip(forwarded_for: Column, remote_addr: Column) -> Column:
    """First hop of the forwarding header, else the peer address."""
    first = F.trim(F.split(forwarded_for, ",")[0])
    return F.coalesce(F.nullif(first, F.lit("")), remote_addr)


def correlation_id(header: Column, seed: Column) -> Column:
    """Given id, else a short id derived from the seed (stable on retries)."""
    return F.coalesce(F.nullif(F.trim(header), F.lit("")), F.left(F.sha2(seed, 256), F.lit(8)))


def is_api_path(path: Column) -> Column:
    return path.startswith(API_ROUTE)


def is_internal_path(path: Column) -> Column:
    test = F.lit(False)
    for part in INTERNAL_PATHS:
        test = test | path.contains(part)
    return test
