"""Queries that read the topic agree with SQL for event ids of any size."""

import os

import pytest

from oreflow.catalog import QUERIES, SQL
from oreflow.session import work_path
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def shifted(spark, folder):
    """The tables with every second event id raised by three billion."""
    path = work_path(spark, "shifted")
    os.makedirs(path)
    for name in os.listdir(folder):
        if name != "events.parquet":
            os.symlink(f"{folder}/{name}", f"{path}/{name}")
    connect(folder).sql(
        "SELECT * REPLACE (event_id + CASE WHEN event_id % 2 = 0 THEN 3000000000 ELSE 0 END AS event_id) FROM events"
    ).write_parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["consumer_lag", "bronze_dedup", "stream_hourly"])
def test_large_event_ids(spark, shifted, name):
    assert compare(QUERIES[name](spark, shifted), connect(shifted), SQL[name]) == ""
