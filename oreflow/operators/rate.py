"""Rate audits: rolling counts and token-bucket replay per client."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreflow.operators.ordered import carry_last
from oreflow.operators.sizing import sized_side
from oreflow.session import materialize

# Default limit of the service.
REQUESTS_PER_PERIOD = 100
PERIOD_SECONDS = 60

CHUNK_SECONDS = 86_400


def per_second(requests: DataFrame, client: str, time: str) -> DataFrame:
    """Requests per client and epoch second: at most 86,400 rows per client
    and day, however hot the client is."""
    second = F.unix_seconds(time).alias("second")
    return requests.filter(F.col(client).isNotNull() & F.col(time).isNotNull()).groupBy(
        F.col(client).alias("client"), second
    ).agg(F.count("*").alias("requests"))


def rolling_audit(
    requests: DataFrame, client: str, time: str, window_seconds: int = PERIOD_SECONDS, limit: int = REQUESTS_PER_PERIOD
) -> DataFrame:
    """Requests of the last ``window_seconds`` at every active second.

    Windows run per (client, day): the tail of a day that can matter to the
    next one is copied there, counted, and dropped from the result.
    """
    chunk_seconds = max(CHUNK_SECONDS, window_seconds)
    home = F.floor(F.col("second") / chunk_seconds)
    tail = F.col("second") >= (F.col("_home") + 1) * chunk_seconds - window_seconds
    counted = per_second(requests, client, time).withColumn("_home", home)
    spread = counted.withColumn(
        "_chunk", F.explode(F.when(tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    back = Window.partitionBy("client", "_chunk").orderBy("second").rangeBetween(-window_seconds, 0)
    return (
        spread.withColumn("rolling_requests", F.sum("requests").over(back))
        .filter(F.col("_chunk") == F.col("_home"))
        .select("client", "second", "requests", "rolling_requests", (F.col("rolling_requests") > limit).alias("over_limit"))
    )


def spend(level: int, elapsed: int | None, asked: int, capacity: int, period: int) -> tuple[int, int]:
    """Refill and spend one second's requests; returns (level, allowed).

    The level counts ``1/period`` tokens, so refilling ``capacity`` tokens per
    period adds ``capacity`` units per second and all numbers stay whole.
    """
    full = capacity * period
    level = full if elapsed is None else min(full, level + elapsed * capacity)
    allowed = min(asked, level // period)
    return level - allowed * period, allowed


REPLAY_SCHEMA = (
    "client string, second long, requests long, allowed long, denied long, remaining long, retry_after_seconds long"
)


def _replay(period: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level, last = None, 0, None
        for batch in batches:
            rows = []
            columns = (batch[c].tolist() for c in ("client", "stretch", "second", "requests", "capacity"))
            for client, stretch, second, asked, capacity in zip(*columns):
                if (client, stretch) != current:
                    current, last = (client, stretch), None
                level, allowed = spend(level, None if last is None else second - last, asked, capacity, period)
                last = second
                denied = asked - allowed
                wait = -(-(period - level) // capacity) if denied else 0
                rows.append((client, second, asked, allowed, denied, level // period, wait))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in REPLAY_SCHEMA.split(", ")])

    return run


def token_bucket(
    requests: DataFrame,
    client: str,
    time: str,
    capacity: int = REQUESTS_PER_PERIOD,
    period_seconds: int = PERIOD_SECONDS,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Replay of a bucket per client: allowed, denied, remaining, retry-after.

    A denied request spends nothing, so a client has to be replayed in order.
    Requests are first counted per second; a pause of a full period refills the
    bucket, so each client is cut there into independent stretches. Workers
    read sorted stretches batch by batch and keep one level, not the group.
    ``limits`` (client, capacity) overrides the default capacity.
    """
    counted = per_second(requests, client, time).withColumn("_day", F.floor(F.col("second") / CHUNK_SECONDS))
    counted = materialize(requests.sparkSession, counted)
    before = carry_last(counted, ["client"], "_day", ["second"], "second", "_before", include_current=False)
    pause = F.col("_before").isNull() | (F.col("second") - F.col("_before") >= period_seconds)
    starts = materialize(requests.sparkSession, before.withColumn("_start", F.when(pause, F.col("second"))).drop("_before"))
    cut = carry_last(starts, ["client"], "_day", ["second"], "_start", "stretch", include_current=True)
    rows = cut.select("client", "stretch", "second", "requests")
    if limits is None:
        rows = rows.withColumn("capacity", F.lit(capacity).cast("long"))
    else:
        own = sized_side(limits.select("client", F.col("capacity").alias("_own")))
        rows = rows.join(own, "client", "left").withColumn("capacity", F.coalesce("_own", F.lit(capacity)).cast("long")).drop("_own")
    ordered = rows.repartition("client", "stretch").sortWithinPartitions("client", "stretch", "second")
    return ordered.mapInPandas(_replay(period_seconds), REPLAY_SCHEMA)
