"""Type-2 history: build, incremental merge, as-of lookup, integrity.

Steps run per key, and per (key, hour) cell for keys of many rows, see ``ordered``: a user with a third of
all events is spread over as many tasks as there are hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.operators.ordered import carry_last, cut_hot_keys, number_and_next
from oreflow.operators.sizing import sized_side
from oreflow.session import materialize

# Fixed value: end of validity of a current version.
OPEN_END = "9999-12-31 00:00:00"


def build_history(events: DataFrame, key: str, attributes: list[str], time: str, tie: str) -> DataFrame:
    """Versions of each key: one row per run of unchanged attributes.

    Columns: key, attributes, valid_from, valid_to, is_current, version. A run
    starts where the attributes differ from the previous event of the key
    (NULL-safe); it ends where the next one starts.
    """
    state = F.struct(*attributes)
    rows = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        key, state.alias("_state"), F.col(time).alias("valid_from"), F.col(tie).alias("_tie"),
    )
    order = ["valid_from", "_tie"]
    rows, chunk = cut_hot_keys(rows, [key], F.date_trunc("hour", "valid_from"), "_hour")
    seen = carry_last(rows, [key], chunk, order, "_state", "_previous", include_current=False)
    starts = seen.filter(~F.col("_state").eqNullSafe(F.col("_previous"))).drop("_previous")
    # Used twice below; only the change points are left here.
    starts = materialize(events.sparkSession, starts)
    closed = number_and_next(starts, [key], chunk, order, "valid_from", "version", "_next")
    return closed.select(
        key,
        *[F.col("_state")[a].alias(a) for a in attributes],
        "valid_from",
        F.coalesce("_next", F.lit(OPEN_END).cast("timestamp")).alias("valid_to"),
        F.col("_next").isNull().alias("is_current"),
        "version",
    )


def first_touched(changed: DataFrame, key: str, time: str) -> DataFrame:
    """(key, _since): the earliest time at which new events touch each key; computed and counted once."""
    known = changed.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    return sized_side(known.groupBy(key).agg(F.min(time).alias("_since")))


def splice_history(history: DataFrame, events: DataFrame, touched: DataFrame, key: str, attributes: list[str], time: str, tie: str) -> DataFrame:
    """History after new events: of each touched key only what lies behind its earliest touched time is rebuilt.

    ``touched`` is of :func:`first_touched`, ``events`` must hold all events of the touched keys from then on, and may
    hold more. Versions that began before stay; the last of them is where the rebuilt tail goes on: it enters as an
    event of its own start, so it is closed anew, split by a late event or left open, and its number is what the
    tail's numbers are shifted by. Events that are older and not new are not needed. An event whose own time
    moves must be in ``touched`` with its older time too.
    """
    mine = history.join(touched, key)
    head = mine.filter(F.col("valid_from") < F.col("_since"))
    last = head.groupBy(key).agg(F.max_by(F.struct(*attributes, "valid_from", "version"), "version").alias("_last"))
    last = materialize(history.sparkSession, last)
    seeds = last.select(
        key, *[F.col("_last")[a].alias(a) for a in attributes], F.col("_last.valid_from").alias(time),
        F.lit("").cast(events.schema[tie].dataType).alias(tie),
    )
    tail = events.join(touched, key).filter(F.col(time) >= F.col("_since")).select(key, *attributes, time, tie)
    rebuilt = build_history(seeds.unionByName(tail), key, attributes, time, tie)
    shifted = rebuilt.join(last.select(key, F.col("_last.version").alias("_offset")), key, "left")
    shifted = shifted.withColumn("version", F.col("version") + F.coalesce(F.col("_offset") - 1, F.lit(0))).drop("_offset")
    settled = head.join(last.select(key, F.col("_last.version").alias("version")), [key, "version"], "left_anti").drop("_since")
    others = history.join(touched, key, "left_anti")
    return others.unionByName(settled).unionByName(shifted)


def merge_history(history: DataFrame, events: DataFrame, changed: DataFrame, key: str, **build) -> DataFrame:
    """History after the events in ``changed``, which are among ``events``; see :func:`splice_history`."""
    return splice_history(history, events, first_touched(changed, key, build["time"]), key, **build)


def as_of(facts: DataFrame, history: DataFrame, key: str, time: str, tie: str, columns: list[str]) -> DataFrame:
    """Facts with the version valid at their time, NULL where none was.

    Versions and facts are merged into one time line per key and the latest
    version is carried forward: linear in the rows, where a range join would
    pair each fact with every version of its key.
    """
    version = F.struct("valid_from", "valid_to", *columns)
    slots = history.select(
        F.col(key), F.col("valid_from").alias("_t"), F.lit(0).alias("_kind"), F.lit("").alias("_tie"),
        version.alias("_version"), F.lit(None).cast(facts.select(F.struct("*")).schema[0].dataType).alias("_fact"),
    )
    rows = facts.select(
        F.col(key), F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.col(tie).cast("string").alias("_tie"),
        F.lit(None).cast(slots.schema["_version"].dataType).alias("_version"), F.struct("*").alias("_fact"),
    )
    line = slots.unionByName(rows)
    known, chunk = cut_hot_keys(
        line.filter(F.col(key).isNotNull() & F.col("_t").isNotNull()), [key], F.date_trunc("hour", "_t"), "_hour"
    )
    filled = carry_last(known, [key], chunk, ["_t", "_kind", "_tie"], "_version", "_valid", include_current=True)
    loose = line.filter(F.col(key).isNull() | F.col("_t").isNull()).withColumn("_valid", F.col("_version"))
    found = (filled.drop(chunk) if chunk else filled).unionByName(loose).filter(F.col("_kind") == 1)
    inside = F.col("_t") < F.col("_valid.valid_to")
    return found.select("_fact.*", *[F.when(inside, F.col("_valid")[c]).alias(c) for c in columns])


def integrity(history: DataFrame, key: str) -> DataFrame:
    """Rule violations of a history, one row per rule.

    Every check is an aggregate or a neighbour comparison keyed by
    (key, version): version n must end where version n+1 starts.
    """
    per_key = history.groupBy(key).agg(
        F.count_if("is_current").alias("_current"),
        F.count("*").alias("_rows"),
        F.min("version").alias("_low"),
        F.max("version").alias("_high"),
        F.countDistinct("version").alias("_versions"),
    )
    counted = per_key.agg(
        F.count_if(F.col("_current") != 1).alias("one_current_row"),
        F.count_if((F.col("_low") != 1) | (F.col("_high") != F.col("_rows")) | (F.col("_versions") != F.col("_rows")))
        .alias("versions_increase"),
    )
    rows = history.agg(
        F.count_if(F.col("valid_to") < F.col("valid_from")).alias("end_not_before_start"),
        F.count_if(F.col("is_current") != (F.col("valid_to") == F.lit(OPEN_END).cast("timestamp")))
        .alias("open_end_is_current"),
    )
    ends = history.select(key, (F.col("version") + 1).alias("_v"), F.col("valid_to").alias("_edge"), F.lit(1).alias("_end"))
    starts = history.select(key, F.col("version").alias("_v"), F.col("valid_from").alias("_edge"), F.lit(0).alias("_end"))
    borders = ends.unionByName(starts).groupBy(key, "_v").agg(
        F.max(F.when(F.col("_end") == 1, F.col("_edge"))).alias("_stop"),
        F.min(F.when(F.col("_end") == 0, F.col("_edge"))).alias("_start"),
    )
    gaps = borders.agg(F.count_if(F.col("_stop") != F.col("_start")).alias("no_gap_or_overlap"))
    result = None
    for frame in (counted, rows, gaps):
        for rule in frame.columns:
            row = frame.select(F.lit(rule).alias("rule"), F.col(rule).alias("violations"))
            result = row if result is None else result.unionByName(row)
    return result.withColumn("success", F.col("violations") == 0)
