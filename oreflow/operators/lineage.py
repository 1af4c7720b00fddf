"""Lineage run events and reachability over them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.operators.sizing import hinted
from oreflow.schemas import LINEAGE_RUN
from oreflow.session import materialize, materialize_counted
from oreflow.sources.tables import SnapshotTable

# Run states.
RUN_STATES = ("START", "COMPLETE", "FAIL")


def run_event(spark: SparkSession, job: str, run_id: str, inputs: list[str], outputs: list[str], state: str, at) -> DataFrame:
    """One lineage record, ready to append to the lineage table."""
    if state not in RUN_STATES:
        raise ValueError(f"unknown run state {state}")
    return spark.createDataFrame([(at, state, run_id, job, inputs, outputs)], LINEAGE_RUN)


def record_run(table: SnapshotTable, job: str, run_id: str, inputs: list[str], outputs: list[str], state: str, at) -> int:
    """Append one lineage record to the lineage table."""
    return table.append(run_event(table.spark, job, run_id, inputs, outputs, state, at))


def datasets_of(df: DataFrame) -> list[str]:
    """Where a frame's rows are read from: roots of snapshot tables and folders of other files."""
    roots = {f.split("/data/part_key=")[0] if "/data/part_key=" in f else f.rsplit("/", 1)[0] for f in df.inputFiles()}
    return sorted({"/" + r[5:].lstrip("/") if r.startswith("file:") else r for r in roots})


@contextmanager
def recorded(log: SnapshotTable, job: str, inputs: list[DataFrame], outputs: list[SnapshotTable], clock=None) -> Iterator[str]:
    """Record a run of a job: START before, then COMPLETE, or FAIL if it raises. Inputs are what the frames read."""
    now = clock or (lambda: datetime.now(timezone.utc))
    run_id = uuid.uuid4().hex
    read = sorted({name for df in inputs for name in datasets_of(df)})
    written = [table.path for table in outputs]
    record_run(log, job, run_id, read, written, "START", now())
    try:
        yield run_id
    except BaseException:
        record_run(log, job, run_id, read, written, "FAIL", now())
        raise
    record_run(log, job, run_id, read, written, "COMPLETE", now())


def edges(runs: DataFrame, repeats: bool = False) -> DataFrame:
    """Edges dataset -> job and job -> dataset of completed runs.

    Going through the job keeps the edge count linear where pairing each input
    with each output would multiply them. With ``repeats`` an edge comes once per run and nothing is
    grouped: enough for :func:`impact`, whose levels are distinct anyway.
    """
    done = runs.filter(F.col("event_type") == "COMPLETE")
    job = F.concat(F.lit("job:"), "job_name")
    reads = done.select(F.explode("inputs").alias("src"), job.alias("dst"))
    writes = done.select(job.alias("src"), F.explode("outputs").alias("dst"))
    both = reads.unionByName(writes)
    return both if repeats else both.distinct()


def impact(graph: DataFrame, seeds: DataFrame, downstream: bool = True) -> DataFrame:
    """Everything reachable from the seeds with its smallest hop count.

    One join per hop between the new frontier and the edges; only the frontier
    is carried, each level is written out, and the loop ends when a level adds
    nothing. ``seeds`` has one column ``node``.
    """
    spark = graph.sparkSession
    src, dst = ("src", "dst") if downstream else ("dst", "src")
    links = materialize(spark, graph.select(F.col(src).alias("node"), F.col(dst).alias("_to")))
    frontier, size = materialize_counted(spark, seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    levels = [frontier]
    while size:
        step = links.join(hinted(frontier.select("node"), size), "node", "left_semi")
        found = step.select(F.col("_to").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, levels).select("node")
        fresh = found.join(seen, "node", "left_anti").withColumn("hops", F.lit(len(levels)))
        frontier, size = materialize_counted(spark, fresh)
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)
