"""Exact top-k by inner product, with bounds from segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreflow.llm.vectors import blocks, usable
from oreflow.session import materialize

LEVELS = (4, 16)
QUERY_ROWS = 1024
CANDIDATE_ROWS = 8192
RUN_ROWS = 1024
RUN_BLOCKS = 16
K = 20
SCALE = 64


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment the mean and the deviation, weighted so that the product of two rows bounds their inner product.

    In a segment of n components, the sum of products is n times the product of means plus the product of
    what deviates from them; by Cauchy-Schwarz the latter is at most n times the product of deviations.
    """
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    out = []
    for part in parts:
        root = np.sqrt(len(part))
        piece = x[:, part]
        mean = piece.mean(axis=1)
        rest = piece - mean[:, None]
        out += [mean * root, np.sqrt((rest * rest).sum(axis=1))]
    return np.array(out).T


NONE = tuple(np.empty(0, dtype=np.int64) for _ in range(3))


def best_of(one: np.ndarray, two: np.ndarray, two_ids: np.ndarray, k: int, found: tuple = NONE) -> tuple:
    """(query place, id, score) of the k best candidates of every query, found coarse to fine.

    ``found`` is the result over earlier candidates; its scores are limits from the start.
    Candidates come in runs. A bound below the query's k-th score so far drops a candidate; the finer
    statistics are computed for pairs the coarser leave open, and survivors get their exact score. Equal
    scores go to the smaller id.
    """
    n = len(one)
    limit = np.full(n, -np.inf)

    def ranked(rows: tuple) -> tuple:
        best = np.lexsort((rows[1], -rows[2], rows[0]))
        rows = [r[best] for r in rows]
        rank = np.arange(len(best)) - np.searchsorted(rows[0], np.arange(n))[rows[0]]
        last = rank == k - 1
        limit[rows[0][last]] = rows[2][last]
        return tuple(r[rank < k] for r in rows)

    found = ranked(found)
    largest = max(np.abs(one).max(initial=0), np.abs(two).max(initial=0))
    exact_floats = largest * largest * one.shape[1] < 2**53
    whole = (one, two) if exact_floats else (one.astype(np.int64), two.astype(np.int64))
    sums = [segment_statistics(one, s) for s in LEVELS]
    order = np.argsort(-np.sqrt((two * two).sum(axis=1)), kind="stable")
    for at in range(0, len(two), RUN_ROWS):
        run = order[at : at + RUN_ROWS]
        stats = [segment_statistics(two[run], s) for s in LEVELS]
        slack = 1e-9 * np.sqrt((one * one).sum(axis=1).max(initial=0) * (two[run] ** 2).sum(axis=1).max(initial=0)) + 1e-6
        q, c = np.nonzero(sums[0] @ stats[0].T + slack >= limit[:, None])
        if len(q) > 0.3 * n * len(run):
            score = (whole[0] @ whole[1][run].T)[q, c]
        else:
            parts = [np.empty(0, dtype=whole[0].dtype)]
            kept = [np.empty((2, 0), dtype=np.int64)]
            for k0 in range(0, len(q), 65536):
                a, b = q[k0 : k0 + 65536], c[k0 : k0 + 65536]
                near = np.einsum("ij,ij->i", sums[1][a], stats[1][b]) + slack >= limit[a]
                a, b = a[near], b[near]
                parts.append(np.einsum("ij,ij->i", whole[0][a], whole[1][run[b]]))
                kept.append(np.array([a, b]))
            (q, c), score = np.concatenate(kept, axis=1), np.concatenate(parts)
        score = score.astype(np.int64)
        near = score >= limit[q]
        found = ranked(tuple(np.concatenate(pair) for pair in zip(found, (q[near], two_ids[run[c]][near], score[near]))))
    return found


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, scale: int = SCALE, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``rows`` with the largest inner product for each row of ``queries``.

    Both have (vec_id, embedding), and the queries are among the rows. Components become floor(scale * x), scores are whole
    numbers. A block of queries meets every block of candidates, ``RUN_BLOCKS`` of them in one task, which carries the
    scores on from block to block and reports k + 1 rows per query at most; a ranked window merges the tasks' rows. A query's own row is no candidate for it: one that has
    its vec_id and scores as it does with itself; where several do, they differ in no result and one of them goes.

    Ties go to the smaller vec_id. Fewer than k candidates: all of them. Null, empty and non-finite vectors and null
    ids take no part; vectors of another length are no candidates. Rows that repeat an id or a whole row are candidates and
    queries of their own, so an id that occurs twice among the queries is answered twice. Extra columns are ignored.
    Empty tables give no rows.
    """
    spark = rows.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
        df = df.filter(usable("vector") & F.col("vec_id").isNotNull())
        return df.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector"), F.size("vector").alias("dim"))

    nothing = np.empty((0, 0))
    asked = blocks(whole(queries), nothing, query_rows).select(
        F.col("block").alias("query_block"), "dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")
    )
    held = blocks(whole(rows), nothing, candidate_rows).select("block", "dim", "ids", "vectors")
    count = asked.agg(F.coalesce(F.max("query_block"), F.lit(-1)).alias("n")).first().n
    runs = held.agg(F.coalesce(F.max("block"), F.lit(0)).alias("n")).first().n // RUN_BLOCKS + 1
    if count < 0:
        pairs = held.limit(0).withColumn("query_block", F.lit(0).cast("int"))
    else:
        pairs = held.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(count))))
    met = pairs.join(asked, ["query_block", "dim"]).withColumn("run", F.floor(F.col("block") / RUN_BLOCKS))
    met = met.repartition(max(1, min(10_000, (count + 1) * runs)), "query_block", "run").sortWithinPartitions("query_block", "run")

    def run(batches):
        key, asking, found = None, None, NONE

        def out():
            number, ids, one = asking
            q, other, score = found
            own = (one.astype(np.int64) ** 2).sum(axis=1)
            columns = [ids[q], number * query_rows + q, own[q], other, score]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "place", "own", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                one, two = (np.frombuffer(row[c], dtype="<f8").reshape(-1, row["dim"]) for c in ("query_vectors", "vectors"))
                if key is not None and key != (row["query_block"], row["run"]):
                    yield out()
                    found = NONE
                key = (row["query_block"], row["run"])
                asking = (row["query_block"], np.frombuffer(row["query_ids"], dtype="<i8"), one)
                found = best_of(one, two, np.frombuffer(row["ids"], dtype="<i8"), k + 1, found)
        if key is not None:
            yield out()

    found = materialize(spark, met.mapInArrow(run, "query_id long, place long, own long, vec_id long, score long"))
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= k + 1)
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    best = best.withColumn("mine", mine).withColumn("met", F.count_if("mine").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = best.filter(~(F.col("mine") & (F.col("met") == 1))).withColumn("rank", F.col("row") - F.least("met", F.lit(1)).cast("int"))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
