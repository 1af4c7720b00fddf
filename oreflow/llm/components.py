"""Connected components of a table of links, as alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.session import materialize_counted


def _hung(edges: DataFrame) -> DataFrame:
    """Each (u, v) with m, the smallest of u and all v of that u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hung(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as u > v."""
    hung = _hung(edges)
    moved = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(hung.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that occurs in ``links`` (a, b); component is the smallest id reachable.

    Large and small stars alternate until the edges are stars around the smallest ids. A step is
    a grouped minimum and a join on the same key, so no group is gathered; the number of steps grows
    with the logarithm of the longest path. Each step's edges are a table in the shared folder.
    Self links and repeated links are allowed; null ids are left out. No links give no rows.
    """
    spark = links.sparkSession
    edges = (
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges, rows = materialize_counted(spark, edges)
    before = None
    while rows:
        edges, rows = materialize_counted(spark, _small_star(_large_star(edges)))
        state = tuple(
            edges.agg(F.sum("v").cast("string"), F.bit_xor(F.xxhash64("u", "v")), F.count(F.lit(1))).first()
        )
        if state == before:
            break
        before = state
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def smallest_reached(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each place of ``ids`` reaches over the pairs of places (i, j) of one tile."""
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        if (label == before).all():
            return label
