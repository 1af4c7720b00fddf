"""Exact percentiles without holding a group's values in one task.

Integer values are split into a coarse cell (high bits) and a rest. A first
pass counts per cell and finds the cells that hold the wanted ranks; a second
pass reads only those cells and counts single values. Both passes are plain
pre-aggregated counts: the first keeps one row per cell, the second at most
``2**CELL_BITS`` values per wanted cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreflow.operators.sizing import sized_side

CELL_BITS = 20
RANGE_BITS = 8


def percentile_name(prob: float) -> str:
    return "p" + f"{prob * 100:g}".replace(".", "_")


def exact_percentiles(
    df: DataFrame,
    groups: list[str],
    value: Column,
    probs: list[float],
    cell_bits: int = CELL_BITS,
    per_cell: DataFrame | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles of an integer value per group.

    Returns the group columns and one double column per probability
    (``p50``, ``p95``, ...). Without groups the result is one row. With
    ``cell_bits=0`` every value is its own cell and one pass is enough: for
    values from a small domain, such as milliseconds. A caller that has counted
    already, together with other measures, gives ``per_cell``: the group columns,
    ``_cell`` (of ``cell_of``) and ``_n``, one row each.
    """
    keys = groups or ["_all"]
    data = df if groups else df.withColumn("_all", F.lit(1))
    data = data.select(*keys, value.cast("long").alias("_v")).filter(F.col("_v").isNotNull())
    data = data.withColumn("_cell", F.shiftright("_v", cell_bits))

    if per_cell is None:
        per_cell = data.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    else:
        per_cell = (per_cell if groups else per_cell.withColumn("_all", F.lit(1))).filter(F.col("_cell").isNotNull())
    ranked = _ranked(per_cell, keys)
    wanted = F.explode(F.array(*[F.lit(p) for p in probs]))
    spots = ranked.withColumn("_p", wanted).withColumn("_pos", F.col("_p") * (F.col("_total") - 1))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("_pos").alias("rank")),
                              F.struct(F.lit(1).alias("side"), F.ceil("_pos").alias("rank"))))
    spots = (
        spots.withColumn("_s", sides)
        .filter((F.col("_s.rank") >= F.col("_before")) & (F.col("_s.rank") < F.col("_before") + F.col("_n")))
        .select(
            *keys,
            "_cell",
            "_p",
            "_pos",
            F.col("_s.side").alias("_side"),
            (F.col("_s.rank") - F.col("_before")).alias("_local"),
        )
    )
    hits = spots.withColumn("_v", F.col("_cell")) if cell_bits == 0 else _values_at(data, spots, keys)
    share = F.col("_pos") - F.floor("_pos")
    low = F.max(F.when(F.col("_side") == 0, F.col("_v")))
    high = F.max(F.when(F.col("_side") == 1, F.col("_v")))
    points = hits.groupBy(*keys, "_p").agg((low + (high - low) * F.max(share)).cast("double").alias("_q"))
    wide = [F.max(F.when(F.col("_p") == p, F.col("_q"))).alias(percentile_name(p)) for p in probs]
    return points.groupBy(*keys).agg(*wide).drop("_all")


def cell_of(value: Column, cell_bits: int = CELL_BITS) -> Column:
    """The cell of an integer value."""
    return F.shiftright(value.cast("long"), cell_bits)


def _ranked(per_cell: DataFrame, keys: list[str]) -> DataFrame:
    """The cells with the number of values before each and in all.

    Cells are summed by ranges of ``2**RANGE_BITS`` first, so one task sees a row per range of a group, not
    a row per cell.
    """
    cells = per_cell.withColumn("_range", F.shiftright("_cell", RANGE_BITS))
    ranges = cells.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    by_range = Window.partitionBy(*keys).orderBy("_range")
    ranges = ranges.select(
        *keys,
        "_range",
        (F.sum("_sum").over(by_range) - F.col("_sum")).alias("_base"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_cell")
    counted = cells.withColumn("_inside", F.sum("_n").over(inside) - F.col("_n"))
    return counted.join(ranges, [*keys, "_range"]).withColumn("_before", F.col("_base") + F.col("_inside"))


def _values_at(data: DataFrame, spots: DataFrame, keys: list[str]) -> DataFrame:
    """Second pass: the value at each wanted place inside its cell."""
    spots = sized_side(spots)
    cells = [*keys, "_cell"]
    wanted = data.join(spots.select(*cells), cells, "left_semi")
    per_value = wanted.groupBy(*cells, "_v").agg(F.count("*").alias("_n"))
    by_value = Window.partitionBy(*cells).orderBy("_v")
    per_value = per_value.withColumn("_upto", F.sum("_n").over(by_value))
    inside = (F.col("_local") < F.col("_upto")) & (F.col("_local") >= F.col("_upto") - F.col("_n"))
    return per_value.join(spots, cells).filter(inside)
