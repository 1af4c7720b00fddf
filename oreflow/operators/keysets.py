"""Bitmaps of hashed keys: which partitions of a table may hold some of a batch's keys.

A key's hash is one position in a space of ``bits`` positions; positions are kept as Spark's bitmaps, one row per
stretch of 32,768 of them that is used at all. Bitmaps are built with partial aggregation and merge by union, so each
publish adds only its own. They answer "surely not" or "perhaps": by chance, a batch of m keys meets a partition of n
with probability 1 - (1 - n / bits) ** m, and then the join that follows just finds nothing there. With 256 positions a
key a partition costs one to two bytes a key, and is passed over by batches of up to some hundred keys; larger batches
usually bring keys of few partitions, and those bitmaps are read in place of the keys themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.operators.sizing import sized_side

PER_KEY = 256
WANTED_ROWS = 10_000
"""A bitmap has 4 KB, so at most 40 MB are broadcast."""

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 44


def bits_for(keys: int) -> int:
    """Positions for groups of about this many keys: a power of two, so that spaces of several sizes go together."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, PER_KEY * keys) - 1).bit_length()))


def key_position(key: list[str], bits: int) -> Column:
    """Position of a key; equal keys of any type have one, NULL parts included."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key]
    return F.pmod(F.xxhash64(*text), F.lit(bits))


def key_bitmaps(rows: DataFrame, key: list[str], by: list[str], bits: int) -> DataFrame:
    """(by, bits, stretch, bitmap): the positions of all keys of each group."""
    placed = rows.select(*by, key_position(key, bits).alias("_at"))
    return placed.groupBy(*by, F.lit(bits).cast("long").alias("bits"), F.bitmap_bucket_number("_at").alias("stretch")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bitmap")
    )


def groups_met(bitmaps: DataFrame, batch: DataFrame, by: list[str]) -> DataFrame:
    """The groups that share a position with the batch's bitmaps (bits, stretch, bitmap).

    Only stretches that both sides use are compared. The batch's side is broadcast while it is small.
    """
    wanted = sized_side(batch.select("bits", "stretch", F.col("bitmap").alias("_wanted")), WANTED_ROWS)
    both = bitmaps.join(wanted, ["bits", "stretch"])
    pairs = both.select(*by, "bits", "stretch", F.explode(F.array("bitmap", "_wanted")).alias("_bitmap"))
    shared = pairs.groupBy(*by, "bits", "stretch").agg(F.bitmap_and_agg("_bitmap").alias("_shared"))
    return shared.filter(F.bitmap_count("_shared") > 0).select(*by).distinct()
