"""Near-duplicate documents by SetSketch registers."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreflow.llm.common import map_texts, mixed
from oreflow.llm.components import components, smallest_reached
from oreflow.operators.sizing import sized_side
from oreflow.session import materialize, materialize_counted


@dataclass(frozen=True)
class Sketch:
    """Register count and banding. With 30 bands of 5, a pair at similarity 0.85 shares no band
    with a chance of about 2e-8, at 0.8 about 7e-6. Buckets up to ``whole`` rows are compared in full,
    larger ones with ``pivots`` rows first; ``block_bytes`` sizes the blocks of what is left of them."""

    bands: int = 30
    rows: int = 5
    base: float = 1.02
    rate: float = 20.0
    limit: int = 4000
    width: int = 5
    percent: int = 85
    pivots: int = 4
    whole: int = 8
    block_bytes: int = 1 << 20
    sigmas: float = 5.5

    @property
    def size(self) -> int:
        return self.bands * self.rows


SKETCH = Sketch()
TASK_BYTES = 1 << 24


class Shingler:
    """Distinct hashes of the word shingles of one normalised text.

    A normalised text has its words joined by single spaces, so a shingle is a range of bytes, and
    its hash comes from prefix sums of a polynomial in an odd base modulo 2**64.
    """

    def __init__(self, width: int):
        seeds = np.random.default_rng(20240501)
        self.width = width
        self.base = int(seeds.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
        self.letter = seeds.integers(1, (1 << 64) - 1, 256, dtype=np.uint64)
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        inverse = pow(self.base, -1, 1 << 64)
        self.power = _powers(self.base, size)
        self.unpower = _powers(inverse, size)

    def __call__(self, text: bytes) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint64)
        if len(text) >= len(self.power):
            self._grow(2 * len(text))
        data = np.frombuffer(text, dtype=np.uint8)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letter[data] * self.power[: len(data)], out=total[1:])
        gaps = np.flatnonzero(data == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(data)]))
        if len(starts) > self.width:
            starts, ends = starts[: 1 - self.width], ends[self.width - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        return np.unique(mixed((total[ends] - total[starts]) * self.unpower[starts]))


def _powers(base: int, size: int) -> np.ndarray:
    powers = np.full(size, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def normal(raw: bytes) -> bytes:
    """A-Z lower-cased, words (runs of other bytes than space and 9 to 13) joined by single spaces."""
    return b" ".join(raw.lower().split())


def text_key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def minima(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash of the set for every register."""
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multiply), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(keys), 8192):
        part = keys[None, at : at + 8192] * multiply[:, None] + add[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def register_values(least: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Truncated exponents of exponential minima: the sketch of a union is the maximum of sketches."""
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    values = np.floor(1 - np.log(-np.log1p(-uniform) / sketch.rate) / np.log(sketch.base))
    return np.clip(values, 0, sketch.limit).astype("<u2")


def permutations(sketch: Sketch) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.random.default_rng(7919)
    multiply = seeds.integers(0, 1 << 32, sketch.size, dtype=np.uint32) | np.uint32(1)
    return multiply, seeds.integers(0, 1 << 32, sketch.size, dtype=np.uint32)


def sketches(docs: DataFrame, sketch: Sketch = SKETCH, carry: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, text_key, registers) of every row, from whole texts, and the binary column ``carry``."""
    carried = [carry] if carry else []

    def make():
        shingler, (multiply, add) = Shingler(sketch.width), permutations(sketch)

        def work(part: pa.RecordBatch) -> dict:
            sizes, keys, least = [], [], []
            for raw in part.column("text").cast(pa.binary()).to_pylist():
                text = normal(raw or b"")
                shingles = shingler(text)
                sizes.append(len(shingles))
                keys.append(text_key(text))
                least.append(minima(shingles, multiply, add))
            values = register_values(np.array(least), sketch)
            return {
                "doc_id": part.column("doc_id"),
                "n_shingles": sizes,
                "text_key": keys,
                "registers": [v.tobytes() if n else None for v, n in zip(values, sizes)],
                **{c: part.column(c) for c in carried},
            }

        return work

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carried)
    schema = ", ".join(["doc_id long, n_shingles long, text_key binary, registers binary", *(f"{c} binary" for c in carried)])
    return map_texts(rows, schema, make)


def band_rows(reps: DataFrame, sketch: Sketch) -> DataFrame:
    """(key, id, n): one row per band of each representative."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = b"".join(batch.column("registers").to_pylist())
            values = np.frombuffer(joined, dtype="<u2").reshape(-1, sketch.bands, sketch.rows).astype(np.uint64)
            keys = np.broadcast_to(np.arange(1, sketch.bands + 1, dtype=np.uint64), values.shape[:2])
            for row in range(sketch.rows):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, row])
            times = np.repeat(np.arange(batch.num_rows), sketch.bands)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64).ravel()), batch.column("id").take(pa.array(times)), batch.column("n").take(pa.array(times))],
                names=["key", "id", "n"],
            )

    return reps.select("id", "n", "registers").mapInArrow(run, "key long, id long, n long")


def joint_estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, sketch: Sketch):
    """Similarity by joint likelihood, and whether the threshold is still plausible.

    The counts of registers that are larger left, larger right or equal are trinomial with chances
    that depend on the similarity and the set sizes; the likelihood is searched on a grid. A pair
    stays when the threshold's likelihood is within ``sigmas`` standard deviations of the maximum.
    """
    wins = (left > right).sum(axis=1)
    losses = (left < right).sum(axis=1)
    ties = left.shape[1] - wins - losses
    share = (n_left / (n_left + n_right))[:, None]
    top = np.minimum(n_left, n_right) / np.maximum(n_left, n_right)
    grid = np.linspace(0, 1, 101)[None, :] * top[:, None]
    floor = np.minimum(sketch.percent / 100, top)[:, None]
    grid = np.concatenate((grid, floor), axis=1)

    def chance(x):
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (sketch.base - 1) / sketch.base) / np.log(sketch.base), 1e-9)

    up = chance(share - (1 - share) * grid)
    down = chance((1 - share) - share * grid)
    same = np.maximum(1 - up - down, 1e-9)
    score = wins[:, None] * np.log(up) + losses[:, None] * np.log(down) + ties[:, None] * np.log(same)
    best = score[:, :-1].argmax(axis=1)
    estimate = grid[np.arange(len(grid)), best]
    plausible = (estimate >= floor[:, 0]) | (score[:, -1] >= score[:, :-1].max(axis=1) - sketch.sigmas**2 / 2)
    return estimate, plausible


def likely(pairs: DataFrame, reps: DataFrame, sketch: Sketch) -> DataFrame:
    """Pairs (a, b) with the joint estimate, without those the likelihood rules out."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                left, right = (
                    np.frombuffer(b"".join(part.column(c).to_pylist()), dtype="<u2").reshape(-1, sketch.size)
                    for c in ("left", "right")
                )
                n_left, n_right = (part.column(c).to_numpy().astype(float) for c in ("n_left", "n_right"))
                estimate, plausible = joint_estimate(left, right, n_left, n_right, sketch)
                kept = pa.array(plausible)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(kept), part.column("b").filter(kept), pa.array(estimate[plausible])],
                    names=["a", "b", "estimate"],
                )

    one = reps.select(F.col("id").alias("a"), F.col("n").alias("n_left"), F.col("registers").alias("left"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("n_right"), F.col("registers").alias("right"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long, estimate double")


def full_sets(docs: DataFrame, ids: DataFrame, sketch: Sketch) -> DataFrame:
    """(id, shingles) of the chosen representatives: sorted 64-bit hashes, packed."""

    def make():
        shingler = Shingler(sketch.width)

        def work(part: pa.RecordBatch) -> dict:
            texts = [normal(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
            return {"id": part.column("id"), "text_key": [text_key(t) for t in texts], "shingles": [shingler(t).tobytes() for t in texts]}

        return work

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    return map_texts(texts.join(ids.select("id"), "id"), "id long, text_key binary, shingles binary", make)


def verified(pairs: DataFrame, sets: DataFrame, sketch: Sketch) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                one = np.frombuffer(left.as_buffer(), dtype=np.uint64)
                two = np.frombuffer(right.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= sketch.percent * (len(one) + len(two) - both))
            kept = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"]
            )

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _crossing(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    one = parts.select(F.col("id").alias("a"), F.col("component").alias("_one"))
    two = parts.select(F.col("id").alias("b"), F.col("component").alias("_two"))
    found = pairs.join(one, "a", "left").join(two, "b", "left")
    return found.filter(F.coalesce("_one", "a") != F.coalesce("_two", "b")).drop("_one", "_two")


def _fits(n: Column, m: Column, both: Column, sketch: Sketch) -> Column:
    """Whether sets of n and m shingles that share ``both`` at most can reach the threshold."""
    return 100 * both >= sketch.percent * (n + m - both)


def _pairs(pivots: DataFrame, members: DataFrame, sketch: Sketch) -> DataFrame:
    """Distinct pairs of a bucket's pivots with its members whose sizes allow the threshold."""
    other = pivots.select("key", F.col("id").alias("_id"), F.col("n").alias("_n"))
    fits = _fits(F.col("n"), F.col("_n"), F.least("n", "_n"), sketch)
    return _ordered(members.join(other, "key").filter((F.col("id") != F.col("_id")) & fits))


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()


def able_sets(sets: DataFrame, sketch: Sketch) -> DataFrame:
    """(set, id, bytes) of the sets that can reach the threshold with another one.

    A set shares no shingle that only it has, so too many of those rule out every partner.
    """

    def run(batches):
        for batch in batches:
            for i, packed in zip(batch.column("set").to_pylist(), batch.column("shingles")):
                found = np.frombuffer(packed.as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i)), pa.array(found)], names=["set", "shingle"])

    counted = sets.mapInArrow(run, "set long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("set").alias("set"))
    alone = counted.filter("times = 1").groupBy("set").agg(F.count(F.lit(1)).alias("alone"))
    size = F.length("shingles")
    shared = size / 8 - F.coalesce("alone", F.lit(0))
    named = sets.join(alone, "set", "left").filter(100 * shared >= sketch.percent * size / 8)
    return named.select("set", "id", size.cast("long").alias("bytes"))


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many members every left set shares with every right one, by products of indicator columns."""
    flat = [np.concatenate(side) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    words = np.intersect1d(*flat)
    counts = np.zeros((len(left), len(right)), dtype=np.int64)
    if not len(words):
        return counts
    placed = []
    for values, rows in zip(flat, owner):
        place = np.minimum(np.searchsorted(words, values), len(words) - 1)
        hit = words[place] == values
        order = np.argsort(place[hit], kind="stable")
        placed.append((place[hit][order], rows[hit][order]))
    for at in range(0, len(words), width):
        sides = []
        for (place, rows), side in zip(placed, (left, right)):
            run = slice(*np.searchsorted(place, [at, at + width]))
            marks = np.zeros((len(side), width), dtype=np.float32)
            marks[rows[run], place[run] - at] = 1
            sides.append(marks)
        counts += (sides[0] @ sides[1].T).astype(np.int64)
    return counts


def block_links(tiles: DataFrame, sketch: Sketch) -> DataFrame:
    """(a, b): for every id with a link in its tile, the smallest id that it reaches there."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sets = [], []
                for side in ("left", "right"):
                    members = batch.column(side).slice(row, 1).flatten()
                    ids.append(members.field("id").to_numpy(zero_copy_only=False))
                    sets.append([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in members.field("shingles")])
                both = common_counts(*sets)
                sizes = [np.array([len(x) for x in side]) for side in sets]
                i, j = np.nonzero(100 * both >= sketch.percent * (sizes[0][:, None] + sizes[1][None, :] - both))
                places = np.concatenate(ids)
                least = smallest_reached(i, j + len(ids[0]), places)
                linked = least != places
                yield pa.RecordBatch.from_arrays([pa.array(places[linked]), pa.array(least[linked])], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, sketch: Sketch = SKETCH, carry: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Equal texts meet first by a 128-bit key, so copies cost one narrow row each. One representative
    per text goes on: its registers fall into bands, and rows with equal bands meet in a bucket. A
    few pivots per bucket, chosen by hash, are compared with its members, so a bucket of n rows
    makes at most ``pivots * n`` pairs there. The joint likelihood of registers drops hopeless pairs,
    and full shingle sets decide the rest: first the best partner of each row, then only pairs
    between components. Where a larger bucket still spans several components, its members outside
    the main one are compared with the whole bucket, block by block and with full sets: no pair
    that shares a band goes unchecked.

    Null, empty or word-less text: n_shingles 0, alone. Repeated rows: each gets its row; equal ids
    and texts share a component as copies do. Two different texts under one id stay one document of
    its own each, but share the id's links. Null doc_id: component null, kept true. Extra columns
    are ignored. An empty table gives no rows. With ``carry``, a binary column of ``docs``, the result also
    has that column and text_key, the key of the normalised text.
    """
    spark = docs.sparkSession
    carried = ["text_key", carry] if carry else []
    made = materialize(spark, sketches(docs, sketch, carry))
    some = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = some.groupBy("text_key").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")
    )
    reps = materialize(spark, reps)
    bucket = Window.partitionBy("key")
    members = (
        band_rows(reps, sketch)
        .withColumn("size", F.count(F.lit(1)).over(bucket))
        .withColumn("turn", F.row_number().over(bucket.orderBy(F.xxhash64("id"), "id")))
        .filter("size > 1")
    )
    members = materialize(spark, members)
    first = (F.col("turn") <= sketch.pivots) | (F.col("size") <= sketch.whole)
    pairs = materialize(spark, likely(_pairs(members.filter(first), members, sketch), reps, sketch))

    best = pairs.groupBy(F.col("b")).agg(F.max(F.struct("estimate", -F.col("a"))).alias("best"))
    best = best.select((-F.col("best.col2")).alias("a"), "b")
    links = materialize(spark, _verify_pairs(docs, reps, best, sketch))
    parts = materialize(spark, components(links))
    links, parts = _settle(docs, reps, _crossing(pairs, parts), links, parts, sketch)

    large = members.filter(F.col("size") > max(sketch.pivots, sketch.whole))
    parts = _work_off(docs, reps, large, links, parts, sketch)

    home = reps.select("text_key", F.col("id").alias("_rep"))
    labels = parts.select(F.col("id").alias("_rep"), F.col("component").alias("_part"))
    out = made.select("doc_id", "n_shingles", *(carried or ["text_key"])).join(home, "text_key", "left").join(labels, "_rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("_part", "_rep", "doc_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        *carried,
    )


def _verify_pairs(docs: DataFrame, reps: DataFrame, pairs: DataFrame, sketch: Sketch) -> DataFrame:
    spark = docs.sparkSession
    pairs = materialize(spark, pairs)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = sized_side(reps.select("id", "text_key").join(ids, "id", "left_semi"))
    return verified(pairs, materialize(spark, full_sets(docs, ids, sketch)), sketch)


def _settle(docs, reps, pairs, links, parts, sketch: Sketch) -> tuple[DataFrame, DataFrame]:
    """Verify pairs between components and merge what they link."""
    spark = docs.sparkSession
    pairs, count = materialize_counted(spark, pairs)
    if not count:
        return links, parts
    found, count = materialize_counted(spark, _verify_pairs(docs, reps, pairs, sketch))
    if not count:
        return links, parts
    links = materialize(spark, links.unionByName(found))
    return links, materialize(spark, components(links))


def _work_off(docs, reps, large: DataFrame, links, parts, sketch: Sketch) -> DataFrame:
    """Components after comparing what is left of large buckets.

    A bucket that lies in one component is done. In others, each member outside the largest component
    meets every member. Both come in blocks, chosen by hash and of about ``block_bytes`` of shingles, so
    no bucket is gathered and a tile of two blocks is one row, whatever the number of its pairs.
    """
    spark = docs.sparkSession
    large, count = materialize_counted(spark, _spanning(large, parts))
    if not count:
        return parts
    ids = sized_side(reps.select("id", "text_key").join(large.select("id").distinct(), "id", "left_semi"))
    sets = full_sets(docs, ids, sketch).dropDuplicates(["id", "text_key"])
    sets = materialize(spark, sets.select(F.xxhash64("id", "text_key").alias("set"), "id", "shingles"))
    outside = (F.col("part") != F.col("main")).alias("outside")
    placed = materialize(spark, large.select("key", "id", outside).join(able_sets(sets, sketch), "id"))
    sizes = placed.groupBy("key", "outside").agg(F.sum("bytes").alias("total"))
    blocks = F.ceil(F.col("total") / sketch.block_bytes)
    placed = placed.join(sizes, ["key", "outside"]).withColumn("block", F.pmod(F.xxhash64("set"), blocks))
    marks = placed.groupBy("key", "outside", "block").agg(F.sum("bytes").alias("bytes"))
    marks = materialize(spark, marks.join(sizes.filter("outside").select("key"), "key", "left_semi"))
    other = marks.select("key", F.col("outside").alias("outside2"), F.col("block").alias("other"), F.col("bytes").alias("bytes2"))
    met = marks.filter("outside").join(other, "key").filter("NOT outside2 OR other >= block")
    met = materialize(spark, met.select("key", "block", "outside2", "other", (F.col("bytes") + F.col("bytes2")).alias("bytes")))
    tasks = max(1, -(-(met.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    members = placed.join(sets.select("set", "shingles"), "set").groupBy("key", "outside", "block")
    stored = materialize(spark, members.agg(F.collect_list(F.struct("id", "shingles")).alias("members")))
    left = stored.filter("outside").select("key", "block", F.col("members").alias("left"))
    right = stored.select("key", F.col("outside").alias("outside2"), F.col("block").alias("other"), F.col("members").alias("right"))
    tiles = met.drop("bytes").join(left, ["key", "block"]).join(right, ["key", "outside2", "other"])
    found = block_links(tiles.repartition(tasks, "key", "block", "outside2", "other").select("left", "right"), sketch)
    found, count = materialize_counted(spark, found.distinct())
    return materialize(spark, components(links.unionByName(found))) if count else parts


def _spanning(large: DataFrame, parts: DataFrame) -> DataFrame:
    """Members with their component, of buckets that span several; main is the bucket's largest one."""
    labels = parts.select("id", F.col("component").alias("part"))
    named = large.join(labels, "id", "left").withColumn("part", F.coalesce("part", "id"))
    sizes = named.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("key").agg(F.max(F.struct("rows", -F.col("part"))).alias("main"), F.count(F.lit(1)).alias("parts"))
    return named.join(main.filter("parts > 1").select("key", (-F.col("main.col2")).alias("main")), "key")
