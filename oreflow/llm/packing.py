"""Packing documents into sequences by a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreflow.llm.common import map_texts
from oreflow.llm.tokens import Encoder
from oreflow.session import materialize_counted

CAPACITY = 2048
SEPARATOR = b"\0\0\0\0"
ROUNDS = 600
"""Patterns priced per solution."""

CLASSES = 48
"""Classes of neighbouring lengths that the linear program tells apart."""

SPREAD = 1.25
"""How much wider than its narrowest member a class may be."""

PASSES = 8
"""Solutions of the program, each over what rounding the one before has left."""

SALT_ROWS = 500_000


@dataclass(frozen=True)
class Pattern:
    """Lengths with their numbers in one sequence, how many sequences look so, and whether the linear program made it."""

    counts: dict[int, int]
    times: int
    solved: bool = False


def priced(value: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable pattern: bounded knapsack by dynamic programming over the capacity.

    A length that may occur ``most`` times is split into 1, 2, 4, ... copies.
    """
    best = np.zeros(capacity + 1)
    items, takes = [], []
    for i in np.argsort(-value / lengths, kind="stable"):
        left, copies = int(min(most[i], capacity // lengths[i])), 1
        while left > 0:
            copies = min(copies, left)
            size = copies * int(lengths[i])
            with_it = best[: capacity + 1 - size] + copies * value[i]
            take = with_it > best[size:] + 1e-15
            best[size:][take] = with_it[take]
            items.append((int(i), copies, size))
            takes.append(take)
            left -= copies
            copies *= 2
    at, found = int(best.argmax()), {}
    for (i, copies, size), take in zip(reversed(items), reversed(takes)):
        if at >= size and take[at - size]:
            found[i] = found.get(i, 0) + copies
            at -= size
    return found


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Covering configuration LP by multiplicative weights.

    Each round prices lengths by weight per demand and adds the most valuable pattern until one of its
    lengths gained its demand once more; weights shrink exponentially with what was covered. Few lengths are
    covered many times over, so that patterns balance; the more lengths, the fewer times the rounds allow.
    The result is scaled so that no length is covered more than once.
    """
    demand = counts.astype(float)
    weight = np.ones(len(lengths))
    covered = np.zeros(len(lengths))
    goal = max(2.0, rounds / len(lengths))
    rate = min(1.0, (1 + np.log(len(lengths))) / goal)
    chosen: dict[tuple, float] = {}
    for _ in range(rounds):
        index = np.flatnonzero(covered < goal)
        if not len(index):
            break
        pattern = priced((weight / demand)[index], lengths[index], counts[index], capacity)
        rows, n = index[list(pattern)], np.array(list(pattern.values()), dtype=float)
        times = (demand[rows] / n).min()
        covered[rows] += n * times / demand[rows]
        weight[rows] *= np.exp(-rate * n * times / demand[rows])
        weight /= weight.max()
        key = tuple(zip(rows.tolist(), n.astype(int).tolist()))
        chosen[key] = chosen.get(key, 0.0) + times
    top = max(1.0, covered.max(initial=1.0))
    return [(dict(p), t / top) for p, t in chosen.items()]


def filled(space: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """A subset of what is left that fills the space as far as possible, large lengths first."""
    reach, steps, want = 1, [], 1 << space
    mask = (want << 1) - 1
    for length in lengths:
        if length > space:
            continue
        n, copies = min(left[length], space // length), 1
        while n > 0:
            copies = min(copies, n)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            n -= copies
            copies *= 2
        if reach & want:
            break
    at, found = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + copies
            at -= length * copies
    return found


def largest_first(space: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """The largest lengths that fit, one after another."""
    found = {}
    for length in lengths:
        n = min(left[length], space // length)
        if n > 0:
            found[length] = n
            space -= n * length
    return found


def classes(left: dict[int, int], number: int, capacity: int) -> list[list[int]]:
    """Groups of neighbouring lengths, large lengths first: each has about 1/``number`` of all tokens at most, and
    neither the lengths nor what they leave of the capacity differ by more than ``SPREAD`` within a group."""
    order = sorted((n for n, c in left.items() if c), reverse=True)
    most = sum(n * left[n] for n in order) / number
    groups: list[list[int]] = []
    mass = 0.0
    for n in order:
        first = groups[-1][0] if groups else 0
        if not groups or mass + n * left[n] > most or first > SPREAD * n or capacity - n > SPREAD * (capacity - first):
            groups.append([])
            mass = 0.0
        groups[-1].append(n)
        mass += n * left[n]
    return groups


def realised(slots: list[list[int]], left: dict[int, int], capacity: int) -> dict[int, int] | None:
    """A length for every slot, out of the slot's lengths, that together are the capacity; none if there is no such choice."""
    mask = (2 << capacity) - 1
    reach = [1]
    for lengths in slots:
        sums = 0
        for n in lengths:
            sums |= reach[-1] << n
        reach.append(sums & mask)
    if not reach[-1] >> capacity & 1:
        return None
    at, found = capacity, {}
    for lengths, before in zip(reversed(slots), reversed(reach[:-1])):
        fits = [n for n in lengths if n <= at and before >> (at - n) & 1 and left[n] > found.get(n, 0)]
        if not fits:
            return None
        best = max(fits, key=lambda n: (left[n] - found.get(n, 0), n))
        found[best] = found.get(best, 0) + 1
        at -= best
    return found


def solved(left: dict[int, int], capacity: int) -> list[tuple[list[Pattern], dict[int, int]]]:
    """Full sequences by the configuration program and what they leave of ``left``, after each pass.

    The program is solved over classes of lengths, each with its mean as size, and its solution rounded down.
    A pattern of classes becomes patterns of lengths that fill the capacity exactly, each used as often as its
    lengths last, so their number follows that of the lengths. What rounding leaves is a smaller histogram, for which
    the program is solved again, until a pass places little.
    """
    out: list[Pattern] = []
    states = []
    left = dict(left)
    for _ in range(PASSES):
        mass = sum(n * c for n, c in left.items())
        if mass < 4 * capacity:
            break
        groups = classes(left, min(CLASSES, max(2, mass // capacity // 8)), capacity)
        counts = np.array([sum(left[n] for n in g) for g in groups])
        sizes = np.array([round(sum(n * left[n] for n in g) / c) for g, c in zip(groups, counts)])
        placed = 0
        for kinds, times in sorted(fractional(sizes, counts, capacity), key=lambda p: -p[1]):
            rest = int(times + 1e-9)
            while rest > 0:
                alive = {i: [n for n in groups[i] if left[n]] for i in kinds}
                found = realised([alive[i] for i, k in kinds.items() for _ in range(k)], left, capacity)
                if not found:
                    break
                n = min(rest, *(left[m] // k for m, k in found.items()))
                for m, k in found.items():
                    left[m] -= n * k
                out.append(Pattern(found, n, True))
                rest -= n
                placed += n
        states.append((list(out), dict(left)))
        if placed * capacity < 0.1 * mass:
            break
    return states


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that place every length exactly as often as the histogram says.

    The configuration program places what it can in full sequences; the little that is left is placed largest
    length first, each with a fill of the rest, best or largest first, as often as the remaining counts allow. Later
    passes of the program leave less, but of more uneven lengths, so where that misses the lower bound, the fills
    follow each pass, and the smallest result counts. Where lengths do not add up to full sequences (all above a third
    of the capacity, say), no full sequence is right and the fills alone may win; equal results go to the program.
    Work depends on the number of different lengths, not on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("a length does not fit the capacity")
    whole = [Pattern({capacity: 1}, left.pop(capacity))] if left.get(capacity) else []
    if not left:
        return whole
    bound = -(-sum(n * c for n, c in left.items()) // capacity)
    best: list[Pattern] | None = None
    for start, over in [*reversed(solved(left, capacity)), ([], left)]:
        for fill in (filled, largest_first):
            found = start + _filled_up(fill, dict(over), capacity)
            if best is None or _sequences(found) < _sequences(best):
                best = found
            if _sequences(best) <= bound:
                return whole + best
    return whole + best


def _sequences(found: list[Pattern]) -> int:
    return sum(p.times for p in found)


def _filled_up(fill, left: dict[int, int], capacity: int) -> list[Pattern]:
    """Sequences of what is left, largest length first, each with a fill of its rest."""
    out: list[Pattern] = []
    order = sorted((n for n in left if left[n]), reverse=True)
    while order:
        largest = order[0]
        left[largest] -= 1
        kinds = fill(capacity - largest, order, left)
        left[largest] += 1
        kinds[largest] = kinds.get(largest, 0) + 1
        times = min(left[n] // k for n, k in kinds.items())
        out.append(Pattern(kinds, times))
        for n, k in kinds.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
    return out


class Slots:
    """For every length its places in the patterns, as sorted arrays."""

    def __init__(self, found: list[Pattern]):
        used: dict[int, int] = {}
        rows, base = [], 0
        for pattern in found:
            offset = 0
            for length in sorted(pattern.counts, reverse=True):
                n = pattern.counts[length]
                start = used.get(length, 0)
                rows.append((length, start, base, n, offset))
                used[length] = start + n * pattern.times
                offset += n * length
            base += pattern.times
        self.rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.keys = (self.rows[:, 0] << 48) + self.rows[:, 1]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with this rank among the pieces of its length."""
        at = np.searchsorted(self.keys, (length << 48) + rank, side="right") - 1
        _, start, base, n, offset = self.rows[at].T
        return base + (rank - start) // n, offset + (rank - start) % n * length


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the separator."""

    def make():
        encode = Encoder(path)

        def work(part: pa.RecordBatch) -> dict:
            rows: list[list] = [[], [], [], [], []]
            ids = part.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, part.column("text").to_pylist()):
                data = encode(text) + SEPARATOR
                total = len(data) // 4
                first = total % capacity or capacity
                starts = [0, *range(first, total, capacity)]
                for piece, (start, end) in enumerate(zip(starts, [*starts[1:], total])):
                    for column, value in zip(rows, (doc_id, piece, start, end - start, zlib.crc32(data[4 * start : 4 * end]))):
                        column.append(value)
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), rows))

        return work

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(rows, "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text): doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    A document is its ids and a separator. One that is longer than ``capacity`` is cut into pieces of
    that length, of which the first may be shorter. Only the histogram of lengths, ``capacity`` numbers
    at most, reaches the driver; patterns go back. Pieces of equal length are numbered: salted by hash, each
    (length, salt) counts from the sum of the salts before it, so a frequent length is many groups.

    Null and empty texts are one separator. Repeated rows and null ids are documents of their own.
    Extra columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut, rows = materialize_counted(spark, pieces(docs, capacity, path))
    salts = max(1, -(-rows // SALT_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots(patterns(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("row", F.row_number().over(order)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row") - 1).alias("rank"))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = slots.value.place(length, rank)
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long"
    return ranked.mapInArrow(run, schema)
