"""Document quality by an interpolated modified Kneser-Ney model of the word pairs of trusted text.

Words and pairs are 64-bit keys in tables that grow with the trusted text. The surprisal of a text is a sum over
its keys: a pair that no trusted text has costs what its context leaves to the lower order plus what its second
word costs there, which are figures of single words, and a pair that has been seen costs less by a difference. So
one table (key, cost) holds the model, and texts are scored by one join of their counted keys with it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.llm.common import arrow_table, map_texts, signed, squeezed, steps, unsigned, unsqueezed
from oreflow.operators.sizing import sized_side
from oreflow.session import Buckets, discard, exists, materialize, materialize_at, shuffles_removed

FOLDS = 4
"""Parts of the trusted text; a text is scored by a model of the other parts."""

HEAVY = 16384
"""A key that makes up this share of all trusted words, or more, is scored before the shuffle: at most HEAVY words
and HEAVY pairs can be so frequent, whatever the corpus."""

UNIT = 1 << 20
"""Costs are whole numbers of 1/UNIT nats, so sums do not depend on their order."""

(EDGE, LOWER, TITLE, UPPER, MIXED, DIGITS, MARKS, NOISY, LONG, OTHER) = range(10)
SHAPES = 10
SHAPE_BITS = 15
BEGIN, END = 1 << 40, 1 << 41
"""Keys of the borders of a text, of shape EDGE."""

BUCKET_BYTES = 1 << 24
"""Trusted text whose pairs make one bucket of the model, or less."""

BLOCK_BYTES = 1 << 23
ROUNDS = 6
"""Parts that buckets and texts are worked off in, one after the other: shuffled data of one lies on disk at a time."""

TURN = 23
MOST_CACHED = 400_000


def shape(word: str) -> int:
    """What an unknown word looks like: unknown words of one shape are one word to the model."""
    core = word.strip(".,;:?'\"()-«»“”")
    if not core:
        return MARKS
    if not core.isalpha():
        if core.isdigit():
            return DIGITS
        return NOISY if any(c.isalnum() for c in core) else MARKS
    if len(core) > 40:
        return LONG
    if core.islower():
        return LOWER
    if core.isupper():
        return UPPER if len(core) > 1 else TITLE
    return TITLE if core[1:].islower() else MIXED if core[0].isalpha() else OTHER


class Keys(dict):
    """The key of a word: a hash whose low bits are its shape. A full cache stays as it is."""

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        found = code - (code & SHAPE_BITS) + shape(word)
        if len(self) < MOST_CACHED and len(word) < 64:
            self[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        found = np.empty(len(words) + 2, dtype=np.uint64)
        found[0], found[-1] = BEGIN, END
        found[1:-1] = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        return found


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ (second << np.uint64(TURN) | second >> np.uint64(64 - TURN))


def buckets_of(keys: np.ndarray, count: int) -> np.ndarray:
    """The range of hash values, of ``count`` equal ones, that a key falls into."""
    return ((keys >> np.uint64(33)) * np.uint64(count) >> np.uint64(31)).astype(np.int64)


def bucket_of(word: Column, count: int) -> Column:
    """``buckets_of`` as a column."""
    return F.shiftright(F.shiftrightunsigned(word, 33) * F.lit(count).cast("long"), 31).cast("int")


def runs_by(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group with the places of its rows, which keep their order."""
    order = np.argsort(groups, kind="stable")
    found, starts = np.unique(groups[order], return_index=True)
    return zip(found.tolist(), np.split(order, starts[1:]))


def counted(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and the sum of their numbers."""
    if n is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes, kind="stable")
    found, starts = np.unique(codes[order], return_index=True)
    return found, np.add.reduceat(n[order], starts) if len(found) else n[:0]


def _pair_blocks(count: int) -> Callable:
    """Counted pairs of a slice of texts, a block for each bucket: the block's words, and pairs of places there."""

    def make():
        keys = Keys()

        def work(part: pa.RecordBatch) -> dict:
            texts = [keys.of(t) for t in part.column("text").to_pylist()]
            folds = np.repeat(part.column("fold").to_numpy(), [len(t) - 1 for t in texts]).astype(np.int64)
            words, place = np.unique(np.concatenate(texts), return_inverse=True)
            inner = np.ones(len(place), dtype=bool)
            inner[np.cumsum([len(t) for t in texts]) - 1] = False
            at = np.flatnonzero(inner)
            codes, n = counted((place[at] * len(words) + place[at + 1]) * FOLDS + folds)
            first, second, folds = codes // FOLDS // len(words), codes // FOLDS % len(words), codes % FOLDS
            blocks = []
            for bucket, rows in runs_by(buckets_of(pair_keys(words[first], words[second]), count)):
                used = np.zeros(len(words), dtype=np.int64)
                used[first[rows]] = used[second[rows]] = 1
                moved = np.cumsum(used) - 1
                columns = (steps(words[used > 0]), steps(moved[first[rows]]), moved[second[rows]], folds[rows], n[rows])
                blocks.append((bucket, *map(squeezed, columns)))
            return dict(zip(("bucket", "words", "first", "second", "fold", "n"), zip(*blocks)))

        return work

    return make


def _pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a bucket, the places of its pairs' words, and the pairs' counts within each fold."""
    words, first = (np.cumsum(unsqueezed(row[c], kind), dtype=kind) for c, kind in (("words", np.uint64), ("first", np.int64)))
    return words, first, unsqueezed(row["second"]), np.array([unsqueezed(row[f"f{k}"]) for k in range(FOLDS)])


def _count_bucket(key: tuple, blocks: pa.Table) -> pa.Table:
    """All pairs of a bucket in one row, with how many counts outside each fold are 1, 2, 3 and 4."""
    parts = [[unsqueezed(v, np.uint64 if c == "words" else np.int64) for v in blocks[c].to_pylist()] for c in blocks.column_names[1:]]
    parts[0], parts[1] = [np.cumsum(v, dtype=np.uint64) for v in parts[0]], [np.cumsum(v) for v in parts[1]]
    words = np.unique(np.concatenate(parts[0]))
    moved = [np.searchsorted(words, own) for own in parts[0]]
    codes = np.concatenate([(m[a] * len(words) + m[b]) * FOLDS + f for m, a, b, f in zip(moved, *parts[1:4])])
    codes, n = counted(codes, np.concatenate(parts[4]))
    pairs, place = np.unique(codes // FOLDS, return_inverse=True)
    inside = np.zeros((FOLDS, len(pairs)), dtype=np.int64)
    inside[codes % FOLDS, place] = n
    outside = inside.sum(axis=0) - inside
    few = [int((outside[k] == j).sum()) for k in range(FOLDS) for j in (1, 2, 3, 4)]
    columns = (steps(words), steps(pairs // len(words)), pairs % len(words), *inside)
    return arrow_table([[v] for v in (key[0].as_py(), *map(squeezed, columns), int(n.sum()), few)], PAIRS)


BLOCKS = "bucket int, words binary, first binary, second binary, fold binary, n binary"
PAIRS = "bucket int, words binary, first binary, second binary, " + "".join(f"f{k} binary, " for k in range(FOLDS)) + "n long, few array<long>"
FIGURES = ["n", *(f"{c}{k}" for c in ("total", "one", "two", "more", "c") for k in range(FOLDS))]
"""Of a word: its count and, outside each fold, its pairs, how many of them are there once, twice and more often, and
how many different words come before it."""


def _word_figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pairs of each bucket add to the figures of their words."""
    for row in (r for batch in batches for r in batch.to_pylist()):
        words, first, second, inside = _pairs_of(row)
        n = inside.sum(axis=0)

        def summed(at: np.ndarray, values: np.ndarray) -> np.ndarray:
            found = np.zeros(len(words), dtype=np.int64)
            np.add.at(found, at, values)
            return found

        tests = [lambda t: t, lambda t: t == 1, lambda t: t == 2, lambda t: t > 2]
        sums = [summed(first, n)]
        sums += [summed(first, test(n - own).astype(np.int64)) for test in tests for own in inside]
        sums += [summed(second, (n > own).astype(np.int64)) for own in inside]
        for at in range(0, len(words), 1 << 16):
            cut = slice(at, at + (1 << 16))
            columns = [words.view(np.int64)[cut], *(v[cut] for v in sums)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", *FIGURES])


def _words_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that each bucket's pairs need figures of."""
    for row in (r for batch in batches for r in batch.to_pylist()):
        words = np.cumsum(unsqueezed(row["words"], np.uint64), dtype=np.uint64).view(np.int64)
        for at in range(0, len(words), 1 << 16):
            own = words[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), row["bucket"], dtype=np.int32))], names=["word", "bucket"])


def discounts(few: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many counts are 1, 2, 3 and 4."""
    one, two, three, four = (float(v or 0) for v in few)
    if not (one and two and three):
        return [0.5, 0.5, 0.5]
    y = one / (one + 2 * two)
    raw = (1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three)
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def taken(count: np.ndarray, by: list[float]) -> np.ndarray:
    """The discount of a count; none of 0."""
    return np.array([0.0, *by])[np.minimum(count, 3)]


def _tally(prefix: str) -> list[Column]:
    """How many counts are 1, 2, 3 and 4 and how many are more than 2, for each fold."""
    tests = {**{str(j): lambda c, j=j: c == j for j in (1, 2, 3, 4)}, "more": lambda c: c > 2}
    return [F.count_if(test(F.col(f"{prefix}{k}"))).alias(f"{k}_{name}") for k in range(FOLDS) for name, test in tests.items()]


def _discounts(row) -> list[list[float]]:
    return [discounts([row[f"{k}_{j}"] for j in (1, 2, 3, 4)]) for k in range(FOLDS)]


COSTS = "bucket int, keys binary, " + "".join(f"v{k} binary, " for k in range(FOLDS)) + "heavy array<long>, heavy_costs array<long>"


@dataclass(frozen=True)
class Model:
    """``costs``, a row for each bucket of keys: its keys, in order, and what each costs the texts of each fold, in
    1/UNIT nats, without the frequent keys; those, and what unknown words of each shape cost each fold."""

    costs: Buckets
    heavy: np.ndarray
    heavy_costs: np.ndarray
    unknown: np.ndarray


def _units(nats: np.ndarray) -> np.ndarray:
    return np.floor(nats * UNIT + 0.5).astype(np.int64)


@dataclass(frozen=True)
class Scale:
    """What all costs share: discounts of pairs and of the lower order, that one's totals and unknown words."""

    cuts: list[list[float]]
    low_cuts: list[list[float]]
    low_all: list[float]
    unknown: np.ndarray
    guess: np.ndarray
    all_words: int

    def weight(self, rows: pa.Table, k: int) -> np.ndarray:
        one, two, more, total = (rows[f"{c}{k}"].to_numpy() for c in ("one", "two", "more", "total"))
        left = self.cuts[k][0] * one + self.cuts[k][1] * two + self.cuts[k][2] * more
        return np.where(total > 0, left / np.maximum(total, 1), 1.0)

    def low(self, rows: pa.Table, k: int) -> np.ndarray:
        count, look = rows[f"c{k}"].to_numpy(), rows["word"].to_numpy() & SHAPE_BITS
        return np.where(count > 0, (count - taken(count, self.low_cuts[k])) / self.low_all[k], self.unknown[k][look])

    def bucket(self, key: tuple, pairs: pa.Table, rows: pa.Table) -> pa.Table:
        """The costs of a bucket from its pairs and from figures of words: of its own, and of those in its pairs."""
        own = rows.filter(rows["own"])
        keys, counts = [own["word"].to_numpy().view(np.uint64)], [own["n"].to_numpy()]
        look = own["word"].to_numpy() & SHAPE_BITS
        costs = [[_units(-np.log(self.low(own, k))) - self.guess[k][look] + _units(-np.log(self.weight(own, k)))] for k in range(FOLDS)]
        for row in pairs.to_pylist():
            words, first, second, inside = _pairs_of(row)
            other = rows.filter(pc.invert(rows["own"]))
            other = other.take(pa.array(np.argsort(other["word"].to_numpy().view(np.uint64))))
            if not np.array_equal(other["word"].to_numpy().view(np.uint64), words):
                raise RuntimeError("figures of a bucket's words are missing")
            keys.append(pair_keys(words[first], words[second]))
            counts.append(inside.sum(axis=0))
            for k in range(FOLDS):
                seen = counts[-1] - inside[k]
                backed = self.weight(other, k)[first] * self.low(other, k)[second]
                share = (seen - taken(seen, self.cuts[k])) / np.maximum(other[f"total{k}"].to_numpy(), 1)[first]
                costs[k].append(np.where(seen > 0, _units(np.log(backed) - np.log(share + backed)), 0))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        costs = np.array([np.concatenate(c) for c in costs])
        order = np.argsort(keys)
        keys, counts, costs = keys[order], counts[order], costs[:, order]
        frequent = (counts * HEAVY >= self.all_words) & (self.all_words > 0)
        usual = [squeezed(steps(keys[~frequent])), *(squeezed(unsigned(c[~frequent])) for c in costs)]
        heavy = [keys[frequent].view(np.int64).tolist(), costs[:, frequent].ravel().tolist()]
        return arrow_table([[v] for v in (key[0].as_py(), *usual, *heavy)], COSTS)


def fit(trusted: DataFrame) -> Model:
    """The model of ``trusted`` (text, fold), for each fold that of the texts outside it.

    Lower orders count the different words seen before (continuation counts); a word without any is unknown, and
    the mass left to unknown words goes to shapes as the words with a single count have them. The driver gets
    a row of sums and at most 2 * HEAVY frequent keys.

    Pairs are counted in buckets of hash ranges. A bucket asks for the figures of its different words, so no pair
    becomes a row; that is done in ``ROUNDS`` parts of the buckets, which bounds what lies on disk at once.
    """
    spark = trusted.sparkSession
    trusted_path, trusted = materialize_at(spark, trusted.select("text", "fold"))
    size = trusted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    blocks = map_texts(trusted, BLOCKS, _pair_blocks(count), limit=BLOCK_BYTES)
    counted_pairs = blocks.groupBy("bucket").applyInArrow(_count_bucket, PAIRS).withColumn("turn", F.col("bucket") % ROUNDS)
    pairs_path, pairs = materialize_at(spark, counted_pairs, "turn")
    discard(spark, trusted_path)
    few = [F.sum(F.element_at("few", k * 4 + j)).alias(f"{k}_{j}") for k in range(FOLDS) for j in (1, 2, 3, 4)]
    row = pairs.agg(F.sum("n").alias("n"), *few).first()
    cuts, all_words = _discounts(row), row["n"] or 0
    packed = pairs.select("words", "first", "second", *[f"f{k}" for k in range(FOLDS)])
    sums = packed.mapInArrow(_word_figures, "word long, " + ", ".join(f"{c} long" for c in FIGURES))
    figures, costs = Buckets(spark, "word", count), Buckets(spark, "bucket", count)
    figures.add(sums.repartition(count, "word").groupBy("word").agg(*[F.sum(c).alias(c) for c in FIGURES]))
    words = figures.read()

    look = F.col("word").bitwiseAND(F.lit(SHAPE_BITS))
    shapes = [F.count_if((F.col(f"c{k}") == 1) & (look == s)).alias(f"{k}_shape{s}") for k in range(FOLDS) for s in range(SHAPES)]
    row = words.agg(*_tally("c"), *[F.sum(f"c{k}").alias(f"{k}_all") for k in range(FOLDS)], *shapes).first()
    low_cuts = _discounts(row)
    unknown = np.empty((FOLDS, SHAPES))
    for k in range(FOLDS):
        cut = sum(d * (row[f"{k}_{j}"] or 0) for d, j in zip(low_cuts[k], ("1", "2", "more")))
        rest = cut / row[f"{k}_all"] if row[f"{k}_all"] else 1.0
        seen = np.array([row[f"{k}_shape{s}"] or 0 for s in range(SHAPES)], dtype=float) + 1
        unknown[k] = rest * seen / seen.sum()
    guess = np.round(-np.log(unknown) * UNIT).astype(np.int64)

    def costed(key: tuple, own: pa.Table, rows: pa.Table) -> pa.Table:
        return scale.bucket(key, own, rows)

    scale = Scale(cuts, low_cuts, [float(row[f"{k}_all"] or 1) for k in range(FOLDS)], unknown, guess, all_words)
    for turn in range(ROUNDS):
        place = f"{pairs_path}/turn={turn}"
        part = spark.read.schema(PAIRS).parquet(place) if exists(spark, place) else pairs.drop("turn").limit(0)
        asked = part.select("bucket", "words").mapInArrow(_words_of_buckets, "word long, bucket int")
        own = words.withColumn("bucket", bucket_of(F.col("word"), count)).withColumn("own", F.lit(True))
        met = asked.hint("merge").join(words, "word").withColumn("own", F.lit(False))
        met = met.unionByName(own.filter(F.col("bucket") % ROUNDS == turn))
        costs.add(part.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(costed, COSTS))
        discard(spark, place)
    discard(spark, pairs_path)
    figures.drop()
    costs.close()
    heavy = costs.read().select("heavy", "heavy_costs").filter(F.size("heavy") > 0).toArrow()
    keys = np.concatenate([np.empty(0, dtype=np.int64), *(np.array(v, dtype=np.int64) for v in heavy["heavy"].to_pylist())])
    values = [np.array(v, dtype=np.int64).reshape(FOLDS, -1) for v in heavy["heavy_costs"].to_pylist()]
    order = np.argsort(keys)
    return Model(costs, keys[order], np.concatenate([np.empty((FOLDS, 0), dtype=np.int64), *values], axis=1)[:, order], guess)


def fold() -> Column:
    """The part of a text, equal for copies: it is scored by the model that counts the other parts."""
    return F.pmod(F.xxhash64(F.lit("limits"), F.coalesce(F.col("text"), F.lit(""))), F.lit(FOLDS)).cast("int")


TEXTS = "bucket int, slice long, keys binary, texts binary, n binary, head binary"
REPLIES = "slice long, texts binary, costs binary, head binary"


def _text_blocks(model: Model) -> Callable:
    """Keys of a slice of texts, a block for each bucket: keys in order, the texts with their folds, numbers. The first
    block of a slice has its head: the hashes of its different texts, their words and the costs known here."""
    shared = (model.heavy, model.heavy_costs, model.unknown, model.costs.count)

    def make():
        heavy, heavy_costs, unknown, count = shared
        keys = Keys()
        number = itertools.count()

        def work(part: pa.RecordBatch) -> dict:
            own = np.array([part.column(c).to_numpy() for c in ("high", "low", "fold")], dtype=np.int64)
            _, first = np.unique(own, axis=1, return_index=True)
            own = own[:, first]
            texts = [keys.of(part.column("text")[int(i)].as_py()) for i in first]
            sizes = np.array([len(t) for t in texts])
            doc = np.repeat(np.arange(len(texts)), sizes)
            token = np.concatenate(texts)
            last = np.cumsum(sizes) - 1
            inner = np.ones(len(token), dtype=bool)
            inner[last] = False
            begins = np.zeros(len(token), dtype=bool)
            begins[last - sizes + 1] = True
            folds = own[2][doc]
            local = np.zeros(len(texts), dtype=np.int64)
            looks = (token & np.uint64(SHAPE_BITS)).astype(np.int64)
            np.add.at(local, doc[~begins], unknown[folds[~begins], looks[~begins]])
            at = np.flatnonzero(inner)
            key = np.concatenate((token, pair_keys(token[at], token[at + 1])))
            doc = np.concatenate((doc, doc[at]))
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            if len(heavy):
                place = np.minimum(np.searchsorted(heavy, key.view(np.int64)), len(heavy) - 1)
                hit = heavy[place] == key.view(np.int64)
                np.add.at(local, doc[hit], heavy_costs[own[2][doc[hit]], place[hit]])
                key, doc = key[~hit], doc[~hit]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            starts = np.flatnonzero(new)
            key, doc, n = key[starts], doc[starts], np.diff(np.append(starts, len(key)))
            place = (TaskContext.get().partitionId(), next(number))
            name = xxhash.xxh3_64_intdigest(own.tobytes() + repr(place).encode()) >> 1
            head = squeezed(np.concatenate((own[0], own[1], sizes - 2, local)))
            doc = doc * FOLDS + own[2][doc]
            edges = np.searchsorted(buckets_of(key, count), np.arange(count + 1))
            blocks = [
                (b, name, *map(squeezed, (steps(key[s:e]), doc[s:e], n[s:e])), None)
                for b, (s, e) in enumerate(pairwise(edges.tolist()))
                if s < e
            ]
            nothing = squeezed(n[:0])
            blocks.append((name % count, name, nothing, nothing, nothing, head))
            return dict(zip(("bucket", "slice", "keys", "texts", "n", "head"), zip(*blocks)))

        return work

    return make


def _score_bucket(costs: pa.Table, blocks: pa.Table) -> pa.Table:
    """What the keys of a bucket add to the cost of the texts in each block."""
    keys, values = np.empty(0, dtype=np.uint64), np.empty((FOLDS, 0), dtype=np.int64)
    for row in costs.to_pylist():
        keys = np.cumsum(unsqueezed(row["keys"], np.uint64), dtype=np.uint64)
        values = np.array([signed(unsqueezed(row[f"v{k}"])) for k in range(FOLDS)])
    found = []
    for row in zip(*(blocks[c].to_pylist() for c in ("slice", "keys", "texts", "n", "head"))):
        name, key, doc, n, head = row[0], np.cumsum(unsqueezed(row[1], np.uint64), dtype=np.uint64), *map(unsqueezed, row[2:4]), row[4]
        places, sums = doc[:0], n[:0]
        if len(keys) and len(key):
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == key)
            doc, cost = doc[hit], n[hit] * values[doc[hit] % FOLDS, place[hit]]
            sums = np.zeros(doc.max() // FOLDS + 1 if len(doc) else 0, dtype=np.int64)
            np.add.at(sums, doc // FOLDS, cost)
            places = np.flatnonzero(sums)
            sums = sums[places]
        if len(places) or head:
            found.append((name, squeezed(steps(places)), squeezed(unsigned(sums)), head))
    return arrow_table(list(zip(*found)) if found else [[]] * 4, REPLIES)


def _sum_slice(replies: pa.Table) -> pa.Table:
    """The whole cost of each text of a slice."""
    heads = [h for h in replies["head"].to_pylist() if h is not None]
    if len(heads) != 1:
        raise RuntimeError("a slice of texts was read twice with different rows")
    high, low, words, cost = unsqueezed(heads[0]).reshape(4, -1).copy()
    for at, value in zip(replies["texts"].to_pylist(), replies["costs"].to_pylist()):
        cost[np.cumsum(unsqueezed(at))] += signed(unsqueezed(value))
    return pa.table({"high": high, "low": low, "n_words": words, "_cost": cost})


def surprisals(docs: DataFrame, model: Model, carry: str | None = None) -> DataFrame:
    """(doc_id, lang, n_words, surprisal): summed negative log probability of each whole text and of its end
    under the model for its ``fold``, and the binary column ``carry``.

    A text is known by 128 bits of hash, and copies get one result. The keys of a slice of texts go to the buckets of
    the model in blocks, and sums per text come back. That is done in ``ROUNDS`` parts of the texts, which bounds
    what lies on disk at once. ``docs`` must give its rows in the same partitions and order when a task is repeated.
    """
    spark = docs.sparkSession
    carried = [carry] if carry else []
    name = [F.xxhash64(F.lit(part), F.coalesce(F.col("text"), F.lit(""))).alias(part) for part in ("high", "low")]
    named = docs.select("doc_id", "lang", "text", "fold", *carried, *name)
    sums = []
    for turn in range(ROUNDS):
        part = named.filter(F.pmod(F.col("high"), F.lit(ROUNDS)) == turn).select("text", "fold", "high", "low")
        blocks = map_texts(part, TEXTS, _text_blocks(model), limit=BLOCK_BYTES)
        replies = model.costs.read().groupBy("bucket").cogroup(blocks.groupBy("bucket")).applyInArrow(_score_bucket, REPLIES)
        sums.append(materialize(spark, replies.groupBy("slice").applyInArrow(_sum_slice, "high long, low long, n_words long, _cost long")))
    whole = reduce(DataFrame.unionByName, sums).groupBy("high", "low").agg(F.max("_cost").alias("_cost"), F.max("n_words").alias("n_words"))
    surprisal = (F.col("_cost") / UNIT).alias("surprisal")
    return named.join(sized_side(whole), ["high", "low"], "left").select("doc_id", "lang", "n_words", surprisal, *carried)


def _blended(rows: DataFrame, basis: DataFrame, marks: dict[str, Column], even: float) -> DataFrame:
    """``rows`` with each figure of the basis: the language's own and that over all, weighed by rows.

    A language with ``even`` rows weighs as much as all together, one without rows, or null, nothing.
    """
    count = F.count(F.lit(1))
    own = basis.filter("lang IS NOT NULL").groupBy("lang")
    own = sized_side(own.agg(count.alias("_n"), *(m.alias(f"_own_{k}") for k, m in marks.items())))
    overall = basis.agg(*(m.alias(f"_all_{k}") for k, m in marks.items()))
    share = F.coalesce(F.col("_n") / (F.col("_n") + even), F.lit(0.0))
    found = rows.join(own, "lang", "left").crossJoin(F.broadcast(overall))
    for k in marks:
        every = F.col(f"_all_{k}")
        found = found.withColumn(k, every + share * (F.coalesce(f"_own_{k}", every) - every))
    return found.select(*rows.columns, *marks)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    low: float = 0.002,
    high: float = 0.99,
    slack: float = 0.06,
    prior: float = 20.0,
    even: float = 50.0,
    unsure: float = 10.0,
    carry: str | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, lang, text): perplexity, the limits of its language, kept.

    Trusted are documents labelled quality 1 and not toxic. Texts fall into ``FOLDS`` parts, and each is
    scored by a model that counts the trusted texts of the other parts, so every trusted row helps to set its
    language's quantiles of the mean surprisal and none is judged by itself. A document is kept while its own
    mean lies between them, widened by ``slack`` nats and ``unsure`` nats over the number of trusted rows: text
    of odd shape has a high perplexity and monotonous text a low one. The mean is smoothed with ``prior`` words
    of the language's median, so that a few words alone reject nobody. The figures of a language move from those
    over all languages to its own as its rows grow, half way at ``even`` of them; they are Spark's approximate
    percentiles at an accuracy of 1/10000. Without any trusted row with words there are no limits, and everything
    with words is kept.

    Null, empty or white text: perplexity null, not kept. Repeated rows get equal results. An
    empty table gives no rows. Long texts are scored whole. Extra columns are ignored
    but for a binary one named by ``carry``, which the result has too.
    """
    spark = docs.sparkSession
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long")).distinct()
    good = sized_side(good)
    carried = [carry] if carry else []
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"), *carried)
    texts = texts.withColumn("fold", fold())
    with shuffles_removed(spark):
        model = fit(texts.join(good, "doc_id", "left_semi"))
        try:
            scored = materialize(spark, surprisals(texts, model, carry))
        finally:
            model.costs.drop()
    mean = F.when(F.col("n_words") > 0, F.col("surprisal") / (F.col("n_words") + 1))
    checked = materialize(spark, scored.filter("n_words > 0").join(good, "doc_id", "left_semi"))

    smooth = (F.col("surprisal") + prior * F.coalesce("middle", mean)) / (F.col("n_words") + 1 + prior)
    middle = {"middle": F.percentile_approx(mean, 0.5, 10000)}
    centred, scored = _blended(checked, checked, middle, even), _blended(scored, checked, middle, even)
    ends = {"least": F.percentile_approx(smooth, low, 10000), "most": F.percentile_approx(smooth, high, 10000)}
    scored = _blended(scored, centred, ends, even)
    scored = scored.crossJoin(F.broadcast(checked.agg((slack + F.try_divide(F.lit(unsure), F.count(F.lit(1)))).alias("margin"))))
    lowest, highest = F.col("least") - F.col("margin"), F.col("most") + F.col("margin")
    inside = smooth.between(lowest, highest) | F.col("most").isNull()
    return scored.select(
        "doc_id",
        "lang",
        "n_words",
        F.exp(mean).alias("perplexity"),
        F.exp(smooth).alias("smoothed"),
        F.exp(lowest).alias("lowest"),
        F.exp(highest).alias("highest"),
        ((F.col("n_words") > 0) & inside).alias("kept"),
        *carried,
    )
