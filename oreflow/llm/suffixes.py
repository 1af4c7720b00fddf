"""Repeated byte strings of a corpus, by a difference cover and one bucket of suffixes at a time."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from oreflow.session import materialize, work_path

LENGTH = 200

# A perfect difference set, every distance modulo 133 is one of its differences.
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)

WINDOW = LENGTH - PERIOD + 1
PART_BYTES = 1 << 23
BUCKET_KEYS = 1 << 22
LEAST_KEYS = 64
HEAVY = 256
BLOCK = 1 << 15

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S, _T = np.uint64(29), np.uint64(32)


@dataclass(frozen=True)
class Layout:
    """Numbers of text parts and of buckets for samples and suffixes, from the bytes of the corpus.

    Parts and buckets have a fixed size until a part would give a bucket fewer than ``LEAST_KEYS`` keys; beyond
    that (about 4 TB) both grow with the root of the corpus.
    """

    parts: int
    sample_buckets: int
    suffix_buckets: int

    @classmethod
    def of(cls, total: int, part_bytes: int = PART_BYTES, bucket_keys: int = BUCKET_KEYS) -> "Layout":
        grown = max(1.0, math.sqrt(LEAST_KEYS * total / (part_bytes * bucket_keys)))
        keys = bucket_keys * grown
        count = lambda n, size: max(1, math.ceil(n / size))
        return cls(count(total, part_bytes * grown), count(total * len(COVER) / PERIOD, keys), count(total, 2 * keys))


# fingerprints ---------------------------------------------------------------------------------


def _step(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One fingerprint of two neighbouring ones."""
    h = left * _A
    h ^= h >> _S
    h += right
    h *= _B
    h ^= h >> _T
    return h


def _words(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as a view."""
    return np.ndarray(max(0, len(flat) - 7), dtype="<u8", buffer=flat, strides=(1,))


def sample_names(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of the ``WINDOW`` bytes from each position on."""
    words = _words(flat)
    h = np.zeros(len(at), dtype=np.uint64)
    for shift in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        h = _step(h, words[at + shift])
    return h


def suffix_keys(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, bucket hash) of the ``LENGTH`` bytes from every position on, by doubling from 8 to 128 bytes."""
    n = len(flat) - LENGTH + 1
    keys, places = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        h, size = _words(flat[low : high + LENGTH - 1]).copy(), 8
        while size < 128:
            h, size = _step(h[:-size], h[size:]), 2 * size
        first, second = h[: high - low], h[LENGTH - 128 : LENGTH - 128 + high - low]
        keys[low:high] = _step(first, second)
        places[low:high] = _step(second * _C, first)
    return keys, places


# one part of the texts ------------------------------------------------------------------------


class Part:
    """The texts of one part in one array, with their cover sample."""

    def __init__(self, texts: pa.Table):
        column = texts.column("text").combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        self.ids = texts.column("id").to_pylist()
        self.first = (offsets[:-1] - offsets[0]).astype(np.int64)
        self.end = (offsets[1:] - offsets[0]).astype(np.int64)
        self.flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        cover = np.array(COVER)
        at = []
        for low, high in zip(self.first.tolist(), self.end.tolist()):
            own = (np.arange(low, high, PERIOD)[:, None] + cover[None]).ravel()
            at.append(own[: np.searchsorted(own, high - WINDOW, side="right")])
        self.at = np.concatenate(at) if at else np.empty(0, dtype=np.int64)

    def names(self, buckets: int) -> np.ndarray:
        """(bucket, 32 bits) of each sample in one number."""
        h = sample_names(self.flat, self.at)
        return ((h >> _T) % np.uint64(buckets) << _T) | (h & np.uint64(0xFFFFFFFF))

    def suffixes(self, repeated: np.ndarray, layout: Layout) -> "Suffixes":
        """Suffixes with a repeated sample among their first ``PERIOD`` positions; no other can have a twin.

        Two equal strings of ``LENGTH`` bytes hold, at one common distance below ``PERIOD``, positions that are
        both in the cover, so there both have the same sample.
        """
        names = self.names(layout.sample_buckets)
        hit = self.at[_member(names, repeated)]
        text = np.searchsorted(self.first, hit, side="right") - 1
        low = np.maximum(hit - PERIOD + 1, self.first[text])
        high = np.minimum(hit + 1, self.end[text] - LENGTH + 1)
        low, high = _joined(low, high, text)
        if not len(low):
            none = np.empty(0, dtype=np.uint64)
            return Suffixes(np.empty(0, dtype=np.int64), none, none)
        starts, keys, places = [], [], []
        for a, b in zip(low.tolist(), high.tolist()):
            key, place = suffix_keys(self.flat[a : b + LENGTH - 1])
            starts.append(np.arange(a, b))
            keys.append(key)
            places.append(place % np.uint64(layout.suffix_buckets))
        return Suffixes(np.concatenate(starts), np.concatenate(keys), np.concatenate(places))


@dataclass(frozen=True)
class Suffixes:
    starts: np.ndarray
    keys: np.ndarray
    buckets: np.ndarray

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order by bucket and key, the first of each different pair there, and pairs' keys and buckets."""
        order = np.lexsort((self.keys, self.buckets))
        keys, buckets = self.keys[order], self.buckets[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])
        return order, new, keys[new], buckets[new]


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    place = np.searchsorted(among, values)
    return among[np.minimum(place, len(among) - 1)] == values


def _joined(low: np.ndarray, high: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of one text made one; both ends must rise with the position."""
    keep = low < high
    low, high, text = low[keep], high[keep], text[keep]
    if not len(low):
        return low, high
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] > high[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return low[first], high[np.append(first[1:], len(low)) - 1]


def _rows(bucket: np.ndarray, values: np.ndarray, twice: np.ndarray, kind: str) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, values, packed marks of those met more than once) for sorted buckets."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if low < high:
            yield int(bucket[low]), values[low:high].astype(kind).tobytes(), np.packbits(twice[low:high]).tobytes()


KEYED = "bucket long, part int, keys binary, twice binary"
KEYED_ARROW = pa.schema([("bucket", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("twice", pa.binary())])
REPLY = "part int, kind int, bucket long, marks binary"
REPLY_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int64()), ("marks", pa.binary())])
FOUND = "id binary, n_removed long, spans array<struct<start: long, length: long>>, kept_sha256 string"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
FOUND_ARROW = pa.schema([("id", pa.binary()), ("n_removed", pa.int64()), ("spans", _SPAN), ("kept_sha256", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _keyed(part: int, bucket: np.ndarray, values: np.ndarray, twice: np.ndarray, kind: str) -> pa.Table:
    return _table([(b, part, keys, marks) for b, keys, marks in _rows(bucket, values, twice, kind)], KEYED_ARROW)


def _sampled(layout: Layout):
    def run(texts: pa.Table) -> pa.Table:
        names, n = np.unique(Part(texts).names(layout.sample_buckets), return_counts=True)
        return _keyed(texts.column("part")[0].as_py(), (names >> _T).astype(np.int64), names, n > 1, "<u4")

    return run


def _sorted_bucket(kind: str, number: int):
    """One bucket: sort its keys, and tell every part which of its own come up again, in their sorted order."""

    def run(rows: pa.Table) -> pa.Table:
        parts, buckets = rows.column("part").to_pylist(), rows.column("bucket").to_pylist()
        own = [np.frombuffer(k, dtype=kind) for k in rows.column("keys").to_pylist()]
        marks = [np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=len(k)).astype(bool) for k, t in zip(own, rows.column("twice").to_pylist())]
        keys = np.sort(np.concatenate([*own, *[k[m] for k, m in zip(own, marks)]]))
        again = keys[1:][keys[1:] == keys[:-1]]
        found = [np.packbits(_member(k, again)).tobytes() for k in own]
        return _table(list(zip(parts, [number] * len(parts), buckets, found)), REPLY_ARROW)

    return run


def _marks(replies: pa.Table, kind: int) -> dict[int, bytes]:
    """Marks of each bucket in the replies of one kind."""
    rows = zip(replies.column("kind").to_pylist(), replies.column("bucket").to_pylist(), replies.column("marks").to_pylist())
    return {bucket: marks for k, bucket, marks in rows if k == kind}


def _again(buckets: np.ndarray, marks: dict[int, bytes]) -> np.ndarray:
    """Marks of values sorted by bucket, as one array."""
    out = np.zeros(len(buckets), dtype=bool)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(buckets)]):
        if low < high:
            out[low:high] = np.unpackbits(np.frombuffer(marks[int(buckets[low])], dtype=np.uint8), count=high - low)
    return out


def _suffixes(texts: pa.Table, replies: pa.Table, layout: Layout) -> tuple[Part, Suffixes]:
    part = Part(texts)
    names = np.unique(part.names(layout.sample_buckets))
    return part, part.suffixes(names[_again((names >> _T).astype(np.int64), _marks(replies, 1))], layout)


def _proposed(layout: Layout):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([], KEYED_ARROW)
        _, found = _suffixes(texts, replies, layout)
        order, new, keys, buckets = found.sorted()
        n = np.diff(np.append(np.flatnonzero(new), len(order)))
        return _keyed(texts.column("part")[0].as_py(), buckets.astype(np.int64), keys, n > 1, "<u8")

    return run


def _decided(layout: Layout):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([], FOUND_ARROW)
        part, found = _suffixes(texts, replies, layout)
        order, new, _, buckets = found.sorted()
        again = _again(buckets.astype(np.int64), _marks(replies, 2))
        repeated = np.zeros(len(order), dtype=bool)
        repeated[order] = again[np.cumsum(new) - 1]
        starts = found.starts[repeated]
        text = np.searchsorted(part.first, starts, side="right") - 1
        low, high = _joined(starts, starts + LENGTH, text)
        owner = np.searchsorted(part.first, low, side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(part.ids) + 1))
        rows = []
        for k, key in enumerate(part.ids):
            a, b = cuts[k], cuts[k + 1]
            if a == b:
                rows.append((key, 0, [], None))
                continue
            base, end = int(part.first[k]), int(part.end[k])
            sha, at = hashlib.sha256(), base
            for i, j in zip(low[a:b].tolist(), high[a:b].tolist()):
                sha.update(part.flat[at:i])
                at = j
            sha.update(part.flat[at:end])
            spans = [{"start": i - base, "length": j - i} for i, j in zip(low[a:b].tolist(), high[a:b].tolist())]
            rows.append((key, int((high[a:b] - low[a:b]).sum()), spans, sha.hexdigest()))
        return _table(rows, FOUND_ARROW)

    return run


# the corpus -----------------------------------------------------------------------------------


def _once_per_task(df: DataFrame) -> DataFrame:
    """Texts without the copies that a task meets among up to a million of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            keep = []
            for key in batch.column("id").to_pylist():
                keep.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def repeated_in_texts(texts: DataFrame, layout: Layout) -> DataFrame:
    """(id, n_removed, spans, kept_sha256) for each of the different texts (id, text), of ``LENGTH`` bytes or more.

    ``kept_sha256`` is null where nothing is removed. Texts are dealt to parts by their id. Three passes over the
    parts (one shuffle of the texts, read again): the samples of the cover go to buckets by their fingerprint, where
    sorting tells which come up again; suffixes with such a sample near their start go to buckets by the fingerprint
    of their ``LENGTH`` bytes, and one bucket is sorted at a time; what comes back, a bit per key, decides. What a
    part sends to a bucket is one row of different keys, so copies within a part cost nothing, a string that a third
    of all texts hold is one key per part, and memory is one part or one bucket. A sample's key has 32 bits below its
    bucket's number: a clash only proposes a suffix that the next step turns down. A suffix's has 64, with buckets
    from other bits of the fingerprint.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(layout.parts)).cast("int")
    placed = _once_per_task(texts.select(part.alias("part"), "id", F.col("text").cast("binary").alias("text")))
    placed = placed.repartition(layout.parts, "part")
    first = Window.partitionBy("part", "id").orderBy("id")
    placed = placed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    by_part = placed.groupBy("part")
    samples = by_part.applyInArrow(_sampled(layout), KEYED).repartition(layout.sample_buckets, "bucket")
    met = samples.groupBy("bucket").applyInArrow(_sorted_bucket("<u4", 1), REPLY)
    suffixes = by_part.cogroup(met.groupBy("part")).applyInArrow(_proposed(layout), KEYED)
    suffixes = suffixes.repartition(layout.suffix_buckets, "bucket")
    again = suffixes.groupBy("bucket").applyInArrow(_sorted_bucket("<u8", 2), REPLY)
    return by_part.cogroup(met.unionByName(again).groupBy("part")).applyInArrow(_decided(layout), FOUND)


def remove_repeats(docs: DataFrame, part_bytes: int = PART_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the bytes covered by strings of 200 bytes met elsewhere too.

    Columns doc_id, n_bytes, n_removed, spans (start and length of the maximal removed runs, in bytes) and
    kept_sha256 of what is left. A text is its UTF-8 bytes; strings never cross texts, and are judged on the input.
    Only equality of 200 bytes matters, so suffixes are sorted by fingerprint, not by alphabet.

    Equal texts meet by their SHA-256 first, on narrow rows: each of 200 bytes or more is removed whole, and one of
    them stands for all in the search. Texts that make up over 1/256 of all rows (so 256 at most) are joined by
    broadcast; no other key has more rows than that. Null text counts as empty; a text below 200 bytes loses nothing;
    repeated rows and ids are judged each by its text, null ids are kept. An empty table gives no rows. A long text
    is worked on whole, in one part. Extra columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    keyed = keyed.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("id"), F.octet_length("text").cast("long").alias("n_bytes"))
    long_enough = F.col("n_bytes") >= LENGTH
    seen, path = Observation(), work_path(spark, "texts")
    narrow = keyed.select("doc_id", "id", "n_bytes")
    size = F.coalesce(F.sum(F.when(long_enough, F.col("n_bytes"))), F.lit(0)).alias("size")
    narrow.observe(seen, F.count(F.lit(1)).alias("rows"), size).write.parquet(path)
    rows = spark.read.schema(narrow.schema).parquet(path)
    layout = Layout.of(seen.get["size"], part_bytes, bucket_keys)
    found = repeated_in_texts(keyed.filter(long_enough).select("id", "text"), layout)

    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    heavy = materialize(spark, counts.filter(F.col("n") > F.lit(seen.get["rows"] / HEAVY)).filter("n > 1").select("id"))
    common = rows.join(F.broadcast(heavy), "id", "left_semi").withColumn("_copies", F.lit(2).cast("long"))
    others = rows.join(F.broadcast(heavy), "id", "left_anti")
    others = others.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("id"))).join(found, "id", "left")
    every = common.unionByName(others, allowMissingColumns=True)
    return every.select("doc_id", "n_bytes", *_judged(long_enough))


def _judged(long_enough: Column) -> list[Column]:
    whole = long_enough & (F.col("_copies") > 1)
    gone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length")))
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start: long, length: long>>"))
    return [
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, gone).otherwise(spans).alias("spans"),
        F.when(whole, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("id")))).alias("kept_sha256"),
    ]


def digest(found: DataFrame) -> DataFrame:
    spans = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", spans, "kept_sha256")
