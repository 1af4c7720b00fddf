"""Periodic runs of words, found through string synchronising sets."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.llm.common import map_texts, mixed

LEAST_WORDS = 6
LEAST_TURNS = 4
SMALL = 8
"""Periods below this (a power of two) come from highly periodic regions, found by comparing words directly."""


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document as the query's contract wants them: a tenth of the ids gets a periodic tail."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


@dataclass
class Corpus:
    """Word numbers of several texts in one array, each text followed by a number that no other place holds."""

    words: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> "Corpus":
        ends = [np.array([-1 - k], dtype=np.int64) for k in range(len(texts))]
        flat = [part for pair in zip(texts, ends) for part in pair]
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        words = np.concatenate(flat) if flat else np.empty(0, dtype=np.int64)
        return cls(words, np.cumsum(sizes) - sizes)


def _small_periods(words: np.ndarray) -> list[np.ndarray]:
    """(start, length, period) of every stretch long enough for one of the periods below ``SMALL``."""
    found = []
    for q in range(1, min(SMALL, len(words))):
        first, last = _stretches(words[q:] == words[:-q])
        size = last - first + q
        keep = size >= max(LEAST_WORDS, LEAST_TURNS * q)
        found.append(np.stack([first[keep], size[keep], np.full(keep.sum(), q)], axis=1))
    return found


def _extended(words: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The maximal stretch around ``at`` in which words ``q`` apart are equal: first word, and end of it."""
    low, step = at, 4 * q
    while low > 0:
        far = max(0, low - step)
        differ = np.flatnonzero(words[far:low] != words[far + q : low + q])
        if len(differ):
            low = far + int(differ[-1]) + 1
            break
        low, step = far, 2 * step
    high, step = at, 4 * q
    while high + q < len(words):
        far = min(len(words) - q, high + step)
        differ = np.flatnonzero(words[high:far] != words[high + q : far + q])
        if len(differ):
            high += int(differ[0])
            break
        high, step = far, 2 * step
    return low, high + q


def _proposals(marks: np.ndarray, context: np.ndarray, scale: int) -> np.ndarray:
    """(period, position) for neighbours of equal context whose distance is in [scale, 2 * scale)."""
    order = np.lexsort((marks, context))
    at, same = marks[order], context[order]
    gap = at[1:] - at[:-1]
    keep = (same[1:] == same[:-1]) & (gap >= scale) & (gap < 2 * scale)
    pairs = np.stack([gap[keep], at[:-1][keep]], axis=1)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _scaled(words: np.ndarray) -> list[np.ndarray]:
    """(start, length, period) for periods of ``SMALL`` and more, by synchronising sets of dyadic scales.

    At scale t a position belongs to the set if the hash of its t words, or of those t places later, is least
    among the t + 1 hashes between: a choice by content alone, so equal stretches choose equal places, and any t
    neighbouring positions hold one of the set. A run of period q in [t, 2t) has at least 4q >= 3t + q words. Within
    its first t words lies a place of the set whose context of 2t words comes again q words later, and no sooner,
    as 2t words are longer than the period. So next places of equal context propose every period; each proposal
    is then extended word by word, which decides.
    """
    found: list[list[int]] = []
    n = len(words)
    grams = mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    scale = 1
    while 4 * scale <= n:
        if scale >= SMALL:
            least = grams
            width = 1
            while width < scale + 1:  # minima over scale + 1 hashes, from overlapping halves
                step = min(width, scale + 1 - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            chosen = (least == grams[: len(least)]) | (least == grams[scale:])
            wide = mixed(grams[:-scale] * np.uint64(0xC2B2AE3D27D4EB4F) + grams[scale:])
            marks = np.flatnonzero(chosen[: len(wide)])
            done: dict[int, int] = {}
            for q, at in _proposals(marks, wide[marks], scale).tolist():
                if at < done.get(q, -1):
                    continue
                first, end = _extended(words, at, q)
                done[q] = end - q
                if end - first >= max(LEAST_WORDS, LEAST_TURNS * q):
                    found.append([first, end - first, q])
            grams = wide
        else:
            grams = mixed(grams[:-scale] * np.uint64(0xC2B2AE3D27D4EB4F) + grams[scale:])
        scale *= 2
    return [np.array(found, dtype=np.int64).reshape(-1, 3)]


def runs_of(corpus: Corpus) -> np.ndarray:
    """(text, start, length, period) of every run of every text, by text, start and period.

    A stretch with several periods is kept with its smallest one. No stretch crosses the end of a text: the
    number there is met nowhere else. Texts too short for a scale are left out of it.
    """
    words, starts = corpus.words, corpus.starts
    parts = _small_periods(words)
    sizes = np.diff(np.append(starts, len(words)))
    large = np.flatnonzero(sizes > LEAST_TURNS * SMALL)
    for low, high in _groups(sizes[large]):
        some = large[low:high]
        picked = np.concatenate([words[starts[k] : starts[k] + sizes[k]] for k in some.tolist()])
        base = np.cumsum(sizes[some]) - sizes[some]
        for rows in _scaled(picked):
            at = np.searchsorted(base, rows[:, 0], side="right") - 1
            rows[:, 0] += (starts[some] - base)[at]
            parts.append(rows)
    rows = np.concatenate(parts) if parts else np.empty((0, 3), dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    text = np.searchsorted(starts, rows[:, 0], side="right") - 1
    found = np.stack([text, rows[:, 0] - starts[text], rows[:, 1], rows[:, 2]], axis=1)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _groups(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of the texts into groups of about 2**15 words, so that arrays stay in the processor's cache and
    short texts skip the scales that only a long neighbour needs."""
    cuts = [0]
    total = 0
    for k, size in enumerate(sizes.tolist()):
        if total and total + size > 1 << 15:
            cuts.append(k)
            total = 0
        total += size
    return list(zip(cuts, [*cuts[1:], len(sizes)])) if len(sizes) else []


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its runs, and the text with the repeats of runs taken out.

    ``runs`` is a list of (start, length, period) in words, by start and period; ``collapsed`` the words that no
    run holds after its first period, joined by one space. With ``plant`` a tenth of the documents is first made
    periodic, see ``planted``. Documents are independent, so nothing is shuffled, whatever the keys.

    Null, empty and white text: no words, no runs, an empty ``collapsed``. Repeated rows and ids give a row each,
    a null id is kept (and never planted). Equal words are equal bytes. A text is worked on whole, however long.
    An empty table gives no rows. Extra columns are ignored.
    """

    def make():
        def work(part: pa.RecordBatch) -> dict:
            ids = part.column("doc_id").to_pylist()
            seen: dict[bytes, int] = {}
            texts, numbers = [], []
            for doc_id, text in zip(ids, part.column("text").to_pylist()):
                words = (text or "").encode().split()
                words = planted(words, doc_id) if plant else words
                texts.append(words)
                numbers.append(np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64))
            found = runs_of(Corpus.of(numbers))
            cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
            runs, kept = [], []
            for k, words in enumerate(texts):
                own = found[cuts[k] : cuts[k + 1], 1:].tolist()
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                if own:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    for s, n, q in own:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                kept.append(b" ".join(words).decode())
            return {"doc_id": ids, "runs": runs, "collapsed": kept}

        return work

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(narrow, schema, make)


def digest(found: DataFrame) -> DataFrame:
    """The runs of each document as numbers and hashes: the longest run (ties: smallest start, then period)."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = found.withColumn("_top", longest)
    length, period = F.col("_top.length"), -F.col("_top.p")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
