"""Language of texts by a byte convolutional network, trained and applied with numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.llm.common import map_texts

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 192
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 6
EPOCHS = 8
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

PAD, GAP = 0, 1


def byte_classes() -> np.ndarray:
    """Class of each byte: letters a-z and bytes over 127 have their own, all else is a gap."""
    classes = np.full(256, GAP, dtype=np.uint8)
    classes[97:123] = np.arange(2, 28)
    classes[128:] = np.arange(28, 156)
    return classes


CLASSES = 156


@dataclass
class Network:
    """Filters as one table per place (class to filters), then a softmax layer."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray

    def pooled(self, windows: np.ndarray, places: bool = False):
        """Largest response of every filter in each window, and where it is."""
        best, where = [], []
        for table, bias in zip(self.tables, self.bias):
            span = windows.shape[1] - len(table) + 1
            total = np.take(table[0], windows[:, :span], axis=0)
            for k in range(1, len(table)):
                total += np.take(table[k], windows[:, k : k + span], axis=0)
            if places:
                at = total.argmax(axis=1)
                where.append(at)
                best.append(np.take_along_axis(total, at[:, None], axis=1)[:, 0] + bias)
            else:
                best.append(total.max(axis=1) + bias)
        return np.concatenate(best, axis=1), where

    def log_odds(self, windows: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages per window."""
        found = np.empty((len(windows), len(self.languages)), dtype=np.float32)
        for at in range(0, len(windows), 256):
            pooled, _ = self.pooled(windows[at : at + 256])
            found[at : at + 256] = np.maximum(pooled, 0) @ self.out + self.shift
        return found - np.logaddexp.reduce(found, axis=1, keepdims=True)


def windows_of(text: str, classes: np.ndarray) -> np.ndarray:
    """The whole text as rows of WINDOW byte classes, the last one padded. Rows start within the
    previous one by a filter's width, so no place is cut through."""
    data = classes[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    step = WINDOW - max(WIDTHS) + 1
    rows = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros((rows - 1) * step + WINDOW, dtype=np.uint8)
    padded[: len(data)] = data[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def train(texts: list[str], labels: list[str], seed: int = 11) -> Network:
    """Fit the network to windows spread over the labelled texts; some are shortened, so that short texts are known."""
    languages = sorted(set(labels))
    draw = np.random.default_rng(seed)
    classes = byte_classes()
    rows, truth = [], []
    for text, label in zip(texts, labels):
        if not LETTER.search(text):
            continue
        found = windows_of(text, classes)
        pick = np.unique(np.linspace(0, len(found) - 1, WINDOWS_PER_DOC).astype(int))
        rows.append(found[pick])
        truth += [languages.index(label)] * len(pick)
    net = Network(
        languages,
        [draw.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        draw.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), dtype=np.float32),
    )
    if not rows or len(languages) < 2:
        return net
    x, y = np.concatenate(rows), np.array(truth)
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, slope: np.ndarray, rate: float) -> None:
        first, second = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        first += 0.1 * (slope - first)
        second += 0.01 * (slope * slope - second)
        value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)

    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.001
        for at in np.array_split(draw.permutation(len(x)), max(1, len(x) // 128)):
            step += 1
            part, label = x[at].copy(), y[at]
            short = draw.random(len(part)) < 0.4
            ends = draw.integers(8, WINDOW, len(part))
            part[short[:, None] & (np.arange(WINDOW) >= ends[:, None])] = PAD
            pooled, where = net.pooled(part, places=True)
            active = np.maximum(pooled, 0)
            score = active @ net.out + net.shift
            chance = np.exp(score - np.logaddexp.reduce(score, axis=1, keepdims=True))
            chance[np.arange(len(label)), label] -= 1
            chance /= len(label)
            back = (chance @ net.out.T) * (pooled > 0)
            adam("out", net.out, active.T @ chance + 1e-4 * net.out, rate)
            adam("shift", net.shift, chance.sum(axis=0), rate)
            for i, width in enumerate(WIDTHS):
                slope = back[:, i * FILTERS : (i + 1) * FILTERS]
                change = np.zeros_like(net.tables[i])
                filters = np.broadcast_to(np.arange(FILTERS), slope.shape)
                for k in range(width):
                    seen = np.take_along_axis(part, where[i] + k, axis=1)
                    np.add.at(change[k], (seen, filters), slope)
                adam(f"table{i}", net.tables[i], change, rate)
                adam(f"bias{i}", net.bias[i], slope.sum(axis=0), rate)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Up to ``per_language`` labelled rows of each language, the smallest by hash, never held-out ones.

    A threshold per language from its row count leaves a few more than wanted; a top-k by hash trims.
    """
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for lang, n in sorted(counts.items()):
        limit = int(min(1.0, 1.5 * per_language / n) * (1 << 32))
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
        rows = usable.filter((F.col("lang") == lang) & (place < limit))
        parts.append(rows.select("lang", "text", place.alias("place"), "doc_id").orderBy("place", "doc_id", "text").limit(per_language))
    if not parts:
        return usable.select("lang", "text").limit(0)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("lang", "text")


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row by the mean log probability of all windows."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        classes, net = byte_classes(), shared.value

        def work(part: pa.RecordBatch) -> dict:
            texts = part.column("text").to_pylist()
            known = [bool(t and LETTER.search(t)) and bool(net.languages) for t in texts]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            rows = [windows_of(t, classes) for t, k in zip(texts, known) if k]
            if rows:
                x = np.concatenate(rows)
                weight = (x > GAP).sum(axis=1) + 0.01
                odds = net.log_odds(x) * weight[:, None]
                starts = np.cumsum([0, *(len(r) for r in rows)])[:-1]
                mean = np.add.reduceat(odds, starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
                chance = np.exp(mean - np.logaddexp.reduce(mean, axis=1, keepdims=True))
                for i, row in zip(np.flatnonzero(known), chance):
                    names[i] = net.languages[int(row.argmax())]
                    scores[i] = min(1.0, float(row.max()))
            return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": names, "score": scores}

        return work

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return map_texts(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)


def language_ids(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Train on a bounded sample of labelled rows of ``docs`` (doc_id, text, lang) and name every row's language.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything when no row is labelled.
    Null doc_id: not held out, not used for training. Repeated rows get equal results. Long texts are read whole.
    Extra columns are ignored. An empty table gives no rows.
    """
    sample = training_rows(docs.select("doc_id", "lang", "text"), per_language).collect()
    net = train([r.text for r in sample], [r.lang for r in sample])
    return identify(docs, net)
