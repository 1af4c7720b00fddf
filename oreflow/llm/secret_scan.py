"""Secrets in texts, by a trigram index over each slice of documents.

A rule is a regular expression and a minimum length. From the expression's parsed form comes a
Boolean query over trigrams that every match must contain (an AND of ORs). A slice of documents
is indexed once for the trigrams the rules ask for; the query intersects postings, and the
expression runs over the remaining documents. A rule without a mandatory trigram runs over all.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.llm.common import map_texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The base rules of the contract, then formats published by the services that issue the keys.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{20,}"),
)
RULES = BASE + MORE

MOST_STRINGS = 64


def mandatory_trigrams(rule: Rule) -> list[frozenset[bytes]]:
    """AND of ORs: each set holds trigrams of which every match contains one; empty when there is none.

    Letters are lower-cased, as the index is. Runs of literals, small classes, alternatives and groups
    are expanded to their possible strings, as long as these are few.
    """
    wanted: list[frozenset[bytes]] = []

    def close(strings: set[str]) -> None:
        tails = [s.lower().encode() for s in strings]
        if tails and all(len(s) >= 3 for s in tails):
            for at in range(min(len(s) for s in tails) - 2):
                wanted.append(frozenset(s[at : at + 3] for s in tails))

    def expand(items) -> set[str] | None:
        """All strings of a sequence, or None when they are many or endless."""
        strings = {""}
        for op, value in items:
            if op is sre.LITERAL:
                more = {chr(value)}
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in value):
                more = {chr(v) for _, v in value}
            elif op is sre.SUBPATTERN:
                more = expand(value[3])
            elif op is sre.BRANCH:
                found = [expand(b) for b in value[1]]
                more = set().union(*found) if all(f is not None for f in found) else None
            elif op is sre.MAX_REPEAT and value[1] <= 4:
                one = expand(value[2])
                more = None if one is None else {"".join([s] * n) for s in one for n in range(value[0], value[1] + 1)} if len(one) == 1 else None
            else:
                more = None
            if more is None or len(strings) * len(more) > MOST_STRINGS:
                return None
            strings = {a + b for a in strings for b in more}
        return strings

    def walk(items) -> None:
        run: set[str] = {""}
        for item in items:
            found = expand([item])
            if found is not None and len(run) * len(found) <= MOST_STRINGS:
                run = {a + b for a in run for b in found}
                continue
            close(run)
            run = {""}
            op, value = item
            if op is sre.SUBPATTERN:
                walk(value[3])
            elif op is sre.MAX_REPEAT and value[0] >= 1:
                walk(value[2])
        close(run)

    walk(parser.parse(rule.pattern))
    return list(dict.fromkeys(wanted))


class Index:
    """Postings of the wanted trigrams over one slice of texts."""

    def __init__(self, trigrams: list[bytes]):
        self.codes = np.sort(np.array([int.from_bytes(t, "big") for t in set(trigrams)], dtype=np.int32))
        self.slot = np.zeros(1 << 24, dtype=np.uint16)
        self.slot[self.codes] = np.arange(1, len(self.codes) + 1, dtype=np.uint16)
        self.lower = np.arange(256, dtype=np.int32)
        self.lower[65:91] += 32

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Trigram to the sorted numbers of the texts that contain it."""
        ends = np.cumsum([len(t) + 2 for t in texts])
        data = self.lower[np.frombuffer(b"".join(t + b"\0\0" for t in texts), dtype=np.uint8)]
        codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        slots = self.slot[codes]
        places = np.flatnonzero(slots)
        owners = np.searchsorted(ends, places, side="right")
        pairs = np.unique(slots[places].astype(np.int64) * len(texts) + owners)
        cuts = np.searchsorted(pairs, np.arange(1, len(self.codes) + 2) * len(texts))
        return {
            int(code).to_bytes(3, "big"): pairs[cuts[i] : cuts[i + 1]] - (i + 1) * len(texts)
            for i, code in enumerate(self.codes)
        }


def candidates(query: list[frozenset[bytes]], postings: dict[bytes, np.ndarray], rows: int) -> np.ndarray:
    """Numbers of the texts that satisfy the query; all texts for an empty query."""
    left = np.ones(rows, dtype=bool)
    for options in query:
        hit = np.zeros(rows, dtype=bool)
        for trigram in options:
            hit[postings[trigram]] = True
        left &= hit
    return np.flatnonzero(left)


def spans_of(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; those whose group is too short are dropped afterwards."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): spans, an array of (kind, start, end, order).

    Places are code points of the whole text, ends are exclusive, spans come by start and then by
    the order of the rules. Spans of different kinds may overlap. Null or empty text: no spans.
    Repeated rows get equal results, an empty table gives no rows, extra columns are ignored.
    """

    def make():
        queries = [mandatory_trigrams(rule) for rule in rules]
        compiled = [rule.compiled() for rule in rules]
        index = Index([t for query in queries for options in query for t in options])

        def work(part: pa.RecordBatch) -> dict:
            texts = [t or "" for t in part.column("text").to_pylist()]
            raw = part.column("text").cast(pa.binary()).to_pylist()
            postings = index.postings([t or b"" for t in raw])
            found: list[list] = [[] for _ in texts]
            for order, (rule, query, pattern) in enumerate(zip(rules, queries, compiled)):
                for i in candidates(query, postings, len(texts)):
                    found[i] += [(start, order, end, rule.kind) for start, end in spans_of(rule, pattern, texts[i])]
            spans = [[{"kind": k, "start": s, "end": e, "rank": o} for s, o, e, k in sorted(f)] for f in found]
            return {"doc_id": part.column("doc_id"), "spans": spans}

        return work

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(rows, 'doc_id long, spans array<struct<kind: string, start: int, `end`: int, `rank`: int>>', make)


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(rule.kind).alias(f"n_{rule.kind}") for rule in BASE],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with every span of a secret replaced by ``[kind]`` and n_chars set anew.

    Overlapping spans are replaced together under the name of the first. Texts without secrets, null texts and
    all other columns stay as they are.
    """
    kinds = docs.schema
    spans_at = kinds.fieldNames().index("text")
    count_at = kinds.fieldNames().index("n_chars") if "n_chars" in kinds.fieldNames() else None

    def run(batches):
        queries = [mandatory_trigrams(rule) for rule in rules]
        compiled = [rule.compiled() for rule in rules]
        index = Index([t for query in queries for options in query for t in options])
        from oreflow.llm.common import slices

        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                postings = index.postings([(t or "").encode() for t in texts])
                found: list[list] = [[] for _ in texts]
                for rule, query, pattern in zip(rules, queries, compiled):
                    for i in candidates(query, postings, len(texts)):
                        found[i] += [(s, e, rule.kind) for s, e in spans_of(rule, pattern, texts[i] or "")]
                columns = list(part.columns)
                texts = [_mask(t, f) if f else t for t, f in zip(texts, found)]
                columns[spans_at] = pa.array(texts, type=columns[spans_at].type)
                if count_at is not None:
                    old = columns[count_at].to_pylist()
                    sizes = [len(t) if f else n for t, f, n in zip(texts, found, old)]
                    columns[count_at] = pa.array(sizes, type=columns[count_at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, kinds)


def _mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def base_hash(spans: list[tuple[str, int, int]]) -> str:
    """The digest of base spans, for checks."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
