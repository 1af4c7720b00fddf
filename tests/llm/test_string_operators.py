"""Repeated strings, whitening and periodic runs against plain versions on small fixtures."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oreflow.llm import runs, suffixes, whitening
from oreflow.llm.queries import QUERIES, SQL
from tests.llm.test_text_operators import DOCS, ODD, docs
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op13_periodic_runs"])
def test_equal_to_sql(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), connect(folder), SQL[name]) == ""


# repeated strings -----------------------------------------------------------------------------


def plain_repeats(texts, length=suffixes.LENGTH):
    """(n_bytes, n_removed, n_spans, sha) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=np.int8)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def found_repeats(spark, rows, **sizes):
    found = suffixes.digest(suffixes.remove_repeats(docs(spark, rows), **sizes)).collect()
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)


def test_cover_holds_every_distance():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("part_bytes", [1 << 23, 3000])
def test_repeats_of_shifted_passages(spark, part_bytes):
    draw = np.random.default_rng(5)

    def text(n):
        return "".join(draw.choice(list("abcdefgh é"), n))

    shared = [text(k) for k in (150, 198, 199, 200, 201, 333, 1000)]
    texts = [None, "", "short", "é" * 150, text(5000), "x" * 700]
    for _ in range(40):
        texts.append(text(int(draw.integers(0, 400))) + shared[int(draw.integers(0, 7))] + text(int(draw.integers(0, 300))))
    texts += [texts[10], texts[10], shared[6], shared[6][3:203], shared[6] + "!" + shared[5], "é" * 150]
    rows = [(i if i % 9 else None, t, "en", "a") for i, t in enumerate(texts)] + [(1, texts[20], "en", "a")]
    want = Counter((r[0], *w) for r, w in zip(rows, plain_repeats([r[1] for r in rows])))
    assert found_repeats(spark, rows, part_bytes=part_bytes, bucket_keys=500) == want


def test_repeats_of_odd_rows(spark):
    want = Counter((r[0], *w) for r, w in zip(ODD, plain_repeats([r[1] for r in ODD[:-2]] + ["word " * 400, ODD[-1][1]])))
    small = [*ODD[:-2], (6, "word " * 400, "de", "b"), ODD[-1]]
    assert found_repeats(spark, small) == want
    assert suffixes.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    nothing = suffixes.remove_repeats(docs(spark, [(1, None, None, None), (2, "a", None, None)])).collect()
    assert sorted((r.doc_id, r.n_removed, r.spans) for r in nothing) == [(1, 0, []), (2, 0, [])]


def test_a_frequent_text_and_a_frequent_passage(spark):
    """A third of the rows is one text, and most others share a passage."""
    passage = "some passage that very many of the texts hold, " * 5
    rows = [(i, "the very same text again and again, " * 8, "en", "a") for i in range(400)]
    rows += [(1000 + i, f"{i} {i * i} before {passage} and after {i}", "en", "a") for i in range(600)]
    found = {r.doc_id: r for r in suffixes.remove_repeats(docs(spark, rows)).collect()}
    assert all(found[i].n_removed == found[i].n_bytes for i in range(400))
    for i in range(600):
        head = len(f"{i} {i * i} before ")
        assert found[1000 + i].spans[0].start <= head and found[1000 + i].n_removed >= len(passage)


# whitening ------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n long, component string")


@pytest.mark.parametrize("values", [[9, 5, 4, 1, 0.5], [7, 7, 7, 2, 2, 1], [3, 3 - 1e-9, 1, 1e-9, 0, 0], [0, 0, 0], [1] * 12])
def test_eigenvectors(values):
    draw = np.random.default_rng(2)
    turn = np.linalg.qr(draw.normal(size=(len(values), len(values))))[0]
    matrix = (turn * np.array(values, dtype=float)) @ turn.T
    matrix = (matrix + matrix.T) / 2
    e, x = whitening.refined_eigenvectors(matrix)
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(matrix))[::-1], atol=1e-14)
    assert np.abs(matrix @ x - x * e).max() <= 4e-15 * max(1, max(values)) and np.abs(x.T @ x - np.eye(len(e))).max() <= 4e-15


def test_eigenvectors_are_better_than_their_start():
    draw = np.random.default_rng(4)
    a = draw.normal(size=(90, 40)) * np.exp(draw.normal(size=40))
    matrix = a.T @ a
    e, x = whitening.refined_eigenvectors(matrix)
    rough = np.linalg.eigh(matrix.astype(np.float32))[1].astype(float)
    error = lambda v: np.abs(matrix @ v - v * np.diag(v.T @ matrix @ v)).max() / e[0]
    assert error(x) < 1e-14 < 1e-9 < error(rough)


def test_whitened_rows(spark):
    draw = np.random.default_rng(9)
    data = (draw.normal(size=(500, 12)) @ draw.normal(size=(12, 12))).astype(np.float32)
    data[20:40] = data[:20]
    rows = [(i, data[i].tolist()) for i in range(500)]
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [1.0] * 11 + [float("nan")]), (903, [float("inf")] * 12), (904, []), (905, [1.0, 2.0])]
    found = whitening.whiten(vectors(spark, rows + odd)).collect()
    x = np.floor(1024 * data.astype(float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    c = x - total / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    want = c @ v[:, :8] / np.sqrt(e[:8])
    assert len(found) == 500 * 8 and {r.vec_id for r in found} == set(range(500))
    got = np.zeros((500, 8))
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - total) ** 2).sum())
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12 and r.identity_error < 1e-10
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = whitening.whiten(vectors(spark, [(None, [1.0, 5.0]), (None, [2.0, 5.0]), (3, [4.0, 5.0]), (3, [4.0, 5.0])])).collect()
    assert len(flat) == 4 and {r.component for r in flat} == {1} and all(r.explained == 1.0 for r in flat)
    large = whitening.whiten(vectors(spark, [(1, [1e30, 1.0]), (2, [9e5, 0.0]), (3, [-9e5, 1.0])])).collect()
    assert {r.vec_id for r in large} == {2, 3}
    assert whitening.Centre(10**9, (5, 7)).deviations(np.array([[10**9, 3]])) == [None]


# periodic runs --------------------------------------------------------------------------------


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at < len(words) - q:
            end = at
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            size = end - at + q
            smaller = any(all(words[i] == words[i + p] for i in range(at, at + size - p)) for p in range(1, q))
            if end > at and size >= max(6, 4 * q) and not smaller:
                out.append((at, size, q))
            at = max(end, at + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(texts):
    return runs.Corpus.of([np.array(t, dtype=np.int64) for t in texts])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4), st.integers(1, 30), st.integers(3, 6), st.integers(0, 9))
def test_runs_are_the_plain_ones(texts, period, turns, cut):
    tail = [(k * k) % 7 for k in range(period)] * turns
    texts = [*texts, [5, 6, *tail[: len(tail) - cut]], tail + tail[::-1]]
    want = [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]
    assert [tuple(r) for r in runs.runs_of(numbered(texts)).tolist()] == want


def test_runs_of_long_periods():
    draw = np.random.default_rng(11)
    for period in (8, 9, 15, 16, 17, 100, 255, 256, 1000):
        unit = draw.integers(0, 1000, period).tolist()
        text = draw.integers(0, 1000, 50).tolist() + (unit * 5)[: 4 * period + 3] + [5000, 1, 2]
        found = [tuple(r) for r in runs.runs_of(numbered([[1, 2], text, text[:60]])).tolist()]
        assert (1, 50, 4 * period + 3, period) in found or any(q == period and n >= 4 * period + 3 for _, _, n, q in found)


def plain_collapse(words):
    gone = {i for s, n, q in plain_runs(words) for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_documents_with_runs(spark):
    texts = ["a b c " * 9, "x x x x x x", "x x x x x", "one  two\tthree\n" * 4 + "four", "é é " * 20 + "end"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + ODD
    found = runs.periodic_runs(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    for (i, t, *_), r in zip(rows[:5], found[:5]):
        words = t.encode().split()
        assert r.doc_id == i and [(x.start, x.length, x.period) for x in r.runs] == plain_runs(words)
        assert r.collapsed.encode() == b" ".join(plain_collapse(words))
    hot = next(r for r in found if r.collapsed == "word")
    assert [(x.start, x.length, x.period) for x in hot.runs] == [(0, 30_000, 1)]
    assert runs.digest(runs.periodic_runs(spark.createDataFrame([], DOCS))).collect() == []
    none = runs.digest(runs.periodic_runs(docs(spark, [(1, None, None, None)]))).first()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(none) == (1, 0, None, None, None, None, empty, empty)


def test_planted_tail():
    words = [b"w%d" % i for i in range(50)]
    hit = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    g = zlib.crc32(str(hit).encode()) // 10
    a = g % 50
    p = 1 + (50 - a) // (3 + g % 8)
    assert runs.planted(words, hit) == [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    assert runs.planted(words, None) == words and runs.planted([], hit) == []
