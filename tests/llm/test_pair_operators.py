"""Near-duplicates, vectors, pages, quality and the pipeline against plain versions on small fixtures."""

import re
from collections import Counter
from contextlib import nullcontext
from dataclasses import replace
from itertools import combinations, pairwise
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from oreflow.llm import near_dup, pages, quality, topk, vectors
from oreflow.llm.common import signed, squeezed, steps, unsigned, unsqueezed
from oreflow.llm.components import components
from oreflow.llm.queries import QUERIES, SQL
from oreflow.session import shared_dir, work_path
from tests.llm.test_text_operators import DOCS, ODD, docs
from tests.oracle import compare, connect


def reachable(ids, links):
    label = {i: i for i in ids}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


# components -----------------------------------------------------------------------------------


def test_components(spark):
    draw = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    links += [(int(a), int(b)) for a, b in draw.integers(200, 300, (60, 2))]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == reachable({i for p in real for i in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# near-duplicate documents ---------------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_dedup(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links = []
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            links.append((a, b))
    label = reachable(list(texts), links)
    return {(i, len(sets[i]), label[i], label[i] == i) for i in texts}


def varied(draw, words, changes):
    words = list(words)
    for at in draw.choice(len(words), changes, replace=False):
        words[at] = f"w{draw.integers(10**9)}"
    return " ".join(words)


def test_near_duplicates_equal_all_pairs(spark):
    draw = np.random.default_rng(17)
    texts = {}
    for group in range(4):
        base = [f"g{group}v{draw.integers(3000)}" for _ in range(150)]
        for _ in range(45):
            texts[len(texts)] = varied(draw, base, int(draw.integers(0, 8)))
    for extra in ("One two three", "one  TWO three", "é É", "", " \t ", "solo"):
        texts[len(texts)] = extra
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_dedup(texts)
    for sketch in (near_dup.SKETCH, replace(near_dup.SKETCH, pivots=1, whole=1, block_bytes=4096)):
        assert {tuple(r) for r in near_dup.near_duplicates(frame, sketch).collect()} == want


def test_near_duplicates_of_odd_rows(spark):
    found = near_dup.near_duplicates(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    assert {(r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id in (1, 2, 3)} == {(0, 1, True), (0, 2, True), (0, 3, True)}
    assert [(r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id == 4] == [(1, 4, True)] * 2
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_joint_estimate_is_close():
    sketch = near_dup.SKETCH
    multiply, add = near_dup.permutations(sketch)
    draw = np.random.default_rng(1)
    for similarity in (0.3, 0.6, 0.85, 0.95):
        both = int(round(2000 * similarity / (1 + similarity)))
        one = draw.integers(0, 2**63, 1000).astype(np.uint64)
        two = np.concatenate((one[:both], draw.integers(0, 2**63, 1000 - both).astype(np.uint64)))
        left, right = (near_dup.register_values(near_dup.minima(x, multiply, add), sketch)[None] for x in (one, two))
        size = np.array([1000.0])
        found, open_ = near_dup.joint_estimate(left, right, size, size, sketch)
        assert abs(found[0] - similarity) < 0.15
        assert open_[0] or similarity < 0.8
        assert not open_[0] or similarity > 0.5
    union = near_dup.minima(np.union1d(one, two), multiply, add)
    merged = np.maximum(left, right)[0]
    assert (near_dup.register_values(union, sketch) == merged).all()


# vectors --------------------------------------------------------------------------------------


def vector_rows():
    draw = np.random.default_rng(9)
    base = draw.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + draw.normal(size=16) * 0.14).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16), (205, [1.0, 2.0]), (206, [2.0, 4.0])]
    rows += [(207, rows[3][1]), (208, [float("inf")] + [0.0] * 15)]
    return rows


def test_near_vectors_equal_all_pairs(spark):
    rows = vector_rows()
    good = {i: np.array(v, dtype=float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    links = []
    for a, b in combinations(sorted(good), 2):
        x, y = good[a], good[b]
        if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
            links.append((a, b))
    label = reachable([i for i, _ in rows], links)
    want = {(i, sum(i in p for p in links), label[i], label[i] == i) for i, _ in rows}
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n_links int")
    for size in (4096, 16):
        assert {tuple(r) for r in vectors.near_vectors(frame, size=size).collect()} == want
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_near_vectors_disk_does_not_grow_with_tiles(spark, monkeypatch):
    """820 tiles of 40 blocks: all that is shuffled and stored stays below four times the vectors."""
    monkeypatch.setattr(vectors, "shuffles_removed", lambda spark: nullcontext(), raising=False)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def on_disk() -> dict[str, int]:
        files = manager.getAllFiles()
        found = [Path(files.apply(i).getPath()) for i in range(files.size())]
        found = [f for f in found if f.name.startswith("shuffle_")] + list(Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))
        return {str(f): f.stat().st_size for f in found if f.is_file()}

    x = np.random.default_rng(3).normal(size=(2560, 64)).astype(np.float32)
    x[1::10] = x[::10] * 2 + np.float32(0.01)
    x[2::640] = x[0]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    frame.write.parquet(path := work_path(spark, "vectors"))
    before = on_disk()
    found = vectors.near_vectors(spark.read.parquet(path), size=64)
    made = sum(size for name, size in on_disk().items() if name not in before)
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None]
    linked = unit @ unit.T >= 0.9
    label = reachable(range(len(x)), np.argwhere(np.triu(linked, 1)).tolist())
    assert {tuple(r) for r in found.collect()} == {(i, int(linked[i].sum()) - 1, label[i], label[i] == i) for i in range(len(x))}
    assert made < 4 * x.nbytes


def test_near_vectors_join_labels_of_many_tasks(spark):
    """A chain whose links lie in tiles of several tasks, one cluster in all blocks, repeated ids, doubles."""
    turn = np.arange(60) / 24
    chain = np.stack((np.cos(turn), np.sin(turn), 0 * turn), axis=1)
    rows = [(1000 - i, v) for i, v in enumerate(chain.tolist())] + [(2000 + i // 2, [0.0, 1e-3 * (i % 7), -1.0 - i]) for i in range(60)]
    good = np.array([v for _, v in rows])
    unit = good / np.sqrt((good * good).sum(axis=1))[:, None]
    linked = unit @ unit.T >= 0.9
    label = reachable([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in np.argwhere(np.triu(linked, 1))])
    want = sorted((i, int(linked[k].sum()) - 1, label[i], label[i] == i) for k, (i, _) in enumerate(rows))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for size in (4, 7, 64):
        assert sorted(tuple(r) for r in vectors.near_vectors(frame, size=size).collect()) == want


def test_quantisation_bound_holds():
    draw = np.random.default_rng(2)
    x, _ = vectors._unit(draw.normal(size=(80, 64)))
    p, s, e = vectors.quantised(x)
    rough = (p.astype(float) @ p.T.astype(float)) * s[:, None] * s[None]
    assert (np.abs(rough - x @ x.T) <= e[:, None] * (1 + e[None]) + e[None] + 1e-12).all()


def test_top_k_equals_brute_force(spark):
    rows = vector_rows()
    good = {i: np.floor(64 * np.array(v, dtype=float)) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in good:
        if q % 20 == 0:
            scored = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:20], 1)}
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    for sizes in ((1024, 8192), (3, 16)):
        found = topk.top_k(frame.filter("vec_id % 20 = 0"), frame, 20, 64, *sizes)
        assert {tuple(r) for r in found.collect()} == want
    assert topk.top_k(frame.limit(0), frame).count() == 0 and topk.top_k(frame, frame.limit(0)).count() == 0


def test_top_k_of_repeated_rows(spark):
    """Every row but the query's own is a candidate: rows that repeat its id, or its id and vector, are other rows."""
    rows = [(20, [1.0, 0.5]), (20, [0.25, 1.0]), (40, [0.5, 0.5]), (40, [0.5, 0.5]), (40, [0.5, 0.5]), (3, [2.0, -1.0]), (7, [-1.0, 0.0])]
    whole = [(i, [int(64 * x) for x in v]) for i, v in rows]
    want = Counter()
    for at, (i, v) in enumerate(whole):
        if i % 20 == 0:
            others = [(-(v[0] * w[0] + v[1] * w[1]), j) for k, (j, w) in enumerate(whole) if k != at]
            want.update((i, rank, j, -s) for rank, (s, j) in enumerate(sorted(others)[:4], 1))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sizes in ((1024, 8192), (2, 2), (1, 1)):
        found = topk.top_k(frame.filter("vec_id % 20 = 0"), frame, 4, 64, *sizes).collect()
        assert Counter(tuple(r) for r in found) == want


def test_segment_bounds_hold():
    draw = np.random.default_rng(4)
    x, y = draw.integers(-60, 60, (50, 64)).astype(float), draw.integers(-60, 60, (70, 64)).astype(float)
    for segments in topk.LEVELS:
        bound = topk.segment_statistics(x, segments) @ topk.segment_statistics(y, segments).T
        assert (bound + 1e-6 >= x @ y.T).all()


# pages ----------------------------------------------------------------------------------------


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_pages_of_the_given_tables(spark, folder):
    """The article's blocks, found by a plain reading of these pages' fixed layout."""
    table = spark.read.parquet(f"{folder}/pages.parquet")
    sources = {r.page_id: r.html for r in table.collect()}
    import html as references

    for r in pages.extract(table).collect():
        article = sources[r.page_id].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        parts = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", article))
        want = [" ".join(references.unescape(p).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in want if p) and r.n_chars == len(r.text)


def test_pages_without_an_article_lose_shared_lines(spark):
    shared = "<div>All rights reserved by us</div><p>Welcome to our site</p>"
    rows = [
        (1, "http://h.com/a/1", page(shared + "<p>First &amp; own  text &#233;</p><ul><li><a href=x>Home</a></ul>")),
        (2, "http://h.com/a/2", page(shared + "<p>Second own text that differs</p><div class='cookie-notice'>Accept</div>")),
        (3, "http://other.com/", page("<p>Alone<p>Two<div id=comments><p>nice!</p></div><form>Search</form>")),
        (4, None, None),
        (5, "", ""),
        (6, "http://h.com/z", "<p unclosed 'quote <b>x</b> < y & z"),
        (7, "http://m.com/1", page("<p>Mirror of a long text</p>")),
        (7, "http://m.com/1", page("<p>Mirror of a long text</p>")),
        (8, "http://q.com/1", page("<article><header><h1>Head</h1></header><p>Body</p><aside>More</aside></article><footer>F</footer>")),
        (9, "http://long.com/", page("<p>" + "word " * 200_000 + "</p>")),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = pages.extract(frame).collect()
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found}
    assert texts[1] == "First & own text é" and texts[2] == "Second own text that differs"
    assert texts[3] == "Alone\n\nTwo" and texts[4] == "" and texts[5] == "" and texts[7] == "Mirror of a long text"
    assert texts[8] == "Head\n\nBody" and len(texts[9]) == 5 * 200_000 - 1
    assert pages.extract(frame.limit(0)).count() == 0


def test_wrappers_and_names_keep_the_text():
    def text(body):
        return pages.main_text(pages.lines_of(page(body)), None)

    for wrap in ("div class='content-sidebar-wrap'", "div class='has-sidebar'", "div class='no-sidebar'", "div id=menu-open", "form", "div class=sidebar"):
        close = wrap.split()[0]
        assert text(f"<nav>Menu</nav><{wrap}><main><p>Long own text</p></main></{close}><footer>F</footer>") == "Long own text"
        assert text(f"<{wrap}><article><p>Long own text</p></article><div class=related>R</div></{close}>") == "Long own text"
        assert text(f"<{wrap}><p>Long own text of the page</p></{close}><footer>Foot</footer>") == "Long own text of the page"
    inner = "<h2 id='related-work'>Related work</h2><p id='social-impact'>Impact</p><h2 id=navigation>Navigation</h2>"
    assert text(f"<article>{inner}<div class='cookie-notice'>C</div></article>") == "Related work\n\nImpact\n\nNavigation"
    assert text("<p><a href=x>Sources of the text</a> all</p><ul><li><a href=y>Home</a></li></ul>") == "Sources of the text all"
    assert text("<p>Own <span class=ad>buy</span> text</p><p>More of it</p>") == "Own text\n\nMore of it"
    teaser = "<aside><article><p>Teaser</p></article></aside><div class=comments><p>Long words of others</p></div>"
    assert text(f"<article><p>Own text of this page</p></article>{teaser}") == "Own text of this page"


def test_common_is_a_longest_common_subsequence():
    draw = np.random.default_rng(6)
    for _ in range(200):
        one, two = (draw.integers(0, 6, int(draw.integers(0, 12))).tolist() for _ in range(2))
        best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
        for i in range(len(one)):
            for j in range(len(two)):
                best[i + 1][j + 1] = best[i][j] + 1 if one[i] == two[j] else max(best[i][j + 1], best[i + 1][j])
        found = [one[i] for i in sorted(pages.common(one, two))]
        assert len(found) == best[-1][-1]
        rest = iter(two)
        assert all(x in rest for x in found)


# quality --------------------------------------------------------------------------------------


def test_quality_separates_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in found if r.quality == 1], [r.kept for r in found if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def plain_costs(trusted, text):
    """Interpolated modified Kneser-Ney over word pairs with borders, counted in plain dictionaries."""
    pairs = Counter(p for t in trusted for p in pairwise(["<", *(t or "").split(), ">"]))
    look = lambda w: quality.EDGE if w in "<>" else quality.shape(w)

    def cuts(counts):
        few = Counter(counts)
        by = quality.discounts([few[j] for j in (1, 2, 3, 4)])
        return lambda n: by[min(n, 3) - 1] if n else 0.0

    before = Counter(b for _, b in pairs)
    cut, low_cut = cuts(pairs.values()), cuts(before.values())
    total = sum(before.values())
    rest = sum(map(low_cut, before.values())) / total if total else 1.0
    shapes = Counter(look(w) for w, n in before.items() if n == 1)

    def low(word):
        if before[word]:
            return (before[word] - low_cut(before[word])) / total
        return rest * (shapes[look(word)] + 1) / (sum(shapes.values()) + quality.SHAPES)

    def chance(first, word):
        after = {b: n for (a, b), n in pairs.items() if a == first}
        if not after:
            return low(word)
        n = after.get(word, 0)
        return (n - cut(n) + sum(map(cut, after.values())) * low(word)) / sum(after.values())

    known = sum(map(low, before)) + rest * sum((shapes[s] + 1) / (sum(shapes.values()) + quality.SHAPES) for s in range(quality.SHAPES))
    assert abs(known - 1) < 1e-9
    return -sum(np.log(chance(a, b)) for a, b in pairwise(["<", *(text or "").split(), ">"]))


@pytest.mark.parametrize("heavy", [quality.HEAVY, 40, 1])
def test_perplexities_equal_plain_counts(spark, monkeypatch, heavy):
    monkeypatch.setattr(quality, "HEAVY", heavy)
    draw = np.random.default_rng(4)
    vocabulary = "the The cat dog, 12 a9 -- of and sees".split() + [f"w{'abcdefghij'[i]}" for i in range(10)]
    texts = [" ".join(draw.choice(vocabulary, draw.integers(1, 60), p=np.arange(20, 0, -1) / 210)) for _ in range(40)]
    texts += [None, "", "new WORDS only 77", "the", texts[0], texts[0]]
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    rows = rows.withColumn("fold", quality.fold())
    for trusted in (rows.filter("doc_id < 30 OR doc_id > 43"), rows.limit(0)):
        counted = trusted.select("doc_id", "fold").collect()
        found = quality.surprisals(rows, quality.fit(trusted.select("text", "fold"))).collect()
        folds = {r.doc_id: r.fold for r in rows.select("doc_id", "fold").collect()}
        assert len(found) == len(texts)
        for r in found:
            others = [texts[t.doc_id] for t in counted if t.fold != folds[r.doc_id]]
            assert r.n_words == len((texts[r.doc_id] or "").split())
            assert abs(r.surprisal - plain_costs(others, texts[r.doc_id])) < 1e-4


def test_quality_leaves_no_model_on_disk(spark):
    folder, shared = "/root/testdata/sf0.01", shared_dir(spark).removeprefix("file:")
    on_disk = lambda: sum(p.stat().st_size for p in Path(shared).rglob("*.parquet") if p.is_file())
    texts, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    before = on_disk()
    assert quality.classify(texts, labels).count() == texts.count()
    assert on_disk() - before < Path(folder, "documents.parquet").stat().st_size / 5
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("oreflow_")]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_squeezed_numbers_come_back():
    draw = np.random.default_rng(7)
    for values in (np.sort(draw.integers(0, 1 << 64, 999, dtype=np.uint64)), np.empty(0, dtype=np.uint64)):
        assert np.array_equal(np.cumsum(unsqueezed(squeezed(steps(values)), np.uint64), dtype=np.uint64), values)
    values = draw.integers(-(1 << 40), 1 << 40, 999)
    assert np.array_equal(signed(unsqueezed(squeezed(unsigned(values)))), values)
    assert len(squeezed(np.arange(1 << 16) % 200)) < 1 << 17


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, None), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs(spark, ODD), labels).collect()
    assert len(found) == len(ODD)
    assert {r.doc_id for r in found if not r.kept} == {1, 2, 3}
    assert quality.classify(docs(spark, []), labels).collect() == []
    for none in (labels.limit(0), labels.filter("quality IS NULL")):
        found = quality.classify(docs(spark, ODD), none).collect()
        assert len(found) == len(ODD) and all(r.kept == bool(r.n_words) and r.lowest is None for r in found)


def test_limits_hold_for_few_trusted_rows(spark):
    draw = np.random.default_rng(12)
    prose = lambda n: " ".join(draw.choice("the old cat sat on a mat and saw it run".split(), n))
    rows = [(i, prose(80), "en" if i < 24 else "xx", "a") for i in range(30)]
    rows += [(100, " ".join(f"X{i}9##" for i in range(200)), "en", "a"), (101, " ".join(f"X{i}9##" for i in range(200)), "xx", "a")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify(docs(spark, rows), labels).collect()}
    assert not found[100].kept and not found[101].kept and all(found[i].kept for i in range(30))
    assert found[0].highest != found[25].highest


# queries and the pipeline ---------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_sql(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), connect(folder), SQL[name]) == ""


def test_pipeline_stages(spark, folder):
    given = spark.read.parquet(f"{folder}/documents.parquet")
    frame = given
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, folder)
        if number < 4:
            assert frame.columns == given.columns
    packed = frame.collect()
    direct = corpus_pipeline.run(spark, folder).collect()
    strip = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert strip(packed) == strip(direct) and packed


def test_pipeline_of_odd_rows(spark, folder):
    frame = docs(spark, ODD)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, folder)
        if number < 4:
            assert frame.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r.doc_id for r in frame.collect()} <= {r[0] for r in ODD}
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.collect() == []


def test_pipeline_drops_near_copies_from_80_percent(spark, folder):
    base = [f"v{i}" for i in range(204)]
    at = lambda place, changes: " ".join(base[:place] + [f"n{place + i}" for i in range(changes)] + base[place + changes :])
    texts = {1: " ".join(base), 2: at(100, 16), 3: at(20, 30)}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    share = lambda i: len(sets[1] & sets[i]) / len(sets[1] | sets[i])
    assert 0.80 <= share(2) < 0.85 and share(3) < 0.80
    frame = docs(spark, [(i, t, "en", "a") for i, t in texts.items()])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, folder).collect()} == {1, 3}
    assert all(r.kept for r in near_dup.near_duplicates(frame).collect())


def test_pipeline_judges_rows_not_ids(spark, folder):
    prose = "the house and the garden are of a long time and the people in it were with a book for the day "
    odd = " ".join(f"X{i}9##" for i in range(300))
    given = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source")
    labelled = given.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("toxic = 0 AND lang = 'en'")
    good, bad = (labelled.filter(f"quality = {k}").orderBy("doc_id").first() for k in (1, 0))
    rows = [(None, good.text, "en", "a"), (900_001, good.text, "en", "a"), (900_001, bad.text, "en", "a")]
    frame = given.union(docs(spark, rows).select("doc_id", "text", "lang", "source"))
    kept = corpus_pipeline.quality_filter(spark, frame, folder).filter("doc_id IS NULL OR doc_id > 900000").collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == [(False, good.text), (True, good.text)]
    rows = [(1, prose, "en", "a"), (1, odd, "en", "a"), (1, prose.upper(), "en", "a"), (2, odd + " y", "en", "a"), (0, odd, "en", "a")]
    left = corpus_pipeline.near_duplicates(spark, docs(spark, rows), folder).collect()
    assert {(r.doc_id, r.text.lower()) for r in left} == {(1, prose), (0, odd.lower())} and len(left) == 2
