"""Language, secrets, tokens, packing and mixing against plain versions on small fixtures."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from oreflow.llm import language, mixing, packing, secret_scan, token_counts
from oreflow.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those the operators make."""
    full = [(i, t, lang, source, None if t is None else len(t), 1, "x") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n", "en", "a"),
    (4, "the same text here", "en", "b"),
    (4, "the same text here", "en", "b"),
    (None, "a row without an id", "en", None),
    (5, "12 34 -- ..", "de", "b"),
    (6, "word " * 30_000, "de", "b"),
    (7, "\U0001f600 née x  two  spaces <|endoftext|> ", "fr", "c"),
]


# tokens ---------------------------------------------------------------------------------------


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


ENCODER = Encoder()
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LETTERS = [*"aB 's\n\t1.é中!|<>\xa0\u2003\u3000\x85\r", "<|endoftext|>", "<|endof", "text|>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=40).map("".join))
def test_ids_equal_the_tokenizer_files(text):
    assert ids(ENCODER(text)) == PLAIN.encode(text, add_special_tokens=False).ids


def test_no_id_is_that_of_the_end_of_a_document():
    assert PLAIN.get_vocab_size() <= token_counts.END


def test_ids_of_the_given_texts(spark, folder, tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids(ENCODER(t)) for t in texts] == want


# packing --------------------------------------------------------------------------------------


def check_packing(rows, texts, tokenizer, capacity):
    """Every document's ids come back from its pieces, and sequences are gapless and not too long."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        whole = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        found = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        assert [r.start for r in found] == list(np.cumsum([0, *(r.length for r in found)])[:-1])
        assert sum(r.length for r in found) == len(whole)
        assert all(r.length == capacity for r in found[1:]) and found[0].length <= capacity
        for r in found:
            part = np.array(whole[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end = offset + length
        assert end <= capacity
    return len(sequences)


def test_packing_round_trip(spark, folder, tokenizer):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = packing.pack(table).collect()
    count = check_packing(rows, {r.doc_id: r.text for r in table.collect()}, tokenizer, 2048)
    assert count <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_of_odd_rows(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 3)
    unique = [r for r in ODD if r[0] not in (4, None)] + [ODD[3]]
    rows = packing.pack(docs(spark, unique), capacity=64).collect()
    check_packing(rows, {r[0]: r[1] for r in unique}, tokenizer, 64)
    assert packing.pack(docs(spark, ODD)).count() >= len(ODD)
    assert packing.pack(docs(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=30))
def test_patterns_place_every_length(histogram):
    found = packing.patterns(histogram, 64)
    placed = {}
    for p in found:
        assert sum(n * k for n, k in p.counts.items()) <= 64
        for n, k in p.counts.items():
            placed[n] = placed.get(n, 0) + k * p.times
    assert placed == histogram
    assert sum(p.times for p in found) <= first_fit(histogram, 64) + 1


@pytest.mark.parametrize("pieces, share", [(2_000, 0.6), (20_000, 0.9), (500_000, 0.8)])
def test_the_program_makes_most_sequences(pieces, share):
    lengths = np.random.default_rng(5).lognormal(5.5, 1, pieces).astype(int).clip(1, 1500)
    histogram = dict(zip(*(v.tolist() for v in np.unique(lengths, return_counts=True))))
    found = packing.patterns(histogram)
    total = sum(p.times for p in found)
    assert sum(p.times for p in found if p.solved) >= share * total
    assert total == -(-int(lengths.sum()) // packing.CAPACITY)
    assert len(found) < 4 * len(histogram) + 2_000


def first_fit(histogram, capacity):
    room = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            at = next((i for i, r in enumerate(room) if r >= n), None)
            if at is None:
                room.append(capacity - n)
            else:
                room[at] -= n
    return len(room)


# token counts ---------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_token_counts(spark, folder, tokenizer, block):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(table, block).collect()}
    assert found == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_token_counts_of_odd_rows(spark, tokenizer):
    found = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.token_counts(docs(spark, ODD), 8).collect())
    assert found == sorted((r[0] or -1, len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert token_counts.token_counts(docs(spark, [])).count() == 0


# secrets --------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(found)]


SECRETS = [
    (1, 'x PassWord = "hunter22" y', None, None),
    (2, "secret=token: abcdefgh", None, None),
    (3, "api_key:ab api-key=abcdefg apikey: abcdefg.", None, None),
    (4, "é\U0001f600 AKIA" + "A1B2" * 4 + " AKIAshort", None, None),
    (5, "a" * 23 + " " + "0123456789abcdef" * 2, None, None),
    (6, "toKen=abcdefgh", None, None),
    (7, "token='" + "f0" * 20 + "' ghp_" + "a" * 36, None, None),
    (8, "-----BEGIN RSA PRIVATE KEY----- eyJabcdefghijk.eyJabcdefghijk.abcdefghijkl xoxb-" + "1" * 24, None, None),
    (9, "clean prose about a token and its password", None, None),
]


def test_secrets_equal_a_plain_scan(spark, folder):
    given_rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    texts = [(i, t) for i, t, _, _ in SECRETS] + [(r.doc_id + 100, r.text) for r in given_rows]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r.doc_id: r for r in secret_scan.digest(secret_scan.find_secrets(frame)).collect()}
    for i, text in texts:
        want = plain_spans(text)
        row = rows[i]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == n for k, _, _ in want) for n in ("assign", "access", "hex")]
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert row.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(row.spans.split(","))
    assert rows[9].spans == "" and "code_host" in rows[7].spans
    assert all(k in rows[8].spans for k in ("private_key", "jwt", "chat"))


def test_every_match_satisfies_the_trigram_query():
    samples = {"private_key": SECRETS[7][1], "jwt": SECRETS[7][1], "chat": SECRETS[7][1], "code_host": SECRETS[6][1]}
    for rule in secret_scan.RULES:
        query = secret_scan.mandatory_trigrams(rule)
        assert bool(query) == (rule.kind != "hex")
        text = samples.get(rule.kind)
        if text:
            assert all(any(t in text.lower().encode() for t in options) for options in query)


def test_secrets_of_odd_rows(spark):
    rows = secret_scan.digest(secret_scan.find_secrets(docs(spark, ODD))).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" for r in rows)
    assert secret_scan.find_secrets(docs(spark, [])).count() == 0
    masked = secret_scan.masked(docs(spark, SECRETS + ODD))
    assert masked.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    texts = {r.doc_id: r for r in masked.collect()}
    assert texts[1].text is None
    rows = {r.doc_id: r for r in secret_scan.masked(docs(spark, SECRETS)).collect()}
    assert rows[1].text == 'x [assign]" y' and rows[1].n_chars == len(rows[1].text)
    assert rows[9].text == SECRETS[8][1]


# language -------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_ids(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2


def test_language_of_odd_rows(spark):
    rows = language.language_ids(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    found = {r.doc_id: r for r in rows}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 5))
    assert found[6].lang_pred in ("en", "de", "fr")
    unlabelled = [(i, t, None, s) for i, t, _, s in ODD]
    assert {r.lang_pred for r in language.language_ids(docs(spark, unlabelled)).collect()} == {"und"}
    assert language.language_ids(docs(spark, [])).count() == 0


def test_windows_hold_the_whole_text():
    classes = language.byte_classes()
    for n in (0, 1, 188, 189, 190, 192, 193, 500, 1000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        rows = language.windows_of(text, classes)
        step = language.WINDOW - max(language.WIDTHS) + 1
        whole = np.concatenate([*(r[:step] for r in rows[:-1]), rows[-1]])
        assert (whole[:n] == classes[np.frombuffer(text.encode(), dtype=np.uint8)]).all() and len(whole) >= n


# mixing ---------------------------------------------------------------------------------------


def plain_seats(shares, seats):
    won = [0] * len(shares)
    for _ in range(seats):
        best = max(range(len(shares)), key=lambda i: (shares[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(0, 60))
def test_apportionment_is_by_highest_quotients(spark, shares, seats):
    if not sum(shares):
        seats = 0
    rows = spark.createDataFrame([(i, float(s), seats) for i, s in enumerate(shares)], "place long, share double, seats long")
    found = {r.place: r.quota for r in mixing.apportion(rows, [], "share", "seats", "place").collect()}
    assert [found[i] for i in range(len(shares))] == plain_seats(shares, seats)


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        weights = sum(weight[s] for s in names if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else weight[s] * rest / weights for s in names}
        over = {s for s in names if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return share
        capped |= over


def test_mix_targets_and_quotas(spark):
    draw = np.random.default_rng(5)
    rows = [(i, f"s{min(int(draw.geometric(0.3)), 7)}" if i % 11 else None, int(draw.integers(0, 40))) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for shard_words in (10**9, 500):
        out = mixing.mix(frame, block_words=4, shard_words=shard_words).collect()
        assert len(out) == len(rows)
        sizes = {}
        for _, source, size in rows:
            sizes[source] = sizes.get(source, 0) + size
        want = plain_targets(sizes)
        taken = {}
        for r in out:
            assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
            assert abs(r.target - want[r.source]) < 1e-6
            taken[r.source] = taken.get(r.source, 0) + r.taken
            assert r.laps * r.size + sum(c.end - c.first for c in r.cuts) == r.taken
        shards = -(-sum(sizes.values()) // shard_words)
        for source, n in taken.items():
            assert abs(n - want[source]) <= 4 * (1 + shards)
        again = mixing.mix(frame.repartition(5), block_words=4, shard_words=shard_words)
        assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_mix_of_odd_rows(spark):
    table = docs(spark, ODD)
    rows = mixing.mix(mixing.sized(table)).collect()
    assert len(rows) == len(ODD) and sum(r.size == 0 for r in rows) == 3
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(mixing.sized(docs(spark, []))).count() == 0
    made = mixing.mixed_documents(table)
    assert made.columns == table.columns
    words = {}
    for r in made.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        words[r.doc_id] = words.get(r.doc_id, 0) + n
    want = {}
    for r in rows:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in want.items() if v}
    only_empty = docs(spark, ODD[:3])
    assert mixing.mixed_documents(only_empty).count() == 0


def test_mixing_stays_out_of_python(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for frame in (mixing.mix(mixing.sized(table)), mixing.mixed_documents(table)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_tokens_of_a_long_text_are_found_in_linear_time():
    rule = next(r for r in secret_scan.RULES if r.kind == "jwt")
    token = "eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + "." + "c" * 20
    assert rule.compiled().findall("eyJ" * 700_000 + " " + token) == [token]
