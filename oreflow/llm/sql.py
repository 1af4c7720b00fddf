"""The operators' results as DuckDB SQL, where SQL can say them."""

from oreflow.llm.mixing import BLOCK_WORDS, MOST_REPEATS, SEED, SHARD_WORDS, WEIGHTS
from oreflow.llm.suffixes import LENGTH

_WORD = r"[^\x20\x09-\x0D]+"


def _apportion(rows: str, group: str, share: str, seats: str, place: str, name: str) -> str:
    """Common table expressions ``name`` with the column quota; group is a list of columns or empty."""
    keys = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    using = f"USING ({keys}{place})"
    return f"""
{name}_1 AS (SELECT *, sum({share}) OVER ({part}) AS _sum, count(*) OVER ({part}) / (2.0 * {seats}) AS _slack FROM {rows}),
{name}_2 AS (SELECT * EXCLUDE (_sum, _slack),
    CASE WHEN _sum > 0 AND {seats} > 0 AND _slack < 1 THEN floor({share} * {seats} / _sum * (1.0 - _slack) + 0.5)::BIGINT ELSE 0 END AS _sure,
    CASE WHEN _sum > 0 AND {seats} > 0 THEN floor({share} * {seats} / _sum * (1.0 + _slack) + 0.5)::BIGINT + 1 ELSE 0 END AS _upto
  FROM {name}_1),
{name}_3 AS (SELECT *, {seats} - sum(_sure) OVER ({part}) AS _open FROM {name}_2),
{name}_4 AS (SELECT {keys}{place}, {share} AS _share, _open, unnest(range(_sure + 1, _upto + 1)) AS _seat FROM {name}_3),
{name}_5 AS (SELECT *, row_number() OVER ({part} ORDER BY _share / (2 * _seat - 1) DESC, {place}, _seat) AS _rank FROM {name}_4),
{name}_6 AS (SELECT {keys}{place}, count(*) AS _won FROM {name}_5 WHERE _rank <= _open GROUP BY ALL),
{name} AS (SELECT {name}_3.* EXCLUDE (_sure, _upto, _open), _sure + coalesce(_won, 0) AS quota FROM {name}_3 LEFT JOIN {name}_6 {using})"""


def _draw(*parts: str) -> str:
    text = " || '|' || ".join([f"'{SEED}'", *parts])
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


_KEY = "coalesce(doc_id::VARCHAR, '')"

OP2 = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, chr(1114111)) AS s, source IS NULL AS no_source,
         coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size
  FROM documents),
shards AS (SELECT greatest(1, ceil(sum(size) / {SHARD_WORDS}))::BIGINT AS n FROM docs),
placed AS (SELECT docs.*, {_draw("'shard'", _KEY)} % n AS shard, md5('{SEED}' || '|' || {_KEY}) AS order_key FROM docs, shards),
cells AS (SELECT s, no_source, shard, sum(size)::BIGINT AS cell_size FROM placed GROUP BY ALL),
sources AS (SELECT s, no_source, sum(cell_size)::BIGINT AS source_size FROM cells GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY no_source, s) AS place FROM sources),
weighed AS (SELECT *, (place - 1) % {WEIGHTS} + 1 AS weight, source_size * {MOST_REPEATS} AS most,
    sum(source_size) OVER ()::BIGINT AS total FROM ranked),
steps AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
    sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights,
    row_number() OVER (ORDER BY most / weight, place) AS step FROM weighed),
firsts AS (SELECT *, min(CASE WHEN weight * rest / weights <= most THEN step END) OVER () AS first FROM steps),
wanted AS (SELECT s, place, source_size,
    CASE WHEN step < first THEN most::DOUBLE
         ELSE weight * max(CASE WHEN step = first THEN rest END) OVER () / max(CASE WHEN step = first THEN weights END) OVER () END AS target,
    floor(total / {BLOCK_WORDS} + 0.5)::BIGINT AS seats FROM firsts),
{_apportion("wanted", "", "target", "seats", "place", "by_source").strip()},
joined AS (SELECT cells.s, cells.shard, cell_size, source_size, target, quota AS source_seats FROM cells JOIN by_source USING (s)),
{_apportion("joined", "s", "cell_size", "source_seats", "shard", "by_cell").strip()},
worded AS (SELECT *, least(quota, floor(cell_size * {MOST_REPEATS} / {BLOCK_WORDS})::BIGINT) * {BLOCK_WORDS} AS words, greatest(cell_size, 1) AS some_words FROM by_cell),
runs AS (SELECT s, shard, source_size, target, cell_size, words // some_words AS laps, words % some_words AS run,
    ({_draw("'run'", "CASE WHEN s = chr(1114111) THEN '' ELSE s END", "shard::VARCHAR")} % ceil(some_words / {BLOCK_WORDS})::BIGINT * {BLOCK_WORDS}) % some_words AS start FROM worded),
ringed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s, shard ORDER BY order_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM placed)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (laps * size + greatest(0, least(start + run, pos + size) - greatest(start, pos))
   + greatest(0, least(start + run - cell_size, pos + size) - greatest(start - cell_size, pos)))::BIGINT AS taken
FROM ringed JOIN runs USING (s, shard)
"""

OP4 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM words),
items AS (SELECT doc_id, unnest(g) AS g FROM sets),
sizes AS (SELECT doc_id, len(g)::BIGINT AS n FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r)
SELECT sizes.doc_id, n AS n_shingles, min(r) AS component_id, min(r) = sizes.doc_id AS kept
FROM sizes JOIN reach ON reach.doc_id = sizes.doc_id GROUP BY sizes.doc_id, n
"""

OP8 = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT e.vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(r) AS component_id, min(r) = e.vec_id AS kept
FROM embeddings e JOIN reach USING (vec_id) LEFT JOIN counts ON a = e.vec_id GROUP BY e.vec_id
"""

OP10 = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

OP11 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, hex(coalesce(text, '')) AS x FROM documents),
pos AS (SELECT r, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) AS i FROM d),
named AS (SELECT r, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS k FROM pos),
again AS (SELECT r, i FROM named QUALIFY count(*) OVER (PARTITION BY k) > 1),
edges AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > {LENGTH}, true)::INT AS fresh FROM again),
numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM edges),
spans AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM numbered GROUP BY r, g),
before AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS free FROM spans),
joined AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
    string_agg(substr(x, 2 * free + 1, 2 * (a - free)), '' ORDER BY a) AS kept
  FROM before JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN joined USING (r)
"""

_CRC = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))"

OP13 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_extract_all(coalesce(text, ''), '{_WORD}'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: {_CRC})) AS h FROM documents),
draws AS (SELECT doc_id, r, w, len(w)::BIGINT AS n, h, h // 10 AS g FROM d),
tails AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM draws),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM tails),
places AS (SELECT r, n, w, a, p, unnest(range(0, n)) AS i FROM periods),
words AS (SELECT r, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM places),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pairs),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, len, min(q) AS q FROM stretches GROUP BY r, s, len),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    min({{'l': -len, 's': s, 'q': q}}) AS top FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, -top.l AS length, top.q AS period,
  (-top.l * 1000) // top.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

SQL = {
    "op2_source_mix": OP2,
    "op4_minhash_dedup": OP4,
    "op8_embedding_dedup": OP8,
    "op10_exact_top_k": OP10,
    "op11_suffix_dedup": OP11,
    "op13_periodic_runs": OP13,
}
