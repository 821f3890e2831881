"""DuckDB SQL of queries whose rules need more than a few lines of it."""

from __future__ import annotations


def _crc_table() -> str:
    """The 256 CRC-32 remainders of one byte, from the polynomial's rule."""
    def remainder(byte: int) -> int:
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        return byte
    return "[" + ",".join(str(remainder(b)) for b in range(256)) + "]::BIGINT[]"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string expression's UTF-8 bytes."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    step = f"lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({codes}, {step}, 4294967295::BIGINT), 4294967295)"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _features_sql(table: str, key: str) -> str:
    """CTEs of one table: words by row, then counts of features by row."""
    return f"""
{table}_w AS MATERIALIZED (SELECT row_number() OVER () AS r, {key} AS id, coalesce({_WORDS}, []) AS w FROM {table}),
{table}_t AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM {table}_w),
{table}_n AS (SELECT r, a, lead(a, 1) OVER d AS b, lead(a, 2) OVER d AS c FROM {table}_t WINDOW d AS (PARTITION BY r ORDER BY i)),
{table}_f AS (
  SELECT r, f, count(*) AS n FROM (
    SELECT r, a AS f FROM {table}_n UNION ALL
    SELECT r, a || ' ' || b FROM {table}_n WHERE b IS NOT NULL UNION ALL
    SELECT r, a || ' ' || b || ' ' || c FROM {table}_n WHERE c IS NOT NULL) GROUP BY r, f)"""


RESAMPLE_SQL = f"""
WITH {_features_sql('documents', 'doc_id')},{_features_sql('benchmark', 'item_id')},
fb AS (SELECT f, {crc32_sql('f')} % 10000 AS bucket
       FROM (SELECT DISTINCT f FROM documents_f UNION SELECT DISTINCT f FROM benchmark_f)),
s AS (SELECT bucket, sum(n) AS s FROM documents_f JOIN fb USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM benchmark_f JOIN fb USING (f) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000)
                                        / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + 10000)))) AS BIGINT) AS g
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), tot),
wt AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight
       FROM documents_f JOIN fb USING (f) JOIN gain USING (bucket) GROUP BY r),
sc AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || id), 8) AS BIGINT)
                                                          + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents_w d LEFT JOIN wt ON wt.r = d.r),
pl AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
              count(*) FILTER (n_words >= 20) OVER () AS able FROM sc)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank
FROM pl
"""

# Four words at consecutive multiples of a period lie in every run of four periods;
# that gives few (text, period) pairs, and each is checked over the whole text.
PERIODIC_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w,
         {crc32_sql('CAST(doc_id AS VARCHAR)')} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p),
t AS MATERIALIZED (
  SELECT r, doc_id, n,
         CASE WHEN h % 10 = 0 AND n > 0
              THEN list_concat(w[:a], list_transform(range(0, n - a), lambda k: w[a + k % p + 1])) ELSE w END AS w
  FROM q),
tok AS MATERIALIZED (SELECT r, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM t),
every AS (SELECT r, n, unnest(range(1, n // 4 + 1)) AS q FROM t),
mult AS (SELECT r, q, k * q AS i FROM (SELECT r, n, q, unnest(range(0, (n - 1) // q + 1)) AS k FROM every)),
met AS MATERIALIZED (SELECT m.r, m.q, m.i, tok.word FROM mult m JOIN tok ON tok.r = m.r AND tok.i = m.i),
ahead AS (
  SELECT r, q, word, lead(word, 1) OVER d AS w1, lead(word, 2) OVER d AS w2, lead(word, 3) OVER d AS w3
  FROM met WINDOW d AS (PARTITION BY r, q ORDER BY i)),
cand AS MATERIALIZED (SELECT DISTINCT r, q FROM ahead WHERE word = w1 AND word = w2 AND word = w3),
same AS (
  SELECT c.r, c.q, unnest(list_filter(range(0, n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i
  FROM cand c JOIN t ON t.r = c.r),
eq AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM same),
stretch AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM eq GROUP BY r, q, isle),
run AS (SELECT r, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS txt
  FROM run GROUP BY r),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) AS nth FROM run),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
stay AS (SELECT tok.r, string_agg(word, ' ' ORDER BY tok.i) AS txt
         FROM tok LEFT JOIN gone ON gone.r = tok.r AND gone.i = tok.i WHERE gone.i IS NULL GROUP BY tok.r)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(listed.txt, '')) AS runs_sha256, sha256(coalesce(stay.txt, '')) AS collapsed_sha256
FROM t LEFT JOIN listed ON listed.r = t.r LEFT JOIN best b ON b.r = t.r AND b.nth = 1 LEFT JOIN stay ON stay.r = t.r
"""

CAP_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
         label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.ok AND b.ok
  AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM e UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v),
comp AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
deg AS (SELECT u, count(*) AS n_links FROM link GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN comp ON comp.u = e.vec_id LEFT JOIN deg ON deg.u = e.vec_id
"""
