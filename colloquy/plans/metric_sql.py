"""DuckDB twins of the per-pair metrics: LCS as a recursive query, METEOR as a ranked join.

``ctes(source, key)`` continues a WITH RECURSIVE list that has ``source``
(key, response, target): tokens, LCS lengths, METEOR and BLEU per pair.
"""

from __future__ import annotations

from .. import constants as C
from . import sqlx


def ctes(source: str, key: str) -> str:
    """CTEs mt (k, h, r), lcs_len (k, lcs), met (k, meteor), bl (k, bleu_2, bleu_4), ng (n, ngram, c)."""
    return f"""
mt AS (SELECT {key} AS k, {sqlx.tok(sqlx.strip_markers('response'))} AS h,
              {sqlx.tok(sqlx.strip_markers('target'))} AS r FROM {source}),
ht AS (SELECT k, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS w FROM mt),
rt AS (SELECT k, unnest(range(1, len(r) + 1)) AS j, unnest(r) AS w FROM mt),
lcs AS (
  SELECT k, CAST(0 AS BIGINT) AS i, j, 0 AS v FROM rt
  UNION ALL
  SELECT k, i + 1, j, max(greatest(v, CASE WHEN same THEN before + 1 ELSE 0 END))
                      OVER (PARTITION BY k ORDER BY j ROWS UNBOUNDED PRECEDING)
  FROM (SELECT l.k, l.i, l.j, l.v, rt.w = ht.w AS same, lag(l.v, 1, 0) OVER (PARTITION BY l.k ORDER BY l.j) AS before
        FROM lcs l JOIN rt ON rt.k = l.k AND rt.j = l.j JOIN ht ON ht.k = l.k AND ht.i = l.i + 1)),
lcs_len AS (SELECT mt.k, coalesce(max(v), 0) AS lcs FROM mt LEFT JOIN lcs ON lcs.k = mt.k GROUP BY mt.k),
rl AS (SELECT mt.k, lcs, len(h) AS nh, len(r) AS nr, lcs / len(h) AS p, lcs / len(r) AS q
       FROM mt JOIN lcs_len USING (k) WHERE len(h) > 0 AND len(r) > 0),
rouge AS (SELECT k, lcs, CASE WHEN lcs = 0 THEN 0.0 ELSE 2 * p * q / (p + q + {C.F_EPS}) END AS rouge_l FROM rl),
hw AS (SELECT k, i, lower(w) AS w, row_number() OVER (PARTITION BY k, lower(w) ORDER BY i DESC) AS nth FROM ht),
rw AS (SELECT k, j, lower(w) AS w, row_number() OVER (PARTITION BY k, lower(w) ORDER BY j DESC) AS nth FROM rt),
al AS (SELECT k, i, j FROM hw JOIN rw USING (k, w, nth)),
ck AS (SELECT k, CASE WHEN i = lag(i) OVER o + 1 AND j = lag(j) OVER o + 1 THEN 0 ELSE 1 END AS opens FROM al
       WINDOW o AS (PARTITION BY k ORDER BY i)),
cs AS (SELECT k, count(*) AS m, sum(opens) AS chunks FROM ck GROUP BY k),
met AS (SELECT mt.k, CASE WHEN m IS NULL THEN 0.0 ELSE
          ((m / len(h)) * (m / len(r)) / ({C.METEOR_ALPHA} * (m / len(h)) + (1 - {C.METEOR_ALPHA}) * (m / len(r))))
          * (1 - {C.METEOR_GAMMA} * pow(chunks / m, {C.METEOR_BETA})) END AS meteor FROM mt LEFT JOIN cs USING (k)),
orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT k, n, g, count(*) AS c FROM (SELECT k, n, unnest(list_transform(range(1, len(h) - n + 2),
       lambda i: array_to_string(h[i:i + n - 1], ' '))) AS g FROM mt, orders WHERE len(h) >= n) GROUP BY ALL),
rg AS (SELECT k, n, g, count(*) AS c FROM (SELECT k, n, unnest(list_transform(range(1, len(r) - n + 2),
       lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM mt, orders WHERE len(r) >= n) GROUP BY ALL),
mc AS (SELECT k, n, sum(least(hg.c, coalesce(rg.c, 0))) AS hits, sum(hg.c) AS whole
       FROM hg LEFT JOIN rg USING (k, n, g) GROUP BY k, n),
ba AS (SELECT k, count(*) FILTER (n <= 2 AND hits > 0) AS ok2, sum(ln(hits / whole)) FILTER (n <= 2 AND hits > 0) AS l2,
              count(*) FILTER (hits > 0) AS ok4, sum(ln(hits / whole)) FILTER (hits > 0) AS l4 FROM mc GROUP BY k),
bl AS (SELECT mt.k, CASE WHEN ok2 = 2 THEN bp * exp(l2 / 2) ELSE 0.0 END AS bleu_2,
              CASE WHEN ok4 = 4 THEN bp * exp(l4 / 4) ELSE 0.0 END AS bleu_4
       FROM (SELECT k, CASE WHEN len(h) > len(r) THEN 1.0 WHEN len(h) = 0 THEN 0.0 ELSE exp(1 - len(r) / len(h)) END AS bp
             FROM mt) mt LEFT JOIN ba USING (k)),
dist AS (SELECT CAST(count(*) AS DOUBLE) / (sum(c) + {C.NGRAM_EPS}) AS dist_2
         FROM (SELECT g, sum(c) AS c FROM hg WHERE n = 3 GROUP BY g))"""


REPORT = """ SELECT (SELECT round(avg(rouge_l), 4) FROM rouge) AS rouge_l, (SELECT round(avg(bleu_2), 4) FROM bl) AS bleu_2,
(SELECT round(avg(bleu_4), 4) FROM bl) AS bleu_4, (SELECT round(avg(meteor), 4) FROM met) AS meteor,
(SELECT round(dist_2, 4) FROM dist) AS dist_2"""
