"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies one operator with its production parameters to a whole
table and derives the digest columns of its contract from the operator's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (cap_filters, decontam, html_text, langid, line_dedup, lm, mixing, periodic, quality, resampling, sharding,
               simhash, token_counts)
from .common import WORD_PATTERN, count_words
from .oracles import CAP_SQL, PERIODIC_SQL, RESAMPLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


# ---------------------------------------------------------- decontamination
DECONTAM_SQL = r"""
WITH it AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
ph AS (
  SELECT DISTINCT item, list_slice(w, s, least(s + 9, len(w))) AS p, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM it WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
ln AS (SELECT DISTINCT n FROM ph),
dp AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, ln WHERE len(w) >= n)),
hit AS (SELECT dp.doc_id, dp.s, dp.n, ph.item FROM dp JOIN ph ON dp.n = ph.n AND dp.p = ph.p),
hw AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit
       FROM (SELECT DISTINCT doc_id, s, unnest(range(0, n)) AS k FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
       FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(dw.w), 0) AS n_words, coalesce(hw.n_hit, 0) AS n_hit,
       coalesce(hi.n_items, 0) AS n_items, sha256(coalesce(hi.ids, '')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN dw ON dw.doc_id = d.doc_id LEFT JOIN hw ON hw.doc_id = d.doc_id
LEFT JOIN hi ON hi.doc_id = d.doc_id
"""


@query("op2_decontamination", DECONTAM_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases found in every document through the FM-indexes of its shards."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# ---------------------------------------------------------------- line dedup
# Three-line windows of the lines with text; the lists are those of line_dedup.py.
LINE_SQL = r"""
WITH ln AS (
  SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS raw
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
lt AS (SELECT *, trim(raw, E' \t\n\x0B\f\r') AS line FROM ln),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS j FROM lt WHERE line <> ''),
w AS (
  SELECT doc_id, j, [line, lead(line, 1) OVER d, lead(line, 2) OVER d] AS w, lead(line, 2) OVER d AS third
  FROM nb WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, j) AS nth FROM w WHERE third IS NOT NULL),
cov AS (SELECT DISTINCT doc_id, j + unnest(range(0, 3)) AS j FROM r WHERE nth > 1),
fate AS (
  SELECT lt.doc_id, lt.pos, lt.raw, lt.line <> '' AS has_text,
         coalesce(max(nb.j) OVER (PARTITION BY lt.doc_id ORDER BY lt.pos), 0) AS j
  FROM lt LEFT JOIN nb ON nb.doc_id = lt.doc_id AND nb.pos = lt.pos),
agg AS (
  SELECT f.doc_id, count(*) FILTER (f.has_text) AS n_lines,
         count(*) FILTER (f.has_text AND c.j IS NOT NULL) AS n_removed,
         coalesce(string_agg(f.raw, chr(10) ORDER BY f.pos) FILTER (c.j IS NULL), '') AS text
  FROM fate f LEFT JOIN cov c ON c.doc_id = f.doc_id AND c.j = f.j GROUP BY f.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, a.text
FROM documents d LEFT JOIN agg a ON a.doc_id = d.doc_id
"""


@query("op3_line_dedup", LINE_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents without later occurrences of repeated three-line windows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


# ------------------------------------------------------------------- mixing
@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix of all sources to their targets takes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(docs, F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "copies")


# ----------------------------------------------------------------- sharding
@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document after the two-pass shuffle of whole rows."""
    placed = sharding.external_shuffle(read(spark, sf_dir, "documents"), sharding.text_bytes(F.col("text")))
    return placed.select(
        "doc_id", sharding.text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# ------------------------------------------------------------------ simhash
@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_groups(docs).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


# ------------------------------------------------------------------ quality
@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, fertility and verdict of every document."""
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id", "lang"])
    return judged.select("rec.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
                         "base_failed", "kept", "m.n_tokens", "m.chars_per_token", "m.byte_share", "m.entropy")


# --------------------------------------------------------------- LM scoring
def crc_rest(column: str, divisor: int):
    """crc32 of a column as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the backoff automaton learned from the training folds."""
    docs = read(spark, sf_dir, "documents")
    train = F.coalesce(crc_rest("doc_id", 7) != 2, F.lit(True))
    return lm.score_texts(docs, train).withColumnRenamed("id", "doc_id")


# -------------------------------------------------------------- language ID
@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the training folds."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_rest("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs, ~held_out)
    found = docs.select("doc_id", held_out.alias("held_out"), langid.predict(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


# ------------------------------------------------------------- token counts
@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths of all documents with its suffix sums."""
    return token_counts.suffix_sums(token_counts.length_histogram(read(spark, sf_dir, "documents")))


# ---------------------------------------------------------- HTML extraction
@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", html_text.main_text_column(F.col("html")).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


# --------------------------------------------------------------- resampling
@query("op11_resampling", RESAMPLE_SQL)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and draw of every document by importance towards the benchmark's distribution."""
    ranked = resampling.importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return ranked.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


# --------------------------------------------------------- embedding dedup
@query("op12_embedding_dedup", CAP_SQL)
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    groups = cap_filters.cap_groups(read(spark, sf_dir, "embeddings"))
    return groups.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


# ------------------------------------------------------------ periodic runs
def with_planted_period(text, doc_id):
    """The text, or for every tenth id (by crc32) its words with a periodic tail whose start and period the id sets."""
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0)
    n = F.size(words)
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    tail = (n - a).cast("int")
    period = (F.floor(tail / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
    unit = F.slice(words, a + 1, period)
    repeated = F.flatten(F.array_repeat(unit, F.ceil(tail / period).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(repeated, F.lit(1), tail)), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), planted).otherwise(text)


@query("op13_periodic_runs", PERIODIC_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, the longest of them, and the text without their repeats."""
    docs = read(spark, sf_dir, "documents")
    text = with_planted_period(F.col("text"), F.col("doc_id"))
    found = periodic.periodic_runs(docs, text, keep=["doc_id"])
    found = found.withColumn("best", periodic.longest_run(F.col("runs")))
    return found.select(
        "rec.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic.runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
