"""Metric states of parts of a corpus that merge into those of the whole.

* ``report_state`` holds what ``generation_report`` needs of a part of the
  predictions: sums and counts of the pair scores and the counts of the n-grams.
  A run that is resumed scores its new rows only and adds their state to those
  stored before.
* ``distinct_state`` replaces the counts of all n-grams by a sketch of how many
  differ: a few kilobytes a group and order, in which the exact form moves every
  distinct n-gram.  The exact form stays the default of ``distinct_n``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..session import materialize, path_exists
from ..sources.io import resume_predictions
from .metrics import metric_tokens, ngram_counts, ngram_stats, ngrams, pair_scores

REPORT = ("rouge_l", "bleu_2", "bleu_4", "meteor")
REPORT_ORDER = 3  # n-grams of the report's dist_2
SKETCH_BITS = 14  # a sketch has 2^14 registers


# -------------------------------------------------------------------- report
def report_state(pairs: DataFrame, keys: list[str], response: str = "response", target: str = "target",
                 by: list[str] | None = None, rouge_mode: str = "sentence", stem: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, grams) of some pairs: (by, metric, total, n) and (by, ngram, count).

    The token table is written once and read by both.
    """
    by = by or []
    ids = keys + [c for c in by if c not in keys]
    toks = materialize(metric_tokens(pairs.select(*ids, response, target), ids, response, target), "report-tokens")
    scored = pair_scores(toks, ids, rouge_mode=rouge_mode, stem=stem)
    melted = scored.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                                   for m in REPORT])))
    scores = melted.groupBy(*by, "metric").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    grams = ngram_counts(toks, "hyp_tokens", (REPORT_ORDER,), by).select(*by, "ngram", "count")
    return scores, grams


def merge_reports(states: list[tuple[DataFrame, DataFrame]], by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The state of all parts together."""
    by = by or []
    scores, grams = states[0]
    for s, g in states[1:]:
        scores, grams = scores.unionByName(s), grams.unionByName(g)
    return (scores.groupBy(*by, "metric").agg(F.sum("total").alias("total"), F.sum("n").alias("n")),
            grams.groupBy(*by, "ngram").agg(F.sum("count").alias("count")))


def report_of(state: tuple[DataFrame, DataFrame], by: list[str] | None = None) -> DataFrame:
    """The report of a state, in the columns of ``generation_report``: a row, or a row a ``by`` group."""
    by = by or []
    scores, grams = state
    long = scores.select(*by, "metric", F.try_divide(F.col("total"), F.col("n").cast("double")).alias("value"))
    stats = ngram_stats(grams.withColumn("n", F.lit(REPORT_ORDER)), by)
    long = long.unionByName(stats.select(*by, F.lit("dist_2").alias("metric"), F.col("distinct_ratio").cast("double").alias("value")))
    return long.groupBy(*by).pivot("metric", [*REPORT, "dist_2"]).agg(F.round(F.first("value"), 4))


def store_report(state: tuple[DataFrame, DataFrame], path: str, part: str) -> None:
    """Keeps the state of one part under ``path``; the same part again replaces it."""
    if not re.fullmatch(r"[\w.-]+", part):
        raise ValueError("part: letters, digits, '_', '.', '-'")
    for name, df in zip(("scores", "grams"), state):
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/part={part}")


def stored_report(spark: SparkSession, path: str, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged state of all parts under ``path``."""
    parts = tuple(spark.read.parquet(f"{path.rstrip('/')}/{name}").drop("part") for name in ("scores", "grams"))
    return merge_reports([parts], by)


def resumed_report(inputs: DataFrame, done: DataFrame | None, keys: list[str], run, path: str, part: str,
                   response: str = "response", target: str = "target", by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new predictions, report over all) of a run that is taken up again.

    ``run`` gets the rows of ``inputs`` without a finished prediction in
    ``done`` and returns their pairs, which are written once; only those are
    tokenised and scored.  Their state is stored as ``part`` and the report read
    off all stored parts, so ``done`` must be the rows of the other parts.  A
    part that failed is run again under its name.
    """
    if done is not None and not path_exists(inputs.sparkSession, f"{path.rstrip('/')}/scores"):
        raise ValueError(f"finished predictions, but no stored state under {path}")
    rest = inputs if done is None else resume_predictions(inputs, done, keys)
    new = materialize(run(rest), "resumed-predictions")
    store_report(report_state(new, keys, response, target, by), path, part)
    return new, report_of(stored_report(inputs.sparkSession, path, by), by)


# ------------------------------------------------------------------ sketches
def distinct_state(df: DataFrame, tokens: str = "tokens", ns=(1, 2, 3, 4), by: list[str] | None = None,
                   bits: int = SKETCH_BITS) -> DataFrame:
    """Rows (by, n, total, sketch): how many n-grams there are and a sketch of how many differ.

    Each task sends one sketch a group and order, so what moves does not grow
    with the number of distinct n-grams.
    """
    by = by or []
    grams = df.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col(tokens), n).alias("_g")) for n in ns])))
    # outer explode and null filter, as in ngram_counts: the n-grams are not evaluated again for a filter
    single = grams.select(*by, "n", F.explode_outer("_g").alias("_gram")).filter(F.col("_gram").isNotNull())
    return single.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("total"), F.hll_sketch_agg("_gram", F.lit(bits)).alias("sketch"))


def merge_distinct(states: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """The state of all parts together; sketches of the same size or, if not, of the smallest."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy(*(by or []), "n").agg(F.sum("total").alias("total"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """Relative error of a merged sketch that is exceeded in one of some 400 cases (three standard errors)."""
    return 3 * 1.04 / math.sqrt(1 << bits)


def distinct_estimates(state: DataFrame, by: list[str] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """Rows (by, n, total, distinct, distinct_ratio, error): estimates with their relative error (``sketch_error``)."""
    by = by or []
    known = F.hll_sketch_estimate("sketch")
    return state.select(*by, "n", "total", known.alias("distinct"),
                        F.round(known / (F.col("total") + F.lit(C.NGRAM_EPS)), 6).alias("distinct_ratio"),
                        F.lit(sketch_error(bits)).alias("error"))
