"""Loss values as aggregations (no autograd: values only).

Cross-entropy and poly loss are row-local expressions on a logits array
followed by one aggregate.  The pairwise ranking losses need a sum over all
ordered candidate pairs of a conversation; pairs are never materialised as
rows.  Candidates are cut into rank blocks of bounded size, each pair of
blocks ``(a <= b)`` of a conversation becomes one row keyed by
``(conv, a, b)`` (so a conversation with very many candidates spreads over
many tasks), and a vectorised kernel sums the block pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .. import constants as C
from ..functions.arrays import logsumexp
from ..plans.numbering import running_sum
from ..session import materialize


# ---------------------------------------------------------------- token losses

def _row_ce(logits: str, target: str):
    lse = logsumexp(F.col(logits))
    t = F.col(target)
    ignored = t == C.IGNORE_INDEX
    in_range = (t >= 0) & (t < F.size(logits))
    wrong = F.raise_error(F.concat(F.lit("target out of range: "), F.coalesce(t.cast("string"), F.lit("null"))))
    tgt = F.when(in_range, F.get(F.col(logits), t)).when(ignored, F.lit(None)).otherwise(wrong).cast("double")
    return lse, tgt, ignored


def masked_cross_entropy(df: DataFrame, logits: str = "logits", target: str = "target",
                         mask: str | None = "mask", reduction: str = "mean",
                         by: list[str] | None = None) -> DataFrame:
    """Σ CE over kept rows / (kept rows + 1e-8); -100 targets add 0 but are counted.

    Any other target outside the logits (or a null one) raises.
    """
    d = df.filter(F.col(mask)) if mask else df
    lse, tgt, ignored = _row_ce(logits, target)
    d = d.withColumn("ce", F.when(ignored, F.lit(0.0)).otherwise(lse - tgt))
    if reduction == "none":
        return d
    agg = [F.count(F.lit(1)).alias("n"),
           F.round(F.sum("ce") / (F.count(F.lit(1)) + F.lit(C.CE_EPS)), 6).alias("loss")]
    return d.groupBy(*by).agg(*agg) if by else d.agg(*agg)


def poly_loss(df: DataFrame, logits: str = "logits", target: str = "target", mask: str | None = "mask",
              epsilon: float = C.POLY_EPSILON, reduction: str = "mean", by: list[str] | None = None) -> DataFrame:
    """CE + ε (1 − p_target); rows with target -100 have no one-hot and are left out."""
    d = df.filter(F.col(mask)) if mask else df
    d = d.filter(F.col(target) != C.IGNORE_INDEX)
    lse, tgt, _ = _row_ce(logits, target)
    ce = lse - tgt
    d = d.withColumn("poly", ce + F.lit(epsilon) * (F.lit(1.0) - F.exp(tgt - lse)))
    if reduction == "none":
        return d
    red = F.avg("poly") if reduction == "mean" else F.sum("poly")
    agg = [F.count(F.lit(1)).alias("n"), F.round(red, 6).alias("loss")]
    return d.groupBy(*by).agg(*agg) if by else d.agg(*agg)


# ---------------------------------------------------------------- pair sums

@pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("sp", T.DoubleType()),
                          T.StructField("sq", T.DoubleType()), T.StructField("margin", T.DoubleType())]))
def _block_pair_kernel(ra: pd.Series, sa: pd.Series, rb: pd.Series, sb: pd.Series) -> pd.DataFrame:
    n_out, sp_out, sq_out, mg_out = [], [], [], []
    for r1, s1, r2, s2 in zip(ra, sa, rb, sb):
        r1 = np.asarray(r1, dtype=np.int64)
        r2 = np.asarray(r2, dtype=np.int64)
        s1 = np.asarray(s1, dtype=np.float64)
        s2 = np.asarray(s2, dtype=np.float64)
        keep = r1[:, None] < r2[None, :]          # earlier rank is the better one
        d = s2[None, :] - s1[:, None]             # negative minus positive
        sp = np.maximum(d, 0.0) + np.log1p(np.exp(-np.abs(d)))
        sq = 0.5 * (s1[:, None] ** 2 + s2[None, :] ** 2)
        n_out.append(int(keep.sum()))
        sp_out.append(float(sp[keep].sum()))
        sq_out.append(float(sq[keep].sum()))
        mg_out.append(float((-d)[keep].sum()))
    return pd.DataFrame({"n": n_out, "sp": sp_out, "sq": sq_out, "margin": mg_out})


def preference_pair_sums(df: DataFrame, conv: str = "conv_id", rank: str = "rank", score: str = "score",
                         block: int = 1024) -> DataFrame:
    """Per conversation, over all pairs i<j by rank (i preferred):

    ``n_pairs``, ``sp_sum`` = Σ softplus(s_j − s_i) (= −log σ(s_i − s_j)),
    ``sq_sum`` = Σ ½(s_i² + s_j²), ``margin_sum`` = Σ (s_i − s_j).
    Ranks are integers, negative, sparse or dense; equal ranks make no pair.
    """
    c = df.select(F.col(conv).alias("conv"), F.col(rank).cast("bigint").alias("r"), F.col(score).cast("double").alias("s"))
    # blocks of `block` candidates whatever the ranks: dense places by a blocked running count
    c = running_sum(c.withColumn("one", F.lit(1)), ["conv"], "r", {"one": "place"})
    c = c.withColumn("blk", F.expr(f"(place - 1) div {int(block)}"))
    blocks = c.groupBy("conv", "blk").agg(F.array_sort(F.collect_list(F.struct("r", "s"))).alias("cs"))
    # both sides of the block-pair join read the blocks: write them once
    blocks = materialize(blocks, "rank-blocks")
    nblk = blocks.groupBy("conv").agg(F.max("blk").alias("last"))
    bl = blocks.join(nblk, "conv")
    # left side: block a paired with every b >= a; right side: block b with every a <= b
    left = bl.select("conv", F.col("blk").alias("a"), F.explode(F.sequence(F.col("blk"), F.col("last"))).alias("b"),
                     F.col("cs").alias("ca"))
    right = bl.select("conv", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blk"))).alias("a"),
                      F.col("blk").alias("b"), F.col("cs").alias("cb"))
    pairs = left.join(right, ["conv", "a", "b"])
    k = _block_pair_kernel(F.transform("ca", lambda x: x["r"]), F.transform("ca", lambda x: x["s"]),
                           F.transform("cb", lambda x: x["r"]), F.transform("cb", lambda x: x["s"]))
    sums = pairs.select("conv", k.alias("k")).groupBy("conv").agg(
        F.sum("k.n").alias("n_pairs"), F.sum("k.sp").alias("sp_sum"),
        F.sum("k.sq").alias("sq_sum"), F.sum("k.margin").alias("margin_sum"))
    return sums.withColumnRenamed("conv", conv)


def ranking_loss(df: DataFrame, conv: str = "conv_id", rank: str = "rank", score: str = "score",
                 beta: float = C.RANK_BETA, reduction: str = "mean") -> DataFrame:
    """Per conversation mean over pairs of −log σ(pos − neg) + β ½(pos² + neg²), then mean.

    Conversations with fewer than two candidates have no pairs and are left out.
    """
    s = preference_pair_sums(df, conv, rank, score).filter(F.col("n_pairs") > 0)
    per = s.select(conv, ((F.col("sp_sum") + F.lit(beta) * F.col("sq_sum")) / F.col("n_pairs")).alias("loss"))
    if reduction == "none":
        return per
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


def pair_classification_loss(df: DataFrame, conv: str = "conv_id", rank: str = "rank",
                             score: str = "score", reduction: str = "mean") -> DataFrame:
    """2-way cross-entropy with class 0 (the preferred one) per pair, mean over all pairs."""
    s = preference_pair_sums(df, conv, rank, score)
    if reduction == "none":
        return s
    return s.agg(F.sum("n_pairs").alias("n"),
                 F.round(F.try_divide(F.sum("sp_sum"), F.sum("n_pairs").cast("double")), 6).alias("loss"))


def _token_loss(fn, **options):
    return lambda logits_df, ranked_df: fn(logits_df, **options)


def _pair_loss(fn, **options):
    return lambda logits_df, ranked_df: fn(ranked_df, **options)


LOSSES = ("CrossEntropyLoss", "Poly", "RMLoss", "RMCLSLoss")


def loss_report(name: str, logits_df: DataFrame | None = None, ranked_df: DataFrame | None = None,
                poly_eps: float = C.POLY_EPSILON, score_l2_reg: float = C.RANK_BETA) -> DataFrame:
    """``(loss, n, value)`` of one of ``LOSSES``; other names raise a KeyError that lists them."""
    runs = dict(zip(LOSSES, (_token_loss(masked_cross_entropy), _token_loss(poly_loss, epsilon=poly_eps),
                             _pair_loss(ranking_loss, beta=score_l2_reg), _pair_loss(pair_classification_loss))))
    if name not in runs:
        raise KeyError(f"{name}: known losses are {', '.join(LOSSES)}")
    r = runs[name](logits_df, ranked_df)
    return r.select(F.lit(name).alias("loss"), F.col("n").cast("bigint").alias("n"), F.col("loss").alias("value"))
