"""Token losses and predictions over logits that come in slices of the vocabulary.

A row of the table is a slice of one position's logits: its keys, the index of
its first entry and an array of entries, down to one entry a row.  Slices may be
cut anywhere and come in any order.  The partial state of a log-sum-exp is an
exponent and a sum scaled by it: ``exp(l - 32 b)`` with ``b = floor(l / 32)`` for
a slice's log-sum-exp ``l``.  States of one exponent simply add up, so partial
aggregation on the map side leaves a few rows a position; those few are brought
to the largest exponent at the end.  The prediction is a maximum over structs of
(logit, negated index): the first of the largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.arrays import argmax_index, logsumexp

_STEP = 32.0


def row_states(df: DataFrame, keys: list[str], start: str = "start", logits: str = "logits", target: str | None = "target",
               carry: list[str] | None = None) -> DataFrame:
    """Rows (keys, size, lse, pred, target, target_logit, carry) with one row a position.

    ``target`` and the columns ``carry`` are the same in all slices of a
    position.  Entries of -inf add nothing; a NaN or +inf gives a NaN ``lse``, as
    in the array form.  Null entries are not allowed for; empty slices add
    nothing.  Slices that overlap, come twice or leave a gap raise.
    """
    carry = [c for c in carry or [] if c not in keys]
    held = F.lit(None).cast("int") if target is None else F.col(target)
    x, at = F.col(logits), F.col(start).cast("bigint")
    local = held - at
    part = df.filter(F.size(x) > 0).select(
        *keys, *carry, held.alias("_target"), at.alias("_at"), F.size(x).cast("bigint").alias("_n"), logsumexp(x).alias("_l"),
        F.struct(F.array_max(x).cast("double").alias("v"), (-(at + argmax_index(x))).alias("i")).alias("_best"),
        F.when((local >= 0) & (local < F.size(x)), F.get(x, local.cast("int"))).cast("double").alias("_hit"))
    finite = ~F.isnan("_l") & (F.abs("_l") < float("inf"))
    part = part.withColumn("_bin", F.when(finite, F.floor(F.col("_l") / _STEP)))
    part = part.withColumn("_sum", F.when(finite, F.exp(F.col("_l") - F.col("_bin") * _STEP)))
    rest = [F.max(F.struct(c)).alias(c) for c in ("_target", *carry)]  # in structs, so that nulls are values too
    binned = part.groupBy(*keys, "_bin").agg(
        F.sum("_sum").alias("_sum"), F.max("_best").alias("_best"), F.max("_hit").alias("_hit"), F.sum("_n").alias("_n"),
        F.min("_at").alias("_first"), F.max(F.col("_at") + F.col("_n")).alias("_end"),
        F.max(F.isnan("_l") | (F.col("_l") == float("inf"))).alias("_odd"), *rest)
    whole = binned.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("_bin").alias("b"), F.col("_sum").alias("s"))).alias("_states"), F.max("_bin").alias("_top"),
        F.max("_best").alias("_best"), F.max("_hit").alias("_hit"), F.sum("_n").alias("_n"), F.min("_first").alias("_first"),
        F.max("_end").alias("_end"), F.max("_odd").alias("_odd"), *[F.max(c).alias(c) for c in ("_target", *carry)])
    sums = F.aggregate(F.filter("_states", lambda x: x["b"].isNotNull()), F.lit(0.0),
                       lambda acc, x: acc + x["s"] * F.exp((x["b"] - F.col("_top")) * _STEP))
    lse = (F.when(F.col("_odd"), F.lit(float("nan"))).when(F.col("_top").isNull(), F.lit(float("-inf")))
           .otherwise(F.col("_top") * _STEP + F.log(sums)))
    gap = F.raise_error(F.concat(F.lit("slices overlap or leave a gap: entries "), F.col("_n").cast("string"), F.lit(", end "),
                                 F.col("_end").cast("string")))
    size = F.when((F.col("_first") == 0) & (F.col("_n") == F.col("_end")), F.col("_end")).otherwise(gap.cast("bigint"))
    return whole.select(*keys, size.alias("size"), lse.alias("lse"), (-F.col("_best.i")).cast("int").alias("pred"),
                        F.col("_target._target").alias("target"), F.col("_hit").alias("target_logit"),
                        *[F.col(c)[c].alias(c) for c in carry])


def _kept(df: DataFrame, keys, start, logits, target, mask, by) -> DataFrame:
    """States of the rows that the mask keeps, with ``ignored``; a target outside the logits raises."""
    d = row_states(df.filter(F.col(mask)) if mask else df, keys, start, logits, target, by)
    ignored = F.col("target") == C.IGNORE_INDEX
    wrong = F.raise_error(F.concat(F.lit("target out of range: "), F.coalesce(F.col("target").cast("string"), F.lit("null"))))
    inside = (F.col("target") >= 0) & (F.col("target") < F.col("size"))
    return d.withColumn("ignored", F.when(ignored, F.lit(True)).when(inside, F.lit(False)).otherwise(wrong.cast("boolean")))


def masked_cross_entropy(df: DataFrame, keys: list[str], start: str = "start", logits: str = "logits",
                         target: str = "target", mask: str | None = "mask", by: list[str] | None = None) -> DataFrame:
    """``losses.masked_cross_entropy`` over slices: (n, loss), with ``by`` for each group."""
    d = _kept(df, keys, start, logits, target, mask, by)
    ce = F.when(F.col("ignored"), F.lit(0.0)).otherwise(F.col("lse") - F.col("target_logit"))
    agg = [F.count(F.lit(1)).alias("n"), F.round(F.sum(ce) / (F.count(F.lit(1)) + F.lit(C.CE_EPS)), 6).alias("loss")]
    return d.groupBy(*by).agg(*agg) if by else d.agg(*agg)


def poly_loss(df: DataFrame, keys: list[str], start: str = "start", logits: str = "logits", target: str = "target",
              mask: str | None = "mask", epsilon: float = C.POLY_EPSILON, by: list[str] | None = None) -> DataFrame:
    """``losses.poly_loss`` over slices: (n, loss) without the ignored targets, with ``by`` for each group."""
    d = _kept(df, keys, start, logits, target, mask, by).filter(~F.col("ignored"))
    ce = F.col("lse") - F.col("target_logit")
    poly = ce + F.lit(epsilon) * (F.lit(1.0) - F.exp(-ce))
    agg = [F.count(F.lit(1)).alias("n"), F.round(F.avg(poly), 6).alias("loss")]
    return d.groupBy(*by).agg(*agg) if by else d.agg(*agg)


def predictions(df: DataFrame, keys: list[str], start: str = "start", logits: str = "logits") -> DataFrame:
    """Rows (keys, pred): index of each position's largest logit, the first of equal ones."""
    return row_states(df, keys, start, logits, target=None).select(*keys, "pred")
