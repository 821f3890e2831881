"""Splits, shuffled batches, shards, packing, padding and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.arrays import pad_right
from ..functions.keyed import keyed_uniform
from ..plans.numbering import dense_row_number


def assign_split(df: DataFrame, key_cols: list[str], eval_fraction: float = 0.1,
                 seed: int = C.SEED) -> DataFrame:
    """``split`` = 'eval' for a keyed-hash fraction of keys, else 'train'."""
    u = keyed_uniform(seed, "split", *key_cols)
    return df.withColumn("split", F.when(u < eval_fraction, F.lit("eval")).otherwise(F.lit("train")))


def batch_numbers(keys: DataFrame, key_cols: list[str], batch_size: int, seed: int = C.SEED,
                  bucket_by: str | None = None) -> DataFrame:
    """``(key_cols, batch_id, row_in_batch, _rn)`` for a narrow table of unique keys.

    The shuffle order is a keyed hash (after ``bucket_by`` when given); global
    positions come from the size-checked numbering (``dense_row_number``).
    """
    extra = [bucket_by] if bucket_by else []
    narrow = keys.select(*key_cols, *extra).withColumn("_u", keyed_uniform(seed, "shuffle", *key_cols))
    order = [F.col(c) for c in extra] + [F.col("_u"), *[F.col(k) for k in key_cols]]
    numbered = dense_row_number(narrow, order, "_rn").drop(*extra, "_u")
    return numbered.withColumn("batch_id", F.floor((F.col("_rn") - 1) / batch_size).cast("bigint")) \
                   .withColumn("row_in_batch", F.pmod(F.col("_rn") - 1, F.lit(batch_size)).cast("int"))


def assign_batches(df: DataFrame, key_cols: list[str], batch_size: int, seed: int = C.SEED,
                   drop_last: bool = False, bucket_by: str | None = None,
                   keys: DataFrame | None = None) -> DataFrame:
    """Seeded shuffle into fixed-size batches: ``batch_id``, ``row_in_batch``.

    Only the (narrow, unique) keys are numbered; the numbers are joined back
    on the key, so wide rows are shuffled once.  ``keys`` may supply the key
    table from an earlier, cheaper stage (otherwise it is taken from ``df``,
    which is then read twice).  ``bucket_by`` (e.g. a length bucket) orders
    rows by bucket first, so a batch holds rows of similar length and padding
    shrinks; rows are still shuffled inside a bucket.
    """
    src = keys if keys is not None else df
    numbered = batch_numbers(src, key_cols, batch_size, seed, bucket_by)
    d = df.join(numbered, key_cols)
    if drop_last:
        total = numbered.agg(F.max("_rn")).first()[0] or 0
        d = d.filter(F.col("batch_id") < total // batch_size)
    return d.drop("_rn")


def shard_rows(df: DataFrame, order_cols: list[str], n_shards: int, batch_size: int) -> DataFrame:
    """Worker ``i`` takes batches ``i, i+n, i+2n, ...`` of the ordered rows."""
    # order_cols are unique: number them alone, then join back
    numbered = dense_row_number(df.select(*order_cols), [F.col(c) for c in order_cols], "_rn")
    d = df.join(numbered, order_cols)
    b = F.floor((F.col("_rn") - 1) / batch_size)
    return d.withColumn("batch_index", b.cast("bigint")) \
            .withColumn("shard", F.pmod(b, F.lit(n_shards)).cast("int")).drop("_rn")


def pad_batch(df: DataFrame, batch_col: str, pads: dict[str, object], multiple: int = 1,
              length_of: str | None = None) -> DataFrame:
    """Right-pad each array column to the batch maximum rounded up to ``multiple``.

    The batch maximum is a window over one batch (bounded by the batch size).
    """
    first = length_of or next(iter(pads))
    w = Window.partitionBy(batch_col)
    mx = F.max(F.size(first)).over(w)
    target = (F.ceil(mx / F.lit(multiple)) * multiple).cast("int")
    d = df.withColumn("padded_length", target)
    for c, v in pads.items():
        d = d.withColumn(c, pad_right(F.col(c), F.col("padded_length"), v))
    return d


def pack_short(df: DataFrame, batch_col: str, order_col: str, arrays: list[str], key_cols: list[str],
               max_length: int, threshold: int = C.MIX_LENGTH_THRESHOLD,
               mix_p: float = C.MIX_PROBABILITY, seed: int = C.SEED) -> DataFrame:
    """Pack pairs of short rows inside a batch: later row's arrays, then earlier.

    A row is eligible when shorter than ``threshold`` and its keyed draw is
    above ``mix_p``.  Eligible rows pair up in batch order; an odd one stays
    alone.  Packed arrays are clipped to ``max_length``.  Groups are batches.
    """
    first = arrays[0]
    u = keyed_uniform(seed, "mix", *key_cols)
    d = df.withColumn("_elig", (F.size(first) < threshold) & (u > mix_p))
    w = Window.partitionBy(batch_col, "_elig").orderBy(order_col)
    d = d.withColumn("_k", F.row_number().over(w) - 1)
    cnt = F.count(F.lit(1)).over(Window.partitionBy(batch_col, "_elig"))
    d = d.withColumn("_grp", F.when(F.col("_elig") & ~((F.col("_k") == cnt - 1) & (F.pmod(cnt, F.lit(2)) == 1)),
                                    F.floor(F.col("_k") / 2)).otherwise(F.lit(None)))
    single = d.filter(F.col("_grp").isNull()).select(
        batch_col, F.col(order_col), *arrays, F.lit(False).alias("packed"))
    pairs = d.filter(F.col("_grp").isNotNull())
    agg = [F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), *[F.col(a) for a in arrays]))).alias("_m")]
    g = pairs.groupBy(batch_col, "_grp").agg(*agg)
    # later element first, then the earlier one, clipped
    out_cols = [F.slice(F.concat(F.get("_m", 1)[a], F.get("_m", 0)[a]), 1, max_length).alias(a) for a in arrays]
    packed = g.select(batch_col, F.get("_m", 1)["o"].alias(order_col), *out_cols, F.lit(True).alias("packed"))
    return single.unionByName(packed)


def length_stats(df: DataFrame, length: Column, max_length: int, by: list[str] | None = None) -> DataFrame:
    """Token length clipped to ``max_length``: min, max, mean, median, over-length share.

    The exact median aggregates value counts; clipped lengths have at most
    ``max_length + 1`` distinct values, so its state is bounded.
    """
    d = df.withColumn("_len", F.least(length, F.lit(max_length))).withColumn("_over", (length > max_length).cast("int"))
    aggs = [F.count(F.lit(1)).alias("n"),
            F.min("_len").cast("bigint").alias("min_len"), F.max("_len").cast("bigint").alias("max_len"),
            F.round(F.avg("_len"), 6).alias("mean_len"),
            F.round(F.percentile(F.col("_len"), F.lit(0.5)), 6).alias("median_len"),
            F.round(F.avg("_over"), 6).alias("over_share")]
    return d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)
