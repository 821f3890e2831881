"""Distributed numbering and segmented running sums.

No operator here brings rows to the driver or runs an un-partitioned window
over a table whose size is not checked:

* ``dense_row_number`` counts first: a table of at most ``small_limit`` rows is
  numbered by one window (its size is proven); a larger one goes to
* ``global_row_number``, which ranks rows by a total order with a
  range-partitioned sort; each partition numbers its own rows and a
  per-partition count table (one row per partition, a proven size bound)
  supplies the offsets.
* ``running_sum`` is a prefix sum inside groups that may be huge: rows are cut
  into fixed-size blocks of the ordering column, each block is summed on its
  own, block totals get their own (much smaller) prefix sum, and the two are
  added.  A hot group therefore spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_row_number(df: DataFrame, order_cols: list, out: str = "rn") -> DataFrame:
    """1-based row number over a total order (``order_cols`` must be unique)."""
    ordered = df.orderBy(*order_cols)
    tagged = (ordered
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()
                          - (F.spark_partition_id().cast("bigint") * F.lit(8589934592))))
    # The counts and the rows must see the same partitioning of the sort;
    # range bounds come from sampling, so the sorted, tagged rows are
    # checkpointed once to the shared checkpoint folder (spark.checkpoint.dir)
    # and both branches read that copy (it also survives lost executors).
    # Callers number narrow key tables, so this copy is small.
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("_part", F.coalesce("_off", F.lit(0)).alias("_off"))
    # one row per partition of the sort: bounded by the partition count
    return (tagged.join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_off") + F.col("_local") + 1)
            .drop("_part", "_local", "_off"))


def dense_row_number(df: DataFrame, order_cols: list, out: str = "rn", small_limit: int = 1_000_000) -> DataFrame:
    """1-based row number over a total order; the distributed path when large.

    The row count is checked first (bounded by ``small_limit + 1``): a table of
    at most ``small_limit`` rows is numbered by one window in one task (its size
    is proven), a larger one by ``global_row_number``.
    """
    n = df.limit(small_limit + 1).count()
    if n <= small_limit:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order_cols)).cast("bigint"))
    return global_row_number(df, order_cols, out)


def running_sum(df: DataFrame, group_cols: list[str], order_col: str, values: dict[str, str],
                inclusive: bool = True, block: int = 4096, totals_out: str | None = None,
                block_col: str | None = None) -> DataFrame:
    """Prefix sums per group ordered by integer ``order_col``.

    ``values`` maps input column -> output column.  ``order_col`` must be unique
    inside a group.  Exclusive sums (``inclusive=False``) leave out the row.
    ``totals_out`` (optional) adds the group total of the first value column.

    Block totals are taken from the windowed rows, so both branches share the
    one shuffle under the window and the input is computed once.
    ``block_col`` names an existing column equal to ``floor(order / block)``;
    when the input is stored bucketed by ``(group, block_col)`` the windows need
    no shuffle of the input at all.
    """
    blk = F.col(block_col) if block_col else F.floor(F.col(order_col) / block).cast("bigint")
    d = df.withColumn("_blk", blk)
    w_local = (Window.partitionBy(*group_cols, "_blk").orderBy(order_col)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for i, v in enumerate(values):
        d = d.withColumn(f"_loc_{i}", F.sum(v).over(w_local))
    # the local sum at the block's last row is the block total; reading it from
    # the windowed rows keeps Catalyst from pruning the window off this branch
    totals = d.groupBy(*group_cols, "_blk").agg(*[F.max_by(f"_loc_{i}", order_col).alias(f"_bt_{i}")
                                                  for i in range(len(values))])
    w_blk = (Window.partitionBy(*group_cols).orderBy("_blk")
             .rowsBetween(Window.unboundedPreceding, -1))
    extra = []
    if totals_out:
        extra = [F.sum("_bt_0").over(Window.partitionBy(*group_cols)).alias(totals_out)]
    offs = totals.select(*group_cols, "_blk", *[F.coalesce(F.sum(f"_bt_{i}").over(w_blk), F.lit(0)).alias(f"_bo_{i}")
                                                for i in range(len(values))], *extra)
    d = d.join(offs, [*group_cols, "_blk"])
    for i, (v, out) in enumerate(values.items()):
        val = F.col(f"_bo_{i}") + F.col(f"_loc_{i}")
        if not inclusive:
            val = val - F.col(v)
        d = d.withColumn(out, val.cast("bigint")).drop(f"_bo_{i}", f"_loc_{i}")
    return d.drop("_blk")
