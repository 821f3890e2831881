"""Sharding by a two-pass external shuffle (DataFrame functions only).

Pass one scatters the records uniformly into memory-sized buckets by a seeded
hash of the record; pass two loads each bucket, Fisher-Yates shuffles it (the
built-in ``shuffle`` of arrays is that algorithm, seeded) and gives the records
their places: the buckets one after another form a uniformly shuffled order,
which is cut into shards of equal row counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import running_sum
from .common import packed, row_key, total, unpacked

N_SHARDS = 16
BUCKET_BYTES = 16 << 20
SEED = 42


def external_shuffle(df: DataFrame, size: Column, n_shards: int = N_SHARDS, bucket_bytes: int = BUCKET_BYTES,
                     seed: int = SEED, key: Sequence[str] | None = None) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``n_shards``-1) and ``slot`` (0, 1, ... in the shard).

    ``size`` is the bytes a row counts as when the number of buckets is chosen
    (null: 0); ``key`` names the columns whose hash picks the bucket (default:
    all).  Row counts of shards differ by one at most; so does an empty shard's
    when there are fewer rows than shards.  The order of a bucket before its
    shuffle is fixed by sorting, so a rerun or a retried task gives the same
    places.  Rows that are equal in all columns (repeated rows) each get a
    place of their own.  An empty table gives an empty result.  Columns named
    ``shard`` or ``slot`` are replaced.  Columns must be orderable (no maps).
    """
    names = df.columns
    rows, volume = total(df.select(size.alias("size")), F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)))
    n_buckets = max(1, -(-int(volume) // bucket_bytes))
    h1, h2 = row_key([F.col("rec")[c] for c in (key or names)], seed)
    records = packed(df).withColumns({"h": h1, "bucket": F.pmod(h2, F.lit(n_buckets))})

    # places of the buckets in the whole order: exclusive sums over bucket numbers
    counts = records.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(0))
    starts = running_sum(counts, ["g"], "bucket", {"n": "start"}, inclusive=False).select("bucket", "start")

    buckets = (records.repartition(n_buckets, "bucket")
               .groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("h", "rec"))).alias("held"))
               .sortWithinPartitions("bucket")
               .select("bucket", F.shuffle("held", seed).alias("held")))
    placed = (buckets.join(starts, "bucket")
              .select("start", F.posexplode("held").alias("i", "held"))
              .select(F.col("held.rec").alias("rec"), (F.col("start") + F.col("i")).alias("place")))
    shard = F.expr(f"cast(place * {n_shards} div {max(rows, 1)} as int)")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(cast(shard as bigint) * {rows} + {n_shards - 1}) div {n_shards}")
    placed = placed.withColumn("slot", (F.col("place") - first).cast("bigint"))
    return unpacked(placed, names, ["shard", "slot"])


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as Parquet, one folder per shard, rows in slot order."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus one (null: just one)."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")
