"""Running token accuracy over a stream of prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..plans.numbering import running_sum
from ..session import path_exists, scratch_path

PRED_SCHEMA = T.StructType([T.StructField("batch", T.LongType()), T.StructField("pred", T.IntegerType()),
                            T.StructField("label", T.IntegerType())])


def running_accuracy(stream: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """``(right, total, accuracy)`` accumulated over everything seen; -100 labels ignored.

    Works on a streaming or a batch DataFrame (the same expressions).
    """
    d = stream.filter(F.col(label) != C.IGNORE_INDEX)
    return d.agg(F.sum((F.col(pred) == F.col(label)).cast("bigint")).alias("right"),
                 F.count(F.lit(1)).alias("total")) \
            .withColumn("accuracy", F.round(F.try_divide(F.col("right").cast("double"),
                                                         F.col("total").cast("double")), 6))


def running_accuracy_by_batch(df: DataFrame, batch: str = "batch", pred: str = "pred",
                              label: str = "label") -> DataFrame:
    """Batch twin of the stream: accuracy accumulated after each batch, in batch order.

    Per-batch sums are a partial aggregate; the cumulative sums over batches use
    the blocked prefix sum, so no window sees all batches in one task.
    """
    per = df.filter(F.col(label) != C.IGNORE_INDEX).groupBy(batch).agg(
        F.sum((F.col(pred) == F.col(label)).cast("bigint")).alias("_r"), F.count(F.lit(1)).alias("_t"))
    cum = running_sum(per, [], batch, {"_r": "right", "_t": "total"})
    return cum.select(batch, "right", "total",
                      F.round(F.try_divide(F.col("right").cast("double"), F.col("total").cast("double")), 6)
                      .alias("accuracy"))


def run_running_accuracy(spark: SparkSession, source_dir: str, schema: T.StructType = PRED_SCHEMA,
                         files_per_trigger: int | None = None, state_path: str | None = None) -> DataFrame:
    """Drive the stream over all files present now and return the final state.

    Every micro-batch overwrites a one-row result table (complete mode).  State
    and result live under ``state_path`` (default: a fresh folder under the
    shared checkpoint folder); a later call with the same path reads only new
    files and carries the counts on.  ``files_per_trigger`` bounds a
    micro-batch (default: everything that is there).  Before any file came the
    state is that of no rows.
    """
    base = (state_path or scratch_path(spark, "running-accuracy")).rstrip("/")
    out = f"{base}/result"
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    agg = running_accuracy(reader.parquet(source_dir))

    def sink(batch_df: DataFrame, epoch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(out)

    q = (agg.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, out):
        return running_accuracy(spark.createDataFrame([], schema))
    return spark.read.parquet(out)
