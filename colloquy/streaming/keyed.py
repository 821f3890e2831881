"""Running accuracy by key, over prediction files that may arrive more than once.

The state of a key lives in the state store: right and counted predictions, and
which batches it has seen, as ranges of batch ids.  A batch is the unit of
delivery: all rows of a key and batch come in one file.  A file that is
delivered again, in the same micro-batch, a later one or after a restart, finds
its batches among those seen and changes nothing.

Predictions are summed by key, batch and file where they are read, so a key that
holds most rows sends a few sums a task to its state, not its rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C
from ..session import path_exists, scratch_path

STATE = "right long, total long, seen string"


def add_batch(seen: list[list[int]], batch: int) -> bool:
    """Adds a batch id to sorted, disjoint ranges [first, last] in place; False if it was there."""
    lo, hi = 0, len(seen)
    while lo < hi:
        mid = (lo + hi) // 2
        if seen[mid][1] < batch:
            lo = mid + 1
        else:
            hi = mid
    if lo < len(seen) and seen[lo][0] <= batch:
        return False
    left = lo > 0 and seen[lo - 1][1] == batch - 1
    right = lo < len(seen) and seen[lo][0] == batch + 1
    if left and right:
        seen[lo - 1][1] = seen.pop(lo)[1]
    elif left:
        seen[lo - 1][1] = batch
    elif right:
        seen[lo][0] = batch
    else:
        seen.insert(lo, [batch, batch])
    return True


def _partial_sums(by: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pdf.groupby(by, dropna=False, as_index=False)[["right", "total"]].sum()
    return run


def _count(keys: list[str]):
    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums: dict[int, dict[str, list[int]]] = {}
        for pdf in frames:
            for batch, file, r, t in pdf[["batch", "file", "right", "total"]].itertuples(index=False):
                have = sums.setdefault(int(batch), {}).setdefault(file, [0, 0])
                have[0], have[1] = have[0] + int(r), have[1] + int(t)
        right, total, seen = state.get if state.exists else (0, 0, "[]")
        ranges, changed = json.loads(seen), not state.exists
        for batch, files in sorted(sums.items()):
            if add_batch(ranges, batch):
                r, t = files[min(files)]  # several files: copies of one delivery
                right, total, changed = right + r, total + t, True
        state.update((right, total, json.dumps(ranges)))
        if changed:
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "right": [right], "total": [total]})
    return run


def _accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    ratio = F.try_divide(F.col("right").cast("double"), F.col("total").cast("double"))
    return df.select(*keys, "right", "total", F.round(ratio, 6).alias("accuracy"))


def keyed_accuracy_stream(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, right, total) of the keys that a micro-batch changes, in update mode.

    ``stream`` has the keys, ``batch`` (not null), ``file``, ``pred`` and
    ``label``; predictions with label -100 are not counted, but their key and
    batch count as seen.
    """
    kept = F.col("label") != C.IGNORE_INDEX
    marked = stream.select(*keys, F.col("batch").cast("long").alias("batch"), "file",
                           F.coalesce(kept & (F.col("pred") == F.col("label")), F.lit(False)).cast("long").alias("right"),
                           F.coalesce(kept, F.lit(False)).cast("long").alias("total"))
    sums = marked.mapInPandas(_partial_sums([*keys, "batch", "file"]), marked.schema)
    kinds = [f"`{k}` {marked.schema[k].dataType.simpleString()}" for k in keys]
    return sums.groupBy(*keys).applyInPandasWithState(
        _count(keys), ", ".join([*kinds, "right long", "total long"]), STATE, "update", GroupStateTimeout.NoTimeout)


def run_keyed_accuracy(spark: SparkSession, source_dir: str, schema: T.StructType, keys: list[str],
                       files_per_trigger: int | None = None, state_path: str | None = None) -> DataFrame:
    """Drives the stream over all files present now; rows (keys, right, total, accuracy).

    ``schema`` has the keys, ``batch``, ``pred`` and ``label``.  A call with the
    same ``state_path`` carries on where the last one stopped, also one that
    failed.  Every micro-batch writes the keys it changed to a folder of its own
    number, so one that runs again replaces its rows; the result is each key's
    last row.
    """
    base = (state_path or scratch_path(spark, "keyed-accuracy")).rstrip("/")
    out = f"{base}/changes"
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(source_dir).withColumn("file", F.col("_metadata.file_path"))

    def sink(changes: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{out}/number={number}")

    q = (keyed_accuracy_stream(rows, keys).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, out):
        return keyed_accuracy(spark.createDataFrame([], schema), keys)
    last = spark.read.parquet(out).groupBy(*keys).agg(F.max_by(F.struct("right", "total"), "number").alias("x"))
    return _accuracy(last.select(*keys, "x.right", "x.total"), keys)


def keyed_accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Batch twin: rows (keys, right, total, accuracy) of predictions that came once."""
    kept = F.col("label") != C.IGNORE_INDEX
    return _accuracy(rows.groupBy(*keys).agg(F.count_if(kept & (F.col("pred") == F.col("label"))).alias("right"),
                                             F.count_if(kept).alias("total")), keys)
