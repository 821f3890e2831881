"""Keyed running accuracy: repeated deliveries, restarts, and the batch twin."""

import random

from pyspark.sql import types as T

from colloquy.session import scratch_path
from colloquy.streaming.keyed import add_batch, keyed_accuracy, run_keyed_accuracy

SCHEMA = T.StructType([T.StructField("model", T.StringType()), T.StructField("batch", T.LongType()),
                       T.StructField("pred", T.IntegerType()), T.StructField("label", T.IntegerType())])


def test_ranges_remember_a_set():
    rng = random.Random(1)
    for _ in range(200):
        seen, want = [], set()
        for _ in range(rng.randint(0, 60)):
            b = rng.randint(-5, 25)
            assert add_batch(seen, b) == (b not in want)
            want.add(b)
        assert [x for lo, hi in seen for x in range(lo, hi + 1)] == sorted(want)
        assert all(a[1] + 1 < b[0] for a, b in zip(seen, seen[1:]))


def rows_of(batch):
    rng = random.Random(batch)
    return [(m, batch, rng.randint(0, 3), rng.choice([0, 1, 2, 3, -100])) for m in ["a", "a", "a", "b", "c"][:3 + batch % 3]
            for _ in range(20)]


def test_a_batch_delivered_twice_counts_once_over_restarts(spark):
    src, state = scratch_path(spark, "test-keyed-src"), scratch_path(spark, "test-keyed-state")

    def deliver(batches):
        for b in batches:
            spark.createDataFrame(rows_of(b), SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def result(df):
        return sorted(tuple(r) for r in df.collect())

    def twin(batches):
        return result(keyed_accuracy(spark.createDataFrame([r for b in batches for r in rows_of(b)], SCHEMA), ["model"]))
    deliver([0, 1, 1, 2])  # a copy within the first run
    assert result(run_keyed_accuracy(spark, src, SCHEMA, ["model"], state_path=state)) == twin([0, 1, 2])
    deliver([2, 0, 4])     # copies after a restart
    assert result(run_keyed_accuracy(spark, src, SCHEMA, ["model"], 1, state)) == twin([0, 1, 2, 4])
    assert result(run_keyed_accuracy(spark, src, SCHEMA, ["model"], state_path=state)) == twin([0, 1, 2, 4])  # nothing new
    deliver([3])
    assert result(run_keyed_accuracy(spark, src, SCHEMA, ["model"], state_path=state)) == twin(range(5))
