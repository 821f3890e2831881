"""States of parts that merge into those of the whole."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import metrics as M
from colloquy.operators import partial as P
from colloquy.session import scratch_path

WORDS = "a b c d e f g the of and on".split()


def some_pairs(rng, n=60):
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))
    return [(i, rng.choice(["u", "v"]), text(), text()) for i in range(n)]


SCHEMA = "id long, grp string, response string, target string"


def same(got, want):
    got, want = (sorted((tuple(r) for r in df.collect()), key=str) for df in (got, want))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-4) if None not in a and not isinstance(a[0], str) else a[:1] == b[:1]
        for x, y in zip(a, b):
            assert x == y or x == pytest.approx(y, abs=2e-4)


@pytest.mark.parametrize("by", [None, ["grp"]])
def test_parts_merge_into_the_report_of_all(spark, by):
    rows = some_pairs(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [df.filter(F.col("id") % 3 == k) for k in range(3)] + [df.limit(0)]
    merged = P.merge_reports([P.report_state(p, ["id"], by=by) for p in parts], by)
    same(P.report_of(merged, by), M.generation_report(df, ["id"], by=by))


def test_a_resumed_run_scores_only_new_rows(spark, monkeypatch):
    rows = some_pairs(random.Random(2))
    inputs = spark.createDataFrame([(r[0], r[3]) for r in rows], "id long, target string")
    answers = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, response string")
    asked, scored, path = [], [], scratch_path(spark, "test-report")
    plain = P.metric_tokens

    def counting(pairs, *args):
        scored.append(sorted(r.id for r in pairs.select("id").collect()))
        return plain(pairs, *args)
    monkeypatch.setattr(P, "metric_tokens", counting)

    def run(limit):
        def answer(df):
            asked.append(df.count())
            return df.filter(F.col("id") < limit).join(answers, "id")
        return answer
    first, half = P.resumed_report(inputs, None, ["id"], run(25), path, "one")
    second, report = P.resumed_report(inputs, first, ["id"], run(99), path, "two")
    pairs = spark.createDataFrame(rows, SCHEMA)
    same(half, M.generation_report(pairs.filter("id < 25"), ["id"]))
    same(report, M.generation_report(pairs, ["id"]))
    assert asked == [60, 35] and scored == [list(range(25)), list(range(25, 60))]
    # the same part again replaces its state
    _, again = P.resumed_report(inputs, first, ["id"], run(99), path, "two")
    same(again, report)
    with pytest.raises(ValueError):
        P.resumed_report(inputs, first, ["id"], run(99), scratch_path(spark, "test-report-none"), "two")
    with pytest.raises(ValueError):
        P.store_report(P.report_state(pairs, ["id"]), path, "a/b")


def test_sketches_of_halves_merge_to_that_of_the_whole(spark):
    rng = random.Random(3)
    rows = [(i, ["x", "y"][i % 2], [f"w{rng.randrange(8000)}" for _ in range(rng.randint(0, 60))]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, g string, tokens array<string>").repartition(4)
    for by in ([], ["g"]):
        whole = P.distinct_state(df, by=by)
        halves = P.merge_distinct([P.distinct_state(df.filter(F.col("id") % 3 == 0), by=by),
                                   P.distinct_state(df.filter(F.col("id") % 3 != 0), by=by)], by)
        one = {tuple(r[c] for c in [*by, "n"]): r for r in P.distinct_estimates(P.merge_distinct([whole], by), by).collect()}
        two = {tuple(r[c] for c in [*by, "n"]): r for r in P.distinct_estimates(halves, by).collect()}
        exact = {tuple(r[c] for c in [*by, "n"]): r for r in M.ngram_stats(M.ngram_counts(df, by=by), by).collect()}
        assert one.keys() == two.keys() == exact.keys()
        for k, r in exact.items():
            assert one[k].distinct == two[k].distinct and one[k].total == two[k].total == r.total
            assert abs(one[k].distinct - r.distinct) <= one[k].error * r.distinct
    assert P.distinct_estimates(P.distinct_state(df.limit(0))).collect() == []
