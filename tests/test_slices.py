"""Logits in slices against whole arrays."""

import math
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions.arrays import argmax_index
from colloquy.operators import losses as L
from colloquy.operators import slices as S

ARRAY = "k long, logits array<double>, target int, mask boolean, g string"


def rows_of(rng, n=40, vocab=37):
    rows = []
    for k in range(n):
        scale = rng.choice([1.0, 50.0, 800.0])
        x = [rng.uniform(-scale, scale) for _ in range(vocab)]
        if rng.random() < 0.3:
            x[rng.randrange(vocab)] = float("-inf")
        if rng.random() < 0.3:
            x[rng.randrange(vocab)] = x[rng.randrange(vocab)] = max(x)
        t = rng.choice([-100, rng.randrange(vocab)])
        if t >= 0 and math.isinf(x[t]):
            x[t] = 0.0
        rows.append((k, x, t, rng.random() < 0.8, rng.choice(["u", "v", None])))
    return rows


def sliced(rows, cut):
    out = []
    for k, x, t, m, g in rows:
        at = 0
        while at < len(x):
            n = cut()
            out.append((k, at, x[at:at + n], t, m, g))
            at += n
    random.Random(0).shuffle(out)
    return out


@pytest.mark.parametrize("width", [1, 5, 64, None])
def test_any_slicing_gives_the_array_form(spark, width):
    rng = random.Random(7)
    rows = rows_of(rng)
    whole = spark.createDataFrame(rows, ARRAY)
    parts = spark.createDataFrame(sliced(rows, lambda: width or rng.randint(1, 9)),
                                  "k long, start long, logits array<double>, target int, mask boolean, g string").repartition(3)
    assert S.masked_cross_entropy(parts, ["k"]).collect() == L.masked_cross_entropy(whole).collect()
    assert S.poly_loss(parts, ["k"]).collect() == L.poly_loss(whole).collect()
    assert sorted(S.masked_cross_entropy(parts, ["k"], by=["g"]).collect(), key=str) == sorted(
        L.masked_cross_entropy(whole, by=["g"]).collect(), key=str)
    assert sorted(S.predictions(parts, ["k"]).collect()) == sorted(
        whole.select("k", argmax_index("logits").alias("pred")).collect())


def test_odd_logits(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [-inf, -inf]), (2, [nan, 1.0]), (3, [1.0, inf]), (4, [800.0, -800.0, 799.0]), (5, [-800.0, -801.0])]
    parts = spark.createDataFrame([(k, i, [v]) for k, x in rows for i, v in enumerate(x)], "k long, start long, logits array<double>")
    got = {r.k: r.lse for r in S.row_states(parts, ["k"], target=None).collect()}
    assert got[1] == -inf and math.isnan(got[2]) and math.isnan(got[3])
    assert got[4] == pytest.approx(800 + math.log(1 + math.exp(-1))) and got[5] == pytest.approx(-800 + math.log(1 + math.exp(-1)))


@pytest.mark.parametrize("target", [-3, 2, None])
def test_targets_outside_raise(spark, target):
    parts = spark.createDataFrame([(1, 0, [1.0], target, True), (1, 1, [2.0], target, True)],
                                  "k long, start long, logits array<double>, target int, mask boolean")
    with pytest.raises(Exception, match="out of range"):
        S.masked_cross_entropy(parts, ["k"]).collect()


@pytest.mark.parametrize("starts", [(0, 2), (0, 1, 1), (1, 2), (0, 0)])
def test_gaps_and_repeats_raise(spark, starts):
    parts = spark.createDataFrame([(1, s, [1.0], 0, True) for s in starts],
                                  "k long, start long, logits array<double>, target int, mask boolean")
    with pytest.raises(Exception, match="overlap or leave a gap"):
        S.poly_loss(parts, ["k"]).collect()


def test_no_rows(spark):
    none = spark.createDataFrame([], "k long, start long, logits array<double>, target int, mask boolean")
    assert S.masked_cross_entropy(none, ["k"]).collect()[0].n == 0 and S.predictions(none, ["k"]).count() == 0
    empty = spark.createDataFrame([(1, 0, [], 0, True), (1, 0, [2.0], 0, True)], none.schema)
    assert S.masked_cross_entropy(empty.select("*", F.lit(1).alias("size")), ["k"]).collect()[0].loss == 0.0
