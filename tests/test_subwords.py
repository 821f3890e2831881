"""Learned byte-pair merges against the plain one-by-one procedure."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.operators import subwords as S


def plain_merges(words, size, least=2):
    seg = {w: [*w[:-1], w[-1] + " "] for w in words}
    out = []
    while len(out) < size:
        count = Counter()
        for w, n in words.items():
            for p in zip(seg[w], seg[w][1:]):
                count[p] += n
        count = {p: n for p, n in count.items() if n >= least}
        if not count:
            break
        best = min(count, key=lambda p: (-count[p], p))
        out.append((*best, count[best]))
        for w in seg:
            s, i, done = seg[w], 0, []
            while i < len(s):
                if tuple(s[i:i + 2]) == best:
                    done.append(s[i] + s[i + 1])
                    i += 2
                else:
                    done.append(s[i])
                    i += 1
            seg[w] = done
    return out


def some_words(rng):
    k = rng.choice([1, 2, 3, 5, 12])
    return {"".join(rng.choice("abcdefghijkl"[:k]) for _ in range(rng.randint(1, 12))): rng.randint(1, rng.choice([3, 50, 1000]))
            for _ in range(rng.randint(1, 25))}


def test_rounds_take_the_merges_of_the_plain_procedure():
    rng = random.Random(1)
    rounds = merged = 0
    for _ in range(400):
        words = some_words(rng)
        seg = {w: [*w[:-1], w[-1] + " "] for w in words}
        got, top = [], rng.choice([2, 3, 5, 50])
        while len(got) < 40:
            count = Counter()
            for w, n in words.items():
                for p in zip(seg[w], seg[w][1:]):
                    count[p] += n
            ranked = sorted(((*p, n) for p, n in count.items() if n >= 2), key=lambda x: (-x[2], x[:2]))[:top]
            if not ranked:
                break
            new = S.independent(ranked, len(ranked) < top)[:40 - len(got)]
            assert new
            got += new
            rounds += 1
            rank = {p[:2]: k for k, p in enumerate(new)}
            seg = {w: S.apply_merges(s, rank) for w, s in seg.items()}
        assert got == plain_merges(words, 40)
        merged += len(got)
    assert rounds < merged


def test_learned_in_spark_as_in_plain_python(spark):
    rng = random.Random(5)
    words = {**some_words(rng), **some_words(rng), "漢字かな": 40, "漢字": 30, "naïve": 7, "aaaaaaaa": 900}
    df = spark.createDataFrame([([w] * n,) for w, n in words.items()], "t array<string>").repartition(3)
    counted = S.word_counts(df, "t")
    assert {"".join(r.symbols): r.n for r in counted.collect()} == {w + " ": n for w, n in words.items()}
    got = [tuple(r) for r in S.learn_merges(counted, 30, top_pairs=8).orderBy("rank").select("left", "right", "count").collect()]
    assert got == plain_merges(words, 30)


def test_pieces_spell_the_words(spark):
    rows = [(1, ["the", "then", "<|patient|>", "漢字", "x"]), (2, []), (3, None), (4, ["", None, "the"]), (5, ["a b", " the "])]
    df = spark.createDataFrame(rows, "k int, pieces array<string>")
    merges = spark.createDataFrame([(0, "t", "h"), (1, "th", "e "), (2, "th", "e")], "rank long, left string, right string")
    done = S.encode_merges(df, "pieces", merges).withColumn("words", S.decode_merges(F.col("pieces")))
    got = {r.k: (r.pieces, r.words) for r in done.collect()}
    assert got[1][0][:3] == ["the ", "the", "n "] and got[1][1] == rows[0][1]
    assert got[2] == ([], []) and got[3] == (None, None) and got[4][1] == ["the"] and got[5][1] == ["a", "b", "the"]


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "t array<string>")
    assert S.learn_merges(S.word_counts(empty, "t"), 5).collect() == []
    single = spark.createDataFrame([(["a", "b", "a", None, ""],)], "t array<string>")
    assert S.learn_merges(S.word_counts(single, "t"), 5).collect() == []
    with pytest.raises(ValueError):
        S.learn_merges(S.word_counts(single, "t"), 0)


def test_blocks_of_words_merge_and_count_as_plain_python():
    rng = random.Random(9)
    for _ in range(300):
        words = {"".join(rng.choice("abc"[:rng.choice([1, 2, 3])]) for _ in range(rng.randint(1, 25))): rng.randint(1, 2**40)
                 for _ in range(rng.randint(1, 12))}
        start = pa.array([[*w[:-1], w[-1] + " "] for w in words], pa.list_(pa.string()))
        n, got, top = np.array(list(words.values())), [], rng.choice([3, 8, 50])
        while len(got) < 40:
            rows = S.pair_counts(*S.merge_block(start, [p[:2] for p in got]), n).to_pylist()
            ranked = sorted(((r["left"], r["right"], r["n"]) for r in rows if r["n"] >= 2), key=lambda x: (-x[2], x[:2]))[:top]
            if not ranked:
                break
            got += S.independent(ranked, len(ranked) < top, {p[0] + p[1] for p in got})[:40 - len(got)]
        assert got == plain_merges(words, 40)


def test_a_pair_that_spells_a_made_symbol_has_a_round_of_its_own():
    top = [("a", "b", 9), ("p", "q", 8), ("x", "y", 7)]
    assert S.independent(top, True) == top
    assert S.independent(top, True, {"pq"}) == top[:1]
    assert S.independent(top, True, {"ab"}) == top[:1]


def test_words_are_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.createDataFrame([(["ab", "abc"],)] * 40, "t array<string>").mapInArrow(look, "t array<string>")
    assert len(S.learn_merges(S.word_counts(df, "t"), 3).collect()) == 3
    assert seen.value == 40
