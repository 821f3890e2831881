"""Common subsequences in linear memory and in tiles, against the full table."""

import random
import tracemalloc

import numpy as np
import pytest

from colloquy.operators import lcs as L
from colloquy.operators import metrics as M


def table(x, y):
    size = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, w in enumerate(x, 1):
        for j, v in enumerate(y, 1):
            size[i, j] = size[i - 1, j - 1] + 1 if w == v else max(size[i - 1, j], size[i, j - 1])
    return size


def table_words(x, y):
    """The walk over the whole table: up only if that side is longer."""
    size, words, i, j = table(x, y), set(), len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            words.add(x[i - 1])
            i, j = i - 1, j - 1
        elif size[i - 1, j] > size[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return words


def pair(rng, longest):
    k = rng.choice([1, 2, 4, 30])
    return [[str(rng.randrange(k)) for _ in range(rng.randint(0, longest))] for _ in range(2)]


def test_words_and_length_are_those_of_the_table():
    rng = random.Random(2)
    for _ in range(250):
        x, y = pair(rng, 90)
        assert L.lcs_length(x, y) == table(x, y)[-1, -1]
        assert L.common_words(x, y) == table_words(x, y)


def test_memory_is_linear():
    rng = random.Random(3)
    peaks = {}
    for n in (4000, 16000):
        x = [str(rng.randrange(10 ** 9)) for _ in range(n)]
        y = [w if rng.random() < 0.7 else "other" for w in x]
        tracemalloc.start()
        words = L.common_words(x, y)
        peaks[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert words == {w for w, v in zip(x, y) if w == v}
    assert peaks[16000] < 8 * peaks[4000] and peaks[16000] < 500 * 16000


@pytest.mark.parametrize("tile", [1, 7, 64])
def test_tiles_pass_on_what_the_kernel_needs(tile):
    rng = random.Random(4)
    for _ in range(60):
        x, y = pair(rng, 70)
        above, right = {}, {}
        for r in range(0, len(x), tile):
            for c in range(0, len(y), tile):
                above[c], right[r] = L.tile_borders(x[r:r + tile], y[c:c + tile], above.get(c), right.get(r))
        grown = sum(len(y[c:c + tile]) - int.from_bytes(above[c], "little").bit_count() for c in above)
        assert grown == (table(x, y)[-1, -1] if x and y else 0)


def test_pairs_of_all_sizes_advance_together(spark):
    rng = random.Random(5)
    rows = [(i, *pair(rng, 60)) for i in range(12)] + [(20, None, ["a"]), (21, [], []), (22, ["a"], None)]
    df = spark.createDataFrame(rows, "k int, h array<string>, r array<string>").repartition(3)
    tiled = M.rouge_l(df, ["k"], "h", "r", tile=16)
    assert sorted(map(tuple, tiled.collect())) == sorted(map(tuple, M.rouge_l(df, ["k"], "h", "r").collect()))
    assert L.lcs_tiled(df.limit(0).selectExpr("k AS pair", "h", "r"), "h", "r").collect() == []


def test_a_long_pair_spreads_over_tasks(spark):
    rng = random.Random(6)
    x = [str(rng.randrange(5000)) for _ in range(200_000)]
    y = [w for w in x if rng.random() < 0.9]
    df = spark.createDataFrame([(1, x, y)], "pair int, h array<string>, r array<string>")
    assert L.lcs_tiled(df, "h", "r", tile=50_000).collect()[0].lcs == len(y)
