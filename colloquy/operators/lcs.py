"""Longest common subsequences in bit-parallel rows: length, words, and one long pair over many tasks.

Row i of the table says for every position j of ``y`` whether the length grows
there: bit j is 0 if ``y[:j+1]`` has one more word in common with ``x[:i]``
than ``y[:j]``.  A row follows from the one before with one addition (Hyyrö
2004), so a row of n positions is n bits.

* ``common_words`` walks the table backwards without keeping it: the middle row
  is computed and kept, the lower half walked first, then the upper half, of
  which only the columns left of the path are needed any more.
* ``lcs_tiled`` cuts the table of a long pair into tiles.  A tile needs the
  lower border of the tile above (a bit a column) and the carries of the tile to
  its left (a bit a row); tiles of one anti-diagonal are independent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TILE = 8192    # words a side of a tile
_LEAF = 32     # rows that a walk keeps at once
_KEPT = 64     # words whose positions are kept as bits


class Positions:
    """Where the words of a sequence stand, as bit sets, in memory linear in its length.

    Only the most frequent words keep their set; others are built from their
    positions when asked for.
    """

    def __init__(self, words: list):
        self.n = len(words)
        self.full = (1 << self.n) - 1
        self.at: dict = {}
        for j, w in enumerate(words):
            self.at.setdefault(w, []).append(j)
        often = [w for w, k in Counter({w: len(p) for w, p in self.at.items()}).most_common(_KEPT) if k > 1]
        self.kept = {w: self._bits(self.at[w]) for w in often}

    def _bits(self, positions: list[int]) -> int:
        if len(positions) == 1:
            return 1 << positions[0]
        raw = bytearray(positions[-1] // 8 + 1)
        for j in positions:
            raw[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(raw, "little")

    def of(self, word) -> int:
        if word in self.kept:
            return self.kept[word]
        return self._bits(self.at[word]) if word in self.at else 0


def lcs_length(x: list, y: list) -> int:
    """Length of a longest common subsequence: O(len(x) len(y) / 64) time, linear memory."""
    if not len(x) or not len(y):
        return 0
    where = Positions(y)
    row = where.full
    for word in x:
        u = row & where.of(word)
        if u:
            row = ((row + u) | (row - u)) & where.full
    return where.n - row.bit_count()


def common_words(x: list[str], y: list[str]) -> set[str]:
    """Words of one longest common subsequence; equal choices leave out ``y``'s last word first.

    Memory: a row of bits for every halving of ``x`` and 32 rows at the end,
    beside the positions: linear in the lengths.  Time: each halving computes
    its rows anew, over the columns that are left.
    """
    if not x or not y:
        return set()
    where, words = Positions(y), set()

    def on(row: int, word, full: int) -> int:
        u = row & where.of(word) & full
        return ((row + u) | (row - u)) & full if u else row

    def walk(lo: int, hi: int, row: int, j: int) -> int:
        """Walks rows ``hi`` to ``lo + 1`` back from column ``j``; ``row`` is row ``lo``.  Returns the column left."""
        full = (1 << j) - 1
        row &= full
        if hi - lo > _LEAF:
            mid, below = (lo + hi) // 2, row
            for i in range(lo, mid):
                below = on(below, x[i], full)
            j = walk(mid, hi, below, j)
            return walk(lo, mid, row, j) if j else 0
        rows = [row]
        for i in range(lo, hi):
            rows.append(on(rows[-1], x[i], full))
        for i in range(hi, lo, -1):
            here = (1 << j) - 1
            equal = where.of(x[i - 1]) & here
            # to the left as long as words differ and nothing grows
            j = (equal | (~rows[i - lo] & here)).bit_length()
            if not j:
                return 0
            if equal >> (j - 1):
                words.add(x[i - 1])
                j -= 1
        return j

    walk(0, len(x), where.full, where.n)
    return words


# ------------------------------------------------------------------ tiles
def tile_borders(x: list, y: list, above: bytes | None, carries: bytes | None) -> tuple[bytes, bytes]:
    """Lower border (a bit a column, 1: no growth) and carries to the right (a bit a row) of one tile."""
    where = Positions(y)
    row = where.full if above is None else int.from_bytes(above, "little")
    coming = 0 if carries is None else int.from_bytes(carries, "little")
    leaving = bytearray(len(x) // 8 + 1)
    for i, word in enumerate(x):
        u = row & where.of(word)
        total = row + u + ((coming >> i) & 1)
        if total > where.full:
            leaving[i >> 3] |= 1 << (i & 7)
            total &= where.full
        row = total | (row - u)
    return row.to_bytes(len(y) // 8 + 1, "little"), bytes(leaving)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y, above, left = (batch.column(c) for c in ("x", "y", "above", "left"))
        done, zeros = [], []
        for k in range(batch.num_rows):
            words = y[k].as_py()
            done.append(tile_borders(x[k].as_py(), words, above[k].as_py(), left[k].as_py()))
            zeros.append(len(words) - int.from_bytes(done[-1][0], "little").bit_count())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("pair", "r", "c", "last")] + [
                pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.binary()),
                pa.array(zeros, pa.int64())], names=["pair", "r", "c", "last", "below", "right", "grown"])


def lcs_tiled(pairs: DataFrame, hyp: str, ref: str, tile: int = TILE) -> DataFrame:
    """Rows (pair, lcs) for rows (pair, hyp, ref) of token arrays, ``pair`` unique; a null or empty side gives 0.

    All pairs advance together, one anti-diagonal of tiles a step; a step is a
    written table, so a lost task repeats its tiles only, and moves the blocks
    of its own tiles only.  There are as many steps as the largest pair has
    blocks on both sides, less one.
    """
    if tile < 1:
        raise ValueError("tile: 1 or more")
    sized = pairs.filter((F.size(hyp) > 0) & (F.size(ref) > 0)).withColumns(
        {"rows": F.ceil(F.size(hyp) / tile).cast("int"), "columns": F.ceil(F.size(ref) / tile).cast("int")})

    def blocks(tokens: str, index: str, of: str, out: str) -> DataFrame:
        each = sized.select("pair", "rows", "columns", tokens, F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias(index))
        cut = F.slice(tokens, F.col(index) * tile + 1, tile).alias(out)
        return materialize(each.select("pair", "rows", "columns", index, cut), f"lcs-{out}")

    xs, ys = blocks(hyp, "r", "rows", "x"), blocks(ref, "c", "columns", "y")
    steps = xs.agg(F.max(F.col("rows") + F.col("columns") - 1)).first()[0] or 0
    kinds = f"pair {xs.schema['pair'].dataType.simpleString()}"
    borders, grown = None, []
    for step in range(steps):
        mine = xs.filter((F.col("r") <= step) & (step - F.col("r") < F.col("columns"))).select(
            "pair", "r", (F.lit(step) - F.col("r")).alias("c"), (F.col("r") == F.col("rows") - 1).alias("last"), "x")
        theirs = ys.filter((F.col("c") <= step) & (step - F.col("c") < F.col("rows"))).select("pair", "c", "y")
        if borders is None:
            mine = mine.withColumns({"above": F.lit(None).cast("binary"), "left": F.lit(None).cast("binary")})
        else:
            key = ["pair", "r", "c"]
            mine = mine.join(borders.select("pair", (F.col("r") + 1).alias("r"), "c", F.col("below").alias("above")), key, "left")
            mine = mine.join(borders.select("pair", "r", (F.col("c") + 1).alias("c"), F.col("right").alias("left")), key, "left")
        borders = materialize(mine.join(theirs, ["pair", "c"]).mapInArrow(
            _tiles, f"{kinds}, r int, c int, last boolean, below binary, right binary, grown bigint"), "lcs-borders")
        grown.append(borders.filter("last").select("pair", "grown"))
    every = pairs.select("pair", F.lit(0).cast("bigint").alias("grown"))
    for part in grown:
        every = every.unionByName(part)
    return every.groupBy("pair").agg(F.sum("grown").alias("lcs"))
