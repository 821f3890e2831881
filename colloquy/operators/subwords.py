"""Sub-word tokens learned from the corpus: byte-pair merges in rounds.

A word is the list of its characters, the last one with a space behind it that
marks the end.  Learning merges the neighbouring pair of symbols with the
greatest count (ties: smaller left, then smaller right symbol), again and
again.  One merge a pass over the words would take as many passes as merges, so
a round takes as many as cannot influence each other:

* Pairs are taken in order while they share no symbol with one taken before.
  Merging one then leaves the counts of the others as they are.
* A pair that a merge creates counts at most as often as an old pair that
  shares a symbol with the merged one.  So every taken pair that counts more
  often than all pairs left over which share a symbol with a taken one would
  also come next if merges were done one by one.
* A pair of equal symbols can create a pair of two merged ones, which has no
  such bound, so it is merged in a round of its own.  So is a pair that spells
  a symbol which another merge made, as it adds to the pairs of that symbol.

The merges are therefore those of the plain procedure, in its order.  A round
takes one merge at least, so there are never more rounds than merges.

The words and their counts stay distributed; a round is one pass that yields
partial pair counts, and brings a bounded number of top pairs to the driver.
A task merges and counts in blocks of words, as arrays of symbol numbers.
Segmented words are written to the shared folder every few rounds; between, a
pass applies the merges learned since, so nothing hangs on an executor's state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

END = " "
TOP_PAIRS = 1024    # pairs a round brings to the driver
WRITE_EVERY = 16    # rounds after which the segmented words are written
MAX_MERGES = 1_000_000
BLOCK = 65_536      # words that a task merges and counts at once
_CACHE = 200_000    # words whose pieces an encoding task keeps


def word_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Rows (symbols, n) of the distinct words in an array column; null and empty words are left out.

    A word that holds a space is as many words as it has parts.
    """
    words = df.select(F.explode(F.split(F.array_join(tokens, END), END)).alias("word")).filter("word <> ''")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    chars = F.split(F.col("word"), "")
    return counted.select(F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.when(
        i == F.length("word") - 1, F.concat(c, F.lit(END))).otherwise(c)).alias("symbols"), "n")


def apply_merges(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges, the one of least rank first, from left to right."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min((rank.get(p, MAX_MERGES) for p in zip(symbols, symbols[1:])), default=MAX_MERGES)
        if best == MAX_MERGES:
            break
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and rank.get((symbols[i], symbols[i + 1])) == best:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.ListArray, pa.Array]]:
    """Columns (symbols, n) of some tens of thousands of words at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in ("symbols", "n"))
            held = []
    if held:
        yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in ("symbols", "n"))


def merge_block(symbols: pa.ListArray, merges: list[tuple[str, str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words after the merges, one merge after the other over all words, each from left to right.

    Returns the names of the symbols, and by place in the joined words the
    number of the symbol and that of the word.
    """
    flat = symbols.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = np.repeat(np.arange(len(symbols)), pc.list_value_length(symbols).to_numpy(zero_copy_only=False))
    number = {name: k for k, name in enumerate(names)}
    for left, right in merges:
        if left not in number or right not in number:
            continue
        at = np.flatnonzero((codes[:-1] == number[left]) & (codes[1:] == number[right]) & (words[:-1] == words[1:]))
        if left == right and len(at):  # of overlapping places every second one, from the first
            first = np.r_[True, np.diff(at) != 1]
            at = at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
        if not len(at):
            continue
        if left + right not in number:
            number[left + right] = len(names)
            names.append(left + right)
        codes[at] = number[left + right]
        codes, words = np.delete(codes, at + 1), np.delete(words, at + 1)
    return names, codes, words


def pair_counts(names: list[str], codes: np.ndarray, words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows (left, right, n) of the neighbouring symbols of a block; ``n`` counts its words."""
    inside = np.flatnonzero(words[:-1] == words[1:])
    key = codes[inside] * len(names) + codes[inside + 1]
    order = np.argsort(key, kind="stable")
    key, each = key[order], n[words[inside]][order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(each, start) if len(key) else np.zeros(0, np.int64)
    name, pair = pa.array(names, pa.string()), key[start]
    return pa.RecordBatch.from_arrays([name.take(pa.array(pair // max(len(names), 1))), name.take(pa.array(pair % max(len(names), 1))),
                                       pa.array(total, pa.int64())], names=["left", "right", "n"])


def _segment(merges: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, n in _blocks(batches):
            names, codes, words = merge_block(symbols, merges)
            ends = np.r_[0, np.cumsum(np.bincount(words, minlength=len(symbols)))]
            done = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()).take(pa.array(codes)))
            yield pa.RecordBatch.from_arrays([done, n], names=["symbols", "n"])
    return run


def _count_pairs(merges: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, n in _blocks(batches):
            yield pair_counts(*merge_block(symbols, merges), n.to_numpy())
    return run


def independent(top: list[tuple[str, str, int]], complete: bool, made: Iterable[str] = ()) -> list[tuple[str, str, int]]:
    """The pairs of one round from the ordered top pairs; ``complete``: there are no others.

    The first is always among them, a pair of equal symbols or one that spells
    a symbol which other merges ``made`` only as the first.
    """
    taken, used, made = [], set(), set(made)
    bound = 0 if complete else top[-1][2]  # no pair left over that shares a symbol counts more
    for left, right, n in top:
        alone = left == right or left + right in made
        if taken and (alone or left in used or right in used):
            bound = n
            break
        taken.append((left, right, n))
        used |= {left, right}
        made.add(left + right)
        if alone:
            break
    return taken[:1] + [p for p in taken[1:] if p[2] > bound]


def learn_merges(words: DataFrame, size: int, least: int = 2, top_pairs: int = TOP_PAIRS) -> DataFrame:
    """Rows (rank, left, right, count) of at most ``size`` merges learned from (symbols, n).

    Merging stops early when no pair counts ``least`` or more.  ``count`` is
    the pair's when it was merged.
    """
    if not 0 < size <= MAX_MERGES or top_pairs < 2:
        raise ValueError(f"size: 1 to {MAX_MERGES}; top_pairs: 2 or more")
    spark = words.sparkSession
    # dealt out without asking for the number of partitions, which would count the words twice
    table = materialize(words.select("symbols", F.col("n").cast("bigint").alias("n"))
                        .repartition(spark.sparkContext.defaultParallelism), "merge-words")
    merges: list[tuple[str, str, int]] = []
    since, rounds = [], 0
    while len(merges) < size:
        pairs = table.mapInArrow(_count_pairs(since), "left string, right string, n bigint")
        counted = pairs.groupBy("left", "right").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        top = [tuple(r) for r in counted.orderBy(F.desc("n"), "left", "right").limit(top_pairs).collect()]
        if not top:
            break
        new = independent(top, len(top) < top_pairs, {p[0] + p[1] for p in merges})[:size - len(merges)]
        merges += new
        since += [p[:2] for p in new]
        rounds += 1
        if rounds % WRITE_EVERY == 0:
            table = materialize(table.mapInArrow(_segment(since), "symbols array<string>, n bigint"), "merge-words")
            since = []
    rows = [(k, left, right, n) for k, (left, right, n) in enumerate(merges)]
    return spark.createDataFrame(rows, "rank bigint, left string, right string, count bigint")


def _encode(merges: list[tuple[str, str]], column: int):
    rank = {pair: k for k, pair in enumerate(merges)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            done = []
            for tokens in batch.column(column).to_pylist():
                pieces = None if tokens is None else []
                for word in (w for t in tokens or () if t for w in t.split(END) if w):
                    if word not in known:
                        if len(known) >= _CACHE:
                            known.clear()
                        known[word] = apply_merges([*word[:-1], word[-1] + END], rank)
                    pieces += known[word]
                done.append(pieces)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.list_(pa.string()))],
                                             names=[*batch.schema.names, "_pieces"])
    return run


def encode_merges(df: DataFrame, tokens: str, merges: DataFrame, out: str = "pieces") -> DataFrame:
    """Adds ``out``: the sub-words of a token array, every word's last one with a space behind it.

    Merges apply in the order of their rank.  A null array stays null, null
    and empty words go.  ``merges`` is checked to hold at most a million rows,
    which every task gets.
    """
    table = merges.orderBy("rank").limit(MAX_MERGES + 1).collect()
    if len(table) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merges")
    names = [c for c in df.columns if c != out]
    plain = df.withColumn("_tokens", F.col(tokens)).select(*names, "_tokens")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    done = plain.mapInArrow(_encode([(r["left"], r["right"]) for r in table], len(names)),
                            f"{schema}, _pieces array<string>")
    return done.select(*names, F.col("_pieces").alias(out))


def decode_merges(pieces: Column) -> Column:
    """The words that sub-words spell, as an array."""
    text = F.array_join(pieces, "")
    words = F.split(F.regexp_replace(text, END + r"\z", ""), END)
    return F.when(F.size(pieces) > 0, words).otherwise(F.when(pieces.isNotNull(), F.array().cast("array<string>")))
