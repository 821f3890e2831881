"""Periodic stretches of words (runs) found with a dictionary of basic factors.

The factors of a text whose length is a power of two get names: two factors of
one length have one name if and only if they are equal, and the name of a
factor of length 2L is that of the pair of its halves.  A run of period q in
(L/2, L] that is at least 4 q long holds three occurrences of one factor of
length L that are q apart, and none between them, since a factor as long as
the smallest period returns only after whole periods.  So for every L the
successor of an occurrence that starts within L words (both then lie within
twice the length) gives a difference, two equal differences in a row an
arithmetic progression, and its difference a proposed period.  Each
progression is extended to both sides as far as words q apart agree; equal
stretches found with several periods keep the smallest.

Only factors that occur twice are carried to the next length: most words of
prose leave after two or three lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

LEAST = 6      # words of a run at least
EXPONENT = 4   # and periods; the proposals need four
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def word_names(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _agree(names: np.ndarray, at: int, period: int, step: int) -> int:
    """How many positions from ``at`` on, going by ``step`` (1 or -1), agree with the one ``period`` later."""
    done, size = 0, 64
    last = len(names) - period if step > 0 else -1  # first position out of reach
    while at + step * done != last:
        lo = at + step * done
        hi = min(lo + size, last) if step > 0 else max(lo - size, last)
        a, b = (lo, hi) if step > 0 else (hi + 1, lo + 1)
        same = names[a:b] == names[a + period:b + period]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done, size = done + b - a, size * 2
    return done


def _proposals(pos: np.ndarray, names: np.ndarray, order: np.ndarray, length: int, n: int) -> np.ndarray:
    """Rows (position, period): first terms of progressions of three occurrences, one a stretch of neighbours.

    ``pos`` ascends; ``order`` sorts by name and then position.
    """
    p, name = pos[order], names[order]
    gap = np.where(name[1:] == name[:-1], p[1:] - p[:-1], 0)
    gap[(gap > length) | (2 * gap <= length)] = 0
    ahead = np.zeros(n, np.int64)  # of each position: distance of its successor
    ahead[p[:-1]] = gap
    first = p[:-1][gap > 0]
    d = ahead[first]
    triple = ahead[first + d] == d
    first, d = first[triple], d[triple]
    begins = np.ones(len(first), bool)
    marked = np.zeros(n, np.int64)
    marked[first] = d
    inner = first > 0
    begins[inner] = marked[first[inner] - 1] != d[inner]
    return np.stack([first[begins], d[begins]], axis=1)


def find_runs(names: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of at least ``least`` words and ``exponent`` (4 or more) periods."""
    if exponent < EXPONENT:
        raise ValueError(f"progressions of three occurrences need {EXPONENT} periods")
    n, found = len(names), {}
    pos, level, length = np.arange(n), names, 1
    while len(pos) and length // 2 < n // exponent:
        order = np.argsort(level, kind="stable")
        for at, period in _proposals(pos, level, order, length, n).tolist():
            left, right = _agree(names, at - 1, period, -1), _agree(names, at, period, 1)
            run = (at - left, left + right + period)
            if run[1] >= max(least, exponent * period):
                found[run] = min(period, found.get(run, period))
        # factors of twice the length: both halves must occur again
        ranked = level[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        name = np.cumsum(fresh) - 1
        again = np.bincount(name)[name] > 1
        named = np.full(n + length, -1, np.int64)
        named[pos[order[again]]] = name[again]
        pos = np.flatnonzero((named[:n] >= 0) & (named[length:n + length] >= 0))
        level = named[pos] * (n + 1) + named[pos + length]
        length *= 2
    return sorted((s, m, q) for (s, m), q in found.items())


def _drop_repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that stay: those in no run after the run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, m, q in runs:
        edge[s + q] += 1
        edge[s + m] -= 1
    return np.cumsum(edge[:n]) == 0


def _analyse(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, collapsed = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = find_runs(word_names(words), least, exponent)
                if found:
                    stay = _drop_repeats(len(words), found)
                    words, n = [w for w, k in zip(words, stay.tolist()) if k], len(words)
                else:
                    n = len(words)
                counts.append(n)
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(item)),
                 pa.array(collapsed, pa.string())], names=["rec", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(df: DataFrame, text: Column, keep: list[str] | None = None, least: int = LEAST,
                  exponent: int = EXPONENT) -> DataFrame:
    """Rows (rec, n_words, runs, collapsed), one per row of ``df``.

    ``rec`` holds the input columns named in ``keep`` (all if not given) as a
    struct, so no name can clash.  ``runs`` lists (start, length, period) of
    every maximal run by start and period; ``collapsed`` is the text's words
    without those that any run holds after its first period, joined by one
    space.  A null or empty text has no words, no run and an empty collapsed
    text; equal rows have equal results, each row its own; runs that start
    together are told apart by their periods; an empty table gives none.  Rows
    are independent, so nothing is shuffled; the longest text bounds a task's
    memory (about 100 bytes a word).
    """
    names = df.columns if keep is None else keep
    rec = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("string")
    fields = df.select(rec.alias("rec"), text.cast("string").alias("text"))
    kind = fields.schema["rec"].dataType.simpleString()
    return fields.mapInArrow(_analyse(least, exponent),
                             f"rec {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run of greatest length as a struct (ties: smallest start, then smallest period); null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                  (-r["period"]).alias("period")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"),
                                             (-best["period"]).alias("period")))


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run, in order."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))), "")
