"""FM-index of one shard of text over word symbols (NumPy, inside a Spark task).

The shard is a sequence of pieces, each closed by symbol 0.  The index holds
the Burrows-Wheeler transform as a wavelet matrix (one bit vector per bit of a
symbol, with counts per 64 bits), the first row of each symbol, and the text
places of a sample of the suffixes.  Phrases are found by backward search, all
of them side by side, and located by walking back to the next sampled suffix.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


class Bits:
    """A bit vector that counts ones before any place."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        self.words, self.before = words, before

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        packed = np.packbits(flags, bitorder="little")
        words = np.zeros(len(flags) // 64 + 1, "<u8")
        words.view(np.uint8)[:len(packed)] = packed
        before = np.zeros(len(words), "<i4")
        np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
        return cls(words, before)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype("<u8")) & np.uint64(1)).astype(bool)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        low = (np.uint64(1) << (at & 63).astype("<u8")) - np.uint64(1)
        return self.before[at >> 6].astype(np.int64) + np.bitwise_count(self.words[at >> 6] & low)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order; the 0 that closes a piece sorts by its place, below all words.

    Prefix doubling: suffixes equal in their first k symbols are told apart by
    the ranks of the suffixes k symbols on, so only those still tied are sorted
    again.  Every tie ends at the closing symbol of the shorter piece.
    """
    n = len(text)
    ends = text == 0
    n_ends = int(ends.sum())
    first = text.astype(np.int64) + (n_ends - 1)
    first[ends] = np.arange(n_ends)
    width = int(first.max()).bit_length() if n else 1
    k = max(1, min(4, 62 // max(width, 1)))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= width
        key[:n - j] |= first[j:] if j else first
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    sorted_key = key[order]
    while True:
        # a group of equal keys has the slot of its first member as rank
        new = np.empty(len(sorted_key), bool)
        new[:1] = True
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        members = order[slots]
        rank[members] = slots[begin][group]
        sizes = np.diff(np.append(begin, len(sorted_key)))
        tied = sizes[group] > 1
        if not tied.any():
            return order
        slots = slots[tied]
        members = members[tied]
        key = (rank[members] << 32) | rank[np.minimum(members + k, n - 1)]
        by = np.argsort(key, kind="stable")
        order[slots] = members[by]
        sorted_key = key[by]
        k *= 2


class FMIndex:
    """Backward search and location over one shard."""

    def __init__(self, n: int, levels: list[Bits], zeros: np.ndarray, first: np.ndarray, marked: Bits,
                 samples: np.ndarray):
        self.n, self.levels, self.zeros, self.first = n, levels, zeros, first
        self.marked, self.samples = marked, samples
        # where each symbol's stretch begins below the last level
        self.base = self._down(np.arange(len(first)), np.zeros(len(first), np.int64))

    @classmethod
    def build(cls, text: np.ndarray, n_symbols: int) -> FMIndex:
        order = suffix_order(text)
        bwt = text[order - 1]
        counts = np.bincount(text, minlength=n_symbols)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        levels, zeros = [], []
        seq = bwt
        depth = max(1, int(n_symbols - 1).bit_length())
        for level in range(depth):
            flags = ((seq >> (depth - 1 - level)) & 1).astype(bool)
            levels.append(Bits.of(flags))
            zeros.append(len(seq) - int(flags.sum()))
            seq = np.concatenate([seq[~flags], seq[flags]])
        # suffixes at every SAMPLE-th place and at the start of each piece keep their place
        starts = np.empty(len(text), bool)
        starts[:1] = True
        starts[1:] = text[:-1] == 0
        keep = starts[order] | (order % SAMPLE == 0)
        return cls(len(text), levels, np.array(zeros, np.int64), first, Bits.of(keep), order[keep].astype("<i4"))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        depth = len(self.levels)
        for level, bits in enumerate(self.levels):
            ones = bits.ones(at)
            one = ((symbol >> (depth - 1 - level)) & 1).astype(bool)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each place."""
        return self._down(symbol, at) - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one row of the suffixes that open with each phrase (rows of symbols)."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(lengths > 0)
        last = phrases[live, lengths[live] - 1]
        lo[live] = self.first[last]
        hi[live] = np.append(self.first, self.n)[last + 1]
        for back in range(2, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = phrases[live, lengths[live] - back]
            lo[live], hi[live] = (self.first[c] + self.rank(c, x[live]) for x in (lo, hi))
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows."""
        places = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows.copy()
        depth = len(self.levels)
        while len(open_):
            hit = self.marked.get(at)
            places[open_[hit]] = self.samples[self.marked.ones(at[hit])] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            # one step back: read the symbol before the suffix on the way down
            symbol, down = np.zeros(len(at), np.int64), at
            for level, bits in enumerate(self.levels):
                one = bits.get(down)
                ones = bits.ones(down)
                symbol |= one.astype(np.int64) << (depth - 1 - level)
                down = np.where(one, self.zeros[level] + ones, down - ones)
            at = self.first[symbol] + down - self.base[symbol]
            steps[open_] += 1
        return places

    def arrays(self) -> dict[str, np.ndarray]:
        return {"words": np.concatenate([b.words for b in self.levels]), "before": np.concatenate(
            [b.before for b in self.levels]), "zeros": self.zeros, "first": self.first,
            "mark_words": self.marked.words, "mark_before": self.marked.before, "samples": self.samples,
            "n": np.array([self.n])}

    @classmethod
    def of(cls, a: dict[str, np.ndarray]) -> FMIndex:
        depth = len(a["zeros"])
        levels = [Bits(w, b) for w, b in zip(np.split(a["words"], depth), np.split(a["before"], depth))]
        return cls(int(a["n"][0]), levels, a["zeros"], a["first"], Bits(a["mark_words"], a["mark_before"]), a["samples"])
