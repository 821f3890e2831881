"""Language-model scoring with a weighted backoff automaton.

Tokens of a text are its words, lower-cased A-Z, and one end.  The model
interpolates n-grams (Jelinek-Mercer): with a context h seen in training,
P(w | h) = LAMBDA c(hw) / c(h) + (1 - LAMBDA) P(w | h without its first word),
over the add-one unigrams (c + 1) / (N + V + 1).  As an automaton, the seen
contexts are states, the seen n-grams arcs, and every state has a failure arc
of weight 1 - LAMBDA to the state of its shorter context; one walk from left
to right through a text carries the state and adds up log-probabilities.

The n-grams of a corpus fit no single memory, so texts are gathered in blocks
of bounded tokens, and a block needs the counts of its own n-grams only:

1. documents -> blocks (a written table): token numbers, hashes of the words;
2. every block sends the sorted keys of its distinct n-grams and their counts
   in training texts to the key ranges they fall in (one key once per block,
   so that frequent n-grams are not hot);
3. every range sums its keys over blocks and sends the totals back;
4. every block builds its part of the automaton and walks its texts.

Keys are 64-bit hashes of n-grams.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import total, words_of

ORDER = 2
LAMBDA = 0.4
BLOCK_TOKENS = 400_000
RANGE_TOKENS = 1_500_000
XXH_SEED = 42
START, END = 0, 1  # token numbers of every block


def squeezed(values: np.ndarray) -> bytes:
    """Integers as compressed bytes, equal bytes of all of them side by side."""
    from zstandard import ZstdCompressor

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return ZstdCompressor(level=1).compress(planes.tobytes())


def restored(data: bytes, dtype: str) -> np.ndarray:
    from zstandard import ZstdDecompressor

    planes = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


BLOCK_SCHEMA = ("block bigint, ids array<string>, train array<boolean>, lengths array<int>, tokens binary, "
                "hashes binary")


def _blocks(block_tokens: int):
    """Documents (id, train, text) to rows of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        part = TaskContext.get().partitionId()
        number = 0

        def fresh():
            words: defaultdict[bytes, int] = defaultdict()
            words.default_factory = words.__len__
            # no word holds white space, so these two names are free
            return words, words[b"\n\n"], words[b"\n"], [], [], [], []

        def row():
            hashes = np.fromiter((xxh64_intdigest(w, XXH_SEED) for w in words), "<u8", len(words))
            return pd.DataFrame([((part << 32) + number, ids, train, lengths, squeezed(np.concatenate(tokens)),
                                  hashes.tobytes())],
                                columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        words, _, _, ids, train, lengths, tokens = fresh()
        size = 0
        for rows in batches:
            for one, is_train, text in zip(rows["id"], rows["train"], rows["text"]):
                own = words_of(text, lower=True)
                ids.append(one)
                train.append(bool(is_train))
                lengths.append(len(own) + 1)
                tokens.append(np.append(np.fromiter(map(words.__getitem__, own), "<i4", len(own)),
                                        np.int32(END)).astype("<i4"))
                size += len(own) + 1
                if size >= block_tokens:
                    yield row()
                    words, _, _, ids, train, lengths, tokens = fresh()
                    size, number = 0, number + 1
        if ids:
            yield row()
    return run


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its context and its last word."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Grams:
    """Distinct n-grams of a block by length: ids at every token, keys, contexts and shorter forms.

    Texts are laid out as start, words, end; ``at[k]`` numbers the n-gram of
    length k that ends at each token (-1: it would reach before the start).
    """

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: int):
        ends = np.cumsum(lengths)
        self.text = np.insert(tokens, ends - lengths, START).astype(np.int64)
        begins = ends - lengths + np.arange(len(lengths))
        place = np.arange(len(self.text)) - np.repeat(begins, lengths + 1)
        self.begins, self.order = begins, order
        self.at = {1: self.text}
        self.keys = {1: hashes}
        self.word = {1: np.arange(len(hashes))}
        self.context: dict[int, np.ndarray] = {}
        self.shorter: dict[int, np.ndarray] = {}
        for k in range(2, order + 1):
            has = np.flatnonzero(place >= k - 1)
            before = self.at[k - 1][has - 1]
            code = before * len(hashes) + self.text[has]
            distinct, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            self.at[k] = np.full(len(self.text), -1, np.int64)
            self.at[k][has] = inverse
            self.context[k], self.word[k] = before[first], self.text[has[first]]
            self.shorter[k] = self.at[k - 1][has[first]]
            self.keys[k] = _mixed(self.keys[k - 1][self.context[k]], hashes[self.word[k]])

    @classmethod
    def of(cls, row, order: int) -> Grams:
        return cls(restored(row.tokens, "<i4"), np.asarray(row.lengths, np.int64), np.frombuffer(row.hashes, "<u8"), order)


def range_of(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """Number of the key range, rising with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


def _sent_counts(order: int, n_ranges: int):
    """Block rows to rows (part, block, k, keys, counts) of every range that has keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                grams = Grams.of(row, order)
                train = np.repeat(np.asarray(row.train, bool), np.asarray(row.lengths) + 1)
                out = []
                for k in range(1, order + 1):
                    used = train & (grams.at[k] >= 0)
                    counts = np.bincount(grams.at[k][used], minlength=len(grams.keys[k])).astype("<i8")
                    by = np.argsort(grams.keys[k], kind="stable")
                    keys, counts = grams.keys[k][by], counts[by]
                    cuts = np.searchsorted(range_of(keys, n_ranges), np.arange(n_ranges + 1))
                    for part in np.flatnonzero(np.diff(cuts)):
                        a, b = cuts[part], cuts[part + 1]
                        out.append((int(part), row.block, k, squeezed(np.diff(keys[a:b], prepend=np.uint64(0))),
                                    squeezed(counts[a:b])))
                yield pd.DataFrame(out, columns=["part", "block", "k", "keys", "counts"])
    return run


def _totals(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of a range's keys over blocks: rows (block, part, k, totals); block -1 has the range's n and v."""
    from xxhash import xxh64_intdigest

    start = np.uint64(xxh64_intdigest(b"\n\n", XXH_SEED))
    out = []
    for k, own in rows.groupby("k"):
        keys = [np.cumsum(restored(x, "<u8"), dtype="<u8") for x in own["keys"]]
        counts = np.concatenate([restored(x, "<i8") for x in own["counts"]])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype("<i8")
        if k == 1:
            tokens = sums[distinct != start]
            out.append((-1, int(part[0]), 0, None, int(tokens.sum()), int((tokens > 0).sum())))
        found = np.split(sums[inverse], np.cumsum([len(x) for x in keys])[:-1])
        out += [(b, int(part[0]), k, squeezed(x), 0, 0) for b, x in zip(own["block"], found)]
    return pd.DataFrame(out, columns=["block", "part", "k", "totals", "n", "v"])


class Automaton:
    """Backoff automaton over a block's words.

    State 0 has no context and an arc for every word.  ``arcs`` maps state *
    width + word of the other states to the place in ``weight`` and ``target``;
    the first ``width`` places are the arcs of state 0.  ``fail`` is the weight
    of the failure arcs and ``lower`` their target.
    """

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], n: int, v: int, lam: float = LAMBDA):
        self.width = len(grams.keys[1])
        p = (counts[1] + 1.0) / (n + v + 1.0)
        states = {1: np.where(counts[1] > 0, 1 + np.arange(self.width), 0)}
        n_states = 1 + self.width
        codes = []
        weights, targets = [np.log10(p)], [states[1] if grams.order > 1 else np.zeros(self.width, np.int64)]
        lower = [np.zeros(1 + self.width, np.int64)]
        for k in range(2, grams.order + 1):
            seen = np.flatnonzero(counts[k] > 0)
            context, word, shorter = grams.context[k][seen], grams.word[k][seen], grams.shorter[k]
            full = (1 - lam) * p[shorter]
            full[seen] += lam * counts[k][seen] / counts[k - 1][context]
            p = full
            states[k] = states[k - 1][shorter]
            if k < grams.order:
                states[k][seen] = n_states + np.arange(len(seen))
                lower.append(states[k - 1][shorter[seen]])
                n_states += len(seen)
            codes.append(states[k - 1][context] * self.width + word)
            weights.append(np.log10(p[seen]))
            targets.append(states[k][seen])
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        self.arcs = dict(zip(code.tolist(), range(self.width, self.width + len(code))))
        # packed numbers: an automaton takes a few times less memory than with lists of objects
        self.weight = array("d", np.concatenate(weights).astype("f8").tobytes())
        self.target = array("q", np.concatenate(targets).astype("i8").tobytes())
        self.lower = array("q", np.concatenate(lower).astype("i8").tobytes())
        self.fail = float(np.log10(1 - lam))
        self.start = int(states[1][START]) if grams.order > 1 else 0

    def score(self, words: list[int]) -> float:
        """Log10 probability of a text: one walk from left to right."""
        find, width, fail = self.arcs.get, self.width, self.fail
        weight, target, lower = self.weight, self.target, self.lower
        state, sum_ = self.start, 0.0
        for w in words:
            arc = find(state * width + w) if state else w
            while arc is None:
                sum_ += fail
                state = lower[state]
                arc = find(state * width + w) if state else w
            sum_ += weight[arc]
            state = target[arc]
        return sum_


SCORE_COLUMNS = ("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _scores(order: int, n: int, v: int):
    """A block row and its totals to scores of its documents."""

    def run(key: tuple, blocks: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame([], columns=SCORE_COLUMNS)
        row = next(blocks.itertuples())
        grams = Grams.of(row, order)
        counts = {}
        for k in range(1, order + 1):
            own = totals[totals["k"] == k].sort_values("part")
            in_order = [restored(x, "<i8") for x in own["totals"]]
            counts[k] = np.zeros(len(grams.keys[k]), np.int64)
            if in_order:
                counts[k][np.argsort(grams.keys[k], kind="stable")] = np.concatenate(in_order)
        automaton = Automaton(grams, counts, n, v)
        lengths = np.asarray(row.lengths, np.int64)
        c = counts[1][grams.text]
        is_token = grams.text != START
        base = np.add.reduceat(np.where(is_token, np.log10((c + 1.0) / (n + v + 1.0)), 0.0), grams.begins)
        known = np.add.reduceat((is_token & (c > 0)).astype(np.int64), grams.begins)
        score = [automaton.score(grams.text[b + 1:b + 1 + m].tolist()) for b, m in zip(grams.begins.tolist(), lengths.tolist())]
        return pd.DataFrame({"id": list(row.ids), "held_out": ~np.asarray(row.train, bool), "n_tokens": lengths,
                             "n_known": known, "train_tokens": n, "base_score": base, "score": score})
    return run


def score_texts(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                block_tokens: int = BLOCK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per row of ``df``.

    The model learns from the rows where ``train`` holds (null: not).  Null
    and empty texts are just an end; repeated rows count and score each; null
    ids stay null.  Without training rows every token has the one unknown
    probability.  An empty table gives an empty result.  Columns besides id,
    text and those of ``train`` are not read.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
                     F.col(f"`{text_col}`").alias("text"))
    blocks = materialize(docs.mapInPandas(_blocks(block_tokens), BLOCK_SCHEMA), "lm-blocks")
    tokens = total(blocks.select(F.explode("lengths").alias("n")), F.coalesce(F.sum("n"), F.lit(0)))[0]
    n_ranges = max(1, -(-int(tokens) // range_tokens))
    sent = blocks.mapInPandas(_sent_counts(order, n_ranges),
                              "part bigint, block bigint, k int, keys binary, counts binary")
    totals = materialize(sent.groupBy("part").applyInPandas(
        _totals, "block bigint, part bigint, k int, totals binary, n bigint, v bigint"), "lm-totals")
    n, v = total(totals, F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0)))
    scored = blocks.groupBy("block").cogroup(totals.filter("block >= 0").groupBy("block")).applyInPandas(
        _scores(order, int(n), int(v)), "id string, held_out boolean, n_tokens bigint, n_known bigint, "
        "train_tokens bigint, base_score double, score double")
    return scored.withColumn("id", F.col("id").cast(df.schema[id_col].dataType))
