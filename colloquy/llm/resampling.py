"""Importance resampling of a corpus towards a target distribution.

Words come from an untrained Regex Split of the ``tokenizers`` library, run
over the text with A-Z lower-cased; it returns every word with its byte
offsets.  A window of one to three words is a pair of offsets (start of its
first word, end of its last) in the words joined by one space, and its bucket
is the CRC-32 of the bytes between them.  CRC-32 is linear, so a window's value
follows from that of the window one word shorter: advance it over the length
of the added bytes and add their own value; no window is cut out as a string.

One pass writes every row's buckets as packed numbers.  Bucket histograms of
corpus and target are sums of one partial histogram a task.  Their smoothed
log-ratio is a bucket's gain (a fixed number of buckets, so the gains may be
broadcast), a row's weight the sum of its gains, and Gumbel noise keyed by the
id turns weights into a draw without replacement: the highest scores win.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import global_row_number
from ..session import materialize, spread
from .common import packed, row_key, total, unpacked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 3        # words of a window at most
BUCKETS = 10_000   # at most 65,536: buckets are packed as two bytes
SEED = 42
LEAST_WORDS = 20   # rows with fewer words are not drawn
PERCENT = 5        # of the rows with enough words that are drawn
_PIECE = 1 << 16   # characters split at once
_LONG = 256        # windows whose added bytes are longer are computed from their bytes


@lru_cache(maxsize=1)
def splitter():
    """The untrained pre-tokenizer: words are what the pattern finds, the rest is removed."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def _pieces(text: str) -> Iterator[str]:
    """The text cut before spaces into pieces of some 65,536 characters (a longer word stays whole)."""
    at = 0
    while len(text) - at > _PIECE:
        cut = text.find(" ", at + _PIECE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def split_words(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """Words of a text (null: none) as UTF-8 bytes with A-Z lower-cased, and their lengths from the byte offsets."""
    from tokenizers import PreTokenizedString

    words: list[bytes] = []
    for piece in _pieces(text) if text else ():
        raw = piece.encode().lower()
        cut = PreTokenizedString(raw.decode())
        splitter().pre_tokenize(cut)
        words += [raw[s:e] for _, (s, e), _ in cut.get_splits(offset_referential="original", offset_type="byte")]
    return words, np.fromiter(map(len, words), np.int64, len(words))


@lru_cache(maxsize=None)
def _advance_table(length: int) -> np.ndarray:
    """4 x 256 table: what each byte of a CRC-32 becomes after ``length`` zero bytes."""
    if length == 0:
        byte = np.arange(256, dtype=np.uint32)
        return np.stack([byte << (8 * k) for k in range(4)])
    if length == 1:
        zero = zlib.crc32(b"\0")
        return np.array([[zlib.crc32(b"\0", b << (8 * k)) ^ zero for b in range(256)] for k in range(4)], np.uint32)
    return _advanced(_advance_table(length - 1), _advance_table(1))


def _advanced(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 values led over the zero bytes of ``table``."""
    return (table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24])


@lru_cache(maxsize=1)
def _advance_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables of all lengths up to ``_LONG``, flat, and a space led over each of them."""
    tables = np.stack([_advance_table(n) for n in range(_LONG + 1)])
    space = np.array([zlib.crc32(b" ")], np.uint32)
    return tables.reshape(-1), np.concatenate([_advanced(space, t) for t in tables])


def window_crcs(words: list[bytes], lengths: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """CRC-32 of all runs of 1 to ``longest`` words joined by one space (all runs of one word first)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint32)
    tables, space = _advance_tables()

    def led(crc: np.ndarray, over: np.ndarray) -> np.ndarray:
        t = np.minimum(over, _LONG) << 10
        return (tables.take(t + (crc & 255)) ^ tables.take(t + ((crc >> 8) & 255) + 256)
                ^ tables.take(t + ((crc >> 16) & 255) + 512) ^ tables.take(t + (crc >> 24) + 768))

    own = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    spaced = space.take(np.minimum(lengths, _LONG)) ^ own  # of a space and the word
    long_words = np.flatnonzero(lengths >= _LONG).tolist()
    for i in long_words:
        spaced[i] = zlib.crc32(b" " + words[i])
    out, window = [own], own
    for k in range(1, min(longest, n)):
        window = led(window[:-1], lengths[k:] + 1) ^ spaced[k:]
        for i in (x - k for x in long_words if x >= k):
            window[i] = zlib.crc32(b" ".join(words[i:i + k + 1]))
        out.append(window)
    return np.concatenate(out)


def _featurize(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, packed = [], []
            for text in batch.column("text"):
                words, lengths = split_words(text.as_py())
                n_words.append(len(words))
                packed.append((window_crcs(words, lengths, longest) % buckets).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "k1", "k2")] + [pa.array(n_words, pa.int64()),
                                                               pa.array(packed, pa.binary())],
                names=["id", "k1", "k2", "n_words", "features"])
    return run


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST,
             buckets: int = BUCKETS) -> DataFrame:
    """Rows (id, k1, k2, n_words, features): buckets of all windows of a row, two bytes each; (k1, k2) names id and text."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets: 1 to 65,536")
    k1, k2 = row_key([id_col, text_col])
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), k1.alias("k1"), k2.alias("k2"),
                       F.col(f"`{text_col}`").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return spread(narrow).mapInArrow(_featurize(longest, buckets),
                                     f"id {kind}, k1 bigint, k2 bigint, n_words bigint, features binary")


def _count_buckets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                sums += np.bincount(np.frombuffer(packed.as_buffer(), "<u2"), minlength=buckets)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[hit])], names=["bucket", "n"])
    return run


def bucket_histogram(featured: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n) over all features; every task sends one row a bucket at most."""
    parts = featured.select("features").mapInArrow(_count_buckets(buckets), "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def histogram_array(histogram: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A histogram as an array: at most one row a bucket comes to the driver."""
    out = np.zeros(buckets, np.int64)
    for row in histogram.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus, from two histograms."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    share = (t + 1) * (float(corpus.sum()) + n) / ((s + 1) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def gain_sum(packed: Column, gains: np.ndarray) -> Column:
    """Sum of the gains of a row's features (none: 0), in Arrow batches."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([int(gains[np.frombuffer(x, "<u2")].sum()) for x in rows], dtype="int64")
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "bigint")(packed)


def gumbel_noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256(``seed:id``); a null id reads ``null``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def importance_resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        target_text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
                        least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Rows (id, k1, k2, n_words, n_features, weight, score, rank), one per row of ``df``.

    ``rank`` is 1, 2, ... for the drawn rows from the highest score down, null
    for the others; floor(percent * N / 100) of the N rows with ``least_words``
    words are drawn.  Ties go to the smaller id, null ids last, then to the
    smaller digest (k1, k2) of id and text; equal rows are rows of their own.
    Null and empty texts have no features and weight 0; a very long text is
    split piece by piece.  An empty target weighs all buckets by the corpus
    alone, an empty table gives no rows.  Other columns are not read.
    """
    featured = materialize(features(df, id_col, text_col, longest, buckets), "resample-features")
    wanted = features(target.select(F.lit(0).alias("id"), F.col(f"`{target_text_col}`").alias("text")), "id", "text",
                      longest, buckets)
    gains = bucket_gains(histogram_array(bucket_histogram(featured, buckets), buckets),
                         histogram_array(bucket_histogram(wanted, buckets), buckets))
    scored = featured.select(
        "id", "k1", "k2", "n_words", (F.octet_length("features") / 2).cast("bigint").alias("n_features"),
        gain_sum(F.col("features"), gains).alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + gumbel_noise(F.col("id"), seed))
    scored = materialize(scored, "resample-scores")
    able = F.col("n_words") >= least_words
    n = total(scored.filter(able), F.count(F.lit(1)))[0]
    order = [F.col("score").desc(), F.col("id").isNull(), F.col("id"), F.col("k1"), F.col("k2")]
    placed = global_row_number(scored.filter(able), order, "place")
    drawn = placed.withColumn("rank", F.when(F.col("place") <= percent * n // 100, F.col("place"))).drop("place")
    return drawn.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint")))


def drawn_rows(df: DataFrame, ranked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``importance_resample`` has drawn, whole and with their ``rank`` (replacing a column of it).

    Equal rows share their digest; each drawn place takes one of them.
    """
    taken = ranked.filter("rank IS NOT NULL").select("k1", "k2", "rank")
    keyed = packed(df)
    k1, k2 = row_key([F.col("rec")[id_col], F.col("rec")[text_col]])
    # one whole row a digest and its places: equal in id and text, so any of them serves
    first = keyed.withColumns({"k1": k1, "k2": k2}).join(taken.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    return unpacked(first.dropDuplicates(["k1", "k2"]).join(taken, ["k1", "k2"]), df.columns, ["rank"])
