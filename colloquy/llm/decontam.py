"""Benchmark decontamination with an FM-index per shard of the training text.

Words are runs of digits, a-z and characters beyond ASCII, after lower-casing
A-Z.  Pass one cuts the documents into shards of bounded size and writes each
shard's FM-index as a row of a table in the shared folder.  Pass two searches
all phrases of the benchmark (windows of 10 words, or a whole shorter item) in
every index, one bounded block of phrases after another, and merges the spans.

Phrases travel as 64-bit hashes of their words, so a block has a fixed size
bound (``BLOCK`` x 10 x 8 bytes); so has the bitmap of word hashes that occur
in phrases.  Words outside it share one symbol of the index.
"""

from __future__ import annotations

import io
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import once, packed, row_key, total, unpacked
from .fm_index import FMIndex

WINDOW = 10
SHARD_WORDS = 500_000
PIECE_WORDS = 256
BLOCK = 100_000
BITMAP_BITS = 20
XXH_SEED = 42
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
# every byte that is not part of a word becomes a space
_SEPARATORS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
OTHER = 1


def content_words(text: str | None) -> list[bytes]:
    """Words of a text (null: none), lower-cased A-Z, as UTF-8."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split()


def phrase_table(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Rows (w1, w2, hashes, item): distinct phrases of each item, hashes of their words in order."""
    lower = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))
    t = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"),
                     F.transform(words, lambda w: F.xxhash64(w)).alias("h")).filter(F.size("h") > 0)
    t = once(t, "h")
    starts = F.sequence(F.lit(1), F.greatest(F.size("h") - (window - 1), F.lit(1)))
    t = t.select("item", F.explode(F.transform(starts, lambda s: F.slice("h", s, window))).alias("hashes"))
    return t.select(F.xxhash64("hashes").alias("w1"), F.xxhash64(F.lit(1), "hashes").alias("w2"), "hashes",
                    "item").distinct()


def _packed_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


class _Shard:
    """Words of documents gathered until the shard is full."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.parts: list[np.ndarray] = []
        self.pieces: list[tuple[int, int, int, int]] = []  # k1, k2, place of the first word, symbols
        self.size = 0

    def add(self, k1: int, k2: int, at: int, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, words), "<i4", len(words)))
        self.pieces.append((k1, k2, at, len(words)))
        self.size += len(words)

    def index(self) -> bytes:
        """The index, the hashes of its symbols and the pieces, as bytes."""
        from xxhash import xxh64_intdigest

        hashes = np.fromiter((xxh64_intdigest(w, XXH_SEED) for w in self.vocabulary), "<u8", len(self.vocabulary))
        known = self.bitmap[(hashes & np.uint64(len(self.bitmap) - 1)).astype(np.int64)]
        symbol = np.full(len(hashes), OTHER, "<i4")
        kept = np.sort(hashes[known])
        symbol[known] = np.searchsorted(kept, hashes[known]) + OTHER + 1
        end = np.zeros(1, "<i4")
        text = np.concatenate([x for p in self.parts for x in (symbol[p], end)])
        fm = FMIndex.build(text, len(kept) + OTHER + 1)
        pieces = np.array(self.pieces, "<i8")
        return _packed_arrays(fm.arrays() | {"kept": kept, "pieces": pieces})


def _indexes(bitmap_ref, window: int, shard_words: int, piece_words: int):
    """Documents (k1, k2, text) to rows of indexes, and a row of words for each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = _Shard(bitmap_ref.value)
        for rows in batches:
            counts = []
            for k1, k2, text in zip(rows["k1"].tolist(), rows["k2"].tolist(), rows["text"]):
                words = content_words(text)
                counts.append((k1, k2, len(words), None))
                # pieces overlap by a phrase less a word, so no phrase is cut
                for at in range(0, len(words), piece_words):
                    if at and at + window - 1 >= len(words):
                        break
                    shard.add(k1, k2, at, words[at:at + piece_words + window - 1])
                    if shard.size >= shard_words:
                        yield pd.DataFrame([(0, 0, 0, shard.index())], columns=["k1", "k2", "n_words", "fm"])
                        shard = _Shard(bitmap_ref.value)
            yield pd.DataFrame(counts, columns=["k1", "k2", "n_words", "fm"])
        if shard.size:
            yield pd.DataFrame([(0, 0, 0, shard.index())], columns=["k1", "k2", "n_words", "fm"])
    return run


def _search(block_ref):
    """Index rows to rows (k1, k2, w1, w2, start, stop): occurrences of the block's phrases by document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, lengths, w1, w2 = block_ref.value
        for rows in batches:
            for blob in rows["fm"]:
                a = dict(np.load(io.BytesIO(blob)))
                fm, kept, pieces = FMIndex.of(a), a["kept"], a["pieces"]
                at = np.searchsorted(kept, hashes)
                known = kept[np.minimum(at, max(len(kept) - 1, 0))] == hashes if len(kept) else np.zeros(hashes.shape, bool)
                inside = np.arange(hashes.shape[1]) < lengths[:, None]
                possible = np.flatnonzero((known | ~inside).all(axis=1))
                lo, hi = fm.search(np.where(inside, at + OTHER + 1, 0)[possible], lengths[possible])
                n = hi - lo
                phrase = np.repeat(possible, n)
                found = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                places = fm.locate(found)
                begins = np.cumsum(pieces[:, 3] + 1) - (pieces[:, 3] + 1)
                piece = np.searchsorted(begins, places, side="right") - 1
                start = pieces[piece, 2] + places - begins[piece]
                yield pd.DataFrame({"k1": pieces[piece, 0], "k2": pieces[piece, 1], "w1": w1[phrase], "w2": w2[phrase],
                                    "start": start, "stop": start + lengths[phrase]})
    return run


def contaminated_texts(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       shard_words: int = SHARD_WORDS, piece_words: int = PIECE_WORDS, block: int = BLOCK) -> DataFrame:
    """Rows (k1, k2, n_words, n_hit, spans, items), one per distinct (id, text) of ``df``.

    (k1, k2) is the row's digest, ``spans`` the merged array of struct(start,
    stop) over its words, ``items`` the sorted ids (as strings) of the items
    that occur.  Null and empty texts have no words and no hits; null or empty
    items have no phrases, an item without an id counts as ``null``.  Repeated
    rows count once, empty tables give empty results or no hits.
    """
    spark = df.sparkSession
    phrases = materialize(phrase_table(items, item_id, item_text, window), "phrases")
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    # at most 2^20 numbers, whatever the benchmark
    used = phrases.select(F.explode("hashes").alias("h")).select(
        F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).alias("bit")).distinct()
    bitmap[used.toPandas()["bit"].to_numpy("int64")] = True
    bitmap_ref = spark.sparkContext.broadcast(bitmap)

    k1, k2 = row_key([id_col, text_col])
    docs = df.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{text_col}`").alias("text"))
    index = materialize(docs.mapInPandas(_indexes(bitmap_ref, window, shard_words, piece_words),
                                         "k1 bigint, k2 bigint, n_words bigint, fm binary"), "fm-index")
    shards = index.filter("fm is not null").select("fm")
    distinct = phrases.select("w1", "w2", "hashes").dropDuplicates(["w1", "w2"])
    n_blocks = max(1, -(-total(distinct, F.count(F.lit(1)))[0] // block))
    hits = None
    for b in range(n_blocks):
        own = distinct.filter(F.pmod("w1", F.lit(n_blocks)) == b).toPandas()
        lengths = own["hashes"].map(len).to_numpy("int64") if len(own) else np.zeros(0, "int64")
        hashes = np.zeros((len(own), window), "<u8")
        for i, h in enumerate(own["hashes"]):
            hashes[i, :len(h)] = np.asarray(h, "<i8").view("<u8")
        ref = spark.sparkContext.broadcast((hashes, lengths, own["w1"].to_numpy("int64"), own["w2"].to_numpy("int64")))
        found = shards.mapInPandas(_search(ref), "k1 bigint, k2 bigint, w1 bigint, w2 bigint, start bigint, stop bigint")
        found = materialize(found, "fm-hits")
        hits = found if hits is None else hits.union(found)

    spans = merged_spans(hits)
    found_items = (hits.select("k1", "k2", "w1", "w2").distinct()
                   .join(phrases.select("w1", "w2", "item"), ["w1", "w2"])
                   .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items")))
    texts = index.filter("fm is null").groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"))
    out = texts.join(spans, ["k1", "k2"], "left").join(found_items, ["k1", "k2"], "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    return out.select("k1", "k2", "n_words", F.coalesce(n_hit, F.lit(0)).cast("bigint").alias("n_hit"), "spans",
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def merged_spans(hits: DataFrame) -> DataFrame:
    """Rows (k1, k2, spans): the union of a text's spans (start, stop) as disjoint, sorted spans.

    A span opens a stretch where no earlier span reaches its start.
    """
    in_order = Window.partitionBy("k1", "k2").orderBy("start")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    distinct = hits.groupBy("k1", "k2", "start").agg(F.max("stop").alias("stop"))
    opened = distinct.withColumn("opens", F.coalesce(F.col("start") > F.max("stop").over(earlier), F.lit(True)))
    stretches = (opened.withColumn("stretch", F.sum(F.col("opens").cast("int")).over(in_order))
                 .groupBy("k1", "k2", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop")))
    return stretches.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """All rows of ``df`` with ``n_words``, ``n_hit``, ``spans`` and ``items`` of ``contaminated_texts``.

    Columns of those names are replaced.
    """
    k1, k2 = row_key([F.col("rec")[id_col], F.col("rec")[text_col]])
    found = contaminated_texts(df, items, id_col, text_col, **options)
    rows = packed(df).withColumns({"k1": k1, "k2": k2}).join(found, ["k1", "k2"])
    return unpacked(rows, df.columns, ["n_words", "n_hit", "spans", "items"])


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  chars_col: str = "n_chars", **options) -> DataFrame:
    """The rows of ``df`` with the hit spans cut out of ``text_col``, other texts as they are.

    A text of which no word is left goes; ``chars_col``, if there is such a
    column, follows the texts that change.
    """
    k1, k2 = row_key([F.col("rec")[id_col], F.col("rec")[text_col]])
    found = contaminated_texts(df, items, id_col, text_col, **options).select("k1", "k2", "n_words", "n_hit", "spans")
    rows = packed(df).withColumns({"k1": k1, "k2": k2}).join(found, ["k1", "k2"])
    rows = rows.filter("n_hit = 0 or n_hit < n_words")
    rows = once(rows.withColumn("clean", removed_spans(F.col("rec")[text_col], F.col("spans"))), "clean")
    new = {text_col: F.col("clean")}
    if chars_col in df.columns:
        new[chars_col] = F.when(F.col("n_hit") > 0, F.length("clean")).otherwise(F.col("rec")[chars_col]).cast(
            df.schema[chars_col].dataType)
    return rows.select(*[new.get(c, F.col("rec")[c]).alias(c) for c in df.columns])


def removed_spans(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` and what stands between them."""

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(texts, spans)], dtype=object)

    return F.pandas_udf(cut, "string")(text, spans)


def _without(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at:places[s["start"]][0]])
        at = places[s["stop"] - 1][1]
    return "".join([*out, text[at:]])
