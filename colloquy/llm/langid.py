"""Language identification by word-first backoff.

A known word scores by its log frequency in each language.  An unseen word
falls back to its character n-grams, longest first: the first length of which
any n-gram is known scores the word by the mean log frequency of those.

The model is fitted on a bounded sample of labelled rows: ``SAMPLE_DOCS``
documents of each language are expected in it, picked by a hash, and the table
of words and n-grams keeps those seen at least ``c`` times, c the smallest
power of two that leaves at most ``MAX_ENTRIES`` entries, so the broadcast
model is bounded whatever the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .common import row_key, total, unit_hash

SAMPLE_DOCS = 4_000
MAX_ENTRIES = 150_000
MAX_GRAM = 4
SEED = 42
CACHED_WORDS = 200_000
HELD_WORDS = 100_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; numerals such as ½ or Ⅷ are no letters and part words."""
    words = []
    for run in LETTERS.findall(text.lower()):
        words += [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return words


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _entries(lang: str, words: Counter) -> list[tuple]:
    """Words and their n-grams of every length with their counts."""
    out = [(lang, 0, w, c) for w, c in words.items()]
    for n in range(1, MAX_GRAM + 1):
        grams: Counter = Counter()
        for w, c in words.items():
            for g in grams_of(w, n):
                grams[g] += c
        out += [(lang, n, g, c) for g, c in grams.items()]
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (lang, text) to rows (lang, kind, entry, n): kind 0 are words, kind n n-grams.

    Counts are held over batches and sent when ``HELD_WORDS`` words are held.
    """
    columns = ["lang", "kind", "entry", "n"]
    held: dict[str, Counter] = {}
    for rows in batches:
        for lang, text in zip(rows["lang"], rows["text"]):
            if text:
                held.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, held.values())) >= HELD_WORDS:
            for lang, words in held.items():
                yield pd.DataFrame(_entries(lang, words), columns=columns)
            held = {}
    for lang, words in held.items():
        yield pd.DataFrame(_entries(lang, words), columns=columns)


class Model:
    """Log frequencies of words and n-grams by language.

    A language in which an entry was not seen counts it half a time.
    """

    def __init__(self, languages: list[str], entries: pd.DataFrame, sums: dict[tuple[str, int], int]):
        self.languages = languages
        self.tables: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
        column = {name: i for i, name in enumerate(languages)}
        distinct = entries[["kind", "entry"]].drop_duplicates()
        for row, (kind, entry) in enumerate(distinct.itertuples(index=False)):
            self.tables[kind][entry] = row
        n = np.full((len(distinct), len(languages)), 0.5)
        whole = np.ones_like(n)
        for kind, table in enumerate(self.tables):
            at = np.fromiter(table.values(), np.int64, len(table))
            whole[at] = [sums.get((name, kind), 0) + 1.0 for name in languages]
        rows = [self.tables[k][e] for k, e in zip(entries["kind"], entries["entry"])]
        n[rows, [column[x] for x in entries["lang"]]] = entries["n"]
        self.logs = np.log(n / whole).astype(np.float32)
        self.cache: dict[str, list[int]] = {}

    def rows_of(self, word: str) -> list[int]:
        """Rows whose mean scores a word: its own, or its longest known n-grams'."""
        known = self.tables[0].get(word)
        if known is not None:
            return [known]
        rows = self.cache.get(word)
        if rows is None:
            for n in range(MAX_GRAM, 0, -1):
                table = self.tables[n]
                rows = [table[g] for g in grams_of(word, n) if g in table]
                if rows:
                    break
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = rows
        return rows

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language of a text and its share of the languages' normalised likelihood."""
        words = Counter(words_of(text)) if text else None
        if not words or not self.languages:
            return UNKNOWN, 0.0
        rows: list[int] = []
        weights: list[float] = []
        for w, c in words.items():
            own = self.rows_of(w)
            rows += own
            weights += [c / len(own)] * len(own) if own else []
        sums = np.asarray(weights) @ self.logs[rows] if rows else np.zeros(len(self.languages))
        # words of a text are not independent: its evidence counts as that of sqrt(n) words
        share = np.exp((sums - sums.max()) / math.sqrt(sum(words.values())))
        best = int(sums.argmax())
        return self.languages[best], float(share[best] / share.sum())


def fit(df: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang",
        sample_docs: int = SAMPLE_DOCS, max_entries: int = MAX_ENTRIES) -> Model:
    """The model of the rows of ``df`` where ``train`` holds and the language is not null.

    The sample is drawn by a hash of all columns but maps, which cannot be
    hashed: equal rows are in it together or not at all.  Null and empty texts
    add nothing, very long texts are read whole, and a table without a
    labelled row gives a model that knows no language.
    """
    k1, k2 = row_key(sorted(name for name, kind in df.dtypes if "map<" not in kind), SEED)
    labelled = df.select(F.col(f"`{lang_col}`").alias("lang"), F.coalesce(train, F.lit(False)).alias("train"),
                         F.col(f"`{text_col}`").alias("text"), unit_hash(F.lit(SEED), k1, k2).alias("u"))
    labelled = labelled.filter("train and lang is not null")
    shares = labelled.groupBy("lang").agg((F.lit(float(sample_docs)) / F.count(F.lit(1))).alias("share"))
    sample = labelled.join(broadcast_if_small(shares), "lang").filter("u < share").select("lang", "text")
    counts = materialize(sample.mapInPandas(_counted, "lang string, kind int, entry string, n bigint")
                         .groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n")), "langid-counts")
    # entries by their count in all languages; the histogram of counts has few rows
    entries = counts.groupBy("kind", "entry").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("rows"))
    least = 2
    while total(entries.filter(F.col("all") >= least), F.coalesce(F.sum("rows"), F.lit(0)))[0] > max_entries:
        least *= 2
    kept = counts.join(entries.filter(F.col("all") >= least).select("kind", "entry"), ["kind", "entry"])
    sums = counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in sums})
    kept = kept.select("lang", "kind", "entry", "n").toPandas().sort_values(["kind", "entry", "lang"])
    return Model(languages, kept, {(r["lang"], r["kind"]): r["n"] for r in sums})


def _predicted(model_ref):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model_ref.value.predict(t) for t in texts], columns=["lang_pred", "score"])
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def predict(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """struct(lang_pred, score) of a text.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if nothing was learned; ties go to the first language by code point.
    """
    model_ref = df.sparkSession.sparkContext.broadcast(model)
    return F.pandas_udf(_predicted(model_ref), "lang_pred string, score double")(F.col(f"`{text_col}`"))
