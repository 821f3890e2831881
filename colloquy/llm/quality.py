"""Quality rules by tokenizer fertility.

A public byte-level vocabulary for many languages measures every whole text:
characters per token, the share of byte-fallback tokens and the entropy of its
tokens.  Good text of a language
stays within narrow bands of these; gibberish, mark-up, repeated or shouted
text does not.  The bands come from rows labelled good: for each language and
octave of text length (entropy grows with length) the range that all but a
thousandth of them on either side keep, widened by a margin.  A cell with too few
labelled rows borrows: the nearest octaves that together have enough serve, of
the language if it has them as near as its script, else of the script.  A script
with too few in all its octaves is held against all good rows together with its
own, text without letters against all good rows.  A script without one good
label is not judged: fertility differs between scripts, so other scripts' bands
would reject all of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from . import vocab

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_LABELLED = 100
TAIL = 0.001
MARGIN = 0.3
OCTAVES = 32
MEASURES = ("chars_per_token", "byte_share", "entropy")
SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "n_tokens bigint, chars_per_token double, byte_share double, entropy double, script string")
# First code points of the stretches of scripts, in order; fixed values of Unicode.
SCRIPT_STARTS = [(0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
                 (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"),
                 (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x3040, "kana"),
                 (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "none"), (0xF900, "han"),
                 (0xFB00, "other"), (0x1F000, "none"), (0x20000, "han"), (0x323B0, "none")]
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_NAMES = sorted({b for _, b in SCRIPT_STARTS})
_KINDS = np.array([_NAMES.index(b) for _, b in SCRIPT_STARTS])


def script_of(text: str) -> str:
    """Script of most characters of a text; ``none`` without any."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.searchsorted(_STARTS, points, side="right") - 1
    counts = np.bincount(_KINDS[at[at >= 0]], minlength=len(_NAMES))
    # digits and signs between the letters of ASCII say nothing
    ascii_other = int((points < 0x80).sum()) - sum(c.isalpha() for c in text if c < "\x80")
    counts[_NAMES.index("latin")] -= min(ascii_other, counts[_NAMES.index("latin")])
    counts[_NAMES.index("none")] = 0
    return _NAMES[int(counts.argmax())] if counts.any() else "none"


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words covered by windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    at, key = np.arange(n), one[:n]
    # windows grow by one word; one whose opening occurs once cannot occur twice
    for k in range(1, window):
        key, counts = np.unique(key * len(ids) + one[at + k], return_inverse=True, return_counts=True)[1:]
        again = counts[key] > 1
        at, key = at[again], key[again]
        if not len(at):
            return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[at] += 1
    edges[at + window] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _is_whole(token: bytes) -> bool:
    try:
        token.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


class Fertility:
    """Tokens of whole texts by a byte-level vocabulary.

    A token that is not whole characters (a byte or some bytes of one that the
    vocabulary lacks) is a byte fallback.
    """

    def __init__(self, encoding):
        self.encoding = encoding
        self.is_byte = np.zeros(encoding.n_vocab, bool)
        for i in range(encoding.n_vocab):
            self.is_byte[i] = not _is_whole(encoding.decode_single_token_bytes(i))

    def of(self, text: str) -> tuple[int, int, float]:
        """Tokens, byte-fallback tokens and entropy in bits."""
        counts = np.bincount(self.encoding.encode_ordinary(text), minlength=len(self.is_byte)) if text else np.zeros(1)
        n = int(counts.sum())
        if not n:
            return 0, 0, 0.0
        p = counts[counts > 0] / n
        return n, int(counts[self.is_byte].sum()), max(0.0, float(-(p * np.log2(p)).sum()))


def measure_text(text: str | None, fertility: Fertility) -> tuple:
    """One row of ``SCHEMA``; a null text counts as an empty one."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    lines: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in lines
            lines.add(line)
    tokens, fallback, entropy = fertility.of(text)
    return (len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), tokens,
            chars / tokens if tokens else 0.0, fallback / tokens if tokens else 0.0, entropy, script_of(text))


def _measured(ranks_ref):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fertility = Fertility(vocab.byte_encoding(ranks_ref.value))
        for texts in batches:
            yield pd.DataFrame([measure_text(t, fertility) for t in texts],
                               columns=[c.split()[0] for c in SCHEMA.split(", ")])
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def measures(df: DataFrame, text_col: str = "text", ranks_path: str = vocab.MULTI_RANKS) -> Column:
    """The measures of a text as a struct column of ``SCHEMA`` (Arrow batches)."""
    ranks_ref = vocab.shipped(df.sparkSession, ranks_path)
    return F.pandas_udf(_measured(ranks_ref), SCHEMA)(F.col(f"`{text_col}`"))


def octave() -> Column:
    """Length class of a measured text: the binary logarithm of its tokens, rounded down."""
    return F.floor(F.log2(F.greatest(F.col("m.n_tokens"), F.lit(1)).cast("double"))).cast("int")


def grid(labelled: DataFrame) -> DataFrame:
    """Rows (lang, script, octave, measure, value, n): labelled good rows (m, octave, lang, script) on a grid of 0.01.

    Tails read off it are exact counts over all labelled rows, and the work
    after the counting has a bounded size.
    """
    long = labelled.select("lang", "script", "octave", F.explode(F.array(*[F.struct(
        F.lit(name).alias("measure"), F.round(F.col("m")[name], 2).alias("value")) for name in MEASURES])).alias("x"))
    return long.groupBy("lang", "script", "octave", "x.measure", "x.value").agg(F.count(F.lit(1)).alias("n"))


def bands(counts: DataFrame, group: str) -> DataFrame:
    """Rows (group, octave, radius, all_rows, <measure>_lo, <measure>_hi) from the ``grid``, for every octave.

    A band comes from the octaves within ``radius``, the least one that gathers
    ``MIN_LABELLED`` rows; a group with fewer rows in all uses all of them.
    Characters per token and byte share are means over tokens, so what longer
    texts stray from the mean of the group counts more for shorter ones, by the
    root of the length.  Entropy moves by at most one bit an octave (that of a
    text is at most one bit above the mean of its halves, and not below it), so
    a cell outside its rows' octaves has its edge one bit further an octave.
    """
    counts = counts.groupBy(group, "octave", "measure", "value").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(group, "octave")
    cell = Window.partitionBy(group, "octave", "measure")
    near = (counts.filter(F.col("measure") == MEASURES[0]).groupBy(group, F.col("octave").alias("of"))
            .agg(F.sum("n").alias("rows"))
            .withColumn("octave", F.explode(F.sequence(F.lit(0), F.lit(OCTAVES - 1))))
            .withColumn("far", F.abs(F.col("of") - F.col("octave")))
            .withColumns({"all_rows": F.sum("rows").over(own), "upto": F.sum("rows").over(own.orderBy("far"))})
            .withColumn("radius", F.min(F.when(F.col("upto") >= F.least("all_rows", F.lit(MIN_LABELLED)), F.col("far")))
                        .over(own))
            .filter(F.col("far") <= F.col("radius"))
            .withColumns({"under": F.greatest(F.min("of").over(own) - F.col("octave"), F.lit(0)),
                          "over": F.greatest(F.col("octave") - F.max("of").over(own), F.lit(0))})
            .drop("rows", "far", "upto"))
    every = Window.partitionBy(group, "measure")
    centred = counts.withColumn("centre", F.sum(F.col("value") * F.col("n")).over(every) / F.sum("n").over(every))
    strayed = F.col("centre") + (F.col("value") - F.col("centre")) * F.pow(F.lit(2.0), (F.col("of") - F.col("octave")) / 2)
    entropy = F.col("measure") == "entropy"
    pooled = centred.withColumnRenamed("octave", "of").join(near, [group, "of"]).withColumn(
        "value", F.when(~entropy & (F.col("of") > F.col("octave")), strayed).otherwise(F.col("value")))
    ranked = pooled.select("*", F.sum("n").over(cell).alias("all"),
                           F.sum("n").over(cell.orderBy("value")).alias("upto"))
    edges = (ranked.groupBy(group, "octave", "radius", "all_rows", "under", "over", "measure")
             .agg(F.min(F.when(F.col("upto") > F.col("all") * TAIL, F.col("value"))).alias("lo"),
                  F.min(F.when(F.col("upto") >= F.col("all") * (1 - TAIL), F.col("value"))).alias("hi")))
    wide = F.greatest((F.col("hi") - F.col("lo")) * MARGIN, F.lit(0.02))
    bits = lambda side: F.when(entropy, F.col(side)).otherwise(0)
    edges = edges.select(group, "octave", "radius", "all_rows", "measure", (F.col("lo") - wide - bits("under")).alias("lo"),
                         (F.col("hi") + wide + bits("over")).alias("hi"))
    pick = lambda name, side: F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{name}_{side}")
    return edges.groupBy(group, "octave", "radius", "all_rows").agg(*[pick(n, s) for n in MEASURES for s in ("lo", "hi")])


def script_bands(counts: DataFrame) -> DataFrame:
    """``bands`` of the scripts; those of thin scripts reach over all good rows, as do those of text without letters."""
    own = bands(counts, "script")
    every = bands(counts.withColumn("every", F.lit("")), "every").filter(F.col("all_rows") >= MIN_LABELLED).drop("every")
    sides = [f"{n}_{s}" for n in MEASURES for s in ("lo", "hi")]
    thin = own.filter(F.col("all_rows") < MIN_LABELLED).select("script", "octave", *[F.col(c).alias(f"own_{c}") for c in sides])
    bare = every.select(F.lit("none").alias("script"), "octave").withColumns(
        {f"own_{c}": F.lit(None).cast("double") for c in sides})
    thin = thin.unionByName(bare.join(own.select("script", "octave"), ["script", "octave"], "left_anti"))
    hull = thin.join(every, "octave").select("script", "octave", "radius", "all_rows", *[
        (F.least if c.endswith("_lo") else F.greatest)(F.col(c), F.col(f"own_{c}")).alias(c) for c in sides])
    return own.filter(F.col("all_rows") >= MIN_LABELLED).unionByName(hull)


def verdicts(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """``measured`` (rows with ``rec`` and ``m``) with booleans ``base_failed`` and ``kept``.

    ``labels`` has doc_id and quality (1: good); rows of null quality or id
    and labels without a document say nothing, repeated labels count as often
    as they stand.  A text fails the base rules with fewer than 10 words or if
    more than a fifth of them repeat.
    """
    m = measured.withColumns({"octave": octave(), "lang": F.col("rec")[lang_col], "script": F.col("m.script")})
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("good_id"))
    labelled = m.join(good, F.col("rec")[id_col] == F.col("good_id")).select("m", "octave", "lang", "script")
    counts = materialize(grid(labelled), "bands-grid")
    by_lang = bands(counts.filter("lang is not null"), "lang").filter(F.col("all_rows") >= MIN_LABELLED).drop("all_rows")
    by_lang = materialize(by_lang, "bands-lang")
    by_script = materialize(script_bands(counts).drop("all_rows"), "bands-script")
    by_script = by_script.select("script", "octave", *[F.col(c).alias(f"s_{c}") for c in by_script.columns[2:]])
    out = (m.join(broadcast_if_small(by_lang), ["lang", "octave"], "left")
           .join(broadcast_if_small(by_script), ["script", "octave"], "left"))
    inside, nearer = F.lit(True), F.col("s_radius") < F.col("radius")
    for name in MEASURES:
        lo, hi = (F.when(nearer, F.col(f"s_{name}_{s}")).otherwise(F.coalesce(F.col(f"{name}_{s}"), F.col(f"s_{name}_{s}")))
                  for s in ("lo", "hi"))
        inside = inside & F.coalesce(F.col("m")[name].between(lo, hi), F.lit(True))
    words, repeat = F.col("m.n_words"), F.col("m.n_repeat_words")
    failed = (words < MIN_WORDS) | (repeat * 100 > words * MAX_REPEAT_PERCENT)
    return out.select("rec", "m", failed.alias("base_failed"), (~failed & inside).alias("kept"))


def judge(df: DataFrame, labels: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", ranks_path: str = vocab.MULTI_RANKS) -> DataFrame:
    """Rows (rec, m, base_failed, kept): ``rec`` has the columns ``carry`` of ``df`` (default: all), ``m`` the measures.

    One row per row of ``df``: null and empty texts measure 0 and fail, repeated
    rows are judged alike, an empty table gives an empty result.  Working
    columns stand beside ``rec``, so names of ``df`` cannot clash with them.
    ``carry`` must hold ``id_col`` and ``lang_col``.
    """
    rec = F.struct(*[F.col(f"`{c}`") for c in (carry or df.columns)]).alias("rec")
    measured = materialize(df.select(rec, measures(df, text_col, ranks_path).alias("m")), "measured")
    return verdicts(measured, labels, id_col, lang_col)
