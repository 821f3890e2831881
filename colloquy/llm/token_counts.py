"""Token counts: an exact histogram of encoded lengths, answered by suffix sums.

Documents are encoded whole by a public byte-level vocabulary and aggregated
by their number of tokens.  Sums over the lengths from each one on tell, for
every context limit, how many documents reach it and how many tokens remain
when texts are cut there, and the same sums give exact quantiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import running_sum
from ..session import materialize
from . import vocab
from .common import total


def _encoded(ranks_ref):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = vocab.byte_encoding(ranks_ref.value)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def token_count(df: DataFrame, text_col: str = "text", ranks_path: str = vocab.BYTE_RANKS) -> Column:
    """Tokens of a whole text (null: 0); names of special tokens are ordinary text."""
    return F.pandas_udf(_encoded(vocab.shipped(df.sparkSession, ranks_path)), "bigint")(F.col(f"`{text_col}`"))


def length_histogram(df: DataFrame, text_col: str = "text", ranks_path: str = vocab.BYTE_RANKS) -> DataFrame:
    """Rows (n_tokens, n_docs), one per length that occurs; a written table.

    Null and empty texts have length 0, repeated rows count each; an empty
    table has no rows.  Only ``text_col`` is read.
    """
    lengths = df.select(token_count(df, text_col, ranks_path).alias("n_tokens"))
    return materialize(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "token-lengths")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, for each length L taken as a context limit:

    ``docs_from`` and ``tokens_from``, documents of L tokens or more and their
    tokens; ``truncated_tokens``, the tokens of all documents cut to L;
    ``docs_upto``, documents of L tokens or fewer.  The sums run over blocks of
    lengths and then over blocks, so no task needs the whole histogram.
    """
    docs, tokens = total(histogram, F.coalesce(F.sum("n_docs"), F.lit(0)),
                         F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)))
    h = histogram.withColumns({"g": F.lit(0), "down": -F.col("n_tokens"), "own": F.col("n_docs") * F.col("n_tokens")})
    h = running_sum(h, ["g"], "down", {"n_docs": "docs_from", "own": "tokens_from"}, block=256)
    return h.select("n_tokens", "n_docs", "docs_from", "tokens_from",
                    (F.lit(tokens) - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from"))
                    .alias("truncated_tokens"),
                    (F.lit(docs) - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"))


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Rows (context_limit, docs_over, total_tokens) for any limits, read off the suffix sums.

    Of the lengths above a limit the smallest one's sums hold: its documents
    are all cut, and everything before it is what its own total leaves out.
    """
    tokens = total(sums, F.coalesce(F.max("tokens_from"), F.lit(0)))[0]
    above = sums.select(F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits])).alias("context_limit"), "*")
    first = (above.groupBy("context_limit").agg(F.min(F.when(
        F.col("n_tokens") > F.col("context_limit"), F.struct("n_tokens", "docs_from", "tokens_from"))).alias("x")))
    over, beyond = (F.coalesce(F.col(f"x.{c}"), F.lit(0)) for c in ("docs_from", "tokens_from"))
    return first.select("context_limit", over.alias("docs_over"),
                        (F.lit(tokens) - beyond + over * F.col("context_limit")).alias("total_tokens"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Rows (share, n_tokens): the smallest length that at least that share of documents does not exceed."""
    docs = total(sums, F.coalesce(F.max("docs_upto"), F.lit(0)))[0]
    cells = [F.min(F.when(F.col("docs_upto") >= F.lit(docs) * s, F.col("n_tokens"))).alias(f"q{i}")
             for i, s in enumerate(shares)]
    row = sums.agg(*cells)
    return row.select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens"))
                                         for i, s in enumerate(shares)])))
