"""Shared helpers of the training-data operators.

Words are maximal runs of characters other than ASCII white space; in UTF-8
bytes that is ``bytes.split()``, and ``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8 bytes (null: none)."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def count_words(text: Column) -> Column:
    """Number of words as a column expression (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def row_key(cols: Iterable, seed: int = 0) -> tuple[Column, Column]:
    """Two 64-bit digests of a row's columns, never null: the identity of a row.

    Rows equal in all ``cols`` share it and are treated alike, so a join on it
    has one row per key on the digest side and never multiplies rows.
    """
    cols = [F.col(f"`{c}`") if isinstance(c, str) else c for c in cols]
    marks = [c.isNull() for c in cols]
    return F.xxhash64(F.lit(seed), *cols, *marks), F.xxhash64(F.lit(seed + 1), *reversed(cols), *marks)


def unit_hash(*parts) -> Column:
    """Uniform double in [0, 1) keyed by ``parts`` (53 bits of their XXH64)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def packed(df: DataFrame, name: str = "rec") -> DataFrame:
    """All columns as one struct, so working columns cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], added: list[str], name: str = "rec") -> DataFrame:
    """Input columns again, then ``added``; an input column of an added name is replaced."""
    taken = {c.lower() for c in added}
    keep = [c for c in columns if c.lower() not in taken]
    return df.select(*[F.col(name)[c].alias(c) for c in keep], *added)


def once(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` evaluated once per row.

    Catalyst writes a projected expression into every place that refers to it,
    also into functions over array elements, where it would run per element;
    a generator of one element is a boundary that it does not cross.
    """
    names = [c for c in df.columns if c != column]
    return df.select(*[F.col(f"`{c}`") for c in names], F.explode(F.array(F.col(f"`{column}`"))).alias(column))


def total(df: DataFrame, *aggregates: Column) -> list:
    """One row of aggregates as a list (a fixed number of values, whatever the input)."""
    return list(df.agg(*aggregates).first())
