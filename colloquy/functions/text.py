"""Row-local string Column functions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(col) -> Column:
    """Python ``str.strip()``: strip every Unicode whitespace at both ends."""
    w = C.STRIP_CLASS
    return F.regexp_replace(_c(col), f"^{w}+|{w}+$", "")


def strip_markers(col) -> Column:
    """Drop ``<...>`` tags, then the literal ``doctor：``, then strip."""
    s = F.regexp_replace(_c(col), "<[^>]+>", "")
    s = F.replace(s, F.lit(C.DOCTOR_COLON), F.lit(""))
    return trim_all(s)


def word_count(col) -> Column:
    return F.regexp_count(_c(col), F.lit(C.WORD_PATTERN))


def length_bucket(col) -> Column:
    """``count(words) // 5 + 1`` with Unicode words."""
    return (F.floor(word_count(col) / C.LENGTH_WORDS_PER_BUCKET) + 1).cast("bigint")


def system_prefix(col, eos: str = C.EOS) -> Column:
    """System marker + text + eos."""
    return F.concat(F.lit(C.SYSTEM), _c(col), F.lit(eos))


def extract_choices(col) -> Column:
    """Choice letters found in a reply, as ``array<string>``.

    A reply starting with A-D yields that letter.  Otherwise the first pattern
    (in the fixed order) with any match supplies all of its matches.  Blank
    replies yield an empty array.
    """
    s = _c(col)
    first = F.substring(s, 1, 1)
    # every pattern is evaluated once; the first non-empty match list wins
    # (Python's Unicode \s spelled out so every engine agrees)
    found = F.array(*[F.regexp_extract_all(s, F.lit(p.replace(r"\s", C.STRIP_CLASS)), F.lit(1))
                      for p in C.CHOICE_PATTERNS])
    first_hit = F.get(F.filter(found, lambda m: F.size(m) > 0), 0)
    return (F.when(s.isNull() | (F.length(s) == 0), F.array().cast("array<string>"))
            .when(first.isin(*C.CHOICES), F.array(first))
            .otherwise(F.coalesce(first_hit, F.array().cast("array<string>"))))


def extract_reply(col, prompt_length) -> Column:
    """Cut the prompt (by characters), stop at the first ``<|``, drop tags."""
    start = (F.lit(prompt_length) if isinstance(prompt_length, int) else _c(prompt_length)).cast("int") + 1
    rest = F.substring(_c(col), start, F.lit(2147483647))
    cut = F.substring_index(rest, "<|", 1)
    cut = F.regexp_replace(cut, "(?d)<.*?>", "")
    return F.regexp_replace(cut, "(?d).*?>", "")


def extract_reply_last(col, marker: str = C.DOCTOR) -> Column:
    """Text after the last doctor marker, stripped, tags removed."""
    s = trim_all(F.substring_index(_c(col), marker, -1))
    return F.regexp_replace(s, "(?d)<.*?>", "")


def extract_case_answer(col) -> Column:
    """Text after the last ``\\n答案：``, stripped."""
    return trim_all(F.substring_index(_c(col), C.ANSWER_CUE, -1))


def tokenize(col, pattern: str = C.TOKEN_PATTERN) -> Column:
    """Regex tokenizer: special markers whole, Unicode words, single symbols."""
    return F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(0))


def whitespace_tokens(col) -> Column:
    """Python ``str.split()`` on whitespace: no empty tokens."""
    t = trim_all(col)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(
        F.split(t, C.STRIP_CLASS + "+"))


def parse_judge_score(col, pattern: str = C.SCORE_PATTERN) -> Column:
    """Numeric score from a judge reply; blank reply scores 0, unparsed is null."""
    s = trim_all(col)
    v = F.regexp_extract(s, pattern, 1)
    return (F.when(F.length(s) == 0, F.lit(0.0))
            .otherwise(F.when(F.length(v) > 0, v.cast("double"))))
