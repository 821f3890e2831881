"""SQL text fragments for the DuckDB oracles (same rules as the Spark side)."""

from __future__ import annotations

from .. import constants as C
from ..functions.keyed import keyed_uniform_sql


def lit(s: str) -> str:
    """A SQL string literal; newlines become ``chr(10)``."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def tok(x: str) -> str:
    return f"regexp_extract_all({x}, '{C.TOKEN_PATTERN}', 0)"


def trim_all(x: str) -> str:
    w = C.STRIP_CLASS
    return f"regexp_replace({x}, '^{w}+|{w}+$', '', 'g')"


def strip_markers(x: str) -> str:
    return trim_all(f"replace(regexp_replace({x}, '<[^>]+>', '', 'g'), {lit(C.DOCTOR_COLON)}, '')")


def marker(role: str) -> str:
    return (f"(CASE WHEN {role} IN ('patient','user','prompter') THEN '{C.PATIENT}' "
            f"WHEN {role} = 'system' THEN '{C.SYSTEM}' ELSE '{C.DOCTOR}' END)")


def keyed(seed: int, salt: str, *cols: str) -> str:
    return keyed_uniform_sql(seed, salt, *cols)


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{C.WORD_PATTERN}', 0))"


def length_bucket(x: str) -> str:
    return f"CAST(floor({words(x)} / {C.LENGTH_WORDS_PER_BUCKET}) + 1 AS BIGINT)"


def portable_pattern(p: str) -> str:
    """Answer patterns with Python's Unicode ``\\s`` spelled out for both engines."""
    return p.replace(r"\s", C.STRIP_CLASS)


def extract_choices(s: str) -> str:
    alts = ", ".join(
        f"CASE WHEN len(regexp_extract_all({s}, {lit(portable_pattern(p))}, 1)) > 0 "
        f"THEN regexp_extract_all({s}, {lit(portable_pattern(p))}, 1) END"
        for p in C.CHOICE_PATTERNS)
    return (f"(CASE WHEN {s} IS NULL OR length({s}) = 0 THEN CAST([] AS VARCHAR[]) "
            f"WHEN substr({s}, 1, 1) IN ('A','B','C','D') THEN [substr({s}, 1, 1)] "
            f"ELSE coalesce({alts}, CAST([] AS VARCHAR[])) END)")


def join_list(x: str, sep: str = " ") -> str:
    return f"array_to_string(list_transform({x}, lambda v: CAST(v AS VARCHAR)), '{sep}')"


SPECIALS_VALUES = ", ".join(f"('{t}', {i})" for i, t in enumerate(C.SPECIAL_TOKENS))
