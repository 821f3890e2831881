"""Keyed randomness: every random choice is a hash of (seed, salt, key).

Results then do not depend on partitioning or retries, and the same value can
be computed in SQL:  ``cast(conv(substr(md5(k),1,8),16,10) as bigint)/2^32``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key_string(seed: int, salt: str, *keys) -> Column:
    parts = [F.lit(f"{seed}:{salt}")]
    for k in keys:
        parts.append(F.lit(":"))
        parts.append((F.col(k) if isinstance(k, str) else k).cast("string"))
    return F.concat(*parts)


def keyed_uniform(seed: int, salt: str, *keys) -> Column:
    """Uniform double in [0, 1) from the md5 of ``seed:salt:key1:key2..``."""
    h = F.substring(F.md5(_key_string(seed, salt, *keys)), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(4294967296.0)


def keyed_uniform_sql(seed: int, salt: str, *keys: str) -> str:
    """The same value as DuckDB SQL (used by the oracles)."""
    k = f"'{seed}:{salt}'" + "".join(f" || ':' || CAST({c} AS VARCHAR)" for c in keys)
    return f"(('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296.0)"
