"""Row-local array Column functions (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _n(x) -> Column:
    return F.lit(x) if isinstance(x, int) else _c(x)


def truncate_head(col, n) -> Column:
    """Keep the first ``n`` elements."""
    return F.slice(_c(col), F.lit(1), _n(n))


def src_keep_tail(col, n) -> Column:
    """Keep the last ``n`` elements when longer than ``n``."""
    a = _c(col)
    return F.when(F.size(a) > _n(n), F.slice(a, -_n(n), _n(n))).otherwise(a)


def tgt_budget(col, budget) -> Column:
    """Clip to ``budget`` elements (a non-positive budget gives an empty array)."""
    a = _c(col)
    b = F.greatest(_n(budget), F.lit(0))
    return F.when(b == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, F.lit(1), b))


def shift_targets(col) -> Column:
    """Roll left by one with wrap-around: ``[1,2,3,0] -> [2,3,0,1]``."""
    a = _c(col)
    return F.when(F.size(a) <= 1, a).otherwise(
        F.concat(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, 1, 1)))


def argmax_index(col) -> Column:
    """0-based index of the largest element; first one on ties."""
    a = _c(col)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def window_slice(col, offset, length) -> Column:
    """``a[offset : offset+length]`` with a 0-based offset."""
    return F.slice(_c(col), _n(offset) + 1, _n(length))


def pad_right(col, target_len, value) -> Column:
    """Right-pad to ``target_len`` with ``value``."""
    a = _c(col)
    k = F.greatest(_n(target_len) - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(value).cast(a_type(value)), k))


def a_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "double"
    return "string"


def join_ints(col, sep: str = " ") -> Column:
    """Array to a space-joined string (stable form for hashing and oracles)."""
    return F.array_join(F.transform(_c(col), lambda x: x.cast("string")), sep)


def join_bools(col) -> Column:
    return F.array_join(F.transform(_c(col), lambda x: F.when(x, "1").otherwise("0")), "")


def logsumexp(col) -> Column:
    """Stable log-sum-exp of a numeric array in one pass (running max rescaling).

    Elements of -inf add nothing, also in front; all -inf gives -inf, NaN stays NaN.
    """
    none = float("-inf")
    init = F.struct(F.lit(none).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        x = x.cast("double")
        m2 = F.greatest(acc["m"], x)
        s = F.when(m2 == none, F.lit(0.0)).otherwise(acc["s"] * F.exp(acc["m"] - m2) + F.exp(x - m2))
        return F.struct(m2.alias("m"), s.alias("s"))

    return F.aggregate(_c(col), init, step,
                       lambda acc: F.when(acc["m"] == none, F.lit(none)).otherwise(acc["m"] + F.log(acc["s"])))
