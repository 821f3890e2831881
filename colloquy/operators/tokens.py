"""Tokens, vocabulary, masks and sequence cuts.

Sequences travel in long form ``(seq keys, pos, token)`` wherever their length
is not yet bounded, and are regrouped into arrays only after they have been cut
to ``max_length``.  Row-local array operators are plain Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.arrays import window_slice
from ..functions.keyed import keyed_uniform
from ..plans.numbering import dense_row_number, running_sum
from ..session import materialize


# ---------------------------------------------------------------- vocabulary

def _specials_df(spark: SparkSession, specials) -> DataFrame:
    # fixed, tiny table of reserved tokens (ids 0..k-1)
    return spark.createDataFrame([(t, i) for i, t in enumerate(specials)],
                                 "token string, token_id bigint")


def build_vocab(tokens: DataFrame, token_col: str = "tokens", specials=C.SPECIAL_TOKENS,
                min_count: int = 1, max_size: int | None = None) -> DataFrame:
    """``(token, token_id, count)``: reserved specials first, then corpus tokens
    by count (desc) and token (asc).

    Counting is a partial+final hash aggregate.  A ``max_size`` limit is a
    top-k (bounded by ``max_size``); without it ids come from
    ``dense_row_number``: one window when the vocabulary is checked to be small,
    else the distributed numbering (range-partitioned sort + offsets).
    """
    spark = tokens.sparkSession
    col = F.col(token_col)
    exploded = explode_values(tokens, col, [], "token") if dict(tokens.dtypes)[token_col].startswith("array") \
        else tokens.select(col.alias("token"))
    # counted once and written: the numbering and the reserved-token counts
    # both read this table instead of exploding the token stream twice
    counts = materialize(exploded.groupBy("token").agg(F.count(F.lit(1)).alias("count")), "token-counts")
    sp = F.broadcast(_specials_df(spark, specials))  # k rows, fixed
    corpus = counts.join(sp, "token", "left_anti").filter(F.col("count") >= min_count)
    k = len(specials)
    if max_size is not None:
        top = corpus.orderBy(F.desc("count"), F.asc("token")).limit(max_size)
        w = Window.orderBy(F.desc("count"), F.asc("token"))  # at most max_size rows
        numbered = top.withColumn("token_id", F.row_number().over(w) - 1 + k)
    else:
        numbered = dense_row_number(corpus, [F.desc("count"), F.asc("token")], "rn") \
            .withColumn("token_id", F.col("rn") - 1 + k).drop("rn")
    # map-side inner join picks the k reserved tokens out of the counts first
    seen = counts.join(sp, "token").select("token", "count")
    special_rows = sp.join(seen, "token", "left").select(
        "token", "token_id", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    vocab = special_rows.unionByName(numbered.select("token", F.col("token_id").cast("bigint"),
                                                      F.col("count").cast("bigint")))
    # the vocabulary is an artifact read many times (size checks, lookups,
    # joins): write it once
    return materialize(vocab, "vocab")


def add_special_tokens(vocab: DataFrame, tokens) -> DataFrame:
    """Union new tokens (deduplicated, ordered by token) with ids after max(id)."""
    spark = vocab.sparkSession
    max_id = vocab.agg(F.max("token_id")).first()[0]
    max_id = -1 if max_id is None else max_id
    new = (spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
           .join(vocab.select("token"), "token", "left_anti"))
    new = new.withColumn("token_id", (F.row_number().over(Window.orderBy("token")) + max_id).cast("bigint")) \
             .withColumn("count", F.lit(0).cast("bigint"))
    return vocab.unionByName(new)


def encode_long(long_tokens: DataFrame, vocab: DataFrame, token_col: str = "token",
                unk_id: int = C.SPECIAL_TOKENS.index(C.UNK)) -> DataFrame:
    """Add ``token_id`` to a long token table; unknown tokens get ``unk_id``.

    A plain join on the token: the optimizer broadcasts the vocabulary or
    shuffles both sides from its statistics, and AQE splits hot tokens.
    """
    v = vocab.select(F.col("token").alias(token_col), "token_id")
    return long_tokens.join(v, token_col, "left") \
        .withColumn("token_id", F.coalesce(F.col("token_id"), F.lit(unk_id).cast("bigint")))


def encode_array(df: DataFrame, array_col: str, vocab: DataFrame, out: str | None = None,
                 unk_id: int = C.SPECIAL_TOKENS.index(C.UNK)) -> DataFrame:
    """Token arrays → id arrays (``out``, default: replace ``array_col``).

    Null arrays stay null, empty ones empty; null and unknown tokens get
    ``unk_id``.  Rows need no key (see ``_by_distinct_array``).
    """
    return _by_distinct_array(df, array_col, out or array_col, "bigint",
                              lambda long: encode_long(long, vocab, "_v", unk_id).select("_a1", "_a2", "_pos", F.col("token_id").alias("_w")))


def decode_array(df: DataFrame, array_col: str, vocab: DataFrame, out: str | None = None) -> DataFrame:
    """Id arrays → token arrays; ids that the vocabulary lacks become null tokens."""
    return _by_distinct_array(df, array_col, out or array_col, "string",
                              lambda long: decode_long(long.withColumnRenamed("_v", "token_id"), vocab)
                              .select("_a1", "_a2", "_pos", F.col("token").alias("_w")))


def _by_distinct_array(df: DataFrame, array_col: str, out: str, kind: str, translate) -> DataFrame:
    """Translate the elements of an array column by a join in long form.

    Every distinct array is exploded, translated and regrouped once under a
    128-bit digest of its elements, and joined back on the digest, so equal
    rows, duplicate keys and null keys of ``df`` need no row number.
    """
    a = F.col(array_col)
    nulls = F.transform(a, lambda x: x.isNull())
    digest = {"_a1": F.xxhash64(F.lit(1), F.size(a), a, nulls), "_a2": F.xxhash64(nulls, a, F.lit(2), F.size(a))}
    keyed = df.withColumns(digest)
    arrays = keyed.filter(F.size(a) > 0).groupBy("_a1", "_a2").agg(F.first(a).alias("_arr"))
    done = regroup(translate(explode_positions(arrays, "_arr", ["_a1", "_a2"], "_pos", "_v")), ["_a1", "_a2"], "_pos",
                   ["_w"]).withColumnRenamed("_w", "_done")
    empty = F.when(a.isNotNull(), F.array().cast(f"array<{kind}>"))
    return keyed.join(done, ["_a1", "_a2"], "left").withColumn(out, F.coalesce("_done", empty)) \
        .select(*[c for c in df.columns if c != out], out)


def decode_long(long_ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``token`` to a long id table."""
    return long_ids.join(vocab.select("token_id", "token"), "token_id", "left")


def explode_positions(df: DataFrame, array_col, keys: list[str], pos: str = "pos",
                      value: str = "token") -> DataFrame:
    """Long form ``(keys, pos, value)`` of an array column or expression.

    The outer variant plus a null filter keeps Catalyst from inferring a
    ``size(expr) > 0`` filter that would evaluate the (regex) expression again.
    """
    col = F.col(array_col) if isinstance(array_col, str) else array_col
    return df.select(*keys, F.posexplode_outer(col).alias(pos, value)).filter(F.col(pos).isNotNull())


def explode_values(df: DataFrame, array_col, keys: list[str], value: str) -> DataFrame:
    """Long form ``(keys, value)``; elements must be non-null (see ``explode_positions``)."""
    col = F.col(array_col) if isinstance(array_col, str) else array_col
    return df.select(*keys, F.explode_outer(col).alias(value)).filter(F.col(value).isNotNull())


def regroup(long_df: DataFrame, keys: list[str], pos: str, value_cols: list[str]) -> DataFrame:
    """Long form back to parallel arrays ordered by ``pos``."""
    s = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_p"), *[F.col(c) for c in value_cols])))
    g = long_df.groupBy(*keys).agg(s.alias("_a"))
    return g.select(*keys, *[F.transform("_a", _field(c)).alias(c) for c in value_cols])


def _field(name: str):
    return lambda x: x[name]


# ---------------------------------------------------------------- masks

def message_index_long(long_df: DataFrame, keys: list[str], pos: str, is_marker: Column,
                       out: str = "msg_index") -> DataFrame:
    """Running count (from -1) of role-marker tokens per sequence (long form)."""
    d = long_df.withColumn("_m", is_marker.cast("bigint"))
    return running_sum(d, keys, pos, {"_m": "_cnt"}).withColumn(out, F.col("_cnt") - 1).drop("_m", "_cnt")


def message_index_array(ids: Column, markers: list) -> Column:
    """Array form for bounded sequences: index = markers seen so far - 1.

    Marker positions are found in one pass; each segment between markers is
    filled with its index, so the cost is O(len + markers) array work.
    """
    n = F.size(ids)
    mpos = F.filter(F.transform(ids, lambda x, i: F.when(x.isin(*markers), i).otherwise(F.lit(-1))),
                    lambda p: p >= 0)
    m = F.size(mpos)
    head = F.array_repeat(F.lit(-1), F.when(m > 0, F.get(mpos, 0)).otherwise(n))
    segs = F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))),
                       lambda k: F.array_repeat(k, F.coalesce(F.get(mpos, k + 1), n) - F.get(mpos, k)))
    return F.when(m == 0, head).otherwise(F.flatten(F.concat(F.array(head), segs)))


def label_mask(msg_index: Column, masking: bool = True, compat_prefix: bool = False) -> Column:
    """True on doctor turns (odd message index), last position forced False.

    Default: positions before the first marker are not trained on.
    ``compat_prefix`` keeps the original's ``-1 % 2 == 1`` behaviour.
    """
    if not masking:
        base = F.transform(msg_index, lambda x: F.lit(True))
    elif compat_prefix:
        base = F.transform(msg_index, lambda x: F.pmod(x, F.lit(2)) == 1)
    else:
        base = F.transform(msg_index, lambda x: (x >= 0) & (F.pmod(x, F.lit(2)) == 1))
    return F.when(F.size(base) == 0, base).otherwise(
        F.concat(F.slice(base, F.lit(1), F.size(base) - 1), F.array(F.lit(False))))


def lm_mask(ids: Column) -> Column:
    """Plain-text entries: every position is trained on."""
    return F.array_repeat(F.lit(True), F.size(ids))


# ---------------------------------------------------------------- cuts

def crop_offset(length: Column, max_length: int, p: float, seed: int, keys: list) -> Column:
    """Start of the kept window.

    With probability ``p`` (keyed) no head truncation happens and a sequence
    longer than ``max_length`` is cut at a uniform offset in
    ``[0, len - max_length]``; otherwise the head is kept.
    """
    u_mode = keyed_uniform(seed, "crop-mode", *keys)
    u_off = keyed_uniform(seed, "crop-offset", *keys)
    span = length - F.lit(max_length) + 1
    return F.when((u_mode < p) & (length > max_length), F.floor(u_off * span)).otherwise(F.lit(0)).cast("int")


def random_crop(df: DataFrame, array_cols: list[str], max_length: int, keys: list[str],
                p: float = C.RANDOM_OFFSET_PROBABILITY, seed: int = C.SEED) -> DataFrame:
    """Cut every parallel array of a row by the same keyed offset."""
    off = crop_offset(F.size(F.col(array_cols[0])), max_length, p, seed, keys)
    d = df.withColumn("crop_offset", off)
    for c in array_cols:
        d = d.withColumn(c, window_slice(F.col(c), F.col("crop_offset"), max_length))
    return d


def prepend_prefix(df: DataFrame, prefix_ids: list, ids: str = "input_ids",
                   attention: str = "attention_mask", mask: str = "label_mask",
                   max_length: int | None = None) -> DataFrame:
    """System prefix ids in front: attention 1, label mask False.

    With ``max_length`` the sequence keeps its first ``max_length`` minus
    prefix positions, so that the result is no longer than ``max_length``.
    """
    k = len(prefix_ids)

    def own(name: str) -> Column:
        return F.col(name) if max_length is None else F.slice(F.col(name), 1, max(0, max_length - k))
    d = df.withColumn(ids, F.concat(F.array(*[F.lit(i) for i in prefix_ids]), own(ids)))
    if attention in df.columns:
        d = d.withColumn(attention, F.concat(F.array_repeat(F.lit(1), k), own(attention)))
    if mask in df.columns:
        d = d.withColumn(mask, F.concat(F.array_repeat(F.lit(False), k), own(mask)))
    return d


def assemble_prompt_target(df: DataFrame, src: str, tgt: str, max_length: int, max_src_length: int,
                           gmask_id: int, sop_id: int, eop_id: int) -> DataFrame:
    """src tail + [gMASK, sop] + clipped tgt + [eop]; labels -100 over the context.

    ``context_length`` is the position of the first ``sop``; labels copy the ids
    from there on (unshifted).  ``violation`` replaces the original asserts.
    """
    s = F.col(src)
    s = F.when(F.size(s) > max_src_length, F.slice(s, -max_src_length, max_src_length)).otherwise(s)
    d = df.withColumn("_src", s)
    budget = F.lit(max_length) - F.size("_src") - 3
    t = F.col(tgt)
    t = F.when(F.size(t) > budget, F.when(budget > 0, F.slice(t, F.lit(1), F.greatest(budget, F.lit(1))))
               .otherwise(F.slice(t, 1, 0))).otherwise(t)
    ids = F.concat(F.col("_src"), F.array(F.lit(gmask_id), F.lit(sop_id)), t, F.array(F.lit(eop_id)))
    d = d.withColumn("input_ids", ids)
    ctx = (F.array_position("input_ids", sop_id) - 1).cast("int")
    d = d.withColumn("context_length", ctx)
    d = d.withColumn("labels", F.concat(F.array_repeat(F.lit(C.IGNORE_INDEX), F.col("context_length")),
                                        F.slice("input_ids", F.col("context_length") + 1, F.size("input_ids"))))
    d = d.withColumn("violation", (F.size("input_ids") != F.size("labels")) | (F.size("input_ids") > max_length))
    return d.drop("_src")


def apply_ignore_index(labels: Column, mask: Column) -> Column:
    """-100 where the mask is false (array form)."""
    return F.zip_with(labels, mask, lambda l, m: F.when(m, l).otherwise(F.lit(C.IGNORE_INDEX)))


def encoding_report(long_ids: DataFrame, vocab: DataFrame, keys: list[str], pos: str,
                    marker_ids: list[int]) -> DataFrame:
    """Per position: id, decoded token and message index."""
    d = decode_long(long_ids, vocab)
    return message_index_long(d, keys, pos, F.col("token_id").isin(*marker_ids))
