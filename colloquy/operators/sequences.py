"""Dialogue → training batches, end to end, in long form until cut.

1. render one piece per turn and tokenize each piece (row-local); callers
   write this table once;
2. piece start offsets and marker counts before each piece come from a
   blocked prefix sum per conversation over the narrow columns alone;
3. the crop window (head, or keyed random offset) is chosen from the total
   length (a partial aggregate); the turns that overlap it are joined back to
   their tokens and only tokens inside the window are exploded;
4. tokens are encoded by a vocabulary join, then regrouped into at most
   ``max_length`` ids per sequence;
5. masks, keyed shuffled batches, padding to a multiple and shifted targets.

No step holds a whole conversation in one task: the only per-conversation
groups left after step 3 are bounded by ``max_length``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.arrays import shift_targets
from ..functions.text import tokenize
from ..plans.numbering import running_sum
from .batches import assign_batches, batch_numbers, pack_short, pad_batch
from .render import dialogue_prompt, render_turns
from .tokens import (assemble_prompt_target, crop_offset, encode_array, encode_long, label_mask, prepend_prefix,
                     regroup)

MARKERS = (C.PATIENT, C.DOCTOR)


TURN_BLOCK = 4096  # turns per prefix-sum block


def piece_tokens(turns: DataFrame, eos: str = C.EOS) -> DataFrame:
    """``(conv_id, turn, blk, toks, n_tok, n_mark)`` for every rendered turn.

    ``blk`` = ``floor(turn / TURN_BLOCK)`` is the block of the prefix sums.
    """
    return tokenize_pieces(render_turns(turns, eos))


def tokenize_pieces(pieces: DataFrame) -> DataFrame:
    """The ``piece_tokens`` table of pieces that are rendered already (``render_turns``, ``render_sft``)."""
    t = pieces.select("conv_id", "turn", F.floor(F.col("turn") / TURN_BLOCK).cast("bigint").alias("blk"),
                      tokenize(F.col("piece")).alias("toks"))
    return t.withColumn("n_tok", F.size("toks").cast("bigint")) \
            .withColumn("n_mark", F.size(F.filter("toks", lambda x: x.isin(*MARKERS))).cast("bigint"))


def encode_dialogues(pieces: DataFrame, vocab: DataFrame, max_length: int = C.MAX_LENGTH,
                     p: float = C.RANDOM_OFFSET_PROBABILITY, seed: int = C.SEED,
                     compat_prefix: bool = False, batches: DataFrame | None = None) -> DataFrame:
    """``(conv_id, input_ids, attention_mask, label_mask, length, crop_offset)``.

    ``pieces`` is the ``piece_tokens`` table.  Tokenizing is the costly step
    and its output feeds the vocabulary, the offsets and the cut, so callers
    write it once (``session.materialize``) and pass the written copy.

    ``batches`` (``conv_id, batch_id, row_in_batch``) attaches batch numbers to
    the pieces that survive the cut; the cut tokens are then shuffled once by
    ``batch_id`` and regrouped inside their batch partition, so the padding
    window that follows needs no further shuffle.
    """
    narrow = pieces.select("conv_id", "turn", "blk", "n_tok", "n_mark")
    pt = running_sum(narrow, ["conv_id"], "turn", {"n_tok": "start", "n_mark": "mark_before"}, inclusive=False,
                     totals_out="total", block=TURN_BLOCK, block_col="blk")
    pt = pt.withColumn("crop_offset", crop_offset(F.col("total"), max_length, p, seed, ["conv_id"]))
    hi = F.col("crop_offset") + max_length
    pt = pt.filter((F.col("start") + F.col("n_tok") > F.col("crop_offset")) & (F.col("start") < hi))
    extra = []
    if batches is not None:
        # only pieces overlapping the cut carry the batch numbers along
        pt = pt.join(batches.select("conv_id", "batch_id", "row_in_batch"), "conv_id")
        extra = ["batch_id", "row_in_batch"]
    # the token arrays meet only the turns that survived
    pt = pt.join(pieces.select("conv_id", "turn", "toks"), ["conv_id", "turn"])
    # marker positions inside a piece (usually just position 0)
    pt = pt.withColumn("mpos", F.filter(F.sequence(F.lit(0), F.greatest(F.col("n_tok") - 1, F.lit(0)).cast("int")),
                                        lambda i: F.coalesce(F.get(F.col("toks"), i).isin(*MARKERS), F.lit(False))))
    long = pt.select("conv_id", *extra, "start", "mark_before", "crop_offset", "mpos",
                     F.posexplode("toks").alias("pos", "token"))
    long = long.withColumn("gpos", F.col("start") + F.col("pos")) \
               .filter((F.col("gpos") >= F.col("crop_offset")) & (F.col("gpos") < F.col("crop_offset") + max_length))
    long = long.withColumn("msg_index", (F.col("mark_before") + F.size(F.filter("mpos", lambda q: q <= F.col("pos"))) - 1)
                           .cast("int"))
    enc = encode_long(long.select("conv_id", *extra, "gpos", "token", "msg_index", "crop_offset"), vocab)
    enc = enc.withColumn("token_id", F.col("token_id").cast("int"))
    if batches is not None:
        enc = enc.repartition("batch_id")  # a batch holds at most batch_size x max_length tokens
    # crop_offset (and the batch numbers) are fixed per conversation, so they ride along as group keys
    seq = regroup(enc, [*extra, "conv_id", "crop_offset"], "gpos", ["token_id", "msg_index"])
    return seq.select(
        *extra, "conv_id", F.col("token_id").alias("input_ids"),
        F.array_repeat(F.lit(1), F.size("token_id")).alias("attention_mask"),
        label_mask(F.col("msg_index"), True, compat_prefix).alias("label_mask"),
        F.size("token_id").alias("length"), "crop_offset")


def dialogue_batches(pieces: DataFrame, vocab: DataFrame, max_length: int = C.MAX_LENGTH,
                     batch_size: int = 8, pad_multiple: int = C.PAD_MULTIPLE, pad_id: int = 0,
                     seed: int = C.SEED, p: float = C.RANDOM_OFFSET_PROBABILITY,
                     prefix_ids: list[int] | None = None, pack: bool = False) -> DataFrame:
    """Padded, shuffled batches with next-token targets (wrap-around roll).

    ``pack`` joins pairs of short sequences of a batch (``pack_short``; a packed
    row has no ``conv_id`` of its own); ``prefix_ids`` go in front of every
    sequence, which is cut that much shorter.  ``pieces`` may be rendered by
    ``render_turns`` or ``render_sft`` (``tokenize_pieces``).
    """
    # every conversation yields one sequence, so batches are numbered from the
    # (already written) piece table's keys, before the chain runs
    keys = pieces.select("conv_id").distinct()
    numbers = batch_numbers(keys, ["conv_id"], batch_size, seed)
    own_length = max_length - len(prefix_ids or [])
    b = encode_dialogues(pieces, vocab, own_length, p, seed, batches=numbers)
    if pack:
        b = pack_short(b, "batch_id", "row_in_batch", ["input_ids", "attention_mask", "label_mask"], ["conv_id"],
                       own_length, seed=seed)
    if prefix_ids:
        b = prepend_prefix(b, list(prefix_ids))
    b = pad_batch(b, "batch_id", {"input_ids": pad_id, "attention_mask": 0, "label_mask": False}, pad_multiple)
    return b.withColumn("targets", shift_targets(F.col("input_ids")))


def piece_positions(pieces: DataFrame) -> DataFrame:
    """Long form ``(conv_id, pos, token, msg_index)`` of whole conversations.

    Positions and message indexes are a turn's prefix sums plus what the turn
    itself counts, so no row or task holds a whole conversation.
    """
    narrow = pieces.select("conv_id", "turn", "blk", "n_tok", "n_mark")
    sums = running_sum(narrow, ["conv_id"], "turn", {"n_tok": "start", "n_mark": "mark_before"}, inclusive=False,
                       block=TURN_BLOCK, block_col="blk")
    t = sums.select("conv_id", "turn", "start", "mark_before").join(pieces.select("conv_id", "turn", "toks"),
                                                                    ["conv_id", "turn"])
    marks = F.filter(F.transform("toks", lambda x, i: F.when(x.isin(*MARKERS), i)), lambda i: i.isNotNull())
    long = t.withColumn("mpos", marks).select("conv_id", "start", "mark_before", "mpos",
                                              F.posexplode("toks").alias("at", "token"))
    # a name other than `pos`: inside a lambda it would mean the new column
    seen = F.size(F.filter("mpos", lambda q: q <= F.col("at")))
    return long.select("conv_id", (F.col("start") + F.col("at")).alias("pos"), "token",
                       (F.col("mark_before") + seen - 1).cast("int").alias("msg_index"))


def prompt_target_tokens(turns: DataFrame, prefix_text: str = C.SYSTEM_PREFIX_TEXT, eos: str = C.EOS) -> DataFrame:
    """``(conv_id, src, tgt)``: tokens of the system prefix, the context and the reply marker, and of the last turn."""
    d = dialogue_prompt(turns, instruction=f"{C.SYSTEM}{prefix_text}{eos}", eos=eos)
    return d.select("conv_id", tokenize(F.col("prompt")).alias("src"),
                    tokenize(F.coalesce("target", F.lit(""))).alias("tgt"))


def prompt_target_ids(turns: DataFrame, vocab: DataFrame, prefix_text: str = C.SYSTEM_PREFIX_TEXT) -> DataFrame:
    """``prompt_target_tokens`` encoded with a vocabulary."""
    s = prompt_target_tokens(turns, prefix_text)
    for side in ("src", "tgt"):
        s = encode_array(s, side, vocab).withColumn(side, F.transform(side, lambda x: x.cast("int")))
    return s


def prompt_target_batches(turns: DataFrame, vocab: DataFrame, max_length: int = C.MAX_LENGTH,
                          max_src_length: int = C.MAX_LENGTH - C.TARGET_RESERVE, batch_size: int = 8, pad_id: int = 0,
                          pad_multiple: int = 1, seed: int = C.SEED, specials=C.SPECIAL_TOKENS) -> DataFrame:
    """The prompt/target chain: encode, assemble, batch and pad.

    ``(conv_id, batch_id, row_in_batch, input_ids, labels, label_mask)``; labels
    are -100 over the context and the padding, the mask is true elsewhere.
    """
    ids = {t: i for i, t in enumerate(specials)}
    a = assemble_prompt_target(prompt_target_ids(turns, vocab), "src", "tgt", max_length, max_src_length,
                               ids[C.GMASK], ids[C.SOP], ids[C.EOP]).select("conv_id", "input_ids", "labels")
    b = assign_batches(a, ["conv_id"], batch_size, seed, keys=turns.select("conv_id").distinct())
    p = pad_batch(b, "batch_id", {"input_ids": pad_id, "labels": C.IGNORE_INDEX}, pad_multiple)
    return p.withColumn("label_mask", F.transform("labels", lambda x: x != C.IGNORE_INDEX))
