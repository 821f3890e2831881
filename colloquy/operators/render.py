"""Rendering dialogues and exam rows into prompts.

Conversations are kept in long form ``(conv_id, turn, role, text)``.  Turn
positions are contiguous from 0 inside a conversation.  Everything that needs
a neighbouring turn groups it with its successor under the unique key
``(conv_id, turn)`` (one scan, one shuffle, no group larger than two rows),
and concatenation into one string per conversation is done in two levels
(fixed-size turn blocks first) so one very long conversation is spread over
many tasks before its final string is assembled.  A null text renders as an
empty one, with its marker and end; ``null_texts`` counts such turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.keyed import keyed_uniform
from ..functions.text import length_bucket, system_prefix

DEFAULT_ROLE_MARKERS = {
    "patient": C.PATIENT, "user": C.PATIENT, "prompter": C.PATIENT,
    "doctor": C.DOCTOR, "assistant": C.DOCTOR,
    "system": C.SYSTEM,
}


def role_marker(role: Column, role_map: dict | None = None, compat: bool = False) -> Column:
    """Marker for a role.  ``compat``: only ``patient`` is a patient, all else doctor."""
    if compat:
        return F.when(role == "patient", F.lit(C.PATIENT)).otherwise(F.lit(C.DOCTOR))
    m = role_map or DEFAULT_ROLE_MARKERS
    expr = None
    for k, v in m.items():
        expr = F.when(role == k, F.lit(v)) if expr is None else expr.when(role == k, F.lit(v))
    return expr.otherwise(F.lit(C.DOCTOR))


def _text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def null_texts(turns: DataFrame) -> DataFrame:
    """Conversations with turns that have no text: ``(conv_id, n)``."""
    return turns.filter(F.col("text").isNull()).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def render_turns(turns: DataFrame, eos: str = C.EOS, role_map: dict | None = None,
                 add_reply: bool = False, compat: bool = False) -> DataFrame:
    """One piece per turn: marker + text + eos; optional trailing doctor marker."""
    pieces = turns.select(
        "conv_id", "turn",
        F.concat(role_marker(F.col("role"), role_map, compat), _text(), F.lit(eos)).alias("piece"),
        F.lit(False).alias("is_reply"))
    if not add_reply:
        return pieces
    reply = (turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
             .select("conv_id", "turn", F.lit(C.DOCTOR).alias("piece"), F.lit(True).alias("is_reply")))
    return pieces.unionByName(reply)


def concat_pieces(pieces: DataFrame, group_cols: list[str], order_col: str, piece_col: str,
                  out: str = "text", sep: str = "", block: int = 1024) -> DataFrame:
    """Ordered string concatenation per group, in two levels.

    Level 1 concatenates fixed-size blocks of ``order_col`` (bounded groups);
    level 2 joins the block strings of each group in block order.
    """
    blk = F.floor(F.col(order_col) / block).cast("bigint").alias("_blk")
    lvl1 = (pieces.select(*group_cols, blk, F.struct(F.col(order_col).alias("o"), F.col(piece_col).alias("p")).alias("_s"))
            .groupBy(*group_cols, "_blk")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["p"]), sep).alias("_bs")))
    return (lvl1.groupBy(*group_cols)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_blk", "_bs"))),
                                          lambda s: s["_bs"]), sep).alias(out)))


def render_dialogue(turns: DataFrame, eos: str = C.EOS, add_reply: bool = False,
                    system_prefix_text: str | None = None, role_map: dict | None = None,
                    compat: bool = False) -> DataFrame:
    """``(conv_id, text)``: all pieces joined without separator, in turn order."""
    pieces = render_turns(turns, eos, role_map, add_reply, compat)
    out = concat_pieces(pieces, ["conv_id"], "turn", "piece", "text")
    if system_prefix_text is not None:
        out = out.withColumn("text", F.concat(system_prefix(F.lit(system_prefix_text), eos), "text"))
    return out


def holdout_last_turn(turns: DataFrame, require_target_role: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split each conversation into context (all but the last turn) and target.

    The last-turn table is a partial aggregate (one row per conversation), so a
    conversation with very many turns does not pile up before the shuffle.
    ``require_target_role`` keeps only conversations whose last turn has that
    role (the original does not check).
    """
    last = turns.groupBy("conv_id").agg(F.max_by("role", "turn").alias("_lrole"), F.max("turn").alias("_last"))
    if require_target_role is not None:
        last = last.filter(F.col("_lrole") == require_target_role)
    marked = turns.join(last.drop("_lrole"), "conv_id")
    context = marked.filter(F.col("turn") < F.col("_last")).drop("_last")
    target = marked.filter(F.col("turn") == F.col("_last")).drop("_last")
    return context, target


def dialogue_prompt(turns: DataFrame, instruction: str = C.DIALOGUE_INSTRUCTION, eos: str = C.EOS,
                    role_map: dict | None = None, compat: bool = False, block: int = 1024) -> DataFrame:
    """``(conv_id, prompt, prompt_length, target, target_role)``.

    prompt = instruction + rendered context + trailing doctor marker; the last
    turn (whatever its role) is the target; length counts code points.

    Two aggregations and no join: every turn is rendered and concatenated in
    two levels (turn blocks, then blocks); each level also keeps its last turn
    (``max_by``), and the last piece is cut off the end of the full string.
    """
    pieces = turns.select(
        "conv_id", "turn", F.floor(F.col("turn") / block).cast("bigint").alias("_blk"),
        F.concat(role_marker(F.col("role"), role_map, compat), _text(), F.lit(eos)).alias("piece"),
        "text", "role")
    last = F.struct(F.length("piece").alias("plen"), F.col("text").alias("text"), F.col("role").alias("role"))
    lvl1 = pieces.groupBy("conv_id", "_blk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), "")
        .alias("_bs"),
        F.max_by(last, F.col("turn")).alias("_last"))
    lvl2 = lvl1.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_blk", "_bs"))), lambda x: x["_bs"]), "")
        .alias("_all"),
        F.max_by("_last", F.col("_blk")).alias("_last"))
    ctx = F.substring(F.col("_all"), F.lit(1), F.length("_all") - F.col("_last.plen"))
    out = lvl2.select("conv_id", F.concat(F.lit(instruction), ctx, F.lit(C.DOCTOR)).alias("prompt"),
                      F.col("_last.text").alias("target"), F.col("_last.role").alias("target_role"))
    return out.select("conv_id", "prompt", F.length("prompt").cast("bigint").alias("prompt_length"),
                      "target", "target_role")


def _pd_str(c: Column) -> Column:
    # a missing CSV cell reads as NaN in the original and formats as 'nan'
    return F.coalesce(c.cast("string"), F.lit("nan"))


def choice_prompt(exam: DataFrame, choices=C.CHOICES, instruction: str = C.CHOICE_INSTRUCTION) -> DataFrame:
    """Adds ``prompt``: instruction + question + ``\\nA. ..`` ... + ``\\n答案：``."""
    parts = [F.lit(instruction), _pd_str(F.col("question"))]
    for ch in choices:
        parts += [F.lit(f"\n{ch}. "), _pd_str(F.col(ch))]
    parts.append(F.lit(C.ANSWER_CUE))
    return exam.withColumn("prompt", F.concat(*parts))


def case_prompt(cases: DataFrame, instruction: str = C.CASE_INSTRUCTION) -> DataFrame:
    """Adds ``prompt`` (instruction + background + question + cue) and ``target``."""
    return cases.withColumn("prompt", F.concat(F.lit(instruction), _pd_str(F.col("background")), F.lit("\n"),
                                               _pd_str(F.col("question")), F.lit(C.ANSWER_CUE))) \
                .withColumn("target", F.col("answer"))


def judge_prompt(pairs: DataFrame, template: str = C.DEFAULT_JUDGE_TEMPLATE) -> DataFrame:
    """Fill ``[Answer]`` then ``[Response]`` literally; wrap as one user message."""
    content = F.replace(F.replace(F.lit(template), F.lit("[Answer]"), F.col("target")),
                        F.lit("[Response]"), F.col("response"))
    return pairs.withColumn("content", content) \
                .withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("content").alias("content"))))


def _fmt_float(c: Column) -> Column:
    # one decimal, half-up on the decimal text
    return F.format_string("%.1f", c.cast("double"))


def system_tag(df: DataFrame, key_cols: list[str], text_col: str = "text", eos: str = C.EOS,
               enabled: bool = True, dropout: float = 0.0, add_length: bool = True,
               seed: int = C.SEED, float_props=("quality", "humor", "creativity"),
               string_props=("lang",), context_col: str | None = "context", out: str = "system_tag") -> DataFrame:
    """System tag built from a turn's properties.

    Present properties (and the length bucket) are shuffled by a keyed hash,
    the context (when non-empty) goes last, each is dropped with probability
    ``dropout`` (keyed), whitespace-only strings are skipped.
    """
    if not enabled:
        return df.withColumn(out, F.lit(""))
    cols = set(df.columns)
    items = []

    def item(name: str, value: Column, present: Column, order: Column, skip: Column):
        drop = keyed_uniform(seed, "drop:" + name, *key_cols) < F.lit(dropout)
        keep = present & ~skip & ~drop
        return F.struct(order.alias("o"), F.when(keep, F.concat(F.lit(name + ": "), value)).alias("f"))

    for name in string_props:
        if name in cols:
            v = F.col(name)
            items.append(item(name, v, v.isNotNull(), keyed_uniform(seed, "order:" + name, *key_cols),
                              (F.length(v) > 0) & (F.length(F.regexp_replace(v, C.STRIP_CLASS, "")) == 0)))
    for name in float_props:
        if name in cols:
            v = F.col(name)
            items.append(item(name, _fmt_float(v), v.isNotNull(), keyed_uniform(seed, "order:" + name, *key_cols),
                              F.lit(False)))
    if add_length:
        items.append(item("length", length_bucket(F.col(text_col)).cast("string"), F.lit(True),
                          keyed_uniform(seed, "order:length", *key_cols), F.lit(False)))
    if context_col and context_col in cols:
        v = F.col(context_col)
        items.append(item("context", v, v.isNotNull() & (F.length(v) > 0), F.lit(2.0),
                          F.length(F.regexp_replace(v, C.STRIP_CLASS, "")) == 0))
    if not items:
        return df.withColumn(out, F.lit(""))
    frags = F.filter(F.transform(F.array_sort(F.array(*items)), lambda s: s["f"]), lambda f: f.isNotNull())
    tag = F.when(F.size(frags) == 0, F.lit("")).otherwise(
        F.concat(F.lit(C.SYSTEM), F.array_join(frags, "\n"), F.lit("\n"), F.lit(eos)))
    return df.withColumn(out, tag)


def render_sft(typed: DataFrame, eos: str = C.EOS, use_system_tag: bool = False,
               dropout: float = C.SYSTEM_PROPERTY_DROPOUT, add_length: bool = False,
               seed: int = C.SEED) -> DataFrame:
    """Typed conversations → ``(conv_id, turn, piece, violation)``.

    Input: ``conv_id, turn, role ('prompter'|'assistant'), text`` plus optional
    ``lang, quality, humor, creativity, context`` and ``system_message``
    (repeated per row).  A prompter turn carries the system tag of the next
    turn; the system message goes before the first turn.  Where the next turn
    is not an assistant turn, ``violation`` is true (the original asserts).
    """
    prop_cols = [c for c in ("lang", "quality", "humor", "creativity", "context") if c in typed.columns]
    has_sm = "system_message" in typed.columns
    # the tag belongs to a turn's predecessor: it is built where the properties
    # are and only (key, role, tag) moves to the turn before it
    following = typed.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("_next_role"), "text",
                             *prop_cols)
    if use_system_tag:
        following = system_tag(following, ["conv_id", "turn"], "text", eos, True, dropout, add_length, seed)
    else:
        following = following.withColumn("system_tag", F.lit(""))
    flat = typed.select("conv_id", "turn", "role", _text().alias("_text"), *(["system_message"] if has_sm else [])).join(
        following.select("conv_id", "turn", "_next_role", "system_tag"), ["conv_id", "turn"], "left")
    is_p = F.col("role") == "prompter"
    has_next = F.col("_next_role").isNotNull()
    tag = F.when(is_p & has_next, F.col("system_tag")).otherwise(F.lit(""))
    p_piece = F.concat(F.lit(C.PATIENT), F.col("_text"), F.lit(eos), tag)
    if has_sm:
        sm = F.col("system_message")
        p_piece = F.when((F.col("turn") == 0) & sm.isNotNull() & (F.length(sm) > 0),
                         F.concat(F.lit(C.SYSTEM), sm, F.lit(eos), p_piece)).otherwise(p_piece)
    piece = F.when(is_p, p_piece).otherwise(F.concat(F.lit(C.DOCTOR), F.col("_text"), F.lit(eos)))
    violation = is_p & has_next & (F.col("_next_role") != "assistant")
    return flat.select("conv_id", "turn", piece.alias("piece"), violation.alias("violation"))


def zip_qa(questions: DataFrame, answers: DataFrame, context: Column | None = None) -> DataFrame:
    """Interleave questions and answers by ``(conv_id, idx)``; longest side wins.

    ``answers.text`` may be ``array<string>`` (first element is used).  A
    missing half is dropped (the original fails on it).
    """
    a_text = F.col("a.text")
    if dict(answers.dtypes).get("text", "").startswith("array"):
        a_text = F.get(a_text, 0)
    j = questions.alias("q").join(answers.alias("a"), ["conv_id", "idx"], "full_outer")
    ctx = context if context is not None else F.lit(None).cast("string")
    rows = F.array(
        F.struct((F.col("idx") * 2).alias("turn"), F.lit("prompter").alias("role"),
                 F.col("q.text").alias("text"), F.lit(None).cast("string").alias("context")),
        F.struct((F.col("idx") * 2 + 1).alias("turn"), F.lit("assistant").alias("role"),
                 a_text.alias("text"), ctx.alias("context")))
    out = j.select("conv_id", F.explode(rows).alias("r")).select("conv_id", "r.*")
    return out.filter(F.col("text").isNotNull())
