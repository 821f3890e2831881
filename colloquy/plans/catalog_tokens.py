"""Registered queries: tokens, vocabulary, masks, cuts, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import arrays as AR
from ..functions.text import system_prefix, tokenize
from ..operators import batches as B
from ..operators import render as R
from ..operators import sequences as S
from ..operators import subwords as SW
from ..operators import tokens as TK
from . import fixtures as FX
from . import sqlx
from ..session import materialize
from .registry import register, table

MARKERS = (C.PATIENT, C.DOCTOR)
MARKERS_SQL = f"('{C.PATIENT}', '{C.DOCTOR}')"
TOK_PIECE = sqlx.tok(f"{sqlx.marker('role')} || text || '{C.EOS}'")

VOCAB_SQL = (
    f"vt AS (SELECT unnest({TOK_PIECE}) AS token FROM conversations), "
    "vc AS (SELECT token, count(*) AS cnt FROM vt GROUP BY token), "
    f"sp AS (SELECT * FROM (VALUES {sqlx.SPECIALS_VALUES}) t(token, token_id)), "
    "vocab AS (SELECT sp.token, CAST(sp.token_id AS BIGINT) AS token_id, CAST(coalesce(vc.cnt, 0) AS BIGINT) AS count "
    "FROM sp LEFT JOIN vc USING (token) UNION ALL "
    f"SELECT token, CAST({len(C.SPECIAL_TOKENS)} + row_number() OVER (ORDER BY cnt DESC, token) - 1 AS BIGINT), "
    "CAST(cnt AS BIGINT) FROM vc WHERE token NOT IN (SELECT token FROM sp))")

_DIALOGUE_TEXT = f"string_agg({sqlx.marker('role')} || text || '{C.EOS}', '' ORDER BY turn)"
DT_SQL = f"dt0 AS (SELECT conv_id, {sqlx.tok(_DIALOGUE_TEXT)} AS tokens FROM conversations GROUP BY conv_id)"

# token level view of the dialogue sequence: position and message index
DTL_SQL = (DT_SQL + ", dtl AS (SELECT conv_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM dt0), "
           f"dtm AS (SELECT conv_id, pos, token, CAST(sum(CASE WHEN token IN {MARKERS_SQL} THEN 1 ELSE 0 END) OVER "
           "(PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS msg FROM dtl), "
           "dtv AS (SELECT conv_id, list(msg ORDER BY pos) AS msg FROM dtm GROUP BY conv_id)")


def _vocab(spark, sf):
    pieces = R.render_turns(FX.conversations(spark, sf))
    return TK.build_vocab(pieces.select(tokenize(F.col("piece")).alias("tokens")), "tokens")


def _conv_keys(spark, sf):
    """Conversation ids (one sequence each): a cheap key table for batch numbering."""
    return FX.conversations(spark, sf).select("conv_id").distinct()


def _dialogue_tokens(spark, sf):
    d = R.render_dialogue(FX.conversations(spark, sf))
    return d.select("conv_id", tokenize(F.col("text")).alias("tokens"))


@register("tokenize", f"SELECT conv_id, turn, CAST(len({sqlx.tok('text')}) AS BIGINT) AS n_tokens, "
          f"md5(array_to_string({sqlx.tok('text')}, ' ')) AS tokens_md5 FROM conversations")
def q_tokenize(spark, sf):
    c = FX.conversations(spark, sf).select("conv_id", "turn", tokenize(F.col("text")).alias("t"))
    return c.select("conv_id", "turn", F.size("t").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@register("build_vocab", "WITH " + VOCAB_SQL + " SELECT token, token_id, count FROM vocab")
def q_build_vocab(spark, sf):
    return _vocab(spark, sf)


def _turn_tokens(spark, sf):
    return FX.conversations(spark, sf).select("conv_id", "turn", tokenize(F.col("text")).alias("toks"))


@register("learn_merges")
def q_learn_merges(spark, sf):
    """Byte-pair merges learned from the words of all turns (the greedy choice has no SQL form)."""
    return SW.learn_merges(SW.word_counts(_turn_tokens(spark, sf), "toks"), 96)


@register("encode_merges", f"SELECT conv_id, turn, md5(array_to_string({sqlx.tok('text')}, ' ')) AS tokens_md5 FROM conversations")
def q_encode_merges(spark, sf):
    """Every turn cut into learned sub-words and spelled again."""
    turns = materialize(_turn_tokens(spark, sf), "merge-turns")
    merges = SW.learn_merges(SW.word_counts(turns, "toks"), 48)
    pieces = SW.encode_merges(turns, "toks", merges).select("conv_id", "turn", SW.decode_merges(F.col("pieces")).alias("t"))
    return pieces.select("conv_id", "turn", F.md5(F.array_join("t", " ")).alias("tokens_md5"))


NEW_SPECIALS = ("<|context|>", C.PATIENT, "<|tool|>")


@register("add_special_tokens", "WITH " + VOCAB_SQL + ", nt AS (SELECT * FROM (VALUES "
          + ", ".join(f"('{t}')" for t in sorted(set(NEW_SPECIALS))) + ") t(token) WHERE token NOT IN "
          "(SELECT token FROM vocab)) SELECT token, token_id, count FROM vocab UNION ALL SELECT token, "
          "CAST((SELECT max(token_id) FROM vocab) + row_number() OVER (ORDER BY token) AS BIGINT), CAST(0 AS BIGINT) "
          "FROM nt")
def q_add_special_tokens(spark, sf):
    return TK.add_special_tokens(_vocab(spark, sf), NEW_SPECIALS)


ENC_SQL = (VOCAB_SQL + f", pt AS (SELECT conv_id, turn, {TOK_PIECE} AS toks FROM conversations), "
           "ptl AS (SELECT conv_id, turn, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM pt), "
           "pte AS (SELECT p.conv_id, p.turn, p.pos, p.token, coalesce(v.token_id, 2) AS token_id FROM ptl p "
           "LEFT JOIN vocab v USING (token))")


@register("encode_tokens", "WITH " + ENC_SQL + " SELECT conv_id, turn, string_agg(CAST(token_id AS VARCHAR), ' ' "
          "ORDER BY pos) AS ids FROM pte GROUP BY conv_id, turn")
def q_encode_tokens(spark, sf):
    """Per-turn token arrays encoded with the corpus vocabulary (a join on distinct arrays)."""
    pieces = materialize(S.piece_tokens(FX.conversations(spark, sf)))
    vocab = TK.build_vocab(pieces, "toks")
    enc = TK.encode_array(pieces.select("conv_id", "turn", "toks"), "toks", vocab, "ids")
    return enc.select("conv_id", "turn", AR.join_ints("ids").alias("ids"))


@register("decode_tokens", "SELECT conv_id, turn, array_to_string(" + TOK_PIECE + ", ' ') AS text FROM conversations")
def q_decode_tokens(spark, sf):
    """Encode every turn's tokens, then decode the ids back (round trip through the vocabulary)."""
    pieces = materialize(S.piece_tokens(FX.conversations(spark, sf)))
    vocab = TK.build_vocab(pieces, "toks")
    keys = ["conv_id", "turn"]
    enc = TK.encode_array(pieces.select(*keys, "toks"), "toks", vocab, "ids")
    dec = TK.decode_array(enc.select(*keys, "ids"), "ids", vocab, "tokens")
    return dec.select(*keys, F.array_join("tokens", " ").alias("text"))


@register("truncate_head", "WITH " + DT_SQL + " SELECT conv_id, array_to_string(tokens[1:64], ' ') AS tokens FROM dt0")
def q_truncate_head(spark, sf):
    d = _dialogue_tokens(spark, sf)
    return d.select("conv_id", F.array_join(AR.truncate_head("tokens", 64), " ").alias("tokens"))


@register("src_keep_tail", "WITH " + DT_SQL + " SELECT conv_id, array_to_string(CASE WHEN len(tokens) > 64 THEN "
          "list_slice(tokens, len(tokens) - 63, len(tokens)) ELSE tokens END, ' ') AS tokens FROM dt0")
def q_src_keep_tail(spark, sf):
    d = _dialogue_tokens(spark, sf)
    return d.select("conv_id", F.array_join(AR.src_keep_tail("tokens", 64), " ").alias("tokens"))


@register("shift_targets", "WITH " + DT_SQL + " SELECT conv_id, array_to_string(CASE WHEN len(tokens) <= 1 THEN tokens "
          "ELSE list_concat(tokens[2:], tokens[1:1]) END, ' ') AS tokens FROM dt0")
def q_shift_targets(spark, sf):
    d = _dialogue_tokens(spark, sf)
    return d.select("conv_id", F.array_join(AR.shift_targets("tokens"), " ").alias("tokens"))


@register("message_index", "WITH " + DTL_SQL + " SELECT conv_id, CAST(pos AS BIGINT) AS pos, token, msg AS msg_index "
          "FROM dtm")
def q_message_index(spark, sf):
    m = S.piece_positions(materialize(S.piece_tokens(FX.conversations(spark, sf))))
    return m.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "token",
                    F.col("msg_index").cast("int").alias("msg_index"))


def _mask_sql(compat: bool) -> str:
    cond = "((x % 2) + 2) % 2 = 1" if compat else "x >= 0 AND x % 2 = 1"
    return (f"array_to_string(list_transform(msg, lambda x, i: CASE WHEN i = len(msg) THEN '0' WHEN {cond} "
            "THEN '1' ELSE '0' END), '')")


@register("label_mask", "WITH " + DTL_SQL + f" SELECT conv_id, {_mask_sql(False)} AS label_mask, "
          f"{_mask_sql(True)} AS label_mask_compat FROM dtv")
def q_label_mask(spark, sf):
    d = _dialogue_tokens(spark, sf).withColumn("msg", TK.message_index_array(F.col("tokens"), list(MARKERS)))
    return d.select("conv_id", AR.join_bools(TK.label_mask(F.col("msg"))).alias("label_mask"),
                    AR.join_bools(TK.label_mask(F.col("msg"), compat_prefix=True)).alias("label_mask_compat"))


@register("random_crop", "WITH " + DTL_SQL + ", c AS (SELECT d.conv_id, d.tokens, v.msg, CAST(CASE WHEN "
          f"{sqlx.keyed(C.SEED, 'crop-mode', 'd.conv_id')} < 0.5 AND len(d.tokens) > 64 THEN "
          f"floor({sqlx.keyed(C.SEED, 'crop-offset', 'd.conv_id')} * (len(d.tokens) - 64 + 1)) ELSE 0 END AS INTEGER) "
          "AS off FROM dt0 d JOIN dtv v USING (conv_id)) SELECT conv_id, off AS crop_offset, "
          "array_to_string(list_slice(tokens, off + 1, off + 64), ' ') AS tokens, "
          f"{sqlx.join_list('list_slice(msg, off + 1, off + 64)')} AS msg_index FROM c")
def q_random_crop(spark, sf):
    d = _dialogue_tokens(spark, sf).withColumn("msg", TK.message_index_array(F.col("tokens"), list(MARKERS)))
    c = TK.random_crop(d, ["tokens", "msg"], 64, ["conv_id"])
    return c.select("conv_id", "crop_offset", F.array_join("tokens", " ").alias("tokens"),
                    AR.join_ints("msg").alias("msg_index"))


@register("lm_mask", f"SELECT doc_id, CAST(len({sqlx.tok('text')}) AS BIGINT) AS n_tokens, "
          f"CAST(len({sqlx.tok('text')}) AS BIGINT) AS n_trained FROM documents")
def q_lm_mask(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    m = d.withColumn("m", TK.lm_mask(F.col("t")))
    return m.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                    F.size(F.filter("m", lambda x: x)).cast("bigint").alias("n_trained"))


PREFIX_TOKENS_SQL = sqlx.tok(f"'{C.SYSTEM}' || {sqlx.lit(C.SYSTEM_PREFIX_TEXT)} || '{C.EOS}'")


@register("prepend_prefix", "WITH " + DTL_SQL + f", pf AS (SELECT {PREFIX_TOKENS_SQL} AS p) SELECT d.conv_id, "
          "array_to_string(list_concat(pf.p, d.tokens[:192 - len(pf.p)]), ' ') AS tokens, "
          "repeat('0', len(pf.p)) || substr(" + _mask_sql(False) + ", 1, 192 - len(pf.p)) AS label_mask, "
          "CAST(len(pf.p) + least(len(d.tokens), 192 - len(pf.p)) AS BIGINT) AS attended "
          "FROM dt0 d JOIN dtv USING (conv_id), pf")
def q_prepend_prefix(spark, sf):
    pref = spark.range(1).select(tokenize(system_prefix(F.lit(C.SYSTEM_PREFIX_TEXT))).alias("p")).first()["p"]
    d = _dialogue_tokens(spark, sf).withColumn("msg", TK.message_index_array(F.col("tokens"), list(MARKERS)))
    d = d.select("conv_id", F.col("tokens").alias("input_ids"),
                 F.array_repeat(F.lit(1), F.size("tokens")).alias("attention_mask"),
                 TK.label_mask(F.col("msg")).alias("label_mask"))
    p = TK.prepend_prefix(d, list(pref), max_length=192)
    return p.select("conv_id", F.array_join("input_ids", " ").alias("tokens"),
                    AR.join_bools("label_mask").alias("label_mask"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("attended"))


# -------- prompt / target assembly (ids) -------------------------------------

PT_MAX, PT_SRC = 128, 96
IDS = {t: i for i, t in enumerate(C.SPECIAL_TOKENS)}

def _encode_array(df, col, vocab, keys):
    enc = TK.encode_array(df, col, vocab)
    return enc.withColumn(col, F.transform(col, lambda x: x.cast("int")))


def _prompt_target_ids(spark, sf):
    return S.prompt_target_ids(FX.conversations(spark, sf), _vocab(spark, sf))


_PT_SRC_TEXT = (f"'{C.SYSTEM}' || {sqlx.lit(C.SYSTEM_PREFIX_TEXT)} || '{C.EOS}' || coalesce(ctx.ctx, '') "
                 f"|| '{C.DOCTOR}'")
PT_SRC_SQL = (
    VOCAB_SQL + ", lastt AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), "
    f"ctx AS (SELECT c.conv_id, string_agg({sqlx.marker('c.role')} || c.text || '{C.EOS}', '' ORDER BY c.turn) AS ctx "
    "FROM conversations c JOIN lastt l USING (conv_id) WHERE c.turn < l.last GROUP BY c.conv_id), "
    "tgt AS (SELECT c.conv_id, c.text AS target FROM conversations c JOIN lastt l USING (conv_id) "
    "WHERE c.turn = l.last), "
    f"gs AS (SELECT t.conv_id, {sqlx.tok(_PT_SRC_TEXT)} AS src, "
    f"{sqlx.tok('t.target')} AS tgt FROM tgt t LEFT JOIN ctx USING (conv_id)), "
    "gsl AS (SELECT conv_id, 's' AS side, unnest(src) AS token, unnest(range(len(src))) AS pos FROM gs UNION ALL "
    "SELECT conv_id, 't', unnest(tgt), unnest(range(len(tgt))) FROM gs), "
    "gse AS (SELECT g.conv_id, g.side, g.pos, coalesce(v.token_id, 2) AS id FROM gsl g LEFT JOIN vocab v USING (token)), "
    "gids AS (SELECT gs.conv_id, coalesce((SELECT list(id ORDER BY pos) FROM gse WHERE gse.conv_id = gs.conv_id AND "
    "side = 's'), []) AS src, coalesce((SELECT list(id ORDER BY pos) FROM gse WHERE gse.conv_id = gs.conv_id AND "
    "side = 't'), []) AS tgt FROM gs)")


@register("tgt_budget",
          "WITH " + PT_SRC_SQL + f", st AS (SELECT conv_id, CASE WHEN len(src) > {PT_SRC} THEN "
          f"list_slice(src, len(src) - {PT_SRC - 1}, len(src)) ELSE src END AS src, tgt FROM gids) "
          f"SELECT conv_id, {sqlx.join_list(f'CASE WHEN len(tgt) > {PT_MAX} - len(src) - 3 THEN list_slice(tgt, 1, {PT_MAX} - len(src) - 3) ELSE tgt END')} "
          "AS tgt FROM st")
def q_tgt_budget(spark, sf):
    s = _prompt_target_ids(spark, sf).withColumn("src", AR.src_keep_tail("src", PT_SRC))
    budget = F.lit(PT_MAX) - F.size("src") - 3
    return s.select("conv_id", AR.join_ints(AR.tgt_budget("tgt", budget)).alias("tgt"))


ASM_SQL = (PT_SRC_SQL + f", st AS (SELECT conv_id, CASE WHEN len(src) > {PT_SRC} THEN "
           f"list_slice(src, len(src) - {PT_SRC - 1}, len(src)) ELSE src END AS src, tgt FROM gids), "
           f"st2 AS (SELECT conv_id, src, CASE WHEN len(tgt) > {PT_MAX} - len(src) - 3 THEN "
           f"list_slice(tgt, 1, {PT_MAX} - len(src) - 3) ELSE tgt END AS tgt FROM st), "
           f"asm AS (SELECT conv_id, list_concat(src, [{IDS[C.GMASK]}, {IDS[C.SOP]}], tgt, [{IDS[C.EOP]}]) AS ids "
           "FROM st2), asm2 AS (SELECT conv_id, ids, CAST(list_position(ids, "
           f"{IDS[C.SOP]}) - 1 AS INTEGER) AS ctxlen FROM asm), asm3 AS (SELECT conv_id, ids, ctxlen, "
           "list_concat(list_transform(range(ctxlen), lambda x: -100), list_slice(ids, ctxlen + 1, len(ids))) AS labels "
           "FROM asm2)")


def _assembled(spark, sf):
    s = _prompt_target_ids(spark, sf)
    return TK.assemble_prompt_target(s, "src", "tgt", PT_MAX, PT_SRC, IDS[C.GMASK], IDS[C.SOP], IDS[C.EOP])


@register("assemble_prompt_target", "WITH " + ASM_SQL + f" SELECT conv_id, {sqlx.join_list('ids')} AS input_ids, "
          f"{sqlx.join_list('labels')} AS labels, ctxlen AS context_length, "
          f"(len(ids) <> len(labels) OR len(ids) > {PT_MAX}) AS violation FROM asm3")
def q_assemble_prompt_target(spark, sf):
    a = _assembled(spark, sf)
    return a.select("conv_id", AR.join_ints("input_ids").alias("input_ids"), AR.join_ints("labels").alias("labels"),
                    "context_length", "violation")


@register("src_keep_tail_ids", "WITH " + PT_SRC_SQL + f" SELECT conv_id, {sqlx.join_list(f'CASE WHEN len(src) > {PT_SRC} THEN list_slice(src, len(src) - {PT_SRC - 1}, len(src)) ELSE src END')} AS src FROM gids")
def q_src_keep_tail_ids(spark, sf):
    s = _prompt_target_ids(spark, sf)
    return s.select("conv_id", AR.join_ints(AR.src_keep_tail("src", PT_SRC)).alias("src"))


BATCH_SQL = (f"SELECT conv_id, CAST(floor((rn - 1) / {{bs}}) AS BIGINT) AS batch_id, CAST((rn - 1) % {{bs}} AS INTEGER) "
             f"AS row_in_batch FROM (SELECT conv_id, row_number() OVER (ORDER BY "
             f"{sqlx.keyed(C.SEED, 'shuffle', 'conv_id')}, conv_id) AS rn FROM {{src}})")


@register("pad_prompt_target", "WITH " + ASM_SQL + ", bt AS (" + BATCH_SQL.format(bs=4, src="asm3") + "), "
          "pp AS (SELECT a.conv_id, b.batch_id, a.ids, a.labels, max(len(a.ids)) OVER (PARTITION BY b.batch_id) AS L "
          "FROM asm3 a JOIN bt b USING (conv_id)) SELECT conv_id, batch_id, "
          f"{sqlx.join_list('list_resize(ids, L, 0)')} AS input_ids, {sqlx.join_list('list_resize(labels, L, -100)')} "
          "AS labels, array_to_string(list_transform(list_resize(labels, L, -100), lambda x: CASE WHEN x <> -100 THEN "
          "'1' ELSE '0' END), '') AS label_mask FROM pp")
def q_pad_prompt_target(spark, sf):
    p = S.prompt_target_batches(FX.conversations(spark, sf), _vocab(spark, sf), PT_MAX, PT_SRC, batch_size=4)
    return p.select("conv_id", "batch_id", AR.join_ints("input_ids").alias("input_ids"),
                    AR.join_ints("labels").alias("labels"), AR.join_bools("label_mask").alias("label_mask"))


APPLY_SQL = (VOCAB_SQL + ", " + DT_SQL + ", dl AS (SELECT conv_id, unnest(tokens) AS token, "
             "unnest(range(len(tokens))) AS pos FROM dt0), de AS (SELECT d.conv_id, d.pos, coalesce(v.token_id, 2) AS id, "
             f"CAST(sum(CASE WHEN d.token IN {MARKERS_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv_id ORDER BY "
             "d.pos ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS msg, count(*) OVER (PARTITION BY d.conv_id) AS n "
             "FROM dl d LEFT JOIN vocab v USING (token))")


@register("apply_ignore_index", "WITH " + APPLY_SQL + " SELECT conv_id, string_agg(CAST(CASE WHEN pos < n - 1 AND "
          "msg >= 0 AND msg % 2 = 1 THEN id ELSE -100 END AS VARCHAR), ' ' ORDER BY pos) AS labels FROM de "
          "GROUP BY conv_id")
def q_apply_ignore_index(spark, sf):
    vocab = _vocab(spark, sf)
    d = _encode_array(_dialogue_tokens(spark, sf), "tokens", vocab, ["conv_id"])
    d = d.withColumn("mask", TK.label_mask(TK.message_index_array(F.col("tokens"), [IDS[m] for m in MARKERS])))
    return d.select("conv_id", AR.join_ints(TK.apply_ignore_index(F.col("tokens"), F.col("mask"))).alias("labels"))


@register("encoding_report", "WITH " + APPLY_SQL + ", dd AS (SELECT conv_id, unnest(tokens) AS token, "
          "unnest(range(len(tokens))) AS pos FROM dt0) SELECT e.conv_id, CAST(e.pos AS BIGINT) AS pos, "
          "CAST(e.id AS BIGINT) AS token_id, d.token, e.msg AS msg_index FROM de e JOIN dd d ON e.conv_id = d.conv_id "
          "AND e.pos = d.pos")
def q_encoding_report(spark, sf):
    vocab = _vocab(spark, sf)
    long = S.piece_positions(materialize(S.piece_tokens(FX.conversations(spark, sf)))).drop("msg_index")
    ids = TK.encode_long(long, vocab).select("conv_id", "pos", "token_id")
    rep = TK.encoding_report(ids, vocab, ["conv_id"], "pos", [IDS[m] for m in MARKERS])
    return rep.select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.col("token_id").cast("bigint"),
                      "token", F.col("msg_index").cast("int").alias("msg_index"))


@register("assign_batches", "WITH " + DT_SQL + " " + BATCH_SQL.format(bs=8, src="dt0"))
def q_assign_batches(spark, sf):
    d = _dialogue_tokens(spark, sf).select("conv_id")
    return B.assign_batches(d, ["conv_id"], 8).select("conv_id", "batch_id", "row_in_batch")


@register("pad_to_multiple", "WITH " + DT_SQL + ", bt AS (" + BATCH_SQL.format(bs=8, src="dt0") + "), "
          "pp AS (SELECT d.conv_id, b.batch_id, d.tokens, CAST(ceil(max(len(d.tokens)) OVER (PARTITION BY b.batch_id) "
          "/ 16) * 16 AS INTEGER) AS L FROM dt0 d JOIN bt b USING (conv_id)) SELECT conv_id, batch_id, L AS "
          f"padded_length, md5(array_to_string(list_resize(tokens, L, '{C.PAD}'), ' ')) AS tokens_md5 FROM pp")
def q_pad_to_multiple(spark, sf):
    d = B.assign_batches(_dialogue_tokens(spark, sf), ["conv_id"], 8, keys=_conv_keys(spark, sf))
    p = B.pad_batch(d, "batch_id", {"tokens": C.PAD}, C.PAD_MULTIPLE)
    return p.select("conv_id", "batch_id", "padded_length", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@register("pack_short", "WITH " + DT_SQL + ", bt AS (" + BATCH_SQL.format(bs=8, src="dt0") + "), "
          f"e AS (SELECT b.batch_id, b.row_in_batch, d.conv_id, d.tokens, (len(d.tokens) < 256 AND "
          f"{sqlx.keyed(C.SEED, 'mix', 'd.conv_id')} > 0.6) AS elig FROM dt0 d JOIN bt b USING (conv_id)), "
          "k AS (SELECT *, row_number() OVER (PARTITION BY batch_id, elig ORDER BY row_in_batch) - 1 AS k, "
          "count(*) OVER (PARTITION BY batch_id, elig) AS cnt FROM e), "
          "g AS (SELECT *, CASE WHEN elig AND NOT (k = cnt - 1 AND cnt % 2 = 1) THEN k // 2 END AS grp FROM k), "
          "o AS (SELECT batch_id, row_in_batch, tokens, false AS packed FROM g WHERE grp IS NULL UNION ALL "
          "SELECT batch_id, max(row_in_batch), list_slice(list_concat(arg_max(tokens, row_in_batch), "
          "arg_min(tokens, row_in_batch)), 1, 512), true FROM g WHERE grp IS NOT NULL GROUP BY batch_id, grp) "
          "SELECT batch_id, row_in_batch, packed, CAST(len(tokens) AS INTEGER) AS n_tokens, "
          "md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM o")
def q_pack_short(spark, sf):
    d = B.assign_batches(_dialogue_tokens(spark, sf), ["conv_id"], 8, keys=_conv_keys(spark, sf))
    p = B.pack_short(d, "batch_id", "row_in_batch", ["tokens"], ["conv_id"], 512)
    return p.select("batch_id", "row_in_batch", "packed", F.size("tokens").alias("n_tokens"),
                    F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@register("length_stats", "WITH l AS (SELECT lang, len(" + sqlx.tok("text") + ") AS n FROM documents) SELECT lang, "
          "count(*) AS n, CAST(min(least(n, 2048)) AS BIGINT) AS min_len, CAST(max(least(n, 2048)) AS BIGINT) AS "
          "max_len, round(avg(least(n, 2048)), 6) AS mean_len, round(quantile_cont(least(n, 2048), 0.5), 6) AS "
          "median_len, round(avg(CASE WHEN n > 2048 THEN 1 ELSE 0 END), 6) AS over_share FROM l GROUP BY lang")
def q_length_stats(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.size(tokenize(F.col("text"))).alias("n"))
    return B.length_stats(d, F.col("n"), 2048, ["lang"])


DB_SQL = (VOCAB_SQL + ", pieces AS (SELECT conv_id, turn, " + TOK_PIECE + " AS toks FROM conversations), "
          "toks AS (SELECT conv_id, turn, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM pieces), "
          "seq AS (SELECT conv_id, token, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS gpos, "
          f"CAST(sum(CASE WHEN token IN {MARKERS_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, pos "
          "ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS msg FROM toks), "
          "tot AS (SELECT conv_id, count(*) AS total FROM seq GROUP BY conv_id), "
          f"off AS (SELECT conv_id, CAST(CASE WHEN {sqlx.keyed(C.SEED, 'crop-mode', 'conv_id')} < 0.5 AND total > @ML@ "
          f"THEN floor({sqlx.keyed(C.SEED, 'crop-offset', 'conv_id')} * (total - @ML@ + 1)) ELSE 0 END AS BIGINT) AS off "
          "FROM tot), kept AS (SELECT s.conv_id, s.gpos, s.msg, coalesce(v.token_id, 2) AS id FROM seq s "
          "JOIN off o USING (conv_id) LEFT JOIN vocab v ON s.token = v.token WHERE s.gpos >= o.off AND "
          "s.gpos < o.off + @ML@), enc AS (SELECT conv_id, list(id ORDER BY gpos) AS ids, list(msg ORDER BY gpos) AS msg "
          "FROM kept GROUP BY conv_id), bt AS (" + BATCH_SQL.format(bs="@BS@", src="enc") + "), "
          "pp AS (SELECT e.conv_id, b.batch_id, b.row_in_batch, e.ids, e.msg, CAST(ceil(max(len(e.ids)) OVER "
          "(PARTITION BY b.batch_id) / 16) * 16 AS INTEGER) AS L FROM enc e JOIN bt b USING (conv_id)), "
          "pd AS (SELECT conv_id, batch_id, row_in_batch, list_resize(ids, L, 0) AS ids, list_resize(list_transform(msg, "
          "lambda x, i: CASE WHEN i = len(msg) THEN false ELSE x >= 0 AND x % 2 = 1 END), L, false) AS mask, "
          "list_resize(list_transform(ids, lambda x: 1), L, 0) AS att FROM pp)")


@register("dialogue_batches", "WITH " + DB_SQL.replace("@ML@", "256").replace("@BS@", "8") + " SELECT conv_id, batch_id, row_in_batch, "
          f"{sqlx.join_list('ids')} AS input_ids, {sqlx.join_list('att', '')} AS attention_mask, "
          "array_to_string(list_transform(mask, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS label_mask, "
          f"{sqlx.join_list('list_concat(ids[2:], ids[1:1])')} AS targets FROM pd")
def q_dialogue_batches(spark, sf):
    """Whole fine-tuning data path: render, tokenize, crop, encode, mask, batch, pad, shift."""
    # written once: the vocabulary, the prefix sums and the cut read it
    pieces = materialize(S.piece_tokens(FX.conversations(spark, sf)), "pieces")
    vocab = TK.build_vocab(pieces, "toks")
    b = S.dialogue_batches(pieces, vocab, max_length=256, batch_size=8)
    return b.select("conv_id", "batch_id", "row_in_batch", AR.join_ints("input_ids").alias("input_ids"),
                    AR.join_ints("attention_mask", "").alias("attention_mask"),
                    AR.join_bools("label_mask").alias("label_mask"), AR.join_ints("targets").alias("targets"))


PREFIX_IDS = [IDS[C.SYSTEM], IDS[C.UNK], IDS[C.EOS]]
_PX_SQL = DB_SQL.replace("@ML@", str(256 - len(PREFIX_IDS))).replace("@BS@", "8").replace(
    "e.ids, e.msg, CAST(ceil(max(len(e.ids))", f"list_concat({PREFIX_IDS}, e.ids) AS ids, list_concat("
    f"{[-1] * len(PREFIX_IDS)}, e.msg) AS msg, CAST(ceil(max({len(PREFIX_IDS)} + len(e.ids))")


@register("dialogue_batches_prefixed", "WITH " + _PX_SQL + " SELECT conv_id, batch_id, row_in_batch, "
          f"{sqlx.join_list('ids')} AS input_ids, {sqlx.join_list('att', '')} AS attention_mask, "
          "array_to_string(list_transform(mask, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS label_mask FROM pd")
def q_dialogue_batches_prefixed(spark, sf):
    """The fine-tuning data path with a system prefix in front of every (shorter cut) sequence."""
    pieces = materialize(S.piece_tokens(FX.conversations(spark, sf)), "pieces")
    b = S.dialogue_batches(pieces, TK.build_vocab(pieces, "toks"), 256, 8, prefix_ids=PREFIX_IDS)
    return b.select("conv_id", "batch_id", "row_in_batch", AR.join_ints("input_ids").alias("input_ids"),
                    AR.join_ints("attention_mask", "").alias("attention_mask"),
                    AR.join_bools("label_mask").alias("label_mask"))
