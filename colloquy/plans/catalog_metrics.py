"""Registered queries: metrics, losses and the running-accuracy stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.arrays import argmax_index
from ..operators import losses as L
from ..operators import metrics as M
from ..operators import partial as P
from ..operators import slices as SL
from ..session import materialize, scratch_path
from ..streaming.accuracy import run_running_accuracy, running_accuracy_by_batch
from ..streaming.keyed import run_keyed_accuracy
from . import fixtures as FX
from . import metric_sql, sqlx
from .registry import register, table

NS_SQL = "ns AS (SELECT * FROM (VALUES (1), (2), (3), (4)) v(n))"
MT_SQL = (FX.METRIC_PAIRS_SQL + f", mt AS (SELECT conv_id, turn, {sqlx.tok(sqlx.strip_markers('response'))} AS h, "
          f"{sqlx.tok(sqlx.strip_markers('target'))} AS r FROM pairs), " + NS_SQL)


def _ng_sql(side: str) -> str:
    return (f"(SELECT conv_id, turn, n, unnest(list_transform(range(1, len({side}) - n + 2), "
            f"lambda i: array_to_string({side}[i:i + n - 1], ' '))) AS ngram FROM mt, ns WHERE len({side}) >= n)")


NGRAM_SQL = MT_SQL + f", hn AS {_ng_sql('h')}, cnt AS (SELECT n, ngram, count(*) AS count FROM hn GROUP BY n, ngram)"
STATS_SQL = (NGRAM_SQL + ", st AS (SELECT n, CAST(sum(count) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS d, "
             "sum(count * ln(count)) AS vlv FROM cnt GROUP BY n)")

CLIP_SQL = (MT_SQL + f", hn AS {_ng_sql('h')}, rn AS {_ng_sql('r')}, "
            "hg AS (SELECT conv_id, turn, n, ngram, count(*) AS c FROM hn GROUP BY ALL), "
            "rg AS (SELECT conv_id, turn, n, ngram, count(*) AS c FROM rn GROUP BY ALL), "
            "m AS (SELECT h.conv_id, h.turn, h.n, sum(least(h.c, coalesce(r.c, 0))) AS matches, sum(h.c) AS total "
            "FROM hg h LEFT JOIN rg r ON h.conv_id = r.conv_id AND h.turn = r.turn AND h.n = r.n AND h.ngram = r.ngram "
            "GROUP BY ALL), mm AS (SELECT g.conv_id, g.turn, g.n, CAST(coalesce(m.matches, 0) AS BIGINT) AS matches, "
            "CAST(coalesce(m.total, 0) AS BIGINT) AS total FROM (SELECT conv_id, turn, n FROM mt, ns) g "
            "LEFT JOIN m USING (conv_id, turn, n))")


def _bleu_sql(n: int) -> str:
    return (f"CASE WHEN len(mt.h) = 0 OR b.min{n} = 0 THEN 0.0 ELSE (CASE WHEN len(mt.h) > len(mt.r) THEN 1.0 ELSE "
            f"exp(1 - len(mt.r) / len(mt.h)) END) * exp(b.slp{n} / {n}) END")


BLEU_SQL = (CLIP_SQL + ", b AS (SELECT conv_id, turn, min(matches) FILTER (WHERE n <= 2) AS min2, "
            "sum(ln(matches / total)) FILTER (WHERE n <= 2 AND matches > 0) AS slp2, "
            "min(matches) FILTER (WHERE n <= 4) AS min4, "
            "sum(ln(matches / total)) FILTER (WHERE n <= 4 AND matches > 0) AS slp4 FROM mm GROUP BY conv_id, turn)")


def _tokens(spark, sf):
    return M.metric_tokens(FX.metric_pairs(spark, sf), ["conv_id", "turn"])


@register("ngram_counts", "WITH " + NGRAM_SQL + " SELECT n, ngram, count FROM cnt")
def q_ngram_counts(spark, sf):
    return M.ngram_counts(_tokens(spark, sf), "hyp_tokens")


@register("ngram_entropy", "WITH " + STATS_SQL + " SELECT n, round(-(vlv / (s + 1e-10) - s / (s + 1e-10) * "
                                                 "ln(s + 1e-10)), 6) AS entropy FROM st")
def q_ngram_entropy(spark, sf):
    return M.ngram_entropy(M.ngram_counts(_tokens(spark, sf), "hyp_tokens"))


@register("distinct_n", "WITH " + STATS_SQL + " SELECT n, round(d / (s + 1e-10), 6) AS distinct_ratio, "
                                              "n = 3 AS dist_2_compat FROM st")
def q_distinct_n(spark, sf):
    return M.distinct_n(M.ngram_counts(_tokens(spark, sf), "hyp_tokens"))


@register("distinct_n_sketch", "WITH " + STATS_SQL + " SELECT n, CAST(s AS BIGINT) AS total, CAST(d AS BIGINT) AS distinct_exact, "
          "true AS within_error FROM st")
def q_distinct_n_sketch(spark, sf):
    """Distinct n-grams from merged sketches of two halves, held against the exact counts."""
    t = materialize(_tokens(spark, sf), "sketch-tokens")
    half = F.pmod("conv_id", F.lit(2))
    states = [P.distinct_state(t.filter(half == k), "hyp_tokens") for k in (0, 1)]
    found = P.distinct_estimates(P.merge_distinct(states))
    exact = M.ngram_stats(M.ngram_counts(t, "hyp_tokens")).select("n", F.col("distinct").alias("distinct_exact"))
    near = F.abs(F.col("distinct") - F.col("distinct_exact")) <= F.col("error") * F.col("distinct_exact")
    return found.join(exact, "n").select("n", "total", "distinct_exact", near.alias("within_error"))


@register("clipped_ngram_join", "WITH " + CLIP_SQL + " SELECT conv_id, turn, n, matches, total FROM mm")
def q_clipped_ngram_join(spark, sf):
    return M.clipped_ngram_matches(_tokens(spark, sf), ["conv_id", "turn"], "hyp_tokens", "ref_tokens", 4)


@register("bleu_n", "WITH " + BLEU_SQL + f" SELECT mt.conv_id, mt.turn, round({_bleu_sql(2)}, 6) AS bleu_2, "
          f"round({_bleu_sql(4)}, 6) AS bleu_4 FROM mt JOIN b USING (conv_id, turn)")
def q_bleu_n(spark, sf):
    keys = ["conv_id", "turn"]
    b = M.bleu_scores(materialize(_tokens(spark, sf)), keys, (2, 4))
    return b.select(*keys, F.round("bleu_2", 6).alias("bleu_2"), F.round("bleu_4", 6).alias("bleu_4"))


PAIR_KEY_SQL = "{'conv_id': conv_id, 'turn': turn}"
PAIR_SQL = "WITH RECURSIVE " + FX.METRIC_PAIRS_SQL + ", " + metric_sql.ctes("pairs", PAIR_KEY_SQL)


@register("rouge_l", PAIR_SQL + " SELECT k.conv_id AS conv_id, k.turn AS turn, CAST(lcs AS BIGINT) AS lcs, "
          "round(rouge_l, 6) AS rouge_l FROM rouge")
def q_rouge_l(spark, sf):
    """Per-pair ROUGE-L over non-empty pairs (LCS kernel in Arrow batches)."""
    t = _tokens(spark, sf).filter((F.size("hyp_tokens") > 0) & (F.size("ref_tokens") > 0))
    r = M.rouge_l(t, ["conv_id", "turn"])
    return r.select("conv_id", "turn", "lcs", F.round("rouge_l", 6).alias("rouge_l"))


# a document against its words without every fifth: the shorter side is the longest common subsequence
LONG_PAIRS_SQL = ("SELECT doc_id, n, n - n // 5 AS lcs FROM (SELECT doc_id, "
                  "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents)")


@register("rouge_l_tiled", f"SELECT doc_id, CAST(lcs AS BIGINT) AS lcs, CASE WHEN n = 0 THEN 0.0 ELSE "
          f"round(2.0 * lcs / n / (CAST(lcs AS DOUBLE) / n + 1 + {C.F_EPS}), 6) END AS rouge_l FROM ({LONG_PAIRS_SQL})")
def q_rouge_l_tiled(spark, sf):
    """ROUGE-L of whole documents against shortened copies; pairs of more than 4,096 words run in tiles."""
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    d = table(spark, sf, "documents").select("doc_id", words.alias("h"))
    pairs = d.select("doc_id", "h", F.filter("h", lambda x, i: F.pmod(i, F.lit(5)) != 4).alias("r"))
    r = M.rouge_l(pairs, ["doc_id"], "h", "r", tile=4096)
    return r.select("doc_id", "lcs", F.round("rouge_l", 6).alias("rouge_l"))


@register("rouge_l_summary")
def q_rouge_l_summary(spark, sf):
    """Per-pair summary-level ROUGE-L: united subsequence words over sentences (ties have no SQL form)."""
    r = M.rouge_l(_tokens(spark, sf), ["conv_id", "turn"], mode="summary")
    return r.select("conv_id", "turn", "lcs", F.round("rouge_l", 6).alias("rouge_l"))


@register("meteor_stem")
def q_meteor_stem(spark, sf):
    """Per-pair METEOR with the stem stage (Porter's rules have no SQL form)."""
    m = M.meteor(_tokens(spark, sf), ["conv_id", "turn"], stem=True)
    return m.select("conv_id", "turn", F.round("meteor", 6).alias("meteor"))


@register("meteor", PAIR_SQL + " SELECT k.conv_id AS conv_id, k.turn AS turn, round(meteor, 6) AS meteor FROM met")
def q_meteor(spark, sf):
    """Per-pair METEOR (exact stage)."""
    m = M.meteor(_tokens(spark, sf), ["conv_id", "turn"])
    return m.select("conv_id", "turn", F.round("meteor", 6).alias("meteor"))


@register("generation_report", PAIR_SQL + metric_sql.REPORT)
def q_generation_report(spark, sf):
    """rouge_l, bleu_2, bleu_4, meteor, dist_2 over all assistant-turn pairs."""
    return M.generation_report(FX.metric_pairs(spark, sf), ["conv_id", "turn"])


@register("generation_report_resumed", PAIR_SQL + metric_sql.REPORT)
def q_generation_report_resumed(spark, sf):
    """The report of a run in two parts: the second scores only what the first has not."""
    pairs = FX.metric_pairs(spark, sf)
    keys, path = ["conv_id", "turn"], scratch_path(spark, "report-state")
    first, _ = P.resumed_report(pairs.filter(F.pmod("conv_id", F.lit(2)) == 0), None, keys, lambda df: df, path, "first")
    return P.resumed_report(pairs, first, keys, lambda df: df, path, "second")[1]


_CORRECT = (f"CASE WHEN length({sqlx.trim_all('model_output')}) > 0 AND len(ch) > 0 AND ch[-1] = answer "
            "THEN 1 ELSE 0 END")
SC_SQL = (FX.EXAM_REPLIES_SQL + f", sc AS (SELECT *, {sqlx.extract_choices(sqlx.trim_all('model_output'))} AS ch "
          f"FROM replies), tc AS (SELECT *, {_CORRECT} AS correctness FROM sc)")


@register("choice_accuracy", "WITH " + SC_SQL + " SELECT answer, count(*) AS n, "
          "round(100.0 * sum(correctness) / count(*), 6) AS accuracy FROM tc GROUP BY answer")
def q_choice_accuracy(spark, sf):
    return M.choice_accuracy(M.tag_correctness(FX.exam_replies(spark, sf)), ["answer"])


TA_SQL = (FX.LOGITS_SQL + ", ta AS (SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS "
          "INTEGER) AS pred, target AS label FROM lg)")


def _preds(spark, sf):
    lg = FX.logits(spark, sf)
    return lg.select("vec_id", argmax_index("logits").alias("pred"), F.col("target").alias("label"))


@register("token_accuracy", "WITH " + TA_SQL + " SELECT 'positive' AS rule, count(*) AS n, round(avg(CASE WHEN "
          "pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ta WHERE label > 0 UNION ALL "
          "SELECT 'ignore_index', count(*), round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) FROM ta "
          "WHERE label <> -100")
def q_token_accuracy(spark, sf):
    p = _preds(spark, sf)
    a = M.token_accuracy(p, rule="positive").select(F.lit("positive").alias("rule"), "*")
    b = M.token_accuracy(p, rule="ignore_index").select(F.lit("ignore_index").alias("rule"), "*")
    return a.unionByName(b)


CE_SQL = (FX.LOGITS_SQL + ", lg2 AS (SELECT *, list_max(logits) AS m FROM lg), "
          "ce AS (SELECT vec_id, target, mask, m + ln(list_sum(list_transform(logits, lambda x: exp(x - m)))) AS lse, "
          "CASE WHEN target = -100 THEN NULL ELSE logits[target + 1] END AS lt FROM lg2)")
CE_VALUE = "round(sum(CASE WHEN target = -100 THEN 0 ELSE lse - lt END) / (count(*) + 1e-8), 6)"
POLY_VALUE = "round(avg(lse - lt + 1.0 * (1 - exp(lt - lse))), 6)"


@register("masked_cross_entropy", "WITH " + CE_SQL + f" SELECT count(*) AS n, {CE_VALUE} AS loss FROM ce WHERE mask")
def q_masked_cross_entropy(spark, sf):
    return L.masked_cross_entropy(FX.logits(spark, sf))


@register("poly_loss", "WITH " + CE_SQL + f" SELECT count(*) AS n, {POLY_VALUE} AS loss FROM ce "
          "WHERE mask AND target <> -100")
def q_poly_loss(spark, sf):
    return L.poly_loss(FX.logits(spark, sf))


def _sliced(spark, sf):
    """Logits in slices of 16 entries of the vocabulary."""
    d = FX.logits(spark, sf)
    cut = F.transform(F.sequence(F.lit(0), F.size("logits") - 1, F.lit(16)),
                      lambda i: F.struct(i.alias("start"), F.slice("logits", i + 1, F.lit(16)).alias("logits")))
    return d.select("vec_id", "target", "mask", F.inline(cut))


@register("losses_sliced", "WITH " + CE_SQL + f" SELECT 'cross_entropy' AS loss, count(*) AS n, {CE_VALUE} AS value FROM ce "
          f"WHERE mask UNION ALL SELECT 'poly', count(*), {POLY_VALUE} FROM ce WHERE mask AND target <> -100")
def q_losses_sliced(spark, sf):
    """Cross-entropy and poly loss over logits in slices."""
    d = _sliced(spark, sf)
    ce, poly = SL.masked_cross_entropy(d, ["vec_id"]), SL.poly_loss(d, ["vec_id"])
    return ce.select(F.lit("cross_entropy").alias("loss"), "n", F.col("loss").alias("value")).unionByName(
        poly.select(F.lit("poly").alias("loss"), "n", F.col("loss").alias("value")))


@register("preds_sliced", "WITH " + FX.LOGITS_SQL + " SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) "
          "AS pred FROM lg")
def q_preds_sliced(spark, sf):
    """First largest logit of every position over slices."""
    return SL.predictions(_sliced(spark, sf), ["vec_id"])


_SP = FX.softplus_sql("neg - pos")
RANK_VALUE = f"(SELECT round(avg(l), 6) FROM (SELECT avg({_SP} + 0.001 * 0.5 * (pos * pos + neg * neg)) AS l FROM rp GROUP BY conv_id))"
RANK_N = "(SELECT count(DISTINCT conv_id) FROM rp)"
PCLS_VALUE = f"(SELECT round(avg({_SP}), 6) FROM rp)"


@register("preference_pairs", "WITH " + FX.RANKED_SQL + " SELECT conv_id, count(*) AS n_pairs, "
          f"round(sum(pos - neg), 6) AS margin_sum, round(sum({_SP}), 6) AS sp_sum FROM rp GROUP BY conv_id")
def q_preference_pairs(spark, sf):
    """Per-conversation pair statistics without materialising pairs (blocked kernel)."""
    s = L.preference_pair_sums(FX.ranked(spark, sf)).filter(F.col("n_pairs") > 0)
    return s.select("conv_id", "n_pairs", F.round("margin_sum", 6).alias("margin_sum"),
                    F.round("sp_sum", 6).alias("sp_sum"))


@register("ranking_loss", "WITH " + FX.RANKED_SQL + f" SELECT {RANK_N} AS n, {RANK_VALUE} AS loss")
def q_ranking_loss(spark, sf):
    return L.ranking_loss(FX.ranked(spark, sf))


@register("pair_classification_loss", "WITH " + FX.RANKED_SQL + f" SELECT count(*) AS n, {PCLS_VALUE} AS loss FROM rp")
def q_pair_classification_loss(spark, sf):
    return L.pair_classification_loss(FX.ranked(spark, sf))


@register("loss_report", "WITH " + CE_SQL + ", " + FX.RANKED_SQL + ", lr AS ("
          f"SELECT 'CrossEntropyLoss' AS loss, CAST(count(*) AS BIGINT) AS n, {CE_VALUE} AS value FROM ce WHERE mask "
          f"UNION ALL SELECT 'Poly', count(*), {POLY_VALUE} FROM ce WHERE mask AND target <> -100 "
          f"UNION ALL SELECT 'RMLoss', {RANK_N}, {RANK_VALUE} "
          f"UNION ALL SELECT 'RMCLSLoss', (SELECT count(*) FROM rp), {PCLS_VALUE}) SELECT * FROM lr")
def q_loss_report(spark, sf):
    lg, rk = FX.logits(spark, sf), FX.ranked(spark, sf)
    out = None
    for name in L.LOSSES:
        r = L.loss_report(name, lg, rk)
        out = r if out is None else out.unionByName(r)
    return out


@register("merge_metrics", "WITH " + TA_SQL + ", " + CE_SQL.replace(FX.LOGITS_SQL + ", ", "") + ", "
          + SC_SQL + " SELECT 'token_accuracy' AS metric, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) "
          "AS value FROM ta WHERE label > 0 UNION ALL SELECT 'choice_accuracy', round(100.0 * sum(correctness) / "
          f"count(*), 6) FROM tc UNION ALL SELECT 'cross_entropy', {CE_VALUE} FROM ce WHERE mask")
def q_merge_metrics(spark, sf):
    ta = M.token_accuracy(_preds(spark, sf), rule="positive").select("accuracy")
    ca = M.choice_accuracy(M.tag_correctness(FX.exam_replies(spark, sf))).select("accuracy")
    ce = L.masked_cross_entropy(FX.logits(spark, sf)).select("loss")
    return M.merge_metrics([("token_accuracy", ta), ("choice_accuracy", ca), ("cross_entropy", ce)])


@register("mean_judge_score", "WITH " + FX.JUDGE_SQL + f", js AS (SELECT CASE WHEN length({sqlx.trim_all('judge_reply')})"
          f" = 0 THEN 0.0 WHEN length(regexp_extract({sqlx.trim_all('judge_reply')}, {sqlx.lit(C.SCORE_PATTERN)}, 1)) > 0 "
          f"THEN CAST(regexp_extract({sqlx.trim_all('judge_reply')}, {sqlx.lit(C.SCORE_PATTERN)}, 1) AS DOUBLE) END AS sc "
          "FROM jr) SELECT count(*) AS n, count(sc) AS n_scored, round(avg(sc), 6) AS mean_score FROM js")
def q_mean_judge_score(spark, sf):
    return M.mean_judge_score(FX.judge_replies(spark, sf))


@register("running_accuracy", "WITH " + TA_SQL + " SELECT CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT)"
          " AS \"right\", count(*) AS total, round(CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS DOUBLE) / "
          "count(*), 6) AS accuracy FROM ta WHERE label <> -100")
def q_running_accuracy(spark, sf):
    """Prediction files (five arrival batches) consumed by a stream; final state."""
    src = scratch_path(spark, "pred-stream")
    p = _preds(spark, sf).withColumn("batch", F.pmod(F.col("vec_id"), F.lit(5)))
    p.select(F.col("batch").cast("bigint").alias("batch"), F.col("pred").cast("int").alias("pred"),
             F.col("label").cast("int").alias("label")).repartition(5, "batch").write.parquet(src)
    return run_running_accuracy(spark, src)


@register("running_accuracy_keyed", "WITH " + TA_SQL + " SELECT vec_id % 3 AS model, CAST(sum(CASE WHEN pred = label AND label "
          "<> -100 THEN 1 ELSE 0 END) AS BIGINT) AS \"right\", count(*) FILTER (label <> -100) AS total, "
          "round(CAST(sum(CASE WHEN pred = label AND label <> -100 THEN 1 ELSE 0 END) AS DOUBLE) / "
          "count(*) FILTER (label <> -100), 6) AS accuracy FROM ta GROUP BY 1")
def q_running_accuracy_keyed(spark, sf):
    """Predictions of three models in four files, all delivered twice, counted by a keyed stream."""
    src = scratch_path(spark, "keyed-stream")
    k = F.col("vec_id")
    p = materialize(_preds(spark, sf).select(
        F.pmod(k, F.lit(3)).cast("bigint").alias("model"), F.pmod(F.expr("vec_id div 3"), F.lit(4)).cast("bigint").alias("batch"),
        F.col("pred").cast("int").alias("pred"), F.col("label").cast("int").alias("label")), "keyed-predictions")
    for _ in range(2):
        p.repartition(4, "batch").write.mode("append").parquet(src)
    return run_keyed_accuracy(spark, src, p.schema, ["model"], files_per_trigger=2)


SEQ_SQL = (f"sp AS (SELECT conv_id, turn, array_to_string({sqlx.tok(sqlx.strip_markers('text'))}, ' ') AS h, "
           f"array_to_string({sqlx.tok(sqlx.strip_markers("CASE WHEN (conv_id + turn) % 3 = 0 THEN text ELSE text || '!' END"))}, ' ') AS r "
           "FROM conversations WHERE role = 'assistant'), sq AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS i, "
           "h, r FROM sp), nn AS (SELECT count(*) AS cnt FROM sq), " + NS_SQL + ", "
           "g AS (SELECT ns.n, sq.i, list(q2.h ORDER BY q2.i) AS hg, list(q2.r ORDER BY q2.i) AS rg FROM ns, sq, sq q2, nn "
           "WHERE q2.i >= sq.i AND q2.i < sq.i + ns.n AND sq.i <= nn.cnt - ns.n + 1 GROUP BY ns.n, sq.i), "
           "gx AS (SELECT n, hg AS gram, true AS h FROM g UNION ALL SELECT n, rg, false FROM g), "
           "gc AS (SELECT n, gram, count(*) FILTER (WHERE h) AS ch, count(*) FILTER (WHERE NOT h) AS cr FROM gx "
           "GROUP BY n, gram), per AS (SELECT n, CAST(sum(least(ch, cr)) AS BIGINT) AS matches, "
           "CAST(sum(ch) AS BIGINT) AS total FROM gc GROUP BY n), cum AS (SELECT n, matches, total, "
           "max(CASE WHEN matches = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS z, "
           "sum(CASE WHEN matches > 0 THEN ln(matches / total) END) OVER (ORDER BY n) AS slp FROM per)")


@register("bleu_sequence", "WITH " + SEQ_SQL + " SELECT n, matches, total, round(CASE WHEN z = 1 THEN 0.0 ELSE "
          "exp(slp / n) END, 6) AS bleu FROM cum")
def q_bleu_sequence(spark, sf):
    """BLEU as the original calls it: whole processed answers are the tokens (one corpus score per order)."""
    c = FX.conversations(spark, sf).filter(F.col("role") == "assistant")
    pairs = c.select("conv_id", "turn", F.col("text").alias("response"),
                     F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0, F.col("text"))
                     .otherwise(F.concat("text", F.lit("!"))).alias("target"))
    t = M.metric_tokens(pairs, ["conv_id", "turn"])
    joined = t.select("conv_id", "turn", F.array_join("hyp_tokens", " ").alias("response"),
                      F.array_join("ref_tokens", " ").alias("target"))
    s = M.bleu_sequence(joined, ["conv_id", "turn"], "response", "target", 4)
    return s.select("n", "matches", "total", F.round("bleu", 6).alias("bleu"))


@register("running_accuracy_batches", "WITH " + TA_SQL + ", pb AS (SELECT CAST(vec_id % 5 AS BIGINT) AS batch, "
          "sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS r, count(*) AS t FROM ta WHERE label <> -100 GROUP BY 1) "
          "SELECT batch, CAST(sum(r) OVER (ORDER BY batch) AS BIGINT) AS \"right\", CAST(sum(t) OVER (ORDER BY batch) "
          "AS BIGINT) AS total, round(CAST(sum(r) OVER (ORDER BY batch) AS DOUBLE) / sum(t) OVER (ORDER BY batch), 6) "
          "AS accuracy FROM pb")
def q_running_accuracy_batches(spark, sf):
    """Batch twin of the running-accuracy stream: cumulative accuracy after each arrival batch."""
    p = _preds(spark, sf).withColumn("batch", F.pmod(F.col("vec_id"), F.lit(5)).cast("bigint"))
    return running_accuracy_by_batch(p)


@register("choice_accuracy_rollup", "WITH " + SC_SQL + " SELECT answer, count(*) AS n, "
          "round(100.0 * sum(correctness) / count(*), 6) AS accuracy FROM tc GROUP BY ROLLUP (answer)")
def q_choice_accuracy_rollup(spark, sf):
    """Choice accuracy per answer letter plus the overall row (rollup)."""
    return M.choice_accuracy(M.tag_correctness(FX.exam_replies(spark, sf)), ["answer"], rollup=True)
