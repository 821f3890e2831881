"""Registered queries: sources/sinks, filters, joins, rendering and strings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import text as TX
from ..functions.arrays import argmax_index
from ..operators import generate as G
from ..operators import metrics as M
from ..operators import render as R
from ..operators.batches import assign_split, shard_rows
from ..session import scratch_path
from ..sources import io
from . import fixtures as FX
from . import sqlx
from .registry import register, table

RANGE_BYTES = 1 << 18  # of the files that queries write and read back in ranges

DP_SQL = (
    "lastt AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), "
    f"ctx AS (SELECT c.conv_id, string_agg({sqlx.marker('c.role')} || c.text || '{C.EOS}', '' ORDER BY c.turn) AS ctx "
    "FROM conversations c JOIN lastt l USING (conv_id) WHERE c.turn < l.last GROUP BY c.conv_id), "
    "tgt AS (SELECT c.conv_id, c.text AS target, c.role AS target_role FROM conversations c JOIN lastt l "
    "USING (conv_id) WHERE c.turn = l.last), "
    f"dp AS (SELECT t.conv_id, {sqlx.lit(C.DIALOGUE_INSTRUCTION)} || coalesce(ctx.ctx, '') || '{C.DOCTOR}' AS prompt, "
    "t.target, t.target_role FROM tgt t LEFT JOIN ctx USING (conv_id))")


def _dp(spark, sf):
    return R.dialogue_prompt(FX.conversations(spark, sf))


# ------------------------------------------------------------ sources / sinks

@register("read_dialogues", "SELECT conv_id, turn, role, text FROM conversations")
def q_read_dialogues(spark, sf):
    """Conversations written as JSON lines (one dialogue per line), read back as turns."""
    path = scratch_path(spark, "dialogues-jsonl")
    io.write_dialogues(FX.conversations(spark, sf), path)
    return io.read_dialogues(spark, path)


@register("read_dialogues_document", "SELECT conv_id, turn, role, text FROM conversations")
def q_read_dialogues_document(spark, sf):
    """Conversations written as few large JSON lists, each read back in many byte ranges, with a key of their own."""
    path = scratch_path(spark, "dialogue-documents")
    io.write_dialogue_documents(FX.conversations(spark, sf).withColumnRenamed("conv_id", "id").selectExpr(
        "id AS conv_id", "id", "turn", "role", "text"), path, files=2, extra=["id"])
    fields = T.StructType([*io.TURN.fields, T.StructField("id", T.LongType())])
    turns = io.read_dialogues(spark, path, whole_document=True, fields=fields, range_bytes=RANGE_BYTES)
    return turns.select(F.col("id").alias("conv_id"), "turn", "role", "text")


@register("read_split", "SELECT conv_id, turn, role, text FROM conversations "
                        f"WHERE {sqlx.keyed(C.SEED, 'split', 'conv_id')} < 0.2")
def q_read_split(spark, sf):
    """Keyed-hash split written partitioned by ``split``; the eval split read back."""
    root = scratch_path(spark, "splits")
    io.write_split(assign_split(FX.conversations(spark, sf), ["conv_id"], 0.2), root)
    return io.read_split(spark, root, "eval").select("conv_id", "turn", "role", "text")


@register("assign_split", f"SELECT conv_id, turn, CASE WHEN {sqlx.keyed(C.SEED, 'split', 'conv_id')} < 0.2 "
                          "THEN 'eval' ELSE 'train' END AS split FROM conversations")
def q_assign_split(spark, sf):
    return assign_split(FX.conversations(spark, sf), ["conv_id"], 0.2).select("conv_id", "turn", "split")


@register("read_exam_csv", "WITH " + FX.EXAM_SQL + " SELECT question, A, B, C, D, answer FROM exam")
def q_read_exam_csv(spark, sf):
    """Exam rows (questions with newlines) written as CSV and read back in byte ranges."""
    path = scratch_path(spark, "exam-csv")
    io.write_scored_csv(FX.exam(spark, sf).drop("p_partkey"), path)
    return io.read_exam_csv(spark, path, "choice", range_bytes=RANGE_BYTES)


@register("read_template",
          "WITH " + FX.METRIC_PAIRS_SQL + " SELECT conv_id, turn, "
          f"replace(replace({sqlx.lit(C.DEFAULT_JUDGE_TEMPLATE + chr(10))}, '[Answer]', target), '[Response]', response)"
          " AS content FROM pairs")
def q_read_template(spark, sf):
    """A judge template written as a text file, read whole, used to fill prompts."""
    path = scratch_path(spark, "template")
    spark.createDataFrame([(C.DEFAULT_JUDGE_TEMPLATE,)], "value string").coalesce(1).write.text(path)
    template = io.read_template(spark, path).first()["template"]  # one small file
    return R.judge_prompt(FX.metric_pairs(spark, sf), template).select("conv_id", "turn", "content")


@register("write_predictions", "WITH " + DP_SQL + " SELECT conv_id AS id, right(prompt, 16) AS response, target FROM dp")
def q_write_predictions(spark, sf):
    """Generated predictions written as JSON lines and read back."""
    dp = G.batch_generate(_dp(spark, sf), "prompt", G.tail_echo_factory(16))
    path = scratch_path(spark, "predictions")
    io.write_predictions(dp.select(F.col("conv_id").alias("id"), "response", "target"), path)
    return io.read_predictions(spark, path)


_CORRECT_SQL = (f"CASE WHEN length({sqlx.trim_all('model_output')}) > 0 AND len(ch) > 0 AND ch[-1] = answer "
                "THEN 1 ELSE 0 END")
SCORED_SQL = (FX.EXAM_REPLIES_SQL + f", sc AS (SELECT *, {sqlx.extract_choices(sqlx.trim_all('model_output'))} AS ch "
              "FROM replies)")


@register("write_scored_csv", "WITH " + SCORED_SQL + " SELECT question, A, B, C, D, answer, model_output, "
          f"CAST({_CORRECT_SQL} AS INTEGER) AS correctness FROM sc")
def q_write_scored_csv(spark, sf):
    """Exam + model output + correctness written as CSV, read back."""
    scored = M.tag_correctness(FX.exam_replies(spark, sf))
    path = scratch_path(spark, "scored-csv")
    io.write_scored_csv(scored.select("question", "A", "B", "C", "D", "answer", "model_output", "correctness"), path)
    schema = "question string, A string, B string, C string, D string, answer string, model_output string, correctness int"
    return io.csv_reader(spark).schema(schema).csv(path)


@register("resume_predictions", "WITH " + DP_SQL + " SELECT conv_id, prompt FROM dp "
          f"WHERE {sqlx.keyed(C.SEED, 'done', 'conv_id')} >= 0.5")
def q_resume_predictions(spark, sf):
    """Prompts whose prediction is not finished yet (a keyed half is done)."""
    dp = _dp(spark, sf).select("conv_id", "prompt")
    from ..functions.keyed import keyed_uniform
    done = dp.filter(keyed_uniform(C.SEED, "done", "conv_id") < 0.5)
    done = G.batch_generate(done, "prompt", G.tail_echo_factory(16))
    return io.resume_predictions(dp, done, ["conv_id"])


@register("union_predictions", "WITH " + DP_SQL + " SELECT conv_id, right(prompt, 16) AS response FROM dp")
def q_union_predictions(spark, sf):
    """A resumed run: the unfinished half is generated and joined to the finished one."""
    from ..functions.keyed import keyed_uniform
    dp = _dp(spark, sf).select("conv_id", "prompt")
    run = lambda todo: G.batch_generate(todo, "prompt", G.tail_echo_factory(16))
    done = run(dp.filter(keyed_uniform(C.SEED, "done", "conv_id") < 0.5)).select("conv_id", "response")
    return io.resumed(dp, done, ["conv_id"], run).select("conv_id", "response")


@register("shard_rows", "SELECT conv_id, turn, CAST(floor((rn - 1) / 8) AS BIGINT) AS batch_index, "
          "CAST(floor((rn - 1) / 8) AS BIGINT) % 4 AS shard FROM "
          "(SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations)")
def q_shard_rows(spark, sf):
    return shard_rows(FX.conversations(spark, sf), ["conv_id", "turn"], 4, 8) \
        .select("conv_id", "turn", "batch_index", F.col("shard").cast("bigint").alias("shard"))


# ------------------------------------------------------------ filters

@register("holdout_last_turn",
          "SELECT c.conv_id, l.last AS target_turn, c.role AS target_role, c.text AS target, l.n - 1 AS context_turns "
          "FROM conversations c JOIN (SELECT conv_id, max(turn) AS last, count(*) AS n FROM conversations "
          "GROUP BY conv_id) l ON c.conv_id = l.conv_id AND c.turn = l.last")
def q_holdout_last_turn(spark, sf):
    ctx, tgt = R.holdout_last_turn(FX.conversations(spark, sf))
    n = ctx.groupBy("conv_id").agg(F.count(F.lit(1)).alias("context_turns"))
    return tgt.join(n, "conv_id", "left").select(
        "conv_id", F.col("turn").alias("target_turn"), F.col("role").alias("target_role"), F.col("text").alias("target"),
        F.coalesce("context_turns", F.lit(0)).cast("bigint").alias("context_turns"))


@register("drop_empty_pairs",
          "WITH p AS (SELECT conv_id, turn, " + sqlx.strip_markers("regexp_replace(text, '[\\p{L}\\p{N}_]+', '', 'g')")
          + " AS response, " + sqlx.strip_markers("text") + " AS target FROM conversations) "
          "SELECT conv_id, turn, response, target FROM p WHERE length(" + sqlx.trim_all("response")
          + ") > 0 AND length(" + sqlx.trim_all("target") + ") > 0")
def q_drop_empty_pairs(spark, sf):
    """Pairs whose response keeps only punctuation; pairs left blank are dropped."""
    c = FX.conversations(spark, sf)
    pairs = c.select("conv_id", "turn",
                     TX.strip_markers(F.regexp_replace("text", C.WORD_PATTERN, "")).alias("response"),
                     TX.strip_markers(F.col("text")).alias("target"))
    return M.drop_empty_pairs(pairs)


@register("mask_positive_labels", "SELECT doc_id, toxic AS pred, quality AS label FROM labels WHERE quality > 0")
def q_mask_positive_labels(spark, sf):
    lb = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("pred"), F.col("quality").alias("label"))
    return M.mask_positive_labels(lb, "label")


@register("preds_from_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) "
                               "AS pred, label FROM embeddings")
def q_preds_from_argmax(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", argmax_index("embedding").alias("pred"), "label")


@register("tag_correctness", "WITH " + SCORED_SQL + " SELECT p_partkey, array_to_string(ch, ',') AS choices, "
          f"CAST({_CORRECT_SQL} AS INTEGER) AS correctness FROM sc")
def q_tag_correctness(spark, sf):
    t = M.tag_correctness(FX.exam_replies(spark, sf))
    return t.select("p_partkey", F.array_join("choices", ",").alias("choices"), "correctness")


@register("extract_choices", "WITH " + FX.EXAM_REPLIES_SQL + " SELECT p_partkey, array_to_string("
          + sqlx.extract_choices("model_output") + ", ',') AS choices FROM replies")
def q_extract_choices(spark, sf):
    r = FX.exam_replies(spark, sf)
    return r.select("p_partkey", F.array_join(TX.extract_choices(F.col("model_output")), ",").alias("choices"))


# ------------------------------------------------------------ joins

@register("pair_predictions",
          "SELECT coalesce(r.conv_id, t.conv_id) AS conv_id, coalesce(r.turn, t.turn) AS turn, r.response, t.target, "
          "(r.response IS NOT NULL AND t.target IS NOT NULL) AS matched FROM "
          "(SELECT conv_id, turn, text AS response FROM conversations WHERE role = 'assistant') r FULL OUTER JOIN "
          "(SELECT conv_id, turn + 1 AS turn, text AS target FROM conversations WHERE role = 'user') t "
          "ON r.conv_id = t.conv_id AND r.turn = t.turn")
def q_pair_predictions(spark, sf):
    c = FX.conversations(spark, sf)
    resp = c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response"))
    tgt = c.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                   F.col("text").alias("target"))
    return M.pair_predictions(resp, tgt, ["conv_id", "turn"])


ZIP_SQL = (
    "q AS (SELECT conv_id, CAST(floor(turn / 2) AS BIGINT) AS idx, text FROM conversations WHERE role = 'user'), "
    "a AS (SELECT conv_id, CAST(floor(turn / 2) AS BIGINT) AS idx, text FROM conversations WHERE role = 'assistant'), "
    "j AS (SELECT coalesce(q.conv_id, a.conv_id) AS conv_id, coalesce(q.idx, a.idx) AS idx, q.text AS qt, a.text AS atx "
    "FROM q FULL OUTER JOIN a ON q.conv_id = a.conv_id AND q.idx = a.idx)")


@register("zip_qa", "WITH " + ZIP_SQL + " SELECT conv_id, idx * 2 AS turn, 'prompter' AS role, qt AS text, "
          "CAST(NULL AS VARCHAR) AS context FROM j WHERE qt IS NOT NULL UNION ALL "
          "SELECT conv_id, idx * 2 + 1, 'assistant', atx, 'psychology' FROM j WHERE atx IS NOT NULL")
def q_zip_qa(spark, sf):
    c = FX.conversations(spark, sf)
    q = c.filter(F.col("role") == "user").select("conv_id", F.floor(F.col("turn") / 2).cast("bigint").alias("idx"), "text")
    a = c.filter(F.col("role") == "assistant").select("conv_id", F.floor(F.col("turn") / 2).cast("bigint").alias("idx"),
                                                      "text")
    return R.zip_qa(q, a, F.lit("psychology"))


# ------------------------------------------------------------ rendering

@register("render_turns",
          f"SELECT conv_id, turn, {sqlx.marker('role')} || text || '{C.EOS}' AS piece, false AS is_reply "
          f"FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, '{C.DOCTOR}', true FROM conversations "
          "GROUP BY conv_id")
def q_render_turns(spark, sf):
    return R.render_turns(FX.conversations(spark, sf), add_reply=True)


@register("render_dialogue",
          f"SELECT conv_id, string_agg({sqlx.marker('role')} || text || '{C.EOS}', '' ORDER BY turn) AS text "
          "FROM conversations GROUP BY conv_id")
def q_render_dialogue(spark, sf):
    return R.render_dialogue(FX.conversations(spark, sf))


@register("system_prefix", f"SELECT conv_id, '{C.SYSTEM}' || text || '{C.EOS}' AS prefix FROM conversations "
                           "WHERE role = 'system'")
def q_system_prefix(spark, sf):
    c = FX.conversations(spark, sf).filter(F.col("role") == "system")
    return c.select("conv_id", TX.system_prefix(F.col("text")).alias("prefix"))


def _tag_sql(keys: list[str], text: str, string_props: dict, float_props: dict, dropout: float, seed: int) -> str:
    items = []

    def item(name, value, present, order, skip):
        drop = f"{sqlx.keyed(seed, 'drop:' + name, *keys)} < {dropout}"
        keep = f"({present}) AND NOT ({skip}) AND NOT ({drop})"
        return f"{{'o': {order}, 'f': CASE WHEN {keep} THEN '{name}: ' || {value} END}}"

    for name, col in string_props.items():
        skip = f"length({col}) > 0 AND length(regexp_replace({col}, '{C.STRIP_CLASS}', '', 'g')) = 0"
        items.append(item(name, col, f"{col} IS NOT NULL", sqlx.keyed(seed, "order:" + name, *keys), skip))
    for name, col in float_props.items():
        items.append(item(name, f"CAST(CAST(round(CAST(CAST(CAST({col} AS DOUBLE) AS VARCHAR) AS DECIMAL(18,6)), 1) AS DECIMAL(18,1)) AS VARCHAR)", f"{col} IS NOT NULL",
                          sqlx.keyed(seed, "order:" + name, *keys), "false"))
    items.append(item("length", f"CAST({sqlx.length_bucket(text)} AS VARCHAR)", "true",
                      sqlx.keyed(seed, "order:length", *keys), "false"))
    arr = "list_filter(list_transform(list_sort([" + ", ".join(items) + "]), lambda s: s.f), lambda f: f IS NOT NULL)"
    return (f"(CASE WHEN len({arr}) = 0 THEN '' ELSE '{C.SYSTEM}' || array_to_string({arr}, chr(10)) || chr(10) "
            f"|| '{C.EOS}' END)")


@register("system_tag", "SELECT d.doc_id, " + _tag_sql(["d.doc_id"], "d.text", {"lang": "d.lang"},
                                                        {"quality": "l.quality"}, 0.3, C.SEED)
          + " AS system_tag FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def q_system_tag(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id") \
        .select("doc_id", "text", "lang", F.col("quality").cast("double").alias("quality"))
    return R.system_tag(d, ["doc_id"], "text", dropout=0.3, add_length=True).select("doc_id", "system_tag")


SFT_SQL = (FX.TYPED_SQL + ", nxt AS (SELECT conv_id, turn - 1 AS turn, role AS next_role, text AS next_text, lang, "
           "quality FROM typed), tags AS (SELECT conv_id, turn, next_role, "
           + _tag_sql(["conv_id", "turn"], "next_text", {"lang": "lang"}, {"quality": "quality"}, 0.3, C.SEED)
           + " AS system_tag FROM nxt), pieces AS (SELECT t.conv_id, t.turn, CASE WHEN t.role = 'prompter' THEN "
           f"(CASE WHEN t.turn = 0 AND t.system_message IS NOT NULL AND length(t.system_message) > 0 THEN "
           f"'{C.SYSTEM}' || t.system_message || '{C.EOS}' ELSE '' END) || '{C.PATIENT}' || t.text || '{C.EOS}' || "
           f"(CASE WHEN g.next_role IS NOT NULL THEN g.system_tag ELSE '' END) ELSE '{C.DOCTOR}' || t.text || "
           f"'{C.EOS}' END AS piece FROM typed t LEFT JOIN tags g ON t.conv_id = g.conv_id AND t.turn = g.turn)")


@register("render_sft", "WITH " + SFT_SQL + " SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text "
                                            "FROM pieces GROUP BY conv_id")
def q_render_sft(spark, sf):
    pieces = R.render_sft(FX.typed_turns(spark, sf), use_system_tag=True, dropout=0.3, add_length=True)
    return R.concat_pieces(pieces, ["conv_id"], "turn", "piece", "text")


@register("length_bucket", f"SELECT doc_id, {sqlx.length_bucket('text')} AS length_bucket FROM documents")
def q_length_bucket(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.length_bucket(F.col("text")).alias("length_bucket"))


def _choice_prompt_sql() -> str:
    parts = [sqlx.lit(C.CHOICE_INSTRUCTION), "question"]
    for ch in C.CHOICES:
        parts += [sqlx.lit(f"\n{ch}. "), ch]
    parts.append(sqlx.lit(C.ANSWER_CUE))
    return " || ".join(parts)


@register("choice_prompt", "WITH " + FX.EXAM_SQL + f" SELECT p_partkey, {_choice_prompt_sql()} AS prompt FROM exam")
def q_choice_prompt(spark, sf):
    return R.choice_prompt(FX.exam(spark, sf)).select("p_partkey", "prompt")


@register("dialogue_prompt", "WITH " + DP_SQL + " SELECT conv_id, prompt, CAST(length(prompt) AS BIGINT) AS "
                                                "prompt_length, target, target_role FROM dp")
def q_dialogue_prompt(spark, sf):
    return _dp(spark, sf)


CASE_PROMPT_EXPR = (f"{sqlx.lit(C.CASE_INSTRUCTION)} || background || chr(10) || question || "
                    f"{sqlx.lit(C.ANSWER_CUE)}")


@register("case_prompt", "WITH " + FX.CASES_SQL + f", cp AS (SELECT doc_id, {CASE_PROMPT_EXPR} AS prompt, answer AS "
          "target FROM cases) SELECT doc_id, CAST(length(prompt) AS BIGINT) AS prompt_length, md5(prompt) AS "
          "prompt_md5, target FROM cp")
def q_case_prompt(spark, sf):
    cp = R.case_prompt(FX.cases(spark, sf))
    return cp.select("doc_id", F.length("prompt").cast("bigint").alias("prompt_length"),
                     F.md5("prompt").alias("prompt_md5"), "target")


@register("judge_prompt", "WITH " + FX.METRIC_PAIRS_SQL + " SELECT conv_id, turn, "
          f"replace(replace({sqlx.lit(C.DEFAULT_JUDGE_TEMPLATE)}, '[Answer]', target), '[Response]', response) "
          "AS content, 'user' AS role FROM pairs")
def q_judge_prompt(spark, sf):
    jp = R.judge_prompt(FX.metric_pairs(spark, sf))
    return jp.select("conv_id", "turn", F.col("messages")[0]["content"].alias("content"),
                     F.col("messages")[0]["role"].alias("role"))


def _reply_cleanup_sql(x: str) -> str:
    cut = f"split_part({x}, '<|', 1)"
    return f"regexp_replace(regexp_replace({cut}, '<.*?>', '', 'g'), '.*?>', '', 'g')"


@register("extract_reply", "WITH " + DP_SQL + ", gen AS (SELECT conv_id, prompt, length(prompt) AS n, "
          f"prompt || target || '{C.EOS}{C.PATIENT}' || 'next question' AS out FROM dp) "
          f"SELECT conv_id, {_reply_cleanup_sql('substr(out, n + 1)')} AS reply FROM gen")
def q_extract_reply(spark, sf):
    """Decoded outputs (prompt + answer + following turn) cut back to the answer."""
    dp = _dp(spark, sf)
    out = dp.withColumn("out", F.concat("prompt", "target", F.lit(C.EOS + C.PATIENT + "next question")))
    return out.select("conv_id", TX.extract_reply(F.col("out"), F.col("prompt_length")).alias("reply"))


@register("extract_reply_last", "WITH " + DP_SQL + ", gen AS (SELECT conv_id, prompt || ' ' || target || "
          f"'{C.EOS}' AS out FROM dp) SELECT conv_id, regexp_replace("
          + sqlx.trim_all(f"string_split(out, '{C.DOCTOR}')[-1]") + ", '<.*?>', '', 'g') AS reply FROM gen")
def q_extract_reply_last(spark, sf):
    dp = _dp(spark, sf)
    out = dp.withColumn("out", F.concat("prompt", F.lit(" "), "target", F.lit(C.EOS)))
    return out.select("conv_id", TX.extract_reply_last(F.col("out")).alias("reply"))


@register("extract_case_answer", "WITH " + FX.CASES_SQL + f", g AS (SELECT doc_id, {CASE_PROMPT_EXPR} || ' ' || "
          "answer || chr(10) AS out FROM cases) SELECT doc_id, "
          + sqlx.trim_all(f"string_split(out, {sqlx.lit(C.ANSWER_CUE)})[-1]") + " AS answer FROM g")
def q_extract_case_answer(spark, sf):
    cp = R.case_prompt(FX.cases(spark, sf))
    out = cp.withColumn("out", F.concat("prompt", F.lit(" "), "answer", F.lit("\n")))
    return out.select("doc_id", TX.extract_case_answer(F.col("out")).alias("answer"))


@register("strip_markers", f"SELECT conv_id, turn, "
          + sqlx.strip_markers(f"'{C.DOCTOR}' || {sqlx.lit(C.DOCTOR_COLON)} || ' ' || text || '{C.EOS}'")
          + " AS text FROM conversations")
def q_strip_markers(spark, sf):
    c = FX.conversations(spark, sf)
    raw = F.concat(F.lit(C.DOCTOR + C.DOCTOR_COLON + " "), F.col("text"), F.lit(C.EOS))
    return c.select("conv_id", "turn", TX.strip_markers(raw).alias("text"))


@register("trim_all", "WITH t AS (SELECT doc_id, " + sqlx.trim_all("chr(12288) || ' ' || text || chr(10) || chr(9)")
          + " AS s FROM documents) SELECT doc_id, CAST(length(s) AS BIGINT) AS n_chars, md5(s) AS text_md5 FROM t")
def q_trim_all(spark, sf):
    d = table(spark, sf, "documents")
    s = TX.trim_all(F.concat(F.lit("　 "), F.col("text"), F.lit("\n\t")))
    return d.select("doc_id", s.alias("s")).select("doc_id", F.length("s").cast("bigint").alias("n_chars"),
                                                   F.md5("s").alias("text_md5"))


# ------------------------------------------------------------ generation hooks

@register("batch_generate", "WITH " + DP_SQL + " SELECT conv_id, right(prompt, 16) AS response FROM dp")
def q_batch_generate(spark, sf):
    """Stand-in generator over every dialogue prompt, in Arrow batches."""
    out = G.batch_generate(_dp(spark, sf), "prompt", G.tail_echo_factory(16))
    return out.select("conv_id", "response")


class _FlakyJudge:
    """Fails on the first call of each partition, then scores by prompt length."""

    def __init__(self):
        self.calls = 0

    def __call__(self, prompts):
        self.calls += 1
        if self.calls == 1:
            raise TimeoutError("timeout")
        return [f"Score: {len(p) % 11}" for p in prompts]


@register("remote_score", "WITH " + FX.METRIC_PAIRS_SQL + ", jp AS (SELECT conv_id, turn, "
          f"replace(replace({sqlx.lit(C.DEFAULT_JUDGE_TEMPLATE)}, '[Answer]', target), '[Response]', response) "
          "AS content FROM pairs) SELECT conv_id, turn, 'Score: ' || CAST(length(content) % 11 AS VARCHAR) AS "
          "judge_reply FROM jp")
def q_remote_score(spark, sf):
    """Judge prompts sent through the retrying caller (a failing stand-in client)."""
    jp = R.judge_prompt(FX.metric_pairs(spark, sf)).select("conv_id", "turn", "content")
    out = G.remote_score(jp, "content", _FlakyJudge, retry_sleep=0.0)
    return out.select("conv_id", "turn", "judge_reply")


@register("tokenize_with", f"SELECT conv_id, turn, CAST(len({sqlx.tok('text')}) AS BIGINT) AS n_tokens, "
          f"md5(array_to_string({sqlx.tok('text')}, ' ')) AS tokens_md5 FROM conversations")
def q_tokenize_with(spark, sf):
    """The pluggable tokenizer hook with a Python regex tokenizer (same pattern)."""
    t = G.tokenize_with(FX.conversations(spark, sf), "text", G.regex_tokenizer_factory())
    return t.select("conv_id", "turn", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))
