"""Stand-in inputs built from the test tables, with their SQL twins.

These only give rows in the schema an operator expects (pairs, exam rows,
model replies, logits, ranked candidates); they do none of the operators'
work.  Each Spark builder has a SQL CTE twin used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import tokenize
from . import sqlx
from .registry import table

LETTERS = ("A", "B", "C", "D")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


# -- pairs for text metrics: assistant turn vs the same tokens minus every fifth
def metric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = conversations(spark, sf).filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", F.col("text").alias("response"),
                    F.array_join(F.filter(tokenize(F.col("text")), lambda x, i: F.pmod(i, F.lit(5)) != 4), " ")
                    .alias("target"))


METRIC_PAIRS_SQL = (f"pairs AS (SELECT conv_id, turn, text AS response, "
                    f"array_to_string(list_filter({sqlx.tok('text')}, lambda x, i: i % 5 <> 0), ' ') AS target "
                    f"FROM conversations WHERE role = 'assistant')")


# -- single-choice exam rows from `part`
def exam(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return p.select(
        "p_partkey",
        F.concat(F.col("p_name"), F.lit("\nsize "), F.col("p_size").cast("string")).alias("question"),
        F.col("p_brand").alias("A"), F.col("p_type").alias("B"), F.col("p_size").cast("string").alias("C"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string").alias("D"),
        F.element_at(letters, (F.pmod(F.col("p_partkey"), F.lit(4)) + 1).cast("int")).alias("answer"))


EXAM_SQL = ("exam AS (SELECT p_partkey, p_name || chr(10) || 'size ' || CAST(p_size AS VARCHAR) AS question, "
            "p_brand AS A, p_type AS B, CAST(p_size AS VARCHAR) AS C, "
            "CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) AS D, "
            "['A','B','C','D'][p_partkey % 4 + 1] AS answer FROM part)")

# reply shapes: literal text and the letters L (a choice) and M (the next one)
REPLY_SHAPES = (
    ("L", "。因为题干如此"),
    ("选", "L"),
    ("我认为选", "L"),
    ("答案是", "L", "，答案是选项", "M"),
    ("答案为：", "L"),
    ("答案：　", "L"),
    ("",),
    ("正确的一项是", "L"),
    ("答案应该是:", "L", "。"),
    ("  答案: 选项 ", "L"),
    ("选项", "L", "是对的"),
    ("The answer is ", "L"),
)


def exam_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Exam rows with a ``model_output`` shaped by ``p_partkey % 12``."""
    e = exam(spark, sf)
    letters = F.array(*[F.lit(x) for x in LETTERS])
    k = F.col("p_partkey")
    lvar = F.element_at(letters, (F.pmod(F.floor(k / 12), F.lit(4)) + 1).cast("int"))
    mvar = F.element_at(letters, (F.pmod(F.floor(k / 12) + 1, F.lit(4)) + 1).cast("int"))
    expr = None
    for i, shape in enumerate(REPLY_SHAPES):
        parts = [lvar if s == "L" else mvar if s == "M" else F.lit(s) for s in shape]
        v = F.concat(*parts)
        cond = F.pmod(k, F.lit(len(REPLY_SHAPES))) == i
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return e.withColumn("model_output", expr)


def _reply_sql() -> str:
    n = len(REPLY_SHAPES)
    lv = "['A','B','C','D'][CAST(floor(p_partkey / 12) AS BIGINT) % 4 + 1]"
    mv = "['A','B','C','D'][(CAST(floor(p_partkey / 12) AS BIGINT) + 1) % 4 + 1]"
    whens = []
    for i, shape in enumerate(REPLY_SHAPES):
        parts = [lv if s == "L" else mv if s == "M" else sqlx.lit(s) for s in shape]
        whens.append(f"WHEN {i} THEN " + " || ".join(parts))
    return f"(CASE p_partkey % {n} " + " ".join(whens) + " END)"


EXAM_REPLIES_SQL = EXAM_SQL + f", replies AS (SELECT *, {_reply_sql()} AS model_output FROM exam)"


# -- logits: embeddings as 64-way logits, label as target, some ignored / masked
def logits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("logits"),
                    F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, F.lit(C.IGNORE_INDEX)).otherwise(F.col("label"))
                    .cast("int").alias("target"),
                    (F.pmod(F.col("vec_id"), F.lit(3)) != 0).alias("mask"))


LOGITS_SQL = ("lg AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS logits, "
              "CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END AS target, vec_id % 3 <> 0 AS mask FROM embeddings)")


# -- ranked candidates: turns of a conversation, earlier = preferred
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    c = conversations(spark, sf)
    return c.select("conv_id", F.col("turn").alias("rank"), (F.length("text") / 100.0).alias("score"))


RANKED_SQL = ("rk AS (SELECT conv_id, turn AS rank, CAST(length(text) AS DOUBLE) / 100.0 AS score FROM conversations), "
              "rp AS (SELECT a.conv_id, a.score AS pos, b.score AS neg FROM rk a JOIN rk b "
              "ON a.conv_id = b.conv_id AND a.rank < b.rank)")


def softplus_sql(d: str) -> str:
    return f"(greatest({d}, 0.0) + ln(1 + exp(-abs({d}))))"


# -- case questions from documents
def cases(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("text").alias("background"),
                    F.concat(F.lit("Which language is source "), F.col("source"), F.lit(" written in?")).alias("question"),
                    F.col("lang").alias("answer"))


CASES_SQL = ("cases AS (SELECT doc_id, text AS background, 'Which language is source ' || source || ' written in?' "
             "AS question, lang AS answer FROM documents)")


# -- typed conversations for the SFT renderer
def typed_turns(spark: SparkSession, sf: str) -> DataFrame:
    c = conversations(spark, sf)
    sm = c.filter(F.col("role") == "system").select("conv_id", F.col("text").alias("system_message"))
    t = c.filter(F.col("role") != "system").join(sm, "conv_id", "left")
    lang = (F.when(F.pmod(F.col("turn"), F.lit(3)) == 0, F.lit("en"))
            .when(F.pmod(F.col("turn"), F.lit(3)) == 1, F.lit("  ")).otherwise(F.lit("")))
    return t.select(
        "conv_id",
        (F.col("turn") - F.when(F.col("system_message").isNotNull(), 1).otherwise(0)).alias("turn"),
        F.when(F.col("role") == "user", "prompter").otherwise("assistant").alias("role"),
        "text", lang.alias("lang"),
        (F.pmod(F.length("text"), F.lit(20)).cast("double") / 20.0).alias("quality"),
        "system_message")


TYPED_SQL = ("sm AS (SELECT conv_id, text AS system_message FROM conversations WHERE role = 'system'), "
             "typed AS (SELECT c.conv_id, c.turn - CASE WHEN sm.system_message IS NOT NULL THEN 1 ELSE 0 END AS turn, "
             "CASE WHEN c.role = 'user' THEN 'prompter' ELSE 'assistant' END AS role, c.text, "
             "CASE c.turn % 3 WHEN 0 THEN 'en' WHEN 1 THEN '  ' ELSE '' END AS lang, "
             "CAST(length(c.text) % 20 AS DOUBLE) / 20.0 AS quality, sm.system_message "
             "FROM conversations c LEFT JOIN sm USING (conv_id) WHERE c.role <> 'system')")


# -- judge replies from conversation turns
def judge_replies(spark: SparkSession, sf: str) -> DataFrame:
    c = conversations(spark, sf).filter(F.col("role") == "assistant")
    k = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(4))
    reply = (F.when(k == 0, F.lit(""))
             .when(k == 1, F.concat(F.lit("Reasoning done. Score: "), F.pmod(F.length("text"), F.lit(11)).cast("string")))
             .when(k == 2, F.concat(F.lit("score：  "), (F.pmod(F.length("text"), F.lit(7)) + 0.5).cast("string")))
             .otherwise(F.lit("no number here")))
    return c.select("conv_id", "turn", reply.alias("judge_reply"))


JUDGE_SQL = ("jr AS (SELECT conv_id, turn, CASE (turn + conv_id) % 4 WHEN 0 THEN '' "
             "WHEN 1 THEN 'Reasoning done. Score: ' || CAST(length(text) % 11 AS VARCHAR) "
             "WHEN 2 THEN 'score：  ' || CAST(CAST(length(text) % 7 AS DOUBLE) + 0.5 AS VARCHAR) "
             "ELSE 'no number here' END AS judge_reply FROM conversations WHERE role = 'assistant')")
