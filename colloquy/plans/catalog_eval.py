"""Registered queries: the evaluation flows end to end (stand-in models)."""

from __future__ import annotations

from .. import constants as C
from ..operators import evaluation as EV
from ..operators import generate as G
from . import fixtures as FX
from . import metric_sql, sqlx
from .catalog_text import CASE_PROMPT_EXPR, DP_SQL, _choice_prompt_sql
from .registry import register

_OUT = (f"{sqlx.trim_all('prompt || substr(' + chr(39) + 'ABCD' + chr(39) + ', CAST(length(prompt) % 4 + 1 AS INTEGER), 1)')}")
EVAL_CHOICE_SQL = (FX.EXAM_SQL + f", ep AS (SELECT *, {_choice_prompt_sql()} AS prompt FROM exam), "
                   f"eo AS (SELECT *, {_OUT} AS model_output FROM ep), "
                   f"ec AS (SELECT *, {sqlx.extract_choices(sqlx.trim_all('model_output'))} AS ch FROM eo), "
                   "et AS (SELECT *, CASE WHEN len(ch) > 0 AND ch[-1] = answer THEN 1 ELSE 0 END AS correctness FROM ec)")


@register("evaluate_choice", "WITH " + EVAL_CHOICE_SQL + " SELECT answer, count(*) AS n, "
          "round(100.0 * sum(correctness) / count(*), 6) AS accuracy FROM et GROUP BY answer")
def q_evaluate_choice(spark, sf):
    """Exam prompts → stand-in model → answer extraction → correctness → accuracy per answer letter."""
    _, acc = EV.evaluate_choice(FX.exam(spark, sf), G.letter_by_length_factory(), ["answer"])
    return acc


_REST = f"right(prompt, 24) || {sqlx.lit(C.EOS + C.PATIENT)}"
_REPLY = sqlx.trim_all(f"regexp_replace(regexp_replace(split_part({_REST}, '<|', 1), '<.*?>', '', 'g'), '.*?>', '', 'g')")
EVAL_DIALOGUE_SQL = ("WITH RECURSIVE " + DP_SQL + f", pr AS (SELECT conv_id, {_REPLY} AS response, target FROM dp), "
                     + metric_sql.ctes("pr", "conv_id") + metric_sql.REPORT)


@register("evaluate_dialogue", EVAL_DIALOGUE_SQL)
def q_evaluate_dialogue(spark, sf):
    """Dialogue prompts → stand-in chat model → reply cut from the decoded output → generation report."""
    _, report = EV.evaluate_dialogue(FX.conversations(spark, sf), G.echo_reply_factory())
    return report


_DECODED = "prompt || ' ' || substr(prompt, length(prompt) // 2 + 1, length(prompt) % 13)"
_RESP = sqlx.trim_all(f"string_split({_DECODED}, {sqlx.lit(C.ANSWER_CUE)})[-1]")
EVAL_CASE_SQL = (FX.CASES_SQL + f", cp AS (SELECT doc_id, {CASE_PROMPT_EXPR} AS prompt, answer AS target FROM cases), "
                 f"cr AS (SELECT doc_id, {_RESP} AS response, target FROM cp), "
                 f"cj AS (SELECT doc_id, replace(replace({sqlx.lit(C.DEFAULT_JUDGE_TEMPLATE)}, '[Answer]', target), "
                 "'[Response]', response) AS content FROM cr)")


def _case_factory():
    """Stand-in case model: decoded prompt + a slice from the middle of the prompt."""
    def make():
        return lambda prompts: [p + " " + p[len(p) // 2:len(p) // 2 + len(p) % 13] for p in prompts]
    return make


@register("evaluate_case", "WITH " + EVAL_CASE_SQL + " SELECT count(*) AS n, count(*) AS n_scored, "
          "round(avg(CAST(length(content) % 11 AS DOUBLE)), 6) AS mean_score FROM cj")
def q_evaluate_case(spark, sf):
    """Case prompts → stand-in model → answer after the last cue → judge prompt → stand-in judge → mean score."""
    _, mean = EV.evaluate_case(FX.cases(spark, sf), ["doc_id"], _case_factory(), G.length_judge_factory())
    return mean
