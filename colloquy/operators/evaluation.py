"""The three evaluation flows, composed from the operators.

* single-choice exams: prompt → generate → extract choices → correctness →
  accuracy (and the scored rows for ``write_scored_csv``);
* dialogues: prompt from all but the last turn → generate → cut the reply out
  of the decoded output → pair with the held-out turn → generation report;
* case questions: prompt → generate → answer after the last cue → judge prompt
  → judge call → mean score.

``factory`` / ``judge_factory`` follow ``batch_generate``: called once per
partition on the executors, returning ``list[str] -> list[str]``.  Decoded
outputs include the prompt, as a causal model's do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import extract_case_answer, extract_reply, extract_reply_last, trim_all
from ..session import materialize
from ..sources.io import read_predictions, resumed, write_predictions, write_scored_csv
from .generate import batch_generate, remote_score
from .metrics import choice_accuracy, generation_report, mean_judge_score, tag_correctness
from .render import case_prompt, choice_prompt, dialogue_prompt, judge_prompt


def evaluate_choice(exam: DataFrame, factory, by: list[str] | None = None,
                    save_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(scored rows, accuracy)``; scored rows carry ``model_output`` and ``correctness``.

    ``save_to`` writes the scored rows as CSV (``write_scored_csv``).
    """
    p = choice_prompt(exam)
    out = batch_generate(p, "prompt", factory, out="model_output")
    scored = tag_correctness(out.withColumn("model_output", trim_all(F.col("model_output"))))
    if save_to is not None:
        scored = materialize(scored, "scored")
        write_scored_csv(scored.drop("choices", "prompt", "error", "attempts"), save_to)
    return scored, choice_accuracy(scored, by)


def evaluate_dialogue(turns: DataFrame, factory, by: list[str] | None = None, parser: str = "prompt",
                      done: DataFrame | None = None, save_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(pairs (conv_id, response, target), report)``.

    ``parser`` cuts the reply out of the decoded output: ``prompt`` after the
    prompt's characters, ``last`` after the last doctor marker.  ``done`` has
    finished pairs, which are not generated again; ``save_to`` writes the pairs
    as predictions (``read_predictions``) before they are scored.
    """
    parsers = {"prompt": lambda: extract_reply(F.col("decoded"), F.col("prompt_length")),
               "last": lambda: extract_reply_last(F.col("decoded"))}
    if parser not in parsers:
        raise ValueError(f"unknown reply parser {parser}")

    def run(prompts: DataFrame) -> DataFrame:
        out = batch_generate(prompts, "prompt", factory, out="decoded")
        return out.select("conv_id", trim_all(parsers[parser]()).alias("response"), F.col("target"))

    pairs = resumed(dialogue_prompt(turns), done, ["conv_id"], run)
    if save_to is not None:
        write_predictions(pairs.withColumnRenamed("conv_id", "id"), save_to)
        pairs = read_predictions(turns.sparkSession, save_to).withColumnRenamed("id", "conv_id")
    return pairs, generation_report(pairs, ["conv_id"], by=by)


def evaluate_case(cases: DataFrame, keys: list[str], factory, judge_factory,
                  template: str = C.DEFAULT_JUDGE_TEMPLATE, retry_sleep: float = 0.0,
                  done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(judged rows, mean score)``; ``done`` has finished rows (keys, response, target)."""
    def run(prompts: DataFrame) -> DataFrame:
        out = batch_generate(prompts, "prompt", factory, out="decoded")
        return out.select(*keys, extract_case_answer(F.col("decoded")).alias("response"), F.col("target"))

    pairs = resumed(case_prompt(cases), done, keys, run)
    jp = judge_prompt(pairs, template).select(*keys, "response", "target", "content")
    judged = remote_score(jp, "content", judge_factory, retry_sleep=retry_sleep)
    return judged, mean_judge_score(judged)
