"""Training-corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` starts
from the table ``documents``, writes each stage's rows as Parquet in the shared
folder and gives the next stage what it reads back.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colloquy.llm import decontam, mixing, quality, sharding, simhash  # noqa: E402
from colloquy.llm.common import count_words  # noqa: E402
from colloquy.session import materialize, prepare  # noqa: E402


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; bands come from the labelled ones among them."""
    prepare(spark)
    judged = quality.judge(docs, _table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*[F.col("rec")[c].alias(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that benchmark phrases cover; one of which no word is left goes."""
    prepare(spark)
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: every document as often as it is taken."""
    prepare(spark)
    mixed = mixing.mix_sources(docs, count_words(F.col("text")))
    return mixing.take_copies(mixed, docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shuffled order with ``shard`` and ``slot``."""
    prepare(spark)
    return sharding.external_shuffle(docs, sharding.text_bytes(F.col("text")))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

# The tokenizer, XXH64 and the seeded shuffles have no SQL form; tests/llm
# holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole table ``documents``."""
    prepare(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
