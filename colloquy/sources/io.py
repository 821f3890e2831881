"""Readers and writers for dialogues, exams, templates and predictions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import read_csv_records, read_json_turns

TURN = T.StructType([T.StructField("speaker", T.StringType()), T.StructField("content", T.StringType())])
CHOICE_EXAM = T.StructType([T.StructField(c, T.StringType()) for c in ("question", "A", "B", "C", "D", "answer")])
CASE_QA = T.StructType([T.StructField(c, T.StringType()) for c in ("background", "question", "answer")])
NULL_TEXT = "\\N"  # how a missing value is spelled in CSV (an empty cell is an empty string)
CSV_OPTIONS = {"escape": '"', "nullValue": NULL_TEXT}
PREDICTION = T.StructType([T.StructField("id", T.LongType()), T.StructField("response", T.StringType()),
                           T.StructField("target", T.StringType())])


def read_dialogues(spark: SparkSession, path: str, whole_document: bool = False, fields: T.StructType | None = None,
                   range_bytes: int | None = None, file_col: str | None = None) -> DataFrame:
    """Dialogues → long turns ``(conv_id, turn, role, text)`` and the other ``fields`` of a turn.

    Default: JSON lines, one ``{"conv_id", "dialogue": [{speaker, content}]}``
    per line.  ``whole_document``: one JSON list of dialogues per file, as the
    original stores it; a file is read in byte ranges by many tasks
    (``sources/ranges.py``), every ``range_bytes`` or, if not given, as the
    session cuts its files.  Dialogues are numbered by position in their file,
    which ``file_col`` names in a column of its own.  ``fields`` (``speaker``
    and ``content`` if not given) says which keys of a turn are read and as
    what; keys it does not name are ignored, those a turn lacks are null.
    """
    turn = fields or TURN
    named = [F.col("t.speaker").alias("role"), F.col("t.content").alias("text"),
             *[F.col(f"t.`{f.name}`").alias(f.name) for f in turn.fields if f.name not in ("speaker", "content")]]
    file = [F.col("file").alias(file_col)] if file_col else []
    if whole_document:
        turns = read_json_turns(spark, path, range_bytes)
        return turns.select("file", F.col("conv").alias("conv_id"), "turn", F.from_json("body", turn).alias("t")) \
            .select(*file, "conv_id", "turn", *named)
    line = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("dialogue", T.ArrayType(turn))])
    convs = spark.read.schema(line).json(path).select(F.col("_metadata.file_path").alias("file"), "conv_id", "dialogue")
    return convs.select("file", "conv_id", F.posexplode("dialogue").alias("turn", "t")) \
        .select(*file, "conv_id", F.col("turn").cast("bigint").alias("turn"), *named)


def write_dialogue_documents(turns: DataFrame, path: str, files: int, extra: list[str] | None = None) -> None:
    """Long turns → ``files`` files at most, each one JSON list of dialogues, in order of ``conv_id`` and ``turn``.

    Every object holds speaker, content and the columns ``extra``.  Rows are
    streamed in order, so no dialogue is held in memory whole.
    """
    body = F.to_json(F.struct(F.col("role").alias("speaker"), F.col("text").alias("content"), *(extra or [])),
                     {"ignoreNullFields": "false"})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            lines = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines.append(("," if conv == last else "],[" if last is not None else "[[") + text)
                last = conv
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(["]]"])], names=["value"])

    ordered = turns.repartitionByRange(files, "conv_id").sortWithinPartitions("conv_id", "turn")
    ordered.select("conv_id", body.alias("body")).mapInArrow(listed, "value string").write.mode("overwrite").text(path)


def write_dialogues(turns: DataFrame, path: str) -> None:
    """Long turns → JSON lines, one dialogue per line, turns in order."""
    d = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("speaker"),
                                                               F.col("text").alias("content")).alias("t")))).alias("a"))
    d.select("conv_id", F.transform("a", lambda x: x["t"]).alias("dialogue")).write.mode("overwrite").json(path)


def write_split(df: DataFrame, root: str, prefix: str = "") -> str:
    """Write a table partitioned by ``split`` under ``root/{prefix}dialogues``."""
    path = f"{root.rstrip('/')}/{prefix}dialogues"
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def read_split(spark: SparkSession, root: str, split: str = "train", prefix: str = "") -> DataFrame:
    """Read one split; the ``split`` filter prunes partitions at the scan."""
    path = f"{root.rstrip('/')}/{prefix}dialogues"
    return spark.read.parquet(path).filter(F.col("split") == split)


def read_exam_csv(spark: SparkSession, path: str, kind: str = "choice", range_bytes: int | None = None) -> DataFrame:
    """Exam CSV with header and quoted newlines, declared all-string schema.

    A file is read in byte ranges by many tasks, quoted newlines or not
    (``sources/ranges.py``), every ``range_bytes`` or, if not given, as the
    session cuts its files; rows are those of ``csv_reader``, which needs a
    task a file.
    """
    schema = CHOICE_EXAM if kind == "choice" else CASE_QA
    records = read_csv_records(spark, path, range_bytes)
    return records.select(F.from_csv("record", ", ".join(f"`{f.name}` string" for f in schema.fields), CSV_OPTIONS).alias("r")).select("r.*")


def csv_reader(spark: SparkSession):
    """CSV reader matching ``write_scored_csv``: quoted newlines, '' stays ''."""
    return spark.read.option("header", True).option("multiLine", True).options(**CSV_OPTIONS)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """A whole text file as one ``template`` string."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("template"))


def write_predictions(df: DataFrame, path: str) -> None:
    """``(id, response, target)`` as JSON lines (non-ASCII kept as is)."""
    df.select("id", "response", "target").write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def write_scored_csv(df: DataFrame, path: str) -> None:
    """Exam columns + ``model_output`` + ``correctness`` as CSV with header."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("nullValue", NULL_TEXT).csv(path))


def write_shards(df: DataFrame, path: str) -> None:
    """Rows with a ``shard`` column (``shard_rows``) written one folder per shard."""
    df.write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One worker's shard; the filter prunes the other shard folders at the scan."""
    return spark.read.parquet(path).filter(F.col("shard") == shard)


def resume_predictions(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``inputs`` that have no finished prediction yet (row-level resume)."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def resumed(inputs: DataFrame, done: DataFrame | None, keys: list[str], run) -> DataFrame:
    """Finished predictions together with those of the rows that are still open.

    ``run`` gets the open rows of ``inputs`` and returns rows with the columns
    of ``done``.  Several finished rows of one key count as one (the least).
    """
    if done is None:
        return run(inputs)
    new = run(resume_predictions(inputs, done, keys))
    rest = [c for c in done.columns if c not in keys]
    once = done.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else done.distinct()
    return once.unionByName(new.select(*done.columns))
