import pytest
"""Sources/sinks, the generation hook and the running-accuracy stream."""

import json


from colloquy.operators import generate as G
from colloquy.session import scratch_path
from colloquy.sources import io
from colloquy.streaming import run_running_accuracy, running_accuracy


def test_whole_document_dialogues(spark, tmp_path):
    doc = [[{"speaker": "patient", "content": "你好"}, {"speaker": "doctor", "content": "hi"}],
           [{"speaker": "patient", "content": "x"}]]
    p = tmp_path / "train.json"
    p.write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    t = io.read_dialogues(spark, str(p), whole_document=True).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role, r.text) for r in t] == [(0, 0, "patient", "你好"), (0, 1, "doctor", "hi"),
                                                                 (1, 0, "patient", "x")]


def test_exam_csv_quoted_newlines(spark, tmp_path):
    p = tmp_path / "test.csv"
    p.write_text('question,A,B,C,D,answer\n"line1\nline2","a ""q""",b,c,d,A\n', encoding="utf-8")
    r = io.read_exam_csv(spark, str(p)).collect()
    assert len(r) == 1 and r[0].question == "line1\nline2" and r[0].A == 'a "q"'


def test_template_whole_file(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("R=[Response]\nA=[Answer]\n", encoding="utf-8")
    assert io.read_template(spark, str(p)).first()["template"] == "R=[Response]\nA=[Answer]\n"


def test_resume_predictions_row_level(spark):
    inputs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, prompt string")
    done = spark.createDataFrame([(2, "B")], "id long, response string")
    assert sorted(r.id for r in io.resume_predictions(inputs, done, ["id"]).collect()) == [1, 3]


def test_batch_generate_retries_and_blank_on_failure(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "id long, prompt string").repartition(2)

    def always_fail():
        def f(prompts):
            raise TimeoutError("timeout")
        return f

    out = G.batch_generate(df, "prompt", always_fail, max_attempts=3).collect()
    assert all(r.response == "" and r.attempts >= 3 and "timeout" in r.error for r in out)
    ok = G.batch_generate(df, "prompt", G.tail_echo_factory(1)).collect()
    assert all(r.response == r.prompt[-1:] and r.error is None for r in ok)


def test_one_bad_prompt_loses_one_reply(spark):
    df = spark.createDataFrame([(i, "bad" if i == 7 else f"p{i}") for i in range(20)] + [(20, None)],
                               "id long, prompt string").coalesce(1)

    def picky():
        def f(prompts):
            if "bad" in prompts:
                raise ValueError("cannot answer")
            return [p.upper() for p in prompts]
        return f

    got = {r.id: r for r in G.batch_generate(df, "prompt", picky, max_attempts=2).collect()}
    assert sum(r.response == r.prompt.upper() for r in got.values() if r.prompt) == 19
    assert got[7].response == "" and "cannot answer" in got[7].error and got[3].error is None
    assert got[20].response is None and got[20].error == "null prompt"


def test_scratch_is_shared_and_released(spark):
    import os
    from colloquy import session as SE
    with pytest.raises(RuntimeError):
        SE.local_scratch("spark://host:7077")
    with pytest.raises(RuntimeError):
        SE.local_scratch("local-cluster[2,1,1024]")
    before = SE.written_tables()
    with SE.scratch(spark):
        n = SE.materialize(spark.range(5)).count()
        made = [p for p in SE.written_tables() if p not in before]
        assert n == 5 and made and os.path.isdir(made[0].removeprefix("file:"))
    assert SE.written_tables() == before and not os.path.exists(made[0].removeprefix("file:"))


def test_stream_final_state_equals_batch(spark):
    src = scratch_path(spark, "test-stream")
    rows = [(i % 4, i % 3, (i * 7) % 3 if i % 5 else -100) for i in range(400)]
    df = spark.createDataFrame(rows, "batch long, pred int, label int")
    df.repartition(4, "batch").write.parquet(src)
    s = run_running_accuracy(spark, src).collect()[0]
    b = running_accuracy(df).collect()[0]
    assert (s.right, s.total, s.accuracy) == (b.right, b.total, b.accuracy)
    assert b.total == sum(1 for r in rows if r[2] != -100)


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["conv_id", "prompt", "prompt_length", "target", "target_role"]
    assert df.count() > 0


def test_running_accuracy_by_batch_is_cumulative(spark):
    from colloquy.streaming import running_accuracy_by_batch

    rows = [(b, p, l) for b in range(3) for p, l in [(1, 1), (0, 1), (2, -100)]]
    df = spark.createDataFrame(rows, "batch long, pred int, label int")
    got = [(r.batch, r.right, r.total) for r in running_accuracy_by_batch(df).orderBy("batch").collect()]
    assert got == [(0, 1, 2), (1, 2, 4), (2, 3, 6)]


def test_split_roundtrip_prunes_partitions(spark):
    from colloquy.operators.batches import assign_split

    turns = spark.createDataFrame([(c, t, "user", f"x{c}") for c in range(50) for t in range(2)],
                                  "conv_id long, turn long, role string, text string")
    root = scratch_path(spark, "test-split")
    io.write_split(assign_split(turns, ["conv_id"], 0.3), root, prefix="p_")
    ev = io.read_split(spark, root, "eval", prefix="p_")
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split" in plan
    tr = io.read_split(spark, root, "train", prefix="p_")
    assert ev.count() + tr.count() == 100
    assert not set(r.conv_id for r in ev.collect()) & set(r.conv_id for r in tr.collect())


def test_dialogue_jsonl_roundtrip(spark):
    turns = spark.createDataFrame([(7, 1, "doctor", "b"), (7, 0, "patient", "a"), (9, 0, "patient", "z")],
                                  "conv_id long, turn long, role string, text string")
    path = scratch_path(spark, "test-jsonl")
    io.write_dialogues(turns, path)
    back = sorted(tuple(r) for r in io.read_dialogues(spark, path).collect())
    assert back == [(7, 0, "patient", "a"), (7, 1, "doctor", "b"), (9, 0, "patient", "z")]


def test_evaluate_dialogue_cuts_the_reply(spark):
    from colloquy.operators import evaluation as EV

    turns = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "hi, how are you")],
                                  "conv_id long, turn long, role string, text string")

    def factory():
        return lambda prompts: [p + "fine thanks</s><|patient|>bye" for p in prompts]

    pairs, report = EV.evaluate_dialogue(turns, factory)
    r = pairs.collect()[0]
    assert (r.response, r.target) == ("fine thanks", "hi, how are you")
    assert report.collect()[0].rouge_l is not None


def test_shards_written_and_read_per_worker(spark):
    from colloquy.operators.batches import shard_rows

    df = spark.range(0, 100).withColumnRenamed("id", "k")
    path = scratch_path(spark, "test-shards")
    io.write_shards(shard_rows(df, ["k"], 3, 4), path)
    got = {s: sorted(r.k for r in io.read_shard(spark, path, s).collect()) for s in range(3)}
    assert got[0][:4] == [0, 1, 2, 3] and got[1][:4] == [4, 5, 6, 7] and got[2][:4] == [8, 9, 10, 11]
    assert sum(len(v) for v in got.values()) == 100
