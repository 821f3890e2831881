"""Resume and save in the evaluation flows, null texts, stream state, piece positions."""

import pytest
from pyspark.sql import functions as F

from colloquy import constants as C
from colloquy.operators import evaluation as EV
from colloquy.operators import generate as G
from colloquy.operators import render as R
from colloquy.operators import sequences as S
from colloquy.operators import tokens as TK
from colloquy.session import materialize, scratch_path
from colloquy.sources import io
from colloquy.streaming.accuracy import running_accuracy, run_running_accuracy

TURNS = "conv_id long, turn long, role string, text string"


def test_resumed_keeps_finished_rows_and_asks_for_the_rest(spark):
    inputs = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "k long, prompt string")
    done = spark.createDataFrame([(1, "old"), (1, "older"), (4, "old")], "k long, response string")
    asked = []

    def run(todo):
        asked.append(sorted(r.k for r in todo.collect()))
        return G.batch_generate(todo, "prompt", G.tail_echo_factory(1))

    got = {r.k: r.response for r in io.resumed(inputs, done, ["k"], run).collect()}
    assert asked == [[0, 2, 3, 5]] and got == {0: "0", 1: "old", 2: "2", 3: "3", 4: "old", 5: "5"}
    assert io.resumed(inputs, None, ["k"], run).count() == 6


def test_dialogue_flow_resumes_saves_and_picks_the_parser(spark, tmp_path):
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"t{c}{t}") for c in (1, 2)
                                   for t in range(2)], TURNS)
    done = spark.createDataFrame([(1, "kept", "t11")], "conv_id long, response string, target string")
    path = str(tmp_path / "pred")

    def factory():
        return lambda prompts: [p + "first</s>" + C.DOCTOR + " second " for p in prompts]

    pairs, report = EV.evaluate_dialogue(turns, factory, done=done, save_to=path)
    assert {(r.conv_id, r.response) for r in pairs.collect()} == {(1, "kept"), (2, "first")}
    assert io.read_predictions(spark, path).count() == 2 and report.count() == 1
    last, _ = EV.evaluate_dialogue(turns, factory, parser="last")
    assert {r.response for r in last.collect()} == {"second"}
    with pytest.raises(ValueError):
        EV.evaluate_dialogue(turns, factory, parser="none")


def test_choice_flow_saves_scored_rows(spark, tmp_path):
    exam = spark.createDataFrame([("q", "a", "b", "c", "d", "A")],
                                 "question string, A string, B string, C string, D string, answer string")
    path = str(tmp_path / "scored")
    scored, acc = EV.evaluate_choice(exam, G.letter_by_length_factory(), save_to=path)
    back = io.csv_reader(spark).csv(path).collect()
    assert scored.count() == 1 and len(back) == 1 and {"model_output", "correctness"} <= set(back[0].asDict())


def test_null_text_renders_as_empty(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "user", None)], TURNS)
    text = {r.conv_id: r.text for r in R.render_dialogue(turns).collect()}
    assert text == {1: f"{C.PATIENT}a{C.EOS}{C.DOCTOR}{C.EOS}", 2: f"{C.PATIENT}{C.EOS}"}
    p = {r.conv_id: (r.prompt, r.target) for r in R.dialogue_prompt(turns, instruction="I:").collect()}
    assert p == {1: (f"I:{C.PATIENT}a{C.EOS}{C.DOCTOR}", None), 2: (f"I:{C.DOCTOR}", None)}
    assert {(r.conv_id, r.n) for r in R.null_texts(turns).collect()} == {(1, 1), (2, 1)}


def test_stream_state_carries_over_and_starts_empty(spark, tmp_path):
    src, state = str(tmp_path / "in"), scratch_path(spark, "state")
    schema = "batch long, pred int, label int"
    first = spark.createDataFrame([(0, 1, 1), (0, 2, 1)], schema)
    (tmp_path / "in").mkdir()
    none = run_running_accuracy(spark, src).collect()[0]
    assert (none.total, none.accuracy) == (0, None)
    first.coalesce(1).write.mode("append").parquet(src)
    assert run_running_accuracy(spark, src, state_path=state).collect()[0].total == 2
    second = spark.createDataFrame([(1, 3, 3), (1, 3, -100)], schema)
    second.coalesce(1).write.mode("append").parquet(src)
    got = run_running_accuracy(spark, src, state_path=state, files_per_trigger=1).collect()[0]
    want = running_accuracy(first.unionByName(second)).collect()[0]
    assert (got.right, got.total, got.accuracy) == (want.right, want.total, want.accuracy)
    assert run_running_accuracy(spark, src, state_path=state).collect()[0].total == 3


def test_piece_positions_equal_the_whole_dialogue(spark):
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"w{t} {C.PATIENT} x") for c in range(3)
                                   for t in range(c + 1)], TURNS)
    pieces = materialize(S.piece_tokens(turns))
    got = {(r.conv_id, r.pos): (r.token, r.msg_index) for r in S.piece_positions(pieces).collect()}
    from colloquy.functions.text import tokenize
    whole = R.render_dialogue(turns).select("conv_id", tokenize(F.col("text")).alias("t")).collect()
    for row in whole:
        n = -1
        for pos, token in enumerate(row.t):
            n += token in (C.PATIENT, C.DOCTOR)
            assert got.pop((row.conv_id, pos)) == (token, n)
    assert not got


def test_prompt_target_batches_shapes(spark):
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", "a b c " * (c + t + 1)) for c in range(9)
                                   for t in range(3)], TURNS)
    vocab = TK.build_vocab(S.prompt_target_tokens(turns), "src")
    b = S.prompt_target_batches(turns, vocab, 48, 24, batch_size=4, pad_multiple=8).collect()
    assert len(b) == 9 and max(r.batch_id for r in b) == 2
    for r in b:
        assert len(r.input_ids) == len(r.labels) == len(r.label_mask) <= 48 and len(r.input_ids) % 8 == 0
        assert all((x != C.IGNORE_INDEX) == m for x, m in zip(r.labels, r.label_mask))


def test_chain_with_prefix_packing_and_typed_input(spark):
    typed = spark.createDataFrame([(c, t, "prompter" if t % 2 == 0 else "assistant", "a b c " * (c % 5 + 1), "en")
                                   for c in range(40) for t in range(2)], TURNS + ", lang string")
    pieces = materialize(S.tokenize_pieces(R.render_sft(typed, use_system_tag=True, dropout=0.0)))
    vocab = TK.build_vocab(pieces, "toks")
    plain = S.dialogue_batches(pieces, vocab, 64, 8, pad_multiple=1).collect()
    packed = S.dialogue_batches(pieces, vocab, 64, 8, pad_multiple=1, prefix_ids=[5, 2], pack=True).collect()
    assert len(plain) == 40 and len(packed) < 40 and any(r.packed for r in packed)
    for r in packed:
        assert r.input_ids[:2] == [5, 2] and not any(r.label_mask[:2])
        assert sum(r.attention_mask) <= 64 and len(r.input_ids) == len(r.label_mask) == len(r.targets)
    # packing keeps all tokens of sequences that fit
    used = lambda rows, k: sum(sum(r.attention_mask) - k for r in rows)
    assert used(packed, 2) <= used(plain, 0) and used(packed, 2) > 0


def test_size_checked_broadcast_changes_no_result(spark):
    from colloquy.session import broadcast_if_small

    left = spark.createDataFrame([(i % 7, i) for i in range(50)], "k long, v long")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "k long, name string")
    hinted, plain = (left.join(broadcast_if_small(right, limit), "k", "left") for limit in (5, 4))
    assert "BroadcastExchange" in hinted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, hinted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
