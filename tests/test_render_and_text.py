"""Golden cases for rendering and string operators (hand-derived)."""

from pyspark.sql import functions as F

from colloquy import constants as C
from colloquy.functions import text as TX
from colloquy.operators import render as R


def turns_df(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_render_turns_with_reply(spark):
    t = turns_df(spark, [(1, 0, "patient", "a"), (1, 1, "doctor", "b")])
    out = R.render_turns(t, add_reply=True).orderBy("turn").select("piece").collect()
    assert [r[0] for r in out] == ["<|patient|>a</s>", "<|doctor|>b</s>", "<|doctor|>"]


def test_render_compat_system_is_doctor(spark):
    t = turns_df(spark, [(1, 0, "system", "s"), (1, 1, "patient", "a")])
    out = R.render_turns(t, compat=True).orderBy("turn").select("piece").collect()
    assert out[0][0] == "<|doctor|>s</s>"
    default = R.render_turns(t).orderBy("turn").select("piece").collect()
    assert default[0][0] == "<|system|>s</s>"


def test_render_dialogue_two_level_order(spark):
    # more turns than one block: order must survive the two-level concat
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(2500)]
    t = turns_df(spark, rows).repartition(7)
    got = R.render_dialogue(t).collect()[0]["text"]
    want = "".join((C.PATIENT if i % 2 == 0 else C.DOCTOR) + str(i) + C.EOS for i in range(2500))
    assert got == want


def test_zip_qa_and_sft_without_tags(spark):
    q = spark.createDataFrame([(1, 0, "Q1"), (1, 1, "Q2")], "conv_id long, idx long, text string")
    a = spark.createDataFrame([(1, 0, "A1"), (1, 1, "A2")], "conv_id long, idx long, text string")
    turns = R.zip_qa(q, a)
    pieces = R.render_sft(turns, use_system_tag=True, dropout=0.0, add_length=False)
    text = R.concat_pieces(pieces, ["conv_id"], "turn", "piece").collect()[0]["text"]
    assert text == "<|patient|>Q1</s><|doctor|>A1</s><|patient|>Q2</s><|doctor|>A2</s>"


def test_zip_qa_longest_wins_and_list_answers(spark):
    q = spark.createDataFrame([(1, 0, "Q1"), (1, 1, "Q2")], "conv_id long, idx long, text string")
    a = spark.createDataFrame([(1, 0, ["A1", "x"])], "conv_id long, idx long, text array<string>")
    out = R.zip_qa(q, a).orderBy("turn").collect()
    assert [(r.role, r.text) for r in out] == [("prompter", "Q1"), ("assistant", "A1"), ("prompter", "Q2")]


def test_length_bucket(spark):
    df = spark.createDataFrame([("",), ("one two three four",), ("one two three four five",), ("你好 ab cd",)], "s string")
    got = [r[0] for r in df.select(TX.length_bucket(F.col("s"))).collect()]
    assert got == [1, 1, 2, 1]


def test_system_tag_cases(spark):
    df = spark.createDataFrame(
        [(1, "t", "en", 1.0, "c"), (2, "t", "  ", None, None), (3, "t", None, None, None)],
        "k long, text string, lang string, quality double, context string")
    out = {r.k: r.system_tag for r in R.system_tag(df, ["k"], dropout=0.0, add_length=False).collect()}
    assert out[1].startswith(C.SYSTEM) and out[1].endswith("context: c\n" + C.EOS)
    body = out[1][len(C.SYSTEM):].split("\n")
    assert sorted(body[:2]) == ["lang: en", "quality: 1.0"] and body[2] == "context: c"
    assert out[2] == "" and out[3] == ""


def test_extract_choices_table(spark):
    cases = [("A。因为…", ["A"]), ("选B", ["B"]), ("我认为选C", []), ("答案是A，答案是选项B", ["A", "B"]),
             ("答案为：D", ["D"]), ("答案：　D", ["D"]), ("", [])]
    df = spark.createDataFrame([(c,) for c, _ in cases], "s string")
    got = [r[0] for r in df.select(TX.extract_choices(F.col("s"))).collect()]
    assert got == [w for _, w in cases]


def test_reply_extraction(spark):
    df = spark.createDataFrame([("PROMPThello<|patient|>x",), ("PROMPThi<b>you",), ("PROMPTa>b",)], "s string")
    got = [r[0] for r in df.select(TX.extract_reply(F.col("s"), 6)).collect()]
    assert got == ["hello", "hiyou", "b"]
    one = spark.createDataFrame([("x<|doctor|>a<|doctor|> b</s>", "q\n答案：one\n答案： two ", "<|doctor|>doctor： hi ")],
                                "a string, b string, c string")
    r = one.select(TX.extract_reply_last(F.col("a")), TX.extract_case_answer(F.col("b")),
                   TX.strip_markers(F.col("c"))).collect()[0]
    assert tuple(r) == ("b", "two", "hi")


def test_judge_prompt_literal(spark):
    df = spark.createDataFrame([("x", "$1")], "response string, target string")
    got = R.judge_prompt(df, "R=[Response];A=[Answer]").collect()[0]
    assert got.content == "R=x;A=$1"
    assert got.messages[0].role == "user"


def test_trim_all_matches_python_strip(spark):
    samples = ["　 a b \n\t", "\x1c\x85x\x1f", "  ", "y"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(TX.trim_all(F.col("s"))).collect()]
    assert got == [s.strip() for s in samples]


def test_holdout_requires_target_role(spark):
    t = turns_df(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q2")])
    ctx, tgt = R.holdout_last_turn(t, require_target_role="assistant")
    assert [r.conv_id for r in tgt.collect()] == [1] and [r.turn for r in ctx.collect()] == [0]


def test_system_tag_dropout_is_keyed_and_near_rate(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("k"), F.lit("t").alias("text"), F.lit("en").alias("lang"))
    a = R.system_tag(df, ["k"], dropout=0.3, add_length=False).collect()
    b = R.system_tag(df.repartition(7), ["k"], dropout=0.3, add_length=False).collect()
    assert {r.k: r.system_tag for r in a} == {r.k: r.system_tag for r in b}
    kept = sum(1 for r in a if r.system_tag) / len(a)
    assert 0.65 < kept < 0.75
