"""Plan shape checks: the shuffles and pushdowns the operators are designed around."""

from pyspark.sql import functions as F

from colloquy.operators import metrics as M
from colloquy.operators import render as R
from colloquy.operators import tokens as TK

CONV = "/root/testdata/sf0.001/conversations.parquet"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    p = plan(df)
    return p.count("Exchange hashpartitioning") + p.count("Exchange rangepartitioning") + \
        p.count("Exchange SinglePartition") + p.count("Exchange RoundRobinPartitioning")


def test_dialogue_prompt_two_shuffles_no_join(spark):
    df = R.dialogue_prompt(spark.read.parquet(CONV))
    p = plan(df)
    assert exchanges(df) == 2 and "Join" not in p


def test_filter_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(CONV).filter(F.col("role") == "assistant").select("conv_id", "text")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,assistant)" in p
    assert "ReadSchema: struct<conv_id:bigint,role:string,text:string>" in p


def test_bleu_counts_shuffle_pairs_once(spark):
    pairs = spark.read.parquet(CONV).select("conv_id", "turn", F.split("text", " ").alias("h"),
                                            F.split("text", ",").alias("r"))
    m = M.ngram_match_counts(pairs, ["conv_id", "turn"], "h", "r", 4)
    assert exchanges(m) == 1


def test_bleu_counts_hold_no_table_of_a_partitions_ngrams(spark):
    pairs = spark.read.parquet(CONV).select("conv_id", "turn", F.split("text", " ").alias("h"),
                                            F.split("text", ",").alias("r"))
    p = plan(M.ngram_match_counts(pairs, ["conv_id", "turn"], "h", "r", 4)).replace("ObjectHashAggregate", "")
    assert "HashAggregate" not in p and "ngram" not in p


def test_ngram_counts_combine_parts_of_bounded_size(spark, monkeypatch):
    rows = [(i % 2, [str(i % k) for k in range(1, 12)]) for i in range(300)] + [(0, None), (1, [])]
    df = spark.createDataFrame(rows, "b int, tokens array<string>")
    few = M.ngram_counts(df, "tokens", (1, 2), ["b"])
    monkeypatch.setattr(M, "NGRAMS_A_TASK", 150)
    many = M.ngram_counts(df, "tokens", (1, 2), ["b"])
    parts = 300 * 11 * 2 // 150
    assert f", {parts}), REPARTITION_BY_NUM" in plan(many) and f", {parts}), REPARTITION_BY_NUM" not in plan(few)
    got = sorted(tuple(r) for r in many.collect())
    assert got == sorted(tuple(r) for r in few.collect()) and sum(r[3] for r in got) == 300 * (11 + 10)


def test_encoding_is_relational(spark):
    toks = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "k long, toks array<string>")
    vocab = spark.createDataFrame([("a", 9), ("b", 10)], "token string, token_id bigint")
    p = plan(TK.encode_array(toks, "toks", vocab, "ids"))
    assert "Python" not in p and "Pandas" not in p and "Join" in p


def test_render_dialogue_two_level(spark):
    df = R.render_dialogue(spark.read.parquet(CONV))
    assert exchanges(df) == 2


def test_prep_chain_shuffles_cut_tokens_once_by_batch(spark):
    from colloquy.operators import sequences as S
    from colloquy.session import materialize

    pieces = materialize(S.piece_tokens(spark.read.parquet(CONV)))
    vocab = TK.build_vocab(pieces, "toks")
    b = S.dialogue_batches(pieces, vocab, max_length=64, batch_size=4)
    b.write.format("noop").mode("overwrite").save()
    p = plan(b)
    # narrow: turn counts by (conversation, block), block totals, batch keys;
    # with tokens: the surviving turns' arrays once, the cut tokens by batch_id
    assert p.count("Exchange hashpartitioning") <= 5
    assert "Exchange hashpartitioning(batch_id" in p
