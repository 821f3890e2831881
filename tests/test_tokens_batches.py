"""Golden cases and properties for tokens, masks, cuts and batches."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy import constants as C
from colloquy.functions import arrays as AR
from colloquy.operators import batches as B
from colloquy.operators import tokens as TK
from colloquy.plans.numbering import global_row_number, running_sum

P, D, E = 101, 102, 103


def test_message_index_and_label_mask(spark):
    df = spark.createDataFrame([([9, P, 5, E, D, 6, E],)], "ids array<int>")
    r = df.select(TK.message_index_array(F.col("ids"), [P, D]).alias("m")).select(
        "m", TK.label_mask(F.col("m")).alias("mask"), TK.label_mask(F.col("m"), compat_prefix=True).alias("compat"),
        TK.label_mask(F.col("m"), masking=False).alias("off")).collect()[0]
    assert r.m == [-1, 0, 0, 0, 1, 1, 1]
    assert r.mask == [False, False, False, False, True, True, False]
    assert r.compat == [True, False, False, False, True, True, False]
    assert r.off == [True] * 6 + [False]


def test_message_index_long_matches_array(spark):
    rows = [(i, [int(x) for x in str(1000 + i * 37)] * 50) for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, ids array<int>")
    arr = {r.seq: r.m for r in df.select("seq", TK.message_index_array(F.col("ids"), [3, 7]).alias("m")).collect()}
    long = df.select("seq", F.posexplode("ids").alias("pos", "id"))
    m = TK.message_index_long(long, ["seq"], "pos", F.col("id").isin(3, 7))
    got = {}
    for r in m.collect():
        got.setdefault(r.seq, {})[r.pos] = r.msg_index
    for s, a in arr.items():
        assert [got[s][i] for i in range(len(a))] == a


def test_running_sum_blocks(spark):
    rows = [(g, i, (i * 7 + g) % 5) for g in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    out = running_sum(df, ["g"], "o", {"v": "cs"}, inclusive=False, block=16)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("ref", F.coalesce(F.sum("v").over(w), F.lit(0)))
    j = out.join(ref, ["g", "o"])
    assert j.filter(F.col("cs") != F.col("ref")).count() == 0


def test_global_row_number_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(5003))).repartition(9)
    n = global_row_number(df, [F.col("k"), F.col("id")], "rn")
    rows = sorted((r.k, r.id, r.rn) for r in n.collect())
    assert [r[2] for r in rows] == list(range(1, 5001))


def test_crop_truncate_tail_shift(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "a array<int>")
    r = df.select(AR.truncate_head("a", 3).alias("h"), AR.src_keep_tail("a", 3).alias("t3"),
                  AR.src_keep_tail("a", 9).alias("t9"),
                  AR.shift_targets(F.array(*[F.lit(x) for x in (1, 2, 3, 0)])).alias("s")).collect()[0]
    assert r.h == [1, 2, 3] and r.t3 == [3, 4, 5] and r.t9 == [1, 2, 3, 4, 5] and r.s == [2, 3, 0, 1]


def test_random_crop_parallel_and_in_range(spark):
    rows = [(i, list(range(i % 13 + 1)), [x * 10 for x in range(i % 13 + 1)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a array<int>, b array<int>")
    out = TK.random_crop(df, ["a", "b"], 4, ["k"]).collect()
    offsets = set()
    for r in out:
        n = r.k % 13 + 1
        assert len(r.a) == min(n, 4) and [x * 10 for x in r.a] == r.b
        assert 0 <= r.crop_offset <= max(n - 4, 0)
        offsets.add(r.crop_offset)
    assert len(offsets) > 3


def test_pad_to_multiple(spark):
    df = spark.createDataFrame([(0, [1] * 5), (0, [2] * 17)], "batch_id long, ids array<int>")
    out = B.pad_batch(df, "batch_id", {"ids": 0}, 16).collect()
    assert {len(r.ids) for r in out} == {32} and out[0].padded_length == 32


def test_assemble_prompt_target(spark):
    s1, s2, s3, t1, t2 = 21, 22, 23, 31, 32
    g, sop, eop = 6, 7, 8
    df = spark.createDataFrame([(1, [s1, s2, s3], [t1, t2])], "k long, src array<int>, tgt array<int>")
    r = TK.assemble_prompt_target(df, "src", "tgt", 100, 50, g, sop, eop).collect()[0]
    assert r.input_ids == [s1, s2, s3, g, sop, t1, t2, eop]
    assert r.labels == [-100] * 4 + [sop, t1, t2, eop]
    assert [x != -100 for x in r.labels] == [False] * 4 + [True] * 4
    r7 = TK.assemble_prompt_target(df, "src", "tgt", 7, 50, g, sop, eop).collect()[0]
    assert r7.input_ids == [s1, s2, s3, g, sop, t1, eop] and not r7.violation


def test_pack_short_pairs_later_first(spark):
    df = spark.createDataFrame([(0, 0, 1, [1, 2]), (0, 1, 2, [3])], "b long, o long, k long, ids array<int>")
    out = B.pack_short(df, "b", "o", ["ids"], ["k"], 512, threshold=256, mix_p=-1.0).collect()
    assert len(out) == 1 and out[0].ids == [3, 1, 2] and out[0].packed
    odd = spark.createDataFrame([(0, 0, 1, [1, 2]), (0, 1, 2, [3]), (0, 2, 3, [4])],
                                "b long, o long, k long, ids array<int>")
    res = sorted((r.packed, r.ids) for r in B.pack_short(odd, "b", "o", ["ids"], ["k"], 512, mix_p=-1.0).collect())
    assert res == [(False, [4]), (True, [3, 1, 2])]


def test_assign_batches_independent_of_partitioning(spark):
    df = spark.range(0, 300).withColumnRenamed("id", "k")
    a = {r.k: (r.batch_id, r.row_in_batch) for r in B.assign_batches(df.repartition(3), ["k"], 8).collect()}
    b = {r.k: (r.batch_id, r.row_in_batch) for r in B.assign_batches(df.repartition(11), ["k"], 8).collect()}
    assert a == b
    sizes = {}
    for bid, _ in a.values():
        sizes[bid] = sizes.get(bid, 0) + 1
    assert sizes[max(sizes)] == 300 % 8 and all(v == 8 for k, v in sizes.items() if k != max(sizes))


def test_vocab_roundtrip(spark):
    texts = spark.createDataFrame([("a b a c",), ("c d <|patient|>",)], "t string")
    toks = texts.select(F.split("t", " ").alias("tokens"))
    vocab = TK.build_vocab(toks, "tokens")
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert ids["<pad>"] == 0 and ids[C.PATIENT] == C.SPECIAL_TOKENS.index(C.PATIENT)
    assert ids["a"] == len(C.SPECIAL_TOKENS) and ids["c"] == len(C.SPECIAL_TOKENS) + 1
    long = toks.select(F.monotonically_increasing_id().alias("s"), F.posexplode("tokens").alias("pos", "token"))
    enc = TK.encode_long(long, vocab)
    dec = TK.decode_long(enc.drop("token"), vocab)
    assert sorted(dec.select("token").rdd.flatMap(lambda r: r).collect()) == sorted("a b a c c d <|patient|>".split())
    more = TK.add_special_tokens(vocab, ["<|tool|>", C.PATIENT])
    new = more.filter(F.col("token") == "<|tool|>").collect()[0]
    assert new.token_id == max(ids.values()) + 1


@pytest.mark.parametrize("limit", [2, None])
def test_build_vocab_max_size(spark, limit):
    toks = spark.createDataFrame([(["x", "y", "y", "z", "z", "z"],)], "tokens array<string>")
    v = TK.build_vocab(toks, "tokens", max_size=limit)
    corpus = [r.token for r in v.orderBy("token_id").collect() if r.token_id >= len(C.SPECIAL_TOKENS)]
    assert corpus == (["z", "y"] if limit == 2 else ["z", "y", "x"])


def test_assign_batches_bucketed_cuts_padding(spark):
    rows = [(k, [1] * ((k * 37) % 97 + 1)) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, ids array<int>").withColumn("lb", F.floor(F.size("ids") / 10))

    def padding(b):
        p = B.pad_batch(b, "batch_id", {"ids": 0}, 1)
        return p.select(F.sum(F.col("padded_length") - F.size(F.filter("ids", lambda x: x == 1)))).first()[0]

    plain = B.assign_batches(df, ["k"], 8)
    bucketed = B.assign_batches(df, ["k"], 8, bucket_by="lb")
    assert bucketed.count() == 400 and padding(bucketed) < padding(plain)


def test_encode_and_decode_arrays(spark):
    rows = [(1, ["a", "b", "zz"]), (2, []), (3, ["b", "a", "a"]), (3, ["b", "a", "a"]), (None, ["a"]), (3, None),
            (4, [None, "a"]), (5, ["a", None])]
    df = spark.createDataFrame(rows, "k long, toks array<string>")
    vocab = TK.build_vocab(df, "toks")
    ids = {r.token: r.token_id for r in vocab.collect()}
    unk = ids[C.UNK]
    enc = TK.encode_array(df, "toks", vocab, "ids")
    want = sorted([(k, t, None if t is None else [ids.get(x, unk) for x in t]) for k, t in rows], key=repr)
    assert sorted([(r.k, r.toks, r.ids) for r in enc.collect()], key=repr) == want
    back = TK.decode_array(enc.filter("k is null or k < 4"), "ids", vocab, "back").collect()
    assert len(back) == 6 and all(r.back == r.toks for r in back)


def test_prefix_shortens_to_max_length(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 1, 1, 1], [True] * 4)],
                               "input_ids array<int>, attention_mask array<int>, label_mask array<boolean>")
    r = TK.prepend_prefix(df, [9, 8], max_length=4).collect()[0]
    assert (r.input_ids, r.attention_mask, r.label_mask) == ([9, 8, 1, 2], [1] * 4, [False, False, True, True])
    assert TK.prepend_prefix(df, [9, 8]).collect()[0].input_ids == [9, 8, 1, 2, 3, 4]


def test_dense_row_number_paths_agree(spark):
    from colloquy.plans.numbering import dense_row_number

    df = spark.range(0, 3000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(3001))).repartition(5)
    small = {r.id: r.rn for r in dense_row_number(df, [F.col("k"), F.col("id")], "rn").collect()}
    big = {r.id: r.rn for r in dense_row_number(df, [F.col("k"), F.col("id")], "rn", small_limit=10).collect()}
    assert small == big and sorted(small.values()) == list(range(1, 3001))


def test_length_stats_clipped_exact_median(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (50,)], "n int")
    r = B.length_stats(df, F.col("n"), 20).collect()[0]
    assert (r.n, r.min_len, r.max_len) == (4, 1, 20)
    assert r.mean_len == (1 + 2 + 10 + 20) / 4 and r.median_len == 6.0 and r.over_share == 0.25
