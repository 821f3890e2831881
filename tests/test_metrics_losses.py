"""Golden values for metrics and losses, brute-force checks for the kernels."""

import math

import pytest
from pyspark.sql import functions as F

from colloquy.operators import losses as L
from colloquy.operators import metrics as M


def pairs_df(spark, rows):
    df = spark.createDataFrame(rows, "id long, response string, target string")
    return df.select("id", F.split("response", " ").alias("hyp_tokens"), F.split("target", " ").alias("ref_tokens"))


def test_ngram_stats(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"],), ([],)], "tokens array<string>")
    counts = M.ngram_counts(df, "tokens")
    c = {(r.n, r.ngram): r["count"] for r in counts.collect()}
    assert c[(1, "a")] == 2 and c[(1, "b")] == 2 and c[(2, "a b")] == 2 and c[(2, "b a")] == 1
    st = {r.n: r for r in M.ngram_stats(counts).collect()}
    assert st[2].distinct_ratio == pytest.approx(2 / 3, abs=1e-6)
    assert st[2].entropy == pytest.approx(0.636514, abs=1e-6)
    assert st[3].distinct_ratio == pytest.approx(1.0, abs=1e-6)


def test_bleu_goldens(spark):
    p = pairs_df(spark, [(1, "the cat sat on mat", "the cat sat on the mat"), (2, "the the the", "the cat sat on the mat"),
                         (3, "mat on sat", "the cat sat on the mat")])
    b2 = {r.id: r.bleu_2 for r in M.bleu_n(p, ["id"], 2).collect()}
    b4 = {r.id: r.bleu_4 for r in M.bleu_n(p, ["id"], 4).collect()}
    b1 = {r.id: r.bleu_1 for r in M.bleu_n(p, ["id"], 1).collect()}
    assert b2[1] == pytest.approx(0.709042, abs=1e-6)
    assert b4[1] == pytest.approx(0.578930, abs=1e-6)
    assert b1[2] == pytest.approx(0.245253, abs=1e-6)
    assert b2[3] == 0.0


def test_clipped_matches_with_repeated_and_null_keys(spark):
    rows = [(1, ["a", "b", "a", "b"], ["a", "b", "b"]), (1, ["a"], None), (2, [], ["x"]), (3, None, ["x"]),
            (None, ["x", "x", ""], ["x", ""]), (4, ["a b", "c"], ["a", "b c"])]
    df = spark.createDataFrame(rows, "k long, h array<string>, r array<string>")
    got = {(r.k, r.n): (r.matches, r.total) for r in M.ngram_match_counts(df, ["k"], "h", "r", 4).collect()}
    assert got == {(1, 1): (3, 5), (1, 2): (1, 3), (1, 3): (0, 2), (1, 4): (0, 1),
                   (None, 1): (2, 3), (None, 2): (1, 2), (None, 3): (0, 1), (4, 1): (0, 2), (4, 2): (1, 1)}


def test_identical_pair_scores_one(spark):
    p = pairs_df(spark, [(1, "a b c d e", "a b c d e")])
    assert M.bleu_n(p, ["id"], 1).collect()[0].bleu_1 == pytest.approx(1.0)
    assert M.rouge_l(p, ["id"]).collect()[0].rouge_l == pytest.approx(1.0, abs=1e-7)


def test_rouge_and_meteor_goldens(spark):
    p = pairs_df(spark, [(1, "the cat sat on mat", "the cat sat on the mat")])
    r = M.rouge_l(p, ["id"]).collect()[0]
    assert r.lcs == 5 and r.rouge_l == pytest.approx(0.909091, abs=1e-6)
    assert M.meteor(p, ["id"]).collect()[0].meteor == pytest.approx(0.755932, abs=1e-6)


def _lcs_brute(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


def test_rouge_l_query_against_brute_force(spark):
    """The registered ROUGE-L query (no SQL oracle) checked against a plain DP on sf0.001."""
    import __spark_entry__ as E
    from conftest import SF_SMALL

    got = {(r.conv_id, r.turn): (r.lcs, r.rouge_l) for r in E.queries()["rouge_l"](spark, SF_SMALL).collect()}
    toks = M.metric_tokens(E.catalog.catalog_metrics.FX.metric_pairs(spark, SF_SMALL), ["conv_id", "turn"]).collect()
    assert got
    for t in toks:
        h, r = t.hyp_tokens, t.ref_tokens
        if not h or not r:
            continue
        lcs = _lcs_brute(h, r)
        p, rc = lcs / len(h), lcs / len(r)
        f = 2 * p * rc / (p + rc + 1e-8)
        assert got[(t.conv_id, t.turn)][0] == lcs
        assert got[(t.conv_id, t.turn)][1] == pytest.approx(round(f, 6), abs=1e-6)


def test_generation_report_shape(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL

    r = E.queries()["generation_report"](spark, SF_SMALL).collect()[0]
    for k in ("rouge_l", "bleu_2", "bleu_4", "meteor", "dist_2"):
        assert 0.0 <= r[k] <= 1.0


def test_cross_entropy_and_poly(spark):
    df = spark.createDataFrame([([2.0, 1.0, 0.0], 0, True), ([0.0, 0.0, 0.0], 1, True), ([1.0, 3.0, 1.0], -100, True)],
                               "logits array<double>, target int, mask boolean")
    assert L.masked_cross_entropy(df).collect()[0].loss == pytest.approx(0.502073, abs=1e-6)
    assert L.poly_loss(df).collect()[0].loss == pytest.approx(1.253822, abs=1e-6)


def test_logsumexp_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 1000.0], 0, True)], "logits array<double>, target int, mask boolean")
    assert L.masked_cross_entropy(df).collect()[0].loss == pytest.approx(math.log(2), abs=1e-6)


def test_ranking_losses(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (2, 0, 3.0), (2, 1, 1.0), (2, 2, 2.0)],
                               "conv_id long, rank long, score double")
    per = {r.conv_id: r.loss for r in L.ranking_loss(df, reduction="none").collect()}
    assert per[1] == pytest.approx(0.315762, abs=1e-6) and per[2] == pytest.approx(0.589150, abs=1e-6)
    assert L.ranking_loss(df).collect()[0].loss == pytest.approx(0.452456, abs=1e-6)
    assert L.pair_classification_loss(df).collect()[0].loss == pytest.approx(0.516678, abs=1e-6)


def test_pair_sums_across_blocks(spark):
    """A conversation larger than one block gives the same sums as the direct double loop."""
    import random
    rnd = random.Random(3)
    scores = [rnd.uniform(-3, 3) for _ in range(70)]
    df = spark.createDataFrame([(5, i, s) for i, s in enumerate(scores)], "conv_id long, rank long, score double")
    got = L.preference_pair_sums(df, block=8).collect()[0]
    n = sp = 0.0
    for i in range(70):
        for j in range(i + 1, 70):
            d = scores[j] - scores[i]
            n += 1
            sp += max(d, 0) + math.log1p(math.exp(-abs(d)))
    assert got.n_pairs == n and got.sp_sum == pytest.approx(sp, rel=1e-9)


def test_token_accuracy_rules(spark):
    df = spark.createDataFrame([(1, -100), (0, 0), (3, 3), (9, 4)], "pred int, label int")
    assert M.token_accuracy(df, rule="positive").collect()[0].accuracy == pytest.approx(0.5)
    assert M.token_accuracy(df, rule="ignore_index").collect()[0].accuracy == pytest.approx(2 / 3, abs=1e-6)
    empty = df.filter(F.lit(False))
    assert M.token_accuracy(empty).collect()[0].accuracy is None
    assert M.choice_accuracy(empty.withColumn("correctness", F.lit(1))).collect()[0].accuracy is None


def test_merge_metrics_rejects_duplicates(spark):
    one = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError):
        M.merge_metrics([("a", one), ("a", one)])
    with pytest.raises(KeyError):
        L.loss_report("Nope", one, one)


def test_log_sum_exp_with_infinite_logits(spark):
    from colloquy.functions.arrays import logsumexp
    inf = float("inf")
    rows = [([-inf, 1.0, 2.0],), ([1.0, -inf, 2.0],), ([-inf, -inf],), ([float("nan"), 1.0],), ([1.0, float("nan")],)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<double>").coalesce(1).select(logsumexp("x")).collect()]
    want = math.log(math.exp(1) + math.exp(2))
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(want) and got[2] == -inf
    assert math.isnan(got[3]) and math.isnan(got[4])


@pytest.mark.parametrize("target", [-3, 3, None])
def test_targets_outside_the_logits_raise(spark, target):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 1, True), ([1.0, 2.0, 3.0], target, True)],
                               "logits array<double>, target int, mask boolean")
    with pytest.raises(Exception, match="out of range"):
        L.masked_cross_entropy(df).collect()


@pytest.mark.parametrize("scale", [(1, 0), (1, -7), (1_700_000_000_000, 5), (2_000_000_000, -3)])
def test_pairs_do_not_depend_on_the_scale_of_ranks(spark, scale):
    a, b = scale
    rows = [(c, a * (r + b), float((r * 7) % 5)) for c in (1, 2) for r in range(12 * c)]
    got = L.preference_pair_sums(spark.createDataFrame(rows, "conv_id long, rank long, score double"), block=4)
    plain = [(c, r, float((r * 7) % 5)) for c in (1, 2) for r in range(12 * c)]
    want = L.preference_pair_sums(spark.createDataFrame(plain, "conv_id long, rank long, score double"))
    key = lambda d: sorted((r.conv_id, r.n_pairs, round(r.sp_sum, 9), round(r.margin_sum, 9)) for r in d.collect())
    assert key(got) == key(want) and [x[1] for x in key(got)] == [66, 276]


def test_lcs_kernel_random_against_brute_force():
    import random
    from colloquy.operators.metrics import _lcs

    rnd = random.Random(7)
    for _ in range(500):
        a = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 70))]
        b = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 70))]
        assert _lcs(a, b) == _lcs_brute(a, b)


def _meteor_loop(hyp, ref, alpha=0.9, beta=3.0, gamma=0.5):
    """Plain statement of the exact stage: scan both sides from the end, pop matches."""
    hl, rl = list(enumerate(w.lower() for w in hyp)), list(enumerate(w.lower() for w in ref))
    matches = []
    for i in range(len(hl) - 1, -1, -1):
        for j in range(len(rl) - 1, -1, -1):
            if hl[i][1] == rl[j][1]:
                matches.append((hl[i][0], rl[j][0]))
                hl.pop(i)
                rl.pop(j)
                break
    if not matches:
        return 0.0
    matches.sort()
    chunks = 1 + sum(1 for a, b in zip(matches, matches[1:]) if not (b[0] == a[0] + 1 and b[1] == a[1] + 1))
    p, r = len(matches) / len(hyp), len(matches) / len(ref)
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (chunks / len(matches)) ** beta)


def test_meteor_kernel_random_against_loop():
    import random
    from colloquy.operators.metrics import _meteor

    rnd = random.Random(11)
    for _ in range(500):
        a = [rnd.choice("abcdeA") for _ in range(rnd.randint(0, 25))]
        b = [rnd.choice("abcdea") for _ in range(rnd.randint(1, 25))]
        assert _meteor(a, b) == pytest.approx(_meteor_loop(a, b), abs=1e-12)


def test_choice_accuracy_rollup_and_grouped_report(spark):
    df = spark.createDataFrame([("A", 1), ("A", 0), ("B", 1)], "answer string, correctness int")
    r = {row.answer: row.accuracy for row in M.choice_accuracy(df, ["answer"], rollup=True).collect()}
    assert r["A"] == 50.0 and r["B"] == 100.0 and r[None] == pytest.approx(66.666667)
    pairs = spark.createDataFrame([(1, "g1", "a b c", "a b c"), (2, "g1", "a b", "x y"), (3, "g2", "p q r s", "p q r s")],
                                  "id long, grp string, response string, target string")
    rep = {x.grp: x for x in M.generation_report(pairs, ["id"], by=["grp"]).collect()}
    assert rep["g2"].rouge_l == 1.0 and rep["g2"].bleu_2 == 1.0 and rep["g1"].bleu_2 == 0.5


def test_generation_report_sequence_bleu(spark):
    pairs = spark.createDataFrame([(1, "a b", "a b"), (2, "c d", "c d"), (3, "e", "x")],
                                  "id long, response string, target string")
    r = M.generation_report(pairs, ["id"], bleu_mode="sequence").collect()[0]
    # answers as tokens: [ab, cd, e] vs [ab, cd, x] -> p1 = 2/3, p2 = 1/2, brevity 1
    assert r.bleu_2 == pytest.approx(round(math.sqrt(2 / 3 * 1 / 2), 4))


def test_bleu_kernels_agree(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL

    toks = M.metric_tokens(E.catalog.catalog_metrics.FX.metric_pairs(spark, SF_SMALL), ["conv_id", "turn"])
    a = {(r.conv_id, r.turn): (r.bleu_2, r.bleu_4) for r in M.bleu_scores(toks, ["conv_id", "turn"]).collect()}
    b = {(r.conv_id, r.turn): (r.bleu_2, r.bleu_4)
         for r in M.bleu_scores(toks, ["conv_id", "turn"], kernel="join").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)


def test_pair_predictions_unmatched(spark):
    r = spark.createDataFrame([(1, "a"), (2, "b")], "id long, response string")
    t = spark.createDataFrame([(2, "B"), (3, "C")], "id long, target string")
    p = M.pair_predictions(r, t, ["id"])
    assert sorted((x.id, x.matched) for x in p.collect()) == [(1, False), (2, True), (3, False)]
    u = M.unmatched_counts(p).collect()[0]
    assert (u.pairs, u.missing_response, u.missing_target) == (3, 1, 1)


def test_pair_scores_match_separate_metrics(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL

    keys = ["conv_id", "turn"]
    toks = M.metric_tokens(E.catalog.catalog_metrics.FX.metric_pairs(spark, SF_SMALL), keys)
    ps = {(r.conv_id, r.turn): r for r in M.pair_scores(toks, keys).collect()}
    rl = {(r.conv_id, r.turn): r.rouge_l for r in M.rouge_l(toks, keys).collect()}
    bl = {(r.conv_id, r.turn): r for r in M.bleu_scores(toks, keys).collect()}
    mt = {(r.conv_id, r.turn): r.meteor for r in M.meteor(toks, keys).collect()}
    for k, r in ps.items():
        if r.rouge_l is not None:
            assert r.rouge_l == pytest.approx(rl[k], abs=1e-12)
        assert (r.bleu_2, r.bleu_4) == pytest.approx((bl[k].bleu_2, bl[k].bleu_4), abs=1e-12)
        assert r.meteor == pytest.approx(mt[k], abs=1e-12)


def test_compute_metrics_merges_and_rejects_duplicates(spark):
    df = spark.createDataFrame([(1, -100), (0, 0), (3, 3), (9, 4)], "pred int, label int")
    out = {r.metric: r.value for r in M.compute_metrics(
        df, [(M.mask_positive_labels, M.token_accuracy)]).collect()}
    assert out == {"accuracy": 0.5}
    with pytest.raises(ValueError):
        M.compute_metrics(df, [(None, M.token_accuracy), (None, M.token_accuracy)])


def test_porter_stems():
    from colloquy.functions.porter import porter_stem
    # examples of the published description of the algorithm
    want = {"caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
            "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
            "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss",
            "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
            "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper",
            "feudalism": "feudal", "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic",
            "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv",
            "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
            "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
            "roll": "roll", "generalizations": "gener", "Über": "Über", "is": "is"}
    assert {w: porter_stem(w) for w in want} == want


def _all_lcs_words(x, y):
    """Word sets of all longest common subsequences (tiny inputs)."""
    import itertools
    for n in range(min(len(x), len(y)), 0, -1):
        found = {c for c in itertools.combinations(x, n)} & {c for c in itertools.combinations(y, n)}
        if found:
            return {frozenset(c) for c in found}
    return {frozenset()}


def test_rouge_summary_words_are_of_a_longest_subsequence(spark):
    import random
    from colloquy.operators.lcs import common_words
    from colloquy.operators.metrics import _summary_overlap
    rng = random.Random(3)
    for _ in range(200):
        x = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
        y = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
        assert frozenset(common_words(x, y)) in _all_lcs_words(x, y)
    assert _summary_overlap("a b c . d e .".split(), "a c . e f".split()) == (3, 5, 4)
    rows = [(1, "a b c . d e .".split(), "a c . e f".split()), (2, [], ["a"]), (3, ["."], ["."]), (4, None, ["a"])]
    df = spark.createDataFrame(rows, "k int, h array<string>, r array<string>")
    got = {r.k: (r.lcs, r.rouge_l) for r in M.rouge_l(df, ["k"], "h", "r", mode="summary").collect()}
    p, q = 3 / 5, 3 / 4
    assert got[1] == (3, pytest.approx(2 * p * q / (p + q + 1e-8))) and {got[k] for k in (2, 3, 4)} == {(0, 0.0)}


def test_meteor_stages(spark):
    rows = [(1, "the cats sat quickly".split(), "the cat sits fast".split()), (2, ["a"], ["a"]), (3, None, ["a"])]
    df = spark.createDataFrame(rows, "k int, h array<string>, r array<string>")
    synonyms = spark.createDataFrame([("quickly", "s1"), ("fast", "s1"), ("fast", "s2"), ("sat", "s3"), ("sits", "s3")],
                                     "word string, sense string")

    def score(m, chunks, nh=4, nr=4):
        p, r = m / nh, m / nr
        return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / m) ** 3)
    exact, stem, full = ({r.k: r.meteor for r in M.meteor(df, ["k"], "h", "r", **o).collect()}
                         for o in ({}, {"stem": True}, {"stem": True, "synonyms": synonyms}))
    assert exact[1] == pytest.approx(score(1, 1)) and stem[1] == pytest.approx(score(2, 1))
    assert full[1] == pytest.approx(score(4, 1)) and exact[2] == stem[2] == full[2] == pytest.approx(0.5)
    assert exact[3] == stem[3] == full[3] == 0.0


def test_report_modes(spark):
    rows = [(1, "Cats sat. A dog ran.", "A cat sat. Dogs run."), (2, "same words here", "same words here")]
    df = spark.createDataFrame(rows, "k int, response string, target string")
    plain = M.generation_report(df, ["k"]).collect()[0]
    other = M.generation_report(df, ["k"], rouge_mode="summary", stem=True).collect()[0]
    assert other.meteor > plain.meteor and (other.bleu_2, other.dist_2) == (plain.bleu_2, plain.dist_2)
