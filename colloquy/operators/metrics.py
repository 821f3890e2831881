"""Evaluation metrics as aggregations.

Corpus statistics (n-gram counts, distinct-n, entropy, accuracies) are
partial+final hash aggregates.  Pairwise text metrics (BLEU, ROUGE-L,
METEOR) are computed per pair; BLEU's clipped n-gram matching walks both
sides' sorted n-grams inside the pair's row, LCS and METEOR alignment run in
Arrow-batched pandas UDFs while the pairs stay distributed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .. import constants as C
from ..functions.porter import porter_stem
from ..plans.numbering import dense_row_number
from ..session import materialize
from ..functions.text import extract_choices, parse_judge_score, strip_markers, tokenize, trim_all, whitespace_tokens
from .lcs import common_words, lcs_tiled

NGRAMS_A_TASK = 4_000_000  # n-grams that a task combines before the shuffle


# ---------------------------------------------------------------- filters

def mask_positive_labels(df: DataFrame, label: str = "label", enabled: bool = True) -> DataFrame:
    """Keep rows whose label is > 0 (drops 0 and -100); ``enabled=False`` keeps all."""
    return df.filter(F.col(label) > 0) if enabled else df


def drop_empty_pairs(pairs: DataFrame, response: str = "response", target: str = "target") -> DataFrame:
    """Drop pairs where either side is empty after stripping."""
    return pairs.filter((F.length(trim_all(F.col(response))) > 0) & (F.length(trim_all(F.col(target))) > 0))


def pair_predictions(responses: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Pair responses and targets by key; unmatched rows are kept with a null side.

    ``matched`` tells complete pairs apart (the original asserts equal counts).
    """
    j = responses.join(targets, keys, "full_outer")
    return j.withColumn("matched", F.col("response").isNotNull() & F.col("target").isNotNull())


def unmatched_counts(paired: DataFrame) -> DataFrame:
    """Counts of pairs with a missing response or target (the original asserts both are 0)."""
    return paired.agg(F.count(F.lit(1)).alias("pairs"),
                      F.count_if(F.col("response").isNull()).alias("missing_response"),
                      F.count_if(F.col("target").isNull()).alias("missing_target"))


# ---------------------------------------------------------------- choice exams

def tag_correctness(df: DataFrame, reply: str = "model_output", answer: str = "answer") -> DataFrame:
    """``correctness`` = 1 when the last extracted choice equals the answer."""
    d = df.withColumn("choices", extract_choices(trim_all(F.col(reply))))
    ch = F.col("choices")  # blank replies give an empty list
    ok = (F.size(ch) > 0) & (F.element_at(ch, -1) == F.col(answer))
    return d.withColumn("correctness", F.coalesce(ok, F.lit(False)).cast("int"))


def choice_accuracy(df: DataFrame, by: list[str] | None = None, correct: str = "correctness",
                    rollup: bool = False) -> DataFrame:
    """``100 * correct / rows``; an empty input gives null instead of failing.

    ``by`` groups; ``rollup=True`` adds subtotals and the grand total.
    """
    acc = (F.lit(100.0) * F.try_divide(F.sum(correct).cast("double"), F.count(F.lit(1)).cast("double")))
    aggs = [F.count(F.lit(1)).alias("n"), F.round(acc, 6).alias("accuracy")]
    if by and rollup:
        return df.rollup(*by).agg(*aggs)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def token_accuracy(df: DataFrame, pred: str = "pred", label: str = "label", rule: str = "positive",
                   by: list[str] | None = None) -> DataFrame:
    """Accuracy over kept labels: ``positive`` keeps label > 0, ``ignore_index`` drops -100."""
    if rule == "positive":
        d = df.filter(F.col(label) > 0)
    elif rule == "ignore_index":
        d = df.filter(F.col(label) != C.IGNORE_INDEX)
    else:
        raise ValueError(f"unknown rule {rule}")
    acc = F.try_divide(F.sum((F.col(pred) == F.col(label)).cast("int")).cast("double"),
                       F.count(F.lit(1)).cast("double"))
    aggs = [F.count(F.lit(1)).alias("n"), F.round(acc, 6).alias("accuracy")]
    return d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)


def merge_metrics(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union one-value metric tables into ``(metric, value)``; duplicate names raise."""
    names = [n for n, _ in parts]
    dup = sorted({n for n in names if names.count(n) > 1})
    if dup:
        raise ValueError(f"duplicate metric names: {dup}")
    out = None
    for name, df in parts:
        col = [c for c in df.columns if c != "metric"][-1]
        t = df.select(F.lit(name).alias("metric"), F.col(col).cast("double").alias("value"))
        out = t if out is None else out.unionByName(t)
    return out


def compute_metrics(df: DataFrame, specs) -> DataFrame:
    """Run ``(preprocess, metric)`` pairs over one prediction table and merge.

    ``preprocess``: DataFrame -> DataFrame (e.g. ``mask_positive_labels``);
    ``metric``: DataFrame -> one-row DataFrame whose columns (other than ``n``)
    are metric values.  Names must be unique across metrics (as with merging
    result dicts); the result is ``(metric, value)``.
    """
    parts = []
    for prep, metric in specs:
        res = metric(prep(df) if prep is not None else df)
        for c in res.columns:
            if c != "n":
                parts.append((c, res.select(c)))
    return merge_metrics(parts)


# ---------------------------------------------------------------- n-grams

def ngrams(tokens: Column, n: int) -> Column:
    """All contiguous n-grams of a token array, space-joined."""
    size = F.size(tokens)
    return F.when(size < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def ngram_counts(df: DataFrame, tokens: str = "tokens", ns=(1, 2, 3, 4), by: list[str] | None = None) -> DataFrame:
    """``(by.., n, ngram, count)`` over the whole corpus (map-side combined).

    The token arrays are written once and dealt out in as many parts as the
    number of their n-grams asks for, so the table in which a task combines
    stays the same size however large the input is.
    """
    by = by or []
    toks = materialize(df.select(*by, F.col(tokens).alias("_t")), "ngram-tokens")
    size = toks.agg(F.sum(F.size("_t").cast("bigint"))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size * len(ns) // NGRAMS_A_TASK))
    # dealt by row number: no sort as in a round-robin, and equal rows stay apart
    t = F.col("_t")
    per_n = toks.repartition(parts, F.monotonically_increasing_id()) \
                .select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), ngrams(t, n).alias("g")) for n in ns])).alias("_x"))
    # outer explode + null filter: no inferred filter re-evaluating the n-gram expression
    exploded = per_n.select(*by, F.col("_x.n").alias("n"), F.explode_outer("_x.g").alias("ngram")) \
                    .filter(F.col("ngram").isNotNull())
    return exploded.groupBy(*by, "n", "ngram").agg(F.count(F.lit(1)).alias("count"))


def ngram_stats(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per n: total, distinct, distinct ratio and entropy (denominator + 1e-10)."""
    by = by or []
    g = counts.groupBy(*by, "n").agg(
        F.sum("count").cast("double").alias("_s"),
        F.count(F.lit(1)).cast("double").alias("_d"),
        F.sum(F.col("count") * F.log(F.col("count").cast("double"))).alias("_vlv"))
    tot = F.col("_s") + F.lit(C.NGRAM_EPS)
    ent = -(F.col("_vlv") / tot - (F.col("_s") / tot) * F.log(tot))
    return g.select(*by, "n", F.col("_s").cast("bigint").alias("total"), F.col("_d").cast("bigint").alias("distinct"),
                    F.round(F.col("_d") / tot, 6).alias("distinct_ratio"), F.round(ent, 6).alias("entropy"))


def ngram_entropy(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ngram_stats(counts, by).select(*(by or []), "n", "entropy")


def distinct_n(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct ratio per n; ``dist_2_compat`` is the 3-gram ratio the original reports as dist-2."""
    s = ngram_stats(counts, by).select(*(by or []), "n", "distinct_ratio")
    return s.withColumn("dist_2_compat", F.col("n") == 3)


# ---------------------------------------------------------------- BLEU

def _clipped_matches(h: Column, r: Column) -> Column:
    """Sum of ``least(count in h, count in r)`` over the distinct strings of two arrays.

    The strings of both sides are sorted together, those of ``r`` first among
    equals, and walked once: every string of ``h`` takes one of ``r`` that is free.
    """
    def side(c, hyp):
        return F.transform(c, lambda g: F.struct(g.alias("g"), F.lit(hyp).alias("h")))

    def step(acc, x):
        free = F.when(acc["g"].eqNullSafe(x["g"]), acc["free"]).otherwise(F.lit(0))
        hit = x["h"] & (free > 0)
        return F.struct(x["g"].alias("g"), F.when(hit, free - 1).when(x["h"], free).otherwise(free + 1).alias("free"),
                        F.when(hit, acc["m"] + 1).otherwise(acc["m"]).alias("m"))

    init = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("free"), F.lit(0).cast("bigint").alias("m"))
    return F.aggregate(F.sort_array(F.concat(side(h, True), side(r, False))), init, step, lambda acc: acc["m"])


def ngram_match_counts(pairs: DataFrame, keys: list[str], hyp: str, ref: str, max_n: int) -> DataFrame:
    """Per pair and order present in the hypothesis: clipped matches and n-gram count.

    Only the pair rows are shuffled (by pair key); rows of one key count
    together.  A pair's n-grams are counted inside its row (clipping is ``least(hyp
    count, ref count)``), so a task holds those of one pair at a time and
    never a table of all n-grams of its partition.
    """
    sides = pairs.repartition(*keys).select(*keys, F.struct(F.col(hyp).alias("h"), F.col(ref).alias("r")).alias("_p")) \
                 .groupBy(*keys).agg(F.collect_list("_p").alias("_p"))

    def grams(side, n):
        none = F.array().cast("array<string>")
        return F.flatten(F.transform("_p", lambda p: F.coalesce(ngrams(p[side], n), none)))

    per_n = sides.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("n"), _clipped_matches(grams("h", n), grams("r", n)).alias("matches"),
                 F.aggregate("_p", F.lit(0).cast("bigint"), lambda acc, p: acc + F.greatest(
                     F.coalesce(F.size(p["h"]), F.lit(0)) - (n - 1), F.lit(0))).alias("total"))
        for n in range(1, max_n + 1)])))
    return per_n.filter(F.col("total") > 0)


def clipped_ngram_matches(pairs: DataFrame, keys: list[str], hyp: str, ref: str, max_n: int) -> DataFrame:
    """``ngram_match_counts`` with a row (zeros) for every pair and order."""
    m = ngram_match_counts(pairs, keys, hyp, ref, max_n)
    grid = pairs.select(*keys, F.explode(F.array(*[F.lit(n) for n in range(1, max_n + 1)])).alias("n"))
    return grid.join(m, [*keys, "n"], "left").select(
        *keys, "n", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))


def _clipped(h, r, max_n: int):
    """Per order 1..max_n: (clipped matches, hypothesis n-gram count) for one pair."""
    from collections import Counter
    h = list(h) if h is not None else []
    r = list(r) if r is not None else []
    out_m, out_t = [], []
    for n in range(1, max_n + 1):
        ch = Counter(zip(*[h[i:] for i in range(n)]))
        cr = Counter(zip(*[r[i:] for i in range(n)]))
        out_m.append(sum((ch & cr).values()))
        out_t.append(max(len(h) - n + 1, 0))
    return out_m, out_t


def _clipped_udf(max_n: int):
    @pandas_udf(T.StructType([T.StructField("m", T.ArrayType(T.LongType())),
                              T.StructField("t", T.ArrayType(T.LongType()))]))
    def clipped(h: pd.Series, r: pd.Series) -> pd.DataFrame:
        ms, ts = [], []
        for x, y in zip(h, r):
            m, t = _clipped(x, y, max_n)
            ms.append(m)
            ts.append(t)
        return pd.DataFrame({"m": ms, "t": ts})
    return clipped


def bleu_scores(pairs: DataFrame, keys: list[str], orders=(2, 4), hyp: str = "hyp_tokens",
                ref: str = "ref_tokens", kernel: str = "pair") -> DataFrame:
    """Unsmoothed sentence BLEU with uniform weights, one column ``bleu_N`` per order.

    A score is 0 when any order up to N has no clipped match (or the
    hypothesis is shorter than N); the brevity penalty is ``exp(1 - r/c)``.
    ``kernel='pair'`` (default) clips n-gram counts per pair in an Arrow-batched
    kernel: a map-only stage, nothing is shuffled.  ``kernel='join'`` uses the
    relational form (``ngram_match_counts``: pairs grouped by key, n-grams
    clipped inside the row); both give the same numbers.
    """
    max_n = max(orders)
    if kernel == "pair":
        k = pairs.select(*keys, F.size(hyp).alias("_c"), F.size(ref).alias("_r"),
                         _clipped_udf(max_n)(F.col(hyp), F.col(ref)).alias("_k"))
        cols = []
        for n in orders:
            m = F.slice(F.col("_k.m"), 1, n)
            t = F.slice(F.col("_k.t"), 1, n)
            ok = F.size(F.filter(m, lambda x: x > 0)) == n
            slp = F.aggregate(F.zip_with(m, t, lambda a, b: F.log(a / b)), F.lit(0.0), lambda acc, x: acc + x)
            bp = F.when(F.col("_c") > F.col("_r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("_r") / F.col("_c")))
            cols.append(F.when((F.col("_c") > 0) & ok, bp * F.exp(slp / n)).otherwise(F.lit(0.0)).alias(f"bleu_{n}"))
        return k.select(*keys, *cols)
    m = ngram_match_counts(pairs, keys, hyp, ref, max_n)
    aggs = []
    for n in orders:
        inside = F.col("n") <= n
        aggs.append(F.count_if(inside & (F.col("matches") > 0)).alias(f"_ok{n}"))
        aggs.append(F.sum(F.when(inside & (F.col("matches") > 0),
                                 F.log(F.col("matches") / F.col("total")))).alias(f"_slp{n}"))
    per = m.groupBy(*keys).agg(*aggs)
    lens = pairs.select(*keys, F.size(hyp).alias("_c"), F.size(ref).alias("_r"))
    j = lens.join(per, keys, "left")
    bp = F.when(F.col("_c") > F.col("_r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("_r") / F.col("_c")))
    cols = []
    for n in orders:
        ok = F.coalesce(F.col(f"_ok{n}"), F.lit(0)) == n
        cols.append(F.when((F.col("_c") > 0) & ok, bp * F.exp(F.col(f"_slp{n}") / n)).otherwise(F.lit(0.0))
                    .alias(f"bleu_{n}"))
    return j.select(*keys, *cols)


def bleu_n(pairs: DataFrame, keys: list[str], n: int, hyp: str = "hyp_tokens", ref: str = "ref_tokens",
           mode: str = "pair") -> DataFrame:
    """BLEU-n.  ``pair``: per-pair token BLEU (see ``bleu_scores``).  ``sequence``:
    the original's call, where whole answers (ordered by ``keys``) are the tokens
    of one corpus-level hypothesis and reference (``bleu_sequence``)."""
    if mode == "sequence":
        return bleu_sequence(pairs, keys, hyp, ref, n).filter(F.col("n") == n).select(F.col("bleu").alias(f"bleu_{n}"))
    return bleu_scores(pairs, keys, (n,), hyp, ref)


def bleu_sequence(pairs: DataFrame, keys: list[str], response: str = "response", target: str = "target",
                  max_n: int = 4) -> DataFrame:
    """Corpus BLEU where each whole answer is one token, answers ordered by ``keys``.

    Rows are numbered by the distributed numbering; the k-th following answer
    is attached by an equi-join on ``index + k`` (no global window).  Returns
    per order ``n``: clipped matches, n-gram count and the cumulative BLEU-n.
    """
    # number the (narrow) keys, then bring the answers back by key
    idx = dense_row_number(pairs.select(*keys), [F.col(k) for k in keys], "_i")
    numbered = pairs.select(*keys, response, target).join(idx, keys)
    # read once per order by the shifted joins below: write it once
    # (answers travel on as 128-bit digests, so the joins and group keys stay narrow)
    digest = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))
    base = materialize(numbered.select("_i", digest(F.col(response)).alias("_h0"), digest(F.col(target)).alias("_r0")),
                       "sequence-answers")
    grams = base
    for j in range(1, max_n):
        shifted = base.select((F.col("_i") - j).alias("_i"), F.col("_h0").alias(f"_h{j}"), F.col("_r0").alias(f"_r{j}"))
        grams = grams.join(shifted, "_i", "left")
    items = []
    for k in range(1, max_n + 1):
        present = F.col(f"_h{k - 1}").isNotNull() if k > 1 else F.lit(True)
        for is_h, side in ((True, "_h"), (False, "_r")):
            g = F.array(*[F.col(f"{side}{j}") for j in range(k)])
            items.append(F.struct(F.lit(k).alias("n"), F.lit(is_h).alias("h"), F.when(present, g).alias("g")))
    ex = grams.select(F.explode(F.array(*items)).alias("_x")).select("_x.*").filter(F.col("g").isNotNull())
    c = ex.groupBy("n", "g").agg(F.count_if(F.col("h")).alias("_ch"), F.count_if(~F.col("h")).alias("_cr"))
    per = c.groupBy("n").agg(F.sum(F.least("_ch", "_cr")).cast("bigint").alias("matches"),
                             F.sum("_ch").cast("bigint").alias("total"))
    # at most max_n rows: a window without partitioning is bounded here
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lp = F.when(F.col("matches") > 0, F.log(F.col("matches") / F.col("total")))
    per = per.withColumn("_zero", F.max((F.col("matches") == 0).cast("int")).over(w)) \
             .withColumn("_slp", F.sum(lp).over(w))
    # hypothesis and reference have the same number of answers, so the brevity penalty is 1
    bleu = F.when(F.col("_zero") == 1, F.lit(0.0)).otherwise(F.exp(F.col("_slp") / F.col("n")))
    return per.select("n", "matches", "total", bleu.alias("bleu"))


# ---------------------------------------------------------------- LCS / ROUGE-L

def _lcs(a, b) -> int:
    """LCS length with the bit-parallel recurrence (Hyyrö 2004): O(len(a) * len(b) / 64).

    Bit j of ``v`` is 0 when reference position j is used by the LCS so far;
    the answer is the number of zero bits.
    """
    a = list(a) if a is not None else []
    b = list(b) if b is not None else []
    if not a or not b:
        return 0
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Token LCS length per pair (bit-parallel kernel, whole token lists)."""
    return pd.Series([_lcs(x, y) for x, y in zip(a, b)], dtype="int64")


def _sentences(tokens) -> list[list[str]]:
    """Stretches of tokens between full stops, empty ones left out."""
    out: list[list[str]] = [[]]
    for t in (tokens if tokens is not None else []):
        if t == ".":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def _summary_overlap(hyp, ref) -> tuple[int, int, int]:
    """Distinct words of the union of the sentences' common subsequences, of the hypothesis, of the reference."""
    hs, rs = _sentences(hyp), _sentences(ref)
    union = set().union(*[common_words(r, h) for r in rs for h in hs])
    return len(union), len({w for s in hs for w in s}), len({w for s in rs for w in s})


@pandas_udf(T.StructType([T.StructField("lcs", T.LongType()), T.StructField("h", T.LongType()),
                          T.StructField("r", T.LongType())]))
def summary_overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_summary_overlap(x, y) for x, y in zip(a, b)], columns=["lcs", "h", "r"])


def rouge_l(pairs: DataFrame, keys: list[str], hyp: str = "hyp_tokens", ref: str = "ref_tokens",
            mode: str = "sentence", tile: int | None = None) -> DataFrame:
    """Per-pair ROUGE-L F = 2PR / (P + R + 1e-8) (empty sides give 0).

    ``sentence``: LCS of the token lists; a pair is one row's work.  With
    ``tile`` pairs of which a side is longer are cut into tiles of that many
    tokens, which spread over tasks (``lcs.lcs_tiled``; ``keys`` are unique
    then).  ``summary``: tokens are split into sentences at full stops; the
    words of the LCS of every reference and hypothesis sentence, found in
    memory linear in their lengths, are united and counted against the distinct
    words of each side.
    """
    if mode == "sentence" and tile is not None:
        x, y = F.coalesce(hyp, F.array().cast("array<string>")), F.coalesce(ref, F.array().cast("array<string>"))
        sized = pairs.select(F.struct(*keys).alias("pair"), x.alias("_x"), y.alias("_y"), F.size(x).alias("_h"), F.size(y).alias("_r"))
        long = F.greatest("_h", "_r") > tile
        whole = sized.filter(~long).select("pair", "_h", "_r", lcs_length(F.col("_x"), F.col("_y")).alias("lcs"))
        tiled = materialize(sized.filter(long), "rouge-long")  # read by each side, and the tokens of all pairs are costly to find
        counted = lcs_tiled(tiled.select("pair", "_x", "_y"), "_x", "_y", tile)
        d = whole.unionByName(tiled.select("pair", "_h", "_r").join(counted, "pair")).select("pair.*", "_h", "_r", "lcs")
    elif mode == "sentence":
        d = pairs.select(*keys, F.size(hyp).alias("_h"), F.size(ref).alias("_r"),
                         lcs_length(F.col(hyp), F.col(ref)).alias("lcs"))
    elif mode == "summary":
        d = pairs.select(*keys, summary_overlap(F.col(hyp), F.col(ref)).alias("_x")).select(
            *keys, F.col("_x.h").alias("_h"), F.col("_x.r").alias("_r"), F.col("_x.lcs").alias("lcs"))
    else:
        raise ValueError(f"unknown ROUGE-L mode {mode}")
    p = F.try_divide(F.col("lcs").cast("double"), F.col("_h").cast("double"))
    r = F.try_divide(F.col("lcs").cast("double"), F.col("_r").cast("double"))
    f = F.coalesce(2 * p * r / (p + r + F.lit(C.F_EPS)), F.lit(0.0))
    return d.select(*keys, "lcs", f.alias("rouge_l"))


# ---------------------------------------------------------------- METEOR

def _align(h: list, r: list, free_h: list[int], free_r: list[int], forms) -> list[tuple[int, int]]:
    """Greedy alignment from the end: each free hypothesis word (last first) takes the last free
    reference word that shares a form with it; ``forms(word)`` lists a word's forms."""
    places: dict = {}
    for j in free_r:
        for form in forms(r[j]):
            places.setdefault(form, []).append(j)
    used, out = set(), []
    for i in reversed(free_h):
        best = -1
        for form in forms(h[i]):
            stack = places.get(form, [])
            while stack and stack[-1] in used:
                stack.pop()
            if stack:
                best = max(best, stack[-1])
        if best >= 0:
            used.add(best)
            out.append((i, best))
    return out


def _meteor(hyp, ref, stem: bool = False, senses=None, alpha=C.METEOR_ALPHA, beta=C.METEOR_BETA,
            gamma=C.METEOR_GAMMA) -> float:
    h = [w.lower() for w in (hyp if hyp is not None else [])]
    r = [w.lower() for w in (ref if ref is not None else [])]
    stages = [lambda w: (w,)]
    if stem:
        stages.append(lambda w: (porter_stem(w),))
    if senses is not None:
        table: dict = {}
        for word, sense in senses:
            table.setdefault(word.lower(), []).append(sense)
        stages.append(lambda w: table.get(w, ()))
    matches: list[tuple[int, int]] = []
    for forms in stages:
        done_h, done_r = {i for i, _ in matches}, {j for _, j in matches}
        matches += _align(h, r, [i for i in range(len(h)) if i not in done_h],
                          [j for j in range(len(r)) if j not in done_r], forms)
    m = len(matches)
    if m == 0:
        return 0.0
    matches.sort()
    chunks = 1 + sum((i + 1, j + 1) != (k, l) for (i, j), (k, l) in zip(matches, matches[1:]))
    p, rc = m / len(h), m / len(r)
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    return fmean * (1 - gamma * (chunks / m) ** beta)


def _meteor_udf(stem: bool):
    @pandas_udf(T.DoubleType())
    def score(h: pd.Series, r: pd.Series, senses: pd.Series) -> pd.Series:
        return pd.Series([_meteor(x, y, stem, None if s is None else [(v["word"], v["sense"]) for v in s])
                          for x, y, s in zip(h, r, senses)], dtype="float64")
    return score


def meteor(pairs: DataFrame, keys: list[str], hyp: str = "hyp_tokens", ref: str = "ref_tokens",
           stem: bool = False, synonyms: DataFrame | None = None) -> DataFrame:
    """Per-pair METEOR: exact matches, then (``stem``) equal Porter stems, then shared senses.

    ``synonyms`` has rows (word, sense), words in lower case; each pair gets
    the senses of its own words by a join, so the table may be of any size.
    """
    d = pairs.select(*keys, F.col(hyp).alias("_h"), F.col(ref).alias("_r"))
    none = F.lit(None).cast("array<struct<word:string,sense:string>>")
    if synonyms is None:
        return d.select(*keys, _meteor_udf(stem)("_h", "_r", none).alias("meteor"))
    words = d.select(*keys, F.explode(F.array_distinct(F.transform(
        F.concat(F.coalesce("_h", F.array().cast("array<string>")), F.coalesce("_r", F.array().cast("array<string>"))),
        F.lower))).alias("word"))
    own = (words.join(synonyms.select("word", F.col("sense").cast("string").alias("sense")), "word")
           .groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("word", "sense"))).alias("_s")))
    return d.join(own, keys, "left").select(
        *keys, _meteor_udf(stem)("_h", "_r", F.coalesce("_s", F.array().cast("array<struct<word:string,sense:string>>")))
        .alias("meteor"))


# ---------------------------------------------------------------- one pass per pair

_PAIR_KERNEL_TYPE = T.StructType([
    T.StructField("lcs", T.LongType()), T.StructField("nh", T.LongType()), T.StructField("nr", T.LongType()),
    T.StructField("m", T.ArrayType(T.LongType())), T.StructField("t", T.ArrayType(T.LongType())), T.StructField("meteor", T.DoubleType())])


def _pair_kernel(rouge_mode: str, stem: bool):
    @pandas_udf(_PAIR_KERNEL_TYPE)
    def kernel(h: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(h, r):
            nh, nr = (0 if v is None else len(v) for v in (x, y))
            lcs = (_lcs(x, y), nh, nr) if rouge_mode == "sentence" else _summary_overlap(x, y)
            rows.append((*lcs, *_clipped(x, y, 4), _meteor(x, y, stem) if nr else 0.0))
        return pd.DataFrame(rows, columns=_PAIR_KERNEL_TYPE.names)
    return kernel


def pair_scores(toks: DataFrame, keys: list[str], hyp: str = "hyp_tokens", ref: str = "ref_tokens",
                rouge_mode: str = "sentence", stem: bool = False) -> DataFrame:
    """ROUGE-L, BLEU-2/4 and METEOR per pair from one Arrow pass over the pairs.

    Same numbers as ``rouge_l``, ``bleu_scores`` and ``meteor``; ``rouge_l`` is
    null when either side is empty (such pairs are ignored by its mean).
    """
    k = toks.select(*keys, F.size(hyp).alias("_c"), F.size(ref).alias("_r"),
                    _pair_kernel(rouge_mode, stem)(F.col(hyp), F.col(ref)).alias("_k"))
    p = F.try_divide(F.col("_k.lcs").cast("double"), F.col("_k.nh").cast("double"))
    r = F.try_divide(F.col("_k.lcs").cast("double"), F.col("_k.nr").cast("double"))
    rouge = F.when((F.col("_c") > 0) & (F.col("_r") > 0), F.coalesce(2 * p * r / (p + r + F.lit(C.F_EPS)), F.lit(0.0)))
    bp = F.when(F.col("_c") > F.col("_r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("_r") / F.col("_c")))
    cols = []
    for n in (2, 4):
        m = F.slice(F.col("_k.m"), 1, n)
        t = F.slice(F.col("_k.t"), 1, n)
        ok = F.size(F.filter(m, lambda x: x > 0)) == n
        slp = F.aggregate(F.zip_with(m, t, lambda a, b: F.log(a / b)), F.lit(0.0), lambda acc, x: acc + x)
        cols.append(F.when((F.col("_c") > 0) & ok, bp * F.exp(slp / n)).otherwise(F.lit(0.0)).alias(f"bleu_{n}"))
    return k.select(*keys, rouge.alias("rouge_l"), *cols, F.col("_k.meteor").alias("meteor"))


# ---------------------------------------------------------------- report

def metric_tokens(pairs: DataFrame, keys: list[str], response: str = "response", target: str = "target") -> DataFrame:
    """strip markers → tokenize → space-join → whitespace tokens, for both sides."""
    def side(c):
        return whitespace_tokens(F.array_join(tokenize(strip_markers(F.col(c))), " "))
    return pairs.select(*keys, side(response).alias("hyp_tokens"), side(target).alias("ref_tokens"))


def generation_report(pairs: DataFrame, keys: list[str], response: str = "response",
                      target: str = "target", by: list[str] | None = None, bleu_mode: str = "pair",
                      rouge_mode: str = "sentence", stem: bool = False) -> DataFrame:
    """rouge_l (non-empty pairs), bleu_2, bleu_4, meteor, dist_2 (3-gram compat), rounded to 4.

    One row, or one row per ``by`` group (``by`` columns come from ``pairs``).
    The processed token table is written once and read by every metric.
    ``bleu_mode='sequence'`` scores BLEU as the original calls it (whole
    processed answers as tokens, ungrouped); ``rouge_mode`` and ``stem`` are
    those of ``rouge_l`` and ``meteor``.
    """
    by = by or []
    toks = metric_tokens(pairs.select(*keys, *[c for c in by if c not in keys], response, target),
                         keys + [c for c in by if c not in keys], response, target)
    toks = materialize(toks)
    ids = keys + [c for c in by if c not in keys]
    # one Arrow pass per pair for rouge_l / bleu / meteor, one aggregation over
    # it, melted in a single projection (so the pass is not repeated per metric)
    ps = pair_scores(toks, ids, rouge_mode=rouge_mode, stem=stem).groupBy(*by).agg(
        F.avg("rouge_l").alias("rouge_l"), F.avg("bleu_2").alias("bleu_2"),
        F.avg("bleu_4").alias("bleu_4"), F.avg("meteor").alias("meteor"))
    from_pairs = ["rouge_l", "meteor"] if bleu_mode == "sequence" else ["rouge_l", "bleu_2", "bleu_4", "meteor"]
    long = ps.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                              for m in from_pairs])).alias("_x")).select(*by, "_x.*")
    if bleu_mode == "sequence":
        if by:
            raise ValueError("sequence-mode BLEU is one corpus score; it has no groups")
        joined = toks.select(*ids, F.array_join("hyp_tokens", " ").alias("_h"), F.array_join("ref_tokens", " ").alias("_r"))
        seq = bleu_sequence(joined, ids, "_h", "_r", 4).filter(F.col("n").isin(2, 4))
        long = long.unionByName(seq.select(F.concat(F.lit("bleu_"), F.col("n").cast("string")).alias("metric"),
                                           F.col("bleu").cast("double").alias("value")))
    dist = ngram_stats(ngram_counts(toks, "hyp_tokens", (3,), by), by)
    long = long.unionByName(dist.select(*by, F.lit("dist_2").alias("metric"),
                                        F.col("distinct_ratio").cast("double").alias("value")))
    # long form (group, metric, value) then one pivot: no joins between the parts
    names = ["rouge_l", "bleu_2", "bleu_4", "meteor", "dist_2"]
    return long.groupBy(*by).pivot("metric", names).agg(F.round(F.first("value"), 4))


# ---------------------------------------------------------------- judge scores

def mean_judge_score(df: DataFrame, reply: str = "judge_reply", by: list[str] | None = None,
                     pattern: str = C.SCORE_PATTERN) -> DataFrame:
    """Mean parsed judge score (blank replies score 0; unparsed replies are counted apart)."""
    d = df.withColumn("_score", parse_judge_score(F.col(reply), pattern))
    aggs = [F.count(F.lit(1)).alias("n"), F.count("_score").alias("n_scored"),
            F.round(F.avg("_score"), 6).alias("mean_score")]
    return d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)
