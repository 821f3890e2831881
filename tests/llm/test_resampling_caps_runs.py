"""Importance resampling, cap filters and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import cap_filters, periodic, queries, resampling
from colloquy.llm.common import words_of

from .helpers import edge_rows, edges, empty

SF = "/root/testdata/sf0.001"


# --------------------------------------------------------------- resampling
def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def plain_features(text):
    w = plain_words(text)
    return [zlib.crc32(b" ".join(w[i:i + k])) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(docs, target):
    """Rows (id, n_features, weight, score, rank) of (id, text) rows with distinct ids."""
    s, t = Counter(), Counter()
    feats = {i: plain_features(x) for i, x in docs}
    for f in feats.values():
        s.update(f)
    for x in target:
        t.update(plain_features(x))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000) / ((s[b] + 1.0) * (all_t + 10000))))

    gains = {b: gain(b) for b in s}
    rows = {}
    for i, _ in docs:
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in feats[i])
        rows[i] = [i, len(feats[i]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i, x in docs if len(plain_words(x)) >= 20), key=lambda i: (-rows[i][3], i))
    for k, i in enumerate(able[:5 * len(able) // 100]):
        rows[i][4] = k + 1
    return sorted(tuple(r) for r in rows.values())


def test_windows_have_the_crc_of_their_bytes():
    rng = random.Random(1)
    texts = ["", " ", "x", "A b\tc--D9 Über ÄB", "a" * 300 + " b " + "c" * 1000 + " d e", "w " * 40_000, "q" * 200_000,
             "y" * 254 + " " + "y" * 255 + " " + "y" * 256 + " end", "a\x00b c 漢字かな"]
    texts += ["".join(rng.choice("aB9 ,.é漢") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    for text in texts:
        words, lengths = resampling.split_words(text)
        assert words == plain_words(text)
        for longest in (1, 3, 5):
            want = [zlib.crc32(b" ".join(words[i:i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
            assert resampling.window_crcs(words, lengths, longest).tolist() == want


def test_op11_is_the_plain_draw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op11_resampling"](spark, SF).collect())
    want = plain_resample([(r.doc_id, r.text) for r in docs], target)
    assert got == want and sum(r[4] is not None for r in got) > 5


def test_resampling_edges(spark):
    target = spark.createDataFrame([("the river of stone",), (None,), ("",)], "text string")
    rows = resampling.importance_resample(edges(spark, clashing=True), target).collect()
    assert len(rows) == len(edge_rows())
    by = {}
    for r in rows:
        by.setdefault((r.k1, r.k2), set()).add((r.n_features, r.weight, r.score))
    assert all(len(v) == 1 for v in by.values())  # equal rows weigh alike
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1 + 5 * sum(r.n_words >= 20 for r in rows) // 100))
    assert all(r.weight == 0 and r["rank"] is None for r in rows if not r.n_features)
    assert resampling.importance_resample(empty(spark), target).collect() == []
    none = resampling.importance_resample(edges(spark), target.limit(0), percent=100).collect()
    assert sum(r["rank"] is not None for r in none) == sum(r.n_words >= 20 for r in none)


def test_drawn_rows_come_back_whole(spark):
    docs = edges(spark, clashing=True).withColumn("rank", F.lit("old"))
    ranked = resampling.importance_resample(docs, spark.createDataFrame([("tree",)], "text string"), percent=50)
    drawn = resampling.drawn_rows(docs, ranked).collect()
    want = sorted(r["rank"] for r in ranked.collect() if r["rank"])
    assert sorted(r["rank"] for r in drawn) == want and len(drawn[0]) == len(docs.columns)


def test_ties_go_to_the_smaller_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, text) for i in range(100)], "doc_id long, text string")
    rows = resampling.importance_resample(docs, docs, percent=10).orderBy("rank").filter("rank IS NOT NULL").collect()
    every = plain_resample([(i, text) for i in range(100)], [text] * 100)
    assert [r.id for r in rows] == [r[0] for r in sorted(every, key=lambda r: (-r[3], r[0]))[:10]]


# -------------------------------------------------------------- cap filters
def near(rng, x, cosine):
    z = rng.standard_normal(len(x))
    z -= (z @ x) * x
    return cosine * x + math.sqrt(1 - cosine ** 2) * z / np.linalg.norm(z)


def vectors(rng, dim=32):
    """Rows (vec_id, embedding, label): background, groups around centres, copies, rows that cannot link."""
    rows = []

    def put(x, label):
        rows.append((len(rows) * 7 % 1009, None if x is None else [None if v is None else float(v) for v in x], label))

    for _ in range(150):
        put(rng.standard_normal(dim), int(rng.integers(3)))
    for size in (2, 3, 10, 60):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        label = int(rng.integers(3))
        for _ in range(size):
            put(near(rng, c, rng.uniform(0.985, 0.9999)) * rng.uniform(0.1, 50), label)
    copy = rng.standard_normal(dim)
    for k in range(40):
        put(copy, 1 if k % 4 else 2)
    put(2 * copy, 1)
    put(-copy, 1)
    put(copy, None)
    put(copy, None)
    put(None, 1)
    put([], 1)
    put([0.0] * dim, 1)
    put([0.0] * dim, 1)
    put([float("nan")] + [1.0] * (dim - 1), 1)
    put([float("inf")] + [1.0] * (dim - 1), 1)
    put([None] + [1.0] * (dim - 1), 1)
    put([1e-300] * dim, 2)
    put([1e300] * dim, 2)
    put([1.0] * (dim + 1), 2)
    return rows


def plain_groups(rows):
    """(vec_id, n_links, component_id, kept) with every pair compared."""
    n = len(rows)
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)
          and any(v) for _, v, lab in rows]
    unit = [cap_filters.unit_vectors(np.array([v]))[0] if o else None for (_, v, _), o in zip(rows, ok)]
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) \
                    and unit[i] @ unit[j] >= 0.98:
                links[i].append(j)
    out, seen = [], {}
    for i in range(n):
        if i in seen:
            continue
        group, queue = {i}, [i]
        while queue:
            for j in links[queue.pop()]:
                if j not in group:
                    group.add(j)
                    queue.append(j)
        least = min(rows[j][0] for j in group)
        seen.update({j: least for j in group})
    for i in range(n):
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out)


@pytest.mark.parametrize("block", [512, 8])
def test_cap_groups_are_those_of_all_pairs(spark, block):
    rows = vectors(np.random.default_rng(11))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("cid", "n", "caps", "u", "id", "blocks", "count", "root")])
    got = cap_filters.cap_groups(df, block=block).select("id", "n_links", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got) == plain_groups(rows)


def test_cap_groups_of_floats_ids_and_empty_tables(spark):
    x = [0.5, -0.25, 1.0, 2.0]
    df = spark.createDataFrame([(None, x, "a"), (None, x, "a"), (5, x, "b"), (5, x, "b"), (6, x, "b"), (None, x, None)],
                               "vec_id long, embedding array<float>, label string")
    got = sorted((tuple(r) for r in cap_filters.cap_groups(df).select("id", "n_links", "component_id", "kept").collect()),
                 key=str)
    assert got == sorted([(None, 1, None, True)] * 2 + [(5, 2, 5, True)] * 2 + [(6, 2, 5, False), (None, 0, None, True)], key=str)
    assert cap_filters.cap_groups(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        cap_filters.cap_groups(df, cosine=0)


@pytest.mark.parametrize("rows", [500, 10 ** 6])
def test_vectors_just_at_the_limit_share_a_cap(rows):
    rng = np.random.default_rng(2)
    for dim in (16, 64, 300):
        a = cap_filters.unit_vectors(rng.standard_normal((800, dim)))
        b = np.stack([near(rng, x, 0.98) for x in a])
        shape = cap_filters.code_shape(rows, dim)
        code, alpha = cap_filters.product_code(dim, *shape), cap_filters.cap_height(dim, *shape)
        at, word = cap_filters.caps_of(a, code, alpha)
        bt, bord = cap_filters.caps_of(b, code, alpha)
        shared = {i for i, _ in set(zip(at.tolist(), word.tolist())) & set(zip(bt.tolist(), bord.tolist()))}
        assert len(shared) >= 0.99 * 800 and np.bincount(at).min() >= cap_filters.LEAST_CAPS


def test_list_decoding_finds_all_exceeding_directions():
    rng = np.random.default_rng(4)
    unit = cap_filters.unit_vectors(rng.standard_normal((50, 24)))
    rotation, parts = cap_filters.product_code(24, 3, 9)
    sums = [(unit @ rotation)[:, cut] @ g for cut, g in parts]
    every = (sums[0][:, :, None, None] + sums[1][:, None, :, None] + sums[2][:, None, None, :]).reshape(50, -1)
    at, word = cap_filters.list_decode(sums, np.full(50, 0.2))
    assert sorted(zip(at.tolist(), word.tolist())) == sorted(map(tuple, np.argwhere(every >= 0.2).tolist()))


def test_op12_links_on_the_given_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    got = sorted(tuple(r) for r in queries.QUERIES["op12_embedding_dedup"](spark, SF).collect())
    assert got == plain_groups([tuple(r) for r in rows])


# ------------------------------------------------------------ periodic runs
def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def plain_collapse(w, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_are_those_of_brute_force():
    rng = random.Random(8)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            if w:
                a, p = rng.randrange(len(w)), rng.randint(1, 15)
                for i in range(a + p, min(len(w), a + rng.randint(1, 90))):
                    w[i] = w[a + (i - a) % p]
        assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w)
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, np.int64), exponent=3)


def test_long_runs():
    n = 300_000
    assert periodic.find_runs(np.arange(n) % 70_001) == [(0, n, 70_001)]
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.find_runs(np.arange(n)) == []


def test_periodic_runs_of_edge_rows(spark):
    df = edges(spark, clashing=True)
    found = periodic.periodic_runs(df, F.col("text"), keep=["doc_id", "text", "SLOT"]).collect()
    assert len(found) == len(edge_rows())
    for r in found:
        w = [x.decode() for x in words_of(r.rec.text)]
        assert r.n_words == len(w) and r.rec.SLOT == "SLOT"
        if len(w) < 500:
            assert [tuple(x) for x in r.runs] == plain_runs(w)
        assert r.collapsed == plain_collapse(w, [tuple(x) for x in r.runs])
    assert periodic.periodic_runs(empty(spark), F.col("text")).collect() == []


def test_op13_plants_and_finds_periods(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc in docs:
        w = [x.decode() for x in words_of(doc.text)]
        n, h = len(w), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 2000:
            continue
        runs, r = plain_runs(w), got[doc.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3) and r.n_runs == len(runs)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(w, runs).encode()).hexdigest()
    assert planted > 5
