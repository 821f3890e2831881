"""Line dedup, mixing and sharding against plain Python, and their edge cases."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from colloquy.llm import line_dedup, mixing, sharding
from colloquy.llm.common import count_words

from .helpers import CLASHING, SCHEMA, edge_rows, edges, empty, words

SPACES = " \t\n\x0b\f\r"


def brute_lines(rows):
    """rows: (id, text), ids distinct and not null."""
    seen, gone = set(), defaultdict(set)
    for i, text in sorted(rows):
        lines = [x.strip(SPACES) for x in text.split("\n")]
        full = [k for k, x in enumerate(lines) if x]
        for j in range(len(full) - 2):
            w = tuple(lines[k] for k in full[j:j + 3])
            if w in seen:
                gone[i].update(range(j, j + 3))
            seen.add(w)
    out = {}
    for i, text in rows:
        lines = text.split("\n")
        kept, j = [], -1
        for x in lines:
            j += bool(x.strip(SPACES))
            if max(j, 0) not in gone[i]:
                kept.append(x)
        out[i] = (j + 1, len(gone[i]), "\n".join(kept))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    pool = [words(rng, 3) for _ in range(12)] + ["", "  ", " padded "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_edges(spark):
    got = line_dedup.dedup_lines(edges(spark, clashing=True))
    rows = got.collect()
    assert len(rows) == len(edge_rows())
    assert {c.lower() for c in got.columns} == {c.lower() for c in SCHEMA.names + list(CLASHING)} | {"n_removed"}
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[1][0].text is None and by_id[1][0].n_lines == 0
    assert by_id[2][0].text == "" and by_id[3][0].text == " \n\t \x0b\n"
    # the null id comes first; the repeated rows and the other copy lose all lines
    assert {(r.n_removed, r.text) for r in by_id[8]} == {(6, "")}
    # repeated rows are one place and are treated alike
    assert len({(r.n_removed, r.text) for r in by_id[7] if "other" not in (r.text or "")}) <= 2
    assert by_id[10][0].text == "one two"
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {s: 0.0 for s in names}, set()
    left = float(total)
    while left > 1e-9 and len(full) < len(names):
        open_ = [s for s in names if s not in full]
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in open_:
            target[s] += share * w[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                full.add(s)
    return target


@pytest.mark.parametrize("block", [4, 256])
def test_mixing_targets_and_copies(spark, block):
    rng = random.Random(2)
    rows = [(i, int(rng.paretovariate(1.3) * 20), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)]
    rows += [(5000 + i, 3, "tiny") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint, source string")
    mixed = mixing.mix_sources(df, F.col("n"), block=block).cache()
    got = mixed.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    want = brute_targets(sizes)
    per = defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        per[r.source].append(r)
    for s, own in per.items():
        ratio = want[s] / sizes[s]
        copies = sum(r.copies for r in own)
        # dependent rounding keeps the number of copies within one of its expectation
        assert abs(copies - ratio * len(own)) < 1 + 1e-6
        assert all(r.copies in (int(ratio), int(ratio) + 1) or r.copies == 3 for r in own)
        taken = sum(r.copies * r.size for r in own)
        assert abs(taken - want[s]) <= max(0.05 * want[s], 3 * max(r.size for r in own))
    again = mixing.mix_sources(df.repartition(7), F.col("n"), block=block)
    assert again.select("doc_id", "copies").exceptAll(mixed.select("doc_id", "copies")).count() == 0


def test_mixing_is_unbiased(spark):
    rows = [(i, 10, "a") for i in range(40)] + [(100, 400, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint, source string")
    hits = Counter()
    for seed in range(4):
        for r in mixing.mix_sources(df, F.col("n"), weights=(1, 3), block=8, seed=seed).collect():
            hits[r.doc_id] += r.copies
    # every document of the first source is taken half the time
    mean = sum(hits[i] for i in range(40)) / 40 / 4
    assert mean == pytest.approx(0.5, abs=1e-9) and len(set(hits.values())) > 2


def test_mixing_edges(spark):
    df = edges(spark, clashing=True)
    mixed = mixing.mix_sources(df, count_words(F.col("text")))
    rows = mixed.collect()
    assert len(rows) == len(edge_rows())
    assert len(mixed.columns) == len({c.lower() for c in mixed.columns})
    assert all(0 <= r.copies <= 3 for r in rows)
    taken = mixing.take_copies(mixed, SCHEMA.names)
    assert taken.columns == SCHEMA.names and taken.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(empty(spark), count_words(F.col("text"))).count() == 0
    nothing = spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, None, 0)], SCHEMA)
    assert {(r.copies, r.target) for r in mixing.mix_sources(nothing, count_words(F.col("text"))).collect()} <= {(3, 0.0), (0, 0.0)}


@pytest.mark.parametrize("bucket_bytes", [300, 1 << 20])
def test_sharding_places(spark, bucket_bytes):
    rows = [(i, "x" * (i % 50)) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = sharding.external_shuffle(df, sharding.text_bytes(F.col("text")), bucket_bytes=bucket_bytes).cache()
    got = placed.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the order is shuffled: neighbours in the result are not neighbours in the input
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 30
    again = sharding.external_shuffle(df.repartition(5), sharding.text_bytes(F.col("text")), bucket_bytes=bucket_bytes)
    assert again.exceptAll(placed).count() == 0
    other = sharding.external_shuffle(df, sharding.text_bytes(F.col("text")), bucket_bytes=bucket_bytes, seed=7)
    assert other.exceptAll(placed).count() > 500


def test_sharding_edges_and_writer(spark, tmp_path):
    placed = sharding.external_shuffle(edges(spark, clashing=True), sharding.text_bytes(F.col("text")))
    rows = placed.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(r[:2] for r in edge_rows())
    assert len(placed.columns) == len({c.lower() for c in placed.columns})
    assert sharding.external_shuffle(empty(spark), sharding.text_bytes(F.col("text"))).count() == 0
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("doc_id", "shard", "slot").exceptAll(placed.select("doc_id", "shard", "slot")).count() == 0
