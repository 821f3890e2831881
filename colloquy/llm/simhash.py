"""SimHash near-duplicate groups with pigeonring candidate filtering.

A fingerprint is 64 bits, cut into a ring of 8 segments.  If two fingerprints
differ in at most d bits, some segment starts a chain whose first l segments
differ in at most floor(l * d / 8) bits, for every l from 1 to 8 (pigeonring
principle).  For d = 2 such a chain opens with three equal segments, and its
first seven differ in one bit at most, so at least three of the next four are
equal as well: a fingerprint is looked up under 8 starts x 4 choices of the
segment that may differ, each with 48 fixed bits.  Only 16 bits are free
within such a bucket, which bounds its members by 65,536 distinct fingerprints
whatever the corpus.  Members of a bucket are held against the chain's budgets
first and then against the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .common import packed, row_key, total, words_of

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 8
XXH_SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text as a signed 64-bit integer; no words: 0."""
    from xxhash import xxh64_intdigest

    words = words_of(text, lower=True)
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashes = np.fromiter((xxh64_intdigest(g, XXH_SEED) for g in grams), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at:at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    return run


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """``fingerprint`` as a column of bigint, evaluated in Arrow batches."""
    run = _fingerprints(shingle)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "bigint")(text)


def budgets(max_bits: int) -> list[int]:
    """Bits that the first 1, 2, ... segments of a chain may differ in."""
    return [(length * max_bits) // SEGMENTS for length in range(1, SEGMENTS + 1)]


def chain_keys(fp: Column, max_bits: int = MAX_BITS) -> Column:
    """Bucket keys of a fingerprint: one per start of the chain and segment that may differ."""
    b = budgets(max_bits)
    equal, single = b.count(0), b.count(1)
    keys = []
    for start in range(SEGMENTS):
        for free in range(max(single, 1)):
            fixed = [k for k in range(equal + single) if k != equal + free]
            mask = sum(0xFF << (8 * ((start + k) % SEGMENTS)) for k in fixed)
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.struct(F.lit(start * SEGMENTS + free).alias("chain"),
                                 fp.bitwiseAND(F.lit(signed).cast("bigint")).alias("part")))
    return F.array(*keys)


def _segment_bits(diff: np.ndarray, start: int, max_bits: int) -> np.ndarray:
    """True where the chain from ``start`` keeps its budgets and the whole distance does too."""
    bits = np.bitwise_count(diff.view(np.uint8).reshape(-1, SEGMENTS))
    order = [(start + k) % SEGMENTS for k in range(SEGMENTS)]
    run = np.cumsum(bits[:, order], axis=1)
    chain = (run[:, :-1] <= np.array(budgets(max_bits)[:-1])).all(axis=1)
    out = np.zeros(len(diff), bool)
    out[chain] = np.bitwise_count(diff[chain]) <= max_bits
    return out


def _bucket_links(chain: int, members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect the members of a bucket as all their close pairs would.

    Members are reached one from another: each is held against those not yet
    reached, so a bucket of m members gives fewer than m links.
    """
    start = chain // SEGMENTS
    left = np.unique(members).view("<u8")
    links: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = _segment_bits(left ^ one, start, max_bits)
            if near.any():
                links += [(int(one.view("<i8")), int(x)) for x in left[near].view("<i8")]
                queue += list(left[near])
                left = left[~near]
    return links


def _link_batches(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            links = [x for chain, m in zip(rows["chain"], rows["members"])
                     for x in _bucket_links(chain, np.asarray(m, "<i8"), max_bits)]
            yield pd.DataFrame(links, columns=["u", "v"], dtype="int64")
    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints (column ``fp``) at ``max_bits`` or fewer bits."""
    keyed = distinct.select("fp", F.inline(chain_keys(F.col("fp"), max_bits)))
    buckets = (keyed.groupBy("chain", "part").agg(F.collect_list("fp").alias("members"))
               .filter(F.size("members") > 1).select("chain", "members"))
    links = buckets.mapInPandas(_link_batches(max_bits), "u bigint, v bigint")
    return links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, root) of every node in ``links`` (u, v): root is the smallest node reachable.

    Alternating large-star and small-star steps: every node hangs its larger,
    then its smaller neighbours under the smallest one, until nothing changes.
    The least neighbour of a node is an aggregate with partial sums on the map
    side, joined back to its links, so a hub's links need not meet in one task.
    Every step is a written table in the shared folder.
    """
    def star(edges: DataFrame, name: str, large: bool) -> DataFrame:
        if large:
            both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        hung = both.join(least, "u")
        if large:
            out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                least.select("u", F.col("m").alias("v")))
        return materialize(out.filter("u <> v").distinct(), name)

    def state(edges: DataFrame) -> list:
        digest = F.xxhash64("u", "v")
        return total(edges, F.count(F.lit(1)), F.sum(digest.cast("decimal(38,0)")), F.bit_xor(digest))

    edges = materialize(links, "links")
    before = state(edges)
    while before[0]:
        edges = star(star(edges, "large-star", True), "small-star", False)
        after = state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (id, k1, k2, fingerprint, component_id, root), one per row of ``df``.

    (k1, k2) is the row's digest of id and text, ``fingerprint`` 16 lower-case
    hex digits, ``component_id`` the smallest id reachable over links, ``root``
    the group's smallest fingerprint, which names it also where ids are null or
    shared by different texts.  Null and empty texts have fingerprint zero and
    link like any other; rows with a null id group as others do but lend no
    id: a group of null ids only has a null component.  Equal rows (also ties
    in id) give equal results, an empty table none.  Columns of ``df`` besides
    id and text are not read.
    """
    k1, k2 = row_key([id_col, text_col])
    prints = materialize(df.select(F.col(f"`{id_col}`").alias("id"), k1.alias("k1"), k2.alias("k2"),
                                   fingerprint_column(F.col(f"`{text_col}`"), shingle).alias("fp")), "simhash")
    # copies collapse before any pairing: one row per distinct fingerprint
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = materialize(connected_components(fingerprint_links(spread(classes), max_bits)), "simhash-roots")
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    labels = linked.join(named, "root").select("fp", "root", "component")
    # classes without links are their own root and keep their own least id
    every = classes.join(labels, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"))
    # written, so that the last join has plain shuffles on both sides and AQE can split a hot fingerprint
    every = materialize(every, "simhash-labels")
    return prints.join(every, "fp").select("id", "k1", "k2", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id", "root")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``df`` per group of near duplicates: the one with the smallest id, then the smallest digest.

    Rows with null ids come last in a group; repeated rows leave one.
    """
    groups = materialize(simhash_groups(df, id_col, text_col, shingle, max_bits), "simhash-groups")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2"))
    keep = groups.groupBy("root").agg(first.alias("x")).select("x.k1", "x.k2")
    k1, k2 = row_key([F.col("rec")[id_col], F.col("rec")[text_col]])
    keyed = packed(df).withColumns({"k1": k1, "k2": k2})
    kept = keyed.join(keep, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*[F.col("rec")[c].alias(c) for c in df.columns])
