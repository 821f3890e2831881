"""Near-duplicate vectors through spherical-cap filters with list decoding.

Filter directions are the words of a random product code: the (randomly
rotated) space is cut into blocks of dimensions, every block has its own list
of random directions, and one choice per block is a direction of the whole
space.  A vector lies in the cap of a direction if their inner product reaches
``alpha``.  List decoding finds all those directions block by block and gives
up a partial choice as soon as the best rest cannot lift it over ``alpha``, so
the work follows the list and not the size of the code.

The code grows with the table: its size is chosen such that a cap holds some
``per_cap`` vectors of a label, and ``alpha`` such that a random vector lies in
``caps`` of them.  A vector in fewer than ``least_caps`` lowers its own alpha
until it has as many; otherwise vectors that the blocks cut badly would lose
their links.  Two vectors are compared if they share a cap, and a linked pair
is counted in the smallest cap that both lie in, so never twice.  Caps with
more than ``BLOCK`` vectors are compared block by block, each pair of blocks
in its own group; a group yields one sum a vector and links that connect what
its close pairs connect, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, materialize, spread
from .common import row_key, total
from .simhash import connected_components

COSINE = 0.98
CAPS = 16         # caps of a random vector, on average
LEAST_CAPS = 12   # caps of every vector at least
PER_CAP = 64      # random vectors of a label in a cap, on average
BLOCK = 512       # vectors of a block in a large cap
SEED = 42
_LIST = 256       # directions of a block of dimensions at most
_STEP = 0.01


def code_shape(rows: int, dim: int, caps: int = CAPS, per_cap: int = PER_CAP) -> tuple[int, int]:
    """(blocks, directions a block) of a code for ``rows`` vectors of a label.

    At least 64 directions in all, at most 2^dim: caps narrower than the links would lose them.
    """
    size = max(64.0, min(rows * caps / per_cap, 2.0 ** dim))
    blocks = 2
    while size ** (1 / blocks) > _LIST:
        blocks += 1
    return min(blocks, dim), int(np.ceil(size ** (1 / blocks)))


@lru_cache(maxsize=8)
def product_code(dim: int, blocks: int, directions: int, seed: int = SEED) -> tuple[np.ndarray, list]:
    """A random rotation and, for each block, its dimensions and its directions as columns."""
    rng = np.random.default_rng([seed, dim, blocks, directions])
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    parts = []
    for cut in np.array_split(np.arange(dim), blocks):
        g = rng.standard_normal((len(cut), directions))
        parts.append((cut, g / np.linalg.norm(g, axis=0) / np.sqrt(blocks)))
    return rotation, parts


def list_decode(sums: list[np.ndarray], alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, direction) of all caps: inner products by block (vectors x directions) and each vector's alpha."""
    best = [s.max(axis=1) for s in sums]
    at, have, word = np.arange(len(alpha)), np.zeros(len(alpha)), np.zeros(len(alpha), np.int64)
    for k, s in enumerate(sums):
        need = alpha - sum(best[k + 1:])
        grown = have[:, None] + s[at]
        row, pick = np.nonzero(grown >= need[at][:, None])
        at, have, word = at[row], grown[row, pick], word[row] * s.shape[1] + pick
    return at, word


def caps_of(unit: np.ndarray, code: tuple[np.ndarray, list], alpha: float,
            least: int = LEAST_CAPS) -> tuple[np.ndarray, np.ndarray]:
    """(vector, direction) of the caps of unit vectors, both ascending; every vector has ``least`` or more."""
    rotation, parts = code
    turned = unit @ rotation
    sums = [turned[:, cut] @ g for cut, g in parts]
    least = min(least, int(np.prod([float(s.shape[1]) for s in sums])))
    left, level, found = np.arange(len(unit)), np.full(len(unit), float(alpha)), []
    while len(left):
        at, word = list_decode([s[left] for s in sums], level[left])
        full = np.bincount(at, minlength=len(left)) >= least
        found.append((left[at[full[at]]], word[full[at]]))
        left = left[~full]
        level[left] -= _STEP
    at, word = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
    order = np.lexsort((word, at))
    return at[order], word[order]


@lru_cache(maxsize=8)
def cap_height(dim: int, blocks: int, directions: int, caps: int = CAPS, seed: int = SEED) -> float:
    """The largest alpha, in steps of 0.01, at which 500 random vectors lie in ``caps`` caps on average."""
    code = product_code(dim, blocks, directions, seed)
    unit = np.random.default_rng([seed, 1]).standard_normal((500, dim))
    turned = unit / np.linalg.norm(unit, axis=1, keepdims=True) @ code[0]
    sums, alpha = [turned[:, cut] @ g for cut, g in code[1]], 1.0
    while alpha > -1 and len(list_decode(sums, np.full(500, alpha))[0]) < caps * 500:
        alpha -= _STEP
    return alpha


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows at length one in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decode(rows: int, caps: int, least: int, per_cap: int, seed: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):  # decoding holds some thousand sums a vector
                batch = whole.slice(begin, 256)
                flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
                dims = np.diff(batch.column("vec").offsets.to_numpy())
                starts = np.cumsum(dims) - dims
                lists, vecs = [None] * len(dims), [None] * len(dims)
                for dim in np.unique(dims):
                    mine = np.flatnonzero(dims == dim)
                    raw = flat[starts[mine][:, None] + np.arange(dim)]
                    shape = code_shape(rows, int(dim), caps, per_cap)
                    alpha = cap_height(int(dim), *shape, caps, seed)
                    at, word = caps_of(unit_vectors(raw), product_code(int(dim), *shape, seed), alpha, least)
                    ends = np.searchsorted(at, np.arange(len(mine) + 1))
                    for k, i in enumerate(mine):
                        lists[i], vecs[i] = word[ends[k]:ends[k + 1]], raw[k].astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cid"), batch.column("n"), batch.column("label"), pa.array(dims, pa.int32()),
                     pa.array(lists, pa.list_(pa.int64())), pa.array(vecs, pa.binary())],
                    names=["cid", "n", "label", "dim", "caps", "vec"])
    return run


def _first_shared(caps: np.ndarray, rows: np.ndarray, cap: int, members: np.ndarray, n: int) -> np.ndarray:
    """Matrix over ``members``: True where two share no cap smaller than ``cap`` (caps, rows: all caps of the n rows)."""
    place = np.full(n, -1)
    place[members] = np.arange(len(members))
    below = (caps < cap) & (place[rows] >= 0)
    _, column = np.unique(caps[below], return_inverse=True)
    has = np.zeros((len(members), int(column.max()) + 1 if len(column) else 0), np.float32)
    has[place[rows[below]], column] = 1
    return has @ has.T == 0


def _reach(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a symmetric matrix connects, fewer than its rows."""
    left, links = np.ones(len(near), bool), []
    for seed in range(len(near)):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue:
            one = queue.pop()
            new = np.flatnonzero(near[one] & left)
            left[new] = False
            links += [(one, x) for x in new.tolist()]
            queue += new.tolist()
    return links


def compare_group(cap: int, own: bool, ids: np.ndarray, copies: np.ndarray, side: np.ndarray, unit: np.ndarray,
                  caps: np.ndarray, rows: np.ndarray, cosine: float) -> tuple[np.ndarray, list]:
    """Of one group: for each member the copies linked to it first in this cap, and links (id, id) that connect.

    ``own``: members of one block, each against all; else those of the two sides against each other.
    """
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    if not own:
        near &= side[:, None] != side[None, :]
    add = np.zeros(len(ids), np.int64)
    hit = np.flatnonzero(near.any(axis=1))
    if not len(hit):
        return add, []
    within = near[np.ix_(hit, hit)]
    counted = within & _first_shared(caps, rows, cap, hit, len(ids))
    add[hit] = counted @ copies[hit]
    return add, [(int(ids[hit[u]]), int(ids[hit[v]])) for u, v in _reach(within)]


def _compare(cosine: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, offs = batch.column("members").flatten(), batch.column("members").offsets.to_numpy()
            offs = offs - offs[0]
            cid, n, blk, caps, vec = (members.field(k) for k in range(5))
            ids, copies, sides = (x.to_numpy(zero_copy_only=False) for x in (cid, n, blk))
            flat, ends = caps.flatten().to_numpy(zero_copy_only=False), caps.offsets.to_numpy()
            ends = ends - ends[0]
            out: list[tuple] = []
            for cap, a, b, lo, hi in zip(batch.column("cap").to_pylist(), batch.column("a").to_pylist(),
                                         batch.column("b").to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                unit = unit_vectors(np.stack([np.frombuffer(v.as_buffer(), kind) for v in vec[lo:hi]]))
                rows = np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1]))
                add, links = compare_group(cap, a == b, ids[lo:hi], copies[lo:hi], sides[lo:hi], unit,
                                           flat[ends[lo]:ends[hi]], rows, cosine)
                some = np.flatnonzero(add)
                out += [(u, None, k) for u, k in zip(ids[lo:hi][some].tolist(), add[some].tolist())]
                out += [(min(x), max(x), None) for x in links]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)],
                                             names=["u", "v", "copies"])
    return run


def linkable(label, vec):
    """True for rows that may link: a label, and a vector that is not null, empty or zero and wholly finite."""
    infinity = F.lit(float("inf"))
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))
    return F.coalesce(label.isNotNull() & sound & F.exists(vec, lambda x: x != 0), F.lit(False))


def cap_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
               cosine: float = COSINE, caps: int = CAPS, least_caps: int = LEAST_CAPS, per_cap: int = PER_CAP,
               block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Rows (id, k1, k2, n_links, component_id, kept), one per row of ``df``.

    Rows link if their labels are equal and not null, their vectors of one
    dimension and the cosine in double precision is ``cosine`` (above 0) or
    more.  Rows with equal labels and vectors are one class with a count: they
    link with each other, and their vector is compared once.  Vectors that are
    null, empty, zero or hold null or non-finite values link with nothing.
    ``n_links``: other rows linked directly; ``component_id``: smallest id
    reachable, null ids lend none; ``kept``: the id is the component's (of
    rows that share the smallest id, all; a row without id, only if its
    component has no id at all).  (k1, k2) is the digest of label and vector.
    An empty table gives no rows; other columns are not read.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine: above 0, at most 1")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
                     F.col(f"`{vec_col}`").alias("vec"))
    kind = "<f4" if isinstance(rows.schema["vec"].dataType.elementType, T.FloatType) else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    k1, k2 = row_key(["label", "vec"])
    rows = rows.withColumns({"k1": k1, "k2": k2, "ok": linkable(F.col("label"), F.col("vec"))})
    classes = rows.filter("ok").groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("label").alias("label"),
        F.first("vec").alias("vec"))
    # written before it is read again: the numbers of the classes then stay
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "cap-classes")
    largest = total(classes.groupBy("label", F.size("vec")).count(), F.max("count"))[0] or 0
    label_kind = rows.schema["label"].dataType.simpleString()
    decoded = materialize(spread(classes.select("cid", "n", "label", "vec")).mapInArrow(
        _decode(largest, caps, least_caps, per_cap, seed, kind),
        f"cid bigint, n bigint, label {label_kind}, dim int, caps array<bigint>, vec binary"), "cap-decoded")

    key = ["label", "dim", "cap"]
    large = (decoded.select("label", "dim", F.explode("caps").alias("cap")).groupBy(*key).count()
             .filter(F.col("count") > block)
             .select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    large = broadcast_if_small(materialize(large, "cap-large"))
    member = F.struct("cid", "n", "blk", "caps", "vec")
    dealt = decoded.withColumn("cap", F.explode("caps")).join(large, key, "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.groupBy(*key, F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b")).agg(
        F.collect_list(member).alias("members")).filter(F.size("members") > 1)
    found = materialize(groups.select("cap", "a", "b", "members").mapInArrow(
        _compare(cosine, kind), "u bigint, v bigint, copies bigint"), "cap-links")

    links = found.filter("v IS NOT NULL").select("u", "v").distinct()
    degrees = found.filter("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("copies").alias("linked"))
    roots = materialize(connected_components(links).withColumnRenamed("node", "cid"), "cap-roots")
    named = classes.select("cid", "k1", "k2", "n", "least").join(degrees, "cid", "left").join(roots, "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "root").select(
        "k1", "k2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "cap-classes-named")
    # both sides plain shuffles, so that AQE can split a vector with very many copies
    narrow = materialize(rows.select("id", "k1", "k2", "ok"), "cap-rows")
    linked = narrow.filter("ok").join(named, ["k1", "k2"]).select("id", "k1", "k2", "n_links", "component_id")
    alone = narrow.filter(~F.col("ok")).select("id", "k1", "k2", F.lit(0).cast("bigint").alias("n_links"),
                                               F.col("id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
