"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source has the same expected number of copies, target over
source size: the whole part is taken as it is, the fraction is a probability
to be rounded.  Pivotal rounding pairs two fractional probabilities and moves
mass between them at random until one is 0 or 1, keeping their sum and each
one's expectation.  Blocks of documents do that side by side, from the
largest document down, so that partners are of similar size and the fractional
residual that each block leaves is a small one; the residuals of blocks are
rounded against each other in a reduction tree of fixed fan-in until one per
source is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import dense_row_number, running_sum
from ..session import broadcast_if_small, materialize
from .common import row_key, total, unit_hash, unpacked

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCK = 256
SEED = 42


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Targets of sources: rows (source, source_size, n, target) from rows (source, source_size, n).

    Sources in code-point order, null last, get the weights in turn and share
    the sum of all sizes.  A target stops at ``max_copies`` times its source's
    size and the excess is reshared by weight until none is above; the fixed
    point is the level t with ``sum(min(cap, weight * t)) = total``, found by
    one pass over the sources in the order in which they reach their caps.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    s = dense_row_number(sizes, [F.col("source").asc_nulls_last()], "i")
    s = (s.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_copies)
         .withColumn("full_at", F.col("cap") / F.col("w")))
    s = running_sum(dense_row_number(s, ["full_at", "i"], "r").withColumn("g", F.lit(0)), ["g"], "r",
                    {"cap": "caps", "w": "ws"})
    s = materialize(s, "mix-sources")
    everything, all_w = total(s, F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0)))
    filled = F.col("caps") + F.col("full_at") * (F.lit(all_w) - F.col("ws"))
    s = s.withColumn("full", filled <= F.lit(float(everything)))
    held, open_w = total(s, F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)),
                         F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))), F.lit(0)))
    level = (everything - held) / open_w if open_w else 0.0
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.lit(float(level)))
    return s.select("source", "source_size", "n", target.alias("target"))


def pivot(items: Column) -> Column:
    """Pivotal rounding along an array of struct(p, u): struct(left, p, taken).

    ``left`` is the place of the last fractional item with its mass ``p``;
    ``taken`` holds the places rounded to one.  ``u`` is the uniform number of
    the step at which an item enters.
    """
    start = F.struct(F.lit(-1).alias("left"), F.lit(0.0).alias("p"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["p"] + x["p"]
        # below one: one of the two ends at 0, the other carries the sum
        stays = x["u"] * s < acc["p"]
        low = F.struct(F.when(stays, acc["left"]).otherwise(x["i"]).alias("left"), s.alias("p"),
                       acc["taken"].alias("taken"))
        # from one on: one of the two ends at 1, the other carries the rest
        wins = x["u"] * (2.0 - s) < 1.0 - x["p"]
        high = F.struct(F.when(wins, x["i"]).otherwise(acc["left"]).alias("left"), (s - 1.0).alias("p"),
                        F.concat(acc["taken"], F.array(F.when(wins, acc["left"]).otherwise(x["i"]))).alias("taken"))
        first = F.struct(x["i"].alias("left"), x["p"].alias("p"), acc["taken"].alias("taken"))
        return F.when(acc["left"] < 0, first).when(s < 1.0, low).otherwise(high)

    placed = F.transform(items, lambda x, i: F.struct(i.cast("int").alias("i"), x["p"].alias("p"), x["u"].alias("u")))
    return F.aggregate(placed, start, step)


def _rounded(groups: DataFrame, seed: int, level: int) -> DataFrame:
    """Rows (source, b, items, largest first) with ``res``, the pivotal rounding of their items."""
    draws = F.transform("items", lambda x, i: F.struct(
        x["p"].alias("p"), unit_hash(F.lit(seed), F.lit(level), x["h"], i).alias("u")))
    return groups.withColumn("res", pivot(draws))


def mix_sources(df: DataFrame, size: Column, source: str = "source", weights: Sequence[int] = WEIGHTS,
                max_copies: int = MAX_COPIES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """All rows of ``df`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``copies`` is the number of times the mix takes the row, 0 to
    ``max_copies``; the copies of a source add up to their expectation within
    one.  A null source is a source of its own, a null size counts 0, a source
    of size 0 has target 0 and no copies.  Repeated rows are rounded one by
    one.  All draws are hashes of the rows, so reruns agree.  An empty table
    gives an empty result; columns of the added names are replaced.  Columns
    must be orderable (no maps).
    """
    names = df.columns
    h, bucket = row_key([F.col("rec")[c] for c in names], seed)
    # the size is computed beside the packed row, before names can clash
    rows = (df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("rec"),
                      F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
                      F.col(f"`{source}`").alias("source"))
            .withColumns({"h": h, "draw": bucket}))
    # few bytes a row here: only source and size reach this aggregation
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    sources = (source_targets(sizes, weights, max_copies)
               .withColumn("whole", F.floor(ratio).cast("int"))
               .withColumn("p", ratio - F.floor(ratio))
               .withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("bigint"))
               .withColumnRenamed("source", "of"))
    sources = materialize(sources, "mix-targets")
    joined = rows.join(broadcast_if_small(sources), F.col("source").eqNullSafe(F.col("of")))
    blocks = (joined.withColumn("b", F.pmod("draw", "blocks"))
              .groupBy("of", "b")
              .agg(F.sort_array(F.collect_list(F.struct("size", "h", "p", "rec")), asc=False).alias("items"),
                   F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                   F.first("whole").alias("whole")))
    blocks = materialize(_rounded(blocks, seed, 0), "mix-blocks")

    # the tree over residuals: one narrow row per block, `origin` names it
    tree = blocks.select("of", F.col("b").alias("origin"), "b", F.col("res.p").alias("p"),
                         F.element_at("items", F.col("res.left") + 1)["size"].alias("size"),
                         F.element_at("items", F.col("res.left") + 1)["h"].alias("h"))
    most = total(sources, F.coalesce(F.max("blocks"), F.lit(0)))[0]
    taken, level = None, 1
    while most > 1:
        grouped = (tree.groupBy("of", F.expr(f"b div {block}").alias("b"))
                   .agg(F.sort_array(F.collect_list(F.struct("size", "h", "p", "origin")), asc=False).alias("items")))
        grouped = materialize(_rounded(grouped, seed, level), "mix-tree")
        ones = grouped.select("of", F.explode(F.transform("res.taken", lambda i: F.element_at(
            F.col("items"), i + 1)["origin"])).alias("origin"))
        taken = ones if taken is None else taken.union(ones)
        tree = grouped.select("of", F.element_at("items", F.col("res.left") + 1)["origin"].alias("origin"), "b",
                              F.col("res.p").alias("p"),
                              F.element_at("items", F.col("res.left") + 1)["size"].alias("size"),
                              F.element_at("items", F.col("res.left") + 1)["h"].alias("h"))
        most, level = -(-most // block), level + 1
    last = tree.filter(unit_hash(F.lit(seed), F.lit("last"), "h") < F.col("p")).select("of", "origin")
    taken = (last if taken is None else taken.union(last)).select(F.col("of").alias("src"), "origin",
                                                                  F.lit(1).alias("one"))
    done = blocks.join(taken, F.col("of").eqNullSafe(F.col("src")) & (F.col("b") == F.col("origin")), "left")
    # places taken, in the items' order; the residual's place counts if the tree took it
    places = F.concat(F.col("res.taken"), F.when(F.col("one") == 1, F.array("res.left"))
                      .otherwise(F.array().cast("array<int>")))
    done = (done.select(places.alias("places"), "source_size", "target", "whole", F.posexplode("items").alias("i", "item"))
            .select(F.col("item.rec").alias("rec"), F.col("item.size").alias("size"), "source_size", "target",
                    (F.col("whole") + F.array_contains("places", F.col("i")).cast("int")).alias("copies")))
    return unpacked(done, names, ["size", "source_size", "target", "copies"])


def take_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says, with ``columns`` only."""
    return (mixed.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy"))
            .drop("_copy"))
