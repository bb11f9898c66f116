"""Exact best match per text by an inverted index ordered by impact.

The right side's weights are an inverted index: a term's postings, in blocks of
like weight, each with the largest weight in it. A block's *impact* on a left text is the
text's own weight of the term times that largest weight: no right text in the
block gets more from the term than that.

For each left text, in tables throughout:

1. A lower bound: the exact scores of a few right texts that lead the postings
   of its strongest terms.
2. Its blocks in order of impact, lowest first, with the running sum of how far each
   raises the bound of what its term can give. As long as that sum stays below a
   share of the lower bound, a right text found in none of the other blocks cannot
   win: these blocks give no candidates. They are the long ones, of common words.
3. Partial sums over the blocks that are left give candidates. A candidate stays
   only if its partial sum and the bound of the left-out blocks, or of the
   text's left-out weight (unit vectors: Cauchy-Schwarz), reach the lower bound.
4. The left-out blocks' share of the sum, for the candidates that stay.

Scores are rounded before the winner is chosen, so bounds are compared with a
margin of one rounding step: no right text that could tie is lost.

Scale: all tables are keyed by left text or by (term, block); no pair exists before
its bound can win, so the work follows the pairs that compete, not
|left| x |right|. Texts whose scores are all alike keep all their pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitae.operators.skew import join_split
from vitae.session import materialize, row_count_at_most

#: Right texts tried for the lower bound, per left text.
SEEDS = 3
#: Share of the lower bound that the left-out blocks may add up to: the higher, the fewer blocks are joined and the
#: more of the candidates they give stay.
SHARE = 0.35
#: Rows of a left side that may be broadcast (a term and a few numbers each).
SMALL_ROWS = 2_000_000
#: Blocks of a term per halving of the weight.
STEPS = 2


def postings(right: DataFrame) -> DataFrame:
    """``(rid, term, rw, block)``: the weights with their term's block, 0 the one of the largest weights (1 or more)."""
    block = F.greatest(F.lit(0), F.floor(-STEPS * F.log2("w"))).cast("int")
    return right.select(F.col("id").alias("rid"), "term", F.col("w").alias("rw"), block.alias("block"))


def block_bounds(index: DataFrame) -> DataFrame:
    """``(term, blocks)``: per term its blocks as (block, most, next), most the largest weight, next that of the block below."""
    tops = index.groupBy("term", "block").agg(F.max("rw").alias("most"))
    below = F.lag("most", 1, 0.0).over(Window.partitionBy("term").orderBy(F.col("block").desc()))
    return tops.withColumn("next", below).groupBy("term").agg(
        F.collect_list(F.struct("block", "most", "next")).alias("blocks"))


def exact_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``(lid, rid, dot)`` of given pairs: their common terms' products, summed.

    With at most ``limit`` rows of left weights to a pair's side, the pairs' weights are broadcast.
    """
    lw = left.select(F.col("id").alias("lid"), "term", F.col("w").alias("lw"))
    rw = right.select(F.col("id").alias("rid"), "term", F.col("w").alias("rw"))
    wanted = pairs.select("lid", "rid").join(lw, "lid")
    if row_count_at_most(wanted, limit):
        wanted = F.broadcast(wanted)
    return (rw.join(wanted, ["rid", "term"])
            .groupBy("lid", "rid").agg(F.sum(F.col("lw") * F.col("rw")).alias("dot")))


def _seeds(left: DataFrame, index: DataFrame) -> DataFrame:
    """``(lid, rid)``: for each left text the right texts that lead its strongest terms."""
    lead = index.groupBy("term").agg(F.max(F.struct("rw", F.bitwise_not("rid").alias("later"))).alias("lead")).select(
        "term", F.col("lead.rw").alias("most"), F.bitwise_not("lead.later").alias("rid"))
    strong = left.select(F.col("id").alias("lid"), "term", "w").join(lead, "term").withColumn(
        "impact", F.col("w") * F.col("most"))
    rank = F.row_number().over(Window.partitionBy("lid").orderBy(F.col("impact").desc(), "term"))
    return strong.withColumn("n", rank).where(F.col("n") <= SEEDS).select("lid", "rid").distinct()


def _bounds(left: DataFrame, right: DataFrame, digits: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, need, index): the left texts' blocks, ``out`` where they give no candidates; what a pair needs to stay; the postings."""
    margin = 1.01 * 10.0**-digits + 1e-9
    index = materialize(postings(right), "postings")
    known = materialize(_seeds(left, index), "seeds")
    stored = index.select(F.col("rid").alias("id"), "term", F.col("rw").alias("w"))
    floor = materialize(exact_scores(known, left, stored, limit).groupBy("lid").agg(F.max("dot").alias("floor")), "floors")
    own = left.select(F.col("id").alias("lid"), "term", F.col("w").alias("lw")).join(floor, "lid")
    placed = own.join(block_bounds(index), "term").select("lid", "term", "lw", "floor", F.explode("blocks").alias("b"))
    impact = F.col("lw") * F.col("b.most")
    lowest = Window.partitionBy("lid").orderBy("impact", "term", F.col("block").desc())
    placed = placed.select(
        "lid", "term", "lw", "floor", F.col("b.block").alias("block"), impact.alias("impact"),
        (F.col("lw") * (F.col("b.most") - F.col("b.next"))).alias("rise")
    ).withColumn("bound", F.sum("rise").over(lowest.rowsBetween(Window.unboundedPreceding, 0)))
    placed = materialize(placed.withColumn("out", F.col("bound") < SHARE * (F.col("floor") - margin)), "impacts")
    # What a left-out part can still give: the sum of its terms' bounds, or its length.
    left_out = placed.where("out")
    rest = left_out.groupBy("lid", "term").agg(F.max("impact").alias("most"), F.first("lw").alias("lw")).groupBy(
        "lid").agg(F.sum("most").alias("by_term"), F.sqrt(F.sum(F.col("lw") * F.col("lw"))).alias("by_length"))
    need = floor.join(rest, "lid", "left").select(
        "lid", (F.col("floor") - F.coalesce(F.least("by_term", "by_length"), F.lit(0.0)) - margin).alias("need"))
    return placed, need, index


def candidates(left: DataFrame, right: DataFrame, digits: int,
               limit: int = SMALL_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, left_out, index): every pair that could have its left text's highest rounded score, and few others.

    ``left`` and ``right`` are ``(id, term, w)`` with unit-length rows. pairs:
    ``(lid, rid, partial)``; left_out: the parts ``(lid, term, block, lw)`` of the left
    texts that partial lacks; index: the right side's postings. Pairs without a common term
    are not among them.
    """
    return _candidates(*_bounds(left, right, digits, limit))


def _candidates(placed: DataFrame, need: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    met = join_split(placed.where("NOT out").select("lid", "term", "block", "lw"), index, ["term", "block"])
    partial = met.groupBy("lid", "rid").agg(F.sum(F.col("lw") * F.col("rw")).alias("partial"))
    pairs = partial.join(need, "lid").where(F.col("partial") >= F.col("need")).select("lid", "rid", "partial")
    return pairs, placed.where("out").select("lid", "term", "block", "lw"), index


def _scores_of_few(placed: DataFrame, need: DataFrame, index: DataFrame, digits: int) -> DataFrame:
    """``(lid, rid, score)`` of the candidates, where the left side's blocks are few enough to broadcast.

    A right text's postings meet them in one task, which has all of a pair's sum there:
    no pair crosses the network, and none leaves that cannot win.
    """
    product = F.col("lw") * F.col("rw")
    met = index.repartition("rid").join(F.broadcast(placed.select("lid", "term", "block", "lw", "out")), ["term", "block"])
    sums = met.groupBy("lid", "rid").agg(F.sum(F.when(~F.col("out"), product)).alias("partial"), F.sum(product).alias("dot"))
    return sums.join(F.broadcast(need), "lid").where(F.col("partial") >= F.col("need")).select(
        "lid", "rid", F.round("dot", digits).alias("score"))


def _rest(pairs: DataFrame, left_out: DataFrame, index: DataFrame) -> DataFrame:
    """``(lid, rid, partial)``: the products of the left-out parts for the pairs that stay.

    Either each pair meets the left-out parts of its left text, or these parts meet
    the index and the pairs choose from what that gives: whichever makes fewer rows, as counted.
    """
    of_left = left_out.groupBy("lid").agg(F.count(F.lit(1)).alias("n"))
    of_block = left_out.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"))
    by_pair = pairs.groupBy("lid").agg(F.count(F.lit(1)).alias("m")).join(of_left, "lid").agg(F.sum(F.col("n") * F.col("m")))
    by_block = index.groupBy("term", "block").agg(F.count(F.lit(1)).alias("m")).join(of_block, ["term", "block"]).agg(
        F.sum(F.col("n") * F.col("m")))
    product = (F.col("lw") * F.col("rw")).alias("partial")
    if (by_block.first()[0] or 0) < (by_pair.first()[0] or 0):
        met = join_split(left_out, index, ["term", "block"]).select("lid", "rid", product)
        sums = met.groupBy("lid", "rid").agg(F.sum("partial").alias("partial"))
        return sums.join(pairs.select("lid", "rid"), ["lid", "rid"], "left_semi")
    return pairs.select("lid", "rid").join(left_out, "lid").join(index, ["rid", "term", "block"]).select("lid", "rid", product)


def best_scores(left: DataFrame, right: DataFrame, digits: int, limit: int = SMALL_ROWS) -> DataFrame:
    """``(lid, rid, score)``: each left text's highest rounded score, ties to the smallest right id.

    A left side whose blocks are at most ``limit`` rows is broadcast.
    """
    placed, need, index = _bounds(left, right, digits, limit)
    if row_count_at_most(placed, limit):
        scored = _scores_of_few(placed, need, index, digits)
    else:
        pairs, left_out, index = _candidates(placed, need, index)
        pairs = materialize(pairs, "candidates")
        scored = pairs.unionByName(_rest(pairs, left_out, index)).groupBy("lid", "rid").agg(
            F.round(F.sum("partial"), digits).alias("score"))
    best = scored.groupBy("lid").agg(F.max(F.struct("score", F.bitwise_not("rid").alias("later"))).alias("k"))
    return best.select("lid", F.bitwise_not("k.later").alias("rid"), F.col("k.score").alias("score"))
