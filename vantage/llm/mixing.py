"""Mixing sources to target weights (operator 2): temperature mixing.

Source weights are the sources' token shares raised to an exponent and
normalised. The exponent in [0, 1] is found by bisection: the entropy of the weights is
to reach ``target_entropy`` (a share of the largest, ln sources), but no source
may be repeated more than ``max_repeats`` times; the limit wins. The sums that a
bisection step needs are one aggregate over the source table for a whole grid of
exponents, so the number of sources is not bounded by the driver.

The weights are realised as block permutations under a token budget. A source's
documents fall into blocks by a hash (about ``block_docs`` documents of all
sources share a block number); each pass over the
source takes its blocks in another order, as far as the source's share of the
budget reaches: whole passes, then whole blocks, then documents of one block
while their tokens fit (the one that crosses the end is taken). No source is read more than ``max_repeats``
times: a budget beyond that many passes of everything is not used up. Only block
totals are ever ordered per source, and documents only within a block. Without a
budget the smallest one is taken that keeps every document once.

Tokens of a document are its white-space words, and one end. Defined cases: a null source is
a source; null and empty texts have one token; repeated rows are documents each
(equal ones enter a partial pass together); one source or an empty table give
weight 1 or no rows; other columns may have any name, but ``mix`` refuses the four that it adds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import Boxed, flag, saved, table

TARGET_ENTROPY, MAX_REPEATS, BLOCK_DOCS, GRID, ROUNDS = 0.98, 1.5, 10_000, 16, 6


def tokens():
    return (F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
             budget: int | None = None) -> float:
    """The exponent for ``source, tokens``: the larger one of what the entropy
    asks for and what the repetition limit allows under the budget (without one,
    under the smallest that keeps every document once)."""
    top = sources.agg(F.count("*").alias("k"), F.sum("tokens").alias("t"), F.min("tokens").alias("least"),
                      F.max("tokens").alias("most")).first()
    if not top.k or top.k == 1:
        return 1.0
    spread = math.log(top.most / top.least)
    if budget is None:
        # with every document kept once the largest source has one pass, and the
        # smallest (most / least) ** (1 - a) passes
        limit = 1.0 if max_repeats <= 1 else max(0.0, 1 - math.log(max_repeats) / spread) if spread > 0 else 0.0
    goal = target_entropy * math.log(top.k)
    share = F.log(F.col("tokens") / float(top.t))
    least = math.log(top.least / top.t)

    def search(keeps) -> tuple[float, float]:
        """Where ``keeps(exponent, z, entropy)``, true for small exponents, ceases to hold, as
        (last that holds, first that does not); all of a grid's sums are one aggregate."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
            got = sources.agg(*[f for i, a in enumerate(grid) for f in (
                F.sum(F.exp(share * a)).alias(f"z{i}"), F.sum(F.exp(share * a) * share * a).alias(f"e{i}"))]).first()
            z = [got[f"z{i}"] for i in range(GRID + 1)]
            held = [i for i, a in enumerate(grid) if keeps(a, z[i], math.log(z[i]) - got[f"e{i}"] / z[i])]
            at = max(held, default=-1)
            if at < 0:
                return 0.0, 0.0
            if at == GRID:
                return hi, hi
            lo, hi = grid[at], grid[at + 1]
        return lo, hi
    # entropy falls as the exponent grows: the last one that still reaches the goal
    wanted = search(lambda a, z, entropy: entropy >= goal - 1e-12)[0]
    if budget is not None:  # the smallest source has the most passes, fewer as the exponent grows
        limit = search(lambda a, z, entropy: budget / top.t * math.exp(least * (a - 1)) / z > max_repeats)[1]
    return max(wanted, limit)


def weights(sources: DataFrame, alpha: float) -> DataFrame:
    """``source, tokens, weight``."""
    total = sources.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(alpha)))).first()[0]
    return sources.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(alpha)) / F.lit(float(total or 1)))


def mix(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
        budget: int | None = None, seed: int = 0, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` with ``__n`` (tokens), ``__p`` (pass), ``__w`` (the source's weight)
    and ``__at``: a row for each time a document is read; ``__at`` in [0, 1) orders
    the mixed stream."""
    if {"__n", "__p", "__w", "__at"} & set(docs.columns):
        raise ValueError("__n, __p, __w and __at are the operator's own columns")
    boxed = Boxed(docs, "doc_id", "source", "text")
    mixed = _mixed(boxed.docs, target_entropy, max_repeats, budget, seed, block_docs)
    return boxed.open(mixed, F.col("__mix_tokens").alias("__n"), F.col("__mix_pass").alias("__p"), F.col("weight").alias("__w"),
                      F.col("__mix_place").alias("__at"))


def _mixed(docs: DataFrame, target_entropy: float, max_repeats: float, budget: int | None, seed: int, block_docs: int) -> DataFrame:
    blocks = max(1, -(-docs.count() // block_docs))  # a column-less scan
    lot = F.xxhash64(F.lit(seed), "doc_id", "text")
    src, block, at = "__mix_source", "__mix_block", "__mix_lot"
    sized = docs.withColumns({
        "__mix_tokens": tokens(), at: lot, block: F.pmod(lot, F.lit(blocks)),
        src: F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))})
    totals = saved(sized.groupBy(src, block).agg(F.sum("__mix_tokens").alias("t"), F.count("*").alias("n")),
                   "op2-blocks")
    per = saved(totals.groupBy(src).agg(F.sum("t").alias("tokens"), F.sum("n").alias("docs")), "op2-sources")
    shares = weights(per, exponent(per, target_entropy, max_repeats, budget))
    if budget is None:  # the smallest budget under which no source has less than one pass
        asked = (shares.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0) * (1 + 1e-12)
    else:
        asked = float(budget)
    quota = F.floor(F.col("weight") * asked)
    if budget is not None:  # what no exponent allows is cut
        quota = F.least(quota, F.floor(F.col("tokens") * float(max_repeats)))
    plan = saved(shares.select(src, "weight", "tokens", quota.alias("quota"))
                 .withColumn("passes", F.floor(F.col("quota") / F.col("tokens")))
                 .withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens")), "op2-plan")
    # the last, partial pass: blocks in their order while they begin before the
    # end, of the one that crosses the end only the documents that do
    w = Window.partitionBy(src).orderBy(F.xxhash64(F.lit(seed + 1), F.col(src), block), block)
    cut = saved(totals.join(plan.where("rest > 0").select(src, "rest"), src)
                .withColumn("before", F.sum("t").over(w) - F.col("t")).where("before < rest")
                .select(src, block, "before", "rest", (F.col("before") + F.col("t") <= F.col("rest")).alias("full")),
                "op2-cut")
    crossing = (sized.select(src, block, at, "__mix_tokens").join(cut.where("NOT full"), [src, block])
                .withColumn("begin", F.col("before") + F.sum("__mix_tokens").over(
                    Window.partitionBy(src, block).orderBy(at)  # equal rows are taken together
                    .rangeBetween(Window.unboundedPreceding, Window.currentRow))
                    - F.sum("__mix_tokens").over(Window.partitionBy(src, block, at)))
                .where("begin < rest").groupBy(src, block).agg(F.max(at).alias("until")))
    ends = cut.select(src, block, "full").join(crossing, [src, block], "left")
    last = flag(F.col("full")) | flag(F.col(at) <= F.col("until"))
    reads = F.expr("sequence(0L, passes - 1 + IF(__mix_last, 1L, 0L))")
    order = F.pmod(F.xxhash64(F.lit(seed), F.col(src), block, "__mix_pass"), F.lit(1 << 40)) / float(1 << 40)
    inner = F.pmod(F.xxhash64(at, "__mix_pass"), F.lit(1 << 40)) / float(1 << 40)
    part = F.when(F.col("__mix_pass") < F.col("passes"), 1.0).otherwise(F.col("rest") / F.col("tokens"))
    # passes of all sources run side by side; within a pass, block by block
    place = (F.col("__mix_pass") + part * (F.floor(order * blocks) + inner) / blocks) * F.col("tokens") / F.col("quota")
    return (sized.join(plan, src).join(ends, [src, block], "left")
            .withColumn("__mix_last", flag(last)).where("passes > 0 OR __mix_last")
            .withColumn("__mix_pass", F.explode(reads))
            .select(*(sized[c] for c in docs.columns), "__mix_tokens", "__mix_pass", "weight", place.alias("__mix_place")))


def op2_mixing(spark, sf_dir):
    """Every reading of every document: source, pass, weight and place in the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).selectExpr("doc_id", "source", "__n AS n_tokens", "__p AS pass", "__w AS weight",
                                "__at AS position")


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents repeated by their source's weight; none is lost. Columns of any
    name come through as they are."""
    boxed = Boxed(docs, "doc_id", "source", "text")
    return boxed.open(_mixed(boxed.docs, TARGET_ENTROPY, MAX_REPEATS, None, 0, BLOCK_DOCS))
