"""Temperature mixing of sources.

A source of token share p gets the weight p^alpha, normalised: alpha 1 keeps the shares,
alpha 0 evens them out. The exponent is found by bisection (fifteen cuts of the interval at
a time, each judged by one aggregate over the table of sources) as the larger of the one
that meets a target entropy and the one that keeps every source under a repetition limit.

The weights are then realised within a token budget. Documents are dealt into 4,096 blocks
of a source by hash and each epoch goes through its blocks in an order of its own. Whole
epochs take all documents; of the last one the blocks are taken in order while their tokens
fit, then the sub-blocks of the block that doesn't fit, then the documents of that
sub-block. So the cut of a source is three keys, found from sums over at most 4,096 blocks,
4,096 sub-blocks and the few documents of one sub-block.

Tokens are words between ASCII white space unless a column gives them. Null sources are a
source of their own. Documents without tokens, of null or blank texts, are left out, as they
have no weight. Repeated rows count each and fall on the same side of a cut. An empty table
gives an empty table.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .tables import cut_lineage, small_enough

BLOCKS = 4_096
#: Sources up to this number are broadcast (some 100 bytes each).
BROADCAST_SOURCES = 50_000
ALPHAS_AT_ONCE, ROUNDS = 15, 5


def measured(documents: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, key, n_tokens, h): the documents that have tokens."""
    n = F.size(T.words(F.col("text"), T.BLANKS)) if tokens is None else tokens
    return documents.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        n.cast("long").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("h")).where(F.col("n_tokens") > 0)


def _statistics(sources: DataFrame, alphas: list[float]) -> dict[float, tuple[float, float]]:
    """Entropy of the weights and largest weight over share, for each exponent."""
    w = F.pow("p", F.col("alpha"))
    rows = sources.select("p", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")).groupBy("alpha").agg(
        F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("e"), F.max(w / F.col("p")).alias("most")).collect()
    return {r["alpha"]: (math.log(r["z"]) - r["e"] / r["z"], r["most"] / r["z"]) for r in rows}


def exponent(sources: DataFrame, target_entropy: float | None, most_repeats: float | None, budget_ratio: float) -> float:
    """The smallest exponent in [0, 1] that meets both limits; 1 if none does.

    Entropy and repetitions fall as the exponent grows. ``budget_ratio`` is the budget over
    all tokens.
    """
    def fits(entropy: float, most: float) -> bool:
        return (target_entropy is None or entropy <= target_entropy + 1e-12) and (
            most_repeats is None or most * budget_ratio <= most_repeats + 1e-9)

    low, high = 0.0, 1.0
    if fits(*_statistics(sources, [0.0])[0.0]):
        return 0.0
    for _ in range(ROUNDS):
        cuts = [low + (high - low) * (i + 1) / (ALPHAS_AT_ONCE + 1) for i in range(ALPHAS_AT_ONCE)]
        found = _statistics(sources, cuts)
        high = min([high, *[a for a in cuts if fits(*found[a])]])
        low = max([low, *[a for a in cuts if a < high]])
    return high


def source_weights(rows: DataFrame, evenness: float = 0.5, most_repeats: float = 4.0, budget: int | None = None) -> DataFrame:
    """(key, tokens, weight, whole, rest): whole epochs, and tokens of the last one, of each source.

    ``evenness`` sets the target entropy between that of the shares (0) and the even one (1).
    """
    sums = cut_lineage(rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens")))
    total, count = sums.agg(F.sum("tokens"), F.count("*")).first()
    if not total:
        return sums.select("key", "tokens", F.lit(0.0).alias("weight"), F.lit(0).alias("whole"), F.lit(0).cast("long").alias("rest"))
    budget = budget or total
    sources = sums.withColumn("p", F.col("tokens") / F.lit(total))
    natural = _statistics(sources, [1.0])[1.0][0]
    alpha = exponent(sources, natural + evenness * (math.log(count) - natural), most_repeats, budget / total)
    z = sources.agg(F.sum(F.pow("p", F.lit(alpha)))).first()[0]
    weight = F.pow("p", F.lit(alpha)) / F.lit(z)
    target = F.floor(F.col("weight") * F.lit(float(budget))).cast("long")
    return cut_lineage(sources.withColumn("weight", weight).select(
        "key", "tokens", "weight", F.floor(target / F.col("tokens")).cast("int").alias("whole"),
        (target % F.col("tokens")).alias("rest")))


def block_order(epoch: Column) -> Column:
    """Where the block of a document comes in an epoch."""
    return F.xxhash64("key", epoch, F.pmod("h", F.lit(BLOCKS)))


def sub_block_order(epoch: Column) -> Column:
    return F.xxhash64("key", epoch, F.pmod(F.shiftright("h", 20), F.lit(BLOCKS)), F.lit(1))


def _cut(rows: DataFrame, limits: DataFrame, name: str) -> DataFrame:
    """(key, cut, rest): the first ``name`` of each source that doesn't fit, and what is left for it."""
    sums = rows.groupBy("key", name).agg(F.sum("n_tokens").alias("n"))
    running = sums.withColumn("upto", F.sum("n").over(
        Window.partitionBy("key").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("upto") <= F.col("rest")
    return cut_lineage(running.join(limits, "key").groupBy("key").agg(
        F.min(F.when(~fits, F.col(name))).alias("cut"),
        (F.first("rest") - F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0))).alias("rest")))


def mix(documents: DataFrame, evenness: float = 0.5, most_repeats: float = 4.0, budget: int | None = None,
        tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, epoch, position, n_tokens): a row for each time a document is used.

    Sorted by ``position`` the rows are the mixed corpus: each source is spread evenly.
    """
    rows = cut_lineage(measured(documents, tokens))
    weights = source_weights(rows, evenness, most_repeats, budget)
    few = small_enough(weights, BROADCAST_SOURCES)

    def spread(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    last = rows.join(spread(weights.select("key", "whole")), "key").select(
        "*", block_order(F.col("whole")).alias("o1"), sub_block_order(F.col("whole")).alias("o2"))
    first = _cut(last, spread(weights.select("key", "rest")), "o1")
    in_block = last.join(spread(first.select("key", F.col("cut").alias("c1"))), "key").where(F.col("o1") == F.col("c1"))
    second = _cut(in_block, spread(first.select("key", "rest")), "o2")
    in_sub = in_block.join(spread(second.select("key", F.col("cut").alias("c2"))), "key").where(F.col("o2") == F.col("c2"))
    third = _cut(in_sub, spread(second.select("key", "rest")), "h")

    cuts = weights.join(first.select("key", F.col("cut").alias("c1")), "key", "left").join(
        second.select("key", F.col("cut").alias("c2")), "key", "left").join(
        third.select("key", F.col("cut").alias("c3")), "key", "left")
    joined = rows.join(spread(cuts), "key")
    o1, o2 = block_order(F.col("whole")), sub_block_order(F.col("whole"))
    taken = F.coalesce((o1 < F.col("c1")) | ((o1 == F.col("c1")) & (
        (o2 < F.col("c2")) | ((o2 == F.col("c2")) & (F.col("h") < F.col("c3"))))), F.lit(False))
    times = F.col("whole") + F.when(taken, 1).otherwise(0)
    used = joined.select("*", F.explode(T.upto(times)).alias("epoch"))
    share = block_order(F.col("epoch")) / F.lit(2.0**64) + 0.5
    rounds = F.col("whole") + F.col("rest") / F.col("tokens")
    return used.select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"),
                       ((F.col("epoch") + share) / rounds).alias("position"), "n_tokens")
