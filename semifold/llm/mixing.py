"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. alpha in [0, 1] is found by bisection, so that the
weights meet a target entropy or so that no source repeats more often than a limit; each round evaluates 15 inner
points in one aggregate, which is four halvings. Weights are realised as budgeted block permutations: a source's
documents are dealt by hash into blocks of bounded size, each block is put in a seeded order, and the source's number of
passes (budget / its tokens) is made of whole passes over all blocks and, for the fraction, the leading documents of each
block up to that fraction of the block's tokens. A hot source is many blocks, so no task holds a source.

Without a budget the mixture takes the fewest tokens that pass every source at least once: no document is left out, and
sources below their target weight repeat. With a budget, a source may be passed by less than once.

Defined results: a null source is a source of its own; null, empty and blank texts count 0 tokens and are passed as
often as their block's whole passes; repeated rows are dealt each for itself, by their place in the table (read the table
itself, or a stored one: a place must not change when a task runs again); one source alone has weight 1; an empty table
gives no rows. Extra columns stay; the added columns carry the prefix mix_.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semifold.llm.lineage import stored


@dataclass(frozen=True)
class MixParams:
    """Give target_entropy (bits) or max_repeats. block_tokens: size of a block; rounds: of bisection, 4 halvings each."""

    max_repeats: float = 1.5
    target_entropy: float | None = None
    budget: float | None = None
    block_tokens: int = 200_000
    rounds: int = 8
    seed: int = 17


def tokens(text: Column) -> Column:
    """White-space words of a text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def _entropy(alpha: float) -> Column:
    """Entropy in bits of shares**alpha normalised: log2(Z) - sum(x log2 x) / Z."""
    x = F.pow("share", F.lit(alpha))
    return F.log2(F.sum(x)) - F.sum(x * F.log2(x)) / F.sum(x)


def _repeats(alpha: float, budget: float | None) -> Column:
    """Most passes of any source: with a budget, budget * weight / tokens; else against the source that passes once."""
    x = F.pow("share", F.lit(alpha))
    if budget is not None:
        return F.max(x / F.col("tokens")) * budget / F.sum(x)
    return F.max(x / F.col("share")) / F.min(x / F.col("share"))


def find_alpha(sources: DataFrame, p: MixParams) -> float:
    """The exponent for sources (share, tokens): both measures fall as alpha rises. 1 if even that exceeds the limit, 0
    if the sources can be mixed evenly within it."""
    measure = (lambda a: _entropy(a)) if p.target_entropy is not None else (lambda a: _repeats(a, p.budget))
    goal = p.target_entropy if p.target_entropy is not None else p.max_repeats
    lo, hi = 0.0, 1.0
    for _ in range(p.rounds):
        at = [lo + (hi - lo) * k / 16 for k in range(17)]
        values = sources.agg(*(measure(a).alias(f"m{k}") for k, a in enumerate(at))).first()
        if values[0] is None or values[0] <= goal:
            return lo
        if values[16] > goal:
            return hi
        k = max(k for k in range(17) if values[k] > goal)
        lo, hi = at[k], at[k + 1]
    return hi


def source_plan(docs: DataFrame, source: str, p: MixParams) -> DataFrame:
    """_m_source, mix_weight, mix_passes and _m_blocks of each source: a table of one row a source."""
    totals = stored(docs.groupBy(F.col(source).alias("_m_source")).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    counted = totals.where(F.col("tokens") > 0)
    whole = counted.agg(F.sum("tokens")).first()[0]
    if not whole:
        return totals.select("_m_source", F.lit(0.0).alias("mix_weight"), F.lit(1.0).alias("mix_passes"), F.lit(1).cast("long").alias("_m_blocks"))
    shares = counted.withColumn("share", F.col("tokens") / F.lit(float(whole)))
    alpha = find_alpha(shares, p)
    x = F.pow("share", F.lit(alpha))
    z, most = shares.agg(F.sum(x), F.max(F.col("share") / x)).first()
    budget = p.budget if p.budget is not None else whole * most * z
    weight = F.coalesce(F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(whole), F.lit(alpha)) / z), F.lit(0.0))
    passes = F.when(F.col("tokens") > 0, weight * float(budget) / F.col("tokens")).otherwise(1.0)
    if p.budget is None:
        passes = F.greatest(passes, F.lit(1.0))  # against rounding: the source that passes once passes wholly
    blocks = F.greatest(F.ceil(F.greatest(F.col("tokens") / p.block_tokens, F.col("docs") / (p.block_tokens / 8))), F.lit(1)).cast("long")
    return stored(totals.select("_m_source", weight.alias("mix_weight"), passes.alias("mix_passes"), blocks.alias("_m_blocks")), "mixture")


def mix(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", p: MixParams = MixParams()) -> DataFrame:
    """One row for each pass of each document, with mix_tokens, mix_weight, mix_passes, mix_epoch and mix_order.

    Rows ordered by mix_epoch and mix_order are the mixture: passes follow each other, blocks of all sources come in an
    order drawn for the pass, and within a block documents keep its seeded order, begun at another place in each whole pass.
    """
    counted = docs.withColumn("mix_tokens", tokens(F.col(text)))
    plan = source_plan(counted.select(source, "mix_tokens"), source, p)
    dealt = counted.withColumn("_m_row", F.xxhash64(F.lit(p.seed), id_col, text, F.monotonically_increasing_id()))
    dealt = dealt.join(plan, dealt[source].eqNullSafe(plan["_m_source"])).withColumn("_m_block", F.pmod(F.xxhash64("_m_row", F.lit("block")), F.col("_m_blocks")))
    block = Window.partitionBy("_m_source", "_m_block")
    order = block.orderBy("_m_row", F.col(id_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_of_it = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.floor("mix_passes")
    middle = F.sum("mix_tokens").over(order) - F.col("mix_tokens") / 2
    more = (F.col("mix_tokens") > 0) & (middle <= (F.col("mix_passes") - whole) * F.sum("mix_tokens").over(all_of_it))
    ranked = dealt.withColumns({"_m_copies": (whole + more.cast("int")).cast("int"), "_m_rank": F.count(F.lit(1)).over(order) - 1, "_m_size": F.count(F.lit(1)).over(all_of_it)})
    passed = ranked.where(F.col("_m_copies") > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_m_copies") - 1)))
    drawn = F.xxhash64(F.lit(p.seed), "mix_epoch", "_m_source", "_m_block")
    rank = F.when(F.col("mix_epoch") < whole, F.pmod(F.col("_m_rank") + F.pmod(drawn, F.lit(1 << 20)), F.col("_m_size"))).otherwise(F.col("_m_rank"))
    passed = passed.withColumn("mix_order", F.shiftleft(F.pmod(F.xxhash64(drawn), F.lit(1 << 36)), 26) + rank)
    return passed.drop("_m_source", "_m_blocks", "_m_block", "_m_copies", "_m_row", "_m_rank", "_m_size")


def mixed_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mixture's documents with the columns of docs alone, one row for each pass."""
    return mix(docs, p=p).select(*docs.columns)
