"""Gibbs sampling of pairwise models as tables: many chains at once, one colour class of nodes after the other.

Nodes of one colour share no edge, so they are drawn together: a step is a join of the edges with the neighbours' states
and a group-by, for all chains and all nodes of the colour. A draw takes the state of the largest log weight plus Gumbel
noise, whose uniform number is a hash of chain, node, state and step: a task that runs again draws the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semifold.operators.dataset import uniform
from semifold.operators.lineage import dropped, kept


def colours(nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """v and colour for all nodes (v), so that no edge (u, v) has one colour: in each round the nodes that come before all
    their neighbours left, by a hash, take the least colour that no neighbour has. Loops are left out."""
    both = edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = kept(both)
    left = kept(nodes.select("v").distinct().withColumn("rank", uniform("v", seed=seed)))
    done = None
    while left.limit(1).count():
        beside = both.join(left.select(F.col("v").alias("u"), F.col("rank").alias("beside")), "u").groupBy("v").agg(F.max(F.struct("beside", "u")).alias("most"))
        first = left.join(beside, "v", "left").where(F.col("most").isNull() | (F.struct(F.col("rank").alias("beside"), F.col("v").alias("u")) > F.col("most"))).select("v")
        if done is None:
            picked = first.withColumn("colour", F.lit(0))
        else:
            used = both.join(done.select(F.col("v").alias("u"), "colour"), "u").groupBy("v").agg(F.collect_set("colour").alias("used"))  # colours are few
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.coalesce(F.size("used"), F.lit(0))), F.coalesce("used", F.array().cast("array<int>"))))
            picked = first.join(used, "v", "left").select("v", free.alias("colour"))
        now = kept(picked if done is None else done.unionByName(picked))
        rest = kept(left.join(now, "v", "left_anti"))
        dropped(left, *([] if done is None else [done]))
        left, done = rest, now
    return done if done is not None else nodes.select("v").withColumn("colour", F.lit(0)).limit(0)


def gibbs(nodes: DataFrame, edges: DataFrame, chains: int, sweeps: int, burn_in: int, seed: int = 0) -> DataFrame:
    """v, s and share of visits after burn_in sweeps, over all chains, for nodes (v, s, value) and edges (u, v, su, sv,
    value), one direction for each edge. Values must be positive."""
    colour = kept(colours(nodes, edges, seed))
    own = kept(nodes.join(colour, "v").select("v", "s", F.ln("value").alias("own"), "colour"))
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("sv").alias("su"), F.col("su").alias("sv"), "value")
    both = kept(edges.select("u", "v", "su", "sv", "value").unionByName(back).join(colour, "v").select("u", "v", "su", "sv", F.ln("value").alias("pull"), "colour"))
    classes = [x[0] for x in colour.select("colour").distinct().orderBy("colour").collect()]
    noise = lambda step: -F.ln(-F.ln(F.greatest(uniform("chain", "v", "s", seed=seed * 1_000_003 + step), F.lit(1e-300))))
    chain = nodes.sparkSession.range(chains).select(F.col("id").alias("chain"))
    # Each chain starts at draws from the nodes' own weights; every node is in every chain, which is what is asked for.
    state = kept(own.crossJoin(chain).groupBy("chain", "v", "colour").agg(F.max_by("s", F.col("own") + noise(0)).alias("s")))
    counts, step = None, 0
    for sweep in range(sweeps):
        for k in classes:
            step += 1
            pulls = both.where(F.col("colour") == k).join(state.select("chain", F.col("v").alias("u"), F.col("s").alias("su")), ["u", "su"])
            pulls = pulls.groupBy("chain", "v", F.col("sv").alias("s")).agg(F.sum("pull").alias("pull"))
            here = state.where(F.col("colour") == k).select("chain", "v", "colour").join(own.select("v", "s", "own"), "v").join(pulls, ["chain", "v", "s"], "left")
            drawn = here.groupBy("chain", "v", "colour").agg(F.max_by("s", F.col("own") + F.coalesce("pull", F.lit(0.0)) + noise(step)).alias("s"))
            before, state = state, kept(state.where(F.col("colour") != k).unionByName(drawn))
            dropped(before)
        if sweep >= burn_in:
            seen = state.groupBy("v", "s").agg(F.count("*").alias("n"))
            before, counts = counts, kept(seen if counts is None else counts.unionByName(seen).groupBy("v", "s").agg(F.sum("n").alias("n")))
            dropped(*([] if before is None else [before]))
    every = own.select("v", "s").join(counts, ["v", "s"], "left")
    return every.select("v", "s", (F.coalesce("n", F.lit(0)) / float(chains * max(1, sweeps - burn_in))).alias("share"))
