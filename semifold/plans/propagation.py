"""Message passing over pairwise models: synchronous loopy belief propagation and mean field as tables of messages.

A model is a node table (v, s, value) of potentials and an edge table (u, v, su, sv, value), one direction for each edge.
Each round is a fixed number of joins and group-bys, whatever the graph: node totals, cavities, messages, normalisation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semifold.operators.lineage import dropped
from semifold.operators.lineage import kept as _kept
from semifold.plans.factor_graphs import Bethe


def _directed(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("sv").alias("su"), F.col("su").alias("sv"), "value")
    return edges.select("u", "v", "su", "sv", "value").unionByName(back)


def _cells(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The model as a table of factor cells: a factor for each node's potential and one for each edge."""
    text = lambda *c: F.array(*(F.col(x).cast("string") for x in c))
    part = lambda df, vs, ss: df.select(F.to_json(text(*vs)).alias("f"), text(*vs).alias("vars"), text(*ss).alias("states"), F.col("value").cast("double").alias("value"))
    return part(nodes, ["v"], ["s"]).unionByName(part(edges, ["u", "v"], ["su", "sv"]))


def _normalised(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn(value, F.col(value) / F.sum(value).over(Window.partitionBy(*keys)))


def _messages(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float, maximise: bool, tolerance: float, share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Both directions of the edges, and the messages (u, v, sv, m) after the rounds. share: a round
    leaves messages as they are that would move by less than share of the largest move."""
    both = _kept(_directed(edges))
    messages = both.select("u", "v", "sv").distinct().withColumn("m", F.lit(1.0))
    messages = _kept(_normalised(messages, ["u", "v"], "m"))
    fold = F.max if maximise else F.sum
    for step in range(rounds):
        base = _log_beliefs(nodes, messages).select(F.col("v").alias("u"), F.col("s").alias("su"), "log_belief")
        reverse = messages.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("sv").alias("su"), F.ln("m").alias("log_back"))
        cavity = both.join(base, ["u", "su"]).join(reverse, ["u", "v", "su"])
        top = F.max(F.col("log_belief") - F.col("log_back")).over(Window.partitionBy("u", "v"))
        sent = cavity.withColumn("x", F.exp(F.col("log_belief") - F.col("log_back") - top) * F.col("value")).groupBy("u", "v", "sv").agg(fold("x").alias("new"))
        sent = _normalised(sent, ["u", "v"], "new")
        stepped = sent.join(messages, ["u", "v", "sv"]).select("u", "v", "sv", F.col("m").alias("old"), ((1 - damping) * F.col("new") + damping * F.col("m")).alias("m"), F.abs(F.col("new") - F.col("m")).alias("moved"))
        if share:
            stepped = stepped.withColumn("_own", F.max("moved").over(Window.partitionBy("u", "v")))  # a message moves whole
            stepped = _kept(stepped)
            top = stepped.agg(F.max("moved").alias("_top"))
            stepped = stepped.crossJoin(top).withColumn("m", F.when(F.col("_own") >= share * F.col("_top"), F.col("m")).otherwise(F.col("old"))).drop("_own", "_top")
        stepped = _kept(stepped.drop("old"))
        messages = stepped.drop("moved")
        if step % 2 and (stepped.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:  # looked at in every other round
            break
    return both, messages


def _log_beliefs(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """nodes with log_belief: their potential and all messages to them. Messages combine before the shuffle."""
    total = messages.groupBy("v", F.col("sv").alias("s")).agg(F.sum(F.ln("m")).alias("_in"))
    return nodes.join(total, ["v", "s"], "left").withColumn("log_belief", F.ln("value") + F.coalesce("_in", F.lit(0.0))).drop("_in")


def belief_propagation(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.0, maximise: bool = False, tolerance: float = 0.0, skip: float = 0.0, share: float = 0.0) -> DataFrame:
    """Node beliefs (v, s, belief) after the given rounds of synchronous updates, fewer if no message moves by tolerance.

    maximise: max-product messages. damping: share of the old message that is kept. skip: odds of leaving a message out of a
    round (an asynchronous schedule; it has no rounds of its own, so it runs on the factor graph, where only messages that can
    change are passed, and tolerance and damping hold for their logarithms). share: only messages that would move by this share of the largest move are sent (a
    residual schedule, many messages at a time). Exact on trees of smaller diameter once nothing moves.
    """
    if skip:
        run = Bethe(_cells(nodes, edges)).run(rounds, damping, tolerance, share, maximise, skip)
        kinds = dict(nodes.dtypes)
        return run.beliefs().select(F.col("v").cast(kinds["v"]).alias("v"), F.col("s").cast(kinds["s"]).alias("s"), "belief")
    joined = _log_beliefs(nodes, _messages(nodes, edges, rounds, damping, maximise, tolerance, share)[1])
    top = F.max("log_belief").over(Window.partitionBy("v"))
    return _normalised(joined.withColumn("belief", F.exp(F.col("log_belief") - top)), ["v"], "belief").select("v", "s", "belief")


def edge_beliefs(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """Beliefs of the edges (u, v, su, sv, belief), as edges are given: the potential times what either end holds without the
    other's message."""
    messages = _messages(nodes, edges, rounds, damping, False, tolerance)[1]
    held = _log_beliefs(nodes, messages)
    side = lambda a, b, s: held.select(F.col("v").alias(a), F.col("s").alias(s), F.col("log_belief").alias(f"_b_{a}"))
    back = lambda a, b, s: messages.select(F.col("u").alias(b), F.col("v").alias(a), F.col("sv").alias(s), F.ln("m").alias(f"_m_{a}"))
    e = edges.join(side("u", "v", "su"), ["u", "su"]).join(side("v", "u", "sv"), ["v", "sv"]).join(back("u", "v", "su"), ["u", "v", "su"]).join(back("v", "u", "sv"), ["u", "v", "sv"])
    log = F.ln("value") + F.col("_b_u") - F.col("_m_u") + F.col("_b_v") - F.col("_m_v")
    e = e.withColumn("_l", log).withColumn("belief", F.exp(F.col("_l") - F.max("_l").over(Window.partitionBy("u", "v"))))
    return _normalised(e, ["u", "v"], "belief").select("u", "v", "su", "sv", "belief")


def map_states(beliefs: DataFrame) -> DataFrame:
    """Each node's state of largest belief, the least state on ties."""
    w = Window.partitionBy("v").orderBy(F.desc("belief"), "s")
    return beliefs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).select("v", "s")


def mean_field(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.5, tolerance: float = 0.0) -> DataFrame:
    """Fully factorised approximation (v, s, q): all nodes are updated together in each round, keeping a share of the old
    value (damping), until none moves by tolerance or the rounds are over. Values must be positive."""
    both = _kept(_directed(edges))
    q = _kept(_normalised(nodes.select("v", "s", F.col("value").alias("q")), ["v"], "q"))
    for _ in range(rounds):
        pull = both.join(q.select(F.col("v").alias("u"), F.col("s").alias("su"), F.col("q").alias("qu")), ["u", "su"]).groupBy("v", F.col("sv").alias("s")).agg(F.sum(F.col("qu") * F.ln("value")).alias("pull"))
        raw = nodes.join(pull, ["v", "s"], "left").withColumn("l", F.ln("value") + F.coalesce("pull", F.lit(0.0)))
        raw = raw.withColumn("new", F.exp(F.col("l") - F.max("l").over(Window.partitionBy("v"))))
        new = _normalised(raw.select("v", "s", "new"), ["v"], "new")
        step = _kept(new.join(q, ["v", "s"]).select("v", "s", ((1 - damping) * F.col("new") + damping * F.col("q")).alias("q"), F.abs(F.col("new") - F.col("q")).alias("moved")))
        dropped(q)
        q = step
        if tolerance and (q.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return q.select("v", "s", "q")
