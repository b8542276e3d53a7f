"""Iterations read their input once, pass no more rows than can change, and broadcast nothing that grows with the graph."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from semifold.operators import graph, learning
from semifold.plans import factor_graphs
from semifold.plans.propagation import belief_propagation


def counted(spark, df):
    """df and an accumulator of how many of its rows were read in all."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def test_cross_validation_reads_rows_once(spark):
    df, seen = counted(spark, spark.range(100).select((F.col("id") % 4).alias("fold"), F.col("id").cast("double").alias("x")))
    fit = lambda rows, shrink: rows.agg(F.avg("x")).first()[0] * shrink
    score = lambda guess, rows: rows.agg((-F.avg((F.col("x") - guess) ** 2)).alias("value"))
    found = learning.cross_validated(df, 4, [{"shrink": 0.9}, {"shrink": 1.0}], fit, score)
    assert [p["shrink"] for p in found] == [0.9, 1.0] and seen.value == 100


def test_refined_parts_read_edges_once(spark):
    df, seen = counted(spark, spark.range(40).select(F.col("id").alias("src"), ((F.col("id") + 1) % 40).alias("dst")).coalesce(1))
    parts = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("part"))
    after = graph.refined_parts(df, parts, 6)
    assert seen.value <= 80  # the two directions of each edge
    edges = spark.range(40).select(F.col("id").alias("src"), ((F.col("id") + 1) % 40).alias("dst"))
    assert graph.cut_size(edges, after).first()[0] < graph.cut_size(edges, parts).first()[0] == 40
    assert {r["part"]: r["count"] for r in after.groupBy("part").count().collect()} == {0: 20, 1: 20}


@pytest.mark.parametrize("of", [graph.components, graph.topological_levels, graph.acyclic_part])
def test_graph_rounds_broadcast_nothing(spark, monkeypatch, of):
    plans, keep = [], graph._kept

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "_kept", watched)
    edges = spark.range(1, 20).select(F.floor(F.col("id") / 2).alias("src"), F.col("id").alias("dst"))
    assert of(edges).count() in (0, 20)
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_asynchronous_rounds_pass_shared_messages_only(spark, monkeypatch):
    n = 50
    nodes = [(f"c{k}", s, 1.0 + 0.01 * k * s) for k in range(n) for s in (0, 1)] + [(v, s, 1.0) for v in ("hub", "end") for s in (0, 1)]
    edges = [(u, v, a, b, 2.0 if a == b else 1.0) for u, v in [*((f"c{k}", "hub") for k in range(n)), ("hub", "end")] for a in (0, 1) for b in (0, 1)]
    nodes = spark.createDataFrame(nodes, "v string, s int, value double")
    edges = spark.createDataFrame(edges, "u string, v string, su int, sv int, value double")
    want = {(r["v"], r["s"]): r["belief"] for r in belief_propagation(nodes, edges, 6, tolerance=1e-12).collect()}
    rows, keep = [], factor_graphs.kept

    def watched(df):
        table = keep(df)
        if "moved" in table.columns:
            rows.append(table.count())
        return table

    monkeypatch.setattr(factor_graphs, "kept", watched)
    got = {(r["v"], r["s"]): r["belief"] for r in belief_propagation(nodes, edges, 12, tolerance=-1.0, skip=0.25).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert rows == [n + 1] * 12  # each edge's message to the hub
