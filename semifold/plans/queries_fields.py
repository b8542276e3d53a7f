"""Queries of conditional random fields: at the likelihood's optimum, expected counts equal observed ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from semifold.operators.crf import ChainField, TreeField
from semifold.operators.optimize import Options
from semifold.plans.registry import query, t


def code(column: str, names: list) -> F.Column:
    """Place of a value among names, from 0."""
    return (F.array_position(F.array(*map(F.lit, names)), F.col(column)) - 1).cast("int")


def names_of(df, column: str) -> list:
    return [x[0] for x in df.select(column).distinct().orderBy(column).collect()]  # labels: few by the field's definition


def told(spark, rows):
    """Counts as observed, and whether the field expects the same up to a ten-thousandth of all steps."""
    return spark.createDataFrame(rows, "kind string, a string, b string, observed double, met boolean")


@query("""WITH s AS (SELECT event_type AS y, value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT 'label' AS kind, y AS a, '' AS b, count(*)::DOUBLE AS observed, true AS met FROM s GROUP BY y
UNION ALL SELECT 'value', y, '', round(sum(value) / 100, 3), true FROM s GROUP BY y
UNION ALL SELECT 'move', y, next, count(*), true FROM s WHERE next IS NOT NULL GROUP BY y, next""")
def chain_field_expectations(spark, d):
    """Event types along each user's events, given their values, by maximum likelihood."""
    events = t(spark, d, "events")
    names = names_of(events, "event_type")
    steps = events.withColumns({"y": code("event_type", names), "i": F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1})
    chain = ChainField(len(names), 2)
    blocks = chain.store(steps, "user_id", "i", "y", [F.lit(1.0), F.col("value") / 100])
    chain = chain.fit(blocks, options=Options(steps=150, tolerance=6e-5))
    out = chain.expectations(blocks, chain.theta)
    seen, hoped = np.split(out[2:], 2)
    keys = [("label", a, "") for a in names] + [("value", a, "") for a in names] + [("move", a, b) for a in names for b in names]
    return told(spark, [(*k, round(float(s), 3), bool(abs(s - h) < 1e-4 * out[1])) for k, s, h in zip(keys, seen, hoped, strict=True) if s or k[0] != "move"])


@query("""WITH s AS (SELECT o_orderstatus AS st, o_orderpriority AS pr, c_mktsegment AS se, o_totalprice / 100000 AS x FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'status' AS kind, st AS a, '' AS b, round(sum(x), 3) AS observed, true AS met FROM s GROUP BY st
UNION ALL SELECT 'priority', pr, '', round(sum(x), 3), true FROM s GROUP BY pr UNION ALL SELECT 'segment', se, '', round(sum(x), 3), true FROM s GROUP BY se
UNION ALL SELECT 'status priority', st, pr, count(*), true FROM s GROUP BY st, pr UNION ALL SELECT 'status segment', st, se, count(*), true FROM s GROUP BY st, se""")
def tree_field_expectations(spark, d):
    """Status, priority and segment of whole orders as a tree, given the price, by maximum likelihood."""
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    columns = {"status": "o_orderstatus", "priority": "o_orderpriority", "segment": "c_mktsegment"}
    names = {k: names_of(rows, c) for k, c in columns.items()}
    tree = TreeField(tuple(len(x) for x in names.values()), ((0, 1), (0, 2)), 2)
    table = tree.store(rows.withColumns({k: code(c, names[k]) for k, c in columns.items()}), list(columns), [F.lit(1.0), F.col("o_totalprice") / 100000])
    tree = tree.fit(table, options=Options(steps=150, tolerance=6e-5))
    out = tree.expectations(table, tree.theta)
    seen, hoped = np.split(out[2:], 2)
    keys = [(k if price else None, a, "") for k, x in names.items() for price in (0, 1) for a in x]
    keys += [(f"status {k}", a, b) for k in ("priority", "segment") for a in names["status"] for b in names[k]]
    return told(spark, [(*k, round(float(s), 3), bool(abs(s - h) < 1e-4 * out[1])) for k, s, h in zip(keys, seen, hoped, strict=True) if k[0] and (s or " " not in k[0])])
