"""Queries of model files, and of filters and learners along streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from semifold.operators.lineage import fresh
from semifold.plans.queries_fields import code, names_of
from semifold.plans.queries_sources import events, finished
from semifold.plans.registry import query, r, t
from semifold.sources import models
from semifold.streaming import dynamic, estimation

CELLS = """WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2), ss AS (SELECT DISTINCT o_orderstatus AS s FROM orders), ps AS (SELECT DISTINCT o_orderpriority AS p FROM orders),
g AS (SELECT s, p, coalesce(n, 0) AS n FROM ss CROSS JOIN ps LEFT JOIN c USING (s, p)) """


def counts(spark, d) -> tuple[list[str], list[str], dict[tuple, int]]:
    """States of status and priority, and the orders' counts: a model file's content."""
    rows = t(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").count().collect()  # a model of a few cells
    n = {(x[0], x[1]): x[2] for x in rows}
    return sorted({s for s, _ in n}), sorted({p for _, p in n}), n


def written(spark, text: str) -> str:
    """The path of a text file in the session's folder."""
    path = fresh(spark, "model")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


@query(f"{CELLS} SELECT (row_number() OVER (ORDER BY s, p) - 1)::INT AS cell, n::DOUBLE AS value FROM g")
def uai_round_trip(spark, d):
    """Counts as a UAI file, and read again: the last argument fastest."""
    ss, ps, n = counts(spark, d)
    text = f"MARKOV\n2\n{len(ss)} {len(ps)}\n1\n2 0 1\n\n{len(ss) * len(ps)}\n"
    text += "\n".join(" ".join(str(float(n.get((s, p), 0))) for p in ps) for s in ss)
    return models.uai_factors(spark, written(spark, text)).select("cell", "value")


@query(f"{CELLS} SELECT 's' AS child, s AS state, '' AS given, round(sum(n) / (SELECT sum(n) FROM g), 6) AS value FROM g GROUP BY s UNION ALL SELECT 'p', p, s, round(n / sum(n) OVER (PARTITION BY s), 6) FROM g")
def bif_round_trip(spark, d):
    """p(status) and p(priority | status) as a BIF network, and read again."""
    ss, ps, n = counts(spark, d)
    total, own = sum(n.values()), {s: sum(n.get((s, p), 0) for p in ps) for s in ss}
    name = lambda x: x.replace(" ", "_")  # noqa: E731  names have no spaces in this format
    text = "network orders { }\n" + "".join(f"variable {v} {{ type discrete [ {len(x)} ] {{ {', '.join(map(name, x))} }}; }}\n" for v, x in (("s", ss), ("p", ps)))
    text += f"probability ( s ) {{ table {', '.join(repr(own[s] / total) for s in ss)}; }}\n"
    text += "probability ( p | s ) {\n" + "".join(f"({name(s)}) {', '.join(repr(n.get((s, p), 0) / own[s]) for p in ps)};\n" for s in ss) + "}\n"
    back = F.create_map(*(F.lit(y) for x in ps for y in (name(x), x)))
    got = models.bif_factors(spark, written(spark, text))
    return r(got.select("child", F.coalesce(F.element_at(back, F.col("state")), F.col("state")).alias("state"), F.array_join("parent_states", ",").alias("given"), "value"), "value")


@query(f"{CELLS} SELECT (row_number() OVER (ORDER BY s, p) - 1)::INT AS cell, n::DOUBLE AS value FROM g")
def pairwise_network_round_trip(spark, d):
    """The counts as a text network of two variables, and read again."""
    ss, ps, n = counts(spark, d)
    text = f"@Variables\n0 {len(ss)}\n1 {len(ps)}\n@End\n@Potentials\n2 0 1 " + " ".join(str(float(n.get((s, p), 0))) for s in ss for p in ps) + "\n@End\n"
    return models.pairwise_network(spark, written(spark, text))[1].select(F.col("cell").cast("int").alias("cell"), "value")


# Filters along each user's events: a state is more or less likely to buy, which shows in the types of events.

_MOVE, _PRIOR = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.6, 0.4])
STEPS = """WITH RECURSIVE names AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS c, count(*) OVER () AS k FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT user_id, c, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events JOIN names USING (event_type)),
"""


def rising(k: int) -> np.ndarray:
    """How likely a type is in each state: falling in one, rising in the other."""
    return np.array([[(k - c) / (k * (k + 1) / 2) for c in range(k)], [(c + 1) / (k * (k + 1) / 2) for c in range(k)]])


@query(f"""{STEPS} f AS (SELECT user_id, i, n, 0.6 * (k - c) / ((k - c) * 0.6 + (c + 1) * 0.4) AS p FROM e WHERE i = 1
UNION ALL SELECT f.user_id, e.i, e.n, (p * 0.9 + (1 - p) * 0.2) * (k - c) / ((p * 0.9 + (1 - p) * 0.2) * (k - c) + (p * 0.1 + (1 - p) * 0.8) * (c + 1)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, n AS steps, round(p, 5) AS p_low, round(1 - p, 5) AS p_high FROM f WHERE i = n""")
def stream_bayes_filter(spark, d):
    """Each user's belief after all events."""
    names = names_of(t(spark, d, "events"), "event_type")
    like = {x: row for x, row in zip(names, rising(len(names)).T, strict=True)}
    df = estimation.bayes_filter(events(spark, d), "user_id", "event_id", "event_type", ["low", "high"], _PRIOR, _MOVE, like)
    return r(finished(df, spark, "update"), "p_low", "p_high", places=5)


@query(f"""{STEPS} s AS (SELECT x::INT AS a, y::INT AS b FROM range(2) p(x), range(2) q(y)),
f AS (SELECT user_id, i, n, list(v / z ORDER BY a, b) AS p FROM (SELECT *, sum(v) OVER (PARTITION BY user_id) AS z FROM (SELECT user_id, i, n, a, b, (0.6 - 0.2 * a) * (CASE WHEN b = a THEN 0.7 ELSE 0.3 END) * (CASE WHEN b = 0 THEN k - c ELSE c + 1 END) AS v FROM e, s WHERE i = 1)) GROUP BY ALL
UNION ALL SELECT user_id, i, n, list(v / z ORDER BY a, b) FROM (SELECT *, sum(v) OVER (PARTITION BY user_id) AS z FROM (
  SELECT f.user_id, e.i, e.n, t.a, t.b, sum(f.p[o.a * 2 + o.b + 1] * (CASE WHEN o.a = 0 THEN 0.9 - 0.8 * t.a ELSE 0.2 + 0.6 * t.a END) * (CASE WHEN t.b = o.b THEN 0.75 + 0.1 * (o.a = o.b)::INT ELSE 0.25 - 0.1 * (o.a = o.b)::INT END)) * (CASE WHEN t.b = 0 THEN any_value(k - c) ELSE any_value(c + 1) END) AS v
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1, s o, s t GROUP BY f.user_id, e.i, e.n, t.a, t.b)) GROUP BY ALL)
SELECT user_id, n AS steps, round(p[3] + p[4], 5) AS intent, round(p[2] + p[4], 5) AS activity FROM f WHERE i = n""")
def stream_dynamic_network(spark, d):
    """Two hidden variables of a user, one cluster of both: filtering is exact, as in SQL's step by step sums."""
    source = t(spark, d, "events")
    names = names_of(source, "event_type")
    apart = np.array([[[0.85, 0.15], [0.25, 0.75]], [[0.75, 0.25], [0.15, 0.85]]])  # by intent and activity before
    network = dynamic.DynamicNetwork(
        {"intent": 2, "activity": 2},
        {"intent": ((), _PRIOR), "activity": (("intent",), np.array([[0.7, 0.3], [0.3, 0.7]]))},
        {"intent": (("intent",), _MOVE), "activity": (("intent", "activity"), apart)},
        {"code": (("activity",), rising(len(names)))},
    )
    stream = events(spark, d).withColumn("code", code("event_type", names))
    got = finished(dynamic.filtered(stream, "user_id", "event_id", network, [("intent", "activity")]), spark, "update")
    wide = got.groupBy("user_id", "steps").pivot("variable", ["intent", "activity"]).agg(F.first(F.get("belief", F.lit(1))))
    return r(wide, "intent", "activity", places=5)


@query("SELECT 'intercept' AS name, round(2.0 * avg(y - 0.5), 6) AS weight FROM (SELECT (event_type = 'purchase')::INT AS y FROM events) UNION ALL SELECT 'value', round(2.0 * avg((y - 0.5) * x), 6) FROM (SELECT (event_type = 'purchase')::INT AS y, value / 100 AS x FROM events)")
def stream_online_logistic(spark, d):
    """One gradient step for the one micro-batch that holds all events."""
    stream = events(spark, d).select((F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("value") / 100).alias("x"))
    w = estimation.OnlineLogistic(["x"], "y", rate=2.0).run(stream, fresh(spark, "progress"))
    return r(spark.createDataFrame([("intercept", float(w[0])), ("value", float(w[1]))], "name string, weight double"), "weight")
