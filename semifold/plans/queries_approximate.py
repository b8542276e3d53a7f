"""Queries of Gaussian approximations and of views of sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from semifold.operators import approximate, dataset, gaussian
from semifold.plans.registry import query, r, t


@query("""WITH m AS (SELECT l_returnflag AS flag, avg(l_quantity) AS x, avg(l_discount) AS y, var_pop(l_quantity) AS vx, var_pop(l_discount) AS vy, covar_pop(l_quantity, l_discount) AS c FROM lineitem GROUP BY 1)
SELECT flag, round(x * y + c, 6) AS mean, round(x * x * vy + y * y * vx + 2 * x * y * c + vx * vy + c * c, 6) AS variance, round(x * c + y * vx, 6) AS with_quantity FROM m""")
def transformed_gaussian(spark, d):
    """The product of two Gaussian variables: mean, variance and covariance with the first, as the closed form has them."""
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    got = approximate.transformed(gaussian.estimate(rows, ("flag",), ("q", "d")), lambda x: x[:, :1] * x[:, 1:], ("y",))
    at = lambda c, k: F.get(c, F.lit(k))
    return r(got.select("flag", at("mean", 2).alias("mean"), at("cov", 8).alias("variance"), at("cov", 2).alias("with_quantity")), "mean", "variance", "with_quantity")


@query("SELECT event_type, round(ln(count(*) / (sum(value) / 100)), 5) AS mean, round(1.0 / count(*), 6) AS variance FROM events GROUP BY 1")
def laplace_of_rates(spark, d):
    """The log rate of each type of events by its value: mode and curvature of n x - v exp(x)."""
    rates = t(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), (F.sum("value") / 100).alias("v")).withColumn("x", F.lit(0.0))
    got = approximate.laplace(rates, ("event_type",), ("x",), lambda x, p: p["n"].to_numpy() * x[:, 0] - p["v"].to_numpy() * np.exp(np.minimum(x[:, 0], 50)), ["n", "v"], ["x"])
    return r(got.select("event_type", F.get("mean", F.lit(0)).alias("mean"), F.get("cov", F.lit(0)).alias("variance")), "mean", places=5).withColumn("variance", F.round("variance", 6))


@query("SELECT user_id, i - 2 AS t, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i BETWEEN 2 AND 5")
def sequence_slice(spark, d):
    """Steps two to five of each user's events, numbered anew."""
    steps = dataset.numbered_steps(t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return dataset.sequence_slice(steps, "t", 2, 6).select("user_id", "t", "event_type")


@query("""WITH s AS (SELECT user_id, row_number() OVER (ORDER BY md5('9|' || user_id), user_id) - 1 AS place FROM (SELECT DISTINCT user_id FROM events))
SELECT place, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, event_type FROM events JOIN s USING (user_id)""")
def sequences_shuffled(spark, d):
    """Users in a seeded order, each with all events in theirs."""
    steps = dataset.numbered_steps(t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return dataset.shuffled_sequences(steps, "user_id", seed=9).select("place", "user_id", "t", "event_type")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, event_type FROM events)
SELECT user_id, t, event_type FROM s UNION ALL SELECT -1 - user_id, t, CASE WHEN t = 0 THEN 'start' ELSE event_type END FROM s""")
def sequences_inserted(spark, d):
    """Each sequence once more under another key, with its first step assigned a new value."""
    steps = dataset.numbered_steps(t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "t", "event_type")
    more = dataset.updated(steps.withColumn("user_id", -1 - F.col("user_id")), F.col("t") == 0, {"event_type": F.lit("start")})
    return dataset.inserted_sequences(steps, more, "user_id")
