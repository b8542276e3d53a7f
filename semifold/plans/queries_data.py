"""Queries of dataset basics, statistics and log-space factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from semifold.functions import scalar
from semifold.operators import dataset, statistics
from semifold.operators.factor import Factor
from semifold.plans.registry import WITH, f_flag, g_line, p_flag, q_flag, query, r, t

#: A number in [0, 1) from the first 32 bits of a digest, as dataset.uniform makes it.
DRAW = "CAST(CAST('0x' || substr(md5({key}), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0"


@query("WITH e AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events) SELECT event_id, user_id FROM e WHERE k = floor(n * 0.37)")
def sample_row(spark, d):
    return dataset.row_at(t(spark, d, "events").select("event_id", "user_id"), 0.37, "event_id")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY md5('7|' || s_suppkey), s_suppkey) - 1 AS position FROM supplier")
def shuffle_rows(spark, d):
    return dataset.shuffled(t(spark, d, "supplier").select("s_suppkey"), "s_suppkey", seed=7)


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(n_nationkey + 100 AS INT), n_name FROM nation UNION ALL SELECT 999, NULL")
def insert_records(spark, d):
    n = t(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("int").alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return dataset.inserted(dataset.inserted(t(spark, d, "region").select("r_regionkey", "r_name"), n), spark.range(1).select(F.lit(999).alias("r_regionkey")))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_records(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return dataset.updated(c, F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("DEBT"), "c_acctbal": F.lit(0.0)})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3")
def restrict_dataset(spark, d):
    return dataset.restricted(t(spark, d, "lineitem"), {"l_returnflag": "R", "l_linenumber": 3}).select("l_orderkey", "l_linenumber")


@query("SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean, sum(CAST(2 AS DOUBLE)) AS total FROM lineitem GROUP BY 1")
def weighted_dataset(spark, d):
    w = dataset.weighted(t(spark, d, "lineitem"), F.col("l_quantity"))
    mean = w.groupBy("l_returnflag").agg((F.sum(F.col("weight") * F.col("l_discount")) / F.sum("weight")).alias("mean"))
    total = dataset.weighted(w, 2.0).groupBy("l_returnflag").agg(F.sum("weight").alias("total"))
    return r(mean.join(total, "l_returnflag"), "mean")


@query("SELECT l_orderkey, l_linenumber, 1.0 AS x0, l_quantity AS x1, l_tax AS x2 FROM lineitem")
def design_matrix(spark, d):
    x = dataset.value_matrix(t(spark, d, "lineitem"), ["l_quantity", "l_tax"], ones=True)
    return x.select("l_orderkey", "l_linenumber", *(F.get("x", F.lit(k)).alias(f"x{k}") for k in range(3)))


@query("SELECT p_partkey, 'p_brand' AS variable, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part")
def record_assignments(spark, d):
    return dataset.assignments(t(spark, d, "part"), "p_partkey", ["p_brand", "p_size"])


@query("SELECT p_partkey, p_brand, p_size FROM part")
def assignment_records(spark, d):
    a = dataset.assignments(t(spark, d, "part"), "p_partkey", ["p_brand", "p_size"])
    return dataset.records(a, "p_partkey", {"p_brand": "string", "p_size": "int"})


@query("WITH e AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events), f AS (SELECT *, CAST(floor(((k + 1) * 5 - 1) / n) AS INT) AS fold FROM e) SELECT fold = 2 AS test, event_type, count(*) AS rows, round(avg(value), 6) AS mean FROM f GROUP BY 1, 2")
def held_out_fold(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type", "value")
    f = dataset.kfold(dataset.with_row_index(e, "event_id"), 5, e.count())
    both = dataset.held_out(f, 2, True).withColumn("test", F.lit(True)).unionByName(dataset.held_out(f, 2, False).withColumn("test", F.lit(False)))
    return r(both.groupBy("test", "event_type").agg(F.count("*").alias("rows"), F.avg("value").alias("mean")), "mean")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice / 1000 - 100 > 50 AND o_orderstatus = 'F'")
def filter_by_score(spark, d):
    o = dataset.restricted(t(spark, d, "orders"), {"o_orderstatus": "F"})
    return dataset.scored_filter(o, F.col("o_totalprice") / 1000 - 100, 50.0).select("o_orderkey")


@query("SELECT l_returnflag, count(l_linenumber) AS n FROM (SELECT l_returnflag, nullif(l_linenumber, 3) AS l_linenumber FROM lineitem) GROUP BY 1")
def missing_values_skipped(spark, d):
    li = t(spark, d, "lineitem").withColumn("l_linenumber", F.expr("nullif(l_linenumber, 3)"))
    return statistics.missing_policy(li, ["l_linenumber", "l_returnflag"], "SKIP").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT event_type, CASE s WHEN 0 THEN 'low' ELSE 'high' END AS state, round(sum(CASE s WHEN 0 THEN 1 / (1 + exp(value / 100 - 1)) ELSE 1 - 1 / (1 + exp(value / 100 - 1)) END), 4) AS value FROM events, range(2) x(s) GROUP BY 1, 2")
def soft_counts(spark, d):
    low = 1 / (1 + F.exp(F.col("value") / 100 - 1))
    return r(statistics.soft_counts(t(spark, d, "events"), ("event_type",), {"low": low, "high": 1 - low}).df, "value", places=4)


@query(f"{WITH} SELECT round(sum(n * ln(value)) / ln(2), 4) AS value FROM p JOIN (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2) USING (flag, status)")
def log_likelihood_base_2(spark, d):
    li = t(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"})
    return r(p_flag(spark, d).log_likelihood(li).withColumn("value", F.col("value") / F.ln(F.lit(2.0))), "value", places=4)


@query("""WITH c AS (SELECT p_brand AS x, p_type AS y, count(*) AS n FROM part GROUP BY 1, 2), f AS (SELECT b.x, k.y, coalesce(n, 0) + 0.01 AS n FROM (SELECT DISTINCT x FROM c) b CROSS JOIN (SELECT DISTINCT y FROM c) k LEFT JOIN c ON c.x = b.x AND c.y = k.y),
w AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM f) SELECT 'p_brand' AS a, 'p_type' AS b, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM w""")
def smoothed_information(spark, d):
    return r(statistics.pairwise_information(t(spark, d, "part"), ["p_brand", "p_type"], smoothing=0.01), "mi")


MAD = "WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events), m AS (SELECT event_type, value AS median FROM e WHERE k = floor(n / 2)), f AS (SELECT event_type, median, abs(value - median) AS far FROM events JOIN m USING (event_type)), g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY far) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM f)"


@query(f"{MAD} SELECT event_type, round(median, 6) AS median, round(far, 6) AS mad FROM g WHERE k = floor(n / 2)")
def median_deviation(spark, d):
    return r(statistics.median_deviation(t(spark, d, "events"), "value", ("event_type",)), "median", "mad")


@query(f"{MAD} SELECT 'MEDIAN' AS kind, event_type, round(median, 6) AS center, round(far, 6) AS spread FROM g WHERE k = floor(n / 2) UNION ALL SELECT 'MEAN', event_type, round(avg(value), 6), round(stddev_pop(value) / sqrt(count(value)), 6) FROM events GROUP BY event_type")
def generalized_mean(spark, d):
    e = t(spark, d, "events")
    both = [statistics.generalized_mean(e, "value", ("event_type",), k).withColumn("kind", F.lit(k)) for k in ("MEAN", "MEDIAN")]
    return r(both[0].unionByName(both[1]), "center", "spread")


@query("SELECT l_linenumber, l_returnflag, count(l_tax) AS n, round(avg(l_tax), 6) AS mean, round(coalesce(stddev_samp(l_tax), 0), 6) AS dev FROM lineitem GROUP BY 1, 2")
def result_set(spark, d):
    return r(statistics.result_set(t(spark, d, "lineitem"), ("l_linenumber", "l_returnflag"), "l_tax"), "mean", "dev")


@query("SELECT 'vector' AS kind, round(avg(power(value - 100, 2)), 4) AS mean, round(sum(power(value - 100, 2)), 2) AS total FROM events UNION ALL SELECT 'finite', round(avg(CAST(event_type <> 'click' AS DOUBLE)), 4), sum(CAST(event_type <> 'click' AS DOUBLE)) FROM events")
def error_measures(spark, d):
    e = t(spark, d, "events").withColumns({"guess": F.lit(100.0), "kind": F.lit("click")})
    v = statistics.errors(e, "value", "guess", "vector").withColumn("kind", F.lit("vector"))
    f = statistics.errors(e, "event_type", "kind", "finite").withColumn("kind", F.lit("finite"))
    return v.unionByName(f).select("kind", F.round("mean", 4).alias("mean"), F.round("total", 2).alias("total"))


@query("WITH x AS (SELECT quality, toxic, CAST(n_chars > 1000 AS INT) AS a, CAST(n_chars < 10 AS INT) AS b FROM labels JOIN documents USING (doc_id)) SELECT round(avg(CAST(quality = a AS INT)), 6) AS quality_accuracy, round(avg(CAST(toxic = b AS INT)), 6) AS toxic_accuracy, round(avg(CAST(quality = a AND toxic = b AS INT)), 6) AS all_accuracy FROM x")
def label_accuracy(spark, d):
    x = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").withColumns({"a": (F.col("n_chars") > 1000).cast("int"), "b": (F.col("n_chars") < 10).cast("int")})
    return r(statistics.label_accuracy(x, {"quality": "a", "toxic": "b"}), "quality_accuracy", "toxic_accuracy", "all_accuracy")


# Factors in log space, point access, ordered folds and the message bound.

LOGS = f"{WITH}, l AS (SELECT flag, status, ln(a) AS a, ln(b) AS b FROM pq) "


def _logs(spark, d, op) -> Factor:
    return p_flag(spark, d).map(scalar.log).combine(q_flag(spark, d).map(scalar.log), op)


@query(f"{LOGS} SELECT flag, status, round(a - b, 6) AS quotient, round(greatest(a, b), 6) AS most, round(least(a, b), 6) AS least, CASE WHEN a > b THEN round(ln(exp(a) - exp(b)), 4) END AS difference FROM l")
def factor_log_ops(spark, d):
    out = _logs(spark, d, "-").df.withColumnRenamed("value", "quotient")
    for name, op in (("most", "max"), ("least", "min"), ("difference", lambda a, b: F.when(a > b, scalar.log_subtract(F.greatest(a, b), F.least(a, b))))):
        out = out.join(_logs(spark, d, op).df.withColumnRenamed("value", name), ["flag", "status"])
    return r(r(out, "quotient", "most", "least"), "difference", places=4)


@query(f"{LOGS} SELECT flag, status, CASE WHEN isinf(a) OR isinf(b) THEN 0.0 ELSE 1.0 END AS both_set, CASE WHEN isinf(a) AND isinf(b) THEN 0.0 ELSE 1.0 END AS either_set FROM l")
def factor_log_logic(spark, d):
    """A log value of -inf is false."""
    truth = lambda v: (v != scalar.NEG_INF).cast("double")
    a, b = (f.map(scalar.log).map(truth) for f in (p_flag(spark, d), q_flag(spark, d)))
    both, either = a.combine(b, "&").df.withColumnRenamed("value", "both_set"), a.combine(b, "|").df.withColumnRenamed("value", "either_set")
    return both.join(either, ["flag", "status"])


@query(f"{WITH} SELECT line, round(sum(f.value + g.value), 6) AS value FROM f JOIN g USING (status) GROUP BY line")
def factor_join_sum(spark, d):
    return r(f_flag(spark, d).combine_collapse(g_line(spark, d), "+", F.sum, ("line",)).df, "value")


@query(f"{WITH} SELECT line, round(ln(sum(f.value * g.value)), 6) AS value FROM f JOIN g USING (status) GROUP BY line")
def factor_log_exp_mult(spark, d):
    """log of the sum of exp(log f + log g): a log-space message."""
    logs = f_flag(spark, d).map(scalar.log).combine(g_line(spark, d).map(scalar.log), "+")
    return r(logs.collapse(lambda v: F.ln(F.sum(F.exp(v))), ("line",)).df, "value")


@query(f"{WITH}, s AS (SELECT flag, sum(value) AS z FROM p GROUP BY flag) SELECT 1 AS given_flag, CAST(min(CAST(abs(z - 1) < 1e-9 AS INT)) AS INT) AS given_flag_of_joint FROM s")
def factor_is_conditional(spark, d):
    a = p_flag(spark, d).conditional("flag").is_conditional(("flag",)).withColumnRenamed("value", "given_flag")
    return a.crossJoin(p_flag(spark, d).is_conditional(("flag",)).withColumnRenamed("value", "given_flag_of_joint"))


@query(f"{WITH} SELECT l_orderkey, l_linenumber, round(value, 6) AS value, round(ln(value), 6) AS log_value FROM lineitem JOIN p ON l_returnflag = flag AND l_linestatus = status")
def factor_lookup(spark, d):
    points = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return r(p_flag(spark, d).lookup(points).drop("flag", "status").withColumn("log_value", scalar.log(F.col("value"))), "value", "log_value")


@query(f"{WITH} SELECT flag, status, CASE WHEN flag = 'R' THEN 0.25 ELSE round(value, 6) END AS value FROM p UNION ALL SELECT 'X', 'X', 0.5")
def factor_assign(spark, d):
    p = p_flag(spark, d)
    new = p.df.where("flag = 'R'").withColumn("value", F.lit(0.25)).unionByName(spark.range(1).select(F.lit("X").alias("flag"), F.lit("X").alias("status"), F.lit(0.5).alias("value")))
    return r(p.assign(new).df, "value")


@query(f"{WITH}, o AS (SELECT value, row_number() OVER (ORDER BY status, flag) AS k, count(*) OVER () AS n FROM p) SELECT round(sum(value * power(-2, n - k)), 6) AS from_left, round(sum(value * power(-2, k - 1)), 6) AS from_right FROM o")
def factor_ordered_fold(spark, d):
    p = p_flag(spark, d)
    left, right = (p.fold_ordered(lambda acc, v: v - 2 * acc, 0.0, side).withColumnRenamed("value", n) for side, n in ((False, "from_left"), (True, "from_right")))
    return r(left.crossJoin(right), "from_left", "from_right")


@query(f"{WITH}, l AS (SELECT status, line, ln(value) AS v FROM g), d AS (SELECT x.status AS a, y.status AS b, x.v - y.v AS d FROM l x JOIN l y ON x.line = y.line AND x.status < y.status), s AS (SELECT max(d) - min(d) AS s FROM d GROUP BY a, b) SELECT round((exp(max(s) / 2) - 1) / (exp(max(s) / 2) + 1), 6) AS value FROM s")
def factor_message_bound(spark, d):
    return r(g_line(spark, d).message_derivative_bound("status", "line"), "value")


# Endless sources, permutations, text forms and ranges.


@query("WITH r AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS k, count(*) OVER () AS n FROM region) SELECT p AS position, r_name FROM range(17) x(p) JOIN r ON k = p % n")
def cycled_source(spark, d):
    return dataset.cycled(t(spark, d, "region").select("r_regionkey", "r_name"), 17, "r_regionkey").select("position", "r_name")


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 25")
def taken_rows(spark, d):
    return dataset.taken(t(spark, d, "events").select("event_id"), 25, "event_id")


@query("WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier) SELECT n - 1 - k AS row_idx, s_suppkey FROM s")
def permute_rows(spark, d):
    s = dataset.with_row_index(t(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    n = s.count()
    return dataset.permuted(s, spark.range(n).select(F.col("id").alias("row_idx"), (n - 1 - F.col("id")).alias("place"))).select("row_idx", "s_suppkey")


@query("SELECT concat_ws(' ', 'n_nationkey=' || n_nationkey, 'n_name=' || n_name) AS line FROM nation UNION ALL SELECT concat_ws(chr(9), CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)) FROM nation UNION ALL SELECT n_nationkey || ' ' || coalesce(nullif(n_name, 'FRANCE'), '?') FROM nation")
def printed_records(spark, d):
    n = t(spark, d, "nation").withColumn("weight", F.col("n_regionkey"))
    lost = n.withColumn("n_name", F.expr("nullif(n_name, 'FRANCE')"))
    parts = [dataset.printed(x, ["n_nationkey", "n_name"], mode) for x, mode in ((n, "vars"), (n, "tabbed_weighted"), (lost, "default"))]
    return parts[0].select("line").unionByName(parts[1].select("line")).unionByName(parts[2].select("line"))


@query("SELECT user_id, min(ts) FILTER (value > 200) AS first, CAST(count(*) FILTER (value > 200) AS BIGINT) AS n FROM events GROUP BY user_id")
def find_and_count(spark, d):
    return dataset.find_first(t(spark, d, "events"), "user_id", "ts", F.col("value") > 200)


@query("WITH e AS (SELECT user_id, ts, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, ts FROM e WHERE a = 'click' AND b = 'view' AND c = 'click'")
def search_subsequence(spark, d):
    return dataset.search_sequence(t(spark, d, "events"), "user_id", "ts", "event_type", ["click", "view", "click"])
