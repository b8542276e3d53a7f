"""Queries over the driver's tables, one for each operator, with DuckDB SQL of the same columns where SQL has them.

Reals are rounded to six places on both sides, since sums in different order differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semifold.functions import scalar
from semifold.functions.semiring import BOOLEAN, MAX_PRODUCT, MAX_SUM, MIN_SUM, SUM_PRODUCT
from semifold.operators import dataset, graph, learning, statistics
from semifold.operators.factor import Factor, product
from semifold.plans.elimination import eliminate
from semifold.plans.models import max_product_assignment
from semifold.plans.propagation import belief_propagation, map_states, mean_field
from semifold.plans.sampling import gibbs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Factors f(flag, status), g(status, line) and a distribution p(flag, status), and the same in SQL.


def f_flag(spark, d) -> Factor:
    df = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("value"))
    return Factor(df.withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"}), ("flag", "status"))


def g_line(spark, d) -> Factor:
    df = t(spark, d, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.avg("l_tax").alias("value"))
    return Factor(df.withColumnsRenamed({"l_linestatus": "status", "l_linenumber": "line"}), ("status", "line"))


def p_flag(spark, d) -> Factor:
    df = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("value"))
    return Factor(df.withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"}), ("flag", "status")).normalize()


def q_flag(spark, d) -> Factor:
    df = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("value"))
    return Factor(df.withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"}), ("flag", "status")).normalize()


WITH = """WITH f AS (SELECT l_returnflag AS flag, l_linestatus AS status, avg(l_discount) AS value FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_linestatus AS status, l_linenumber AS line, avg(l_tax) AS value FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) / sum(count(*)) OVER () AS value FROM lineitem GROUP BY 1, 2),
q AS (SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) / sum(sum(l_quantity)) OVER () AS value FROM lineitem GROUP BY 1, 2),
pq AS (SELECT flag, status, p.value AS a, q.value AS b FROM p JOIN q USING (flag, status)) """


def _binary(name: str, op, expr: str) -> None:
    def run(spark, d):
        return r(f_flag(spark, d).combine(g_line(spark, d), op).df, "value")

    QUERIES[name] = run
    ORACLES[name] = f"{WITH} SELECT flag, status, line, round({expr}, 6) AS value FROM f JOIN g USING (status)"


for _name, _op, _expr in (
    ("factor_product", "*", "f.value * g.value"),
    ("factor_sum", "+", "f.value + g.value"),
    ("factor_difference", "-", "f.value - g.value"),
    ("factor_quotient", "/", "CASE WHEN f.value = 0 AND g.value = 0 THEN 0 ELSE f.value / g.value END"),
    ("factor_max", "max", "greatest(f.value, g.value)"),
    ("factor_min", "min", "least(f.value, g.value)"),
    ("factor_and", "&", "CAST(f.value <> 0 AND g.value <> 0 AS DOUBLE)"),
    ("factor_or", "|", "CAST(f.value <> 0 OR g.value <> 0 AS DOUBLE)"),
):
    _binary(_name, _op, _expr)


@query(f"{WITH} SELECT flag, status, round(0.7 * a + 0.3 * b, 6) AS value FROM pq")
def factor_weighted_update(spark, d):
    return r(p_flag(spark, d).weighted_update(q_flag(spark, d), 0.3).df, "value")


@query(f"{WITH} SELECT flag, status, round(-power(1 / value, 2) * 3 + 1, 6) AS value FROM p")
def factor_scalar_ops(spark, d):
    return r(p_flag(spark, d).map(scalar.reciprocal).map(lambda v: -F.pow(v, F.lit(2)) * 3 + 1).df, "value")


@query(f"{WITH} SELECT flag, status, line, round(ln(f.value) + ln(g.value), 6) AS value FROM f JOIN g USING (status)")
def factor_log_product(spark, d):
    return r(f_flag(spark, d).map(scalar.log).combine(g_line(spark, d).map(scalar.log), "+").df, "value")


@query(f"{WITH} SELECT flag, status, round(ln(a + b), 6) AS value FROM pq")
def factor_log_add(spark, d):
    return r(p_flag(spark, d).map(scalar.log).combine(q_flag(spark, d).map(scalar.log), scalar.log_add).df, "value")


@query(f"{WITH} SELECT round(sum(f.value * g.value), 6) AS value FROM f JOIN g USING (status)")
def factor_join_aggregate(spark, d):
    return r(f_flag(spark, d).combine_collapse(g_line(spark, d), "*", F.sum).df, "value")


@query(f"{WITH} SELECT flag, status, line, round(f.value, 6) AS left_value, round(g.value, 6) AS right_value FROM f JOIN g USING (status) WHERE f.value > g.value ORDER BY line, status, flag LIMIT 1")
def factor_join_find(spark, d):
    return r(f_flag(spark, d).join_find(g_line(spark, d), lambda a, b: a > b).select("flag", "status", "line", "left_value", "right_value"), "left_value", "right_value")


@query(f"{WITH} SELECT flag, line, round(f.value * g.value, 6) AS value FROM f JOIN g USING (status) WHERE status = 'O'")
def factor_restrict_multiply(spark, d):
    return r((f_flag(spark, d).restrict({"status": "O"}) * g_line(spark, d).restrict({"status": "O"})).df, "value")


@query(f"{WITH} SELECT flag, status, line, round(f.value * g.value * p.value, 6) AS value FROM f JOIN g USING (status) JOIN p USING (flag, status)")
def factor_product_all(spark, d):
    return r(product([f_flag(spark, d), g_line(spark, d), p_flag(spark, d)]).df, "value")


for _name, _fold in (("marginal", "sum"), ("maximum", "max"), ("minimum", "min")):
    QUERIES[f"factor_{_name}"] = lambda spark, d, m=_name: r(getattr(f_flag(spark, d) * g_line(spark, d), m)("flag").df, "value")
    ORACLES[f"factor_{_name}"] = f"{WITH} SELECT flag, round({_fold}(f.value * g.value), 6) AS value FROM f JOIN g USING (status) GROUP BY flag"


@query("SELECT l_linestatus AS status, max(CAST(l_discount > 0.09 AS DOUBLE)) AS any_high, min(CAST(l_discount > 0.09 AS DOUBLE)) AS all_high FROM lineitem GROUP BY 1")
def factor_logical_folds(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_linestatus").alias("status"), "l_orderkey", "l_linenumber", (F.col("l_discount") > 0.09).cast("double").alias("value"))
    f = Factor(rows, ("status", "l_orderkey", "l_linenumber"))
    return f.logical_or("status").df.withColumnRenamed("value", "any_high").join(f.logical_and("status").df.withColumnRenamed("value", "all_high"), "status")


@query(f"{WITH} SELECT flag, status, round(value / sum(value) OVER (), 6) AS value FROM f")
def factor_normalize(spark, d):
    return r(f_flag(spark, d).normalize().df, "value")


@query(f"{WITH} SELECT flag, status, round(value / sum(value) OVER (PARTITION BY flag), 6) AS value FROM p")
def factor_conditional(spark, d):
    return r(p_flag(spark, d).conditional("flag").df, "value")


@query(f"{WITH} SELECT flag, round(value, 6) AS value FROM p WHERE status = 'F'")
def factor_restrict(spark, d):
    return r(p_flag(spark, d).restrict({"status": "F"}).df, "value")


@query("SELECT CAST(l_linenumber - 1 + 7 * (CAST(l_quantity AS INT) % 5) AS BIGINT) AS code, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1")
def factor_unroll(spark, d):
    rows = t(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("a"), (F.col("l_quantity").cast("int") % 5).alias("b"))
    return Factor(rows.groupBy("a", "b").agg(F.count("*").alias("value")), ("a", "b")).unroll({"a": 7, "b": 5}, "code").df


@query("SELECT CAST(l_linenumber - 1 AS INT) AS a, CAST(l_quantity AS INT) % 5 AS b, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2")
def factor_roll_up(spark, d):
    rows = t(spark, d, "lineitem").select((F.col("l_linenumber") - 1 + 7 * (F.col("l_quantity").cast("int") % 5)).alias("code"))
    return Factor(rows.groupBy("code").agg(F.count("*").alias("value")), ("code",)).roll_up({"a": 7, "b": 5}).df


@query(f"{WITH} SELECT round(-sum(value * ln(value)), 6) AS value FROM p")
def factor_entropy(spark, d):
    return r(p_flag(spark, d).entropy(), "value")


@query(f"{WITH} SELECT round(-sum(value * ln(value)) / ln(2), 6) AS value FROM p")
def factor_entropy_base_2(spark, d):
    return r(p_flag(spark, d).entropy(2.0), "value")


@query(f"{WITH} SELECT round(greatest(sum(a * ln(a / b)), 0), 6) AS value FROM pq")
def factor_relative_entropy(spark, d):
    return r(p_flag(spark, d).relative_entropy(q_flag(spark, d)), "value")


@query(f"{WITH} SELECT round(greatest(sum((a * ln(2 * a / (a + b)) + b * ln(2 * b / (a + b))) / 2), 0), 6) AS value FROM pq")
def factor_js_divergence(spark, d):
    return r(p_flag(spark, d).js_divergence(q_flag(spark, d)), "value")


@query(f"{WITH} SELECT round(sum(abs(a * ln(b))), 6) AS value FROM pq")
def factor_cross_entropy(spark, d):
    return r(p_flag(spark, d).cross_entropy(q_flag(spark, d)), "value")


@query(f"{WITH} SELECT round(sum(value * ln(value / (pa * pb))), 6) AS value FROM (SELECT value, sum(value) OVER (PARTITION BY flag) AS pa, sum(value) OVER (PARTITION BY status) AS pb FROM p)")
def factor_mutual_information(spark, d):
    return r(p_flag(spark, d).mutual_information(("flag",), ("status",)), "value")


@query(f"{WITH} SELECT round(sum(abs(a - b)), 6) AS n1, round(max(abs(a - b)), 6) AS ninf, round(sum(abs(ln(a) - ln(b))), 6) AS n1_log, round(max(abs(ln(a) - ln(b))), 6) AS ninf_log FROM pq")
def factor_norms(spark, d):
    both = p_flag(spark, d).df.join(q_flag(spark, d).df.withColumnRenamed("value", "other"), ["flag", "status"])
    x, y = F.abs(F.col("value") - F.col("other")), F.abs(scalar.log(F.col("value")) - scalar.log(F.col("other")))
    return r(both.agg(F.sum(x).alias("n1"), F.max(x).alias("ninf"), F.sum(y).alias("n1_log"), F.max(y).alias("ninf_log")), "n1", "ninf", "n1_log", "ninf_log")


@query(f"{WITH} SELECT flag, status, round(value, 6) AS value FROM p ORDER BY p.value DESC, status, flag LIMIT 1")
def factor_arg_max(spark, d):
    return r(p_flag(spark, d).arg_max(), "value")


@query(f"{WITH} SELECT flag, status, round(value, 6) AS value FROM p ORDER BY p.value, status, flag LIMIT 1")
def factor_arg_min(spark, d):
    return r(p_flag(spark, d).arg_min(), "value")


@query(f"{WITH} SELECT CAST(0 AS BIGINT) AS value")
def factor_equality(spark, d):
    p = p_flag(spark, d)
    return p.differs_from(p.reorder("status", "flag"), 1e-12)


@query(f"{WITH} SELECT round(sum(ln(p.value)), 4) AS value FROM lineitem JOIN p ON l_returnflag = flag AND l_linestatus = status")
def factor_log_likelihood(spark, d):
    data = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return r(p_flag(spark, d).log_likelihood(data), "value", places=4)


# Marginal queries in every semiring over the chain nation - segment - priority - status.


def chain(spark, d) -> list[Factor]:
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    scaled = lambda df: df.withColumn("value", F.col("value") / 100.0)
    co = c.join(o, F.col("c_custkey") == F.col("o_custkey"))
    a = c.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("value"))
    b = co.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("value"))
    e = o.groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("value"))
    return [Factor(scaled(a), ("nation", "segment")), Factor(scaled(b), ("segment", "priority")), Factor(scaled(e), ("priority", "status"))]


CHAIN = """WITH a AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) / 100.0 AS value FROM customer GROUP BY 1, 2),
b AS (SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) / 100.0 AS value FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
e AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) / 100.0 AS value FROM orders GROUP BY 1, 2),
j AS (SELECT nation, segment, priority, status, a.value AS x, b.value AS y, e.value AS z FROM a JOIN b USING (segment) JOIN e USING (priority)) """


@query(f"{CHAIN} SELECT nation, round(sum(x * y * z), 6) AS value FROM j GROUP BY nation")
def ve_chain_marginal(spark, d):
    return r(eliminate(chain(spark, d), ("nation",), SUM_PRODUCT).df, "value")


@query(f"{CHAIN} SELECT nation, status, round(max(x * y * z), 6) AS value FROM j GROUP BY nation, status")
def ve_max_product(spark, d):
    return r(eliminate(chain(spark, d), ("nation", "status"), MAX_PRODUCT).df, "value")


@query(f"{CHAIN} SELECT nation, round(min(x + y + z), 6) AS value FROM j GROUP BY nation")
def ve_min_sum(spark, d):
    return r(eliminate(chain(spark, d), ("nation",), MIN_SUM).df, "value")


@query(f"{CHAIN} SELECT status, round(max(x + y + z), 6) AS value FROM j GROUP BY status")
def ve_max_sum(spark, d):
    return r(eliminate(chain(spark, d), ("status",), MAX_SUM, by="degree").df, "value")


@query(f"{CHAIN} SELECT nation, max(CAST(x > 0.1 AND y > 6 AND z > 0 AS DOUBLE)) AS value FROM j GROUP BY nation")
def ve_boolean(spark, d):
    limits = [0.1, 6.0, 0.0]
    factors = [f.map(lambda v, k=k: (v > k).cast("double")) for f, k in zip(chain(spark, d), limits, strict=True)]
    return eliminate(factors, ("nation",), BOOLEAN).df


@query(f"{CHAIN} SELECT status, round(sum(x * y * z), 6) AS value FROM j WHERE segment = 'BUILDING' GROUP BY status")
def ve_with_evidence(spark, d):
    return r(eliminate(chain(spark, d), ("status",), evidence={"segment": "BUILDING"}).df, "value")


@query(f"{CHAIN} SELECT nation, segment, priority, status FROM j ORDER BY x * y * z DESC, status, priority, segment, nation LIMIT 1")
def map_assignment(spark, d):
    return max_product_assignment(chain(spark, d)).select("nation", "segment", "priority", "status")


# Datasets.

EVENTS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events"


@query("SELECT l_tax, l_orderkey, l_quantity FROM lineitem")
def project_reorder(spark, d):
    return t(spark, d, "lineitem").select("l_tax", "l_orderkey", "l_quantity")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, event_id FROM events")
def row_index(spark, d):
    return dataset.with_row_index(t(spark, d, "events").select("event_id"), "event_id").select("row_idx", "event_id")


@query("WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, event_id FROM events) SELECT row_idx, event_id FROM e WHERE row_idx >= 5 AND row_idx < 20 UNION ALL SELECT row_idx, event_id FROM e WHERE row_idx >= 15 AND row_idx < 30")
def row_slices(spark, d):
    e = dataset.with_row_index(t(spark, d, "events").select("event_id"), "event_id").select("row_idx", "event_id")
    return dataset.row_slices(e, [(5, 20), (15, 30)])


@query("WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, event_id FROM events), n AS (SELECT count(*) AS n FROM events) SELECT fold, count(*) AS rows, min(row_idx) AS first_row FROM (SELECT row_idx, CAST(floor(((row_idx + 1) * 7 - 1) / n) AS INT) AS fold FROM e, n) GROUP BY fold")
def kfold_split(spark, d):
    e = t(spark, d, "events").select("event_id")
    f = dataset.kfold(dataset.with_row_index(e, "event_id"), 7, e.count())
    return f.groupBy("fold").agg(F.count("*").alias("rows"), F.min("row_idx").alias("first_row"))


@query("SELECT l_orderkey, l_linenumber, [1, 0, 0, 1, 0, 1, 1][l_linenumber] AS color, CAST(l_returnflag = 'R' AS INT) AS is_r, CAST(l_linenumber - 1 + 7 * (CAST(l_quantity AS INT) % 3) AS BIGINT) AS merged FROM lineitem")
def recode_columns(spark, d):
    li = t(spark, d, "lineitem")
    line, third = F.col("l_linenumber") - 1, F.col("l_quantity").cast("int") % 3
    return li.select("l_orderkey", "l_linenumber", dataset.recode(line, [1, 0, 0, 1, 0, 1, 1]).alias("color"), dataset.indicator(F.col("l_returnflag"), "R").alias("is_r"), dataset.merged_code([line, third], [7, 3]).alias("merged"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def normalize_columns(spark, d):
    return r(dataset.z_scores(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), "c_acctbal")


@query("SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS a, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS b FROM part")
def unit_sphere(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return r(dataset.unit_rows(p, ["a", "b"]), "a", "b")


@query(f"WITH e AS ({EVENTS}) SELECT a.user_id, a.ts, a.event_type AS event_type__0, b.event_type AS event_type__1 FROM e a JOIN e b ON a.user_id = b.user_id AND b.step = a.step + 1")
def sliding_pairs(spark, d):
    return dataset.sliding(t(spark, d, "events"), "user_id", "ts", ["event_type"], 1)


@query(f"WITH e AS ({EVENTS}) SELECT a.user_id, a.ts, round(a.value, 6) AS value__0, round(b.value, 6) AS value__1, round(c.value, 6) AS value__2, round(f.value, 6) AS value__3 FROM e a JOIN e b ON a.user_id = b.user_id AND b.step = a.step + 1 JOIN e c ON a.user_id = c.user_id AND c.step = a.step + 2 JOIN e f ON a.user_id = f.user_id AND f.step = a.step + 3")
def sliding_history(spark, d):
    return r(dataset.sliding(t(spark, d, "events"), "user_id", "ts", ["value"], 3), "value__0", "value__1", "value__2", "value__3")


@query(f"WITH e AS ({EVENTS}) SELECT user_id, max(event_type) FILTER (step = 2) AS event_type__0, max(event_type) FILTER (step = 3) AS event_type__1 FROM e WHERE step IN (2, 3) GROUP BY user_id HAVING count(*) = 2")
def fixed_steps(spark, d):
    return dataset.fixed_steps(t(spark, d, "events"), "user_id", "ts", ["event_type"], 2, 4)


# Statistics.


@query("WITH c AS (SELECT p_brand, p_type, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1, 2), f AS (SELECT b.p_brand, y.p_type, coalesce(n, 0) + 0.5 AS v FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type FROM part) y LEFT JOIN c ON c.p_brand = b.p_brand AND c.p_type = y.p_type) SELECT p_brand, p_type, round(v / sum(v) OVER (), 6) AS value FROM f")
def mle_marginal(spark, d):
    return r(statistics.mle_marginal(t(spark, d, "part"), ("p_brand", "p_type"), smoothing=0.5).df, "value")


@query("WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT s, p, round((v + 1) / sum(v + 1) OVER (PARTITION BY p), 6) AS value FROM c")
def mle_conditional(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), "o_totalprice")
    return r(statistics.mle_conditional(o, ("s",), ("p",), weight="o_totalprice", smoothing=1.0).df, "value")


@query("SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS weight, 'l_quantity' AS i, 'l_discount' AS j, round(avg(l_quantity), 6) AS mean_i, round(avg(l_discount), 6) AS mean_j, round(covar_pop(l_quantity, l_discount), 6) AS cov FROM lineitem GROUP BY 1")
def mle_gaussian_by_key(spark, d):
    m = statistics.moments(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], keys=("l_returnflag",))
    return r(m.where((F.col("i") == "l_quantity") & (F.col("j") == "l_discount")), "mean_i", "mean_j", "cov")


@query("SELECT round(avg(l_quantity), 6) AS mean_q, round(avg(l_extendedprice), 4) AS mean_p, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov FROM lineitem")
def mean_covariance(spark, d):
    a = statistics.mean_covariance(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumnsRenamed({"mean_a": "mean_q", "mean_b": "mean_p"})
    return r(r(r(a, "mean_q"), "mean_p", places=4), "cov", places=3)


@query("SELECT round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean, round(sqrt((sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - power(sum(l_quantity * l_discount) / sum(l_quantity), 2)) / sum(l_quantity)), 6) AS stderr FROM lineitem")
def expected_value(spark, d):
    return r(statistics.expected_value(t(spark, d, "lineitem"), F.col("l_discount"), F.col("l_quantity")), "mean", "stderr")


@query("SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS INT) AS rank FROM orders")
def order_statistics(spark, d):
    return statistics.order_statistics(t(spark, d, "orders"), "o_totalprice", "o_orderkey", ("o_orderpriority",)).select("o_orderpriority", "o_orderkey", "rank")


@query("SELECT event_type, round(value, 6) AS median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k = floor(n / 2)")
def median_upper(spark, d):
    return r(statistics.upper_median(t(spark, d, "events"), "value", ("event_type",)), "median")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value) / sqrt(count(value)), 6) AS stderr, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1")
def light_accumulator(spark, d):
    return r(statistics.accumulator(t(spark, d, "events"), "value", ("event_type",)), "mean", "stderr", "least", "most")


@query("""WITH c AS (SELECT 'l_linenumber' AS a, 'l_linestatus' AS b, CAST(l_linenumber AS VARCHAR) AS x, l_linestatus AS y FROM lineitem
UNION ALL SELECT 'l_linenumber', 'l_returnflag', CAST(l_linenumber AS VARCHAR), l_returnflag FROM lineitem UNION ALL SELECT 'l_linestatus', 'l_returnflag', l_linestatus, l_returnflag FROM lineitem),
n AS (SELECT a, b, x, y, count(*) AS n FROM c GROUP BY ALL), w AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a, b) AS t, sum(n) OVER (PARTITION BY a, b, x) AS nx, sum(n) OVER (PARTITION BY a, b, y) AS ny FROM n)
SELECT a, b, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM w GROUP BY a, b""")
def pairwise_information(spark, d):
    return r(statistics.pairwise_information(t(spark, d, "lineitem"), ["l_linenumber", "l_linestatus", "l_returnflag"]), "mi")


@query("WITH x AS (SELECT quality AS t, CAST(n_chars > 1000 AS INT) AS p FROM labels JOIN documents USING (doc_id)), l AS (SELECT DISTINCT t AS label FROM x UNION SELECT DISTINCT p FROM x) SELECT label, round(coalesce(count(*) FILTER (t = label AND p = label) / nullif(count(*) FILTER (p = label), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (t = label AND p = label) / nullif(count(*) FILTER (t = label), 0), 0), 6) AS recall FROM x, l GROUP BY label")
def precision_recall(spark, d):
    x = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").select(F.col("quality").cast("int").alias("quality"), (F.col("n_chars") > 1000).cast("int").alias("long"))
    return r(statistics.precision_recall(x, "quality", "long"), "precision", "recall")


@query("SELECT min(l_quantity) AS least, max(l_quantity) AS most, arg_max(l_orderkey, struct_pack(a := l_extendedprice, b := -l_orderkey)) AS at_most FROM lineitem")
def column_extremes(spark, d):
    li = t(spark, d, "lineitem")
    return statistics.extremes(li, "l_quantity", "l_orderkey", "l_extendedprice")


# Ranges, sets and scalar functions.


@query("SELECT event_id, user_id, round(sum(value) OVER w, 4) AS partial_sum, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS difference FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def range_numerics(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = t(spark, d, "events").select("event_id", "user_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("partial_sum"), (F.col("value") - F.lag("value").over(w)).alias("difference"))
    return r(out, "difference")


@query("SELECT c_nationkey AS k, CAST(1 AS INT) AS op FROM customer UNION SELECT s_nationkey, 1 FROM supplier UNION (SELECT c_nationkey, 2 FROM customer INTERSECT SELECT s_nationkey, 2 FROM supplier) UNION (SELECT n_nationkey, 3 FROM nation EXCEPT SELECT c_nationkey, 3 FROM customer WHERE c_acctbal > 9900)")
def set_operations(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    rich = t(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    tag = lambda df, k: df.withColumn("op", F.lit(k))
    return tag(c.union(s).distinct(), 1).union(tag(c.intersect(s), 2)).union(tag(n.subtract(rich), 3))


@query("WITH s AS (SELECT DISTINCT l_orderkey AS set_id, l_linenumber AS element FROM lineitem) SELECT set_id FROM s WHERE element IN (1, 3, 5) GROUP BY set_id HAVING count(*) = 3")
def set_index_supersets(spark, d):
    s = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("element"))
    return graph.set_supersets(s, spark.range(3).select((F.col("id") * 2 + 1).cast("int").alias("element")))


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name")
def subset_pairs(spark, d):
    names = t(spark, d, "region").agg(F.array_sort(F.collect_list("r_name")).alias("names"))
    return graph.subsets(names, "names", 2, 2).select(F.get("subset", F.lit(0)).alias("a"), F.get("subset", F.lit(1)).alias("b"))


@query("SELECT p_partkey, list_filter(string_split_regex(p_name, '[ _#]+'), lambda x: x <> '')[1] AS first_part, upper(trim(p_brand)) AS brand, regexp_replace(p_type, '[^A-Za-z0-9]', '_', 'g') AS kind, translate(p_name, 'ae', 'xx') AS swapped FROM part")
def string_functions(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", F.get(scalar.split_any(F.col("p_name"), " _#"), F.lit(0)).alias("first_part"), F.upper(F.trim("p_brand")).alias("brand"), scalar.non_alnum_to(F.col("p_type"), "_").alias("kind"), scalar.swap_chars(F.col("p_name"), "ae", "x").alias("swapped"))


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS p, round(exp(value / 500) / (exp(value / 500) + exp(0.1) + exp(0.2)), 6) AS s0, round(CASE WHEN value = 0 THEN 0 ELSE value / value END, 6) AS one, round(ln(1 + abs(value)), 6) AS lg FROM events")
def link_functions(spark, d):
    e = t(spark, d, "events")
    v = F.col("value")
    out = e.select("event_id", scalar.logistic(v / 100).alias("p"), scalar.softmax([v / 500, F.lit(0.1), F.lit(0.2)])[0].alias("s0"), scalar.safe_divide(v, v).alias("one"), scalar.log(1 + F.abs(v)).alias("lg"))
    return r(out, "p", "s0", "one", "lg")


# Graphs: supplier - part - nation links and regular graphs.


def _links(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT degree, count(*) AS vertices FROM (SELECT src, count(*) AS degree FROM e GROUP BY src) GROUP BY degree")
def graph_degrees(spark, d):
    return graph.degree_distribution(_links(spark, d))


def _dag(spark, d):
    """Edges from a part's number to the number halved and to a third of it: a small directed acyclic graph."""
    p = t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k")).where("k > 1")
    half = p.select(F.floor(F.col("k") / 2).alias("src"), F.col("k").alias("dst"))
    third = p.where("k % 3 = 0").select(F.floor(F.col("k") / 3).alias("src"), F.col("k").alias("dst"))
    return half.unionByName(third).distinct()


DAG = "e AS (SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS src, CAST(p_partkey AS BIGINT) AS dst FROM part WHERE p_partkey > 1 UNION SELECT CAST(floor(p_partkey / 3) AS BIGINT), p_partkey FROM part WHERE p_partkey > 1 AND p_partkey % 3 = 0)"


@query(f"WITH RECURSIVE {DAG}, a(id) AS (SELECT src FROM e WHERE dst IN (60, 77) UNION SELECT e.src FROM e JOIN a ON e.dst = a.id) SELECT id FROM a")
def graph_ancestors(spark, d):
    roots = spark.range(1).select(F.explode(F.array(F.lit(60).cast("long"), F.lit(77).cast("long"))).alias("id"))
    return graph.ancestors(_dag(spark, d), roots).select("id")


@query(f"WITH RECURSIVE {DAG}, a(id) AS (SELECT dst FROM e WHERE src = 5 UNION SELECT e.dst FROM e JOIN a ON e.src = a.id) SELECT id FROM a")
def graph_descendants(spark, d):
    return graph.descendants(_dag(spark, d), spark.range(5, 6)).select("id")


@query(f"WITH RECURSIVE {DAG}, a(id, depth) AS (SELECT CAST(5 AS BIGINT), 0 UNION SELECT e.dst, depth + 1 FROM e JOIN a ON e.src = a.id WHERE depth < 3) SELECT id, CAST(min(depth) AS INT) AS depth FROM a GROUP BY id")
def graph_within_radius(spark, d):
    return graph.reachable(_dag(spark, d), spark.range(5, 6), 3)


@query(f"WITH {DAG}, m AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM e UNION SELECT a.src, b.src FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src) SELECT src, dst FROM m")
def graph_moral(spark, d):
    return graph.moral_graph(_dag(spark, d))


@query(f"WITH RECURSIVE {DAG}, a(id, level) AS (SELECT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM e JOIN a ON e.src = a.id) SELECT id, CAST(max(level) AS INT) AS level FROM a GROUP BY id")
def graph_topological_levels(spark, d):
    return graph.topological_levels(_dag(spark, d))


@query("WITH RECURSIVE e AS (SELECT CAST(s_suppkey AS BIGINT) AS a, CAST(s_suppkey + 7 AS BIGINT) AS b FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(id, root) AS (SELECT a, a FROM u UNION SELECT u.b, w.root FROM u JOIN w ON u.a = w.id) SELECT id, min(root) AS component FROM w GROUP BY id")
def graph_components(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("src"), (F.col("s_suppkey") + 7).cast("long").alias("dst"))
    return graph.components(s).select("id", "component")


@query("WITH v AS (SELECT CAST(x AS BIGINT) AS src FROM range(48) t(x)) SELECT src, src + 1 AS dst FROM v WHERE src % 8 < 7 UNION ALL SELECT src, src + 8 FROM v WHERE src < 40")
def graph_grid(spark, d):
    return graph.grid_graph(spark, 6, 8)


def price_graph(spark, d):
    line = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"))
    return line.agg(F.min("l_extendedprice").alias("weight"))


@query()
def graph_spanning_tree(spark, d):
    """Least spanning forest of parts and suppliers (negative keys), by the lowest price of each pair of them."""
    return graph.spanning_forest(price_graph(spark, d))


@query("WITH c AS (SELECT DISTINCT p_brand AS clique_id, p_size AS element FROM part) SELECT a.clique_id AS src, b.clique_id AS dst, count(*) AS weight FROM c a JOIN c b ON a.element = b.element AND a.clique_id < b.clique_id GROUP BY 1, 2")
def junction_separators(spark, d):
    """Separators between the brands' sets of sizes: few cliques, whatever the table's size."""
    return graph.running_intersection(t(spark, d, "part").select(F.col("p_brand").alias("clique_id"), F.col("p_size").alias("element")).distinct())


# Models and learning.


@query("""WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2), y AS (SELECT s, sum(n) / sum(sum(n)) OVER () AS py FROM c GROUP BY s),
x AS (SELECT s, p, n / sum(n) OVER (PARTITION BY s) AS px FROM c) SELECT o_orderkey, s AS o_orderstatus, round(py * px / sum(py * px) OVER (PARTITION BY o_orderkey), 6) AS probability FROM orders JOIN x ON o_orderpriority = p JOIN y USING (s)""")
def naive_bayes_posterior(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    model = learning.NaiveBayes.fit(o, "o_orderstatus", ["o_orderpriority"])
    return r(model.posterior(o, "o_orderkey"), "probability")


@query(f"WITH e AS ({EVENTS}), s AS (SELECT a.event_type AS current, b.event_type AS next FROM e a JOIN e b ON a.user_id = b.user_id AND b.step = a.step + 1), c AS (SELECT current, next, count(*) + 1.0 AS n FROM s GROUP BY 1, 2) SELECT next, current, round(n / sum(n) OVER (PARTITION BY current), 6) AS value FROM c")
def markov_transitions(spark, d):
    return r(learning.markov_chain(t(spark, d, "events"), "user_id", "ts", "event_type", smoothing=1.0)[1].df, "value")


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem")
def linear_regression(spark, d):
    b = learning.linear_regression(t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.range(1).select(F.lit(round(b["intercept"], 2)).alias("intercept"), F.lit(round(b["l_quantity"], 3)).alias("slope"))


@query()
def logistic_regression(spark, d):
    """Return flag R against quantity and discount by Newton steps."""
    li = t(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("x"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    b = learning.logistic_regression(li, ["q", "x"], "y")
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in b.items()))


@query()
def chow_liu_tree(spark, d):
    return r(learning.chow_liu(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax"]), "mi")


@query()
def gaussian_mixture(spark, d):
    parts = learning.gaussian_mixture_1d(t(spark, d, "events"), "value", [10.0, 100.0, 400.0], 10)
    rows = [F.struct(F.lit(k).alias("component"), *(F.lit(float(p[n])).alias(n) for n in ("weight", "mean", "sd"))) for k, p in enumerate(parts)]
    return spark.range(1).select(F.inline(F.array(*rows)))


@query(f"{WITH}, a AS (SELECT flag, sum(value) AS m FROM q GROUP BY flag), x AS (SELECT flag, status, p.value * a.m / sum(p.value) OVER (PARTITION BY flag) AS v FROM p JOIN a USING (flag)), b AS (SELECT status, sum(value) AS m FROM q GROUP BY status) SELECT flag, status, round(v * b.m / sum(v) OVER (PARTITION BY status), 6) AS value FROM x JOIN b USING (status)")
def proportional_fitting(spark, d):
    q = q_flag(spark, d)
    return r(learning.proportional_fitting(p_flag(spark, d), [q.marginal("flag"), q.marginal("status")], 1).df, "value")


# Inference on pairwise models with loops: the nations of each region in a ring, weighted by their customers' balances.

RING = """WITH RECURSIVE c AS (SELECT c_nationkey AS n, (avg(c_acctbal) - 4500) / 500 AS l FROM customer GROUP BY 1),
p AS (SELECT n_nationkey AS n, n_regionkey AS reg, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, count(*) OVER (PARTITION BY n_regionkey) AS m, coalesce(l, 0) AS l FROM nation LEFT JOIN c ON n = n_nationkey),
x AS (SELECT reg, m, unnest(range(1 << m)) AS x FROM (SELECT DISTINCT reg, m FROM p)),
w AS (SELECT reg, x, exp(sum(l * ((x >> k) & 1)) + sum(CASE WHEN (p.m > 2 OR k < p.m - 1) AND (x >> k) & 1 = (x >> ((k + 1) % p.m)) & 1 THEN 0.4 ELSE 0 END)) AS v FROM x JOIN p USING (reg) GROUP BY reg, x),
exact AS (SELECT n, b.s, sum(CASE WHEN (x >> k) & 1 = b.s THEN v ELSE 0 END) / sum(v) AS share FROM p JOIN w USING (reg), (VALUES (0), (1)) b(s) GROUP BY n, b.s) """


def ring(spark, d):
    """Nodes (v, s, value) and edges: neighbours of a ring in the same state count exp(0.4) times."""
    balance = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(((F.avg("c_acctbal") - 4500) / 500).alias("l"))
    n = t(spark, d, "nation").join(balance, "n_nationkey", "left").withColumn("l", F.coalesce("l", F.lit(0.0)))
    two = lambda name: F.explode(F.array(F.lit(0), F.lit(1))).alias(name)
    nodes = n.select(F.col("n_nationkey").alias("v"), "l", two("s")).select("v", "s", F.exp(F.col("l") * F.col("s")).alias("value"))
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    around = Window.partitionBy("n_regionkey")
    after = n.select(F.col("n_nationkey").alias("u"), F.lead("n_nationkey").over(w).alias("next"), F.min("n_nationkey").over(around).alias("first"), F.count("*").over(around).alias("m"))
    e = after.select("u", F.coalesce("next", F.when(F.col("m") > 2, F.col("first"))).alias("v")).where("v is not null")
    edges = e.select("u", "v", two("su")).select("u", "v", "su", two("sv")).withColumn("value", F.when(F.col("su") == F.col("sv"), F.exp(F.lit(0.4))).otherwise(1.0))
    return nodes, edges


def exact_marginals(spark, d):
    """Of the ring model, by elimination along each ring: the two paths from a node's neighbours are summed state by state."""
    nodes, edges = ring(spark, d)
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("v"), F.col("n_regionkey").alias("reg"))
    members = n.groupBy("reg").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # a region's nations
    rows = members.withColumn("x", F.explode(F.expr("sequence(0, cast(pow(2, size(vs)) as int) - 1)")))
    rows = rows.select("reg", "x", F.posexplode("vs").alias("k", "v")).select("reg", "x", "v", F.expr("shiftright(x, k) & 1").alias("s"))
    own = rows.join(nodes, ["v", "s"]).groupBy("reg", "x").agg(F.sum(F.ln("value")).alias("a"))
    ends = rows.select("reg", "x", F.col("v").alias("u"), F.col("s").alias("su")).join(edges, ["u", "su"]).join(rows.withColumnRenamed("s", "sv"), ["reg", "x", "v", "sv"])
    weight = own.join(ends.groupBy("reg", "x").agg(F.sum(F.ln("value")).alias("b")), ["reg", "x"], "left").select("reg", "x", F.exp(F.col("a") + F.coalesce("b", F.lit(0.0))).alias("p"))
    share = rows.join(weight, ["reg", "x"]).groupBy("v", "s").agg(F.sum("p").alias("p"))
    return share.withColumn("exact", F.col("p") / F.sum("p").over(Window.partitionBy("v"))).select("v", "s", "exact")


def beside_exact(spark, d, df, column: str, within: float):
    """The exact share of each state, and whether an estimate lies so near to it."""
    both = exact_marginals(spark, d).join(df, ["v", "s"], "left")
    return both.select("v", "s", F.round("exact", 5).alias("exact"), F.coalesce(F.abs(F.col(column) - F.col("exact")) < within, F.lit(False)).alias("near"))


@query(f"{RING} SELECT n AS v, s, round(share, 5) AS exact, true AS near FROM exact")
def loopy_belief_propagation(spark, d):
    """On rings, beliefs are no exact shares but near them."""
    return beside_exact(spark, d, belief_propagation(*ring(spark, d), rounds=16, tolerance=1e-6), "belief", 0.02)


@query(f"{RING} SELECT n AS v, ((arg_max(x, v) >> any_value(k)) & 1)::INT AS s FROM p JOIN w USING (reg) GROUP BY n")
def map_states_by_max_product(spark, d):
    """The most probable states of each ring; messages on a single ring find them."""
    return map_states(belief_propagation(*ring(spark, d), rounds=24, tolerance=1e-6, maximise=True))


@query(f"""{RING}, e AS (SELECT a.n AS u, b.n AS v FROM p a JOIN p b ON a.reg = b.reg AND b.k = (a.k + 1) % a.m AND (a.m > 2 OR a.k < a.m - 1)), both_ways AS (SELECT * FROM e UNION ALL SELECT v, u FROM e),
f AS (SELECT 0 AS i, n, l, 1 / (1 + exp(-l)) AS q FROM p UNION ALL SELECT a.i + 1, a.n, a.l, 1 / (1 + exp(-(a.l + 0.4 * sum(2 * b.q - 1)))) FROM f a JOIN both_ways ON v = a.n JOIN f b ON b.n = u WHERE a.i < 60 GROUP BY a.i, a.n, a.l)
SELECT n AS v, s, round(CASE WHEN s = 1 THEN q ELSE 1 - q END, 4) AS q FROM f, (VALUES (0), (1)) b(s) WHERE i = 60""")
def mean_field_of_nations(spark, d):
    """Iterated until no share moves; SQL iterates the same equations to their fixed point."""
    return r(mean_field(*ring(spark, d), rounds=40, damping=0.0, tolerance=1e-6), "q", places=4)


@query(f"{RING} SELECT n AS v, s, round(share, 5) AS exact, true AS near FROM exact")
def gibbs_sampling(spark, d):
    """3,000 draws of each node, a colour class at a time; their shares are within 0.06 of the exact ones."""
    return beside_exact(spark, d, gibbs(*ring(spark, d), chains=1000, sweeps=5, burn_in=2, seed=4), "share", 0.06)
