"""Queries of structure search, decomposable models and mixture factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from semifold.operators import gaussian
from semifold.operators.mixture import Mixture
from semifold.operators.structure import Entropies, conditional_weights, empty_model, heaviest_tree, hill_climb
from semifold.plans import models
from semifold.plans.registry import query, r, t

FOUR = ["flag", "line", "size", "status"]
FOUR_SQL = """WITH b AS (SELECT l_returnflag AS flag, l_linenumber AS line, CAST(floor(l_quantity / 10) AS INT) AS size, l_linestatus AS status FROM lineitem)"""


def four(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.floor(F.col("l_quantity") / 10).cast("int").alias("size"), F.col("l_linestatus").alias("status"))


def _entropy(columns) -> str:
    return f"(SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT count(*) AS n FROM b GROUP BY {', '.join(columns)}))"


_PAIRS = [(a, b) for k, a in enumerate(FOUR) for b in FOUR[k + 1 :]]
_BEST = " UNION ALL ".join(f"SELECT {_entropy([c for c in FOUR if c not in (a, b)])} - {_entropy([c for c in FOUR if c != a])} - {_entropy([c for c in FOUR if c != b])} AS score" for a, b in _PAIRS)


@query(f"{FOUR_SQL} SELECT round(max(score), 6) AS score, 2 AS width FROM ({_BEST})")
def best_decomposable_model(spark, d):
    """The best model of tree width two over four columns: SQL tries all that leave out one edge."""
    model, score = hill_climb(Entropies(four(spark, d), FOUR), empty_model(FOUR), 2)
    return r(spark.createDataFrame([(score, max(map(len, model.cliques())) - 1)], "score double, width int"), "score")


@query(f"""{FOUR_SQL}, fs AS (SELECT flag, status, count(*) AS n FROM b GROUP BY 1, 2), fl AS (SELECT flag, line, count(*) AS n FROM b GROUP BY 1, 2), f AS (SELECT flag, count(*) AS n FROM b GROUP BY 1)
SELECT line, status, round(sum(fl.n * 1.0 * fs.n / f.n) / (SELECT count(*) FROM b), 6) AS value FROM fs JOIN fl USING (flag) JOIN f USING (flag) WHERE flag <> 'Z' GROUP BY line, status""")
def decomposable_given(spark, d):
    """Two arguments of different cliques, without evidence: the argument between them is summed out."""
    model = models.Decomposable.fit(four(spark, d), [("flag", "status"), ("flag", "line")])
    return r(model.given({}, "line", "status").df, "value")


@query(f"""{FOUR_SQL}, fs AS (SELECT flag, status, count(*) AS n FROM b WHERE status = 'F' GROUP BY 1, 2), fl AS (SELECT flag, line, count(*) AS n FROM b GROUP BY 1, 2), f AS (SELECT flag, count(*) AS n FROM b GROUP BY 1)
SELECT flag, line FROM fs JOIN fl USING (flag) JOIN f USING (flag) ORDER BY fs.n * 1.0 * fl.n / f.n DESC LIMIT 1""")
def decomposable_map(spark, d):
    """The most probable flag and line of a model, given the status."""
    return models.Decomposable.fit(four(spark, d), [("flag", "status"), ("flag", "line")]).map_assignment({"status": "F"}).select("flag", "line")


@query(f"""{FOUR_SQL} SELECT flag, status, round(count(*) / (SELECT count(*) FROM b), 5) AS value, true AS near FROM b GROUP BY flag, status""")
def decomposable_sample(spark, d):
    """Samples of a model, one for each order line, have its clique's shares up to 0.02."""
    rows = four(spark, d)
    ids = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    drawn = models.Decomposable.fit(rows, [("flag", "status"), ("flag", "line")]).sample(ids.select("id"), "id", seed=3)
    share = lambda df, name: df.groupBy("flag", "status").agg(F.count("*").alias(name))
    both = share(rows, "n").join(share(drawn, "m"), ["flag", "status"], "left")
    total = F.lit(rows.count())
    return r(both.select("flag", "status", (F.col("n") / total).alias("value"), (F.abs(F.coalesce("m", F.lit(0)) - F.col("n")) / total < 0.02).alias("near")), "value", places=5)


@query(f"""WITH b AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, CAST(floor(o_totalprice / 100000) AS INT) AS price FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT {_entropy(["price"])} AS x), w AS (
SELECT 'priority' AS a, 'segment' AS b, {_entropy(["priority", "price"])} + {_entropy(["segment", "price"])} - h.x - {_entropy(["priority", "segment", "price"])} AS w FROM h
UNION ALL SELECT 'priority', 'status', {_entropy(["priority", "price"])} + {_entropy(["status", "price"])} - h.x - {_entropy(["priority", "status", "price"])} FROM h
UNION ALL SELECT 'segment', 'status', {_entropy(["segment", "price"])} + {_entropy(["status", "price"])} - h.x - {_entropy(["segment", "status", "price"])} FROM h)
SELECT a, b, round(w, 6) AS weight, row_number() OVER (ORDER BY w DESC) <= 2 AS joined FROM w""")
def conditional_tree(spark, d):
    """Conditional information of the labels of an order given its price, and the tree of largest weight over them."""
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    labels = ["priority", "segment", "status"]
    rows = rows.select(F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"), F.floor(F.col("o_totalprice") / 100000).cast("int").alias("price"))
    weights = conditional_weights(Entropies(rows, [*labels, "price"]), labels, {c: ["price"] for c in labels})
    tree = {frozenset(e) for e in heaviest_tree(weights)}
    return r(spark.createDataFrame([(a, b, w, frozenset((a, b)) in tree) for (a, b), w in weights.items()], "a string, b string, weight double, joined boolean"), "weight")


# A mixture over quantity and discount with a component for each flag.

MIX = """WITH m AS (SELECT l_returnflag AS component, count(*)::DOUBLE AS n, avg(l_quantity) AS mq, avg(l_discount) AS md, var_pop(l_quantity) AS vq, var_pop(l_discount) AS vd, covar_pop(l_quantity, l_discount) AS c FROM lineitem GROUP BY 1),
w AS (SELECT *, n / sum(n) OVER () AS w FROM m),
g AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md, var_pop(l_quantity) AS vq, var_pop(l_discount) AS vd, covar_pop(l_quantity, l_discount) AS c FROM lineitem) """


def flags(spark, d) -> tuple[Mixture, gaussian.Gaussians]:
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("component"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    weights = rows.groupBy("component").agg(F.count("*").alias("n"))
    weights = weights.crossJoin(weights.agg(F.sum("n").alias("all"))).select("component", (F.col("n") / F.col("all")).alias("weight"))
    return Mixture.of(gaussian.estimate(rows, ("component",), ("q", "d")), weights), gaussian.estimate(rows, (), ("q", "d"))


@query(f"""{MIX}, x AS (SELECT component, w * exp(-power(0.05 - md, 2) / (2 * vd)) / sqrt(vd) AS v, mq + c / vd * (0.05 - md) AS mean FROM w) SELECT component, round(v / sum(v) OVER (), 6) AS weight, round(mean, 4) AS mean FROM x""")
def mixture_restrict(spark, d):
    """At one discount: the components' shares and mean quantities."""
    at = flags(spark, d)[0].restrict({"d": 0.05})
    return r(at.weights().join(at.parts.moments().select("component", F.get("mean", F.lit(0)).alias("mean")), "component"), "weight").withColumn("mean", F.round("mean", 4))


@query(f"""{MIX}, s AS (SELECT component, w, w.vq + g.vq AS a, w.c + g.c AS b, w.vd + g.vd AS e, w.mq - g.mq AS x, w.md - g.md AS y FROM w, g), z AS (SELECT component, w * exp(-(e * x * x - 2 * b * x * y + a * y * y) / (2 * (a * e - b * b))) / sqrt(a * e - b * b) AS v FROM s)
SELECT component, round(v / sum(v) OVER (), 6) AS weight FROM z""")
def mixture_times_gaussian(spark, d):
    """The product with the Gaussian of all lines: the components' shares."""
    mixture, whole = flags(spark, d)
    return r((mixture * whole).weights(), "weight")


@query(f"""{MIX}, s AS (SELECT p.component || '*' || o.component AS component, p.w * o.w AS w, p.vq + o.vq AS a, p.c + o.c AS b, p.vd + o.vd AS e, p.mq - o.mq AS x, p.md - o.md AS y FROM w p, w o), z AS (SELECT component, w * exp(-(e * x * x - 2 * b * x * y + a * y * y) / (2 * (a * e - b * b))) / sqrt(a * e - b * b) AS v FROM s)
SELECT component, round(v / sum(v) OVER (), 6) AS weight FROM z""")
def mixture_product(spark, d):
    """The mixture's product with itself: every pair of components."""
    mixture, _ = flags(spark, d)
    return r((mixture * mixture).weights(), "weight")


@query(f"""{MIX} SELECT 2 AS components, round(sum(w * mq), 4) AS mean, round(sum(w * (vq + mq * mq)) - power(sum(w * mq), 2), 4) AS variance FROM w""")
def mixture_pruned(spark, d):
    """Cut to two components, the mixture keeps its mean and variance."""
    small = flags(spark, d)[0].marginal("q").pruned(2)
    one = small.collapsed().moments().select(F.get("mean", F.lit(0)).alias("mean"), F.get("cov", F.lit(0)).alias("variance"))
    return r(one.crossJoin(small.weights().agg(F.count("*").cast("int").alias("components"))), "mean", "variance", places=4)
