"""Queries of junction trees, graphical models, graphs, learning and validation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from semifold.operators import dataset, graph, learning, optimize
from semifold.operators.factor import Factor
from semifold.plans import junction, models
from semifold.plans.propagation import belief_propagation, edge_beliefs
from semifold.plans.registry import CHAIN, DAG, _dag, chain, f_flag, query, r, t

# A model with a loop: segment - priority - status - segment, and the nations that hang on the segment.

LOOP = f"""{CHAIN.rstrip()}, k AS (SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) / 100.0 AS value FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
m AS (SELECT nation, segment, priority, status, x * y * z * k.value AS v FROM j JOIN k USING (segment, status)) """


def loop(spark, d) -> list[Factor]:
    co = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    k = co.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status")).agg((F.count("*") / 100.0).alias("value"))
    return [*chain(spark, d), Factor(k, ("segment", "status"))]


def shares(spark, f: Factor):
    return r(f.normalize().df, "value")


_INFORMATION = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, sum(p * ln(p / (x * y))) AS i FROM (SELECT p, sum(p) OVER (PARTITION BY {a}) AS x, sum(p) OVER (PARTITION BY {b}) AS y FROM (SELECT {a}, {b}, sum(v) / sum(sum(v)) OVER () AS p FROM m GROUP BY {a}, {b})) WHERE p > 0"
    for a, b in (("priority", "segment"), ("priority", "status"), ("segment", "status"))
)


@query(f"{LOOP}, w AS ({_INFORMATION}) SELECT a, b, round(i, 6) AS information, row_number() OVER (ORDER BY i DESC) <= 2 AS joined FROM w")
def thin_projection(spark, d):
    """The tree over three arguments of a model with a loop that keeps most of their information."""
    return r(models.thin_projection(junction.shafer_shenoy(loop(spark, d)), "priority", "segment", "status")[0], "information")


@query(f"{LOOP} SELECT priority, status, round(sum(v) / sum(sum(v)) OVER (), 6) AS value FROM m GROUP BY priority, status")
def junction_tree_beliefs(spark, d):
    return shares(spark, junction.shafer_shenoy(loop(spark, d)).belief("priority", "status"))


@query(f"{LOOP} SELECT nation, status, round(sum(v) / sum(sum(v)) OVER (), 6) AS value FROM m GROUP BY nation, status")
def junction_tree_joined_belief(spark, d):
    """A belief over arguments of two cliques."""
    return shares(spark, junction.shafer_shenoy(loop(spark, d)).belief("nation", "status"))


@query(f"{LOOP} SELECT nation, round(sum(v) / sum(sum(v)) OVER (), 6) AS value FROM m WHERE status = 'F' AND priority = '1-URGENT' GROUP BY nation")
def junction_tree_evidence(spark, d):
    return shares(spark, junction.shafer_shenoy(loop(spark, d), evidence={"status": "F", "priority": "1-URGENT"}).belief("nation"))


@query(f"{LOOP} SELECT segment, round(sum(v) / sum(sum(v)) OVER (), 6) AS value FROM m GROUP BY segment")
def hugin_beliefs(spark, d):
    return shares(spark, junction.hugin(loop(spark, d)).belief("segment"))


@query("SELECT * FROM (VALUES ('clique', 'nation,segment', 2), ('clique', 'priority,segment,status', 3), ('separator', 'segment', 1), ('intersection', 'holds', 1), ('width', 'tree', 2)) v(kind, name, size)")
def junction_tree_structure(spark, d):
    tree = junction.JunctionTree.build([f.args for f in loop(spark, d)])
    rows = [("clique", ",".join(sorted(c)), len(c)) for c in tree.cliques] + [("separator", ",".join(sorted(tree.separator(i, j))), len(tree.separator(i, j))) for i, j in tree.edges]
    rows += [("intersection", "holds", int(tree.running_intersection())), ("width", "tree", tree.width())]
    return spark.createDataFrame(rows, "kind string, name string, size int")


@query(f"{LOOP} SELECT nation, segment, priority, status FROM m ORDER BY v DESC LIMIT 1")
def map_by_elimination(spark, d):
    return models.max_product_assignment(loop(spark, d)).select("nation", "segment", "priority", "status")


@query(f"{LOOP}, z AS (SELECT ln(sum(v)) AS z FROM m), o AS (SELECT nation, segment, priority, status, v FROM m ORDER BY status, priority, segment, nation LIMIT 50) SELECT round(sum(ln(v)) - 50 * max(z), 4) AS value FROM o, z")
def factor_graph_log_likelihood(spark, d):
    g = models.FactorGraph(loop(spark, d)).simplify()
    rows, *others = loop(spark, d)
    rows = rows.df.drop("value")
    for f in others:
        rows = rows.join(f.df.drop("value"), [a for a in f.args if a in rows.columns])
    return r(g.log_likelihood(rows.orderBy("status", "priority", "segment", "nation").limit(50)), "value", places=4)


# A Bayesian network over line items: flag -> status, flag -> line.

NET = """WITH li AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line FROM lineitem),
f AS (SELECT flag, count(*) / sum(count(*)) OVER () AS p FROM li GROUP BY flag),
s AS (SELECT flag, status, count(*) / sum(count(*)) OVER (PARTITION BY flag) AS p FROM li GROUP BY 1, 2),
n AS (SELECT flag, line, count(*) / sum(count(*)) OVER (PARTITION BY flag) AS p FROM li GROUP BY 1, 2) """


def items(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"))


def net(spark, d) -> models.BayesianNetwork:
    return models.BayesianNetwork.fit(items(spark, d), {"flag": (), "status": ("flag",), "line": ("flag",)})


@query(f"{NET} SELECT round(sum(ln(f.p) + ln(s.p) + ln(n.p)), 3) AS value FROM li JOIN f USING (flag) JOIN s USING (flag, status) JOIN n USING (flag, line)")
def bayes_net_log_likelihood(spark, d):
    return r(net(spark, d).log_likelihood(items(spark, d)), "value", places=3)


@query(f"{NET} SELECT flag, round(sum(f.p * s.p * n.p) / sum(sum(f.p * s.p * n.p)) OVER (), 6) AS value FROM f JOIN s USING (flag) JOIN n USING (flag) WHERE status = 'F' AND line = 2 GROUP BY flag")
def bayes_net_posterior(spark, d):
    return r(net(spark, d).condition({"status": "F", "line": 2}, "flag").df, "value")


DRAWN = """u AS (SELECT s_suppkey AS id, CAST(CAST('0x' || substr(md5('3|flag|' || s_suppkey), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS uf, CAST(CAST('0x' || substr(md5('3|status|' || s_suppkey), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS us FROM supplier),
cf AS (SELECT flag, sum(p) OVER (ORDER BY flag) - p AS lo, CASE WHEN flag = max(flag) OVER () THEN 2 ELSE sum(p) OVER (ORDER BY flag) END AS hi FROM f),
cs AS (SELECT flag, status, sum(p) OVER (PARTITION BY flag ORDER BY status) - p AS lo, CASE WHEN status = max(status) OVER (PARTITION BY flag) THEN 2 ELSE sum(p) OVER (PARTITION BY flag ORDER BY status) END AS hi FROM s)"""


@query(f"{NET}, {DRAWN} SELECT id, cf.flag, cs.status FROM u JOIN cf ON cf.lo <= uf AND uf < cf.hi JOIN cs ON cs.flag = cf.flag AND cs.lo <= us AND us < cs.hi")
def bayes_net_sample(spark, d):
    """A sample for each supplier; digests of the keys are the random numbers, so SQL draws the same."""
    n = net(spark, d)
    small = models.BayesianNetwork({v: n.parents[v] for v in ("flag", "status")}, {v: n.factors[v] for v in ("flag", "status")})
    return small.sample(t(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", seed=3).select("id", "flag", "status")


@query("SELECT * FROM (VALUES ('status', 'line', '', false), ('status', 'line', 'flag', true), ('a', 'c', '', true), ('a', 'c', 'd', false)) v(a, b, given, separated)")
def d_separation(spark, d):
    """A fork given its root, and a collider given what follows it, by the network's own test and by tables."""
    fork = net(spark, d)
    collider = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "d")], "src string, dst string")
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    tables = [graph.separated(collider, one("a"), one("c"), g).select(F.lit("a").alias("a"), F.lit("c").alias("b"), F.lit(name).alias("given"), F.col("value").alias("separated")) for g, name in ((one("a").limit(0), ""), (one("d"), "d"))]
    own = [("status", "line", "", fork.separated({"status"}, {"line"}, set())), ("status", "line", "flag", fork.separated({"status"}, {"line"}, {"flag"}))]
    return spark.createDataFrame(own, "a string, b string, given string, separated boolean").unionByName(tables[0]).unionByName(tables[1])


@query(f"{NET}, h AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM li GROUP BY flag, status) UNION ALL SELECT -sum(p * ln(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM li GROUP BY flag, line) UNION ALL SELECT sum(p * ln(p)) FROM f) SELECT round(sum(h), 6) AS value FROM h")
def decomposable_entropy(spark, d):
    return r(models.Decomposable.fit(items(spark, d), [("flag", "status"), ("flag", "line")]).entropy(), "value")


@query(f"{NET} SELECT status, line, round(sum(f.p * s.p * n.p), 6) AS value FROM f JOIN s USING (flag) JOIN n USING (flag) GROUP BY status, line")
def decomposable_marginal(spark, d):
    return r(models.Decomposable.fit(items(spark, d), [("flag", "status"), ("flag", "line")]).marginal("status", "line").df, "value")


@query(f"{NET} SELECT round(sum(ln(f.p) + ln(s.p) + ln(n.p)), 3) AS value FROM li JOIN f USING (flag) JOIN s USING (flag, status) JOIN n USING (flag, line)")
def decomposable_log_likelihood(spark, d):
    return r(models.Decomposable.fit(items(spark, d), [("flag", "status"), ("flag", "line")]).log_likelihood(items(spark, d)), "value", places=3)


# Belief propagation on a tree of whole tables: customers hang on their nations, nations on their regions.

TREE = """WITH w AS (SELECT CAST(x AS INT) AS s FROM range(2) v(x)), cm AS (SELECT c_nationkey AS n, s.s, sum(ln((1 + (s.s = 0)::INT) * 1.0 + (1 + (s.s = 1)::INT) * exp(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE -0.1 END))) AS l FROM customer, w s GROUP BY 1, 2),
nl AS (SELECT n_nationkey AS n, n_regionkey AS reg, w.s, coalesce(cm.l, 0) AS l FROM nation CROSS JOIN w LEFT JOIN cm ON cm.n = n_nationkey AND cm.s = w.s),
top AS (SELECT n, max(l) AS m FROM nl GROUP BY n), nm AS (SELECT nl.reg, a.s, nl.n, ln(sum((1 + (a.s = nl.s)::INT) * exp(nl.l - top.m))) + max(top.m) AS l FROM nl JOIN top USING (n), w a GROUP BY 1, 2, 3),
rl AS (SELECT reg, s, sum(l) AS l FROM nm GROUP BY 1, 2) """


def tree(spark, d):
    """Nodes (v, s, value) and edges: customers, nations and regions; a neighbour in the same state counts twice."""
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    state = F.explode(F.array(F.lit(0), F.lit(1))).alias("s")
    own = F.when(F.col("s") == 1, F.exp(F.when(F.col("c_acctbal") < 0, 1.0).otherwise(-0.1))).otherwise(1.0)
    nodes = c.select(name("c", "c_custkey").alias("v"), state, "c_acctbal").select("v", "s", own.alias("value"))
    for kind, key in (("n", "n_nationkey"), ("r", "n_regionkey")):
        nodes = nodes.unionByName(n.select(name(kind, key).alias("v")).distinct().select("v", state).withColumn("value", F.lit(1.0)))
    e = c.select(name("c", "c_custkey").alias("u"), name("n", "c_nationkey").alias("v")).unionByName(n.select(name("n", "n_nationkey").alias("u"), name("r", "n_regionkey").alias("v")))
    two = lambda x: F.explode(F.array(F.lit(0), F.lit(1))).alias(x)
    edges = e.select("u", "v", two("su")).select("u", "v", "su", two("sv")).withColumn("value", F.when(F.col("su") == F.col("sv"), 2.0).otherwise(1.0))
    return nodes, edges


@query(f"{TREE} SELECT 'r' || reg AS v, s, round(exp(l - mx) / sum(exp(l - mx)) OVER (PARTITION BY reg), 5) AS belief FROM (SELECT *, max(l) OVER (PARTITION BY reg) AS mx FROM rl)")
def tree_beliefs_of_regions(spark, d):
    """Exact on a tree: customers' messages reach the regions in two rounds, and all beliefs are final after four."""
    b = belief_propagation(*tree(spark, d), rounds=6, tolerance=1e-12)
    return r(b.where(F.col("v").startswith("r")), "belief", places=5)


REGIONS = f"{TREE} SELECT 'r' || reg AS v, s, round(exp(l - mx) / sum(exp(l - mx)) OVER (PARTITION BY reg), 5) AS belief FROM (SELECT *, max(l) OVER (PARTITION BY reg) AS mx FROM rl)"


@query(REGIONS)
def residual_beliefs_of_regions(spark, d):
    """Only the messages that would move by a tenth of the largest move are sent in a round."""
    b = belief_propagation(*tree(spark, d), rounds=12, tolerance=1e-12, share=0.1)
    return r(b.where(F.col("v").startswith("r")), "belief", places=5)


@query(REGIONS)
def asynchronous_beliefs_of_regions(spark, d):
    """Each message sits out a round with odds of a quarter."""
    b = belief_propagation(*tree(spark, d), rounds=20, tolerance=-1.0, skip=0.25)
    return r(b.where(F.col("v").startswith("r")), "belief", places=5)


@query(f"{TREE}, e AS (SELECT nl.n, nl.reg, a.s AS sr, nl.s AS sn, nl.l + ln(1 + (a.s = nl.s)::INT) + rl.l - nm.l AS l FROM nl CROSS JOIN w a JOIN rl ON rl.reg = nl.reg AND rl.s = a.s JOIN nm ON nm.n = nl.n AND nm.s = a.s), x AS (SELECT *, max(l) OVER (PARTITION BY n) AS mx FROM e) SELECT 'n' || n AS u, 'r' || reg AS v, sn AS su, sr AS sv, round(exp(l - mx) / sum(exp(l - mx)) OVER (PARTITION BY n), 5) AS belief FROM x")
def tree_beliefs_of_edges(spark, d):
    b = edge_beliefs(*tree(spark, d), rounds=6, tolerance=1e-12)
    return r(b.where(F.col("v").startswith("r")), "belief", places=5)


# Graphs.


@query(f"WITH {DAG}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT 'connected' AS name, true AS value UNION ALL SELECT 'tree', count(*) = (SELECT count(*) FROM v) - 1 FROM e UNION ALL SELECT 'cyclic', false UNION ALL SELECT 'cyclic with a back edge', true")
def graph_tests(spark, d):
    g = _dag(spark, d)
    back = g.unionByName(g.agg(F.max("dst").alias("src"), F.min("src").alias("dst")))
    say = lambda name, df: df.select(F.lit(name).alias("name"), "value")
    flag = lambda name, v: spark.range(1).select(F.lit(name).alias("name"), F.lit(v).alias("value"))
    return say("connected", graph.is_connected(g)).unionByName(say("tree", graph.is_tree(g))).unionByName(flag("cyclic", graph.is_cyclic(g))).unionByName(flag("cyclic with a back edge", graph.is_cyclic(back)))


@query(f"WITH {DAG} SELECT src, dst FROM e WHERE src % 2 = 1 AND dst % 2 = 1")
def graph_induced(spark, d):
    odd = t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id")).unionByName(spark.range(2)).where("id % 2 = 1")
    return graph.induced(_dag(spark, d), odd)


@query(f"WITH {DAG} SELECT CAST(12 AS BIGINT) AS id, dst AS neighbour FROM e WHERE src = 12 UNION SELECT 12, src FROM e WHERE dst = 12")
def graph_neighbours(spark, d):
    return graph.neighbours(_dag(spark, d), spark.range(12, 13))


@query("WITH RECURSIVE e AS (SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS src, CAST(p_partkey AS BIGINT) AS dst FROM part WHERE p_partkey > 1), o(id, parent, depth) AS (SELECT CAST(1 AS BIGINT), CAST(NULL AS BIGINT), 0 UNION ALL SELECT e.dst, e.src, depth + 1 FROM e JOIN o ON e.src = o.id) SELECT id, parent, depth FROM o")
def graph_tree_order(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("dst")).where("dst > 1")
    return graph.tree_order(p.select(F.floor(F.col("dst") / 2).alias("src"), "dst"), spark.range(1, 2))


SETS = "WITH s AS (SELECT DISTINCT l_orderkey AS set_id, l_linenumber AS element FROM lineitem), h AS (SELECT set_id, count(*) AS n, count(*) FILTER (element IN (2, 4)) AS overlap FROM s GROUP BY 1)"


@query(f"{SETS} (SELECT 'cover' AS kind, set_id, n FROM h WHERE overlap = 2 ORDER BY n, set_id LIMIT 1) UNION ALL (SELECT 'meets', set_id, overlap FROM h WHERE overlap > 0 ORDER BY overlap DESC, set_id LIMIT 1)")
def set_index_best(spark, d):
    s = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("element"))
    q = spark.range(1, 3).select((F.col("id") * 2).cast("int").alias("element"))
    a, b = graph.set_cover_least(s, q).withColumn("kind", F.lit("cover")), graph.set_meets_most(s, q).withColumnRenamed("overlap", "n").withColumn("kind", F.lit("meets"))
    return a.unionByName(b)


@query("WITH s AS (SELECT DISTINCT l_suppkey AS r, l_linenumber AS v FROM lineitem) SELECT 'factor' AS kind, CAST(r AS VARCHAR) AS region, CAST(1 AS BIGINT) AS number FROM s GROUP BY r UNION ALL SELECT 'variable', CAST(v AS VARCHAR), 1 - count(*) FROM s GROUP BY v")
def bethe_counting_numbers(spark, d):
    return graph.counting_numbers(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("region"), F.col("l_linenumber").alias("variable")))


@query("SELECT part, count(*) AS n FROM (SELECT CAST(floor((row_number() OVER () - 1) * 4 / count(*) OVER ()) AS INT) AS part FROM (SELECT DISTINCT floor(p_partkey / 2) AS id FROM part WHERE p_partkey > 1 UNION SELECT p_partkey FROM part WHERE p_partkey > 1)) GROUP BY part")
def graph_balanced_parts(spark, d):
    return graph.balanced_parts(_dag(spark, d), 4).groupBy("part").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(DISTINCT c_nationkey) FROM customer) AS n) SELECT p::INT AS part, ceil((p + 1) * n / 4.0)::BIGINT - ceil(p * n / 4.0)::BIGINT AS n, true AS smaller FROM c, range(4) r(p)")
def graph_refined_parts(spark, d):
    """Orders, customers and nations cut into four runs of one size, and refined: sizes stay, the cut falls by two fifths."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    edges = o.select((F.col("o_orderkey") * 3).alias("src"), (F.col("o_custkey") * 3 + 1).alias("dst"))
    edges = edges.unionByName(c.select((F.col("c_custkey") * 3 + 1).alias("src"), (F.col("c_nationkey").cast("long") * 3 + 2).alias("dst")))
    before = graph.balanced_parts(edges, 4)
    after = graph.refined_parts(edges, before, rounds=8)
    cuts = graph.cut_size(edges, before).select(F.col("value").alias("b")).crossJoin(graph.cut_size(edges, after).select(F.col("value").alias("a")))
    return after.groupBy("part").agg(F.count("*").alias("n")).crossJoin(cuts.select((5 * F.col("a") < 3 * F.col("b")).alias("smaller")))


# Learning and validation.


@query("""WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2), j AS (SELECT s, p, n, ln(n / sum(n) OVER ()) AS l, ln(n / sum(n) OVER (PARTITION BY p)) AS cl, row_number() OVER (PARTITION BY p ORDER BY n DESC, s) AS k FROM c)
SELECT round(sum(n * l), 4) AS log_likelihood, round(sum(n * cl), 4) AS conditional, round(sum(n) FILTER (k = 1) / sum(n), 6) AS accuracy FROM j""")
def naive_bayes_likelihoods(spark, d):
    o = t(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    m = learning.NaiveBayes.fit(o, "o_orderstatus", ["o_orderpriority"])
    return r(r(m.likelihoods(o), "log_likelihood", "conditional", places=4), "accuracy")


@query("""WITH li AS (SELECT l_returnflag AS f, l_linenumber AS l, count(*) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT f, l, n, CASE f WHEN 'A' THEN 0.8 WHEN 'N' THEN 0.5 ELSE 0.3 END AS w FROM li), c AS (SELECT 0 AS class, f, l, n * w AS w FROM e UNION ALL SELECT 1, f, l, n * (1 - w) FROM e), z AS (SELECT class, sum(w) AS t FROM c GROUP BY 1)
SELECT class, 'f' AS feature, f AS value, round(sum(w) / max(t), 6) AS probability FROM c JOIN z USING (class) GROUP BY class, f UNION ALL SELECT class, 'l', CAST(l AS VARCHAR), round(sum(w) / max(t), 6) FROM c JOIN z USING (class) GROUP BY class, l UNION ALL SELECT class, '', '', round(t / sum(t) OVER (), 6) FROM z""")
def naive_bayes_em_round(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("l"))
    return r(learning.naive_bayes_em(li, ["f", "l"], {"A": [0.8, 0.2], "N": [0.5, 0.5], "R": [0.3, 0.7]}, 1), "probability")


@query("SELECT round(avg(l_quantity), 4) AS mean_q, round(avg(l_tax * 100), 4) AS mean_t, round(var_pop(l_quantity), 3) AS var_q, round(covar_pop(l_quantity, l_tax * 100), 3) AS cov FROM lineitem")
def mixture_em_keeps_moments(spark, d):
    """After any round of EM the mixture's mean and covariance are those of the data."""
    li = t(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_tax") * 100).alias("x"))
    parts = learning.mixture_em(li, ["q", "x"], [[10.0, 2.0], [25.0, 4.0], [40.0, 6.0]], 4)
    m = sum(p["weight"] * p["mean"] for p in parts)
    c = sum(p["weight"] * (p["cov"] + np.outer(p["mean"], p["mean"])) for p in parts) - np.outer(m, m)
    return spark.range(1).select(*(F.lit(round(float(v), k)).alias(n) for n, v, k in (("mean_q", m[0], 4), ("mean_t", m[1], 4), ("var_q", c[0, 0], 3), ("cov", c[0, 1], 3))))


E_STEP = "SELECT value AS x, 0.5 * exp(-power(value - 50, 2) / (2 * v)) / (0.5 * exp(-power(value - 50, 2) / (2 * v)) + 0.5 * exp(-power(value - 300, 2) / (2 * v))) AS w FROM events, (SELECT var_pop(value) AS v FROM events)"


@query(f"WITH e AS ({E_STEP}) SELECT round(avg(w), 5) AS weight, round(sum(w * x) / sum(w), 4) AS mean, round(sqrt(sum(w * x * x) / sum(w) - power(sum(w * x) / sum(w), 2)), 4) AS sd FROM e")
def mixture_em_round(spark, d):
    p = learning.mixture_em(t(spark, d, "events"), ["value"], [[50.0], [300.0]], 1)[0]
    return spark.range(1).select(F.lit(round(p["weight"], 5)).alias("weight"), F.lit(round(float(p["mean"][0]), 4)).alias("mean"), F.lit(round(float(np.sqrt(p["cov"][0, 0])), 4)).alias("sd"))


def flags(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("x"))


@query("SELECT flag, round(count(*) / 10.0) AS rows, round(sum(q) / 10) AS q, round(sum(x) / 10) AS x FROM (SELECT l_returnflag AS flag, l_quantity / 50 AS q, l_discount * 10 AS x FROM lineitem) GROUP BY flag")
def multiclass_logistic_optimum(spark, d):
    """At the optimum the predicted sums of each class equal the observed ones, for the intercept and every feature."""
    df = flags(spark, d)
    classes, b = learning.multiclass_logistic(df, ["q", "x"], "flag", options=optimize.Options(tolerance=1e-7))
    score = F.array(*(F.lit(float(row[0])) + float(row[1]) * F.col("q") + float(row[2]) * F.col("x") for row in b))
    p = df.withColumn("_e", F.transform(score, F.exp)).withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda s, v: s + v))
    each = p.select("q", "x", "_z", F.posexplode("_e").alias("k", "e")).withColumn("w", F.col("e") / F.col("_z"))
    sums = each.groupBy("k").agg(F.round(F.sum("w") / 10).alias("rows"), F.round(F.sum(F.col("w") * F.col("q")) / 10).alias("q"), F.round(F.sum(F.col("w") * F.col("x")) / 10).alias("x"))
    return sums.select(F.get(F.array(*map(F.lit, classes)), F.col("k")).alias("flag"), "rows", "q", "x")


@query("SELECT round(sum(y) / 10) AS y, round(sum(y * q) / 10) AS q, round(sum(y * x) / 10) AS x FROM (SELECT CAST(l_returnflag = 'R' AS INT) AS y, l_quantity / 50 AS q, l_discount * 10 AS x FROM lineitem)")
def logistic_regression_optimum(spark, d):
    df = flags(spark, d).withColumn("y", (F.col("flag") == "R").cast("double"))
    b = learning.logistic_regression(df, ["q", "x"], "y", l2=0.0)
    p = 1 / (1 + F.exp(-learning.linear_prediction(b)))
    return df.agg(F.round(F.sum(p) / 10).alias("y"), F.round(F.sum(p * F.col("q")) / 10).alias("q"), F.round(F.sum(p * F.col("x")) / 10).alias("x"))


@query("SELECT m AS method, round(regr_intercept(l_extendedprice, l_quantity), 0) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 0) AS slope FROM lineitem, (VALUES ('fista'), ('gradient'), ('conjugate'), ('lbfgs')) v(m) GROUP BY m")
def linear_regression_methods(spark, d):
    """The same least squares by each minimiser, over standardised features."""
    li = t(spark, d, "lineitem")
    out = [("fista", *learning.penalised_regression(li, ["l_quantity"], "l_extendedprice").values())]
    s = li.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"), F.avg("l_extendedprice").alias("y"), F.covar_pop("l_quantity", "l_extendedprice").alias("c")).first()

    def objective(b):  # mean square over two of y - b0 - b1 z, up to a constant, from sufficient statistics
        return 0.5 * (b[0] ** 2 + b[1] ** 2) - b[0] * s["y"] - b[1] * s["c"] / s["s"], np.array([b[0] - s["y"], b[1] - s["c"] / s["s"]])

    for method in ("gradient", "conjugate", "lbfgs"):
        b = optimize.minimise(objective, np.zeros(2), method)
        out.append((method, float(b[0] - b[1] * s["m"] / s["s"]), float(b[1] / s["s"])))
    return spark.createDataFrame([(m, round(a, 0), round(b, 0)) for m, a, b in out], "method string, intercept double, slope double")


@query(f"WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step FROM events), i AS (SELECT event_type AS s, count(*) / sum(count(*)) OVER () AS p FROM e WHERE step = 0 GROUP BY 1), x AS (SELECT a.event_type AS c, b.event_type AS n, count(*) AS k FROM e a JOIN e b ON a.user_id = b.user_id AND b.step = a.step + 1 GROUP BY 1, 2), y AS (SELECT k, k / sum(k) OVER (PARTITION BY c) AS p FROM x) SELECT round((SELECT sum(ln(p)) FROM e JOIN i ON s = event_type WHERE step = 0) + (SELECT sum(k * ln(p)) FROM y), 3) AS value")
def markov_log_likelihood(spark, d):
    e = t(spark, d, "events")
    initial, step = learning.markov_chain(e, "user_id", "ts", "event_type")
    return r(learning.markov_log_likelihood(e, "user_id", "ts", "event_type", initial, step), "value", places=3)


@query("WITH c AS (SELECT p_brand, p_type, p_retailprice AS w FROM part) SELECT 'p_brand' AS of, p_brand AS value, round(sum(w) / sum(sum(w)) OVER (), 5) AS share FROM c GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, round(sum(w) / sum(sum(w)) OVER (), 5) FROM c GROUP BY p_type")
def proportional_fitting_to_marginals(spark, d):
    """Counts fitted to the marginals by price: at the end both marginals are the targets."""
    p = t(spark, d, "part")
    counts = Factor(p.groupBy("p_brand", "p_type").agg(F.count("*").alias("value")), ("p_brand", "p_type")).normalize()
    priced = Factor(p.groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("value")), ("p_brand", "p_type")).normalize()
    fitted = learning.proportional_fitting(counts, [priced.marginal("p_brand"), priced.marginal("p_type")], 20, 1e-7)
    parts = [fitted.marginal(a).df.select(F.lit(a).alias("of"), F.col(a).alias("value"), F.round("value", 5).alias("share")) for a in ("p_brand", "p_type")]
    return parts[0].unionByName(parts[1])


PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y FROM lineitem" for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_returnflag", "l_tax"), ("l_linestatus", "l_linenumber"), ("l_linestatus", "l_tax"), ("l_linenumber", "l_tax")))


@query(f"""WITH c AS ({PAIRS}), n AS (SELECT a, b, x, y, count(*) AS n FROM c GROUP BY ALL), w AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a, b) AS t, sum(n) OVER (PARTITION BY a, b, x) AS nx, sum(n) OVER (PARTITION BY a, b, y) AS ny FROM n),
m AS (SELECT a, b, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM w GROUP BY a, b), k AS (SELECT e.a AS a1, e.b AS b1, f.a AS a2, f.b AS b2, g.a AS a3, g.b AS b3, e.mi + f.mi + g.mi AS s FROM m e JOIN m f ON (e.a, e.b) < (f.a, f.b) JOIN m g ON (f.a, f.b) < (g.a, g.b) WHERE len(list_distinct([e.a, e.b, f.a, f.b, g.a, g.b])) = 4 ORDER BY s DESC LIMIT 1)
SELECT a AS src, b AS dst, round(mi, 6) AS mi FROM m, k WHERE (a, b) IN ((a1, b1), (a2, b2), (a3, b3))""")
def chow_liu_best_tree(spark, d):
    """SQL tries all sixteen trees over four columns: three edges that touch all four."""
    return r(learning.chow_liu(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax"]), "mi")


@query("WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events), f AS (SELECT *, CAST(floor(((k + 1) * 4 - 1) / n) AS INT) AS fold FROM e), s AS (SELECT shrink, fold, (SELECT avg(value) FROM f g WHERE g.fold <> x.fold) * shrink AS guess FROM (SELECT DISTINCT fold FROM f) x, (VALUES (0.5), (0.75), (1.0), (1.25), (1.5)) v(shrink)) SELECT CAST(shrink AS DOUBLE) AS shrink, round(avg(score), 3) AS mean, round(stddev_pop(score), 3) AS dev FROM (SELECT shrink, s.fold, -avg(power(value - guess, 2)) AS score FROM s JOIN f ON s.fold = f.fold GROUP BY 1, 2) GROUP BY shrink")
def cross_validation(spark, d):
    """How far to shrink a mean, by the held-out square error."""
    e = t(spark, d, "events").select("event_id", "value")
    f = dataset.kfold(dataset.with_row_index(e, "event_id"), 4, e.count())
    fit = lambda rows, shrink: rows.agg(F.avg("value")).first()[0] * shrink
    score = lambda guess, rows: rows.agg((-F.avg((F.col("value") - guess) ** 2)).alias("value"))
    found = learning.cross_validated(f, 4, learning.grid({"shrink": (0.5, 1.5)}, 5), fit, score)
    return r(spark.createDataFrame([(p["shrink"], p["mean"], p["dev"]) for p in found], "shrink double, mean double, dev double"), "mean", "dev", places=3)


@query("SELECT CAST(a AS DOUBLE) AS a, CAST(round(power(10, b), 6) AS DOUBLE) AS b FROM (VALUES (0.0), (0.5), (1.0)) x(a), (VALUES (-2), (-1), (0)) y(b) WHERE false UNION ALL SELECT round(power(10, a), 6), round(power(10, b), 6) FROM (VALUES (-2), (-1), (0)) x(a), (VALUES (-2), (-1), (0)) y(b)")
def parameter_grid(spark, d):
    points = learning.grid({"a": (0.01, 1.0), "b": (0.01, 1.0)}, 3, log=True)
    return r(spark.createDataFrame([(p["a"], p["b"]) for p in points], "a double, b double"), "a", "b")
