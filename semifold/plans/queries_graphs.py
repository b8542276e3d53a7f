"""Queries of factor graphs with factors of any size and of region graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from semifold.plans.factor_graphs import Bethe, cells_of, counting_numbers, generalised_beliefs, pairwise, regions_closed
from semifold.plans.queries_models import LOOP, loop
from semifold.plans.registry import query, r, t

# A tree of whole tables with factors of three: two customers of a nation and the nation; nations hang on their regions.

PAIRS = """WITH w AS (SELECT CAST(x AS INT) AS s FROM range(2) v(x)),
c AS (SELECT c_nationkey AS n, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 2 AS k, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 2 AS side, CASE WHEN c_acctbal < 0 THEN 1.0 ELSE -0.1 END AS l FROM customer),
pr AS (SELECT n, k, max(l) FILTER (side = 0) AS a, max(l) FILTER (side = 1) AS b FROM c GROUP BY n, k),
pm AS (SELECT n, x.s, ln(sum(CASE WHEN b IS NULL THEN (CASE WHEN z.s = 0 THEN (1 + (y.s = x.s)::INT) * exp(a * y.s) ELSE 0 END) ELSE (1 + (y.s = x.s)::INT + (z.s = x.s)::INT) * exp(a * y.s + b * z.s) END)) AS l FROM pr, w x, w y, w z GROUP BY n, k, x.s),
nl AS (SELECT n_nationkey AS n, n_regionkey AS reg, w.s, coalesce(sum(pm.l), 0) AS l FROM nation CROSS JOIN w LEFT JOIN pm ON pm.n = n_nationkey AND pm.s = w.s GROUP BY 1, 2, 3),
top AS (SELECT n, max(l) AS m FROM nl GROUP BY n),
nm AS (SELECT nl.reg, a.s, nl.n, ln(sum((1 + (a.s = nl.s)::INT) * exp(nl.l - top.m))) + max(top.m) AS l FROM nl JOIN top USING (n), w a GROUP BY 1, 2, 3),
rl AS (SELECT reg, s, sum(l) AS l FROM nm GROUP BY 1, 2), rt AS (SELECT *, max(l) OVER (PARTITION BY reg) AS m FROM rl)"""


def pair_cells(spark, d):
    """Factors: (customer, customer, nation), or (customer, nation) where a nation's last customer is alone, a factor of
    each customer alone, and (nation, region)."""
    by = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") < 0, 1.0).otherwise(-0.1).alias("l"), ((F.row_number().over(by) - 1) / 2).cast("long").alias("k"))
    name = lambda kind, key: F.concat(F.lit(kind), F.lpad(F.col(key).cast("string"), 12, "0"))
    states = lambda n: F.explode(F.array(*(F.array(*(F.lit(str(x >> k & 1)) for k in range(n))) for x in range(2**n)))).alias("states")
    alone = c.select(name("own", "c_custkey").alias("f"), F.array(name("c", "c_custkey")).alias("vars"), states(1), "l").withColumn("value", F.exp(F.when(F.get("states", F.lit(0)) == "1", F.col("l")).otherwise(0.0))).drop("l")
    group = c.groupBy("c_nationkey", "k").agg(F.sort_array(F.collect_list(name("c", "c_custkey"))).alias("cs"))  # two at most
    group = group.select(F.concat(F.lit("pair"), F.concat_ws("-", "cs")).alias("f"), F.concat("cs", F.array(name("n", "c_nationkey"))).alias("vars"))
    cells = None
    for size in (2, 3):
        agree = sum((F.get("states", F.lit(k)) == F.get("states", F.lit(size - 1))).cast("int") for k in range(size - 1))
        part = group.where(F.size("vars") == size).select("f", "vars", states(size)).withColumn("value", (1 + agree).cast("double"))
        cells = part if cells is None else cells.unionByName(part)
    regions = t(spark, d, "nation").select(name("to", "n_nationkey").alias("f"), F.array(name("n", "n_nationkey"), name("r", "n_regionkey")).alias("vars"), states(2))
    regions = regions.withColumn("value", F.when(F.get("states", F.lit(0)) == F.get("states", F.lit(1)), 2.0).otherwise(1.0))
    return alone.unionByName(cells).unionByName(regions)


@query(f"{PAIRS} SELECT 'r' || lpad(reg::VARCHAR, 12, '0') AS v, s::VARCHAR AS s, round(exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY reg), 5) AS belief FROM rt")
def factor_graph_beliefs(spark, d):
    """Messages between variables and factors of up to three arguments; the graph is a tree, so beliefs are exact."""
    return r(Bethe(pair_cells(spark, d)).run(12).beliefs().where(F.col("v").startswith("r")), "belief", places=5)


REGION_BELIEFS = "SELECT 'r' || lpad(reg::VARCHAR, 12, '0') AS v, s::VARCHAR AS s, round(exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY reg), 5) AS belief"


@query(f"{PAIRS} {REGION_BELIEFS}, true AS fewer FROM rt")
def splash_beliefs(spark, d):
    """Residual splashes on local trees reach the beliefs of synchronous rounds with fewer messages."""
    together = Bethe(pair_cells(spark, d)).run(12)
    splashed = together.restarted().splash(12, 2)
    b = splashed.beliefs().where(F.col("v").startswith("r")).withColumn("fewer", F.lit(splashed.sent < together.sent))
    return r(b, "belief", places=5)


@query(f"{PAIRS} {REGION_BELIEFS} FROM rt")
def pairwise_conversion_beliefs(spark, d):
    """Factors of three as pairs with a hidden variable: the old variables keep their beliefs."""
    return r(Bethe(pairwise(pair_cells(spark, d))).run(24).beliefs().where(F.col("v").startswith("r")), "belief", places=5)


@query(f"{PAIRS} SELECT round(sum(z), 3) AS value FROM (SELECT max(m) + ln(sum(exp(l - m))) AS z FROM rt GROUP BY reg)")
def factor_graph_log_normaliser(spark, d):
    """The Bethe estimate of the log normaliser, exact on a tree."""
    return r(Bethe(pair_cells(spark, d)).run(12).log_normaliser(), "value", places=3)


@query(f"{LOOP} SELECT priority, status, round(sum(v) / sum(sum(v)) OVER (), 5) AS belief FROM m GROUP BY priority, status")
def region_graph_beliefs(spark, d):
    """Parent-to-child messages on the regions of a model with a loop; its large region holds the loop, so beliefs are exact."""
    base = spark.createDataFrame([(["nation", "segment"],), (["priority", "segment", "status"],)], "vars array<string>")
    b = generalised_beliefs(base, cells_of(spark, loop(spark, d)), rounds=40)
    b = b.where(F.size("vars") == 3).groupBy(F.get("states", F.lit(0)).alias("priority"), F.get("states", F.lit(2)).alias("status")).agg(F.sum("belief").alias("belief"))
    return r(b, "belief", places=5)


@query("""WITH RECURSIVE base AS (SELECT DISTINCT list_sort(list(DISTINCT o_orderpriority)) AS v FROM orders GROUP BY o_custkey),
closed AS (SELECT v, 0 AS k FROM base UNION SELECT list_sort(list_intersect(a.v, b.v)), k + 1 FROM closed a, base b WHERE k < 5 AND len(list_intersect(a.v, b.v)) > 0),
rg AS (SELECT DISTINCT v, len(v) AS n FROM closed), n5 AS (SELECT v, 1 AS c FROM rg WHERE n = 5),
n4 AS (SELECT * FROM n5 UNION ALL SELECT v, 1 - coalesce((SELECT sum(c) FROM n5 WHERE list_has_all(n5.v, rg.v)), 0) FROM rg WHERE n = 4),
n3 AS (SELECT * FROM n4 UNION ALL SELECT v, 1 - coalesce((SELECT sum(c) FROM n4 WHERE list_has_all(n4.v, rg.v)), 0) FROM rg WHERE n = 3),
n2 AS (SELECT * FROM n3 UNION ALL SELECT v, 1 - coalesce((SELECT sum(c) FROM n3 WHERE list_has_all(n3.v, rg.v)), 0) FROM rg WHERE n = 2),
n1 AS (SELECT * FROM n2 UNION ALL SELECT v, 1 - coalesce((SELECT sum(c) FROM n2 WHERE list_has_all(n2.v, rg.v)), 0) FROM rg WHERE n = 1)
SELECT array_to_string(v, ',') AS region, c::BIGINT AS number FROM n1""")
def kikuchi_counting_numbers(spark, d):
    """Regions: the priorities that a customer's orders have, and all intersections of these sets."""
    base = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("vars")).select("vars").distinct()
    return counting_numbers(regions_closed(base)).select(F.concat_ws(",", "vars").alias("region"), "number")
