"""Queries of Gaussian and hybrid factors: quantity and discount of line items by return flag, with closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from semifold.operators import gaussian
from semifold.plans.registry import query, r, t

MOMENTS = """WITH b AS (SELECT l_returnflag AS flag, l_quantity AS q, 100 * l_discount AS d FROM lineitem),
m AS (SELECT flag, count(*) AS n, avg(q) AS mq, avg(d) AS md, var_pop(q) AS vq, var_pop(d) AS vd, covar_pop(q, d) AS c FROM b GROUP BY flag),
l AS (SELECT *, vq * vd - c * c AS det, vd / (vq * vd - c * c) AS lqq, -c / (vq * vd - c * c) AS lqd, vq / (vq * vd - c * c) AS ldd FROM m),
g AS (SELECT *, lqq * mq + lqd * md AS eq, lqd * mq + ldd * md AS ed FROM l) """


def base(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), (100 * F.col("l_discount")).alias("d"))


def joint(spark, d) -> gaussian.Gaussians:
    return gaussian.estimate(base(spark, d), ("flag",), ("q", "d"))


def single(spark, d) -> gaussian.Gaussians:
    """The Gaussian of the quantity over all flags: a factor without keys."""
    return gaussian.estimate(base(spark, d), (), ("q",))


def cells(df, *names):
    return df.select("flag", *(F.round(c, 5).alias(n) for n, c in names))


def item(column, k):
    return F.get(column, F.lit(k))


@query(f"{MOMENTS}, s AS (SELECT avg(q) AS m, var_pop(q) AS v FROM b) SELECT flag, round(eq + m / v, 5) AS eta_q, round(ed, 5) AS eta_d, round(lqq + 1 / v, 5) AS l_qq, round(lqd, 5) AS l_qd, round(ldd, 5) AS l_dd FROM g, s")
def gaussian_product(spark, d):
    p = (joint(spark, d) * single(spark, d)).df
    return cells(p, ("eta_q", item("eta", 0)), ("eta_d", item("eta", 1)), ("l_qq", item("lam", 0)), ("l_qd", item("lam", 1)), ("l_dd", item("lam", 3)))


@query(f"{MOMENTS}, s AS (SELECT avg(q) AS m, var_pop(q) AS v FROM b) SELECT flag, round(eq - m / v, 5) AS eta_q, round(lqq - 1 / v, 5) AS l_qq, round(lqd, 5) AS l_qd FROM g, s")
def gaussian_quotient(spark, d):
    p = (joint(spark, d) / single(spark, d)).df
    return cells(p, ("eta_q", item("eta", 0)), ("l_qq", item("lam", 0)), ("l_qd", item("lam", 1)))


@query(f"{MOMENTS} SELECT flag, round(mq, 5) AS mean, round(vq, 5) AS var, 0.0 AS log_norm FROM g")
def gaussian_marginal(spark, d):
    m = joint(spark, d).marginal("q").moments()
    return cells(m, ("mean", item("mean", 0)), ("var", item("cov", 0)), ("log_norm", F.abs("log_norm")))


@query(f"{MOMENTS} SELECT flag, round(mq, 5) AS mean, round(vq, 5) AS var, round(-0.5 * ln(2 * pi() * vd * (1 - c * c / (vq * vd))), 5) AS log_norm FROM g")
def gaussian_maximum(spark, d):
    """Max-marginal: the marginal's shape, without the integral over the discount."""
    m = joint(spark, d).maximum("q").moments()
    return cells(m, ("mean", item("mean", 0)), ("var", item("cov", 0)), ("log_norm", F.col("log_norm")))


@query(f"{MOMENTS} SELECT flag, round(mq + c / vd * (5 - md), 5) AS mean, round(vq - c * c / vd, 5) AS var, round(-0.5 * ln(2 * pi() * vd) - (5 - md) * (5 - md) / (2 * vd), 5) AS log_norm FROM g")
def gaussian_restrict(spark, d):
    m = joint(spark, d).restrict({"d": 5.0}).moments()
    return cells(m, ("mean", item("mean", 0)), ("var", item("cov", 0)), ("log_norm", F.col("log_norm")))


@query(f"{MOMENTS} SELECT flag, round(lqq, 5) AS l_qq, round(lqd, 5) AS l_qd, round(ldd - 1 / vd, 5) AS l_dd, round(eq, 5) AS eta_q FROM g")
def gaussian_conditional(spark, d):
    """p(q | d): the information of d alone is taken out."""
    p = joint(spark, d).conditional("d").df
    return cells(p, ("l_qq", item("lam", 0)), ("l_qd", item("lam", 1)), ("l_dd", item("lam", 3)), ("eta_q", item("eta", 0)))


@query(f"{MOMENTS} SELECT flag, round(0.5 * ln(power(2 * pi() * exp(1), 2) * det), 5) AS entropy FROM g")
def gaussian_entropy(spark, d):
    return cells(joint(spark, d).moments(), ("entropy", F.col("entropy")))


@query(f"{MOMENTS}, o AS (SELECT avg(q) AS mq, avg(d) AS md, var_pop(q) AS vq, var_pop(d) AS vd, covar_pop(q, d) AS c FROM b) SELECT g.flag, round(0.5 * ((o.vd * g.vq - 2 * o.c * g.c + o.vq * g.vd) / (o.vq * o.vd - o.c * o.c) + (o.vd * power(o.mq - g.mq, 2) - 2 * o.c * (o.mq - g.mq) * (o.md - g.md) + o.vq * power(o.md - g.md, 2)) / (o.vq * o.vd - o.c * o.c) - 2 + ln((o.vq * o.vd - o.c * o.c) / g.det)), 5) AS value FROM g, o")
def gaussian_relative_entropy(spark, d):
    whole = gaussian.estimate(base(spark, d), (), ("q", "d"))
    return cells(joint(spark, d).relative_entropy(whole), ("value", F.col("value")))


@query(f"{MOMENTS} SELECT b.flag, round(avg(-ln(2 * pi()) - 0.5 * ln(det) - 0.5 * (lqq * power(b.q - mq, 2) + 2 * lqd * (b.q - mq) * (b.d - md) + ldd * power(b.d - md, 2))), 5) AS mean_log FROM b JOIN g USING (flag) GROUP BY b.flag")
def gaussian_log_likelihood(spark, d):
    return r(joint(spark, d).log_value(base(spark, d)).groupBy("flag").agg(F.avg("value").alias("mean_log")), "mean_log", places=5)


@query("WITH b AS (SELECT l_quantity AS q, 100 * l_discount AS d FROM lineitem) SELECT round(avg(q), 4) AS mean_q, round(avg(d), 4) AS mean_d, round(var_pop(q), 4) AS var_q, round(covar_pop(q, d), 4) AS cov, round(var_pop(d), 4) AS var_d FROM b")
def mixture_moments(spark, d):
    """A mixture over the flags, matched by one Gaussian: that of all rows."""
    w = base(spark, d).groupBy("flag").agg(F.count("*").cast("double").alias("weight"))
    m = joint(spark, d).mixture(w).moments()
    return m.select(*(F.round(c, 4).alias(n) for n, c in (("mean_q", item("mean", 0)), ("mean_d", item("mean", 1)), ("var_q", item("cov", 0)), ("cov", item("cov", 1)), ("var_d", item("cov", 3)))))


@query(f"{MOMENTS}, p AS (SELECT flag, n / sum(n) OVER () AS w FROM m) SELECT round(sum(w * exp(-0.5 * ln(2 * pi() * vq) - power(20 - mq, 2) / (2 * vq))), 6) AS density FROM g JOIN p USING (flag)")
def hybrid_density(spark, d):
    """A table factor times a Gaussian for each flag, summed over the flags, at one quantity."""
    w = base(spark, d).groupBy("flag").count()
    total = w.agg(F.sum("count").alias("n"))
    at = joint(spark, d).marginal("q").restrict({"q": 20.0}).df.join(w, "flag").crossJoin(total)
    return r(at.agg(F.sum(F.exp("xi") * F.col("count") / F.col("n")).alias("density")), "density")
