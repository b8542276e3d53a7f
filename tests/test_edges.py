"""Engine operators on nulls, empty tables, ties, one key with all rows, and their error paths."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from semifold.functions import scalar
from semifold.operators import dataset, gaussian, graph, learning, optimize, statistics
from semifold.operators.factor import Factor
from semifold.plans import junction, models, registry, sampling


def test_numbers_are_consecutive_with_ties_and_one_key(spark):
    df = spark.range(0, 5000, 1, 8).select((F.col("id") % 3).alias("k"), F.lit("clash").alias("_n"))
    got = [r["row_idx"] for r in dataset.with_row_index(df, "k").collect()]
    assert sorted(got) == list(range(5000))
    assert dataset.with_row_index(df.limit(0), "k").count() == 0
    same = spark.range(900).select(F.lit("a").alias("g"), F.lit(1.0).alias("x"), "id")
    assert sorted(r["rank"] for r in statistics.order_statistics(same, "x", "id", ("g",)).collect()) == list(range(900))
    assert statistics.upper_median(same, "x", ("g",)).collect() == [("a", 1.0)]
    assert statistics.upper_median(same.limit(0), "x", ("g",)).count() == 0


@pytest.mark.parametrize("expression", [lambda: scalar.safe_divide(F.lit(1.0), F.lit(0.0)), lambda: scalar.log(F.lit(-1.0)), lambda: scalar.entropy_term(F.lit(-1.0)), lambda: scalar.log_subtract(F.lit(0.0), F.lit(1.0))])
def test_scalar_errors(spark, expression):
    with pytest.raises(Exception):
        spark.range(1).select(expression()).collect()


def test_factors_that_cannot_be_normalised(spark):
    with pytest.raises(Exception, match="normalised"):
        Factor(spark.createDataFrame([("a", 0.0)], "x string, value double"), ("x",)).normalize().df.collect()


def test_missing_policies(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (None, None)], "a int, b int")
    assert [statistics.missing_policy(df, ["a", "b"], p).count() for p in ("NO", "SKIP")] == [3, 1]
    with pytest.raises(Exception, match="misses"):
        statistics.missing_policy(df, ["a", "b"], "STRICT").count()
    assert statistics.missing_policy(df.where("a is not null or b is null"), ["a", "b"], "STRICT").count() == 1


def test_smoothing_counts_unseen_cells(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] * 2 + [(None, "y")], "p string, q string")
    n = np.array([[3.5, 0.5], [0.5, 2.5]])
    p = n / n.sum()
    want = (p * np.log(p / np.outer(p.sum(1), p.sum(0)))).sum()
    assert statistics.pairwise_information(df, ["p", "q"], smoothing=0.5).first()["mi"] == pytest.approx(want)


def test_junction_tree_of_a_grid(spark):
    """4 x 3 grid: every belief equals that of the full product, before and after evidence, by both schemes."""
    rng = np.random.default_rng(0)
    names = [f"x{i}{j}" for i in range(3) for j in range(3)]
    edges = [(f"x{i}{j}", f"x{i}{j + 1}") for i in range(3) for j in range(2)] + [(f"x{i}{j}", f"x{i + 1}{j}") for i in range(2) for j in range(3)]
    tables = {e: rng.uniform(0.2, 2, (2, 2)) for e in edges}
    tree = junction.JunctionTree.build(edges)
    assert tree.running_intersection() and all(tree.cover(set(e)) is not None for e in edges) and tree.width() == 3
    full = np.ones([2] * 9)
    for (a, b), v in tables.items():
        axes = [names.index(a), names.index(b)]
        shape = [2 if k in axes else 1 for k in range(9)]
        full = full * (v if axes[0] < axes[1] else v.T).reshape(shape)
    factors = [Factor(spark.createDataFrame([(s, t, float(v[s, t])) for s in range(2) for t in range(2)], f"{a} int, {b} int, value double"), (a, b)) for (a, b), v in tables.items()]
    found = junction.shafer_shenoy(factors, evidence={"x11": 1})
    for a in ("x00", "x22"):
        at = np.take(full, 1, axis=names.index("x11")).sum(axis=tuple(k for k, n in enumerate([n for n in names if n != "x11"]) if n != a))
        got = {r[a]: r["value"] for r in found.belief(a).df.collect()}
        assert [got[0], got[1]] == pytest.approx(at.tolist())


def test_d_separation_and_blanket():
    net = models.BayesianNetwork({"a": (), "b": ("a",), "c": ("a",), "d": ("b", "c"), "e": ("d",)}, {})
    assert net.separated({"b"}, {"c"}, {"a"}) and not net.separated({"b"}, {"c"}, {"a", "e"}) and not net.separated({"b"}, {"c"}, set())
    assert net.markov_blanket("b") == {"a", "c", "d"}
    with pytest.raises(ValueError):
        models.BayesianNetwork({"a": ("b",), "b": ("a",)}, {}).order()


def test_spanning_forest_is_kruskals(spark):
    edges = [(r["src"], r["dst"], float((r["src"] * 7919 + r["dst"] * 104729) % 1009)) for r in graph.grid_graph(spark, 5, 6).collect()]
    got = graph.spanning_forest(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()
    root = list(range(30))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    total = 0.0
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if top(a) != top(b):
            root[top(a)] = top(b)
            total += w
    assert len(got) == 29 and sum(r["weight"] for r in got) == total


def test_spanning_forest_of_order_lines_is_kruskals(spark):
    edges = [tuple(r) for r in registry.price_graph(spark, "/root/testdata/sf0.001").select("weight", "src", "dst").collect()]
    root: dict = {x: x for _, a, b in edges for x in (a, b)}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    want = set()
    for w, a, b in sorted(edges):
        if top(a) != top(b):
            root[top(a)] = top(b)
            want.add((w, a, b))
    got = {(r["weight"], r["src"], r["dst"]) for r in registry.QUERIES["graph_spanning_tree"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_colours_differ_along_edges(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 40, (160, 2))] + [(99, k) for k in range(40)]
    nodes = spark.createDataFrame([(k,) for k in [*range(40), 99, 100]], "v long")
    got = {r["v"]: r["colour"] for r in sampling.colours(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len(got) == 42 and all(got[a] != got[b] for a, b in edges if a != b)


@pytest.mark.parametrize("method", ["gradient", "conjugate", "lbfgs"])
def test_minimisers(method):
    a = np.diag([1.0, 4.0, 9.0])
    f = lambda x: (0.5 * x @ a @ x - x.sum(), a @ x - 1)
    x = optimize.minimise(f, np.zeros(3), method, optimize.Options(steps=500))
    assert x == pytest.approx([1, 0.25, 1 / 9], abs=1e-4) and optimize.gradient_error(f, np.array([0.3, -1.0, 2.0])) < 1e-6


def test_mixture_finds_planted_components(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal((-2, 0), 0.4, (300, 2)), rng.normal((2, 2), 0.4, (300, 2))])
    parts = learning.mixture_em(spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double"), ["a", "b"], [[-1.0, 0.0], [1.0, 0.5]], 15)
    assert parts[0]["mean"] == pytest.approx([-2, 0], abs=0.1) and parts[1]["mean"] == pytest.approx([2, 2], abs=0.1)


def test_gaussian_products_and_marginals_agree_with_numpy(spark):
    m, c = [1.0, -2.0, 0.5], np.array([[2.0, 0.3, 0.1], [0.3, 1.0, -0.2], [0.1, -0.2, 0.7]])
    g = gaussian.Gaussians.from_moments(spark.createDataFrame([(m, c.ravel().tolist())], "mean array<double>, cov array<double>"), (), ("x", "y", "z"))
    r = g.marginal("x", "z").moments().first()
    assert r["mean"] == pytest.approx([1.0, 0.5]) and r["cov"] == pytest.approx(c[np.ix_([0, 2], [0, 2])].ravel().tolist()) and r["log_norm"] == pytest.approx(0)
    back = (g.conditional("z") * g.marginal("z")).reorder("x", "y", "z").moments().first()
    assert back["mean"] == pytest.approx(m) and back["cov"] == pytest.approx(c.ravel().tolist())
    assert g.df.limit(0).count() == 0 and gaussian.estimate(spark.createDataFrame([], "k string, x double"), ("k",), ("x",)).df.count() == 0
