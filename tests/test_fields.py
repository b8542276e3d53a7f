"""Conditional random fields against enumeration of all labellings."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from semifold.operators.crf import ChainField, TreeField
from semifold.operators.optimize import Options, gradient_error


@pytest.fixture(scope="module")
def steps(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, int(rng.integers(0, 3)), float(rng.normal())) for s, n in enumerate((7, 1, 5, 2)) for i in range(n)]
    return spark.createDataFrame(rows, "s long, i int, y int, v double").cache()


def plain_chain(rows, w, t):
    """Log-likelihood of all sequences, by enumeration, and the label marginals of each step."""
    sequences: dict = {}
    for r in sorted(rows):
        sequences.setdefault(r["s"], []).append((r["y"], np.array([1.0, r["v"]])))
    total, best = 0.0, []
    for s, seq in sequences.items():
        score = lambda ys, seq=seq: sum(x @ w[:, y] for y, (_, x) in zip(ys, seq, strict=True)) + sum(t[a, b] for a, b in zip(ys, ys[1:], strict=False))
        every = {ys: np.exp(score(ys)) for ys in product(range(3), repeat=len(seq))}
        z = sum(every.values())
        total += score([y for y, _ in seq]) - np.log(z)
        for i in range(len(seq)):
            p = [sum(v for ys, v in every.items() if ys[i] == k) for k in range(3)]
            best.append((s, i, int(np.argmax(p))))
    return total, best


@pytest.mark.parametrize("block", [2, 1024])
def test_chain_equals_enumeration(spark, steps, block):
    chain = ChainField(3, 2, block, np.random.default_rng(1).normal(size=15))
    blocks = chain.store(steps, "s", "i", "y", [F.lit(1.0), F.col("v")])
    total, best = plain_chain(steps.select("s", "i", "y", "v").collect(), *chain.split(chain.theta))
    assert np.isclose(chain.expectations(blocks, chain.theta)[0], total)
    assert sorted((r["seq"], r["step"], r["best"]) for r in chain.decode(blocks).collect()) == best
    assert gradient_error(chain.objective(blocks, l2=0.1), chain.theta) < 1e-6


def test_chain_pseudo_likelihood(spark, steps):
    chain = ChainField(3, 2, 2, np.random.default_rng(1).normal(size=15))
    blocks = chain.store(steps, "s", "i", "y", [F.lit(1.0), F.col("v")])
    whole = ChainField(3, 2, 1024, chain.theta)
    assert np.allclose(chain.pseudo(blocks, chain.theta), whole.pseudo(whole.store(steps, "s", "i", "y", [F.lit(1.0), F.col("v")]), chain.theta))
    assert gradient_error(chain.objective(blocks, l2=0.1, pseudo=True), chain.theta) < 1e-6


def test_chain_learns_what_it_is_drawn_from(spark):
    """Labels that repeat and follow a feature's sign."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(60):
        y = 0
        for i in range(40):
            x = rng.normal()
            p = 1 / (1 + np.exp(-(2 * x + (1.5 if y else -1.5))))
            y = int(rng.random() < p)
            rows.append((s, i, y, float(x)))
    df = spark.createDataFrame(rows, "s long, i int, y int, v double")
    by_feature = np.mean([(x > 0) == y for _, _, y, x in rows])
    for pseudo in (False, True):
        chain = ChainField(2, 2, 16)
        blocks = chain.store(df, "s", "i", "y", [F.lit(1.0), F.col("v")])
        fit = chain.fit(blocks, l2=1e-3, pseudo=pseudo, options=Options(steps=40, tolerance=1e-3))
        w, t = fit.split(fit.theta)
        assert 1.2 < w[1, 1] - w[1, 0] < 3 and t[0, 0] + t[1, 1] - t[0, 1] - t[1, 0] > 1.5
        right = fit.decode(blocks).agg(F.avg((F.col("y") == F.col("best")).cast("double"))).first()[0]
        assert right > by_feature + 0.02  # what the neighbours add


def test_tree_equals_enumeration(spark):
    rng = np.random.default_rng(2)
    sizes, edges = (2, 3, 2, 2), ((0, 1), (0, 2))
    tree = TreeField(sizes, edges, 2)
    tree.theta = rng.normal(size=len(tree.theta))
    rows = [(*(int(rng.integers(0, n)) for n in sizes), float(rng.normal())) for _ in range(9)]
    table = tree.store(spark.createDataFrame(rows, "a int, b int, c int, d int, v double"), list("abcd"), [F.lit(1.0), F.col("v")])
    ws, tables = tree.split(tree.theta)
    total, best = 0.0, []
    for *y, v in rows:
        x = np.array([1.0, v])
        score = lambda ys, x=x: sum(x @ w[:, k] for w, k in zip(ws, ys, strict=True)) + sum(q[ys[a], ys[b]] for q, (a, b) in zip(tables, edges, strict=True))
        every = {ys: score(ys) for ys in product(*map(range, sizes))}
        total += score(y) - np.log(sum(np.exp(s) for s in every.values()))
        best.append((y, list(max(every, key=every.get))))
    assert np.isclose(tree.expectations(table, tree.theta)[0], total)
    assert sorted((r["y"], r["best"]) for r in tree.predict(table).collect()) == sorted(best)
    for pseudo in (False, True):
        assert gradient_error(tree.objective(table, l2=0.05, pseudo=pseudo), tree.theta) < 1e-6
    (r,) = tree.accuracy(table).collect()
    assert np.isclose(r["per_label"], np.mean([a == b for y, z in best for a, b in zip(y, z, strict=True)])) and np.isclose(r["whole"], np.mean([y == z for y, z in best]))


def test_refusals(spark):
    with pytest.raises(ValueError):
        TreeField((2, 2, 2), ((1, 2), (0, 1)), 1)
    with pytest.raises(Exception, match="a label is null"):
        TreeField((2,), (), 1).store(spark.createDataFrame([(None,)], "a int"), ["a"], [F.lit(1.0)])
