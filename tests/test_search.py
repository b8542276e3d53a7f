"""Structure search, decomposable models and mixtures against enumeration in numpy."""

from __future__ import annotations

from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from semifold.operators import graph
from semifold.operators.factor import Factor
from semifold.operators.gaussian import Gaussians
from semifold.operators.mixture import Mixture
from semifold.operators.structure import Entropies, conditional_weights, empty_model, heaviest_tree, hill_climb, leaf_moves, push_moves, star_model, swap_moves
from semifold.plans.junction import shafer_shenoy
from semifold.plans.models import Decomposable, thin_projection

NAMES = list("abcde")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for _ in range(400):
        a = int(rng.integers(0, 3))
        b = int((a + (rng.random() < 0.3)) % 3)
        c = int((a + b + (rng.random() < 0.2)) % 2)
        d = int((c + (rng.random() < 0.25)) % 2)
        out.append((a, b, c, d, int((d + b + (rng.random() < 0.3)) % 2)))
    return out


def entropy(rows, columns):
    n = np.array(list(Counter(tuple(r[NAMES.index(c)] for c in columns) for r in rows).values())) / len(rows)
    return float(-(n * np.log(n)).sum())


def test_entropies_are_counted_once(spark, rows):
    h = Entropies(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in NAMES)), NAMES)
    scopes = [s for k in range(1, 4) for s in combinations(NAMES, k)]
    h.ask(scopes)
    assert h.passes == 1 and all(h[s] == pytest.approx(entropy(rows, s)) for s in scopes) and h.passes == 1


def test_search_finds_the_best_tree_and_moves_stay_valid(spark, rows):
    h = Entropies(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in NAMES)), NAMES)
    trees = []
    for edges in combinations(list(combinations(NAMES, 2)), 4):
        root = {c: c for c in NAMES}

        def top(c, root=root):
            return c if root[c] == c else top(root[c], root)

        for a, b in edges:
            root[top(a)] = top(b)
        if len({top(c) for c in NAMES}) == 1:
            trees.append(-sum(entropy(rows, c) for c in NAMES) + sum(entropy(rows, [a]) + entropy(rows, [b]) - entropy(rows, (a, b)) for a, b in edges))
    for start in (empty_model(NAMES), star_model(NAMES, "e")):
        model, score = hill_climb(h, start, 1)
        assert score == pytest.approx(max(trees)) and model.valid(1)
    wide, better = hill_climb(h, model, 2)
    assert better >= score and wide.valid(2) and max(map(len, wide.cliques())) <= 3
    near = [m for move in (leaf_moves, push_moves, swap_moves) for m in move(wide, 2)]
    assert near and all(m.valid(2) and {c for c, _ in m.steps} == set(NAMES) for m in near)
    small, _ = hill_climb(h, empty_model(NAMES), 2, penalty=10.0)
    assert small.key() == empty_model(NAMES).key()


def test_decomposable_map_and_conditioning(spark, rows):
    model = Decomposable.fit(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in NAMES)), [("a", "b", "c"), ("c", "d"), ("b", "e")])
    n = Counter(rows)
    p = lambda s, x: sum(k for r, k in n.items() if all(r[NAMES.index(c)] == x[c] for c in s)) / len(rows)
    joint = {}
    for v in product(range(3), range(3), range(2), range(2), range(2)):
        x = dict(zip(NAMES, v, strict=True))
        cut = p("c", x) * p("b", x)
        joint[v] = p("abc", x) * p("cd", x) * p("be", x) / cut if cut else 0.0
    best = max((v for v in joint if v[3] == 1), key=joint.get)
    assert model.map_assignment({"d": 1}).select("a", "b", "c", "e").first() == tuple(best[k] for k in (0, 1, 2, 4))
    z = sum(q for v, q in joint.items() if v[3] == 1)
    got = {(r["a"], r["e"]): r["value"] for r in model.given({"d": 1}, "a", "e").df.collect()}
    assert all(got.get((a, e), 0.0) == pytest.approx(sum(q for v, q in joint.items() if v[3] == 1 and v[0] == a and v[4] == e) / z) for a in range(3) for e in range(2))


def mixture(spark, rows):
    df = spark.createDataFrame([(k, c, m, np.array(s).ravel().tolist(), w) for k, c, m, s, w in rows], "k int, component string, mean array<double>, cov array<double>, weight double")
    return Mixture.of(Gaussians.from_moments(df, ("k", "component"), ("x", "y")), df)


def test_mixture_algebra(spark):
    a = [(1, "p", [0.0, 1.0], [[1.0, 0.2], [0.2, 2.0]], 0.7), (1, "q", [2.0, -1.0], [[0.5, 0.0], [0.0, 1.0]], 0.2), (1, "r", [1.0, 1.0], [[2.0, 0.5], [0.5, 1.0]], 0.1), (2, "p", [0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], 2.0)]
    b = [(1, "s", [1.0, 0.0], [[1.5, 0.0], [0.0, 1.0]], 0.5), (1, "t", [0.0, 0.0], [[1.0, -0.3], [-0.3, 1.0]], 0.5), (2, "s", [1.0, 0.0], [[1.5, 0.0], [0.0, 1.0]], 1.0)]
    at = {1: (0.3, -0.4), 2: (1.0, 0.5)}
    points = spark.createDataFrame([(k, *x) for k, x in at.items()], "k int, x double, y double")

    def value(rows, k):
        total = 0.0
        for _, _, m, s, w in (r for r in rows if r[0] == k):
            d, c = np.array(at[k]) - m, np.array(s)
            total += w * np.exp(-0.5 * d @ np.linalg.inv(c) @ d) / (2 * np.pi * np.sqrt(np.linalg.det(c)))
        return total

    p, q = mixture(spark, a), mixture(spark, b)
    got = {r["k"]: r["value"] for r in (p * q).density(points).collect()}
    assert all(got[k] == pytest.approx(np.log(value(a, k) * value(b, k))) for k in (1, 2))
    got = {r["k"]: r["value"] for r in (p + q).density(points).collect()}
    assert all(got[k] == pytest.approx(np.log(value(a, k) + value(b, k))) for k in (1, 2))
    assert {r["k"]: r["value"] for r in p.log_norm().collect()} == {1: pytest.approx(0.0), 2: pytest.approx(np.log(2.0))}
    assert [r["value"] for r in p.normalize().log_norm().collect()] == pytest.approx([0.0, 0.0])
    small = p.pruned(2)
    assert sorted((r["k"], r["component"], round(r["weight"], 9)) for r in small.weights().collect()) == [(1, "p", 0.7), (1, "rest", 0.3), (2, "p", 1.0)]
    whole, cut = (sorted(m.collapsed().moments().select("k", "mean", "cov", F.col("log_norm")).collect()) for m in (p, small))
    for x, y in zip(whole, cut, strict=True):
        assert x["mean"] == pytest.approx(y["mean"]) and x["cov"] == pytest.approx(y["cov"]) and x["log_norm"] == pytest.approx(y["log_norm"])
    with pytest.raises(ValueError):
        Mixture(Gaussians.from_moments(spark.createDataFrame([([0.0], [1.0])], "mean array<double>, cov array<double>"), (), ("x",)))


def test_conditional_weights_find_the_planted_tree(spark):
    """Labels that follow each other along a path, and a feature that makes all of them alike."""
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(4000):
        x = int(rng.integers(0, 2))
        b = int(rng.random() < 0.5)
        a, c = (int(b ^ (rng.random() < 0.15)) for _ in range(2))
        d = int(c ^ (rng.random() < 0.15))
        rows.append((*(v + 2 * x for v in (a, b, c, d)), x))
    h = Entropies(spark.createDataFrame(rows, "a int, b int, c int, d int, x int"), list("abcdx"))
    seen = {c: ["x"] for c in "abcd"}
    for kind in ("information", "influence"):
        assert heaviest_tree(conditional_weights(h, list("abcd"), seen, kind)) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert h.passes == 1
    p = conditional_weights(h, list("abcd"), seen, "piecewise")
    n = Counter((r[0], r[1], r[4]) for r in rows)
    m = Counter(r[4] for r in rows)
    assert p["a", "b"] == pytest.approx(sum(k * np.log(k / m[x]) for (_, _, x), k in n.items()) / len(rows))


def test_refined_parts_separate_cliques(spark):
    edges = [(10 * g + i, 10 * g + j) for g in range(2) for i in range(8) for j in range(i)] + [(0, 10)]
    parts = [(10 * g + i, (g + (i > 4)) % 2) for g in range(2) for i in range(8)]
    e, p = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(parts, "id long, part int")
    after = graph.refined_parts(e, p)
    assert Counter(r["part"] for r in after.collect()) == Counter(k for _, k in parts)
    assert graph.cut_size(e, p).first()[0] > 30 and graph.cut_size(e, after).first()[0] == 1


def test_thin_projection(spark):
    rng = np.random.default_rng(4)
    joint = np.exp(rng.normal(size=(2, 2, 3)))
    joint /= joint.sum()
    cells = [(a, b, c, float(joint[a, b, c])) for a in range(2) for b in range(2) for c in range(3)]
    model = shafer_shenoy([Factor(spark.createDataFrame(cells, "a int, b int, c int, value double"), ("a", "b", "c"))])
    pairs, tree = thin_projection(model, "a", "b", "c")
    told = {(x["a"], x["b"]): (x["information"], x["joined"]) for x in pairs.collect()}
    for (x, y), gone in {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 0}.items():
        p = joint.sum(axis=gone)
        assert told[x, y][0] == pytest.approx(float((p * np.log(p / p.sum(1, keepdims=True) / p.sum(0, keepdims=True))).sum()))
    assert sorted(t for _, t in told.values()) == [False, True, True] and not told[min(told, key=lambda k: told[k][0])][1]
    # The tree's joint: product of the two pairs over the argument between them.
    (u, v), (w, x) = (k for k, t in told.items() if t[1])
    middle = ({u, v} & {w, x}).pop()
    axes = {"a": 0, "b": 1, "c": 2}
    over = lambda keep: joint.sum(axis=tuple(k for n, k in axes.items() if n not in keep), keepdims=True)
    want = over({u, v}) * over({w, x}) / over({middle})
    got = {(r["a"], r["b"], r["c"]): r["value"] for r in tree.joint().df.collect()}
    assert got == pytest.approx({k: float(want[k]) for k in product(range(2), range(2), range(3))})
