"""Gaussian approximations against closed forms, and views of sequences on small tables."""

from __future__ import annotations

import numpy as np
import pytest

from semifold.operators import approximate, dataset
from semifold.operators.gaussian import Gaussians


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_points_are_exact_to_degree_five(d):
    points, weights = approximate.integration_points(d)
    assert len(points) == 2 * d * d + 1 and weights.sum() == pytest.approx(1)
    moment = {0: 1, 1: 0, 2: 1, 3: 0, 4: 3, 5: 0}
    rng = np.random.default_rng(d)
    for _ in range(60):
        powers = np.zeros(d, int)
        for k in rng.integers(0, d, rng.integers(0, 6)):
            powers[k] += 1
        assert weights @ np.prod(points**powers, axis=1) == pytest.approx(np.prod([moment[k] for k in powers]), abs=1e-9)


def test_linear_maps_are_exact_and_give_their_conditional(spark):
    mean, cov = [1.0, -2.0], np.array([[2.0, 0.6], [0.6, 1.0]])
    g = Gaussians.from_moments(spark.createDataFrame([("k", mean, cov.ravel().tolist())], "key string, mean array<double>, cov array<double>"), ("key",), ("x", "y"))
    joint = approximate.transformed(g, lambda p: (3 * p[:, 0] - p[:, 1] + 0.5)[:, None], ("z",))
    r = joint.first()
    a = np.array([[1, 0], [0, 1], [3, -1]])
    assert r["mean"] == pytest.approx([1.0, -2.0, 5.5]) and r["cov"] == pytest.approx((a @ cov @ a.T).ravel().tolist())
    factor = approximate.conditional(joint, ("key",), ("x", "y"), ("z",), 0.25)
    at = spark.createDataFrame([("k", 0.3, 0.7, 1.1)], "key string, x double, y double, z double")
    want = -0.5 * (1.1 - (0.9 - 0.7 + 0.5)) ** 2 / 0.25 - 0.5 * np.log(2 * np.pi * 0.25)
    assert factor.log_value(at).first()["value"] == pytest.approx(want)


def test_mode_and_curvature(spark):
    """A Gaussian's own mode, from afar, and a density that is not concave everywhere."""
    df = spark.createDataFrame([(1, 4.0, -30.0), (2, -1.0, 0.2)], "k int, m double, x double")
    log = lambda x, p: -0.5 * (x[:, 0] - p["m"].to_numpy()) ** 2 / 0.3
    got = {r["k"]: (r["mean"][0], r["cov"][0], r["log_norm"]) for r in approximate.laplace(df, ("k",), ("x",), log, ["m"], ["x"]).collect()}
    assert all(got[k] == pytest.approx((m, 0.3, 0.5 * np.log(2 * np.pi * 0.3)), abs=1e-5) for k, m in ((1, 4.0), (2, -1.0)))
    heavy = approximate.laplace(df, ("k",), ("x",), lambda x, p: -2 * np.log1p((x[:, 0] - p["m"].to_numpy()) ** 2), ["m"], ["x"])
    assert all(r["mean"][0] == pytest.approx({1: 4.0, 2: -1.0}[r["k"]], abs=1e-4) and r["cov"][0] == pytest.approx(0.25, abs=1e-4) for r in heavy.collect())
    with pytest.raises(Exception, match="no curvature"):
        approximate.laplace(df, ("k",), ("x",), lambda x, p: 0 * x[:, 0], ["m"], ["x"]).collect()
    assert approximate.laplace(df.limit(0), ("k",), ("x",), log, ["m"], ["x"]).count() == 0


def test_views_of_sequences(spark):
    df = dataset.numbered_steps(spark.createDataFrame([(s, n, f"{s}{n}") for s in "ab" for n in (3, 1, 2)], "s string, n int, x string"), "s", "n")
    assert sorted((r["s"], r["t"], r["x"]) for r in dataset.sequence_slice(df, "t", 1, 3).collect()) == [("a", 0, "a2"), ("a", 1, "a3"), ("b", 0, "b2"), ("b", 1, "b3")]
    places = {(r["s"], r["place"]) for r in dataset.shuffled_sequences(df, "s", 4).collect()}
    assert {s for s, _ in places} == {"a", "b"} and {p for _, p in places} == {0, 1} and len(places) == 2
    with pytest.raises(Exception, match="there already"):
        dataset.inserted_sequences(df, df, "s").collect()
