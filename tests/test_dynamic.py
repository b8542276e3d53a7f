"""Dynamic networks against enumeration of all slices."""

from __future__ import annotations

import numpy as np
import pytest

from semifold.plans.junction import JunctionTree
from semifold.streaming import dynamic


def random_network():
    rng = np.random.default_rng(6)
    table = lambda *shape: (x := rng.random(shape) + 0.2) / x.sum(axis=-1, keepdims=True)
    return dynamic.DynamicNetwork(
        {"a": 2, "b": 3, "c": 2},
        {"a": ((), table(2)), "b": (("a",), table(2, 3)), "c": (("b",), table(3, 2))},
        {"a": (("a",), table(2, 2)), "b": (("b", "a"), table(3, 2, 3)), "c": (("c", "b"), table(2, 3, 2))},
        {"o": (("c", "a"), table(2, 2, 4)), "q": (("b",), table(3, 2))},
    )


ROWS = [{"o": 1, "q": 0}, {"o": None, "q": 1}, {"o": 3, "q": None}]


def test_one_cluster_is_exact(spark, tmp_path):
    network = random_network()
    want = dynamic.enumerated(network, ROWS)
    rows = [(k, t, r["o"], r["q"]) for k in (7, 8) for t, r in enumerate(ROWS[: 3 if k == 7 else 1])]
    for part in (rows[:2] + rows[3:], rows[2:3]):  # two micro-batches: the state goes on
        spark.createDataFrame(part, "k long, t long, o int, q int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, t long, o int, q int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    df = dynamic.filtered(stream, "k", "t", network, [("a", "b", "c")])
    df.writeStream.format("memory").queryName("dynamic").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start().awaitTermination()
    got = {(r["k"], r["steps"], r["variable"]): r["belief"] for r in spark.table("dynamic").collect()}
    for v, b in want.items():
        assert got[7, 3, v] == pytest.approx(b.tolist())
        assert got[8, 1, v] == pytest.approx(dynamic.enumerated(network, ROWS[:1])[v].tolist())


def test_projection_keeps_the_clusters_marginals():
    rng = np.random.default_rng(1)
    joint = rng.random((2, 3, 2))
    joint /= joint.sum()
    got = dynamic.projected(joint, list("abc"), JunctionTree.build([("a", "b"), ("b", "c")]))
    assert np.allclose(got.sum(axis=2), joint.sum(axis=2)) and np.allclose(got.sum(axis=0), joint.sum(axis=0)) and not np.allclose(got, joint)
    ab, bc, b = joint.sum(axis=2), joint.sum(axis=0), joint.sum(axis=(0, 2))
    assert np.allclose(got, ab[:, :, None] * bc[None] / b[None, :, None])
    assert np.allclose(dynamic.projected(joint, list("abc"), JunctionTree.build([("a",), ("b",), ("c",)])), joint.sum(axis=(1, 2))[:, None, None] * b[None, :, None] * joint.sum(axis=(0, 1))[None, None])


def test_overlapping_clusters_are_nearer_than_single_variables():
    network = random_network()
    want = dynamic.enumerated(network, ROWS)
    far = {}
    for name, clusters in (("single", [("a",), ("b",), ("c",)]), ("pairs", [("a", "b"), ("b", "c")])):
        tree, joint = JunctionTree.build(clusters), None
        for row in ROWS:
            joint = network.observed(network.first() if joint is None else network.advanced(joint), row)
            joint = dynamic.projected(joint, list("abc"), tree)
        far[name] = sum(np.abs(joint.sum(axis=tuple(a for a in range(3) if a != i)) - want[v]).max() for i, v in enumerate("abc"))
    assert far["pairs"] < far["single"] < 0.1


def test_structure_and_refusals():
    network = random_network()
    assert network.ancestors("c") == {"a", "b", "c"} and network.ancestors("a") == {"a"}
    assert len(network.unrolled(3)) == 9 and network.unrolled(2)[4][0] == ("b@0", "a@0", "b@1")
    network.check()
    with pytest.raises(ValueError):
        dynamic.DynamicNetwork({"a": 2}, {"a": ((), np.array([0.5, 0.6]))}, {"a": (("a",), np.eye(2))}, {}).check()
