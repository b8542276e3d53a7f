"""Streaming operators against plain numpy over the same rows, read in several micro-batches."""

from __future__ import annotations

import numpy as np
import pytest

from semifold.streaming import estimation


def fed(spark, tmp_path, rows, schema, files: int = 3):
    """A stream of rows over several files, a micro-batch each."""
    for k in range(files):
        spark.createDataFrame(rows[k::files] if rows else [], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(spark, df, tmp_path, mode: str, name: str):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    return spark.table(name).collect()


def test_weighted_counts(spark, tmp_path):
    rows = [("a", 1.0), ("b", 2.0), ("a", 0.5), (None, 1.0)]
    stream = fed(spark, tmp_path, rows, "x string, w double")
    got = drained(spark, estimation.incremental_counts(stream, ("x",), "w"), tmp_path, "complete", "weighted_counts")
    assert {r["x"]: r["value"] for r in got} == {"a": 1.5, "b": 2.0, None: 1.0}


def test_bayes_filter(spark, tmp_path):
    prior, move = np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]])
    seen = {"u": np.array([0.7, 0.2]), "d": np.array([0.3, 0.8])}
    rows = [(k, t, "u" if (t + k) % 3 else "d") for t in range(6) for k in (1, 2)]
    stream = fed(spark, tmp_path, rows, "k long, t long, o string", 1)
    got = drained(spark, estimation.bayes_filter(stream, "k", "t", "o", ["a", "b"], prior, move, seen), tmp_path, "update", "bayes")
    for k in (1, 2):
        b = prior * seen[[o for i, t, o in rows if i == k and t == 0][0]]
        b = b / b.sum()
        for t in range(1, 6):
            b = (b @ move) * seen[[o for i, s, o in rows if i == k and s == t][0]]
            b = b / b.sum()
        (r,) = [r for r in got if r["k"] == k]
        assert r["steps"] == 6 and (r["p_a"], r["p_b"]) == (pytest.approx(b[0]), pytest.approx(b[1]))


def test_assumed_density_filter_of_one_variable_is_exact(spark, tmp_path):
    move, like = np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([[0.8, 0.2], [0.4, 0.6]])
    rows = [(1, t, t % 2) for t in range(5)]
    stream = fed(spark, tmp_path, rows, "k long, t long, o int", 1)
    df = estimation.assumed_density_filter(stream, "k", "t", ["o"], {"x": 2}, {"x": move}, {"o": like})
    (r,) = drained(spark, df, tmp_path, "update", "adf")
    b = np.array([0.5, 0.5])
    for t in range(5):
        b = (b @ move if t else b) * like[:, t % 2]
        b = b / b.sum()
    assert r["belief"] == pytest.approx(b.tolist())


def test_online_logistic_learns(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(x + rng.normal() / 4 > 0)) for x in rng.normal(size=600)]
    stream = fed(spark, tmp_path, rows, "x double, y double", 6)
    w = estimation.OnlineLogistic(["x"], "y", rate=4.0).run(stream, str(tmp_path / "sgd"))
    assert w[1] > 1.0 and abs(w[0]) < 0.5
