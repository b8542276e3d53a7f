"""Vectors of one length fill several blocks of one size, and the answer stays exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from semifold.llm import topk


def test_equal_lengths(spark):
    rng = np.random.default_rng(5)
    signs = rng.choice([-1.0, 1.0], (500, 16))
    vectors = [*signs, *[np.full(16, 0.25)] * 300, *[np.zeros(16)] * 200]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    p = topk.TopKParams(candidate_block=64, query_block=16)
    v = topk.integer_vectors(df, "vec_id", "embedding", p.scale)
    c, n = topk.numbered(v, "norm", 64, "test")
    rows = {r["b"]: r for r in c.groupBy("b").agg(F.count("*").alias("n"), F.min("norm").alias("lo"), F.max("norm").alias("hi")).collect()}
    assert sorted(rows) == list(range(n)) and n == -(-len(vectors) // 64)
    assert all(rows[k]["n"] == 64 for k in range(n - 1)) and all(rows[k]["lo"] >= rows[k + 1]["hi"] for k in range(n - 1))
    whole = np.floor(64 * np.array(vectors)).astype(int)
    want = []
    for i in range(0, len(vectors), 20):
        best = sorted((-int(whole[i] @ x), j) for j, x in enumerate(whole) if j != i)[:20]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = topk.top_k(df, params=p).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def plain(vectors: list) -> list[tuple]:
    whole = [[int(np.floor(64 * x)) for x in v] for v in vectors]
    out = []
    for i in range(0, len(vectors), 20):
        best = sorted((-sum(a * b for a, b in zip(whole[i], x)), j) for j, x in enumerate(whole) if j != i)[:20]
        out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    return sorted(out)


def test_lengths_from_tiny_to_huge_and_one_long_vector(spark):
    """Bounds exclude most blocks; a vector of 3,000 components and products beyond 2**53 stay exact."""
    rng = np.random.default_rng(6)
    vectors = [(rng.normal(size=8) * 10.0 ** (k % 7)).tolist() for k in range(400)] + [rng.normal(size=3000).tolist(), (rng.normal(size=8) * 1e7).tolist(), [0.0] * 8]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = topk.top_k(df, params=topk.TopKParams(candidate_block=32, query_block=4, chunk=8, rotated=6, head=3))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain(vectors)
