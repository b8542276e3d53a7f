"""The pipeline's near-duplicate stage against brute force on planted edits, and its fingerprints' parts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from semifold.llm import neardup


def grams(text: str | None) -> set:
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def plain_kept(rows: list[tuple]) -> set:
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return {i for k, (i, _) in enumerate(rows) if least[top(k)] == i}


def planted() -> list[tuple]:
    rng = np.random.default_rng(3)
    line = "this very common line of boilerplate stands in a great many documents of the table "
    texts = []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 300))]
        texts.append((line if k % 3 else "") + " ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.choice(len(base), rng.integers(1, 2 + len(base) // 30), replace=False):
                copy[at] = f"x{rng.integers(0, 5000)}"
            texts.append((line if k % 3 else "") + " ".join(copy))
    crowd = [f"c{x}" for x in range(80)]
    texts += [" ".join([*crowd[:k], "edit", str(k), *crowd[k + 2 :]]) for k in range(1, 78)]
    texts += ["", None, "one two", "One  two", "one two three"]
    order = rng.permutation(len(texts))
    return [(int(i), t) for i, t in zip(order, texts, strict=True)]


@pytest.mark.parametrize("block, texts, layouts", [(8, 16, (5, 4)), (4096, 512, ())])
def test_finds_planted_edits(spark, block, texts, layouts):
    rows = planted()
    want = plain_kept(rows)
    assert len(want) < len(rows) - 100
    got = neardup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearParams(block=block, texts=texts, layouts=layouts))
    kept = {r["doc_id"] for r in got.collect()}
    # Pairs of parts, meant for larger corpora, miss a pair at the limit itself with odds of a few in a hundred.
    assert kept == want if layouts else want <= kept and len(kept - want) <= 1


def test_stage_of_the_pipeline(spark):
    """Two texts under one doc_id are two rows: one that nothing resembles stays."""
    base = [f"w{k}" for k in range(200)]
    edited = " ".join([*base[:50], "new", *base[51:140], "other", *base[141:]])
    alone = "quite another text of a few words"
    rows = [(1, " ".join(base)), (2, edited), (3, alone), (None, edited), (3, edited), (4, edited.upper()), (5, alone + " x y"), (6, "last"), (6, alone + " x y"), (6, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "_t_": F.lit("clash"), "sid": F.lit(2)})
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=repr) == sorted([(1, rows[0][1]), (3, alone), (None, edited), (5, alone + " x y"), (6, "last")], key=repr)


def test_empty(spark):
    assert neardup.near_dedup(spark.createDataFrame([], "doc_id long, text string, n int")).count() == 0


def test_plan_keeps_the_pigeonhole_sum():
    """Whatever the number of fingerprints, the thresholds add up; more fingerprints take longer parts and more probes."""
    rng = np.random.default_rng(1)
    for n in (10, 10**5, 10**10, 10**12):
        m = np.full((16, 65, 65), n / 4.0)
        m[:, range(64), range(64)] = m[:, 64, :64] = m[:, :64, 64] = n / 2 * (1 + 0.01 * rng.standard_normal((16, 64)))
        m[:, 64, 64] = n
        parts = neardup.plan_parts(m, neardup.NearParams(arrangements=0))
        assert sum(e for _, e in parts) == 80
        assert all(len(set(bits)) == len(bits) for ((_, bits),), _ in parts)
        longest = max(len(bits) for ((_, bits),), _ in parts)
        assert longest == 13 if n <= 10**5 else longest > 13
        paired = neardup.plan_parts(m, neardup.NearParams())
        assert paired == parts if n <= 10**5 else all(len(x) == 2 and e == 1 for x, e in paired)


@pytest.mark.parametrize("share, most", [(0.8, 0.001), (0.9, 0.0)])
def test_odds_of_missing_a_pair(share, most):
    """Pairs of sets of the given similarity agree in one of 80 parts of 12 or 13 bits but for a few in a hundred thousand."""
    p, rng, missed, n = neardup.NearParams(), np.random.default_rng(4), 0, 3000
    for _ in range(n):
        h = rng.integers(0, 2**64 - 1, 180, dtype=np.uint64)
        both = int(round(2 * share / (1 + share) * 100))
        a, b = h[:100], np.concatenate([h[:both], h[100 : 200 - both]])
        far = neardup.wide_fingerprint(a, p) ^ neardup.wide_fingerprint(b, p)
        missed += all(w & neardup.mask_of(range(lo, hi)) for w in far.tolist() for lo, hi in ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64)))
    assert missed / n <= most
