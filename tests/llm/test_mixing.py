"""Mixtures against a plain computation of weights, passes and blocks."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from semifold.llm import mixing


def plain_alpha(shares: dict, goal: float) -> float:
    """The least exponent at which no source repeats more than goal times, to 32 halvings."""
    repeats = lambda a: max(s ** (a - 1) for s in shares.values()) / min(s ** (a - 1) for s in shares.values())
    lo, hi = 0.0, 1.0
    if repeats(0.0) <= goal:
        return 0.0
    for _ in range(32):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if repeats(mid) > goal else (lo, mid)
    return hi


def rows():
    out = [(k, "word " * (3 + k % 50), f"s{min(int(math.log2(k + 1)), 9)}") for k in range(900)]
    return out + [(900, None, "s1"), (901, " ", None), (902, "x", None), (None, "a b c", "s2"), (7, "word " * 10, "s2"), (7, "word " * 10, "s2")]


@pytest.mark.parametrize("block_tokens", [400, 200_000])
def test_weights_passes_and_order(spark, block_tokens):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    p = mixing.MixParams(block_tokens=block_tokens)
    got = mixing.mix(docs, p=p).collect()
    words: Counter = Counter()
    for _, t, s in rows():
        words[s] += len((t or "").split())
    shares = {s: n / sum(words.values()) for s, n in words.items()}
    alpha = plain_alpha(shares, p.max_repeats)
    z = sum(x**alpha for x in shares.values())
    weight = {s: x**alpha / z for s, x in shares.items()}
    most = max(shares[s] / weight[s] for s in shares)
    passed: Counter = Counter()
    for r in got:
        assert r["mix_weight"] == pytest.approx(weight[r["source"]], rel=1e-6)
        assert r["mix_passes"] == pytest.approx(weight[r["source"]] * most / shares[r["source"]], rel=1e-6)
        assert r["mix_tokens"] == len((r["text"] or "").split())
        passed[r["source"]] += r["mix_tokens"]
    assert Counter(repr((r["doc_id"], r["text"])) for r in got if r["mix_epoch"] == 0) == Counter(repr((i, t)) for i, t, _ in rows())
    blocks = {s: max(1, math.ceil(n / block_tokens)) for s, n in words.items()}
    for s, n in words.items():
        goal = n * weight[s] * most / shares[s]
        assert abs(passed[s] - goal) <= 50 * max(blocks[s], 1) * 8  # a document more or less in each block
    for epoch in {r["mix_epoch"] for r in got}:
        own = [r["mix_order"] for r in got if r["mix_epoch"] == epoch]
        assert len(set(own)) == len(own)
        of_turn = defaultdict(list)
        for x in own:
            of_turn[x >> 26].append(x & (1 << 26) - 1)
        assert epoch or all(sorted(v) == list(range(len(v))) for v in of_turn.values())  # a whole pass: each block is a permutation


def test_repeated_rows_are_dealt_apart(spark):
    docs = spark.range(0, 60_000, 1, 8).selectExpr("cast(1 as long) as doc_id", "'one two' as text", "'s' as source")
    got = mixing.mix(docs, p=mixing.MixParams(block_tokens=1000)).groupBy((mixing.F.col("mix_order") / (1 << 26)).cast("long").alias("turn")).count().collect()
    assert sum(r["count"] for r in got) == 60_000 and len(got) > 400 and max(r["count"] for r in got) < 1000
