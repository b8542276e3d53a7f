"""Ranked search against plain scoring of all pairs, and against SQL over whole tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from semifold.llm import queries, wavelet
from tests.compare import alike, duck, rows

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOC = "doc_id long, text string, score long, rank int, item long, terms string, df int, bits int"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    docs = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_tokens = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for doc_id, c in docs:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_tokens
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                found.append((-s, doc_id is None, doc_id))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def odd(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(40)] + ["É", "漢字", "naïve", "İ", "K", "ſ"]
    texts = [" ".join(vocab[min(int(rng.expovariate(0.12)), 45)] for _ in range(rng.choice([1, 3, 8, 20, 60]))) for _ in range(120)]
    data = [(1000 - k if k % 11 else None, t) for k, t in enumerate(texts)]
    data += [(2000 + k, "W1, w2; w2!\tw3\nw3") for k in range(40)] + [(5, None), (6, ""), (7, " \n.,"), (5, "w1 w2"), (5, "w1 w2"), (2**60 + 1, "w30 w31"), (2**60 + 3, "w30 w31"), (9, "w1 longword " * 30_000)]
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4, 5) for i, t in data], DOC)


ITEMS = [(0, "w1 w2 w3"), (1, "W2 w2, w2"), (2, None), (3, ""), (4, "absent"), (5, " ".join(f"w{k}" for k in range(40)) * 3), (6, "É 漢字 naïve i̇ k ſ İ K"), (None, "w5"), (7, "w30"), (7, "w30"), (2**60 + 1, "longword w17")]


@pytest.mark.parametrize("p", [wavelet.SearchParams(), wavelet.SearchParams(shard_docs=7, step=1), wavelet.SearchParams(shard_postings=30, block_items=2, step=2, cells=4), wavelet.SearchParams(shard_docs=1, block_terms=1, k=3)])
def test_equals_plain_scores(spark, p):
    docs, items = odd(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(tuple, wavelet.search(docs, items, p).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, p.k)


def test_opens_few_nodes(spark):
    """A rare word's documents are reached without opening the rest of the tree."""
    shard = wavelet.Shard()
    for k in range(4096):
        shard.add(k, [b"common", *([b"rare"] if k in (5, 4000) else []), f"own{k}".encode()])
    forward = spark.createDataFrame([tuple(shard.row()[c] for c in wavelet.FORWARD.names)], wavelet._schema(wavelet.FORWARD))
    row = wavelet.trees(forward, 4096, 8194, wavelet.SearchParams()).first().asDict()
    tree, names = wavelet.Tree(row), wavelet._terms(row["terms"])
    opened = []
    plain_lexsort = wavelet.np.lexsort
    wavelet.np.lexsort = lambda keys: (opened.append(len(keys[0])), plain_lexsort(keys))[1]
    try:
        top = tree.best(wavelet.np.array([names.index(b"rare"), names.index(b"common")]), wavelet.np.array([6000, 1]), [], wavelet.SearchParams(k=2, step=1))
    finally:
        wavelet.np.lexsort = plain_lexsort
    assert [i for _, i in top] == [5, 4000] and len(opened) < 60


@pytest.mark.parametrize("docs,items", [(0, 2), (2, 0), (0, 0)])
def test_empty_tables(spark, docs, items):
    d = spark.createDataFrame([(1, "a b"), (2, "b")][:docs], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, "b")][:items], "item_id long, text string")
    assert wavelet.search(d, q).collect() == []


def test_matches_sql(spark):
    got, want = queries.QUERIES["op11_ranked_search"](spark, SF).toPandas(), duck(SF).execute(queries.ORACLES["op11_ranked_search"]).df()
    assert sorted(got.columns) == sorted(want.columns) and alike(rows(got), rows(want))
