"""Very long texts, deep pages and large ids beside null ones."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from semifold.llm import html_extract, licenses, neardup, packing, pii, simhash

IDS = [2**60 + 1, None, 2**60 + 3]
STORY = "A plain sentence of the story with several quiet words in a row to read, and then one more of the same kind."


def test_large_ids_beside_null(spark):
    docs = spark.createDataFrame([(i, f"text {k} of {i}") for k, i in enumerate(IDS)], "doc_id long, text string").coalesce(1)
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "concat('<p>', text, '</p>') AS html")
    want = sorted(IDS, key=repr)
    assert sorted((r["doc_id"] for r in simhash.components(docs).collect()), key=repr) == want
    assert {r["component_id"] for r in simhash.components(docs).collect()} <= set(IDS)
    assert sorted((r["doc_id"] for r in pii.find(docs).collect()), key=repr) == want
    assert sorted((r["doc_id"] for r in packing.pack(docs, packing.PackParams(public_tokenizers.path("byte_bpe_50k.tiktoken"))).collect()), key=repr) == want
    assert sorted((r["page_id"] for r in html_extract.extract(pages).collect()), key=repr) == want


@pytest.mark.parametrize("depth", [100, 600, 5000])
def test_article_in_deep_elements(depth):
    page = f"<html><body>{'<div>' * depth}<ul class='menu'><li><a href='/1'>Home</a></li><li><a href='/2'>News</a></li></ul><article><p>{STORY}</p><p>{STORY}</p></article>{'</div>' * depth}</body></html>"
    model = html_extract.train(html_extract.labelled_pages())
    assert html_extract.extract_batch([page, "<p>x</p>"], model, 0.5)[0] == f"{STORY} {STORY}"


def test_messages_node_by_node_equal_those_by_level():
    rng = np.random.default_rng(1)
    parent = np.array([-1, *(rng.integers(max(0, k - 9), k) for k in range(1, 400))])
    depth = np.zeros(400, int)
    for k in range(1, 400):
        depth[k] = depth[parent[k]] + 1
    x = rng.standard_normal((400, 3))
    model = html_extract.TreeModel(rng.standard_normal(3), rng.standard_normal((2, 2)))
    assert np.allclose(model.marginals(parent, depth, x, narrow=0), model.marginals(parent, depth, x, narrow=10**6))


@pytest.fixture(scope="module")
def tokenizers():
    return packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, "a" * 1_000_000, " " * 1_100_000 + "end", "x" + "\n " * 700_000 + "<|endoftext|>" + "\t" * 9000, "a" + " " * 4096 + "b" + "　" * 5000 + " c"])
def test_long_runs_give_the_tokenizers_ids(tokenizers, text):
    ranks, json = tokenizers
    assert packing.encode(ranks, text) == json.encode(text, add_special_tokens=False).ids


def test_spaces_around_the_cut_give_the_tokenizers_ids(tokenizers):
    ranks, json = tokenizers
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "9", "'s", "!", "<|endoftext|>", "\x1c", "​", rng.choice(" \n\t\xa0 \x85") * rng.choice([1, 2, 4095, 4096, 4097, 9000])]) for _ in range(rng.randrange(1, 9)))
        assert packing.encode(ranks, text) == json.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_memory_of_a_table_of_numbers():
    rng = random.Random(7)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(60_000))  # about 400 kB in one run of tokens
    model = pii.default_model()
    tracemalloc.start()
    pii.find_batch([text, "call +1 555 123 4567", "x"], model, pii.PiiParams())
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()


def test_runs_in_lots_are_decoded_as_alone():
    model, rng = pii.default_model(), random.Random(2)
    runs = [model.scores([rng.choice(["12", "(555)", "123-4567", "+1", "a@b.org"]) for _ in range(rng.randrange(1, 40))]) for _ in range(60)]
    assert all((a == b).all() for a, b in zip(model.viterbi(runs, cells=100), model.viterbi(runs), strict=True))
    tokens = [rng.choice(["12", "(555)", "123-4567", "+1", "x"]) for _ in range(100)]
    assert np.allclose(model.scores(tokens, "a", "b", chunk=7), model.scores(tokens, "a", "b"))


def test_many_anchor_words_take_linear_time(spark):
    words = sorted(licenses.build_index(licenses.LicenseParams()).postings)
    took = []
    for n in (16_000, 64_000):
        rng = random.Random(n)
        text = " ".join(rng.choice(words) for _ in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        licenses.scan(docs).collect()
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 5, took


def fingerprints(n: int, similarity: float, p: neardup.NearParams):
    rng = np.random.default_rng(5)
    both, own = round(1000 * similarity * 2 / (1 + similarity)), 1000 - round(1000 * similarity * 2 / (1 + similarity))
    pairs = []
    for _ in range(n):
        h = rng.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
        pairs.append((neardup.wide_fingerprint(h[: both + own], p), neardup.wide_fingerprint(np.concatenate([h[:both], h[both + own :]]), p)))
    return (np.stack(x) for x in zip(*pairs, strict=True))


@pytest.mark.parametrize("arrangements,sets,rows,meetings", [(0, 1e5, 80, 1200), (3, 1e9, 480, 10_500)])
def test_odds_of_filing(arrangements, sets, rows, meetings):
    """Recall of pairs at the limit, and how many sets without likeness a set meets, for the plan at a corpus's size."""
    p = neardup.NearParams(arrangements=arrangements)
    m = np.full((p.words, 65, 65), sets / 4)
    m[:, np.arange(64), np.arange(64)] = m[:, -1, :] = m[:, :, -1] = sets / 2
    m[:, -1, -1] = sets
    parts = neardup.plan_parts(m, p)
    assert len(parts) == rows and all(len(x) == (2 if arrangements else 1) for x, _ in parts)
    assert len({repr(x) for x, _ in parts}) == rows
    a, b = fingerprints(400, 0.8, p)
    met = (neardup._keys(a, parts) == neardup._keys(b, parts)).any(axis=1)
    assert met.mean() >= 0.95
    chance = sum(sets / 2.0 ** sum(len(bits) for _, bits in x) for x, _ in parts)
    assert chance < meetings
