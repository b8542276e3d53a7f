"""Merkle manifest against a plain construction of the same trees, and against SQL over whole tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from semifold.llm import merkle, queries
from tests.compare import alike, duck, rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, h string, row int, idx int, cell int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def climb(levels, i, now, beside, fanout):
    for below in levels[:-1]:
        first = i // fanout * fanout
        run = below[first : first + fanout]
        beside += run[: i - first] + run[i - first + 1 :]
        now = sha(*run[: i - first], now, *run[i - first + 1 :])
        i //= fanout
    return now, beside


def plain(data, fanout=3):
    groups = defaultdict(list)
    for r in data:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in names}
    top = tree([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for i, (_, _, h, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            shown = h
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                shown = leaf(r, r["text"].replace("\n", ""))
            now, beside = climb(trees[s], i, shown, [], fanout)
            now, beside = climb(top, k, now, beside, fanout)
            out.append((r["doc_id"], h, trees[s][-1][0], top[-1][0], sha(*beside), now))
    return sorted(out, key=repr)


def odd(spark, n):
    rng = random.Random(5)
    data = [(k if k % 31 else None, [None, "", f"a\nb{k}", "same\ntext", "x" * (k % 9)][rng.randrange(5)], None if k % 7 == 0 else "en", "hot" if k % 3 else [None, "", "é", "a", f"s{k}"][rng.randrange(5)], k % 5, "g", "h", 1, 2, 3) for k in range(n)]
    data += [(2**60 + 1, "big", None, "hot", 1, "g", "h", 1, 2, 3), (None, "big", None, "hot", 1, "g", "h", 1, 2, 3), (2**60 + 3, "big", None, "hot", 1, "g", "h", 1, 2, 3), (5, "twice", "en", "hot", 5, "g", "h", 1, 2, 3), (5, "twice", "en", "hot", 5, "g", "h", 1, 2, 3)]
    return spark.createDataFrame(data, SCHEMA)


def verified(docs, p):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    got = merkle.verify(docs, F.replace("text", F.lit("\n"), F.lit("")), even, p)
    return sorted(((r["id"], r["h"], r["subroot"], r["root"], sha(*r["siblings"]), r["folded"]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("n,fanout,cells", [(400, 3, 2), (90, 3, 0), (150, 2, 3), (130, 3, 6)])
def test_equals_plain_trees(spark, n, fanout, cells):
    docs = odd(spark, n)
    assert verified(docs, merkle.MerkleParams(fanout, cells)) == plain(docs.collect(), fanout)


def test_one_source_alone(spark):
    docs = spark.createDataFrame([(k, "t\n", "en", "s", 1) for k in range(1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert verified(docs, merkle.MerkleParams()) == plain(docs.collect())


def test_ranges_split_anywhere_give_the_same_nodes():
    """Runs of a group, cut at any places, leave as pending exactly what completes the tree."""
    n, leaves = 50, [sha(str(k)) for k in range(50)]
    want = {(level, i): h for level, row in enumerate(tree(leaves, 3)) for i, h in enumerate(row)}
    rng = random.Random(3)
    for _ in range(20):
        cuts = [0, *sorted(rng.sample(range(1, n), 5)), n]
        records, pending = {}, []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            r = merkle.Range(3)
            for i in range(lo, hi):
                r.push(0, i, leaves[i])
            r.close()
            records |= {(level, i): h for level, i, h in r.records}
            pending += r.pending
        assert all(want[k] == h for k, h in records.items()) and all(want[level, i] == h for level, i, h in pending)
        assert {i for level, i, _ in pending if level == 0} == {i for i in range(n) if (1, i // 3) not in records}


def test_empty_table(spark):
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matches_sql(spark):
    got, want = queries.QUERIES["op12_merkle_manifest"](spark, SF).toPandas(), duck(SF).execute(queries.ORACLES["op12_merkle_manifest"]).df()
    assert sorted(got.columns) == sorted(want.columns) and alike(rows(got), rows(want))
