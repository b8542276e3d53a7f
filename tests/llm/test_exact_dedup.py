"""Exact duplicates against a plain grouping, and against SQL over whole tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from semifold.llm import exactdup, queries
from tests.compare import alike, duck, rows

SF = "/root/testdata/sf0.001"


def odd(spark):
    long = "a long text " * 40_000
    texts = ["", None, " ", "same", "same", "same", "Same", "sane", long, long, long[:-1] + "x", "é" * 300 + "a", "é" * 300 + "b", "é" * 300 + "a"]
    data = [(k, t) for k, t in enumerate(texts)] + [(3, "same"), (3, "same"), (None, "alone"), (None, "pair"), (None, "pair"), (2**60 + 1, "big"), (None, "big"), (2**60 + 3, "big")]
    return spark.createDataFrame([(i, t, 1, 2, "x", 5) for i, t in data], "doc_id long, text string, n long, word long, bits string, row int")


def plain(data):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(data):
        groups[t or ""].append((i is not None, i if i is not None else 0, k, i))
    out = []
    for t, members in groups.items():
        best = max(members)
        out += [(i, best[3], len(members), k == best[2], hashlib.sha256(t.encode()).hexdigest()) for *_, k, i in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("prefix", [1, 256])
@pytest.mark.parametrize("bits", [(6, 6), (16, 28)])
def test_equals_plain_grouping(spark, prefix, bits):
    docs = odd(spark)
    p = exactdup.ExactParams(prefix=prefix, least_bits=bits[0], most_bits=bits[1])
    got = exactdup.exact_groups(docs, p, digest_all=True).withColumn("sha", F.lower(F.hex("sha")))
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["sha"]) for r in got.collect()), key=repr)
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_reads_whole_texts_of_survivors_only(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "cc"), (4, "dddd"), (5, "dddd")], "doc_id long, text string")
    read = {r["doc_id"] for r in exactdup.exact_groups(docs).where("sha is not null").collect()}
    assert {4, 5} <= read and 1 not in read


def test_empty_table(spark):
    assert exactdup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_matches_sql(spark):
    got, want = queries.QUERIES["op13_exact_dedup"](spark, SF).toPandas(), duck(SF).execute(queries.ORACLES["op13_exact_dedup"]).df()
    assert sorted(got.columns) == sorted(want.columns) and alike(rows(got), rows(want))
