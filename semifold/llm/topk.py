"""Exact top-k inner products by norm-sorted candidates and SVD-rotated partial sums.

Vectors become integers, floor(scale * x). Candidates are range-sorted by descending length (ties by a hash of id and
vector) and numbered, so blocks have one size, whatever lengths tie, and hold vectors of similar length. Queries, a stated
subset, are cut into blocks, too, and a task meets one block of queries with one block of candidates. In a task the
candidates pass by descending length in chunks: a query is done once its k-th score exceeds |q| |c| (Cauchy-Schwarz).
Vectors are rotated to the eigenvectors of the candidates' second moments, so the first few coordinates carry most of the
length: partial sum + |q rest| |c rest| bounds the score, and only candidates that may still reach the k-th score are
scored, exactly, in integers. Each task returns k rows a query at most, and a window over the query merges them.

The first block of candidates (the longest) meets every query first. The k-th score there says how long a candidate must
be to matter to a query. Queries are then blocked by that need, and a block of candidates goes only to the blocks of
queries that it may matter to: what the bound excludes is not shuffled. The driver holds one number for each block.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; nor do rows with a
null id. Shorter vectors count as padded with zeros; a task's memory goes by the shorter of its two blocks' longest
vectors. Ties go to the smaller id. Rows that repeat an id stay separate candidates, but a row is never a candidate of a
query with its own id; repeated query rows are one query (the largest integer vector wins). Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semifold.llm.lineage import stored


@dataclass(frozen=True)
class TopKParams:
    """query_block and candidate_block: rows of a block; chunk: candidates that pass at once; rotated: leading components
    that are rotated (the others count to the rest); head: rotated coordinates of the partial sum."""

    k: int = 20
    scale: int = 64
    query_every: int = 20
    query_block: int = 2048
    candidate_block: int = 8192
    chunk: int = 1024
    rotated: int = 256
    head: int = 16


RESULT = "query_id long, vec_id long, score long"
#: Sums of products up to this are exact in double precision.
EXACT = 2.0**53


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, v (array of double with integer values) and norm of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size("v") > 0)
    a = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    a = a.withColumn("v", F.transform("v", lambda e: F.rint(F.floor(e * scale)).cast("double")))
    return a.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the candidates' first dim components, by the eigenvectors of their second moments."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            x = _matrix(pdf["v"], dim)
            total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(dim), dim), "j": np.tile(np.arange(dim), dim), "s": total.ravel()})

    rows = vectors.select("v").mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((dim, dim))
    for r in rows:
        m[r["i"], r["j"]] = r["s"]
    if not np.isfinite(m).all():
        return np.eye(dim)
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


def _matrix(values: pd.Series, dim: int) -> np.ndarray:
    """The first dim components, zeros behind shorter vectors."""
    x = np.zeros((len(values), dim))
    for k, v in enumerate(values):
        x[k, : min(len(v), dim)] = v[:dim]
    return x


def _exact(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of c with those of q of the same place."""
    if np.abs(c).max(initial=0.0) * np.abs(q).max(initial=0.0) * c.shape[1] < EXACT:
        return np.einsum("ij,ij->i", c, q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(c, q, strict=True)]
    return np.array([min(max(s, -(2**63) + 1), 2**63 - 1) for s in whole], dtype=np.int64)


def _rotated(x: np.ndarray, norm: np.ndarray, rot: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
    """The first coordinates of the rotated vectors, and the length of all that is left of them."""
    r = x[:, : len(rot)] @ rot[: x.shape[1], :head]
    return r, np.sqrt(np.maximum(0.0, norm**2 - (r**2).sum(axis=1)) + 1e-9 * norm**2)


def search_block(q: pd.DataFrame, c: pd.DataFrame, rot: np.ndarray, p: TopKParams) -> pd.DataFrame:
    """The k best candidates of each query within one block pair, without those that cannot reach the query's floor."""
    longest = lambda t: max(map(len, t["v"]), default=1)
    dim = max(min(longest(q), longest(c)), 1)  # what lies beyond the shorter vector is multiplied by zero
    order = np.argsort(-c["norm"].to_numpy(), kind="stable")
    cid, cv, cn = c["vec_id"].to_numpy()[order], _matrix(c["v"].iloc[order], dim), c["norm"].to_numpy()[order]
    qid, qv, qn = q["vec_id"].to_numpy(), _matrix(q["v"], dim), q["norm"].to_numpy()
    floor = q["floor"].to_numpy().astype(float)  # a score that k others are known to reach; -inf if unknown
    head = min(p.head, len(rot))
    (cr, c_rest), (qr, q_rest) = _rotated(cv, cn, rot, head), _rotated(qv, qn, rot, head)
    top_q, top_i, top_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    live = np.arange(len(qid))
    whole = np.abs(cv).max(initial=0.0) * np.abs(qv).max(initial=0.0) * dim < EXACT
    for lo in range(0, len(cid), p.chunk):
        at = slice(lo, min(lo + p.chunk, len(cid)))
        # Bounds are in floating point: a relative slack keeps every candidate that might tie.
        live = live[qn[live] * cn[lo] * (1 + 1e-9) + 1e-6 >= floor[live]]
        if not len(live):
            break
        bound = qr[live] @ cr[at].T + np.outer(q_rest[live], c_rest[at]) + 1e-8 * np.outer(qn[live], cn[at]) + 1e-6
        may = (bound >= floor[live, None]) & (cid[at] != qid[live, None])
        if whole and may.mean() > 0.02:
            score = np.where(may, qv[live] @ cv[at].T, -np.inf)
            reach = np.partition(score, -p.k, axis=1)[:, -p.k] if score.shape[1] > p.k else np.full(len(live), -np.inf)
            i, j = np.nonzero(may & (score >= np.maximum(reach, floor[live])[:, None]))
            got = score[i, j].astype(np.int64)
        else:
            i, j = np.nonzero(may)
            got = _exact(cv[lo + j], qv[live[i]])
        top_q, top_i, top_s = np.concatenate([top_q, live[i]]), np.concatenate([top_i, cid[lo + j]]), np.concatenate([top_s, got])
        order = np.lexsort((top_i, -top_s, top_q))
        top_q, top_i, top_s = top_q[order], top_i[order], top_s[order]
        place = np.arange(len(top_q)) - np.searchsorted(top_q, top_q)
        last = place == p.k - 1
        floor[top_q[last]] = np.maximum(floor[top_q[last]], top_s[last])
        keep = place < p.k
        top_q, top_i, top_s = top_q[keep], top_i[keep], top_s[keep]
    return pd.DataFrame({"query_id": qid[top_q], "vec_id": top_i, "score": top_s})


def numbered(df: DataFrame, by: str, block: int, what: str) -> tuple[DataFrame, int]:
    """df as a table in descending order of by, with b, the number of its block of so many rows, and how many there are.

    Rows are range-sorted and counted within their partitions; the driver adds up one count for each partition."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = 0
        for pdf in batches:
            yield pdf.assign(local=before + np.arange(len(pdf)))
            before += len(pdf)

    tie = F.xxhash64(F.lit("block"), "vec_id", "v")
    in_order = df.withColumn("tie", tie).repartitionByRange(F.desc(by), "tie").sortWithinPartitions(F.desc(by), "tie").drop("tie").withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{name} {kind}" for name, kind in in_order.dtypes)
    table = stored(in_order.mapInPandas(count, f"{fields}, local long"), what)
    counts = sorted((r["part"], r["count"]) for r in table.groupBy("part").count().collect())
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    base = table.sparkSession.createDataFrame([(k, s) for (k, _), s in zip(counts, starts[:-1], strict=True)] or [(0, 0)], "part int, base long")
    return table.join(base, "part").withColumn("b", F.floor((F.col("base") + F.col("local")) / block).cast("int")).drop("part", "base", "local"), -(-starts[-1] // block)


def _meet(q: DataFrame, c: DataFrame, rot: np.ndarray, p: TopKParams) -> DataFrame:
    """One group for each pair of a block of queries (qb) and a block of candidates (cb)."""
    q = q.select(*(F.col(x).alias(x) for x in q.columns))  # both come from one table: new names keep them apart
    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(lambda a, b: search_block(a, b, rot, p), RESULT)


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", params: TopKParams = TopKParams()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by query_every, its k best others."""
    p, spark = params, df.sparkSession
    c, n_c = numbered(integer_vectors(df, id_col, vec_col, p.scale), "norm", p.candidate_block, "candidates")
    c = c.withColumnRenamed("b", "cb")
    size = c.agg(F.max(F.size("v")).alias("dim"), F.sum((F.col("vec_id") % p.query_every == 0).cast("long")).alias("q")).first()
    if not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rot = rotation(c, min(size["dim"], p.rotated))
    queries = c.where(F.col("vec_id") % p.query_every == 0).groupBy("vec_id").agg(F.max(F.struct("v", "norm")).alias("x")).select("vec_id", "x.*")
    n_q = -(-size["q"] // p.query_block)
    all_q = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))
    to_first = queries.select("vec_id", "v", "norm", F.lit(float("-inf")).alias("floor"), F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int").alias("qb"), F.lit(0).alias("cb"))
    found = _meet(to_first, c.where(F.col("cb") == 0).withColumn("qb", all_q), rot, p)
    if n_c > 1:
        found = stored(found, "longest")
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= p.k, F.min("score")).cast("double").alias("floor"))
        seeded = queries.join(floors, "vec_id", "left").select("vec_id", "v", "norm", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        # The length that a candidate needs, with the slack of search_block; a query of length 0 reaches nothing above 0.
        need = F.when(F.col("norm") > 0, (F.col("floor") - 1e-6) / F.col("norm") / (1 + 1e-9)).when(F.col("floor") > 0, float("inf")).otherwise(float("-inf"))
        q, _ = numbered(seeded.withColumn("need", need), "need", p.query_block, "queries")
        q = q.withColumnRenamed("b", "qb")
        tops = dict(map(tuple, c.groupBy("cb").agg(F.max("norm")).collect()))
        needs = dict(map(tuple, q.groupBy("qb").agg(F.min("need")).collect()))
        # Blocks of queries go by falling need: a block of candidates matters from some block of queries on.
        least = np.array([needs[k] for k in range(len(needs))])
        spans = [(cb, int(np.searchsorted(-least, -top, "left"))) for cb, top in tops.items() if cb]
        reach = spark.createDataFrame([(cb, k) for cb, k in spans if k < len(least)], "cb int, from_q int")
        sent = c.join(reach, "cb").withColumn("qb", F.explode(F.sequence("from_q", F.lit(len(least) - 1)))).drop("from_q")
        to_c = np.searchsorted([k for _, k in sorted(spans)], np.arange(len(least)), "right").tolist()
        asked = q.join(spark.createDataFrame(list(enumerate(to_c)), "qb int, to_c int"), "qb")
        asked = asked.where(F.col("to_c") > 0).withColumn("cb", F.explode(F.sequence(F.lit(1), "to_c"))).select("vec_id", "v", "norm", "floor", "qb", "cb")
        found = found.union(_meet(asked, sent, rot, p))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
