"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within tau bits are found through parts of the 64 bits: if part i must agree up to t_i bits and the sum of
(t_i + 1) over the parts is tau + 1, every such pair agrees so in at least one part (t_i = -1: the part is not probed).
Correlated bits are grouped into one part, and the unequal t_i are allocated by dynamic programming over the candidate
counts that all fingerprints' part values predict, together with the cost of probes. Each distinct fingerprint is filed
under its part values and those at up to t_i flipped bits; fingerprints that meet under one value are verified by their
full distance. Values under which many meet are cut into blocks, and each pair of blocks is a group of its own, so no
group grows with the data. A group returns a spanning forest of its links, not all pairs.

Exact copies share one fingerprint and count once. Components come from connected_components over fingerprints.

Defined results: a null text is empty; documents without words have fingerprint 0 and link like any other; repeated rows
each get a row; a row with a null doc_id gets its fingerprint and the component's least non-null doc_id (null if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semifold.llm.components import connected_components
from semifold.llm.lineage import stored

BITS = 64


@dataclass(frozen=True)
class SimHashParams:
    """probe_cost: what filing one row costs, in comparisons of two fingerprints. block: largest group compared whole."""

    shingle: int = 3
    seed: int = 42
    tau: int = 3
    part_counts: tuple = (2, 3, 4)
    probe_cost: float = 100.0
    block: int = 256


def fingerprint(text: str | None, p: SimHashParams) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    whole, k, digest = b" ".join(words), p.shingle, xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(whole, p.seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    n, ones = len(starts), np.zeros(BITS, np.int64)
    for lo in range(0, n, 65536):
        h = np.array([digest(whole[a:b], p.seed) for a, b in zip(starts[lo : lo + 65536], stops[lo : lo + 65536], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long), one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), p) for t in b.column("text")], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_moments(fps: DataFrame) -> np.ndarray:
    """Over all fingerprints: m[i, j], in how many bits i and j are both set; m[64, 64] is their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS + 1, BITS + 1))
        for pdf in batches:
            x = np.column_stack([_bits(pdf["fp"].to_numpy()), np.ones(len(pdf))]).astype(float)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    m = np.zeros((BITS + 1, BITS + 1))
    for r in fps.select("fp").mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        m[r["i"], r["j"]] = r["s"]
    return m


def group_bits(m: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of equal size, each grown from its most correlated free pair by the bit most correlated with it."""
    n = max(m[-1, -1], 1.0)
    mean = m[-1, :BITS] / n
    cov = m[:BITS, :BITS] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = (len(free) + parts - k - 1) // (parts - k)
        rest = sorted(free)
        sub = corr[np.ix_(rest, rest)]
        i, j = np.unravel_index(sub.argmax(), sub.shape) if len(rest) > 1 else (0, 0)
        part = list(dict.fromkeys([rest[i], rest[j]]))[:size]
        while len(part) < size:
            rest = sorted(free - set(part))
            part.append(rest[int(corr[np.ix_(rest, part)].sum(axis=1).argmax())])
        out.append(sorted(part))
        free -= set(part)
    return out


def mask_of(bits) -> int:
    """Bits as a signed long."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least sum of costs[i][e_i] with the e_i adding up to total, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for e, extra in enumerate(cost[: total - used + 1]):
                if used + e not in step or c + extra < step[used + e][0]:
                    step[used + e] = (c + extra, [*chosen, e])
        best = step
    return best[total]


def plan_parts(fps: DataFrame, p: SimHashParams) -> list[tuple[list[int], int]]:
    """(bits, e) of the parts to probe: part values must agree up to e - 1 bits. Costs are estimated from all fps."""
    m = bit_moments(fps)
    n = max(m[-1, -1], 1.0)
    share = m[-1, :BITS] / n
    agree = np.maximum(share**2 + (1 - share) ** 2, 1e-9)
    layouts = [group_bits(m, k) for k in p.part_counts]
    flat = [bits for layout in layouts for bits in layout]
    value = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("value")) for k, bits in enumerate(flat))))
    met = fps.select(value.alias("x")).groupBy("x.part", "x.value").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    pairs = {r["part"]: r["pairs"] for r in met.collect()}
    choices, k = [], 0
    for layout in layouts:
        costs = []
        for bits in layout:
            odds = (1 - agree[bits]) / agree[bits]  # a part that agrees but for one bit, against one that agrees
            cost = [0.0]
            for e in range(1, p.tau + 2):
                probes = sum(comb(len(bits), f) for f in range(e))
                near = sum(odds.sum() ** f / (1 if f < 2 else f) for f in range(e))
                cost.append(n * probes * p.probe_cost + pairs.get(k, 0.0) * near + n * n / 2 * sum(comb(len(bits), f) for f in range(1, e)) / 2.0 ** len(bits))
            costs.append(cost)
            k += 1
        choices.append((allocate(costs, p.tau + 1), layout))
    (_, chosen), layout = min(choices, key=lambda c: c[0][0])
    return [(bits, e) for bits, e in zip(layout, chosen, strict=True) if e]


def filed(fps: DataFrame, parts: list[tuple[list[int], int]], p: SimHashParams) -> DataFrame:
    """g and fp: each fingerprint under its part values and their neighbours; values that many share, in pairs of blocks."""
    rows = []
    for k, (bits, e) in enumerate(parts):
        flips = [mask_of(c) for f in range(e) for c in combinations(bits, f)]
        own = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        rows.append(F.transform(F.array(*map(F.lit, flips)), _under(k, own)))
    under = fps.select("fp", F.explode(F.flatten(F.array(*rows))).alias("g"))
    crowded = under.groupBy("g").count().where(F.col("count") > p.block).select("g", F.ceil(F.col("count") / p.block).cast("int").alias("blocks"))
    dealt = under.join(crowded, "g", "left")
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    key = F.when(F.col("blocks").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.select(key.alias("g"), "fp")


def _under(part: int, own):
    return lambda flip: F.xxhash64(F.lit(part), own.bitwiseXOR(flip))


def _links(g: np.ndarray, fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each group; g is sorted."""
    left, right = [], []
    at, d = np.arange(len(g)), 1
    while True:
        at = at[at + d < len(g)]
        at = at[g[at] == g[at + d]]
        if not len(at):
            break
        near = at[np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= tau]
        left.append(near)
        right.append(near + d)
        d += 1
    if not left:
        return fp[:0], fp[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(g))
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero((root != np.arange(len(g))) & (fp != fp[root]))
    return fp[at], fp[root[at]]


def links(fps: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """a and b: links between distinct fingerprints of fps whose components are those of all pairs within tau bits."""
    parts = plan_parts(fps, p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in batches:
            g, fp = np.concatenate([g, pdf["g"].to_numpy()]), np.concatenate([fp, pdf["fp"].to_numpy()])
            if len(g) < 4096:
                continue
            last = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            a, b = _links(g[:last], fp[:last], p.tau)
            yield pd.DataFrame({"a": a, "b": b})
            g, fp = g[last:], fp[last:]
        a, b = _links(g, fp, p.tau)
        yield pd.DataFrame({"a": a, "b": b})

    return filed(fps, parts, p).repartition("g").sortWithinPartitions("g").mapInPandas(run, "a long, b long")


def with_components(prints: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """prints (doc_id, fp) with root (a fingerprint that names the component) and component_id, the least doc_id reachable
    over links."""
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    comps = connected_components(links(fps.select("fp"), p), "a", "b").withColumnRenamed("node", "fp")
    rooted = fps.join(comps, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return prints.join(named, "fp", "left")


def components(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of docs."""
    found = with_components(stored(fingerprints(docs, p), "simhash"), p)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
