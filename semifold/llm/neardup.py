"""Near-duplicates by SimHash with verified similarity, for pipelines (op1 keeps its own contract values).

A pair whose five-word shingle sets have similarity 0.8 differs in about 15 bits of 100, too many for 64-bit fingerprints
to be searched. So fingerprints here have `words` words of 64 bits, each the SimHash of the set under its own hash, and the
generalised pigeonhole principle is applied to all their bits: correlated bits of a word are grouped into parts, and
dynamic programming over estimated candidate counts allocates unequal thresholds e - 1 whose e add up to five times
`words`. A pair within 5 * words - 1 bits (8 of 100) is found for certain. Others are found if any part agrees: with 80
parts of 12 or 13 bits a pair of similarity 0.8 is missed with odds of 3e-5, one of 0.85 with 3e-7. Longer parts, which
pay for more documents, are probed at flipped bits, too.

Single parts let sets without likeness meet in proportion to the corpus: of n sets, n / 85 a set. From some tens of millions
of sets on, where that costs more than filing does, sets are filed under pairs of parts instead, of 25 or 26 bits: the 80
parts are put in groups of five, `arrangements` times so that no two parts share two groups, and each pair of a group's
parts is a value. A pair of sets within 4 * words - 1 bits has a group with three differing bits or fewer, so two parts
of five agree: found for certain. Of pairs of similarity 0.8 the three arrangements miss 22 of 1,000 (measured), of those of
0.82 11, of 0.85 one. There are 480 rows a set then, and n / 97,000 chance meetings a set, 10,300 of them at a thousand million
sets, where single parts would give 12 million: the work is that of filing, in proportion to the corpus.

1. Each text becomes its set of shingles; equal sets count once (a group of exact copies is one row from here on).
2. Each set is filed under its part values. Values that many share are cut into blocks, and each pair of blocks is a group
   of its own, so no group grows with the data. A sketch of 128 bits tells which sets have a near one at all; only those
   are filed again with their whole fingerprints, and each group gives a spanning forest of its near pairs. Components of
   these are crowds: similar sets are in one crowd.
3. Within a crowd all pairs are compared exactly, by the shingles themselves, not their hashes: large crowds are cut into
   blocks, each pair of blocks is a group, and a group gives a spanning forest of the pairs that reach the limit.

A component of verified links is a group of near-duplicates. Defined results: a null text is empty; texts without words
have the empty set and are copies of each other; texts of up to five words are one shingle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semifold.llm.components import connected_components
from semifold.llm.lineage import release, stored
from semifold.llm.simhash import BITS, allocate, group_bits, mask_of


@dataclass(frozen=True)
class NearParams:
    """words: of a fingerprint; layouts: numbers of parts that a word may be cut into (empty: pairs of parts
    alone); arrangements: of parts in groups, for pairs of parts (0: none); block: largest group of fingerprints
    compared whole; texts: largest crowd compared whole; deviations: how far beyond the expected distance of a pair at the limit a pair still counts as near; probe_cost: what
    filing one row costs, in comparisons of two sketches."""

    shingle: int = 5
    similarity: float = 0.8
    seed: int = 42
    words: int = 16
    layouts: tuple = (5, 4, 3, 2)
    arrangements: int = 3
    probe_cost: float = 1000.0
    block: int = 4096
    texts: int = 512
    deviations: float = 4.6

    def limit(self, bits: int) -> int:
        """Most bits of so many in which a similar pair may differ."""
        odds = acos(2 * self.similarity / (1 + self.similarity)) / pi
        return int(bits * odds + self.deviations * sqrt(bits * odds * (1 - odds)))


def shingles(text: str | None, k: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if len(words) <= k:
        return {b" ".join(words)} if words else set()
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1].tolist()
    return {whole[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def wide_fingerprint(h: np.ndarray, p: NearParams) -> np.ndarray:
    """The words of the fingerprint of a set of hashes: a bit is 1 if set in over half the word's hashes."""
    salt = np.random.default_rng(p.seed).integers(0, 2**63, p.words, dtype=np.uint64)
    ones = np.zeros(p.words * BITS, np.int64)
    for lo in range(0, len(h), 255):
        x = h[lo : lo + 255, None] ^ salt
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8").astype(np.int64)


def signatures(docs: DataFrame, p: NearParams) -> DataFrame:
    """doc_id, t (hash of the text, to find the row again), s (128 bits of the set's sorted hashes, its name) and fp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            names, prints = [], []
            for text in pdf["text"]:
                h = np.unique(np.array([xxhash.xxh64_intdigest(s, p.seed) for s in shingles(text, p.shingle)], dtype="<u8"))
                names.append(xxhash.xxh3_128_digest(h.tobytes(), p.seed))
                prints.append(wide_fingerprint(h.astype(np.uint64), p))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "t": pdf["t"], "s": names, "fp": prints})

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("t")).mapInPandas(run, "doc_id long, t long, s binary, fp array<long>")


def word_moments(sets: DataFrame, words: int) -> np.ndarray:
    """m[w, i, j]: in how many fingerprints bits i and j of word w are both set; m[w, 64, 64] is their number. A number of
    fixed size for each partition, added up by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((words, BITS + 1, BITS + 1))
        for pdf in batches:
            if not len(pdf):
                continue
            fp = np.stack(pdf["fp"]).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little").reshape(len(fp), words, BITS)
            x = np.concatenate([bits, np.ones((len(fp), words, 1), np.uint8)], axis=2).astype(np.float32).transpose(1, 0, 2)
            total += x.transpose(0, 2, 1) @ x
        w, i, j = np.nonzero(total)
        yield pd.DataFrame({"w": w, "i": i, "j": j, "n": total[w, i, j]})

    m = np.zeros((words, BITS + 1, BITS + 1))
    for r in sets.select("fp").mapInPandas(run, "w int, i int, j int, n double").groupBy("w", "i", "j").agg(F.sum("n").alias("n")).collect():
        m[r["w"], r["i"], r["j"]] = r["n"]
    return m


def paired_parts(parts: list[tuple[int, int, list[int]]], p: NearParams) -> list[tuple]:
    """Pairs of parts (word, place in the word, bits) that share a group of some arrangement; no pair comes twice.

    Arrangement r has the parts with the same (word + r * place) modulo words in one group. Two parts could share the
    groups of r and s only if words divides (r - s) times the difference of their places, which is smaller than words.
    """
    if (p.arrangements - 1) * 4 >= p.words:
        raise ValueError("too many arrangements for so few words")
    out = []
    for r in range(p.arrangements):
        groups: dict[int, list] = {}
        for w, j, bits in parts:
            groups.setdefault((w + r * j) % p.words, []).append((w, bits))
        out += [pair for members in groups.values() for pair in combinations(members, 2)]
    return out


def plan_parts(m: np.ndarray, p: NearParams) -> list[tuple[tuple, int]]:
    """(parts, e) to file under, from the moments of all fingerprints; parts are one or two (word, bits). Values of single
    parts must agree up to e - 1 bits, and the e of all parts add up to 5 * words; those of pairs must agree (e is 1)."""
    n = max(m[0, -1, -1], 1.0)
    share = m[:, -1, :BITS] / n
    agree = np.maximum(share**2 + (1 - share) ** 2, 1e-9)
    choices = []
    for layout in p.layouts:
        parts = [(w, bits) for w in range(p.words) for bits in group_bits(m[w], layout)]
        costs = []
        for w, bits in parts:
            pairs = n * n / 2 * agree[w, bits].prod()  # estimate of the pairs that agree in the whole part
            odds = float(((1 - agree[w, bits]) / agree[w, bits]).mean())
            cost = [0.0]
            for e in (1, 2, 3):
                probes = sum(comb(len(bits), f) for f in range(e))
                cost.append(n * probes * p.probe_cost + pairs * sum(comb(len(bits), f) * odds**f for f in range(2 * e - 1)))
            costs.append(cost)
        cost, chosen = allocate(costs, 5 * p.words)
        choices.append((cost, [((part,), e) for part, e in zip(parts, chosen, strict=True) if e]))
    if p.arrangements:
        pairs = paired_parts([(w, j, bits) for w in range(p.words) for j, bits in enumerate(group_bits(m[w], 5))], p)
        met = n * n / 2 * sum(float(agree[v, a].prod() * agree[w, b].prod()) for (v, a), (w, b) in pairs)
        choices.append((n * len(pairs) * p.probe_cost + met, [(pair, 1) for pair in pairs]))
    return min(choices, key=lambda c: c[0])[1]


def _keys(fp: np.ndarray, parts: list[tuple[tuple, int]]) -> np.ndarray:
    """For fingerprints (n x words) the values under which each is filed: those of its parts, and those at up to e - 1
    flipped bits."""
    out = []
    with np.errstate(over="ignore"):
        for k, (((w, bits), *more), e) in enumerate(parts):
            own = fp[:, w] & np.int64(mask_of(bits))
            for v, other in more:
                own = own * np.int64(-7046029254386353131) ^ ((fp[:, v] & np.int64(mask_of(other))) * np.int64(-4417276706812531889))
            for flip in [0, *(mask_of(c) for f in range(1, e) for c in combinations(bits, f))]:
                x = ((own ^ np.int64(flip)).view(np.uint64) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(31)) ^ np.uint64(k << 32)) * np.uint64(0xBF58476D1CE4E5B9)
                out.append(x ^ (x >> np.uint64(30)))
    return np.column_stack(out).view(np.int64)


def filed(sets: DataFrame, parts: list, p: NearParams, words: int) -> DataFrame:
    """g, sid and fp, its first words: each set under its values; values that many share, in pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                fp = batch.column("fp").flatten().to_numpy().reshape(batch.num_rows, p.words)
                g = _keys(fp, parts)
                some = np.repeat(np.ascontiguousarray(fp[:, :words]), g.shape[1], axis=0)
                short = pa.ListArray.from_arrays(np.arange(0, some.size + 1, words, dtype=np.int32), pa.array(some.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(g.ravel()), pa.array(np.repeat(batch.column("sid").to_numpy(), g.shape[1])), short], ["g", "sid", "fp"])

    under = sets.select("sid", "fp").mapInArrow(run, "g long, sid long, fp array<long>")
    crowded = stored(under.groupBy("g").count().where(F.col("count") > p.block).select("g", F.ceil(F.col("count") / p.block).cast("int").alias("blocks")), "crowded")
    lone = under.join(crowded, "g", "left_anti")
    dealt = under.join(crowded, "g").withColumn("own", F.pmod(F.xxhash64("sid", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))
    return lone.select("g", "sid", "fp").union(dealt.select(pair.alias("g"), "sid", "fp"))


def _near_pairs(g: np.ndarray, fp: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of one group (g is sorted) within limit bits."""
    at, d = np.arange(len(g)), 1
    while True:
        at = at[at + d < len(g)]
        at = at[g[at] == g[at + d]]
        if not len(at):
            return
        for lo in range(0, len(at), 1 << 20):
            i = at[lo : lo + (1 << 20)]
            far = np.zeros(len(i), np.int64)
            for w in range(fp.shape[1]):
                far += np.bitwise_count((fp[i, w] ^ fp[i + d, w]).view(np.uint64))
            i = i[far <= limit]
            if len(i):
                yield i, i + d
        d += 1


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place reachable from each of n places over the links i - j."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        root = root[root]
        if (root == before).all():
            return root


def _in_groups(batches: Iterator[pa.RecordBatch], words: int, found) -> Iterator[pa.RecordBatch]:
    """found(g, sid, fp) for batches sorted by g, cut so that groups stay whole."""
    g, sid, fp = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, words), np.int64)
    for batch in batches:
        g, sid = np.concatenate([g, batch.column("g").to_numpy()]), np.concatenate([sid, batch.column("sid").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").flatten().to_numpy().reshape(-1, words)])
        if len(g) < 4096:
            continue
        last = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
        yield found(g[:last], sid[:last], fp[:last])
        g, sid, fp = g[last:], sid[last:], fp[last:]
    yield found(g, sid, fp)


def with_near_one(sets: DataFrame, parts: list, p: NearParams) -> DataFrame:
    """sid of the sets that meet another whose sketch is near."""

    def found(g: np.ndarray, sid: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        some = np.zeros(len(g), bool)
        for i, j in _near_pairs(g, fp, p.limit(2 * BITS)):
            some[i] = some[j] = True
        return pa.RecordBatch.from_arrays([pa.array(np.unique(sid[some]))], ["sid"])

    met = filed(sets, parts, p, 2).repartition("g").sortWithinPartitions("g", "sid").mapInArrow(lambda b: _in_groups(b, 2, found), "sid long")
    return met.distinct()


def near_links(sets: DataFrame, parts: list, p: NearParams) -> DataFrame:
    """a and b: a spanning forest of the near pairs of each group."""

    def found(g: np.ndarray, sid: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        root = own = np.arange(len(g))
        for i, j in _near_pairs(g, fp, p.limit(p.words * BITS)):  # a forest takes in one lot of pairs after the other
            root = _roots(len(g), np.concatenate([i, own]), np.concatenate([j, root]))
        at = np.flatnonzero(root != np.arange(len(g)))
        return pa.RecordBatch.from_arrays([pa.array(sid[at]), pa.array(sid[root[at]])], ["a", "b"])

    met = filed(sets, parts, p, p.words).repartition("g").sortWithinPartitions("g", "sid")
    return met.mapInArrow(lambda b: _in_groups(b, p.words, found), "a long, b long").distinct()


def similar_pairs(texts: list[str], p: NearParams) -> tuple[np.ndarray, np.ndarray]:
    """Places (later, earlier) of all pairs whose shingle sets reach the similarity, compared exactly."""
    sets = [shingles(t, p.shingle) for t in texts]
    if len(sets) == 2:
        hit = jaccard(*sets) >= p.similarity
        return np.ones(int(hit), np.int64), np.zeros(int(hit), np.int64)
    seen = Counter(x for s in sets for x in s)
    column = {x: k for k, x in enumerate(x for x, n in seen.items() if n > 1)}  # a shingle of one set is in no intersection
    size, both = np.array([len(s) for s in sets]), np.zeros((len(sets), len(sets)))
    held = [np.array(sorted(column[x] for x in s if x in column), np.int64) for s in sets]
    for lo in range(0, len(column), 4096):
        x = np.zeros((len(sets), min(4096, len(column) - lo)), np.float32)
        for k, h in enumerate(held):
            x[k, h[np.searchsorted(h, lo) : np.searchsorted(h, lo + 4096)] - lo] = 1
        both += x @ x.T
    union = size[:, None] + size[None] - both
    hit = (np.divide(both, union, out=np.ones_like(both), where=union > 0) >= p.similarity) & (np.arange(len(sets))[:, None] > np.arange(len(sets))[None])
    return np.nonzero(hit)


def verified(crowds: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """a and b: spanning forests of the similar pairs of each crowd (sid, crowd). texts: sid and text."""

    def linked(sid: np.ndarray, texts: list[str]) -> pd.DataFrame:
        i, j = similar_pairs(texts, p)
        root = _roots(len(sid), i, j)
        at = np.flatnonzero(root != np.arange(len(sid)))
        return pd.DataFrame({"a": sid[at], "b": sid[root[at]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # rows of the group that may go on
        key = None
        for pdf in batches:
            out = []
            for k, sid, text in zip(pdf["k"], pdf["sid"], pdf["text"], strict=True):
                if k != key and held:
                    out.append(linked(np.array([h[0] for h in held]), [h[1] for h in held]))
                    held = []
                key = k
                held.append((sid, text))
            yield pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if held:
            yield linked(np.array([h[0] for h in held]), [h[1] for h in held])

    sized = crowds.groupBy("crowd").agg(F.ceil(F.count("*") / p.texts).cast("int").alias("blocks"))
    dealt = crowds.join(sized, "crowd").withColumn("own", F.pmod(F.xxhash64("sid", F.lit("text")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = dealt.select("sid", F.xxhash64("crowd", F.least("own", "other"), F.greatest("own", "other")).alias("k"))
    return grouped.join(texts, "sid").repartition("k").sortWithinPartitions("k").mapInPandas(run, "a long, b long")


def components(docs: DataFrame, prints: DataFrame, p: NearParams) -> tuple[DataFrame, DataFrame]:
    """The sets (s, sid) of prints, and the components (sid, root) of all similar pairs that are in one crowd."""
    grouped = prints.groupBy("s").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.first("fp").alias("fp"))
    sets = stored(grouped.withColumn("sid", F.monotonically_increasing_id()), "sets")  # numbered once: a table
    parts = plan_parts(word_moments(sets, p.words), p)
    active = stored(sets.join(with_near_one(sets, parts, p), "sid", "left_semi"), "active")
    crowds = connected_components(near_links(active, parts, p), "a", "b").withColumnsRenamed({"node": "sid", "root": "crowd"})
    found = active.join(crowds, "sid", "left_semi").select("sid", F.col("first.doc_id").alias("_d"), F.col("first.t").alias("_t"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("text")).withColumn("_t", F.xxhash64("text"))
    texts = stored(rows.join(found, ["_d", "_t"]).select("sid", "text").dropDuplicates(["sid"]), "texts")
    links = stored(verified(crowds, texts, p), "verified")
    release(active, texts)
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "sid")
    return sets.select("s", "sid"), sets.select("sid").join(roots, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"))


def near_dedup(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """docs without near-duplicates: of each component the row with the least doc_id stays, once.

    Rows go by their own text: two texts under one doc_id are two rows. Rows without a doc_id stay, since nothing names
    them. Columns are unchanged."""
    prints = stored(signatures(docs.where(F.col("doc_id").isNotNull()), p), "signatures")
    sets, comps = components(docs, prints, p)
    named = prints.select("doc_id", "t", "s").join(sets, "s").join(comps, "sid")
    keep = named.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("k")).select(F.col("k.doc_id").alias("_d_"), F.col("k.t").alias("_t_"))
    rows = docs.select(F.struct("*").alias("_row_"), F.xxhash64(F.col("text").cast("string")).alias("_t_"), F.col("doc_id").cast("long").alias("_d_"))
    once = Window.partitionBy("_d_", "_t_").orderBy(F.lit(0))
    left = rows.join(keep, ["_d_", "_t_"], "left_semi").withColumn("_s_", F.row_number().over(once)).where(F.col("_s_") == 1)
    return left.select("_row_.*").unionByName(docs.where(F.col("doc_id").isNull()))
