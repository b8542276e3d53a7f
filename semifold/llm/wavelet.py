"""Exact ranked lexical search by dual-sorted wavelet trees, one a shard of documents.

A shard holds the postings of its documents: term after term, the documents of each term by falling impact (the part of the
score that does not depend on the query). Over this sequence of document numbers stands a wavelet tree, level by level in
arrays: each node is a range of doc_ids, the stable partition keeps the impact order within a node, so a term's first
posting in a node has the term's largest impact in that doc_id range. The same sequence is thus sorted two ways: by impact
at the root, by doc_id at the leaves.

A query's terms are ranges of the sequence. They go down the tree together (node intersection): the sum of weight times
first impact bounds the score of every document below a node. Nodes are opened best first, a few at a time; a leaf's bound
is its document's exact score; a node that cannot beat the k-th answer so far (of this and earlier shards of the task, ties
by doc_id) is never opened. When a query of very many terms holds more than a budget of ranges, the deepest nodes go first,
which frees them: memory stays bounded, the answer exact.

Shards are cut where documents lie, by postings and by documents, so no text and no posting is shuffled, and a word of all
documents is a short list in each shard. Queries are packed in blocks of bounded size; a block is broadcast, meets every
shard, and each task returns k rows an item at most. Document frequencies are counted for the queries' terms only, from the
shards' dictionaries, combined before the shuffle.

Defined results: null texts and texts without terms are no documents; each row is a document of its own, also rows that
repeat; a null doc_id comes after all others in ties (the largest long, too, is taken as null); each row of the queries is a query of its own, null ids included, and
one without a term in any document has no rows; extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semifold.llm.lineage import release, stored

#: Bytes of a text in UTF-8: A-Z as a-z, other ASCII but digits and letters as a space. What is not ASCII stays.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class SearchParams:
    """k: answers an item. b: the length share of a document's norm, in percent. shard_postings, shard_docs: a shard ends
    at either. block_terms, block_items: a block of queries ends at either. step: nodes opened at once; cells: ranges that
    wait before depth goes first."""

    k: int = 10
    b: int = 75
    shard_postings: int = 1 << 20
    shard_docs: int = 1 << 13
    block_terms: int = 1 << 16
    block_items: int = 1 << 10
    step: int = 24
    cells: int = 1 << 21


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


class Shard:
    """The documents of a shard as they come."""

    def __init__(self):
        self.ids, self.sizes, self.terms, self.at, self.tf, self.n = [], [], {}, [], [], 0

    def add(self, doc_id: int | None, tokens: list[bytes]) -> None:
        counts, terms = Counter(tokens), self.terms
        self.ids.append(doc_id)
        self.sizes.append(len(tokens))
        self.at.append(np.fromiter((terms.setdefault(t, len(terms)) for t in counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.n += len(counts)

    def row(self) -> dict:
        """Documents by doc_id (null last), postings by term and document."""
        ids = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((np.array([i is None for i in self.ids]), ids))
        rank = np.empty(len(ids), np.int32)
        rank[order] = np.arange(len(ids), dtype=np.int32)
        term = np.concatenate(self.at)
        doc = np.repeat(rank, [len(x) for x in self.at])
        by = np.lexsort((doc, term))
        sizes = np.array(self.sizes, np.int64)
        return {
            "n_docs": len(ids), "n_tokens": int(sizes.sum()), "ids": [self.ids[i] for i in order], "sizes": _packed(sizes[order].astype("<i8")),
            "terms": _packed(np.frombuffer(b"\n".join(self.terms), np.uint8)), "df": _packed(np.bincount(term, minlength=len(self.terms)).astype("<i4")),
            "docs": _packed(doc[by].astype("<i4")), "tf": _packed(np.concatenate(self.tf)[by].astype("<i4")),
        }


FORWARD = pa.schema([("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "terms", "df", "docs", "tf"))])
INDEX = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("terms", "df", "impacts", "bits"))])


def _schema(s: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in s)


def shards(docs: DataFrame, p: SearchParams) -> DataFrame:
    """One row a shard: its documents' ids and lengths, its terms, and their postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                tokens = words(text.as_py())
                if not tokens:
                    continue
                shard.add(doc_id, tokens)
                if shard.n >= p.shard_postings or len(shard.ids) >= p.shard_docs:
                    yield pa.RecordBatch.from_pylist([shard.row()], FORWARD)
                    shard = Shard()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], FORWARD)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _schema(FORWARD))


def trees(forward: DataFrame, n_docs: int, n_tokens: int, p: SearchParams) -> DataFrame:
    """One row a shard: ids, terms, df, the impacts at the root and the tree's bits, level after level."""

    def row(x: dict) -> dict:
        sizes = _unpacked(x["sizes"], "<i8").tolist()
        norm = np.array([100 - p.b + (p.b * n * n_docs) // n_tokens for n in sizes], np.int64)
        doc, tf, df = _unpacked(x["docs"], "<i4"), _unpacked(x["tf"], "<i4").astype(np.int64), _unpacked(x["df"], "<i4")
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc])
        by = np.lexsort((doc, -impact, np.repeat(np.arange(len(df)), df)))
        seq, levels = doc[by], []
        depth = max(1, (len(sizes) - 1).bit_length())
        for level in range(depth):
            bit = (seq >> (depth - 1 - level)) & 1
            levels.append(np.packbits(bit.astype(np.uint8)))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        return {"ids": x["ids"], "terms": x["terms"], "df": x["df"], "impacts": _packed(impact[by].astype("<i4")), "bits": _packed(np.concatenate(levels))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pylist([row(b.slice(i, 1).to_pylist()[0])], INDEX)

    return forward.select("ids", "sizes", "terms", "df", "docs", "tf").mapInArrow(run, _schema(INDEX))


class Tree:
    """A shard's tree in memory: per level, zeros before each place (flat, one place more than postings), and impacts."""

    def __init__(self, x: dict):
        self.ids = np.array([NO_ID if i is None else i for i in x["ids"]], np.int64)
        df = _unpacked(x["df"], "<i4").astype(np.int64)
        self.ends = np.cumsum(df)
        self.starts = self.ends - df
        self.n = n = int(df.sum())
        self.depth = max(1, (len(self.ids) - 1).bit_length())
        self.stride = n + 1
        bits = _unpacked(x["bits"], "u1").reshape(self.depth, -1)
        impact = _unpacked(x["impacts"], "<i4")
        self.zeros = np.zeros(self.depth * self.stride, np.int32)
        self.impact = np.zeros((self.depth + 1) * self.stride, np.int32)
        self.impact[:n] = impact
        self.left = np.zeros(self.depth, np.int64)
        for level in range(self.depth):
            bit = np.unpackbits(bits[level], count=n).astype(bool)
            at = level * self.stride
            np.cumsum(~bit, out=self.zeros[at + 1 : at + n + 1])
            self.left[level] = self.zeros[at + n]
            impact = np.concatenate([impact[~bit], impact[bit]])
            self.impact[at + self.stride : at + self.stride + n] = impact

    def best(self, terms: np.ndarray, weights: np.ndarray, top: list, p: SearchParams) -> list:
        """top (at most k of (-score, id), sorted) with this shard's documents that belong in it."""
        lo, hi = self.starts[terms][None, :], self.ends[terms][None, :]
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.impact[lo] @ weights
        while True:
            worst, worst_id = (-top[-1][0], top[-1][1]) if len(top) == p.k else (1, NO_ID)
            first = self.ids[np.minimum(prefix << (self.depth - level), len(self.ids) - 1)]
            may = (bound > worst) | ((bound == worst) & (first <= worst_id))
            if not may.any():
                return top
            if not may.all():
                lo, hi, level, prefix, bound, first = (x[may] for x in (lo, hi, level, prefix, bound, first))
            if len(bound) > p.step:
                order = np.lexsort((first, -bound)) if lo.size <= p.cells else np.lexsort((-bound, -level))
                now, later = order[: p.step], order[p.step :]
            else:
                now, later = np.arange(len(bound)), np.empty(0, np.int64)
            base = (level[now] * self.stride)[:, None]
            zl, zh = self.zeros[base + lo[now]].astype(np.int64), self.zeros[base + hi[now]].astype(np.int64)
            turn = self.left[level[now]][:, None]
            new_lo, new_hi = np.concatenate([zl, turn + lo[now] - zl]), np.concatenate([zh, turn + hi[now] - zh])
            new_level = np.concatenate([level[now] + 1] * 2)
            new_prefix = np.concatenate([prefix[now] * 2, prefix[now] * 2 + 1])
            new_bound = np.where(new_lo < new_hi, self.impact[(new_level * self.stride)[:, None] + new_lo], 0) @ weights
            leaf = new_level == self.depth
            hit = leaf & (new_bound >= worst) & (new_bound > 0)
            if hit.any():
                found = list(zip((-new_bound[hit]).tolist(), self.ids[new_prefix[hit]].tolist(), strict=True))
                top = sorted(top + found)[: p.k]
            go = ~leaf & (new_bound > 0)
            lo, hi, level, prefix, bound = (np.concatenate([a[later], b[go]]) for a, b in ((lo, new_lo), (hi, new_hi), (level, new_level), (prefix, new_prefix), (bound, new_bound)))


BLOCK = pa.schema([("block", pa.int64()), ("item_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("terms", "item", "term", "qtf"))])


def query_blocks(queries: DataFrame, p: SearchParams) -> DataFrame:
    """One row a block of queries: its items' ids, its distinct terms, and (item, term, qtf) as three arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, terms, cells = TaskContext.get().partitionId() << 33, [], {}, []

        def batch() -> pa.RecordBatch:
            flat = np.array(cells, np.int64).reshape(-1, 3).T.astype("<i8")
            return pa.RecordBatch.from_pylist([{"block": number, "item_ids": ids, "terms": _packed(np.frombuffer(b"\n".join(terms), np.uint8)), **{c: _packed(x) for c, x in zip(("item", "term", "qtf"), flat, strict=True)}}], BLOCK)

        for b in batches:
            for item, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                counts = Counter(words(text))
                cells += [(len(ids), terms.setdefault(t, len(terms)), n) for t, n in counts.items()]
                ids.append(item)
                if len(cells) >= p.block_terms or len(ids) >= p.block_items:
                    yield batch()
                    number, ids, terms, cells = number + 1, [], {}, []
        if cells:
            yield batch()

    return queries.mapInArrow(run, _schema(BLOCK))


def _terms(blob: bytes) -> list[bytes]:
    text = _unpacked(blob, "u1").tobytes()
    return text.split(b"\n") if text else []


def weighted(block: DataFrame, forward: DataFrame, n_docs: int) -> DataFrame:
    """A block with weights, the weight of each of its terms by their document frequency over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1).to_pylist()[0]
                wanted = _terms(x["q_terms"])
                total = np.zeros(len(wanted), np.int64) if total is None else total
                own, df = {t: k for k, t in enumerate(_terms(x["terms"]))}, _unpacked(x["df"], "<i4")
                at = np.array([own.get(t, -1) for t in wanted], np.int64)
                total[at >= 0] += df[at[at >= 0]]
        if total is not None:
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["k", "df"])

    pairs = forward.select("terms", "df").crossJoin(F.broadcast(block.select(F.col("terms").alias("q_terms"))))
    df = pairs.mapInArrow(run, "k long, df long").groupBy("k").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    # A block's terms are bounded, so this one group is.
    return block.crossJoin(F.broadcast(df.select("k", w.alias("w")).agg(F.collect_list(F.struct("k", "w")).alias("weights"))))


ANSWER = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def answers(index: DataFrame, block: DataFrame, p: SearchParams) -> DataFrame:
    """item, item_id, doc_id and score: k answers at most of each item from each task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = None
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1).to_pylist()[0]
                if q is None:
                    wanted, w = _terms(x["q_terms"]), {r["k"]: r["w"] for r in x["weights"]}
                    item, term, qtf = (_unpacked(x[c], "<i8") for c in ("item", "term", "qtf"))
                    weight = np.array([w.get(k, 0) for k in range(len(wanted))], np.int64)[term] * qtf
                    cuts = np.searchsorted(item, np.arange(len(x["item_ids"]) + 1))
                    q, tops, first = (wanted, term, weight, cuts), [[] for _ in x["item_ids"]], (x["block"], x["item_ids"])
                wanted, term, weight, cuts = q
                own = {t: k for k, t in enumerate(_terms(x["terms"]))}
                at = np.array([own.get(t, -1) for t in wanted], np.int64)[term]
                del own
                tree = Tree(x)
                for n in range(len(tops)):
                    here, weights = at[cuts[n] : cuts[n + 1]], weight[cuts[n] : cuts[n + 1]]
                    use = (here >= 0) & (weights > 0)
                    if use.any():
                        tops[n] = tree.best(here[use], weights[use], tops[n], p)
        if q is not None:
            rows = [((first[0] << 20) + n, first[1][n], None if i == NO_ID else i, -s) for n, top in enumerate(tops) for s, i in top]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, ANSWER, strict=True)], schema=ANSWER)

    names = [F.col("terms").alias("q_terms"), "weights", "block", "item_ids", "item", "term", "qtf"]
    return index.select("terms", "df", "ids", "impacts", "bits").crossJoin(F.broadcast(block.select(*names))).mapInArrow(run, _schema(ANSWER))


def index(docs: DataFrame, p: SearchParams = SearchParams()) -> tuple[DataFrame, DataFrame, int]:
    """The index of docs (doc_id, text): shards of trees and shards of postings, both tables in the shared folder, and the
    number of documents."""
    forward = stored(shards(docs, p), "postings")
    n_docs, n_tokens = forward.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return stored(trees(forward, n_docs, n_tokens, p), "trees"), forward, n_docs


def search(docs: DataFrame, queries: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of docs (doc_id, text) for each row of queries (item_id, text)."""
    shard_trees, forward, n_docs = index(docs, p)
    blocks = stored(query_blocks(queries.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string")), p), "queries")
    found = None
    for r in blocks.select("block").orderBy("block").collect():  # a pass over the index a block, so no task meets two
        block = stored(weighted(blocks.where(F.col("block") == r["block"]), forward, n_docs), "weighted")
        some = answers(shard_trees, block, p)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = stored(found, "answers")
    release(shard_trees, forward, blocks)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.row_number().over(Window.partitionBy("item", "lot").orderBy(*order, F.col("tie")))
    # Answers of many tasks are cut to k in lots first, so that no task merges those of all.
    lots = found.withColumn("tie", F.monotonically_increasing_id()).withColumn("lot", F.pmod(F.xxhash64("tie"), F.lit(32))).withColumn("rank", part).where(F.col("rank") <= p.k).drop("rank")
    last = F.row_number().over(Window.partitionBy("item").orderBy(*order, F.col("tie")))
    return lots.withColumn("rank", last.cast("int")).where(F.col("rank") <= p.k).select("item_id", "rank", "doc_id", "score")
