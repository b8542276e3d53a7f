"""Removal of passages that repeat across documents, by per-shard suffix arrays.

A byte goes if it lies in a string of `length` bytes (a window) that also starts in a document with a smaller doc_id.

1. Documents are gathered into shards of bounded bytes, and each shard gets its suffix array (Larsson-Sadakane) and
   common prefixes (Kasai). Runs of suffixes that share `length` bytes are the shard's equal windows: a window goes if
   its run holds a smaller doc_id. What is left, the first window of each content in the shard, may still occur in
   another shard.
2. Each window has an anchor, the least hash of the k-byte strings in it, so equal windows have equal anchors. Anchors
   of the windows left meet by value; those of a single shard are dropped.
3. Windows of the other anchors go, with their bytes, to where their anchor is merged: the shards' windows become one
   sorted list, and every window finds its content's least doc_id there by binary search.
4. Each shard joins what was found, marks the covered bytes and hashes what is left.

A passage that thousands of documents share leaves a shard once, so groups grow with the shards, not with the copies.
Tables in the shared folder hold the shards (compressed); every other step is one shuffle. Memory is bounded by the
shard, or by the longest text if that is larger.

Defined results: a null text is empty; a row with a null doc_id comes after all others (as if its doc_id were the
largest long), so it is judged against every named document and removes nothing from them; rows with one doc_id are one
document, each judged by itself against smaller doc_ids; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semifold.llm.lineage import release, stored
from semifold.llm.suffixes import byte_words, common_prefixes, suffix_array

LAST = 2**63 - 1


@dataclass(frozen=True)
class SubstringParams:
    """shard_bytes: below 2**21, so that sort keys and row numbers fit one machine word. merge_rows: runs merged at once;
    hot_runs: anchors with more runs than this are merged window by window. length is at least 50, anchor at least 8."""

    length: int = 50
    anchor: int = 16
    shard_bytes: int = 1_900_000
    merge_rows: int = 20_000
    hot_runs: int = 20_000


@dataclass
class Shard:
    """Documents end to end: data, the ids, and where each document starts (with the end as the last)."""

    data: np.ndarray
    ids: np.ndarray
    starts: np.ndarray

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.starts))

    def inside(self, length: int) -> np.ndarray:
        """Whether a window from each byte stays within its document."""
        return np.arange(len(self.data)) + length <= np.repeat(self.starts[1:], np.diff(self.starts))


def repeated_windows(s: Shard, length: int) -> np.ndarray:
    """For each byte, whether the window from it also starts in a document of the shard with a smaller id."""
    n = len(s.data)
    gone = np.zeros(n, bool)
    if n < length:
        return gone
    sa, _, tied = suffix_array(s.data, length)
    shares = common_prefixes(s.data, sa, tied) >= length
    at = np.flatnonzero(shares | np.concatenate([shares[1:], [False]]))  # places in runs of two or more
    if not len(at):
        return gone
    inside, doc = s.inside(length)[sa[at]], s.ids[s.owner][sa[at]]
    heads = np.flatnonzero(~shares[at])
    least = np.minimum.reduceat(np.where(inside, doc, LAST), heads)
    gone[sa[at]] = inside & (np.repeat(least, np.diff(np.concatenate([heads, [len(at)]]))) < doc)
    return gone


def string_hashes(words: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the k-byte strings that start at the given places (default: at all), k at least 8; words: of byte_words."""
    n = len(words) - k + 1 if at is None else len(at)
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for off in [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]:
            h = (h ^ (words[off : off + len(h)] if at is None else words[at + off]).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def least_in_windows(h: np.ndarray, span: int) -> np.ndarray:
    """The least of each span values side by side."""
    if len(h) < span:
        return h[:0]
    size, low = 1, h
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - (span - size)], low[span - size :]) if size < span else low


def window_runs(s: Shard, gone: np.ndarray, p: SubstringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, where) of runs of windows that are left, lie side by side in one document and share an anchor; at
    most 64 windows a run. where: how far after the first window's start the anchor's string starts."""
    h = string_hashes(byte_words(s.data), p.anchor)
    span = p.length - p.anchor + 1
    low = least_in_windows(h, span)
    at = np.flatnonzero((~gone & s.inside(p.length))[: len(low)])
    if not len(at):
        return at, at, at
    low = low[at]
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (s.owner[at[1:]] != s.owner[at[:-1]])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - head) % 64 == 0
    heads = np.flatnonzero(new)
    first = at[heads]
    strings = np.lib.stride_tricks.sliding_window_view(h, span)  # a row for each window: its strings' hashes
    where = np.concatenate([(strings[first[k : k + 8192]] == low[heads[k : k + 8192], None]).argmax(axis=1) for k in range(0, len(first), 8192)])
    return first, np.diff(np.concatenate([heads, [len(at)]])), where


#: runs: the compressed byte planes of (distance from the run before as 32 bits, count, where) of window_runs.
SHARD = "shard long, text binary, ids array<long>, nulls array<int>, sizes array<int>, gone binary, runs binary, n_runs int"


def _planes(first: np.ndarray, count: np.ndarray, where: np.ndarray) -> bytes:
    steps = np.diff(np.concatenate([[0], first])).astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.vstack([steps.T, count[None].astype(np.uint8), where[None].astype(np.uint8)]).tobytes()


def _unpacked(blob: bytes, size: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(size, 1)), np.uint8)[:size]


def _open(row) -> Shard:
    starts = np.concatenate([[0], np.cumsum(np.asarray(row["sizes"], np.int64))]).astype(np.int64)
    return Shard(_unpacked(row["text"], int(starts[-1])), np.asarray(row["ids"], np.int64), starts)


def _open_runs(row, words: np.ndarray, p: SubstringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, count) of the shard's runs."""
    n = int(row["n_runs"])
    planes = _unpacked(row["runs"], 6 * n).reshape(6, n)
    first = np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel().astype(np.int64))
    return string_hashes(words, p.anchor, first + planes[5]).view(np.int64), first, planes[4].astype(np.int64)


def shards(docs: DataFrame, p: SubstringParams) -> DataFrame:
    """One row for each shard, with the bits of the windows that repeat within it and the runs of those left."""

    def closed(number: int, texts: list[bytes], ids: list) -> pd.DataFrame:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        sizes = [len(t) for t in texts]
        nulls = np.array([k for k, i in enumerate(ids) if i is None], np.int32)
        named = np.array([LAST if i is None else i for i in ids], np.int64)
        s = Shard(np.frombuffer(b"".join(texts), np.uint8), named, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        gone = repeated_windows(s, p.length)
        runs = window_runs(s, gone, p)
        row = {"shard": number, "text": pack(s.data.tobytes()), "ids": named, "nulls": nulls, "sizes": np.array(sizes, np.int32), "gone": pack(np.packbits(gone).tobytes()), "runs": pack(_planes(*runs)), "n_runs": len(runs[0])}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        texts, ids, size = [], [], 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].astype(object), pdf["text"], strict=True):
                t = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                if texts and size + len(t) > p.shard_bytes:
                    yield closed(number, texts, ids)
                    number, texts, ids, size = number + 1, [], [], 0
                texts.append(t)
                ids.append(None if doc is None or doc != doc else int(doc))
                size += len(t)
        if texts:
            yield closed(number, texts, ids)

    # The id goes as text beside its null flag: a nullable long would reach pandas as a rounded double.
    own = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string"))
    return own.mapInPandas(run, SHARD)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Batches sorted by key again, cut so that rows of one key stay together; at least `least` rows each but the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if rows >= least and batch.num_rows:
            k = batch.column(key).to_numpy()
            old = held[-1].column(key)[-1].as_py()
            more = int(np.searchsorted(k, old, "right"))  # how far the last key goes on
            if more < len(k):
                yield pa.Table.from_batches([*held, batch.slice(0, more)]).combine_chunks()
                held, rows, batch = [], 0, batch.slice(more)
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shared_anchors(found: DataFrame, p: SubstringParams) -> DataFrame:
    """anchor and shard for the anchors of windows left in two shards or more."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = np.unique(_open_runs(row, byte_words(_open(row).data), p)[0])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(np.full(len(low), row["shard"]))], ["anchor", "shard"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the sorted rows those whose anchor the row before or after has, too; one row is held back, not a group."""
        held, seen = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            a = both.column("anchor").to_numpy()
            more = np.concatenate([a[1:] == a[:-1], [False]])
            keep = more | np.concatenate([[seen], more[:-1]])
            seen = bool(keep[-1])
            yield from both.slice(0, len(a) - 1).filter(pa.array(keep[:-1])).to_batches()
            held = both.slice(len(a) - 1).to_batches()[0]
        if held is not None and seen:
            yield held

    # A shard lists an anchor once, so an anchor listed twice is in two shards.
    rows = found.select("shard", "text", "ids", "sizes", "runs", "n_runs").mapInArrow(listed, "anchor long, shard long")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(met, "anchor long, shard long")


def candidate_windows(found: DataFrame, shared: DataFrame, p: SubstringParams) -> DataFrame:
    """The runs of windows left at shared anchors, with their bytes."""

    def cut(key, s_rows: pd.DataFrame, a_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(s_rows) or not len(a_rows):
            return pd.DataFrame({"anchor": [], "shard": [], "first": [], "doc": [], "bytes": []})
        row = s_rows.iloc[0]
        s = _open(row)
        low, first, count = _open_runs(row, byte_words(s.data), p)
        wanted = np.sort(a_rows["anchor"].to_numpy())
        at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)] == low)
        data = s.data.tobytes()
        return pd.DataFrame({"anchor": low[at], "shard": row["shard"], "first": first[at], "doc": s.ids[s.owner[first[at]]], "bytes": [data[f : f + c + p.length - 1] for f, c in zip(first[at].tolist(), count[at].tolist(), strict=True)]})

    own = found.select("shard", "text", "ids", "sizes", "runs", "n_runs")
    return own.groupBy("shard").cogroup(shared.groupBy("shard")).applyInPandas(cut, "anchor long, shard long, first long, doc long, bytes binary")


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of words: each row's place in the sorted list of distinct rows, found by binary search over their hashes,
    and one row of each. Rows are compared in full: if two that differ had one hash, they would be sorted by themselves."""
    h = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            h = (h ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    merged, one = np.unique(h, return_index=True)
    place = np.searchsorted(merged, h)
    if (rows == rows[one[place]]).all():
        return place, one
    _, one, place = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return place.ravel(), one


def _least_by(place: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, LAST)
    np.minimum.at(out, place, doc)
    return out


def merge(anchor: np.ndarray, doc: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For runs of windows of whole anchors (run k is data[starts[k]:starts[k + 1]], below 65 windows): the bits of each
    run's windows that a smaller document has."""
    size = np.diff(starts) - length + 1
    words = byte_words(data)
    offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    at = lambda w: np.column_stack([words[w + o] for o in offsets]).astype(np.uint64)
    # Equal runs first: the first, middle and last window hold every byte of a run.
    base = starts[:-1]
    place, one = _classes(np.column_stack([*(at(base + x) for x in (0, (size - 1) // 2, size - 1)), size.astype(np.uint64)]))
    gone = _least_by(place, doc, len(one))[place] < doc  # an equal run of a smaller document: all its windows go
    full = (np.uint64(2) << (size - 1).astype(np.uint64)) - np.uint64(1)
    bits = np.where(gone, full, np.uint64(0))
    # Distinct runs that share an anchor may agree in part: their windows are merged one by one.
    which, n = np.unique(anchor[one], return_counts=True)
    own = np.flatnonzero(np.isin(anchor, which[n > 1]) & ~gone)
    if len(own):
        run = np.repeat(own, size[own])
        offset = np.arange(len(run)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        place, one = _classes(at(base[run] + offset))
        hit = _least_by(place, doc[run], len(one))[place] < doc[run]
        np.bitwise_or.at(bits, run[hit], np.uint64(1) << offset[hit].astype(np.uint64))
    return bits


def repeated_runs(runs: DataFrame, p: SubstringParams) -> DataFrame:
    """shard, first and bits: the windows of runs that a smaller document has, too.

    Runs meet by anchor. An anchor of more than hot_runs runs (a string shorter than a window that is everywhere) is no
    group: its windows are taken one by one, their least documents combine before the shuffle, and a join by the window,
    whose large side may be split, gives them back.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "anchor", p.merge_rows):
            blob = t.column("bytes").combine_chunks()
            blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
            _, ends, data = blob.buffers()
            starts = np.frombuffer(ends, np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
            data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]]
            bits = merge(t.column("anchor").to_numpy(), t.column("doc").to_numpy(), data, starts - starts[0], p.length)
            some = bits != 0
            yield pa.RecordBatch.from_arrays([pa.array(t.column("shard").to_numpy()[some]), pa.array(t.column("first").to_numpy()[some]), pa.array(bits[some].view(np.int64))], ["shard", "first", "bits"])

    hot = stored(runs.groupBy("anchor").count().where(F.col("count") > p.hot_runs).select("anchor"), "hot")
    grouped = runs.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    cold = grouped.mapInArrow(merged, "shard long, first long, bits long")
    step = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - p.length)).alias("step")
    lone = runs.join(hot, "anchor", "left_semi").select("shard", "first", "doc", "bytes", step)
    lone = lone.select("shard", (F.col("first") + F.col("step")).alias("first"), "doc", F.substring("bytes", F.col("step") + 1, F.lit(p.length)).alias("window"))
    least = lone.groupBy("window").agg(F.min("doc").alias("least"))
    return cold.union(lone.join(least, "window").where(F.col("least") < F.col("doc")).select("shard", "first", F.lit(1).cast("long").alias("bits")))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_bytes(s: Shard, gone: np.ndarray, length: int) -> np.ndarray:
    """Which bytes stay: those in no window that goes."""
    edge = np.zeros(len(s.data) + length + 1, np.int32)
    at = np.flatnonzero(gone)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge)[: len(s.data)] == 0


def digests(s: Shard, keep: np.ndarray, nulls) -> pd.DataFrame:
    cut = ~keep
    inner = np.concatenate([[False], cut[:-1]]) if len(cut) else cut
    inner[s.starts[:-1][s.starts[:-1] < len(cut)]] = False  # a span ends with its document
    heads = cut & ~inner
    out, unnamed = [], set(np.asarray(nulls).tolist())
    for k, doc in enumerate(s.ids.tolist()):
        a, b = int(s.starts[k]), int(s.starts[k + 1])
        part = keep[a:b]
        n = int(part.sum())
        raw = s.data[a:b] if n == b - a else s.data[a:b][part]
        out.append((None if k in unnamed else doc, b - a, b - a - n, int(heads[a:b].sum()), hashlib.sha256(raw.tobytes()).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def repeated_passages(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256: one row for each row of docs."""
    found = stored(shards(docs, p), "shards")
    shared = stored(shared_anchors(found, p), "anchors")
    runs = stored(candidate_windows(found, shared, p), "windows")

    release(shared)
    bits = stored(repeated_runs(runs, p), "repeats")
    release(runs)

    def finish(key, s_rows: pd.DataFrame, b_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(s_rows):
            return pd.DataFrame({c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")})
        row = s_rows.iloc[0]
        s = _open(row)
        gone = np.unpackbits(_unpacked(row["gone"], -(-len(s.data) // 8)))[: len(s.data)].astype(bool)
        first, mask = b_rows["first"].to_numpy(np.int64), b_rows["bits"].to_numpy(np.int64).view(np.uint64)
        for j in range(64):
            gone[first[(mask >> np.uint64(j)) & np.uint64(1) == 1] + j] = True
        return digests(s, kept_bytes(s, gone, p.length), row["nulls"])

    return found.select("shard", "text", "ids", "nulls", "sizes", "gone").groupBy("shard").cogroup(bits.groupBy("shard")).applyInPandas(finish, RESULT)
