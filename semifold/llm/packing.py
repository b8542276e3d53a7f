"""Packing documents into fixed-length token sequences in space-filling-curve order.

Each document's tokens are hashed into a count vector, projected to a few dimensions by fixed random directions and
placed on a Hilbert curve. Documents are range-sorted by their Hilbert key, and the stream of their tokens along the
curve is cut into sequences, so neighbours on the curve share sequences and only the last sequence is short.

Tokens are written once to a table in the shared folder (two bytes an id, compressed by row). Only row numbers, keys and
lengths are range-sorted; the running sums of the partitions, one number for each partition, give every document its
place in the stream, and the places meet the tokens again by row number. No task holds more than a partition, and copies
of one document, whose keys tie, are split over partitions by a hash of their row.

Defined results: a null text is empty and has the end id alone; repeated rows (and rows with a null doc_id) are packed
each for itself; extra columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semifold.llm.lineage import stored

#: The byte-level pattern that the vocabulary was made with, and its one special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}
#: What the pattern's \s stands for (Unicode White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space that the pattern's lookahead would go through step by step.
LONG_SPACE = re.compile(f"[{SPACES}]{{4096,}}")


@dataclass(frozen=True)
class PackParams:
    """ranks: path of the vocabulary as ranks (base64 token and id in each line); the same ids as its JSON form gives."""

    ranks: str
    length: int = 2048
    end_id: int = 1
    buckets: int = 256
    dims: int = 4
    bits: int = 8
    seed: int = 11
    level: int = 3


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The encoding of a rank file, made once in each worker process."""
    import tiktoken

    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[path]


def encode_plain(enc, text: str) -> list[int]:
    """The ids of a text without special strings.

    A long run of white space is taken out of the pattern's hands, whose lookahead keeps a step of each sign: all of the
    run but its last sign (all, at the end) is one piece of the pattern, and what follows starts a new one.
    """
    at, ids = 0, []
    for m in LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += enc.encode_ordinary(text[at : m.start()])
        ids += enc._encode_single_piece(text[m.start() : end])
        at = end
    return ids + enc.encode_ordinary(text[at:])


def encode(enc, text: str) -> list[int]:
    ((special, special_id),) = SPECIAL.items()
    first, *rest = text.split(special)
    ids = encode_plain(enc, first)
    for part in rest:
        ids += [special_id, *encode_plain(enc, part)]
    return ids


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of points (n x dims of integers below 2**bits), by Gray-code transposition."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(dims):
            set_ = (x[i] & level) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _normal_cdf(y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-1.702 * y))


def curve_keys(ids: list[np.ndarray], p: PackParams) -> np.ndarray:
    """Hilbert keys of documents given as arrays of ids, none of them empty."""
    rng = np.random.default_rng(p.seed)
    directions = rng.standard_normal((p.buckets, p.dims))
    flat = np.concatenate(ids).astype(np.uint64)
    mixed = (flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    sign = np.where(mixed & np.uint64(1), 1.0, -1.0)
    counts = np.bincount(doc * p.buckets + ((mixed >> np.uint64(1)) % np.uint64(p.buckets)).astype(np.int64), weights=sign, minlength=len(ids) * p.buckets).reshape(len(ids), -1)
    unit = counts / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1e-12)
    cells = np.clip((_normal_cdf(unit @ directions) * (1 << p.bits)).astype(np.int64), 0, (1 << p.bits) - 1)
    return hilbert_key(cells, p.bits)


def tokenised(docs: DataFrame, p: PackParams) -> DataFrame:
    """row, doc_id, n (ids with the end id), key and ids (compressed 16- or 32-bit little-endian numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        enc, pack = encoder(p.ranks), zstandard.ZstdCompressor(level=p.level)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                ids = [np.array([*encode(enc, t.as_py() or ""), p.end_id], dtype="<u2" if enc.max_token_value < 65536 else "<u4") for t in part.column("text")]
                columns = [pa.array(row + np.arange(len(ids))), part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(curve_keys(ids, p)), pa.array([pack.compress(x.tobytes()) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "key", "ids"])
                row += len(ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, doc_id long, n long, key long, ids binary")


def placed(tokens: DataFrame) -> DataFrame:
    """row and at (the number of ids before it in the stream along the curve)."""

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = 0
        for pdf in batches:
            total = pdf["n"].cumsum()
            yield pd.DataFrame({"row": pdf["row"], "part": pdf["part"], "n": pdf["n"], "before": before + total - pdf["n"]})
            before += int(total.iloc[-1]) if len(pdf) else 0

    light = tokens.select("row", "n", "key", F.xxhash64("row").alias("tie"))
    in_order = light.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").withColumn("part", F.spark_partition_id())
    runs = stored(in_order.mapInPandas(running, "row long, part int, n long, before long"), "runs")
    # One number for each partition of the range sort, not for each document.
    totals = runs.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, starts = 0, {}
    for r in totals:
        starts[r["part"]] = base
        base += r["n"]
    rows = [(k, v) for k, v in starts.items()]
    bases = runs.sparkSession.createDataFrame(rows, "part int, base long")
    return runs.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("before")).alias("at"))


def pack(docs: DataFrame, p: PackParams) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    tokens = stored(tokenised(docs, p), "tokens")

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc, n, packed, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at")), strict=True):
                raw = unpack.decompress(packed)
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype("<u4")
                lo = 0
                while lo < n:
                    offset = (at + lo) % p.length
                    size = min(n - lo, p.length - offset)
                    out.append((doc, lo, size, zlib.crc32(ids[lo : lo + size].tobytes()), n, (at + lo) // p.length, offset))
                    lo += size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)

    schema = ", ".join(f"{c} long" for c in names)
    return tokens.select("row", "doc_id", "n", "ids").join(placed(tokens), "row").select("doc_id", "n", "ids", "at").mapInArrow(cut_pieces, schema)
