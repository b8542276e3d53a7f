"""Exact duplicates by progressive refinement: length, then a hash of a bounded prefix, then a hash of the whole text.

Rows that could still equal another row survive to the next, dearer step:

1. byte lengths are counted; only lengths that two rows or more share go on;
2. of those rows a bounded prefix is hashed; only (length, prefix hash) pairs that two rows or more share go on;
3. of those rows alone the whole content is read and its SHA-256 makes the groups, together with the length.

Which lengths and pairs are shared is passed to the next step as a bitmap over their hashes. The bitmap's size follows the
number of shared keys up to a fixed limit, so it is broadcast at a known size; a bit that two keys have in common only lets
rows through that the next step drops. So texts are never shuffled: each step scans them where they lie, and what is
shuffled are counts (combined before the shuffle) and, at the end, rows of a digest and two numbers. A hot group (copies
of one text) is one row of the group side in the last join, whose large side adaptive execution splits.

Defined results: a null text counts as empty, and empty texts equal each other; of equal texts the row with the largest
doc_id stays, a null doc_id counts as smallest, and of rows that tie (repeated rows) one stays; keep_id is null where all
ids of a group are null; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semifold.llm.lineage import release, stored


@dataclass(frozen=True)
class ExactParams:
    """prefix: code points of the prefix. least_bits and most_bits: limits of a bitmap's size, as powers of two (the larger
    is 32 MB to broadcast). bits_a_key: the size aimed at."""

    prefix: int = 256
    least_bits: int = 16
    most_bits: int = 28
    bits_a_key: int = 16


def _length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _prefix_key(text: Column, p: ExactParams) -> Column:
    return F.xxhash64(_length(text), F.substring(text, 1, p.prefix))


def _bitmap(counted: DataFrame, p: ExactParams) -> tuple[DataFrame, int]:
    """word and bits: the bitmap over the hashes h of counted (h, n) with n over one, and the power of two of its size."""
    shared = counted.where("n > 1")
    keys = shared.count()
    size = min(p.most_bits, max(p.least_bits, (keys * p.bits_a_key).bit_length()))
    slot = F.pmod("h", F.lit(1 << size))
    return shared.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(h, 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), size


def _survives(df: DataFrame, h: Column, bitmap: DataFrame, size: int, name: str) -> DataFrame:
    """df with the boolean column name: whether the bit of h is set. The bitmap has 2**(size - 6) rows at most."""
    with_word = df.withColumn("word", F.shiftright(F.pmod(h, F.lit(1 << size)), 6)).join(F.broadcast(bitmap), "word", "left")
    hit = F.coalesce(F.getbit("bits", F.pmod(h, F.lit(64))) == 1, F.lit(False))  # 64 divides the size: the bit's place is h modulo 64
    return with_word.withColumn(name, hit).drop("word", "bits")


def exact_groups(docs: DataFrame, p: ExactParams = ExactParams(), digest_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, n_bytes and sha (binary), one row for each row of docs. sha is null for rows that
    no earlier step left a partner, unless digest_all asks for it."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    lengths = stored(rows.groupBy(_length(F.col("text")).alias("n_bytes")).agg(F.count("*").alias("n")).select(F.xxhash64("n_bytes").alias("h"), "n"), "lengths")
    by_length, length_size = _bitmap(lengths, p)
    same_length = _survives(rows, F.xxhash64(_length(F.col("text"))), by_length, length_size, "same_length")

    heads = stored(same_length.where("same_length").groupBy(_prefix_key(F.col("text"), p).alias("h")).agg(F.count("*").alias("n")), "prefixes")
    by_prefix, prefix_size = _bitmap(heads, p)
    prefix_key = F.when(F.col("same_length"), _prefix_key(F.col("text"), p)).otherwise(F.lit(0).cast("long"))
    probed = _survives(same_length, prefix_key, by_prefix, prefix_size, "same_prefix").withColumn("read", F.col("same_length") & F.col("same_prefix"))

    digest = F.unhex(F.sha2("text", 256))
    digested = stored(probed.select("doc_id", _length(F.col("text")).alias("n_bytes"), "read", (digest if digest_all else F.when(F.col("read"), digest)).alias("sha")), "digests")
    release(lengths, heads)

    marked = digested.withColumn("row", F.monotonically_increasing_id())
    read = marked.where("read")
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")).alias("best")
    # Stored, so that the join deals its two sides itself and can split the rows of a hot group.
    groups = stored(read.groupBy("n_bytes", "sha").agg(best, F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    found = read.join(groups, ["n_bytes", "sha"], "left")
    alone = F.col("group_size").isNull()
    in_groups = found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        "n_bytes",
        "sha",
    )
    single = marked.where("not read").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "n_bytes", "sha")
    return in_groups.unionByName(single)

