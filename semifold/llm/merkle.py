"""Merkle dataset manifest: hash trees over a table's rows by mountain ranges, with a proof for each row.

Rows are leaves, range-sorted by group and order; what is sorted is a digest and a key, never a text. A task of the range
sort numbers its rows within each group, and the few groups that go over a task's edge get their offset from one number a
task, so every leaf has its index in its group.

- **Stack.** A task passes over its leaves in order and keeps a mountain range: peaks by level, as a counter to the base of
  the fanout. Where the last child of a run arrives the run carries to the next level and a node record is emitted.
- **Merging.** Runs that a task's edge cuts (unaligned) and the short runs at a group's end are left as pending peaks. They
  meet by (group, level, parent), a run at a time, level by level; a short run is hashed as it is, without padding.
- The roots of the groups are the leaves of one more tree, built the same way.
- **Proofs.** Leaves meet in aligned cells of fanout ** cell_levels at most, together with the cell's path: the runs above
  it, up to its group's root and on to the root of all. No group and no task holds more than a cell, its path and a batch.

Defined results: null values hash as `-`; a null group sorts first and is a group of its own; null ids sort first in their
group; rows that tie in group and id are ordered by their hash, and equal rows each are a leaf; extra columns are not read;
an empty table has no nodes, no root and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semifold.llm.lineage import release, stored


@dataclass(frozen=True)
class MerkleParams:
    """fanout: children of a node. cell_levels: a cell of the proofs has fanout ** cell_levels leaves at most."""

    fanout: int = 3
    cell_levels: int = 6


@dataclass(frozen=True)
class Forest:
    """ranked: g, idx, h and the columns of the items. sizes: g, n, depth. nodes: g, level, idx, h of all inner nodes.
    roots: g, h. All are tables in the shared folder."""

    ranked: DataFrame
    sizes: DataFrame
    nodes: DataFrame
    roots: DataFrame


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf's hash: `-` if null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(group: Column) -> Column:
    """A string without null that sorts like the group, null first, byte by byte."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(" "))


def ranked(items: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """items (g, h, row and others) with idx, their place within g by order, then h; and the number of items of each g."""
    keys = [F.asc("g"), *map(F.asc_nulls_first, order), F.asc("h"), F.asc("row")]
    dealt = items.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            at = []
            for g in b.column("g").to_pylist():
                last, n = g, (n + 1 if g == last else 1)
                at.append(n - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "at"])

    schema = ", ".join(f"`{c}` {t}" for c, t in [*dealt.dtypes, ("at", "long")])
    local = stored(dealt.mapInArrow(number, schema), "ranked")
    counts = stored(local.groupBy("part", "g").agg(F.count("*").alias("n")), "counts")
    # Only a group that goes on from an earlier task has an offset, and only a task's first group can: a row a task at most.
    before = F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", before).where("before is not null").select("part", "g", "before")
    placed = local.join(F.broadcast(offsets), ["part", "g"], "left").withColumn("idx", F.col("at") + F.coalesce("before", F.lit(0).cast("long"))).drop("part", "at", "before")
    return placed, counts.groupBy("g").agg(F.sum("n").alias("n"))


class Range:
    """The mountain range of one run of consecutive nodes of a group, as far as it is complete within the task."""

    def __init__(self, fanout: int):
        self.fanout, self.peaks, self.records, self.pending = fanout, [], [], []

    def push(self, level: int, idx: int, h: str) -> None:
        while True:
            if level == len(self.peaks):
                self.peaks.append([])
            run = self.peaks[level]
            run.append((idx, h))
            if idx % self.fanout != self.fanout - 1:
                return
            self.peaks[level] = []
            if len(run) < self.fanout:  # its first children are in another task
                self.pending += [(level, i, x) for i, x in run]
                return
            level, idx, h = level + 1, idx // self.fanout, digest([x for _, x in run])
            self.records.append((level, idx, h))

    def close(self) -> None:
        self.pending += [(level, i, x) for level, run in enumerate(self.peaks) for i, x in run]
        self.peaks = []


def stacked(items: DataFrame, p: MerkleParams) -> DataFrame:
    """g, level, idx, h, pending: the nodes that tasks complete, and the peaks that wait for another task or a group's end."""
    schema = pa.schema([("g", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("h", pa.string()), ("pending", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, following, peaks = None, -1, Range(p.fanout)

        def emitted(out: list) -> None:
            out += [(group, *x, False) for x in peaks.records] + [(group, *x, True) for x in peaks.pending]
            peaks.records, peaks.pending = [], []

        for b in batches:
            out: list = []
            for g, idx, h in zip(*(b.column(c).to_pylist() for c in ("g", "idx", "h")), strict=True):
                if g != group or idx != following:
                    peaks.close()
                    emitted(out)
                    group = g
                peaks.push(0, idx, h)
                following = idx + 1
            emitted(out)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)
        out = []
        peaks.close()
        emitted(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return items.select("g", "idx", "h").mapInArrow(run, "g string, level int, idx long, h string, pending boolean")


def _depth(n: Column, fanout: int, most: int) -> Column:
    """Levels above n leaves: the least d with fanout ** d >= n."""
    return sum(((n > fanout**k).cast("int") for k in range(most)), F.lit(0))


def forest(items: DataFrame, order: list[str], p: MerkleParams = MerkleParams()) -> Forest:
    """The trees of all groups of items (g, h, row and others)."""
    placed, counted = ranked(items, order)
    placed = stored(placed, "leaves")
    largest = counted.agg(F.max("n")).first()[0] or 1
    most = 0
    while p.fanout**most < largest:
        most += 1
    sizes = stored(counted.withColumn("depth", _depth(F.col("n"), p.fanout, most)), "sizes")
    made = stored(stacked(placed, p), "nodes")
    waiting = stored(made.where("pending").select("g", "level", "idx", "h").join(sizes.select("g", "depth"), "g"), "pending")
    records, roots, carried, rounds = [made.where("not pending").select("g", "level", "idx", "h")], [], None, []
    for level in range(most + 1):
        now = waiting.where(F.col("level") == level).select("g", "idx", "h", "depth")
        now = now if carried is None else now.unionByName(carried)
        roots.append(now.where(F.col("depth") == level).select("g", "h"))
        if level == most:
            break
        run = F.array_sort(F.collect_list(F.struct("idx", "h")))
        runs = now.where(F.col("depth") > level).groupBy("g", "depth", F.expr(f"idx div {p.fanout}").alias("parent")).agg(run.alias("run"))
        rounds.append(carried := stored(runs.select("g", F.col("parent").alias("idx"), F.sha2(F.concat_ws("", F.col("run.h")), 256).alias("h"), "depth"), "merged"))
        records.append(carried.select("g", F.lit(level + 1).alias("level"), "idx", "h"))
    nodes, all_roots = records[0], roots[0]
    for x in records[1:]:
        nodes = nodes.unionByName(x)
    for x in roots[1:]:
        all_roots = all_roots.unionByName(x)
    made_of = Forest(placed, sizes, stored(nodes, "manifest"), stored(all_roots, "roots"))
    release(made, waiting, *rounds)
    return made_of


def paths(f: Forest, cell_levels: int, p: MerkleParams) -> DataFrame:
    """g, cell and path: for each aligned cell of fanout ** cell_levels leaves the runs above it, from the lowest, each as
    the cell's place in it (pos) and the hashes of its nodes (run)."""
    low = f.ranked.select("g", F.lit(0).alias("level"), "idx", "h") if cell_levels == 0 else None
    high = f.nodes.where(F.col("level") >= cell_levels)
    high = high if low is None else high.unionByName(low)
    runs = high.groupBy("g", "level", F.expr(f"idx div {p.fanout}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("run")).select("g", "level", "parent", F.col("run.h").alias("run"))
    cells = high.where(F.col("level") == cell_levels).select("g", F.col("idx").alias("cell")).unionByName(f.sizes.where(F.col("depth") < cell_levels).select("g", F.lit(0).cast("long").alias("cell")))
    over = cells.join(f.sizes.where(F.col("depth") > cell_levels), "g").withColumn("level", F.explode(F.sequence(F.lit(cell_levels), F.col("depth") - 1)))
    over = over.withColumn("at", F.expr(f"cell div cast(pow({p.fanout}, level - {cell_levels}) as long)"))
    over = over.select("g", "cell", "level", (F.col("at") % p.fanout).cast("int").alias("pos"), F.expr(f"at div {p.fanout}").alias("parent"))
    path = F.array_sort(F.collect_list(F.struct("level", "pos", "run")))
    found = over.join(runs, ["g", "level", "parent"]).groupBy("g", "cell").agg(path.alias("path"))
    step = "array<struct<level:int,pos:int,run:array<string>>>"
    return cells.join(found, ["g", "cell"], "left").select("g", "cell", F.coalesce(F.col("path").cast(step), F.array().cast(step)).alias("path"))


def manifest(items: DataFrame, order: list[str], p: MerkleParams = MerkleParams()) -> tuple[Forest, Forest]:
    """The trees of the groups of items (g, h, row and others) and the tree over their roots."""
    groups = forest(items, order, p)
    tops = forest(groups.roots.select(F.lit("").alias("g"), "h", F.col("g").alias("name"), F.lit(0).cast("long").alias("row")), ["name"], p)
    return groups, tops


def proofs(groups: Forest, tops: Forest, p: MerkleParams = MerkleParams()) -> DataFrame:
    """Of each leaf: id, h, subroot, root, siblings (the hashes beside it, from its own level up to the root) and folded, the
    root that the leaf presented (h where that is null) gives with these siblings."""
    top_path = paths(tops, 0, p).join(tops.ranked.select("g", F.col("idx").alias("cell"), "name"), ["g", "cell"]).join(tops.roots.select("g", F.col("h").alias("root")), "g")
    top_path = stored(top_path.select(F.col("name").alias("g"), F.col("path").alias("above"), "root"), "top_paths")
    size = p.fanout**p.cell_levels
    cells = stored(paths(groups, p.cell_levels, p), "cells").join(groups.sizes, "g").join(groups.roots.withColumnRenamed("h", "subroot"), "g").join(top_path, "g")
    step = lambda s: F.struct(s["pos"].alias("pos"), s["run"].alias("run"))
    first = stored(cells.select(
        "g", "cell", F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("presented"),
        F.least(F.col("depth"), F.lit(p.cell_levels)).alias("levels"), F.transform(F.concat("path", "above"), step).alias("path"), "subroot", "root",
    ), "paths")
    null = {"levels": "int", "path": "array<struct<pos:int,run:array<string>>>", "subroot": "string", "root": "string"}
    leaves = groups.ranked.select("g", F.expr(f"idx div {size}").alias("cell"), "idx", "id", "h", "presented", *(F.lit(None).cast(t).alias(c) for c, t in null.items()))
    both = first.unionByName(leaves).repartition("g", "cell").sortWithinPartitions("g", "cell", "idx")
    schema = pa.schema([("id", pa.int64()), ("h", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("siblings", pa.list_(pa.string())), ("folded", pa.string())])

    def cell_proofs(head: dict, leaves: list[dict]) -> list[tuple]:
        levels, k = [[x["h"] for x in leaves]], p.fanout
        for _ in range(head["levels"]):
            below = levels[-1]
            levels.append([digest(below[i : i + k]) for i in range(0, len(below), k)])
        path, out = [(x["pos"], x["run"]) for x in head["path"]], []
        for i, leaf in enumerate(leaves):
            beside, now = [], leaf["presented"] or leaf["h"]
            own, at = [], i
            for below in levels[:-1]:
                first = at // k * k
                own.append((at - first, below[first : first + k]))
                at //= k
            for pos, run in [*own, *path]:
                left, right = run[:pos], run[pos + 1 :]
                beside += left + right
                now = digest([*left, now, *right])
            out.append((leaf["id"], leaf["h"], head["subroot"], head["root"], beside, now))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, leaves, out = None, [], []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                for x in b.slice(lo, 2048).to_pylist():
                    if x["idx"] < 0:
                        out += cell_proofs(head, leaves) if leaves else []
                        head, leaves = x, []
                        if len(out) >= 2048:
                            yield batch(out)
                            out = []
                    else:
                        leaves.append(x)
        out += cell_proofs(head, leaves) if leaves else []
        if out:
            yield batch(out)

    return both.mapInArrow(run, "id long, h string, subroot string, root string, siblings array<string>, folded string")


def document_leaves(docs: DataFrame, presented_text: Column | None = None, where: Column | None = None) -> DataFrame:
    """The leaves of a documents table: row, id, g, h, and presented, the hash with presented_text where `where` holds."""
    named = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    cut = docs.select("doc_id", "source", "lang", "n_chars", "text")
    shown = F.lit(None).cast("string") if presented_text is None else F.when(where & F.col("text").isNotNull(), leaf_hash(*named, presented_text))
    made = cut.select(F.col("doc_id").cast("long").alias("id"), group_key(F.col("source")).alias("g"), leaf_hash(*named, F.col("text")).alias("h"), shown.alias("presented"))
    return stored(made, "hashed").withColumn("row", F.monotonically_increasing_id())


def verify(docs: DataFrame, presented_text: Column | None = None, where: Column | None = None, p: MerkleParams = MerkleParams()) -> DataFrame:
    """Proofs of all rows of docs (doc_id, source, lang, n_chars, text), a tree a source by doc_id, each checked against
    presented_text in the place of text, where `where` holds."""
    leaves = document_leaves(docs, presented_text, where)
    groups, tops = manifest(leaves, ["id"], p)
    return proofs(groups, tops, p)
