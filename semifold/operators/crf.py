"""Conditional random fields over chains and trees: models of labels given features, whose normaliser differs row by row.

The data stays in Spark: each evaluation of the objective is one pass of Arrow batches over a stored table, in which a task
adds up its rows' log-likelihoods and gradients, and one aggregate over the tasks. The parameters are a short vector on the
driver, where a minimiser of `optimize` moves it. Both fields learn by likelihood or by pseudo-likelihood (each label given
its neighbours' labels), with an L2 penalty on all parameters.

- ChainField: sequences of any length with shared weights. Sequences are stored in blocks of bounded length. A block's sums
  over its inner labels are a matrix from the label before it to its last label; a scan over these matrices gives each
  block what comes in from either side, and within a block forward and backward sums finish the work. A sequence that
  holds a third of all rows is many blocks, so no task holds a sequence.
- TreeField: rows of the same few labels, joined by a tree; sums go up and down the tree for a whole batch of rows at once.

Null labels and null or missing features raise an error when the table is stored. Labels are numbers from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semifold.operators.lineage import kept
from semifold.operators.optimize import Objective, Options, minimise


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def _summed(df: DataFrame, size: int, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """part(batches), a vector, added up over all tasks of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = part(batches)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k])], names=["k", "x"])

    out = np.zeros(size)
    for r in df.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():  # at most size rows
        out[r["k"]] = r["x"]
    return out


def _checked(column: Column, what: str) -> Column:
    return F.when(column.isNotNull(), column).otherwise(F.raise_error(F.lit(f"{what} is null")))


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return np.asarray(batch.column(name).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


@dataclass
class Lot:
    """Blocks side by side, padded to the longest: rows of the batch, lengths, where steps are, labels, features, label
    scores (e) and the table of moves."""

    rows: np.ndarray
    size: np.ndarray
    here: np.ndarray
    y: np.ndarray
    x: np.ndarray
    e: np.ndarray
    moves: np.ndarray

    def sums(self, come: list, go: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums of each step, and the sequence's log normaliser."""
        zero = np.zeros(self.e.shape[2])
        first = [zero if come[k] is None else log_sum(np.array(come[k])[:, None] + self.moves, 0) for k in self.rows.tolist()]
        end = np.array([zero if go[k] is None else go[k] for k in self.rows.tolist()])
        alpha, beta = np.empty(self.e.shape), np.empty(self.e.shape)
        alpha[:, 0] = first + self.e[:, 0]
        for i in range(1, self.e.shape[1]):
            alpha[:, i] = np.where(self.here[:, i, None], log_sum(alpha[:, i - 1, :, None] + self.moves, 1) + self.e[:, i], alpha[:, i - 1])
        beta[:, -1] = end
        for i in range(self.e.shape[1] - 2, -1, -1):
            beta[:, i] = np.where(self.here[:, i + 1, None], log_sum(self.moves + (self.e[:, i + 1] + beta[:, i + 1])[:, None], 2), end)
        return alpha, beta, log_sum(alpha[:, -1] + end, 1)


@dataclass
class ChainField:
    """labels: their number; features: of each step. weights: features x labels; moves: label x next label."""

    labels: int
    features: int
    block: int = 1024
    theta: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.theta is None:
            self.theta = np.zeros(self.features * self.labels + self.labels**2)

    def split(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.features * self.labels
        return theta[:cut].reshape(self.features, self.labels), theta[cut:].reshape(self.labels, self.labels)

    def store(self, df: DataFrame, sequence: str, order: str, label: str, features: list[Column]) -> DataFrame:
        """Blocks of the sequences of df: seq, block, blocks, y and x (flat), and the labels before and after the block. order
        numbers a sequence's steps from 0 without gaps."""
        x = [_checked(f.cast("double"), "a feature") for f in features]
        step = F.struct(F.col(order).alias("i"), _checked(F.col(label), "a label").cast("int").alias("y"), F.array(*x).alias("x"))
        rows = df.select(F.col(sequence).alias("seq"), F.expr(f"cast({order} div {self.block} as long)").alias("block"), step.alias("s"))
        whole = rows.groupBy("seq", "block").agg(F.array_sort(F.collect_list("s")).alias("s"))  # a block of bounded length
        blocks = kept(whole.select("seq", "block", F.col("s.y").alias("y"), F.flatten("s.x").alias("x")))
        ends = blocks.select("seq", "block", F.element_at("y", 1).alias("first"), F.element_at("y", -1).alias("last"))
        before = ends.select("seq", (F.col("block") + 1).alias("block"), F.col("last").alias("before"))
        after = ends.select("seq", (F.col("block") - 1).alias("block"), F.col("first").alias("after"))
        sizes = ends.groupBy("seq").agg(F.count("*").alias("blocks"))
        return kept(blocks.join(before, ["seq", "block"], "left").join(after, ["seq", "block"], "left").join(sizes, "seq"))

    def _lots(self, batch: pa.RecordBatch, theta: np.ndarray, cells: int = 1 << 16) -> Iterator[Lot]:
        """The blocks of a batch, those of like length side by side, as many at a time as fill cells."""
        w, t = self.split(theta)
        size = np.array([len(y) for y in batch.column("y")], int)
        order, lo = np.argsort(size, kind="stable"), 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= cells:
                hi += 1
            rows, lo = order[lo:hi], hi
            most = int(size[rows].max())
            y, x = np.zeros((len(rows), most), int), np.zeros((len(rows), most, self.features))
            for j, k in enumerate(rows.tolist()):
                y[j, : size[k]] = batch.column("y")[k].values.to_numpy(zero_copy_only=False)
                x[j, : size[k]] = np.reshape(batch.column("x")[k].values.to_numpy(zero_copy_only=False), (-1, self.features))
            yield Lot(rows, size[rows], np.arange(most)[None] < size[rows][:, None], y, x, x @ w, t)

    @staticmethod
    def several(blocks: DataFrame) -> bool:
        """Whether any sequence has more than one block."""
        return blocks.where("blocks > 1").limit(1).count() > 0

    def _sides(self, blocks: DataFrame, theta: np.ndarray, several: bool) -> DataFrame:
        """blocks with come and go: what is summed over all steps before and after the block, by the neighbour's label; null
        at a sequence's ends."""
        if not several:
            return blocks.withColumns({c: F.lit(None).cast("array<double>") for c in ("come", "go")})
        n, listed = self.labels, pa.list_(pa.float64())

        def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, first = [None] * b.num_rows, [None] * b.num_rows
                for lot in self._lots(b, theta):
                    way, start = lot.moves[None] + lot.e[:, 0][:, None, :], lot.e[:, 0]
                    for i in range(1, lot.e.shape[1]):
                        here, step = lot.here[:, i], lot.moves[None] + lot.e[:, i][:, None, :]
                        way = np.where(here[:, None, None], log_sum(way[:, :, :, None] + step[:, None], 2), way)
                        start = np.where(here[:, None], log_sum(start[:, :, None] + step, 1), start)
                    for j, k in enumerate(lot.rows.tolist()):
                        m[k], first[k] = way[j].ravel().tolist(), start[j].tolist()
                yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("block"), pa.array(m, listed), pa.array(first, listed)], names=["seq", "block", "m", "first"])

        def scan(rows):
            rows = rows.sort_values("block")
            ms = [np.array(m).reshape(n, n) for m in rows["m"]]
            come, go = [None] * len(ms), [None] * len(ms)
            for k in range(1, len(ms)):
                come[k] = np.array(rows["first"].iloc[0]) if k == 1 else log_sum(come[k - 1][:, None] + ms[k - 1], 0)
            for k in reversed(range(len(ms) - 1)):  # from this block's last label on
                go[k] = log_sum(ms[k + 1] + (0 if go[k + 1] is None else go[k + 1]), 1)
            return rows[["seq", "block"]].assign(come=come, go=go)

        kind = dict(blocks.dtypes)["seq"]
        made = blocks.where("blocks > 1").select("seq", "block", "y", "x").mapInArrow(matrices, f"seq {kind}, block long, m array<double>, first array<double>")
        # One row of labels ** 2 numbers for each block: a sequence of 1e9 steps is a million of them.
        sides = made.groupBy("seq").applyInPandas(scan, f"seq {kind}, block long, come array<double>, go array<double>")
        return blocks.join(sides, ["seq", "block"], "left")

    def expectations(self, blocks: DataFrame, theta: np.ndarray, several: bool | None = None) -> np.ndarray:
        """Log-likelihood, number of steps, observed and expected counts of all parameters. several: as several() says."""
        n, size = self.labels, len(theta)

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            ll, steps = 0.0, 0
            seen, hoped = np.zeros(size), np.zeros(size)
            for b in batches:
                come, go, before = (b.column(c).to_pylist() for c in ("come", "go", "before"))
                for lot in self._lots(b, theta):
                    alpha, beta, z = lot.sums(come, go)
                    node = np.exp(alpha + beta - z[:, None, None]) * lot.here[:, :, None]
                    pair = lot.here[:, 1:, None, None]
                    edge = (np.exp(np.where(pair, alpha[:, :-1, :, None] + lot.moves + (lot.e + beta)[:, 1:, None] - z[:, None, None, None], -np.inf))).sum(axis=(0, 1))
                    one = np.eye(n)[lot.y] * lot.here[:, :, None]
                    pairs = np.einsum("bia,bic->ac", one[:, :-1], one[:, 1:])
                    ll += float((one * lot.e).sum())
                    for j, k in enumerate(lot.rows.tolist()):
                        if come[k] is None:
                            ll -= float(z[j])
                        else:  # the step into the block counts with it
                            edge += np.exp(np.array(come[k])[:, None] + lot.moves + (lot.e[j, 0] + beta[j, 0])[None] - z[j])
                            pairs[before[k], lot.y[j, 0]] += 1
                    ll += float((pairs * lot.moves).sum())
                    seen += np.concatenate([np.einsum("bif,bik->fk", lot.x, one).ravel(), pairs.ravel()])
                    hoped += np.concatenate([np.einsum("bif,bik->fk", lot.x, node).ravel(), edge.ravel()])
                    steps += int(lot.size.sum())
            return np.concatenate([[ll, steps], seen, hoped])

        table = self._sides(blocks, theta, self.several(blocks) if several is None else several)
        return _summed(table.select("y", "x", "come", "go", "before"), 2 + 2 * size, part)

    def pseudo(self, blocks: DataFrame, theta: np.ndarray) -> np.ndarray:
        """The same for the pseudo-likelihood: labels given their neighbours' labels."""
        n, size = self.labels, len(theta)

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            ll, steps, seen, hoped = 0.0, 0, np.zeros(size), np.zeros(size)
            for b in batches:
                before, after = (b.column(c).to_pylist() for c in ("before", "after"))
                for lot in self._lots(b, theta):
                    into, out = np.vstack([lot.moves, np.zeros(n)]), np.vstack([lot.moves.T, np.zeros(n)])  # the last row: no neighbour
                    left, right = np.full(lot.y.shape, n), np.full(lot.y.shape, n)
                    left[:, 1:] = lot.y[:, :-1]
                    right[:, :-1] = np.where(lot.here[:, 1:], lot.y[:, 1:], n)
                    for j, k in enumerate(lot.rows.tolist()):
                        left[j, 0] = n if before[k] is None else before[k]
                        right[j, lot.size[j] - 1] = n if after[k] is None else after[k]
                    e, x, y, left, right = (a[lot.here] for a in (lot.e, lot.x, lot.y, left, right))
                    s = e + into[left] + out[right]
                    log_p = s - log_sum(s, 1)[:, None]
                    ll += float(log_p[np.arange(len(y)), y].sum())
                    for total, share in ((seen, np.eye(n)[y]), (hoped, np.exp(log_p))):
                        moves, back = np.zeros((n + 1, n)), np.zeros((n + 1, n))
                        np.add.at(moves, left, share)
                        np.add.at(back, right, share)
                        total += np.concatenate([(x.T @ share).ravel(), (moves[:n] + back[:n].T).ravel()])
                    steps += len(y)
            return np.concatenate([[ll, steps], seen, hoped])

        return _summed(blocks.select("y", "x", "before", "after"), 2 + 2 * size, part)

    def objective(self, blocks: DataFrame, l2: float = 0.0, pseudo: bool = False) -> Objective:
        several = not pseudo and self.several(blocks)
        return _objective(self.pseudo if pseudo else lambda table, theta: self.expectations(table, theta, several), blocks, l2)

    def fit(self, blocks: DataFrame, l2: float = 0.0, pseudo: bool = False, options: Options = Options()) -> ChainField:
        return ChainField(self.labels, self.features, self.block, minimise(self.objective(blocks, l2, pseudo), self.theta.copy(), options=options))

    def decode(self, blocks: DataFrame) -> DataFrame:
        """seq, step, y and best: for each step the label of the largest marginal probability."""
        theta, size = self.theta, self.block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                come, go, at = (b.column(c).to_pylist() for c in ("come", "go", "block"))
                for lot in self._lots(b, theta):
                    alpha, beta, _ = lot.sums(come, go)
                    rows = np.repeat(lot.rows, lot.size)
                    steps = np.repeat([at[k] * size for k in lot.rows.tolist()], lot.size) + np.nonzero(lot.here)[1]
                    best = (alpha + beta).argmax(axis=2)[lot.here]
                    yield pa.RecordBatch.from_arrays([b.column("seq").take(pa.array(rows)), pa.array(steps, pa.int64()), pa.array(lot.y[lot.here], pa.int32()), pa.array(best, pa.int32())], names=["seq", "step", "y", "best"])

        table = self._sides(blocks, theta, self.several(blocks)).select("seq", "block", "y", "x", "come", "go")
        return table.mapInArrow(run, f"seq {dict(blocks.dtypes)['seq']}, step long, y int, best int")


def _objective(counts, table: DataFrame, l2: float) -> Objective:
    """Mean negative log-likelihood with the penalty, and its gradient: expected less observed counts."""

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        out, size = counts(table, theta), len(theta)
        n = max(out[1], 1.0)
        return -out[0] / n + l2 / 2 * float(theta @ theta), (out[2 + size :] - out[2 : 2 + size]) / n + l2 * theta

    return value


@dataclass
class TreeField:
    """sizes: labels of each output; edges: (parent, child) of a forest over the outputs, parents before their children as
    children of others; features: of a row, shared by all outputs."""

    sizes: tuple[int, ...]
    edges: tuple[tuple[int, int], ...]
    features: int
    theta: np.ndarray = field(default=None)

    def __post_init__(self):
        children = [c for _, c in self.edges]
        if len(set(children)) < len(children) or any(p in children[k:] for k, (p, _) in enumerate(self.edges)):
            raise ValueError("the edges must be a forest, each parent before its children")
        if self.theta is None:
            self.theta = np.zeros(self.features * sum(self.sizes) + sum(self.sizes[a] * self.sizes[b] for a, b in self.edges))

    def split(self, theta: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A features x labels matrix of each output, and a table of each edge."""
        shapes = [(self.features, n) for n in self.sizes] + [(self.sizes[a], self.sizes[b]) for a, b in self.edges]
        cuts = np.cumsum([a * b for a, b in shapes])[:-1]
        parts = [x.reshape(s) for x, s in zip(np.split(theta, cuts), shapes, strict=True)]
        return parts[: len(self.sizes)], parts[len(self.sizes) :]

    def store(self, df: DataFrame, labels: list[str], features: list[Column]) -> DataFrame:
        y = F.array(*(_checked(F.col(c), "a label").cast("int") for c in labels))
        return kept(df.select(y.alias("y"), F.array(*(_checked(f.cast("double"), "a feature") for f in features)).alias("x")))

    def _marginals(self, e: list[np.ndarray], tables: list[np.ndarray], fold=log_sum) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each row: log normaliser, log marginals of outputs and of edges, by sums up and down the tree."""
        inside, up = [x.copy() for x in e], [None] * len(self.edges)
        for k in reversed(range(len(self.edges))):
            a, b = self.edges[k]
            up[k] = fold(tables[k][None] + inside[b][:, None, :], 2)
            inside[a] = inside[a] + up[k]
        roots = [v for v in range(len(self.sizes)) if v not in {b for _, b in self.edges}]
        z = sum(log_sum(inside[v], 1) for v in roots)
        outside, pair = [np.zeros_like(x) for x in e], [None] * len(self.edges)
        for k, (a, b) in enumerate(self.edges):
            above = outside[a] + inside[a] - up[k]
            outside[b] = fold(above[:, :, None] + tables[k][None], 1)
            pair[k] = above[:, :, None] + tables[k][None] + inside[b][:, None, :]
        node = [i + o for i, o in zip(inside, outside, strict=True)]
        own = [x - log_sum(x, 1)[:, None] for x in node]
        pair = [p - log_sum(p.reshape(len(p), -1), 1)[:, None, None] for p in pair]
        return z, own, pair

    def _counts(self, table: DataFrame, theta: np.ndarray, pseudo: bool) -> np.ndarray:
        size, (ws, tables) = len(theta), self.split(theta)
        eyes = [np.eye(n) for n in self.sizes]

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            ll, rows, seen, hoped = 0.0, 0, np.zeros(size), np.zeros(size)
            for b in batches:
                if not b.num_rows:
                    continue
                y, x = _matrix(b, "y", len(self.sizes)).astype(int), _matrix(b, "x", self.features)
                e, at = [x @ w for w in ws], np.arange(len(x))
                one = [eyes[v][y[:, v]] for v in range(len(ws))]
                rows += len(x)
                if not pseudo:
                    z, node, pair = self._marginals(e, tables)
                    ll += float(sum(e[v][at, y[:, v]].sum() for v in range(len(ws))) + sum(t[y[:, a], y[:, c]].sum() for t, (a, c) in zip(tables, self.edges, strict=True)) - z.sum())
                    seen += np.concatenate([*((x.T @ o).ravel() for o in one), *((one[a].T @ one[c]).ravel() for a, c in self.edges)])
                    hoped += np.concatenate([*((x.T @ np.exp(m)).ravel() for m in node), *(np.exp(p).sum(axis=0).ravel() for p in pair)])
                    continue
                got, want = [np.zeros_like(t) for t in tables], [np.zeros_like(t) for t in tables]
                own, wish = [], []
                for v in range(len(ws)):
                    s = e[v].copy()
                    near = [(k, a, c) for k, (a, c) in enumerate(self.edges) if v in (a, c)]
                    for k, a, c in near:
                        s += tables[k][y[:, a]] if c == v else tables[k].T[y[:, c]]
                    log_p = s - log_sum(s, 1)[:, None]
                    ll += float(log_p[at, y[:, v]].sum())
                    share = np.exp(log_p)
                    own.append((x.T @ one[v]).ravel())
                    wish.append((x.T @ share).ravel())
                    for k, a, c in near:
                        got[k] += one[a].T @ one[c]
                        want[k] += one[a].T @ share if c == v else share.T @ one[c]
                seen += np.concatenate([*own, *(g.ravel() for g in got)])
                hoped += np.concatenate([*wish, *(g.ravel() for g in want)])
            return np.concatenate([[ll, rows], seen, hoped])

        return _summed(table, 2 + 2 * size, part)

    def expectations(self, table: DataFrame, theta: np.ndarray) -> np.ndarray:
        """Log-likelihood, number of rows, observed and expected counts of all parameters."""
        return self._counts(table, theta, False)

    def pseudo(self, table: DataFrame, theta: np.ndarray) -> np.ndarray:
        return self._counts(table, theta, True)

    def objective(self, table: DataFrame, l2: float = 0.0, pseudo: bool = False) -> Objective:
        return _objective(self.pseudo if pseudo else self.expectations, table, l2)

    def fit(self, table: DataFrame, l2: float = 0.0, pseudo: bool = False, options: Options = Options()) -> TreeField:
        return TreeField(self.sizes, self.edges, self.features, minimise(self.objective(table, l2, pseudo), self.theta.copy(), options=options))

    def predict(self, table: DataFrame) -> DataFrame:
        """y and best: the labels of each row and those of the largest joint probability (first on ties)."""
        ws, tables = self.split(self.theta)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                e = [_matrix(b, "x", self.features) @ w for w in ws]
                inside, choice = [m.copy() for m in e], [None] * len(self.edges)
                for k in reversed(range(len(self.edges))):
                    a, c = self.edges[k]
                    s = tables[k][None] + inside[c][:, None, :]
                    choice[k] = s.argmax(axis=2)
                    inside[a] = inside[a] + s.max(axis=2)
                best = [m.argmax(axis=1) for m in inside]
                for k, (a, c) in enumerate(self.edges):
                    best[c] = choice[k][np.arange(len(best[a])), best[a]]
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(np.stack(best, axis=1).tolist(), pa.list_(pa.int32()))], names=["y", "best"])

        return table.mapInArrow(run, "y array<int>, best array<int>")

    def accuracy(self, table: DataFrame) -> DataFrame:
        """One row: the share of labels that predict() gets right (per_label), and of rows it gets wholly right (whole)."""
        right = F.aggregate(F.zip_with("y", "best", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
        return self.predict(table).select(right.alias("n")).agg((F.sum("n") / (F.count("*") * len(self.sizes))).alias("per_label"), F.avg((F.col("n") == len(self.sizes)).cast("double")).alias("whole"))
