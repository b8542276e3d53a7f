"""Dynamic Bayesian networks: a two-slice model of few finite variables, unrolled by step or filtered along a stream.

The network is small (its tables are arrays), the sequences are not: a key's filter keeps only its belief, as the marginals of
stated clusters. After each step the joint is projected to the clusters by a junction tree over them: the product of the
cluster marginals over the separators' is the nearest distribution of that structure. One cluster of all variables is exact
filtering; single variables are a fully factored filter; overlapping clusters lie between.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from semifold.plans.junction import JunctionTree


@dataclass(frozen=True)
class DynamicNetwork:
    """sizes: states of each variable. prior: of each variable (parents in the same slice, array over parents and itself).
    moves: of each variable (parents in the slice before, array). seen: of each observed column (parents, array over the
    parents and the column's codes). Parents of a slice must come before their children in sizes."""

    sizes: dict[str, int]
    prior: dict[str, tuple[tuple[str, ...], np.ndarray]]
    moves: dict[str, tuple[tuple[str, ...], np.ndarray]]
    seen: dict[str, tuple[tuple[str, ...], np.ndarray]]

    def check(self) -> None:
        """An error if a table has not the shape of its variables or does not add up to one."""
        names = list(self.sizes)
        for kind, tables in (("prior", self.prior), ("move", self.moves)):
            for v, (parents, a) in tables.items():
                if a.shape != (*(self.sizes[p] for p in parents), self.sizes[v]) or not np.allclose(a.sum(axis=-1), 1):
                    raise ValueError(f"the {kind} of {v} is no conditional table")
                if kind == "prior" and any(names.index(p) >= names.index(v) for p in parents):
                    raise ValueError(f"a parent of {v} comes after it")
        for o, (parents, a) in self.seen.items():
            if a.shape[:-1] != tuple(self.sizes[p] for p in parents) or not np.allclose(a.sum(axis=-1), 1):
                raise ValueError(f"{o} is no conditional table")

    def ancestors(self, variable: str) -> set[str]:
        """Variables of the slice before on which a variable depends, over any number of steps."""
        found: set[str] = set()
        queue = [variable]
        while queue:
            for p in self.moves[queue.pop()][0]:
                if p not in found:
                    found.add(p)
                    queue.append(p)
        return found

    def _along(self, a: np.ndarray, scope: tuple[str, ...]) -> np.ndarray:
        """An array over scope with an axis for each variable, of length one where it says nothing."""
        names = list(self.sizes)
        order = sorted(range(len(scope)), key=lambda k: names.index(scope[k]))
        return np.transpose(a, order).reshape([self.sizes[v] if v in scope else 1 for v in names])

    def first(self) -> np.ndarray:
        out = np.ones([1] * len(self.sizes))
        for v, (parents, a) in self.prior.items():
            out = out * self._along(a, (*parents, v))
        return out

    def advanced(self, joint: np.ndarray) -> np.ndarray:
        """The joint of the next slice."""
        n = len(self.sizes)
        names = list(self.sizes)
        terms: list = [joint, list(range(n))]
        for v, (parents, a) in self.moves.items():
            terms += [a, [*(names.index(p) for p in parents), n + names.index(v)]]
        return np.einsum(*terms, list(range(n, 2 * n)))

    def observed(self, joint: np.ndarray, row: dict[str, int | None]) -> np.ndarray:
        """The joint given the columns of a row that are not null."""
        for o, (parents, a) in self.seen.items():
            if row.get(o) is not None:
                joint = joint * self._along(a[..., int(row[o])], parents)
        return joint / joint.sum()

    def unrolled(self, steps: int) -> list[tuple[tuple[str, ...], np.ndarray]]:
        """The conditional tables of the variables of `steps` slices, named variable@step, as (scope, array)."""
        out = [((*(f"{p}@0" for p in parents), f"{v}@0"), a) for v, (parents, a) in self.prior.items()]
        for t in range(1, steps):
            out += [((*(f"{p}@{t - 1}" for p in parents), f"{v}@{t}"), a) for v, (parents, a) in self.moves.items()]
        return out


def projected(joint: np.ndarray, names: list[str], tree: JunctionTree) -> np.ndarray:
    """The product of joint's cluster marginals over its separators' marginals."""

    def marginal(scope) -> np.ndarray:
        return joint.sum(axis=tuple(k for k, v in enumerate(names) if v not in scope), keepdims=True)

    out = np.ones([1] * len(names))
    for c in tree.cliques:
        out = out * marginal(c)
    for i, j in tree.edges:
        s = marginal(tree.separator(i, j))
        out = np.divide(out, s, out=np.zeros(np.broadcast_shapes(out.shape, s.shape)), where=s > 0)
    return out * np.ones(joint.shape)


def filtered(stream: DataFrame, key: str, order: str, network: DynamicNetwork, clusters: list[tuple[str, ...]]) -> DataFrame:
    """key, steps, variable and belief (array) after each micro-batch. Observed columns hold codes or null (not seen); steps
    within a batch are taken by order. Works on tables, too, through one micro-batch."""
    network.check()
    names, observed = list(network.sizes), list(network.seen)
    tree = JunctionTree.build([tuple(c) for c in clusters])
    if {v for c in clusters for v in c} != set(names):
        raise ValueError("the clusters must have all variables")
    shape = tuple(network.sizes.values())

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, joint = (state.get[0], np.array(state.get[1]).reshape(shape)) if state.exists else (0, None)
        for row in pd.concat(list(batches)).sort_values(order)[observed].itertuples(index=False):
            joint = network.first() if joint is None else network.advanced(joint)
            joint = network.observed(joint, {o: None if pd.isna(x) else int(x) for o, x in zip(observed, row, strict=True)})
            joint = projected(joint, names, tree)
            steps += 1
        state.update((steps, joint.ravel().tolist()))
        own = [joint.sum(axis=tuple(a for a in range(len(names)) if a != i)) for i in range(len(names))]
        yield pd.DataFrame({key: [k[0]] * len(names), "steps": steps, "variable": names, "belief": [b.tolist() for b in own]})

    kind = dict(stream.dtypes)[key]
    out = f"{key} {kind}, steps long, variable string, belief array<double>"
    return stream.select(key, order, *observed).groupBy(key).applyInPandasWithState(step, out, "steps long, joint array<double>", "update", GroupStateTimeout.NoTimeout)


def enumerated(network: DynamicNetwork, rows: list[dict]) -> dict[str, np.ndarray]:
    """The beliefs of the last slice by enumeration of all slices: for tests of short sequences."""
    tables = network.unrolled(len(rows))
    names = [f"{v}@{t}" for t in range(len(rows)) for v in network.sizes]
    out = {v: np.zeros(n) for v, n in network.sizes.items()}
    for x in product(*(range(network.sizes[v.split("@")[0]]) for v in names)):
        at = dict(zip(names, x, strict=True))
        p = float(np.prod([a[tuple(at[v] for v in scope)] for scope, a in tables]))
        for t, row in enumerate(rows):
            for o, (parents, a) in network.seen.items():
                if row.get(o) is not None:
                    p *= a[(*(at[f"{v}@{t}"] for v in parents), row[o])]
        for v in network.sizes:
            out[v][at[f"{v}@{len(rows) - 1}"]] += p
    return {v: b / b.sum() for v, b in out.items()}
