"""Junction trees: triangulation, cliques and separators of a model's scopes, and calibration by message passing.

Scopes and cliques are sets of argument names, metadata of the model, and are worked out on the driver. Potentials and
messages are factors: every message is a join and a group-by, stored once, so a plan never holds more than one clique's
neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from semifold.functions.semiring import SUM_PRODUCT, Semiring
from semifold.operators.factor import Factor, product
from semifold.operators.lineage import kept
from semifold.plans.elimination import elimination_order

Scope = frozenset[str]


def neighbours(scopes: list[tuple[str, ...]]) -> dict[str, set[str]]:
    near: dict[str, set[str]] = {a: set() for s in scopes for a in s}
    for s in scopes:
        for a, b in combinations(s, 2):
            near[a].add(b)
            near[b].add(a)
    return near


def triangulate(scopes: list[tuple[str, ...]], by: str = "fill", first: list[str] | None = None) -> tuple[list[str], list[Scope], set[Scope]]:
    """Elimination order, maximal cliques and fill-in edges. first: arguments to eliminate before all others."""
    ahead = list(first or [])
    every = {a for s in scopes for a in s}
    rest = elimination_order(scopes, set(ahead), by) if ahead else elimination_order(scopes, set(), by)
    order = [*ahead, *(a for a in rest if a not in ahead)]
    near, cliques, fill = neighbours(scopes), [], set()
    for a in order:
        around = near.pop(a)
        clique = frozenset({a, *around})
        if not any(clique <= c for c in cliques):
            cliques.append(clique)
        for b, c in combinations(sorted(around), 2):
            if c not in near[b]:
                fill.add(frozenset({b, c}))
                near[b].add(c)
                near[c].add(b)
        for b in around:
            near[b].discard(a)
    assert every == set(order)
    return order, cliques, fill


@dataclass
class JunctionTree:
    """cliques, and edges (i, j) between them; the separator of an edge is what both cliques hold."""

    cliques: list[Scope]
    edges: list[tuple[int, int]]

    @classmethod
    def build(cls, scopes: list[tuple[str, ...]], by: str = "fill") -> JunctionTree:
        """Cliques of the triangulated scopes, joined by a spanning tree of largest separators."""
        cliques = triangulate(scopes, by)[1]
        pairs = sorted(((-len(a & b), i, j) for (i, a), (j, b) in combinations(enumerate(cliques), 2) if a & b))
        root, edges = list(range(len(cliques))), []

        def top(k: int) -> int:
            while root[k] != k:
                k = root[k]
            return k

        for _, i, j in pairs:
            if top(i) != top(j):
                root[top(i)] = top(j)
                edges.append((i, j))
        return cls(cliques, edges)

    def separator(self, i: int, j: int) -> Scope:
        return self.cliques[i] & self.cliques[j]

    def near(self, i: int) -> list[int]:
        return [b if a == i else a for a, b in self.edges if i in (a, b)]

    def running_intersection(self) -> bool:
        """Whether the cliques that hold an argument are connected, for every argument."""
        for a in {a for c in self.cliques for a in c}:
            own = {k for k, c in enumerate(self.cliques) if a in c}
            if sum(a in self.separator(i, j) for i, j in self.edges) != len(own) - 1:
                return False
        return True

    def width(self) -> int:
        return max(map(len, self.cliques), default=0) - 1

    def cover(self, args: set[str]) -> int | None:
        """The smallest clique that holds all args, None if there is none."""
        own = [k for k, c in enumerate(self.cliques) if args <= c]
        return min(own, key=lambda k: (len(self.cliques[k]), k), default=None)

    def separator_cover(self, args: set[str]) -> tuple[int, int] | None:
        own = [e for e in self.edges if args <= self.separator(*e)]
        return min(own, key=lambda e: (len(self.separator(*e)), e), default=None)

    def meets(self, args: set[str]) -> int | None:
        """The clique that shares most with args."""
        return max(range(len(self.cliques)), key=lambda k: (len(args & self.cliques[k]), -len(self.cliques[k]), -k), default=None)

    def schedule(self) -> list[tuple[int, int]]:
        """Messages from the leaves to the first clique of each tree and back: every edge in both directions."""
        seen, inward = set(), []
        for start in range(len(self.cliques)):
            if start in seen:
                continue
            seen.add(start)
            queue = [start]
            for k in queue:
                for n in self.near(k):
                    if n not in seen:
                        seen.add(n)
                        queue.append(n)
                        inward.append((n, k))
        return [*reversed(inward), *((b, a) for a, b in inward)]


def _stored(f: Factor) -> Factor:
    return Factor(kept(f.df), f.args)


@dataclass
class Calibrated:
    """A junction tree whose cliques hold beliefs: products of all factors, collapsed to the clique."""

    tree: JunctionTree
    beliefs: list[Factor]
    semiring: Semiring
    evidence: dict[str, object] = field(default_factory=dict)

    def belief(self, *args: str) -> Factor:
        """Of arguments within one clique, from its belief; of others, by joining the cliques on the paths between them."""
        k = self.tree.cover(set(args))
        if k is not None:
            return self.beliefs[k].collapse(self.semiring.collapse, args).reorder(*args)
        return self._joined(set(args)).collapse(self.semiring.collapse, args).reorder(*args)

    def _joined(self, args: set[str]) -> Factor:
        """Beliefs of a connected part of the tree that covers args, each clique divided by its separator."""
        part = set(range(len(self.tree.cliques)))

        def spare(k: int) -> bool:
            """A leaf of the part that args do not need."""
            others = set().union(*(self.tree.cliques[n] for n in part if n != k))
            return len(part) > 1 and sum(n in part for n in self.tree.near(k)) <= 1 and not (self.tree.cliques[k] & args) - others

        while (leaf := next((k for k in sorted(part) if spare(k)), None)) is not None:
            part.discard(leaf)
        start = min(part)
        out, done, queue = self.beliefs[start], {start}, [start]
        for k in queue:
            for n in self.tree.near(k):
                if n in part and n not in done:
                    done.add(n)
                    queue.append(n)
                    over = tuple(a for a in self.beliefs[n].args if a in self.tree.separator(k, n))
                    out = out * (self.beliefs[n] / self.beliefs[n].collapse(self.semiring.collapse, over)) if over else out * self.beliefs[n]
                    out = out.collapse(self.semiring.collapse, tuple(a for a in out.args if a in args or any(a in self.tree.cliques[m] for m in part - done)))
        return out


def _assigned(factors: list[Factor], tree: JunctionTree) -> list[list[Factor]]:
    own: list[list[Factor]] = [[] for _ in tree.cliques]
    for f in factors:
        own[tree.cover(set(f.args)) or 0].append(f)
    return own


def shafer_shenoy(factors: list[Factor], semiring: Semiring = SUM_PRODUCT, evidence: dict[str, object] | None = None) -> Calibrated:
    """Calibration without division: a message is the clique's potential times all other messages, collapsed."""
    pool = [f.restrict(evidence or {}) for f in factors]
    tree = JunctionTree.build([f.args for f in pool if f.args])
    own = _assigned(pool, tree)
    sent: dict[tuple[int, int], Factor] = {}
    for i, j in tree.schedule():
        parts = [*own[i], *(sent[n, i] for n in tree.near(i) if n != j)]
        over = tuple(sorted(tree.separator(i, j)))
        if parts:
            joined = product(parts, semiring)
            sent[i, j] = _stored(joined.collapse(semiring.collapse, tuple(a for a in joined.args if a in over)))
    beliefs = [_stored(product([*own[k], *(sent[n, k] for n in tree.near(k) if (n, k) in sent)], semiring)) for k in range(len(tree.cliques))]
    return Calibrated(tree, beliefs, semiring, dict(evidence or {}))


def hugin(factors: list[Factor], evidence: dict[str, object] | None = None) -> Calibrated:
    """Calibration with division (sum-product): a clique's belief is multiplied by the new separator over the old one."""
    pool = [f.restrict(evidence or {}) for f in factors]
    tree = JunctionTree.build([f.args for f in pool if f.args])
    beliefs = [product(own) for own in _assigned(pool, tree) if own]
    if len(beliefs) < len(tree.cliques):  # a clique of fill-in edges only holds no factor to start from
        return shafer_shenoy(factors, SUM_PRODUCT, evidence)
    old: dict[Scope, Factor] = {}
    for i, j in tree.schedule():
        over, edge = tuple(sorted(tree.separator(i, j))), frozenset({str(i), str(j)})
        new = _stored(beliefs[i].marginal(*over))
        beliefs[j] = _stored(beliefs[j] * (new / old[edge] if edge in old else new))
        old[edge] = new
    return Calibrated(tree, [_stored(b) for b in beliefs], SUM_PRODUCT, dict(evidence or {}))
