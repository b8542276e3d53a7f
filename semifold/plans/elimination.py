"""Marginal queries by variable elimination: the whole query is one DataFrame plan of joins and group-bys."""

from __future__ import annotations

from itertools import combinations

from semifold.functions.semiring import SUM_PRODUCT, Semiring
from semifold.operators.factor import Factor, product


def elimination_order(scopes: list[tuple[str, ...]], retain: set[str], by: str = "fill") -> list[str]:
    """Greedy order of the arguments outside retain: fewest fill-in edges, or smallest degree."""
    near: dict[str, set[str]] = {a: set() for s in scopes for a in s}
    for s in scopes:
        for a, b in combinations(s, 2):
            near[a].add(b)
            near[b].add(a)
    order = []
    left = sorted(set(near) - retain)
    while left:
        fill = {a: sum(c not in near[b] for b, c in combinations(sorted(near[a]), 2)) for a in left}
        a = min(left, key=lambda x: (fill[x] if by == "fill" else len(near[x]), len(near[x]), x))
        for b, c in combinations(near[a], 2):
            near[b].add(c)
            near[c].add(b)
        for b in near.pop(a):
            near[b].discard(a)
        left.remove(a)
        order.append(a)
    return order


def eliminate(factors: list[Factor], retain: tuple[str, ...] = (), semiring: Semiring = SUM_PRODUCT, by: str = "fill", evidence: dict[str, object] | None = None) -> Factor:
    """The product of factors collapsed to retain, with evidence filtered before the first join."""
    pool = [f.restrict(evidence or {}) for f in factors]
    for a in elimination_order([f.args for f in pool], set(retain), by):
        own = [f for f in pool if a in f.args]
        joined = product(own, semiring)
        pool = [f for f in pool if a not in f.args] + [joined.collapse(semiring.collapse, tuple(x for x in joined.args if x != a))]
    done = product(pool, semiring)
    return done.reorder(*(a for a in retain if a in done.args))
