"""Structure search over decomposable models of bounded tree width.

A model is an attachment of columns: each column, in some order, has parents that lie together in a clique of columns before
it. Its log-likelihood per row is the negative sum of entropies H(column and parents) - H(parents), so a search needs
nothing of the data but entropies of small sets of columns. They are memoised: sets that a step asks for and that are not
known yet are counted together, in one pass of grouping sets whose counts combine before the shuffle; sets met again cost
nothing. The search itself moves over columns, of which there are few, on the driver.

Moves: a leaf (a column that no other leans on) is attached elsewhere; a subtree (a column and all that lean on it) is
pushed to other parents; two columns change places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scope = frozenset[str]


class Entropies:
    """Entropies in nats of sets of columns of df, weighted by a column if given; passes counts the scans of the table."""

    def __init__(self, df: DataFrame, columns: list[str], weight: str | None = None, sets_a_pass: int = 64):
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        self.df = df.select(*columns, w.alias("_w"))
        self.columns, self.sets_a_pass, self.passes = list(columns), sets_a_pass, 0
        self.known: dict[Scope, float] = {frozenset(): 0.0}
        self.sizes: dict[Scope, int] = {frozenset(): 1}

    def ask(self, scopes) -> None:
        missing = sorted({frozenset(s) for s in scopes} - self.known.keys(), key=sorted)
        for lo in range(0, len(missing), self.sets_a_pass):
            self._count(missing[lo : lo + self.sets_a_pass])

    def _count(self, scopes: list[Scope]) -> None:
        self.passes += 1
        all_columns = sorted({c for s in scopes for c in s}, key=self.columns.index)
        sets = [[c for c in all_columns if c in s] for s in scopes]
        cells = self.df.groupingSets([[F.col(c) for c in s] for s in sets], *all_columns).agg(F.grouping_id().alias("_g"), F.sum("_w").alias("_n"))
        plogp = F.sum(F.when(F.col("_n") > 0, F.col("_n") * F.ln("_n")).otherwise(0.0))
        rows = {r["_g"]: r for r in cells.groupBy("_g").agg(F.sum("_n").alias("n"), plogp.alias("x"), F.count("*").alias("cells")).collect()}  # a row a set
        for s, own in zip(scopes, sets, strict=True):
            r = rows.get(sum(1 << (len(all_columns) - 1 - k) for k, c in enumerate(all_columns) if c not in own))
            n = r["n"] if r and r["n"] else 0.0
            self.known[s] = 0.0 if not n else log(n) - r["x"] / n
            self.sizes[s] = r["cells"] if r else 0

    def __getitem__(self, scope) -> float:
        s = frozenset(scope)
        if s not in self.known:
            self.ask([s])
        return self.known[s]


@dataclass(frozen=True)
class Attached:
    """(column, parents) in order; parents lie in one clique of the columns before."""

    steps: tuple[tuple[str, Scope], ...]

    def cliques(self) -> list[Scope]:
        """The largest of the sets of a column and its parents."""
        all_sets = {p | {c} for c, p in self.steps}
        return sorted((s for s in all_sets if not any(s < t for t in all_sets)), key=sorted)

    def families(self) -> list[tuple[Scope, Scope]]:
        return [(p | {c}, p) for c, p in self.steps]

    def key(self) -> frozenset:
        """What tells models apart: their cliques."""
        return frozenset(self.cliques())

    def valid(self, width: int) -> bool:
        before: list[Scope] = []
        for c, p in self.steps:
            if len(p) > width or p and not any(p <= s for s in before):
                return False
            before.append(p | {c})
        return True

    def log_likelihood(self, h: Entropies) -> float:
        """Mean log-likelihood of a row under the maximum likelihood parameters."""
        h.ask(s for both in self.families() for s in both)
        return -sum(h[a] - h[b] for a, b in self.families())


def empty_model(columns: list[str]) -> Attached:
    return Attached(tuple((c, frozenset()) for c in columns))


def star_model(columns: list[str], centre: str) -> Attached:
    return Attached(((centre, frozenset()), *((c, frozenset([centre])) for c in columns if c != centre)))


def _subsets(s: Scope, most: int) -> Iterator[Scope]:
    for k in range(min(most, len(s)) + 1):
        yield from map(frozenset, combinations(sorted(s), k))


def subtree(model: Attached, column: str) -> set[str]:
    """The column and all that lean on it, directly or not."""
    inside = {column}
    for c, p in model.steps:
        if p & inside:
            inside.add(c)
    return inside


def leaf_moves(model: Attached, width: int) -> Iterator[Attached]:
    for c, p in model.steps:
        if subtree(model, c) == {c}:
            rest = tuple(s for s in model.steps if s[0] != c)
            for to in {x for clique in Attached(rest).cliques() for x in _subsets(clique, width)} - {p}:
                yield Attached((*rest, (c, to)))


def push_moves(model: Attached, width: int) -> Iterator[Attached]:
    """A column with parents and all that leans on it is attached to other parents; what leans keeps its inner parents."""
    for c, p in model.steps:
        inside = subtree(model, c)
        rest = tuple(s for s in model.steps if s[0] not in inside)
        if not rest or inside == {c}:
            continue
        for to in {x for clique in Attached(rest).cliques() for x in _subsets(clique, width)} - {p}:
            moved = tuple((x, to if x == c else q & (inside | to)) for x, q in model.steps if x in inside)
            if (new := Attached((*rest, *moved))).valid(width):
                yield new


def swap_moves(model: Attached, width: int) -> Iterator[Attached]:
    names = [c for c, _ in model.steps]
    for a, b in combinations(names, 2):
        other = {a: b, b: a}
        yield Attached(tuple((other.get(c, c), frozenset(other.get(x, x) for x in p)) for c, p in model.steps))


MOVES: tuple[Callable[[Attached, int], Iterator[Attached]], ...] = (leaf_moves, push_moves, swap_moves)


def hill_climb(h: Entropies, start: Attached, width: int, penalty: float = 0.0, steps: int = 1000, moves=MOVES) -> tuple[Attached, float]:
    """The model that no move betters, and its score: mean log-likelihood less penalty times its number of free parameters
    (each family's cells that occur, less those of its parents)."""

    def score(m: Attached) -> float:
        free = sum(h.sizes[a] - h.sizes[b] for a, b in m.families())
        return m.log_likelihood(h) - penalty * free

    h.ask(s for both in start.families() for s in both)
    best, at = start, score(start)
    for _ in range(steps):
        near = {m.key(): m for move in moves for m in move(best, width)}
        near.pop(best.key(), None)
        h.ask(s for m in near.values() for both in m.families() for s in both)
        if not near:
            break
        to, m = max(((score(m), m) for m in near.values()), key=lambda x: x[0])
        if to <= at + 1e-12:
            break
        best, at = m, to
    return best, at


# Trees for conditional random fields: which labels to join, given what is seen.


def conditional_weights(h: Entropies, labels: list[str], seen: dict[str, list[str]], kind: str = "information") -> dict[tuple[str, str], float]:
    """A weight of each pair of labels given the columns seen[label] of both (their union):

    information: the conditional mutual information of the labels; piecewise: the mean log of p(both | seen), the pair's own
    conditional likelihood; influence: what that exceeds the labels' own, each given its own columns alone. All sets of
    columns are counted together."""
    pairs = list(combinations(labels, 2))
    x = {(a, b): frozenset(seen.get(a, ())) | frozenset(seen.get(b, ())) for a, b in pairs}
    own = {a: frozenset(seen.get(a, ())) for a in labels}
    needed = [x[p] | extra for p in pairs for extra in ({*p}, {p[0]}, {p[1]}, set())] + [own[a] | extra for a in labels for extra in ({a}, set())]
    h.ask(needed)
    given = lambda s, c: h[s | c] - h[c]
    out = {}
    for a, b in pairs:
        both = given(frozenset((a, b)), x[a, b])
        if kind == "information":
            out[a, b] = given(frozenset([a]), x[a, b]) + given(frozenset([b]), x[a, b]) - both
        elif kind == "piecewise":
            out[a, b] = -both
        elif kind == "influence":
            out[a, b] = given(frozenset([a]), own[a]) + given(frozenset([b]), own[b]) - both
        else:
            raise ValueError(kind)
    return out


def heaviest_tree(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The edges of the spanning tree of largest weight (ties by name), each parent before its children."""
    root = {c: c for pair in weights for c in pair}

    def top(c: str) -> str:
        return c if root[c] == c else top(root[c])

    picked = []
    for (a, b), _ in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if top(a) != top(b):
            root[top(a)] = top(b)
            picked.append((a, b))
    out, done = [], [min(root)] if root else []
    for c in done:
        for a, b in picked:
            if c in (a, b) and (other := b if c == a else a) not in done:
                done.append(other)
                out.append((c, other))
    return out
