"""Graphical models over factors: Bayesian networks, Markov networks, factor graphs, decomposable models and sampling.

A model's structure (argument names) is metadata on the driver; its factors are tables, and likelihoods, posteriors and
samples are plans of joins over the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semifold.functions import scalar
from semifold.operators.dataset import uniform
from semifold.operators.factor import Factor, product
from semifold.operators.lineage import kept
from semifold.operators.statistics import mle_conditional, mle_marginal
from semifold.operators.structure import heaviest_tree
from semifold.plans.elimination import eliminate
from semifold.plans.junction import Calibrated, JunctionTree, shafer_shenoy


def draw(df: DataFrame, f: Factor, head: str, given: tuple[str, ...], u) -> DataFrame:
    """df (with the columns given) with head drawn from the conditional f at the uniform numbers u: the first value, in
    the values' order, whose cumulated probability exceeds u."""
    before = Window.partitionBy(*given).orderBy(head).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = f.df.withColumn("_hi", F.sum("value").over(before))
    last = F.row_number().over(Window.partitionBy(*given).orderBy(F.desc(head))) == 1
    table = table.select(*given, head, (F.col("_hi") - F.col("value")).alias("_lo"), F.when(last, F.lit(scalar.POS_INF)).otherwise(F.col("_hi")).alias("_hi"))
    rows = df.withColumn("_u", u)
    spans = F.sort_array(F.collect_list(F.struct("_lo", "_hi", head)))
    wide = table.groupBy(*given).agg(spans.alias("_spans"))  # one row for each assignment of given: the domain of head
    both = rows.join(wide, list(given)) if given else rows.crossJoin(wide)
    hit = F.filter("_spans", lambda x: (x["_lo"] <= F.col("_u")) & (F.col("_u") < x["_hi"]))
    return both.withColumn(head, F.get(hit, F.lit(0))[head]).drop("_u", "_spans")


@dataclass
class BayesianNetwork:
    """For each variable its parents and the conditional factor p(variable | parents)."""

    parents: dict[str, tuple[str, ...]]
    factors: dict[str, Factor]

    @classmethod
    def fit(cls, df: DataFrame, parents: dict[str, tuple[str, ...]], smoothing: float = 0.0) -> BayesianNetwork:
        made = {v: mle_conditional(df, (v,), p, smoothing=smoothing) if p else mle_marginal(df, (v,), smoothing=smoothing) for v, p in parents.items()}
        return cls(parents, made)

    def order(self) -> list[str]:
        """Parents before children; an error if there is a cycle."""
        out: list[str] = []
        while len(out) < len(self.parents):
            ready = sorted(v for v, p in self.parents.items() if v not in out and all(x in out for x in p))
            if not ready:
                raise ValueError("the network has a cycle")
            out += ready
        return out

    def log_likelihood(self, df: DataFrame) -> DataFrame:
        """One row: the sum over rows and variables of log p(variable | parents)."""
        parts = [f.log_likelihood(df) for f in self.factors.values()]
        return reduce(DataFrame.unionAll, parts).agg(F.sum("value").alias("value"))

    def joint(self, *retain: str, evidence: dict[str, object] | None = None) -> Factor:
        return eliminate(list(self.factors.values()), retain, evidence=evidence)

    def condition(self, evidence: dict[str, object], *query: str) -> Factor:
        """p(query | evidence)."""
        return self.joint(*query, evidence=evidence).normalize()

    def sample(self, ids: DataFrame, key: str, seed: int = 0) -> DataFrame:
        """One joint sample for each row of ids: variables in order, each drawn by a digest of key and variable."""
        out = ids
        for v in self.order():
            out = draw(out, self.factors[v], v, self.parents[v], uniform(F.lit(v), key, seed=seed))
        return out

    def moral_scopes(self) -> list[tuple[str, ...]]:
        return [(v, *p) for v, p in self.parents.items()]

    def markov_blanket(self, variable: str) -> set[str]:
        children = [c for c, p in self.parents.items() if variable in p]
        return {*self.parents[variable], *children, *(x for c in children for x in self.parents[c])} - {variable}

    def separated(self, a: set[str], b: set[str], given: set[str]) -> bool:
        """Whether a and b are d-separated by given: disconnected in the moral graph of their ancestors without given."""
        own, queue = set(), [*a, *b, *given]
        while queue:
            v = queue.pop()
            if v not in own:
                own.add(v)
                queue += self.parents[v]
        near: dict[str, set[str]] = {v: set() for v in own}
        for v in own:
            family = (v, *self.parents[v])
            for x in family:
                near[x] |= set(family) - {x}
        seen, queue = set(given), [x for x in a if x not in given]
        while queue:
            v = queue.pop()
            if v in b:
                return False
            if v not in seen:
                seen.add(v)
                queue += near[v] - seen
        return True


@dataclass
class FactorGraph:
    """A Markov network or factor graph: any factors, the model being their normalised product."""

    factors: list[Factor]

    def simplify(self) -> FactorGraph:
        """Each factor whose arguments lie within another's is multiplied into it; the model stays the same."""
        left = sorted(self.factors, key=lambda f: (len(f.args), f.args))
        out: list[Factor] = []
        while left:
            f = left.pop(0)
            k = next((k for k, g in enumerate(left) if set(f.args) <= set(g.args)), None)
            if k is None:
                out.append(f)
            else:
                left[k] = left[k] * f
        return FactorGraph(out)

    def condition(self, evidence: dict[str, object]) -> FactorGraph:
        return FactorGraph([f.restrict(evidence) for f in self.factors])

    def norm_constant(self) -> DataFrame:
        return eliminate(self.factors).df

    def log_likelihood(self, df: DataFrame) -> DataFrame:
        """Normalised: the factors' log values summed over the rows, less the number of rows times log of the constant."""
        parts = reduce(DataFrame.unionAll, [f.log_likelihood(df) for f in self.factors]).agg(F.sum("value").alias("_l"))
        z = self.norm_constant().select(F.ln("value").alias("_z"))
        return parts.crossJoin(z).crossJoin(df.agg(F.count("*").alias("_n"))).select((F.col("_l") - F.col("_n") * F.col("_z")).alias("value"))

    def calibrated(self, evidence: dict[str, object] | None = None) -> Calibrated:
        return shafer_shenoy(self.factors, evidence=evidence)


@dataclass
class Decomposable:
    """A junction tree of normalised clique marginals; the model is their product over the separators' marginals."""

    tree: JunctionTree
    cliques: list[Factor]

    @classmethod
    def fit(cls, df: DataFrame, scopes: list[tuple[str, ...]], smoothing: float = 0.0) -> Decomposable:
        tree = JunctionTree.build(scopes)
        return cls(tree, [mle_marginal(df, tuple(sorted(c)), smoothing=smoothing) for c in tree.cliques])

    def separators(self) -> list[Factor]:
        return [self.cliques[i].marginal(*sorted(self.tree.separator(i, j))) for i, j in self.tree.edges]

    def joint(self) -> Factor:
        out = self.cliques[0]
        done, queue = {0}, [0]
        for k in queue:
            for n in self.tree.near(k):
                if n not in done:
                    done.add(n)
                    queue.append(n)
                    out = out * self.cliques[n].conditional(*sorted(self.tree.separator(k, n)))
        return out

    def marginal(self, *args: str) -> Factor:
        k = self.tree.cover(set(args))
        if k is not None:
            return self.cliques[k].marginal(*args).reorder(*args)
        return self.joint().marginal(*args).reorder(*args)

    def entropy(self) -> DataFrame:
        """Entropies of the cliques less those of the separators."""
        parts = [f.entropy() for f in self.cliques] + [f.entropy().select((-F.col("value")).alias("value")) for f in self.separators()]
        return reduce(DataFrame.unionAll, parts).agg(F.sum("value").alias("value"))

    def conditionals(self) -> list[tuple[tuple[str, ...], tuple[str, ...], Factor]]:
        """(new arguments, arguments known before, their conditional factor) of the cliques, along the tree."""
        out, done = [], set()
        for root in range(len(self.cliques)):
            queue = [] if root in done else [root]
            for k in queue:
                if k in done:
                    continue
                done.add(k)
                known = {a for new, _, _ in out for a in new} & set(self.cliques[k].args)
                new = tuple(a for a in self.cliques[k].args if a not in known)
                out.append((new, tuple(sorted(known)), self.cliques[k].conditional(*sorted(known)) if known else self.cliques[k]))
                queue += [n for n in self.tree.near(k) if n not in done]
        return out

    def map_assignment(self, evidence: dict[str, object] | None = None) -> DataFrame:
        """The most probable assignment of what evidence leaves open: one row."""
        return max_product_assignment([g for _, _, f in self.conditionals() if (g := f.restrict(evidence or {})).args])

    def given(self, evidence: dict[str, object], *query: str) -> Factor:
        """p(query | evidence), by elimination over the cliques' conditionals."""
        return eliminate([f for _, _, f in self.conditionals()], query, evidence=evidence).normalize()

    def sample(self, ids: DataFrame, key: str, seed: int = 0) -> DataFrame:
        """One joint sample for each row of ids: cliques along the tree, a clique's new arguments one after the other."""
        out = ids
        for new, known, f in self.conditionals():
            for k, v in enumerate(new):
                before = (*known, *new[:k])
                joint = f.marginal(*before, v)
                out = draw(out, joint.conditional(*before) if before else joint, v, before, uniform(F.lit(v), key, seed=seed))
        return out

    def log_likelihood(self, df: DataFrame) -> DataFrame:
        parts = [f.log_likelihood(df) for f in self.cliques] + [f.log_likelihood(df).select((-F.col("value")).alias("value")) for f in self.separators()]
        return reduce(DataFrame.unionAll, parts).agg(F.sum("value").alias("value"))


def thin_projection(model: Calibrated, *args: str) -> tuple[DataFrame, Decomposable]:
    """The model of a tree over args that is nearest to a calibrated model, by relative entropy: its edges carry the largest
    total mutual information, and each has the model's own belief of its two arguments.

    Returns the pairs (a, b, information, joined) and the tree's model. Beliefs of pairs are stored, one table each; the driver
    holds a number a pair."""
    if len(args) < 2:
        return _pairs_table(model, {}, set()), Decomposable(JunctionTree([frozenset(args)], []), [model.belief(*args).normalize()] if args else [])
    beliefs = {(a, b): Factor(kept(model.belief(a, b).normalize().df), (a, b)) for a, b in combinations(sorted(args), 2)}
    rows = [f.mutual_information((a,), (b,)).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "value") for (a, b), f in beliefs.items()]
    weights = {(x["a"], x["b"]): x["value"] for x in reduce(DataFrame.unionAll, rows).collect()}  # a row a pair of arguments
    edges = {frozenset(e) for e in heaviest_tree(weights)}
    by_scope = {frozenset(e): f for e, f in beliefs.items()}
    tree = JunctionTree.build([tuple(sorted(e)) for e in sorted(edges, key=sorted)])
    return _pairs_table(model, weights, edges), Decomposable(tree, [by_scope[c] for c in tree.cliques])


def _pairs_table(model: Calibrated, weights: dict[tuple[str, str], float], edges: set[frozenset[str]]) -> DataFrame:
    rows = [(a, b, w, frozenset((a, b)) in edges) for (a, b), w in weights.items()]
    return model.beliefs[0].df.sparkSession.createDataFrame(rows, "a string, b string, information double, joined boolean")


def max_product_assignment(factors: list[Factor]) -> DataFrame:
    """The assignment of largest product, by max-product elimination and back-tracking: one row.

    Each eliminated argument leaves a table of its best value for its neighbours' values, joined back in reverse; the full
    product is never made. Ties go to the smaller value of the argument eliminated last."""
    from semifold.functions.semiring import MAX_PRODUCT
    from semifold.plans.elimination import elimination_order

    pool, traces = list(factors), []
    for a in elimination_order([f.args for f in pool], set()):
        joined = product([f for f in pool if a in f.args], MAX_PRODUCT)
        rest = tuple(x for x in joined.args if x != a)
        best = joined.df.groupBy(*rest).agg(F.max_by(F.col(a), F.struct("value")).alias(a), F.max("value").alias("value"))
        traces.append((rest, best.select(*rest, a)))
        pool = [f for f in pool if a not in f.args] + [Factor(best, rest)]
    out = None
    for rest, table in reversed(traces):
        out = table if out is None else out.join(table, list(rest)) if rest else out.crossJoin(table)
    return out
