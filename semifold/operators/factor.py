"""Factors: relations of argument columns and a value, with natural-join and group-by algebra.

A factor holds one row for each assignment of its arguments. Products join on the shared arguments; factors without a
shared argument pair every row, which is the definition of their product and meant for small factors. Spark chooses the
join by measured size, so nothing is broadcast unchecked.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semifold.functions import scalar
from semifold.functions.semiring import SUM_PRODUCT, Semiring

OPS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": scalar.safe_divide,
    "&": lambda a, b: ((a != 0) & (b != 0)).cast("double"),
    "|": lambda a, b: ((a != 0) | (b != 0)).cast("double"),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "abs_difference": lambda a, b: F.abs(a - b),
}


class Factor:
    """df with the columns args and value (double)."""

    def __init__(self, df: DataFrame, args: tuple[str, ...], value: str = "value"):
        self.args = tuple(args)
        self.df = df.select(*self.args, F.col(value).cast("double").alias("value"))

    # joins

    def combine(self, other: Factor, op: str | Callable[[Column, Column], Column]) -> Factor:
        """op of the two values on the natural join; the arguments are the union."""
        f = OPS[op] if isinstance(op, str) else op
        shared = [a for a in self.args if a in other.args]
        right = other.df.withColumnRenamed("value", "_right")
        joined = self.df.join(right, shared) if shared else self.df.crossJoin(right)
        return Factor(joined.withColumn("value", f(F.col("value"), F.col("_right"))), (*self.args, *(a for a in other.args if a not in self.args)))

    def __mul__(self, other: Factor) -> Factor:
        return self.combine(other, "*")

    def __truediv__(self, other: Factor) -> Factor:
        return self.combine(other, "/")

    def __add__(self, other: Factor) -> Factor:
        return self.combine(other, "+")

    def __sub__(self, other: Factor) -> Factor:
        return self.combine(other, "-")

    def map(self, f: Callable[[Column], Column]) -> Factor:
        """Any function of the value: scalar operations, pow, invert, negation, log and exp."""
        return Factor(self.df.withColumn("value", f(F.col("value"))), self.args)

    def weighted_update(self, other: Factor, a: float) -> Factor:
        """(1 - a) self + a other: the damping step."""
        return self.combine(other, lambda x, y: (1 - a) * x + a * y)

    def combine_collapse(self, other: Factor, op: str, collapse: Callable[[Column], Column], retain: tuple[str, ...] = ()) -> Factor:
        return self.combine(other, op).collapse(collapse, retain)

    def join_find(self, other: Factor, predicate: Callable[[Column, Column], Column]) -> DataFrame:
        """The first pair of the natural join that satisfies predicate, in storage order (last argument first)."""
        args = (*self.args, *(a for a in other.args if a not in self.args))
        pairs = self.df.withColumnRenamed("value", "left_value").join(other.df.withColumnRenamed("value", "right_value"), [a for a in self.args if a in other.args])
        return pairs.where(predicate(F.col("left_value"), F.col("right_value"))).orderBy(*reversed(args)).limit(1)

    # aggregation

    def collapse(self, collapse: Callable[[Column], Column], retain: tuple[str, ...] = ()) -> Factor:
        """Fold the values over all arguments but retain; nothing is grouped if retain covers the arguments."""
        keep = tuple(a for a in self.args if a in retain)
        if keep == self.args:
            return self
        return Factor(self.df.groupBy(*keep).agg(collapse(F.col("value")).alias("value")), keep)

    def marginal(self, *retain: str) -> Factor:
        return self.collapse(F.sum, retain)

    def maximum(self, *retain: str) -> Factor:
        return self.collapse(F.max, retain)

    def minimum(self, *retain: str) -> Factor:
        return self.collapse(F.min, retain)

    def logical_or(self, *retain: str) -> Factor:
        return self.collapse(lambda v: F.max((v != 0).cast("double")), retain)

    def logical_and(self, *retain: str) -> Factor:
        return self.collapse(lambda v: F.min((v != 0).cast("double")), retain)

    def normalize(self) -> Factor:
        """Values over their sum, which must be positive and finite; the check is part of the plan."""
        total = self.df.agg(F.sum("value").alias("_z"))
        z = F.when(scalar.is_positive_finite(F.col("_z")), F.col("_z")).otherwise(F.raise_error(F.lit("the factor cannot be normalised")))
        return Factor(self.df.crossJoin(total).withColumn("value", F.col("value") / z), self.args)

    def conditional(self, *given: str) -> Factor:
        """self over its marginal on given, with 0/0 = 0."""
        total = F.sum("value").over(Window.partitionBy(*given))
        return Factor(self.df.withColumn("value", scalar.safe_divide(F.col("value"), total)), self.args)

    def restrict(self, assignment: dict[str, object]) -> Factor:
        """The rows that agree with assignment, without its arguments: a pushed-down filter."""
        bound = [a for a in self.args if a in assignment]
        kept = reduce(lambda d, a: d.where(F.col(a) == F.lit(assignment[a])), bound, self.df)
        return Factor(kept, tuple(a for a in self.args if a not in assignment))

    def restrict_by(self, evidence: DataFrame) -> Factor:
        """restrict for many assignments at once: the arguments of evidence stay as keys."""
        return Factor(self.df.join(evidence, [a for a in self.args if a in evidence.columns]), self.args)

    def reorder(self, *args: str) -> Factor:
        return Factor(self.df, args)

    def rename(self, names: dict[str, str]) -> Factor:
        return Factor(self.df.withColumnsRenamed(names), tuple(names.get(a, a) for a in self.args))

    def unroll(self, arities: dict[str, int], name: str) -> Factor:
        """All arguments (integer codes) as one mixed-radix code, the last argument most significant."""
        code, radix = F.lit(0).cast("long"), 1
        for a in self.args:
            code, radix = code + F.col(a) * radix, radix * arities[a]
        return Factor(self.df.withColumn(name, code), (name,))

    def roll_up(self, arities: dict[str, int]) -> Factor:
        """The inverse of unroll: one code back to the arguments named in arities, in their order."""
        df, radix = self.df, 1
        for a, k in arities.items():
            df, radix = df.withColumn(a, F.pmod(F.floor(F.col(self.args[0]) / radix), F.lit(k)).cast("int")), radix * k
        return Factor(df, tuple(arities))

    def is_conditional(self, tail: tuple[str, ...], tol: float = 1e-9) -> DataFrame:
        """Whether the values add up to 1 for every assignment of tail: one row, value 1 or 0."""
        sums = self.df.groupBy(*tail).agg(F.sum("value").alias("_z"))
        return sums.agg(F.min((F.abs(F.col("_z") - 1) <= tol).cast("int")).alias("value"))

    def lookup(self, points: DataFrame, default: float = 0.0) -> DataFrame:
        """points (the arguments, and other columns) with value, the factor's value there."""
        found = self.df.withColumnRenamed("value", "_v")
        return points.join(found, list(self.args), "left").withColumn("value", F.coalesce("_v", F.lit(default))).drop("_v")

    def assign(self, points: DataFrame) -> Factor:
        """The factor with the values of points (the arguments and value) written over its own, new rows included."""
        new = points.select(*self.args, F.col("value").cast("double").alias("_v"))
        both = self.df.join(new, list(self.args), "full")
        return Factor(both.withColumn("value", F.coalesce("_v", "value")), self.args)

    def fold_ordered(self, step: Callable[[Column, Column], Column], start: float, right: bool = False) -> DataFrame:
        """Ordered fold of all values in storage order (last argument most significant), from the left or the right. The
        factor is gathered as one array: for small factors only, as the fold is no aggregate."""
        rows = F.sort_array(F.collect_list(F.struct(*reversed(self.args), F.col("value"))), asc=not right)
        return self.df.agg(F.aggregate(rows, F.lit(float(start)), lambda acc, x: step(acc, x["value"])).alias("value"))

    def message_derivative_bound(self, x: str, y: str) -> DataFrame:
        """tanh of a quarter of the largest log ratio f(a,c) f(b,d) / (f(a,d) f(b,c)): how much a message from x to y can
        turn with the one that x receives."""
        logs = self.df.groupBy(x, y).agg(F.ln(F.sum("value")).alias("l"))
        pair = logs.alias("p").join(logs.alias("q"), F.col(f"p.{y}") == F.col(f"q.{y}")).where(F.col(f"p.{x}") < F.col(f"q.{x}"))
        ratio = pair.select(F.col(f"p.{x}").alias("a"), F.col(f"q.{x}").alias("b"), (F.col("p.l") - F.col("q.l")).alias("d"))
        spread = ratio.groupBy("a", "b").agg((F.max("d") - F.min("d")).alias("s"))
        return spread.agg(F.tanh(F.max("s") / 4).alias("value"))

    # scalar queries: one-row DataFrames

    def norm_constant(self) -> DataFrame:
        return self.df.agg(F.sum("value").alias("value"))

    def entropy(self, base: float | None = None) -> DataFrame:
        scale = 1.0 if base is None else math.log(base)
        return self.df.agg((F.sum(scalar.entropy_term(F.col("value"))) / scale).alias("value"))

    def _paired(self, other: Factor, term: Callable[[Column, Column], Column], fold: Callable[[Column], Column]) -> DataFrame:
        return self.combine(other, term).df.agg(fold(F.col("value")).alias("value"))

    def relative_entropy(self, other: Factor) -> DataFrame:
        return self._paired(other, scalar.kl_term, lambda v: F.greatest(F.sum(v), F.lit(0.0)))

    def js_divergence(self, other: Factor) -> DataFrame:
        """Mean relative entropy of both factors to their average."""
        def term(p: Column, q: Column) -> Column:
            m = (p + q) / 2
            return (scalar.kl_term(p, m) + scalar.kl_term(q, m)) / 2

        return self._paired(other, term, lambda v: F.greatest(F.sum(v), F.lit(0.0)))

    def cross_entropy(self, other: Factor) -> DataFrame:
        return self._paired(other, scalar.cross_entropy_term, F.sum)

    def mutual_information(self, a: tuple[str, ...], b: tuple[str, ...]) -> DataFrame:
        """Of the arguments a and b under this (normalised) factor; 0 log 0 is 0."""
        joint = self.marginal(*a, *b).df
        pa, pb = F.sum("value").over(Window.partitionBy(*a)), F.sum("value").over(Window.partitionBy(*b))
        terms = joint.select("value", (pa * pb).alias("_m"))
        return terms.agg(F.sum(F.when(F.col("value") > 0, F.col("value") * F.ln(F.col("value") / F.col("_m"))).otherwise(0.0)).alias("value"))

    def norm_1(self, other: Factor) -> DataFrame:
        return self._paired(other, "abs_difference", F.sum)

    def norm_inf(self, other: Factor) -> DataFrame:
        return self._paired(other, "abs_difference", F.max)

    def arg_max(self) -> DataFrame:
        """The arguments of the largest value; ties go to the first in storage order (last argument most significant)."""
        return self.df.orderBy(F.desc("value"), *reversed(self.args)).limit(1)

    def arg_min(self) -> DataFrame:
        return self.df.orderBy(F.asc("value"), *reversed(self.args)).limit(1)

    def differs_from(self, other: Factor, tol: float = 0.0) -> DataFrame:
        """Number of rows that the factors do not share up to tol, whatever the argument order."""
        both = self.df.join(other.df.withColumnRenamed("value", "_right"), list(self.args), "full")
        same = (F.abs(F.col("value") - F.col("_right")) <= tol) & F.col("value").isNotNull() & F.col("_right").isNotNull()
        return both.agg(F.count(F.when(~F.coalesce(same, F.lit(False)), 1)).alias("value"))

    def log_likelihood(self, data: DataFrame, weight: str | None = None) -> DataFrame:
        """Sum over the rows of data of weight * log value; the data are grouped before the join."""
        w = F.col(weight) if weight else F.lit(1.0)
        counts = data.groupBy(*self.args).agg(F.sum(w).alias("_w"))
        return counts.join(self.df, list(self.args), "left").agg(F.sum(F.col("_w") * scalar.log(F.coalesce("value", F.lit(0.0)))).alias("value"))


def product(factors: list[Factor], semiring: Semiring = SUM_PRODUCT) -> Factor:
    """The n-ary combine of factors."""
    return reduce(lambda a, b: a.combine(b, semiring.combine), factors)
