"""Mixture factors: weighted sums of Gaussian factors over the same arguments, for each assignment of finite keys.

A mixture is a table of Gaussian factors with one more key, the component; a component's weight is the integral of its
factor. Products pair the components of both sides within the shared keys, so they multiply in number; `pruned` bounds the
number again by a stated rule. All else works component by component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semifold.operators.gaussian import Gaussians

COMPONENT = "component"


class Mixture:
    """parts: Gaussian factors whose last key is `component` (a string)."""

    def __init__(self, parts: Gaussians):
        if parts.keys[-1:] != (COMPONENT,):
            raise ValueError("the last key must be the component")
        self.parts, self.keys, self.args = parts, parts.keys[:-1], parts.args

    @classmethod
    def of(cls, parts: Gaussians, weights: DataFrame, weight: str = "weight") -> Mixture:
        """Normalised Gaussians with weights (keys and component, weight)."""
        g = parts.normalize()
        df = g.df.join(weights.select(*g.keys, F.col(weight).alias("_w")), list(g.keys)).withColumn("xi", F.col("xi") + F.ln("_w"))
        return cls(Gaussians(df, g.keys, g.args))

    def __mul__(self, other: Mixture | Gaussians) -> Mixture:
        """With a mixture: each pair of components; with a Gaussian factor: each component with it."""
        if isinstance(other, Gaussians):
            both = self.parts * other
            keys = (*(k for k in both.keys if k != COMPONENT), COMPONENT)
            return Mixture(Gaussians(both.df, keys, both.args))
        right = Gaussians(other.parts.df.withColumnRenamed(COMPONENT, "_other"), (*other.keys, "_other"), other.args)
        both = self.parts * right
        keys = tuple(k for k in both.keys if k not in (COMPONENT, "_other"))
        return Mixture(Gaussians(both.df.withColumn(COMPONENT, F.concat_ws("*", COMPONENT, "_other")), (*keys, COMPONENT), both.args))

    def __add__(self, other: Mixture) -> Mixture:
        """All components of both, over the same keys and arguments; the left ones are named <, the right ones >."""
        named = lambda m, sign: m.parts.reorder(*self.args).df.withColumn(COMPONENT, F.concat(F.lit(sign), COMPONENT))
        return Mixture(Gaussians(named(self, "<").unionByName(named(other, ">")), self.parts.keys, self.args))

    def marginal(self, *retain: str) -> Mixture:
        return Mixture(self.parts.marginal(*retain))

    def restrict(self, values: dict) -> Mixture:
        return Mixture(self.parts.restrict(values))

    def weights(self) -> DataFrame:
        """keys, component and weight, the share of the component in the integral over all of them."""
        z = self.parts.log_norm()
        top = F.max("value").over(Window.partitionBy(*self.keys))
        w = z.withColumn("weight", F.exp(F.col("value") - top))
        return w.select(*self.parts.keys, (F.col("weight") / F.sum("weight").over(Window.partitionBy(*self.keys))).alias("weight"))

    def log_norm(self) -> DataFrame:
        """keys and value, the logarithm of the integral."""
        z = self.parts.log_norm().withColumn("_t", F.max("value").over(Window.partitionBy(*self.keys)))
        return z.groupBy(*self.keys).agg((F.ln(F.sum(F.exp(F.col("value") - F.col("_t")))) + F.first("_t")).alias("value"))

    def normalize(self) -> Mixture:
        z = self.log_norm().withColumnRenamed("value", "_z")
        df = self.parts.df.join(z, list(self.keys)) if self.keys else self.parts.df.crossJoin(z)  # one row of _z a key
        return Mixture(Gaussians(df.withColumn("xi", F.col("xi") - F.col("_z")), self.parts.keys, self.args))

    def density(self, rows: DataFrame) -> DataFrame:
        """rows (keys and a column for each argument, distinct) with value, the mixture's logarithm there."""
        columns = rows.columns
        names = self.parts.df.select(*self.parts.keys)
        asked = rows.join(names, list(self.keys)) if self.keys else rows.crossJoin(names)  # a row for each component
        each = self.parts.log_value(asked).withColumn("_t", F.max("value").over(Window.partitionBy(*columns)))
        return each.groupBy(*columns).agg((F.ln(F.sum(F.exp(F.col("value") - F.col("_t")))) + F.first("_t")).alias("value"))

    def collapsed(self) -> Gaussians:
        """The Gaussian of the same weight, mean and covariance."""
        one = self.parts.mixture(self.weights(), self.keys)
        z = self.log_norm().withColumnRenamed("value", "_z")
        df = one.df.join(z, list(self.keys)) if self.keys else one.df.crossJoin(z)
        return Gaussians(df.withColumn("xi", F.col("xi") + F.col("_z")), self.keys, self.args)

    def pruned(self, most: int) -> Mixture:
        """For each key the most - 1 heaviest components (ties by name) and one more for all others, of their weight, mean and
        covariance: the mixture's own weight, mean and covariance do not change."""
        rank = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("weight"), COMPONENT))
        ranked = self.weights().withColumn("_lot", F.when(rank < most, F.col(COMPONENT)).otherwise(F.lit("rest")))
        moved = Gaussians(self.parts.df.join(ranked.select(*self.parts.keys, "_lot"), list(self.parts.keys)), (*self.parts.keys, "_lot"), self.args)
        lots = ranked.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(*self.keys, "_lot")))
        one = moved.mixture(lots, (*self.keys, "_lot"))
        share = ranked.groupBy(*self.keys, "_lot").agg(F.sum("weight").alias("_w"))
        z = self.log_norm().withColumnRenamed("value", "_z")
        scaled = one.df.join(share, [*self.keys, "_lot"])
        scaled = scaled.join(z, list(self.keys)) if self.keys else scaled.crossJoin(z)
        df = scaled.withColumn("xi", F.col("xi") + F.ln("_w") + F.col("_z")).withColumnRenamed("_lot", COMPONENT)
        return Mixture(Gaussians(df, self.parts.keys, self.args))
