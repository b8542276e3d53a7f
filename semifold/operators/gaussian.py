"""Gaussian factors in information form, one for each row of a table of keys: log f(x) = xi + eta.x - x.Lambda.x / 2.

A table without key columns is one factor; with key columns it is a hybrid factor, a Gaussian for each assignment of the
finite arguments. Products and quotients join on shared keys and add or subtract native array columns; marginals and
moments invert small blocks of all rows of an Arrow batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stacked(values: pd.Series, *shape: int) -> np.ndarray:
    return np.array(values.tolist(), dtype=float).reshape(len(values), *shape)


class Gaussians:
    """df: keys, eta (array), lam (array, row by row) and xi; args: the names of the vector's components."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...], args: tuple[str, ...]):
        self.keys, self.args = tuple(keys), tuple(args)
        self.df = df.select(*keys, "eta", "lam", "xi")

    @classmethod
    def from_moments(cls, df: DataFrame, keys: tuple[str, ...], args: tuple[str, ...], mean: str = "mean", cov: str = "cov") -> Gaussians:
        """Densities from mean (array) and cov (array, row by row); an error where cov is singular."""
        d = len(args)

        @F.pandas_udf("eta array<double>, lam array<double>, xi double")
        def inverted(m: pd.Series, c: pd.Series) -> pd.DataFrame:
            mu, lam = _stacked(m, d), np.linalg.inv(_stacked(c, d, d))
            eta = np.einsum("nij,nj->ni", lam, mu)
            xi = 0.5 * (np.linalg.slogdet(lam)[1] - d * np.log(2 * np.pi) - (eta * mu).sum(axis=1))
            return pd.DataFrame({"eta": list(eta), "lam": list(lam.reshape(len(mu), -1)), "xi": xi})

        return cls(df.withColumn("_g", inverted(mean, cov)).select(*keys, "_g.*"), keys, args)

    def _spread(self, args: tuple[str, ...], side: str) -> tuple[list[Column], list[Column]]:
        """eta and lam of this factor over more arguments, zero where it says nothing."""
        at = {a: k for k, a in enumerate(self.args)}
        eta = [F.get(f"{side}eta", F.lit(at[a])) if a in at else F.lit(0.0) for a in args]
        lam = [F.get(f"{side}lam", F.lit(at[a] * len(at) + at[b])) if a in at and b in at else F.lit(0.0) for a in args for b in args]
        return eta, lam

    def _combined(self, other: Gaussians, sign: int) -> Gaussians:
        args = (*self.args, *(a for a in other.args if a not in self.args))
        shared = [k for k in self.keys if k in other.keys]
        right = other.df.withColumnsRenamed({c: f"_r_{c}" for c in ("eta", "lam", "xi")})
        both = self.df.join(right, shared) if shared else self.df.crossJoin(right)
        (e1, l1), (e2, l2) = self._spread(args, ""), other._spread(args, "_r_")
        eta, lam = F.array(*(a + sign * b for a, b in zip(e1, e2, strict=True))), F.array(*(a + sign * b for a, b in zip(l1, l2, strict=True)))
        keys = (*self.keys, *(k for k in other.keys if k not in self.keys))
        return Gaussians(both.select(*keys, eta.alias("eta"), lam.alias("lam"), (F.col("xi") + sign * F.col("_r_xi")).alias("xi")), keys, args)

    def __mul__(self, other: Gaussians) -> Gaussians:
        return self._combined(other, 1)

    def __truediv__(self, other: Gaussians) -> Gaussians:
        return self._combined(other, -1)

    def weighted(self, w: Column | float) -> Gaussians:
        """The factor to the power w: damping, or the exponent of a likelihood."""
        w = w if isinstance(w, Column) else F.lit(float(w))
        return Gaussians(self.df.withColumns({"eta": F.transform("eta", lambda x: x * w), "lam": F.transform("lam", lambda x: x * w), "xi": F.col("xi") * w}), self.keys, self.args)

    def reorder(self, *args: str) -> Gaussians:
        eta, lam = self._spread(args, "")
        return Gaussians(self.df.select(*self.keys, F.array(*eta).alias("eta"), F.array(*lam).alias("lam"), "xi"), self.keys, args)

    def restrict(self, values: dict[str, Column | float]) -> Gaussians:
        """The factor at the given components: the rest moves into eta and xi. Values may be columns of the keys."""
        d = len(self.args)
        at = {a: k for k, a in enumerate(self.args)}
        fixed = {a: v if isinstance(v, Column) else F.lit(float(v)) for a, v in values.items() if a in at}
        rest = tuple(a for a in self.args if a not in fixed)
        lam = lambda a, b: F.get("lam", F.lit(at[a] * d + at[b]))
        eta = [F.get("eta", F.lit(at[a])) - sum((lam(a, b) * v for b, v in fixed.items()), F.lit(0.0)) for a in rest]
        xi = F.col("xi") + sum((F.get("eta", F.lit(at[b])) * v for b, v in fixed.items()), F.lit(0.0)) - sum((lam(b, c) * v * w for b, v in fixed.items() for c, w in fixed.items()), F.lit(0.0)) / 2
        empty = F.array().cast("array<double>")
        return Gaussians(self.df.select(*self.keys, F.array(*eta).alias("eta") if rest else empty.alias("eta"), F.array(*(lam(a, b) for a in rest for b in rest)).alias("lam") if rest else empty.alias("lam"), xi.alias("xi")), self.keys, rest)

    def _without(self, retain: tuple[str, ...], integrate: bool) -> Gaussians:
        keep = [k for k, a in enumerate(self.args) if a in retain]
        drop = [k for k, a in enumerate(self.args) if a not in retain]
        d = len(self.args)
        if not drop:
            return self

        @F.pandas_udf("eta array<double>, lam array<double>, xi double")
        def reduced(eta: pd.Series, lam: pd.Series, xi: pd.Series) -> pd.DataFrame:
            e, m = _stacked(eta, d), _stacked(lam, d, d)
            block, cross = m[:, drop][:, :, drop], m[:, keep][:, :, drop]
            gain = np.linalg.solve(block.transpose(0, 2, 1), cross.transpose(0, 2, 1)).transpose(0, 2, 1)
            left = e[:, keep] - np.einsum("nij,nj->ni", gain, e[:, drop])
            info = m[:, keep][:, :, keep] - gain @ cross.transpose(0, 2, 1)
            top = 0.5 * np.einsum("ni,ni->n", e[:, drop], np.linalg.solve(block, e[:, drop][:, :, None])[:, :, 0])
            more = 0.5 * (len(drop) * np.log(2 * np.pi) - np.linalg.slogdet(block)[1]) if integrate else 0.0
            return pd.DataFrame({"eta": list(left), "lam": list(info.reshape(len(e), -1)), "xi": xi.to_numpy() + top + more})

        return Gaussians(self.df.withColumn("_g", reduced("eta", "lam", "xi")).select(*self.keys, "_g.*"), self.keys, tuple(self.args[k] for k in keep))

    def marginal(self, *retain: str) -> Gaussians:
        return self._without(retain, True)

    def maximum(self, *retain: str) -> Gaussians:
        return self._without(retain, False)

    def conditional(self, *tail: str) -> Gaussians:
        """The factor over its marginal on tail, in the order of the factor's arguments."""
        return (self / self.marginal(*tail)).reorder(*self.args)

    def log_norm(self) -> DataFrame:
        """keys and the logarithm of the integral."""
        return self.marginal().df.select(*self.keys, F.col("xi").alias("value"))

    def normalize(self) -> Gaussians:
        z = self.log_norm().withColumnRenamed("value", "_z")
        both = self.df.join(z, list(self.keys)) if self.keys else self.df.crossJoin(z)
        return Gaussians(both.withColumn("xi", F.col("xi") - F.col("_z")), self.keys, self.args)

    def moments(self) -> DataFrame:
        """keys, mean (array), cov (array, row by row), log_norm and entropy."""
        d = len(self.args)

        @F.pandas_udf("mean array<double>, cov array<double>, log_norm double, entropy double")
        def made(eta: pd.Series, lam: pd.Series, xi: pd.Series) -> pd.DataFrame:
            e, cov = _stacked(eta, d), np.linalg.inv(_stacked(lam, d, d))
            mu = np.einsum("nij,nj->ni", cov, e)
            half = 0.5 * (np.linalg.slogdet(cov)[1] + d * np.log(2 * np.pi))
            return pd.DataFrame({"mean": list(mu), "cov": list(cov.reshape(len(e), -1)), "log_norm": xi.to_numpy() + half + 0.5 * (e * mu).sum(axis=1), "entropy": half + 0.5 * d})

        return self.df.withColumn("_g", made("eta", "lam", "xi")).select(*self.keys, "_g.*")

    def log_value(self, df: DataFrame) -> DataFrame:
        """df (keys and a column for each argument) with value, the factor's logarithm at each row."""
        at = F.array(*(F.col(a).cast("double") for a in self.args))
        d = len(self.args)
        linear = sum((F.get("eta", F.lit(k)) * F.get(at, F.lit(k)) for k in range(d)), F.lit(0.0))
        square = sum((F.get("lam", F.lit(j * d + k)) * F.get(at, F.lit(j)) * F.get(at, F.lit(k)) for j in range(d) for k in range(d)), F.lit(0.0))
        both = df.join(self.df, list(self.keys)) if self.keys else df.crossJoin(self.df)
        return both.withColumn("value", F.col("xi") + linear - square / 2).drop("eta", "lam", "xi")

    def relative_entropy(self, other: Gaussians) -> DataFrame:
        """keys and KL(self || other) of normalised factors over the same arguments, for each pair of shared keys."""
        d = len(self.args)
        shared = [k for k in self.keys if k in other.keys]
        a = self.moments().select(*self.keys, "mean", "cov")
        b = other.reorder(*self.args).moments().select(*other.keys, F.col("mean").alias("_m"), F.col("cov").alias("_c"))

        @F.pandas_udf("double")
        def kl(m: pd.Series, c: pd.Series, m2: pd.Series, c2: pd.Series) -> pd.Series:
            mu, s, nu, t = _stacked(m, d), _stacked(c, d, d), _stacked(m2, d), _stacked(c2, d, d)
            inv, diff = np.linalg.inv(t), nu - mu
            trace = np.einsum("nij,nji->n", inv, s)
            return pd.Series(0.5 * (trace + np.einsum("ni,nij,nj->n", diff, inv, diff) - d + np.linalg.slogdet(t)[1] - np.linalg.slogdet(s)[1]))

        both = a.join(b, shared) if shared else a.crossJoin(b)
        return both.withColumn("value", kl("mean", "cov", "_m", "_c")).select(*self.keys, *(k for k in other.keys if k not in self.keys), "value")

    def mixture(self, weights: DataFrame, keep: tuple[str, ...] = ()) -> Gaussians:
        """The moment-matched Gaussian of the mixture with weights (keys, weight) over the keys that are not kept."""
        d = len(self.args)
        m = self.moments().join(weights, list(self.keys))
        w, g = F.col("weight"), (lambda c, k: F.get(c, F.lit(k)))
        first = [F.sum(w * g("mean", k)).alias(f"_m{k}") for k in range(d)]
        second = [F.sum(w * (g("cov", j * d + k) + g("mean", j) * g("mean", k))).alias(f"_s{j}_{k}") for j in range(d) for k in range(d)]
        one = m.groupBy(*keep).agg(F.sum(w).alias("_w"), *first, *second)
        mean = [F.col(f"_m{k}") / F.col("_w") for k in range(d)]
        cov = [F.col(f"_s{j}_{k}") / F.col("_w") - mean[j] * mean[k] for j in range(d) for k in range(d)]
        return Gaussians.from_moments(one.select(*keep, F.array(*mean).alias("mean"), F.array(*cov).alias("cov")), keep, self.args)


def estimate(df: DataFrame, keys: tuple[str, ...], args: tuple[str, ...], weight: str | None = None) -> Gaussians:
    """Maximum likelihood Gaussians of the columns args for each key: one group-by of sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    x = [F.col(a).cast("double") for a in args]
    d = len(args)
    sums = [F.sum(w * v).alias(f"_m{k}") for k, v in enumerate(x)] + [F.sum(w * x[j] * x[k]).alias(f"_s{j}_{k}") for j in range(d) for k in range(j, d)]
    one = df.dropna(subset=list(args)).groupBy(*keys).agg(F.sum(w).alias("_w"), *sums)
    mean = [F.col(f"_m{k}") / F.col("_w") for k in range(d)]
    cov = [F.col(f"_s{min(j, k)}_{max(j, k)}") / F.col("_w") - mean[j] * mean[k] for j in range(d) for k in range(d)]
    return Gaussians.from_moments(one.select(*keys, F.array(*mean).alias("mean"), F.array(*cov).alias("cov")), keys, args)
