"""Gaussian approximations of what is not Gaussian: transformed variables, and densities by their mode.

Both work on many small problems at a time, one a row, in numpy over Arrow batches: `transformed` takes the moments of a
function of Gaussian variables at integration points of degree five (exact where the function's products are polynomials of
degree five or less), `laplace` puts a Gaussian at the mode of a log density by Newton's steps on its differences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semifold.operators.gaussian import Gaussians, _stacked


def integration_points(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Points (n x d) and weights for the standard normal, exact for all polynomials of degree five: the centre, two points on
    each axis and four on each plane of two axes."""
    u, eye = np.sqrt(3.0), np.eye(d)
    axis = [s * u * eye[i] for i in range(d) for s in (1, -1)]
    plane = [u * (s * eye[i] + t * eye[j]) for i in range(d) for j in range(i) for s in (1, -1) for t in (1, -1)]
    weights = [1 - 2 * d * (4 - d) / 18 - len(plane) / 36, *[(4 - d) / 18] * len(axis), *[1 / 36] * len(plane)]
    return np.array([np.zeros(d), *axis, *plane]), np.array(weights)


def transformed(g: Gaussians, f: Callable[[np.ndarray], np.ndarray], names: tuple[str, ...]) -> DataFrame:
    """keys, mean and cov (row by row) of (arguments of g, then names): the joint moments of x and y = f(x). f
    takes rows of points (n x arguments) and returns n x names."""
    d, m = len(g.args), len(names)
    points, weights = integration_points(d)

    @F.pandas_udf("mean array<double>, cov array<double>")
    def moments(mean: pd.Series, cov: pd.Series) -> pd.DataFrame:
        mu, s = _stacked(mean, d), _stacked(cov, d, d)
        x = mu[:, None, :] + np.einsum("pj,nij->npi", points, np.linalg.cholesky(s))
        y = np.asarray(f(x.reshape(-1, d)), float).reshape(len(mu), len(points), m)
        both = np.concatenate([x, y], axis=2)
        centre = np.einsum("p,npi->ni", weights, both)
        off = both - centre[:, None]
        spread = np.einsum("p,npi,npj->nij", weights, off, off)
        return pd.DataFrame({"mean": list(centre), "cov": list(spread.reshape(len(mu), -1))})

    return g.moments().withColumn("_g", moments("mean", "cov")).select(*g.keys, "_g.*")


def conditional(joint: DataFrame, keys: tuple[str, ...], args: tuple[str, ...], names: tuple[str, ...], noise: float) -> Gaussians:
    """The Gaussian factor p(names | args) of joint moments, with noise added to the variance of names."""
    n, d = len(args) + len(names), len(args)
    extra = F.transform("cov", lambda v, k: v + F.when((k % (n + 1) == 0) & (k / (n + 1) >= d), noise).otherwise(0.0))
    both = Gaussians.from_moments(joint.withColumn("cov", extra), keys, (*args, *names))
    return both.conditional(*args)


def laplace(df: DataFrame, keys: tuple[str, ...], args: tuple[str, ...], log_density: Callable[[np.ndarray, pd.DataFrame], np.ndarray], parameters: list[str], start: list[str], steps: int = 60, h: float = 1e-4) -> DataFrame:
    """keys, mean, cov (row by row) and log_norm of the Gaussian at the mode of each row's density. log_density takes points
    (n x args) and the n rows' parameters, and returns n logarithms; it must have one mode that Newton's steps, halved where
    they do not rise, reach from the columns start. A mode without curvature raises an error."""
    d = len(args)
    eye = np.eye(d)

    def shape(x: np.ndarray, p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = log_density(x, p)
        up, down = (np.stack([log_density(x + s * h * eye[i], p) for i in range(d)], axis=1) for s in (1, -1))
        hess = np.empty((len(x), d, d))
        for i in range(d):
            hess[:, i, i] = (up[:, i] - 2 * at + down[:, i]) / h**2
            for j in range(i):
                a, b = h * eye[i], h * eye[j]
                hess[:, i, j] = hess[:, j, i] = (log_density(x + a + b, p) - log_density(x + a - b, p) - log_density(x - a + b, p) + log_density(x - a - b, p)) / (4 * h * h)
        return at, (up - down) / (2 * h), hess

    def run(batches):
        for pdf in batches:
            p, x = pdf[parameters], pdf[start].to_numpy(float)
            for _ in range(steps if len(x) else 0):
                at, slope, hess = shape(x, p)
                lift = np.maximum(np.linalg.eigvalsh(hess)[:, -1] + 1e-6, 0)  # a step must rise where the density is not concave
                way = np.linalg.solve(-hess + 2 * lift[:, None, None] * eye, slope[:, :, None])[:, :, 0]
                size = np.ones(len(x))
                for _ in range(40):
                    low = ~(log_density(x + size[:, None] * way, p) >= at - 1e-12)
                    if not low.any():
                        break
                    size[low] /= 2
                x = x + size[:, None] * way
                if np.abs(size[:, None] * way).max() < 1e-9:
                    break
            at, _, hess = shape(x, p)
            if len(x) and np.linalg.eigvalsh(hess)[:, -1].max() >= 0:
                raise ValueError("a density has no curvature at its mode")
            cov = np.linalg.inv(-hess) if len(x) else hess
            norm = at + 0.5 * (d * np.log(2 * np.pi) + (np.linalg.slogdet(cov)[1] if len(x) else 0.0))
            yield pdf[list(keys)].assign(mean=list(x), cov=list(cov.reshape(len(x), -1)), log_norm=norm)

    kinds = dict(df.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "mean array<double>, cov array<double>, log_norm double"
    return df.select(*keys, *dict.fromkeys([*parameters, *start])).mapInPandas(run, schema)
