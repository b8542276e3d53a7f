"""Minimisers for learners: the objective is a Spark aggregate, the parameters are a short vector on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Options:
    """steps: most rounds; tolerance: largest gradient component at which to stop; memory: of L-BFGS."""

    steps: int = 200
    tolerance: float = 1e-6
    memory: int = 8
    rate: float = 1.0


def line_search(f: Objective, x: np.ndarray, value: float, g: np.ndarray, way: np.ndarray, first: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Halves the step until the value falls by a share of what the slope promises."""
    step, slope = first, float(g @ way)
    for _ in range(40):
        at = x + step * way
        v, h = f(at)
        if np.isfinite(v) and v <= value + 1e-4 * step * slope:
            return at, v, h
        step /= 2
    return x, value, g


def minimise(f: Objective, x: np.ndarray, method: str = "lbfgs", options: Options = Options()) -> np.ndarray:
    """gradient (steepest descent), conjugate (Polak-Ribiere) or lbfgs."""
    value, g = f(x)
    way, pairs, rate = -g, [], options.rate
    for _ in range(options.steps):
        if np.abs(g).max(initial=0.0) <= options.tolerance:
            break
        if float(way @ g) >= 0:
            way, pairs = -g, []
        new, v, h = line_search(f, x, value, g, way, rate)
        if not (new != x).any():
            if not pairs and (way == -g).all():
                break
            way, pairs = -g, []
            continue
        s, y = new - x, h - g
        x, value, old, g = new, v, g, h
        if method == "lbfgs":
            if float(s @ y) > 1e-12:
                pairs = [*pairs, (s, y)][-options.memory :]
            q, back = g.copy(), []
            for a, b in reversed(pairs):
                c = float(a @ q) / float(a @ b)
                back.append(c)
                q -= c * b
            if pairs:
                q *= float(pairs[-1][0] @ pairs[-1][1]) / float(pairs[-1][1] @ pairs[-1][1])
            for (a, b), c in zip(pairs, reversed(back), strict=True):
                q += (c - float(b @ q) / float(a @ b)) * a
            way = -q
        elif method == "conjugate":
            way = -g + max(0.0, float(g @ (g - old)) / max(float(old @ old), 1e-300)) * way
        else:
            way = -g
    return x


def gradient_error(f: Objective, x: np.ndarray, h: float = 1e-5) -> float:
    """The largest difference between the gradient and central differences of the value."""
    g = f(x)[1]
    out = 0.0
    for k in range(len(x)):
        e = np.zeros(len(x))
        e[k] = h
        out = max(out, abs((f(x + e)[0] - f(x - e)[0]) / (2 * h) - g[k]))
    return out
