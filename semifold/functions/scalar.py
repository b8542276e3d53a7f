"""Scalar functions as Column expressions: guarded arithmetic, log-space numbers, information terms, links, strings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF, POS_INF = float("-inf"), float("inf")
#: Fixed value: the logarithm that stands for that of zero in relative entropies.
LEAST_LOG = -700.0


def safe_divide(a: Column, b: Column) -> Column:
    """a / b with 0/0 = 0; any other division by zero is an error."""
    return F.when((b == 0) & (a == 0), F.lit(0.0)).when(b == 0, F.raise_error(F.lit("division of a nonzero value by zero"))).otherwise(F.try_divide(a, b))


def log(x: Column) -> Column:
    """Natural logarithm with log(0) = -inf; a negative value is an error."""
    return F.when(x == 0, F.lit(NEG_INF)).when(x < 0, F.raise_error(F.lit("logarithm of a negative value"))).otherwise(F.ln(x))


def reciprocal(x: Column) -> Column:
    return F.when(x == 0, F.lit(POS_INF)).otherwise(F.try_divide(F.lit(1.0), x))


def is_positive_finite(x: Column) -> Column:
    return (x > 0) & (x < POS_INF) & ~F.isnan(x)


def close(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) < tol


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    top = F.greatest(a, b)
    return F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(top + F.log1p(F.exp(F.least(a, b) - top)))


def log_subtract(a: Column, b: Column) -> Column:
    """log(exp(a) - exp(b)), -inf where they are equal; an error where b is larger."""
    return F.when(a == b, F.lit(NEG_INF)).when(b > a, F.raise_error(F.lit("logarithm of a negative difference"))).otherwise(a + F.log1p(-F.exp(b - a)))


def sign(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def entropy_term(p: Column) -> Column:
    """-p log p, 0 at 0."""
    return F.when(p > 0, -p * F.ln(p)).when(p == 0, F.lit(0.0)).otherwise(F.raise_error(F.lit("entropy of a negative value")))


def kl_term(p: Column, q: Column) -> Column:
    """p (log p - log q), with log q held at LEAST_LOG where q is 0 and 0 where p is 0."""
    held = F.when(q > 0, F.greatest(F.ln(q), F.lit(LEAST_LOG))).otherwise(F.lit(LEAST_LOG))
    return F.when(p > 0, p * (F.ln(p) - held)).otherwise(0.0)


def cross_entropy_term(p: Column, q: Column) -> Column:
    """|p log q|: 0 where p is 0, infinite where q alone is 0."""
    return F.when(p == 0, F.lit(0.0)).when(q == 0, F.lit(POS_INF)).otherwise(F.abs(p * F.ln(q)))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: list[Column]) -> list[Column]:
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    e = [F.exp(x - top) for x in xs]
    return [v / sum(e[1:], e[0]) for v in e]


def split_any(text: Column, separators: str) -> Column:
    """Parts of text between runs of any of the separator characters; no part is empty."""
    cls = "".join(f"\\u{ord(c):04x}" for c in separators)
    return F.filter(F.split(text, f"[{cls}]+"), lambda x: x != "")


def swap_chars(text: Column, old: str, new: str) -> Column:
    return F.translate(text, old, new * len(old))


def non_alnum_to(text: Column, new: str) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", new)


CONSTANTS = {"pi": math.pi, "e": math.e, "ln_two": math.log(2), "two_pi": 2 * math.pi, "root_two": math.sqrt(2), "log10_two": math.log10(2)}
