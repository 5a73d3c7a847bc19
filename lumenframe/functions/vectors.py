"""Vector and scalar expressions. Arrays are ARRAY<DOUBLE> of equal length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: str | Column) -> Column:
    """An array of numbers as doubles; products are only taken of these."""
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def rbf(a: Column, b: Column, gamma: float | Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """exp(-gamma |a - b|^2) from squared norms, which callers keep where they have them."""
    na = squared_norm(a) if norm_a is None else norm_a
    nb = squared_norm(b) if norm_b is None else norm_b
    return F.exp(-F.lit(gamma) * (na + nb - 2 * dot(a, b)))


def linear_kernel(a: Column, b: Column) -> Column:
    return dot(a, b)


def polynomial_kernel(a: Column, b: Column, scale: float, shift: float, degree: float) -> Column:
    return F.pow(F.lit(scale) * dot(a, b) + F.lit(shift), F.lit(degree))


def sigmoid_kernel(a: Column, b: Column, scale: float, shift: float) -> Column:
    return F.tanh(F.lit(scale) * dot(a, b) + F.lit(shift))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b; `otherwise` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    return F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)


def differs(a: Column, b: Column, epsilon: float) -> Column:
    """Whether |a - b| < epsilon fails; NaN and null differ."""
    return ~F.coalesce((F.abs(a - b) < epsilon) & ~F.isnan(a - b), F.lit(False))


def block_of(i: Column, size: int) -> tuple[Column, Column]:
    """Number of a block and place in it."""
    return F.floor(i / size).cast("long"), F.pmod(i, F.lit(size))


ACTIVATIONS = {
    "linear": lambda x: x,
    "tanh": F.tanh,
    "logistic": lambda x: 1 / (1 + F.exp(-x)),
    "elliott": lambda x: x / (1 + F.abs(x)),
}
#: Operations that one application counts for in the throughput estimate.
ACTIVATION_FLOPS = {"linear": 0, "elliott": 3, "tanh": 7, "logistic": 7}


def weighted(terms: list[tuple[Column, float]], bias: float) -> Column:
    """bias + the sum of column x weight, in the given order."""
    return reduce(lambda s, t: s + t[0] * F.lit(float(t[1])), terms, F.lit(float(bias)))
