"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns, all JVM-side."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value worked out once per row, not once per entry of a lambda that uses it."""
    return F.transform(F.array(value), fn)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def unit(v: Column, eps: float = 1e-12) -> Column:
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, k: Column | float) -> Column:
    factor = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(v, lambda x: x * factor)


def matvec(weights: Sequence[Sequence[float]], v: Column, bias: Sequence[float] | None = None) -> Column:
    """``W v (+ b)`` for a literal matrix."""
    out = F.transform(F.array(*[literal(row) for row in weights]), lambda row: dot(row, v))
    return out if bias is None else add(out, literal(bias))


def softmax(v: Column) -> Column:
    raised = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(raised, lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def erf(x: Column) -> Column:
    """Error function by a rational approximation (Abramowitz and Stegun 7.1.26, |error| < 1.5e-7)."""
    # The published coefficients.
    p, coefficients = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1.0 / (1.0 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + F.lit(c)) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def activate(name: str, x: Column, slope: float = 0.25) -> Column:
    """Scalar activation by name; an unknown name means relu. ``slope`` is the prelu weight."""
    name = name.lower()
    if name == "leaky_relu":
        return F.when(x >= 0, x).otherwise(x * 0.01)
    if name == "prelu":
        return F.when(x >= 0, x).otherwise(x * slope)
    if name == "elu":
        return F.when(x > 0, x).otherwise(F.exp(x) - 1.0)
    if name == "gelu":
        return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))
    if name == "tanh":
        return F.tanh(x)
    if name == "sigmoid":
        return sigmoid(x)
    if name in ("identity", "none", "linear"):
        return x
    return F.greatest(x, F.lit(0.0))


def activate_all(name: str, v: Column) -> Column:
    return F.transform(v, lambda x: activate(name, x))


def standardise(v: Column, eps: float = 1e-5) -> Column:
    """Layer norm of one row: zero mean, unit population variance over the vector's own entries."""
    def scaled(mean: Column) -> Column:
        variance = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.size(v)
        return let(F.sqrt(variance + F.lit(eps)), lambda s: F.transform(v, lambda x: (x - mean) / s))

    return let(total(v) / F.size(v), scaled)


def reduce_columns(name: str, dim: int, fn) -> Column:
    """Per-dimension aggregate of a vector column: ``fn`` over entry 0..dim-1, back as an array.

    One aggregate buffer per entry keeps a row per edge (no explode) and combines before the shuffle.
    """
    return F.array(*[fn(F.col(name).getItem(i)) for i in range(dim)])
