"""Vector functions on array columns, in doubles, stable for large values (softmax family of 2.8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)); the exponent is never above 0, so nothing overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def silu(x: Column) -> Column:
    """x * sigmoid(x)."""
    return x * sigmoid(x)


def softplus(x: Column) -> Column:
    """log(1 + exp(x))."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gated(gate: Column, up: Column) -> Column:
    """silu(gate) * up, place by place."""
    return F.zip_with(doubles(gate), doubles(up), lambda g, u: silu(g) * u)


def rms_norm(vector: Column, weight: Column | None = None, eps: float = 1e-5) -> Column:
    """The vector over the root of its mean square plus eps, times a weight for each place; an empty vector stays empty."""
    v = doubles(vector)
    scale = F.sqrt(_sum(F.transform(v, lambda x: x * x)) / F.size(v) + eps)
    normed = let(scale, lambda s: F.transform(v, lambda x: x / s))
    return normed if weight is None else F.zip_with(normed, doubles(weight), lambda x, w: x * w)


def cosine(left: Column, right: Column, least: float | None = None, eps: float = 1e-8) -> Column:
    """Cosine of two vectors, each norm counted as eps at least, and the cosine as `least` at least."""
    a, b = doubles(left), doubles(right)
    norm = lambda v: F.greatest(F.sqrt(_sum(F.transform(v, lambda x: x * x))), F.lit(eps))
    out = _sum(F.zip_with(a, b, lambda x, y: x * y)) / (norm(a) * norm(b))
    return out if least is None else F.greatest(out, F.lit(least))


def _shifted(vector: Column) -> Column:
    """The vector less its largest value."""
    return let(doubles(vector), lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: x - top)))


def softmax(vector: Column) -> Column:
    powers = F.transform(_shifted(vector), F.exp)
    return let(powers, lambda p: let(_sum(p), lambda s: F.transform(p, lambda x: x / s)))


def log_softmax(vector: Column) -> Column:
    return let(_shifted(vector), lambda v: let(F.log(_sum(F.transform(v, F.exp))), lambda s: F.transform(v, lambda x: x - s)))
