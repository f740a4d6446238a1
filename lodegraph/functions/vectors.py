"""Vectors and token matrices as arrays, in JVM expressions."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MASKED_SCORE
from .arrays import bound


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalise(a: Column) -> Column:
    """``a`` over its Euclidean norm; a zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def fuse(a: Column, b: Column) -> Column:
    """The unit vector of the sum, as for an image with its caption."""
    return normalise(F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double")))


def token_matrix(a: Column, tokens: int, width: int) -> Column:
    """Cut a vector into unit token vectors."""
    return F.array(*[normalise(F.slice(a, 1 + i * width, width)) for i in range(tokens)])


def max_sim(query: Column, element: Column, q_valid: Column | None = None, e_valid: Column | None = None) -> Column:
    """Late interaction: the sum over query tokens of the best inner product with an element token.

    Invalid element tokens score -1e4 before the maximum, invalid query tokens count nothing.
    """
    q_valid = F.transform(query, lambda _: F.lit(True)) if q_valid is None else q_valid
    e_valid = F.transform(element, lambda _: F.lit(True)) if e_valid is None else e_valid
    best = F.zip_with(query, q_valid, lambda q, ok: F.when(ok, F.array_max(F.zip_with(
        element, e_valid, lambda e, fine: F.when(fine, dot(q, e)).otherwise(F.lit(MASKED_SCORE))))).otherwise(F.lit(0.0)))
    return total(best)


def mean_pool(tokens: Column, valid: Column, width: int) -> Column:
    """The unit vector of the mean of the valid tokens."""

    def pooled(t: Column) -> Column:
        n = F.greatest(total(F.transform(valid, lambda v: v.cast("double"))), F.lit(1.0))
        at = lambda i: total(F.zip_with(t, valid, lambda x, v: F.when(v, F.get(x, i).cast("double")).otherwise(F.lit(0.0)))) / n
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at)

    return bound(bound(tokens, pooled), normalise)


def sinusoid(value: Column, width: int, base: float = 1000.0) -> Column:
    """Sines, then cosines, of a scalar at falling frequencies; an odd last place is zero."""
    half = width // 2
    angle = [value * F.lit(float(2.718281828459045 ** (-log(base) * i / max(half, 1)))) for i in range(half)]
    return F.array(*[F.sin(a) for a in angle], *[F.cos(a) for a in angle], *[F.lit(0.0)] * (width - 2 * half))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gated_sum(facets: list[tuple[Column, Column]]) -> Column:
    """Sum of facet vectors, each times the sigmoid of its gate."""
    scaled = [_scaled(v, sigmoid(g)) for v, g in facets]
    out = scaled[0]
    for s in scaled[1:]:
        out = F.zip_with(out, s, lambda x, y: x + y)
    return out


def _scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)
