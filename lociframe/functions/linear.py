"""Small dense linear algebra and the tail of Student's t as column expressions.

A matrix is an array of rows. Sizes may differ from row to row of the table. Division by zero
gives null, which spreads, so that what has no inverse is null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lociframe.functions.arrays import let, places, total


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def transpose(m: Column) -> Column:
    """Rows of the transpose; ``m`` has at least one row."""
    return F.transform(places(F.get(m, F.lit(0))), lambda j: F.transform(m, lambda row: F.get(row, j)))


def products(a: Column, b: Column) -> Column:
    """Products of each row of ``a`` with each of ``b``."""
    return F.transform(a, lambda u: F.transform(b, lambda v: dot(u, v)))


def times(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: dot(row, v))


def add_to_diagonal(m: Column, amount: float) -> Column:
    """But for the first entry."""
    return F.transform(m, lambda row, i: F.transform(row, lambda v, j: F.when((i == j) & (i > 0), v + amount).otherwise(v)))


def inverse(m: Column) -> Column:
    """Inverse of a symmetric positive definite matrix, by elimination."""

    def eliminated(a: Column, k: Column) -> Column:
        def by(pivot: Column) -> Column:
            scaled = F.transform(pivot, lambda v: F.try_divide(v, F.get(pivot, k)))
            return let(scaled, lambda p: F.transform(a, lambda row, i: F.when(i == k, p).otherwise(let(F.get(row, k), lambda f: F.zip_with(row, p, lambda x, y: x - f * y)))))

        return let(F.get(a, k), by)

    beside = lambda i: F.transform(places(m), lambda j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0)))
    both = F.aggregate(places(m), F.transform(m, lambda row, i: F.concat(row, beside(i))), eliminated)
    return F.transform(both, lambda row: F.slice(row, F.size(m) + 1, F.size(m)))


def norm(m: Column) -> Column:
    """Largest sum of a row's absolute values; null where one is."""
    return F.array_max(F.transform(m, lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + F.abs(x))))


def is_singular(m: Column, inverted: Column, limit: float = 1e12) -> Column:
    """Whether a matrix has no inverse, or one by which errors grow beyond ``limit`` times."""
    undefined = F.exists(inverted, lambda row: F.exists(row, lambda x: x.isNull() | F.isnan(x)))
    return undefined | F.coalesce(norm(m) * norm(inverted) > limit, F.lit(True))


def t_two_sided(t: Column, df: int) -> Column:
    """2 (1 - CDF(|t|)) of Student's t with a whole number of degrees of freedom.

    A power series of the incomplete beta function beyond 3, or the root of fewer than nine
    degrees, so that small tails keep their digits, and the finite sum for whole degrees of
    freedom below.
    """
    a, switch = df / 2, min(df, 9)
    tail, c = [], 1.0
    for k in range(math.ceil(38 / math.log1p(switch / df))):
        tail.append(c * a / (a + k))
        c *= (k + 0.5) / (k + 1)
    front = math.exp(math.lgamma(a + 0.5) - math.lgamma(a) - math.lgamma(0.5)) / a
    odd = df % 2
    middle, c = [], 1.0
    for k in range((df - 1) // 2 if odd else df // 2):
        middle.append(c)
        c *= (2 * k + 2) / (2 * k + 3) if odd else (2 * k + 1) / (2 * k + 2)
    horner = lambda cs, x: F.aggregate(literal(cs[::-1]), F.lit(0.0), lambda s, c: s * x + c) if cs else F.lit(0.0)

    def at(u: Column) -> Column:
        x, sine = F.lit(float(df)) / (df + u * u), u / F.sqrt(df + u * u)
        low = sine * horner(middle, x)
        if odd:
            low = (F.atan(u / math.sqrt(df)) + low * F.sqrt(x)) * (2 / math.pi)
        return F.when(F.isnan(u), F.lit(float("nan"))).when(u > 1e150, 0.0).when(u * u > switch, front * F.pow(x, F.lit(a)) * horner(tail, x)).otherwise(1 - low)

    return let(F.abs(t), at)
