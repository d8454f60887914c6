"""Column expressions over arrays of pools and alleles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it inside lambdas.

    The optimizer may put a computed column's expression in the place of its name, also within
    a lambda, where it would be computed again for each element.
    """
    return F.transform(F.array(value), then)[0]


def bound(frame: DataFrame, **columns: Column) -> DataFrame:
    """``frame`` with more columns, each computed once for a row, however later lambdas use it.

    They pass through a generator of one row, across which the optimizer moves no expression.
    Long chains of ``let`` in one expression take the analyser too long.
    """
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return frame.select("*", made)


def total(values: Column) -> Column:
    """Sum of an array's numbers."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def places(values: Column) -> Column:
    """0, 1, ... up to the last place of an array; empty for an empty one."""
    return F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))


def frequencies(counts: Column) -> Column:
    """Counts of each pool over their sum; null where a pool has none."""
    share = lambda row: let(total(row.cast("array<double>")), lambda t: F.transform(row, lambda x: F.try_divide(x.cast("double"), t)))
    return F.transform(counts, share)


def coverage(counts: Column) -> Column:
    """Sum of each pool's counts."""
    return F.transform(counts, lambda row: F.aggregate(row, F.lit(0).cast("long"), lambda s, x: s + x))


def pick(values: Column, at: Column) -> Column:
    """The entries of an array at the given places."""
    return F.transform(at, lambda i: F.get(values, i))


def weighted_mean(freqs: Column, weights: Sequence[float], i: Column) -> Column:
    """Mean over pools of allele ``i``'s frequency; a missing one counts as 0."""
    terms = [F.coalesce(F.get(F.get(freqs, F.lit(p)), i), F.lit(0.0)) * float(w) for p, w in enumerate(weights)]
    return reduce(lambda a, b: a + b, terms) / float(sum(weights))
