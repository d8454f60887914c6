"""Tests of a locus' pools-by-alleles table: chi-square and Fisher's exact test by greedy tables."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import arrays as ar
from lociframe.functions import dist

#: log10 of n factorial for n up to 34; larger tables are scaled down to 34.
MOST = 34
LOG10_FACTORIAL = [lgamma(n + 1) / log(10) for n in range(MOST + 1)]


def chisq_statistic(loci: DataFrame) -> DataFrame:
    """``loci`` with ``statistic`` and ``df``: chi-square of the frequencies, and pools * alleles - 1. Needs ``freqs``."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)

    def margins(f: Column) -> Column:
        columns = F.transform(F.sequence(F.lit(0), F.size(F.get(f, F.lit(0))) - 1), lambda i: F.aggregate(f, F.lit(0.0), lambda s, r: s + F.get(r, i)))
        return F.struct(F.transform(f, add).alias("r"), columns.alias("c"), add(F.flatten(f)).alias("t"), f.alias("f"))

    def value(m: Column) -> Column:
        term = lambda x, i, j: ar.let(F.get(m["r"], i) * F.get(m["c"], j) / m["t"], lambda e: F.coalesce(F.try_divide(F.pow(x - e, F.lit(2)), e), F.lit(0.0)))
        return add(F.flatten(F.transform(m["f"], lambda row, i: F.transform(row, lambda x, j: term(x, i, j)))))

    statistic = ar.let(F.col("freqs"), lambda f: ar.let(margins(f), value))
    return loci.withColumns({"statistic": statistic, "df": F.size("freqs") * F.size("alleles") - 1})


def chisq_test(loci: DataFrame, classic: bool = False) -> DataFrame:
    """chr, pos, alleles, statistic, pvalue. ``classic`` uses counts and (pools - 1)(alleles - 1) degrees of freedom."""
    if classic:
        loci = loci.withColumn("freqs", F.transform("counts", lambda r: r.cast("array<double>")))
    tested = chisq_statistic(loci)
    if classic:
        tested = tested.withColumn("df", (F.size("freqs") - 1) * (F.size("alleles") - 1))

    @F.pandas_udf("double")
    def upper(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(dist.chi2_upper(x.to_numpy(float), df.to_numpy(float)))

    return tested.select("chr", "pos", F.array_join("alleles", "").alias("alleles"), "statistic", upper("statistic", "df").alias("pvalue"))


def scaled(counts: Column) -> Column:
    """Counts scaled down and floored where a table's sum exceeds 34."""
    small = lambda t: F.transform(counts, lambda r: F.transform(r, lambda x: F.when(t > MOST, F.floor(x * (F.lit(float(MOST)) / t))).otherwise(x).cast("long")))
    return ar.let(F.aggregate(F.flatten(counts), F.lit(0).cast("long"), lambda s, x: s + x), small)


def fisher_observed(loci: DataFrame) -> DataFrame:
    """chr, pos, alleles, statistic: the observed table's hypergeometric probability."""
    logs = F.array(*[F.lit(x) for x in LOG10_FACTORIAL])
    log_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + logs[x.cast("int")])
    whole = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)

    def value(m: Column) -> Column:
        columns = F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda i: F.aggregate(m, F.lit(0).cast("long"), lambda s, r: s + F.get(r, i)))
        margins = log_of(F.transform(m, whole)) + log_of(columns)
        return F.pow(F.lit(10.0), margins - log_of(F.flatten(m)) - logs[whole(F.flatten(m)).cast("int")])

    return loci.select("chr", "pos", F.array_join("alleles", "").alias("alleles"), ar.let(scaled(F.col("counts")), value).alias("statistic"))


def overlaps(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Tables (loci, rows, columns) that use up the margins from their first row and column on.

    Laid end to end, a row's and a column's shares of the total are stretches of one line; a
    cell is as long as its row and column have in common.
    """
    ends = lambda v: np.cumsum(v, axis=1)
    r, c = ends(rows)[:, :, None], ends(columns)[:, None, :]
    return np.maximum(np.minimum(r, c) - np.maximum(r - rows[:, :, None], c - columns[:, None, :]), 0)


def corner_tables(rows: np.ndarray, columns: np.ndarray, a: int, b: int) -> np.ndarray:
    """Tables with these margins, as far as can be in the corner from row ``a`` and column ``b`` on.

    Rows before the corner may use the last column alone, rows within it the columns within it,
    and the last row all columns. What is then left of the margins is used from the last row and
    column backwards.
    """
    n, p = rows.shape[1], columns.shape[1]
    made, left, below = np.zeros((len(rows), n, p), np.int64), rows.copy(), columns.copy()
    last = n - 1
    parts = [(slice(0, min(a, last)), slice(p - 1, p)), (slice(min(a, last), last), slice(b, p)), (slice(last, n), slice(0, p))]
    for at in [*parts, (slice(None, None, -1), slice(None, None, -1))]:
        x = overlaps(left[:, at[0]], below[:, at[1]])
        made[:, at[0], at[1]] += x
        left[:, at[0]] -= x.sum(axis=2)
        below[:, at[1]] -= x.sum(axis=1)
    return made


def fisher_kernel(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed probability, and that plus those of the tables of all corners, for tables (loci, n, p)."""
    _, n, p = counts.shape
    total = counts.sum(axis=(1, 2), keepdims=True)
    m = np.where(total > MOST, np.floor(counts * (MOST / np.maximum(total, 1))), counts).astype(np.int64)
    rows, columns = m.sum(axis=2), m.sum(axis=1)
    logs = np.array(LOG10_FACTORIAL)
    marginal = logs[rows].sum(axis=1) + logs[columns].sum(axis=1)

    def ratio(t: np.ndarray) -> np.ndarray:
        return 10.0 ** (marginal - logs[np.minimum(t, MOST)].sum(axis=(1, 2)) - logs[np.minimum(t.sum(axis=(1, 2)), MOST)])

    observed = ratio(m)
    return observed, observed + sum(ratio(corner_tables(rows, columns, a, b)) for a in range(n) for b in range(p))


def by_shape(column: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows whose nested arrays have the same shape, and these stacked."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, rows in enumerate(column):
        shapes.setdefault((len(rows), len(rows[0]) if len(rows) else 0), []).append(i)
    for _, at in sorted(shapes.items()):
        yield np.array(at), np.array([np.stack(column.iat[i]) for i in at], float)


def fisher_exact_test(loci: DataFrame) -> DataFrame:
    """chr, pos, alleles, statistic (observed probability), pvalue (plus that of the greedy tables)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((2, len(batch)))
            for at, stacked in by_shape(batch["counts"]):
                out[:, at] = fisher_kernel(stacked)
            yield pd.DataFrame({"chr": batch["chr"], "pos": batch["pos"], "alleles": batch["alleles"], "statistic": out[0], "pvalue": out[1]})

    rows = loci.select("chr", "pos", F.array_join("alleles", "").alias("alleles"), "counts")
    return rows.mapInPandas(run, "chr string, pos long, alleles string, statistic double, pvalue double")
