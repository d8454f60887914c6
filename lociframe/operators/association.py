"""Per-locus association with phenotypes: correlation, least squares, maximum likelihood, ridge, kinship covariates.

Phenotypes are one small matrix, pools by traits, that travels with the tasks; loci never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import arrays as ar
from lociframe.functions import dist
from lociframe.functions import linear as ln
from lociframe.model import EPSILON
from lociframe.operators import filters as fl


@dataclass(frozen=True)
class Phenotypes:
    """Pools in order: names, sizes, and values pools by traits; NaN is missing."""

    names: tuple[str, ...]
    sizes: np.ndarray
    values: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        return self.sizes / self.sizes.sum()

    @property
    def complete(self) -> np.ndarray:
        """Places of pools of which no trait is missing."""
        keep = np.flatnonzero(~np.isnan(self.values).any(axis=1))
        if not len(keep):
            raise ValueError("no pool has all phenotypes")
        return keep

    def only(self, at: np.ndarray) -> Phenotypes:
        return Phenotypes(tuple(self.names[i] for i in at), self.sizes[at], self.values[at])


def only_pools(loci: DataFrame, at: np.ndarray) -> DataFrame:
    """``loci`` with the counts of the given pools."""
    return loci.withColumn("counts", F.array(*[F.get("counts", F.lit(int(i))) for i in at]))


def pearson(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """r, rounded to 7 digits, and p of each row of ``x`` with ``y`` over complete pairs; degrees of freedom from all pools."""
    ok = ~np.isnan(x) & ~np.isnan(y)
    n = ok.sum(axis=-1)
    with np.errstate(all="ignore"):
        mean = lambda v: (np.where(ok, v, 0).sum(axis=-1) / n)[..., None]
        a, b = np.where(ok, x - mean(x), 0), np.where(ok, np.broadcast_to(y, x.shape) - mean(np.broadcast_to(y, x.shape)), 0)
        r = (a * b).sum(axis=-1) / np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))
        flat = (a * a).sum(axis=-1) * (b * b).sum(axis=-1) <= EPSILON**2
        r = np.where(flat, np.nan, np.sign(r) * np.floor(np.abs(r) * 1e7 + 0.5) / 1e7)
        df = x.shape[-1] - 2
        p = np.where(r * r >= 1, EPSILON, dist.t_two_sided(r / np.sqrt(np.maximum(1 - r * r, EPSILON) / df), df))
    return r, np.where(np.isnan(r), np.nan, p)


def correlation_scan(loci: DataFrame, phen: Phenotypes) -> DataFrame:
    """chr, pos, alleles, freq, phenotype, statistic, pvalue for each allele but the last label, and trait. Needs ``freqs``."""
    rows = fl.allele_rows(loci.where(F.size("alleles") >= 2).withColumn("alleles", F.slice("alleles", 1, F.size("alleles") - 1)))
    y = phen.values

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.array([np.array(v, float) for v in batch["x"]])
            for k in range(y.shape[1]):
                r, p = pearson(x, y[:, k])
                yield pd.DataFrame({"chr": batch["chr"], "pos": batch["pos"], "alleles": batch["allele"], "freq": np.nanmean(x, axis=1), "phenotype": f"Pheno_{k}", "statistic": r, "pvalue": p})

    return rows.mapInPandas(run, "chr string, pos long, alleles string, freq double, phenotype string, statistic double, pvalue double")


SCAN = "chr string, pos long, alleles string, freq double, phenotype string, statistic double, pvalue double"
NAN = float("nan")


def fitted(frame: DataFrame, y: np.ndarray, likelihood: bool = False, compat: bool = True, ridge: float = 0.0) -> DataFrame:
    """Least squares as expressions: ``frame`` without singular designs and with ``fits``.

    ``frame`` has ``columns``, an array of a design's columns with as many values each as ``y``
    has rows. ``fits`` has for each column an array over traits of structs of statistic (the
    coefficient) and pvalue.

    The test has n - 1 degrees of freedom. With ``likelihood`` the error variance is 2 SSE / n
    and, where ``compat``, the statistic is the coefficient over its variance, not its root:
    the values an optimiser finds for that objective in closed form. ``ridge`` is added to the
    diagonal but for the intercept. With fewer pools than columns the coefficients are the shortest
    that fit exactly, and every p value is 1, as where a line goes through all pools.
    """
    n, traits = len(y), range(y.shape[1])
    cols, inv, few = F.col("columns"), F.col("_inverse"), F.size("columns") > n
    inner = ln.products(cols, cols)
    if ridge:
        few, product = F.lit(False), ln.add_to_diagonal(inner, ridge)
    else:
        product = F.when(few, ln.products(F.col("_rows"), F.col("_rows"))).otherwise(inner)
    frame = ar.bound(frame, _rows=ln.transpose(cols))
    frame = ar.bound(frame, _product=product)
    frame = ar.bound(frame, _inverse=ln.inverse(F.col("_product")))
    frame = frame.where(~ln.is_singular(F.col("_product"), inv))
    by = [ln.literal(y[:, k]) for k in traits]
    # with few pools X'(XX')^-1 y, the shortest of the exact solutions
    frame = ar.bound(frame, **{f"_beta{k}": F.when(few, ln.times(cols, ln.times(inv, by[k]))).otherwise(ln.times(inv, ln.times(cols, by[k]))) for k in traits})
    left = [F.zip_with(by[k], ln.times(F.col("_rows"), F.col(f"_beta{k}")), lambda u, v: u - v) for k in traits]
    frame = ar.bound(frame, **{f"_left{k}": left[k] for k in traits})

    def statistics(k: int) -> Column:
        """t of each coefficient; not a number where nothing is left for an error."""
        sse = ln.dot(F.col(f"_left{k}"), F.col(f"_left{k}"))
        error = F.when(few, F.lit(NAN)).otherwise(2 * sse / n) if likelihood else F.when(F.size(cols) >= n, F.lit(NAN)).otherwise(F.try_divide(sse, n - F.size(cols)))

        def t(b: Column, j: Column) -> Column:
            spread = lambda v: v if likelihood and compat else F.sqrt(v)
            over = lambda v: F.when(F.isnan(v), F.lit(NAN)).when(v <= 0, F.lit(float("inf"))).otherwise(F.try_divide(b, spread(v)))
            return F.when(F.abs(b) <= EPSILON, 0.0).otherwise(over(F.when(few, F.lit(NAN)).otherwise(F.get(F.get(inv, j), j) * F.col(f"_error{k}"))))

        return error, F.transform(f"_beta{k}", t)

    made = [statistics(k) for k in traits]
    frame = ar.bound(frame, **{f"_error{k}": made[k][0] for k in traits})
    frame = ar.bound(frame, **{f"_p{k}": F.transform(made[k][1], lambda t: ln.t_two_sided(t, n - 1)) for k in traits})
    one = lambda k, j: F.struct(F.get(f"_beta{k}", j).alias("statistic"), F.nanvl(F.get(f"_p{k}", j), F.lit(1.0)).alias("pvalue"))
    fits = F.transform(ar.places(cols), lambda j: F.array(*[one(k, j) for k in traits]))
    return ar.bound(frame, fits=fits)


def not_collinear(columns: Column, n: int, limit: float = 0.99) -> Column:
    """Places of the columns that no earlier one which stays has |r| of ``limit`` or more with."""
    centred = F.transform(columns, lambda c: ar.let(ar.total(c) / n, lambda mean: F.transform(c, lambda v: v - mean)))

    def near(c: Column, i: Column, j: Column) -> Column:
        a, b = F.get(c, i), F.get(c, j)
        scale = F.sqrt(ln.dot(a, a) * ln.dot(b, b))
        r = F.floor(F.abs(F.try_divide(ln.dot(a, b), scale)) * 1e7 + 0.5) / 1e7
        return (scale > EPSILON) & F.coalesce(r >= limit, F.lit(False))

    def gone(c: Column) -> Column:
        step = lambda g, j: F.concat(g, F.array(F.exists(ar.places(g), lambda i: ~F.get(g, i) & near(c, i, j))))
        return F.aggregate(ar.places(c), F.array().cast("array<boolean>"), step)

    return ar.let(ar.let(centred, gone), lambda g: F.filter(ar.places(g), lambda i: ~F.get(g, i)))


def _exploded(frame: DataFrame, *about: str) -> DataFrame:
    """One row for each entry of ``tests`` (structs of ``about`` and ``fit``) and trait."""
    rows = frame.select("chr", "pos", F.explode("tests").alias("_t")).select("chr", "pos", *[f"_t.{c}" for c in about], F.posexplode("_t.fit").alias("_k", "_f"))
    return rows.select("chr", "pos", *about, F.concat(F.lit("Pheno_"), "_k").alias("phenotype"), "_f.statistic", "_f.pvalue")


def regression_scan(loci: DataFrame, phen: Phenotypes, likelihood: bool = False, compat: bool = True, ridge: float = 0.0) -> DataFrame:
    """Joint model of an intercept and all alleles but the major; one row for each of these alleles and trait.

    ``loci`` has ``freqs`` of the pools of ``phen``, in which nothing is missing. Loci of
    singular designs are dropped. With ``likelihood`` collinear alleles are left out.
    """
    n, x = len(phen.names), F.col("_x")
    rows = ar.bound(fl.drop_major(loci).select("chr", "pos", "alleles", "freqs"), _x=ln.transpose(F.col("freqs")))
    rows = ar.bound(rows, _at=not_collinear(x, n) if likelihood else ar.places(x))
    rows = ar.bound(rows, columns=F.concat(F.array(ln.literal(np.ones(n))), ar.pick(x, F.col("_at"))))
    rows = fitted(rows, phen.values, likelihood, compat, ridge)
    about = lambda i, k: F.struct(F.get("alleles", i).alias("alleles"), (ar.total(F.get(x, i)) / n).alias("freq"), F.get("fits", k + 1).alias("fit"))
    return _exploded(rows.withColumn("tests", F.transform("_at", about)), "alleles", "freq")


def allele_scan(loci: DataFrame, phen: Phenotypes, likelihood: bool = False, compat: bool = True) -> DataFrame:
    """Each allele on its own against an intercept; one row for each allele and trait. Needs ``freqs``."""
    n = len(phen.names)
    rows = ar.bound(fl.allele_rows(loci), freq=ar.total(F.col("x")) / n)
    rows = ar.bound(rows, _x=F.transform("x", lambda v: v - F.col("freq"))).where(ln.dot(F.col("_x"), F.col("_x")) > 1e-12)
    rows = fitted(ar.bound(rows, columns=F.array(ln.literal(np.ones(n)), F.col("_x"))), phen.values, likelihood, compat)
    test = F.struct(F.col("allele").alias("alleles"), F.col("freq"), F.get("fits", F.lit(1)).alias("fit"))
    return _exploded(rows.withColumn("tests", F.array(test)), "alleles", "freq")


def gram(alleles: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Sum over alleles of the pools-by-pools products of ``x``, and the number of alleles.

    Each task sums its own rows; only these n * n numbers meet. Missing frequencies count as
    the allele's mean.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((n, n)), 0
        for batch in batches:
            if len(batch):
                x = np.array([np.array(v, float) for v in batch["x"]])
                x = np.where(np.isnan(x), np.nanmean(x, axis=1, keepdims=True), x)
                total, rows = total + x.T @ x, rows + len(x)
        yield pd.DataFrame({"at": np.arange(n * n + 1), "value": np.append(total.ravel(), rows)})

    summed = alleles.select("x").mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    got = np.zeros(n * n + 1)
    for at, value in summed.collect():  # n * n + 1 rows, n pools
        got[at] = value
    return got[:-1].reshape(n, n), int(got[-1])


def principal_components(kinship: np.ndarray, share: float = 0.75, compat: bool = False) -> np.ndarray:
    """Leading eigenvectors that together explain ``share``, each with its largest entry positive.

    ``compat`` takes one fewer than needed, as where the last one before the share is reached counts.
    """
    values, vectors = np.linalg.eigh(kinship)
    values, vectors = values[::-1], vectors[:, ::-1]
    reached = int(np.argmax(np.cumsum(values) / values.sum() >= share - 1e-12))
    chosen = vectors[:, : reached if compat else reached + 1]
    return chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), range(chosen.shape[1])])


def kinship_scan(loci: DataFrame, phen: Phenotypes, share: float = 0.75, likelihood: bool = False, compat: bool = True, compat_components: bool = False) -> DataFrame:
    """chr, pos, alleles, phenotype, statistic, pvalue of each allele given an intercept and kinship components. Needs ``freqs``."""
    rows = fl.allele_rows(loci)
    n = len(phen.names)
    total, p = gram(rows, n)
    components = principal_components(total / max(p, 1), share, compat_components)
    design = F.array(ln.literal(np.ones(n)), *[ln.literal(c) for c in components.T], F.col("x"))
    fits = fitted(ar.bound(rows, columns=design), phen.values, likelihood, compat)
    test = F.struct(F.col("allele").alias("alleles"), F.element_at("fits", -1).alias("fit"))
    return _exploded(fits.withColumn("tests", F.array(test)), "alleles")
