"""Lasso by coordinate descent, the alleles being rows of a table of any length.

Minimises ``sum((y - X b)**2) / 2 + lambda * sum(|b|)``. Few alleles get a coefficient, about as
many as there are pools at most, so coordinates are swept in blocks of candidates and only a
pass over all alleles says which these are:

1. A pass finds, for each fit and each of ``buckets`` hash classes of alleles, the one whose
   product with the residual is largest. Alleles with equal frequencies are in one class, so a
   hundred thousand copies of a column bring one candidate.
2. Those above lambda join the fit's block, over which coordinates are descended until the
   conditions of the minimum hold. No other allele's coefficient can move before the next pass.
3. The duality gap gives a radius around the solution; alleles that no solution within it can
   use leave the table for good.

It ends when a pass finds no allele above lambda: then the block's solution is that of all
alleles. All fits, traits by lambdas, share the passes. A block holds as many alleles as there are
pools, plus those of two passes; residuals and blocks are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.sources.shared import materialize

KEY = ("chr", "pos", "allele")


def soft_threshold(rho: np.ndarray, z: np.ndarray, lam: float) -> np.ndarray:
    """``rho``, brought nearer to 0 by ``lam`` but not beyond it, over ``z``."""
    return np.sign(rho) * np.maximum(np.abs(rho) - lam, 0) / z


@dataclass
class Block:
    """A fit's candidates: the intercept first, with its own penalty, then alleles."""

    y: np.ndarray
    trait: int
    lam: float
    keys: list[tuple] = field(default_factory=list)
    x: np.ndarray | None = None
    beta: np.ndarray | None = None
    penalty: np.ndarray | None = None

    def start(self, penalise_intercept: bool) -> None:
        self.keys, self.x, self.beta = [None], np.ones((1, len(self.y))), np.zeros(1)
        self.penalty = np.array([self.lam if penalise_intercept else 0.0])
        self.descend()

    def add(self, key: tuple, x: np.ndarray) -> None:
        self.keys.append(key)
        self.x, self.beta, self.penalty = np.vstack([self.x, x]), np.append(self.beta, 0.0), np.append(self.penalty, self.lam)

    def prune(self) -> None:
        """Candidates without a coefficient go."""
        keep = self.beta != 0
        keep[0] = True
        self.keys = [k for k, stays in zip(self.keys, keep, strict=True) if stays]
        self.x, self.beta, self.penalty = self.x[keep], self.beta[keep], self.penalty[keep]

    @property
    def residual(self) -> np.ndarray:
        return self.y - self.beta @ self.x

    def solved(self, gram: np.ndarray, product: np.ndarray, beta: np.ndarray) -> bool:
        """Whether no coefficient could move."""
        slope = product - gram @ beta
        scale = 1e-11 * max(np.abs(product).max(), 1e-300)
        held = np.where(beta != 0, np.abs(slope - self.penalty * np.sign(beta)), np.maximum(np.abs(slope) - self.penalty, 0))
        return bool((held <= scale).all())

    def descend(self, sweeps: int = 100_000) -> None:
        """Coordinate after coordinate; after every 20 sweeps the signs found so far are tried for the exact solution."""
        gram, product, beta = self.x @ self.x.T, self.x @ self.y, self.beta.copy()
        slope = product - gram @ beta
        for sweep in range(1, sweeps + 1):
            for j in np.flatnonzero(np.diag(gram) > 0):
                new = float(soft_threshold(slope[j] + gram[j, j] * beta[j], gram[j, j], self.penalty[j]))
                if new != beta[j]:
                    slope -= gram[j] * (new - beta[j])
                    beta[j] = new
            if sweep % 20 == 0 or sweep == 1:
                if self.solved(gram, product, beta):
                    break
                on, exact = np.flatnonzero(beta), np.zeros_like(beta)
                if len(on):
                    exact[on] = np.linalg.lstsq(gram[np.ix_(on, on)], product[on] - self.penalty[on] * np.sign(beta[on]), rcond=1e-12)[0]
                if (np.sign(exact) == np.sign(beta)).all() and self.solved(gram, product, exact):
                    beta = exact
                    break
        self.beta = beta

    def sphere(self, largest: float) -> tuple[np.ndarray, float]:
        """Centre and radius that hold the dual solution; ``largest`` product of an allele, or the penalised intercept, with the residual."""
        r = self.residual
        top = max(self.lam, largest, float(abs(r.sum())) if self.penalty[0] else 0.0)
        centre = r / top
        primal = (r @ r) / 2 + self.penalty @ np.abs(self.beta)
        dual = (self.y @ self.y - self.lam**2 * ((centre - self.y / self.lam) ** 2).sum()) / 2
        return centre, float(np.sqrt(max(2 * (primal - dual), 0.0)) / self.lam)


def _rows(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _candidates(table: DataFrame, residuals: np.ndarray, buckets: int) -> list[tuple]:
    """For each fit and bucket the allele with the largest product: fit, product, key, x; the first key of equals."""
    n = residuals.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            x, bucket = _rows(batch, n), batch.column(batch.schema.get_field_index("bucket")).to_numpy()
            keys = [batch.column(batch.schema.get_field_index(k)) for k in KEY]
            size = np.abs(x @ residuals.T)
            size = np.round(size, 11 - np.int64(np.floor(np.log10(max(size.max(initial=0), 1e-250)))))  # so that equal columns have equal products
            for b in np.unique(bucket):
                at = np.flatnonzero(bucket == b)
                for j, top in enumerate(size[at].max(axis=0).tolist()):
                    if top >= found.get((j, b), (0.0,))[0]:
                        row = min((tuple(k[int(i)].as_py() for k in keys), int(i)) for i in at[size[at, j] == top])
                        old = found.get((j, b))
                        if old is None or top > old[0] or row[0] < old[1]:
                            found[j, b] = (top, row[0], x[row[1]].tolist())
        if found:
            columns = [(j, b, size, *key, x) for (j, b), (size, key, x) in found.items()]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*columns, strict=True), kinds, strict=True)], names=["fit", "bucket", "size", *KEY, "x"])

    made = table.mapInArrow(best, "fit int, bucket int, size double, chr string, pos long, allele string, x array<double>")
    first = F.struct((-F.col("size")).alias("size"), *KEY)
    top = made.groupBy("fit", "bucket").agg(F.min_by(F.struct("size", *KEY, "x"), first).alias("top"))
    return [(r["fit"], r["top"]["size"], tuple(r["top"][k] for k in KEY), np.array(r["top"]["x"])) for r in top.collect()]  # fits by buckets


def _survivors(table: DataFrame, spheres: list[tuple[np.ndarray, float]]) -> DataFrame:
    """Rows of ``table`` that a solution of some fit may use."""
    centres, radii = np.array([c for c, _ in spheres]), np.array([r for _, r in spheres])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, centres.shape[1])
            may = (np.abs(x @ centres.T) + np.sqrt((x * x).sum(axis=1))[:, None] * radii >= 1 - 1e-9).any(axis=1)
            yield batch.filter(pa.array(may))

    return table.mapInArrow(keep, table.schema)


@dataclass(frozen=True)
class Lasso:
    """``coefficients``: phenotype, lambda, chr, pos, allele, beta of the alleles that have one, intercepts as rows without a place; ``fitted`` traits by lambdas by pools; ``passes`` over the alleles."""

    coefficients: DataFrame
    fitted: np.ndarray
    lambdas: np.ndarray
    passes: int


def lasso(alleles: DataFrame, y: np.ndarray, lambdas: Sequence[float], shares: bool = False, penalise_intercept: bool = True, buckets: int = 16, tolerance: float = 1e-9) -> Lasso:
    """Fit allele rows (chr, pos, allele, pools' frequencies ``x``) to each trait of ``y``, pools by traits, with each lambda.

    With ``shares`` a lambda is a share of the least that leaves all alleles out. Missing
    frequencies count as the allele's mean, an allele without any is left out; with none at
    all the fits are intercepts. Of alleles with equal frequencies the first by chromosome and
    place has the coefficient.
    """
    n, traits = y.shape
    known = F.filter("x", lambda v: v.isNotNull() & ~F.isnan(v))
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
    filled = F.transform("x", lambda v: F.when(v.isNotNull() & ~F.isnan(v), v).otherwise(F.col("mean")))
    table = alleles.select(*KEY, F.transform("x", lambda v: v.cast("double")).alias("x")).where(F.size(known) > 0).withColumn("mean", mean)
    table = table.select(*KEY, filled.alias("x")).withColumn("bucket", F.pmod(F.xxhash64("x"), F.lit(buckets)).cast("int"))
    table = materialize(table, "lasso")
    fits = [Block(y[:, t].astype(float), t, float(lam)) for t in range(traits) for lam in lambdas]
    passes = 0
    if shares:
        first = [Block(y[:, t].astype(float), t, 1e300) for t in range(traits)]
        for b in first:
            b.start(penalise_intercept)
        tops = np.zeros(traits)
        for t, size, _, _ in _candidates(table, np.array([b.residual for b in first]), buckets):
            tops[t] = max(tops[t], size)
        if penalise_intercept:
            tops = np.maximum(tops, np.abs(y.sum(axis=0)))
        passes += 1
        for b in fits:
            b.lam = float(b.lam * max(tops[b.trait], 1e-300))
    for b in fits:
        if b.lam <= 0:
            raise ValueError("lambda must be above 0")
        b.start(penalise_intercept)
    open_ = list(range(len(fits)))
    while open_:
        found = _candidates(table, np.array([fits[i].residual for i in open_]), buckets)
        passes += 1
        spheres, still = [], []
        for k, i in enumerate(open_):
            b = fits[i]
            mine = [c for c in found if c[0] == k]
            spheres.append(b.sphere(max((c[1] for c in mine), default=0.0)))
            new = [c for c in mine if c[1] > b.lam * (1 + tolerance) and c[2] not in b.keys]
            if new:
                if len(b.keys) > n + buckets:
                    b.prune()
                for _, _, key, x in new:
                    b.add(key, x)
                b.descend()
                still.append(i)
        if still and passes in (4, 8, 16, 32):
            kept = [s for s, i in zip(spheres, open_, strict=True) if i in still]
            table = materialize(_survivors(table, kept), "lasso")
        open_ = still
    rows = [(f"Pheno_{b.trait}", b.lam, *(key or (None, None, "intercept")), float(v)) for b in fits for key, v in zip(b.keys, b.beta, strict=True) if key is None or v != 0]
    made = alleles.sparkSession.createDataFrame(rows, "phenotype string, lambda double, chr string, pos long, allele string, beta double")
    shape = (traits, len(lambdas))
    return Lasso(made, np.array([b.beta @ b.x for b in fits]).reshape(*shape, n), np.array([b.lam for b in fits]).reshape(shape), passes)
