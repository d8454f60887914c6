"""Allele effects from quantiles: beta distributions fitted to an allele's and the other alleles' shares.

All alleles of a batch are fitted at once by a Nelder-Mead search that masks those that have converged, or whose
simplex would come out of every further round as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lociframe.functions import dist
from lociframe.model import EPSILON
from lociframe.operators import filters as fl

MOST_ROUNDS = 1000
#: Alleles that are fitted together: late rounds have few left, which fewer batches share.
MOST_ROWS = 10_000


@dataclass(frozen=True)
class Quantiles:
    """Phenotype of pools cut at quantiles: bin widths, scaled quantiles, and the trait's spread and range."""

    bins: np.ndarray
    q: np.ndarray
    sig: float
    low: float
    high: float


def nelder_mead(cost: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, size: int = 4, h: float = 1.0, rounds: int = MOST_ROUNDS) -> np.ndarray:
    """Minimise ``cost(points, which)`` for ``n`` problems at once; reflection 1, expansion 2, contraction and shrinking 1/2."""
    simplex = np.full((n, size + 1, size), h)
    simplex[:, range(size), range(size)] += 0.5
    every = np.arange(n)
    values = np.stack([cost(simplex[:, i], every) for i in range(size + 1)], axis=1)
    live = every
    for _ in range(rounds):
        order = np.argsort(values[live], axis=1, kind="stable")
        values[live] = np.take_along_axis(values[live], order, axis=1)
        simplex[live] = np.take_along_axis(simplex[live], order[:, :, None], axis=1)
        live = live[values[live].std(axis=1, ddof=1) >= EPSILON]
        if not len(live):
            break
        s, f = simplex[live], values[live]
        centre, worst = s[:, :-1].mean(axis=1), s[:, -1]
        xr = centre + (centre - worst)
        fr = cost(xr, live)
        new, fnew = worst.copy(), f[:, -1].copy()
        take = (fr >= f[:, 0]) & (fr < f[:, -2])
        further = np.flatnonzero(fr < f[:, 0])
        if len(further):
            xe = centre[further] + 2 * (xr[further] - centre[further])
            fe = cost(xe, live[further])
            better = fe < fr[further]
            new[further], fnew[further] = np.where(better[:, None], xe, xr[further]), np.where(better, fe, fr[further])
        new[take], fnew[take] = xr[take], fr[take]
        near = np.flatnonzero(fr >= f[:, -2])
        shrink = np.zeros(0, int)
        if len(near):
            xc = centre[near] + 0.5 * (worst[near] - centre[near])
            fc = cost(xc, live[near])
            good = fc < f[near, -1]
            new[near[good]], fnew[near[good]] = xc[good], fc[good]
            shrink = near[~good]
        s[:, -1], f[:, -1] = new, fnew
        stays = np.zeros(0, int)
        if len(shrink):
            old = s[shrink, 1:]
            s[shrink, 1:] = s[shrink, :1] + 0.5 * (old - s[shrink, :1])
            stays = shrink[(s[shrink, 1:] == old).all(axis=(1, 2))]  # vertices a rounding apart: all later rounds end here
            for i in range(1, size + 1):
                f[shrink, i] = cost(s[shrink, i], live[shrink])
        simplex[live], values[live] = s, f
        live = np.delete(live, stays)
    return simplex[every, values.argmin(axis=1)]


def shapes(points: np.ndarray) -> np.ndarray:
    """Unbounded parameters to beta shapes between epsilon and 10."""
    return EPSILON + (10 - EPSILON) / (1 + np.exp(-points))


def effects(freqs: np.ndarray, z: Quantiles, method: str = "ML", compat: bool = True) -> np.ndarray:
    """alpha of each row of ``freqs`` (alleles, pools)."""
    share = freqs @ z.bins
    if compat:  # quantiles scaled once more
        q = (z.q - z.low) / (z.high - z.low)
    else:
        q = z.q.astype(float).copy()
    q[0] = 0.0
    with np.errstate(all="ignore"):
        own = np.cumsum(freqs * z.bins / share[:, None], axis=1)
        rest = np.cumsum((1 - freqs) * z.bins / (1 - share)[:, None], axis=1)

    both = np.concatenate([own, rest])  # the two distributions of a row are fitted in one array

    def pairs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = shapes(points)
        return np.concatenate([s[:, 0], s[:, 2]]), np.concatenate([s[:, 1], s[:, 3]])

    def squares(points: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows = np.concatenate([at, at + len(freqs)])
        error = ((both[rows] - cdf(np.zeros(len(rows), int), *pairs(points))) ** 2).sum(axis=1)
        return error[: len(at)] + error[len(at) :]

    def likelihood(points: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = cdf(np.concatenate([at, at + len(freqs)]), *pairs(points))
        part = np.log10(np.maximum(np.diff(c, axis=1, prepend=0.0), EPSILON)).sum(axis=1)
        return -part[: len(at)] - part[len(at) :]

    cdf = dist.BetaCdf(q[None] if method == "LS" else both)

    best = nelder_mead(squares if method == "LS" else likelihood, len(freqs))
    s = shapes(best)
    mean = lambda a, b: z.low + (z.high - z.low) * a / (a + b)
    return 2 * np.sqrt(share * (1 - share)) * (mean(s[:, 0], s[:, 1]) - mean(s[:, 2], s[:, 3])) / z.sig


def gwalpha(loci: DataFrame, z: Quantiles, method: str = "ML", compat: bool = True) -> DataFrame:
    """chr, pos, alleles, freq, phenotype, statistic, pvalue (always unknown) of all alleles but the major. Needs ``freqs``."""
    if method not in ("LS", "ML"):
        raise ValueError("method is LS or ML")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), MOST_ROWS):
                part = batch.iloc[at : at + MOST_ROWS]
                x = np.array([np.array(v, float) for v in part["x"]])
                yield pd.DataFrame({"chr": part["chr"], "pos": part["pos"], "alleles": part["allele"], "freq": x.mean(axis=1), "phenotype": "Pheno_0", "statistic": effects(x, z, method, compat), "pvalue": "Unknown"})

    # fits take long and rows little room, so that partitions by size would leave cores without any
    rows = fl.allele_rows(fl.drop_major(loci)).repartition(4 * loci.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInPandas(run, "chr string, pos long, alleles string, freq double, phenotype string, statistic double, pvalue string")
