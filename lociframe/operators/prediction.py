"""Genomic prediction: models and cross-validation in the space of pools.

With n pools and many alleles, least squares needs only the n-by-n matrix of products of
pools, summed once over all alleles. Coefficients are linear in the alleles' rows and are
never gathered: penalised models take two distributed passes over the alleles (largest
coefficients, sums by how large they are), each for all folds, repetitions and penalties at
once, and only sums over alleles reach the driver.

A penalty shrinks the alleles whose coefficient is below a limit, and what it makes of one is
linear in a few powers of it. So sums of these between the limits of all penalties give every
penalty's predictions; the work on an allele hardly grows with their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.model import EPSILON
from lociframe.operators.association import gram, pearson
from lociframe.sources.shared import materialize

METRICS = ("cor", "mbe", "mae", "mse", "rmse")
MODELS = ("ols", "ols_iterative", "lasso", "ridge", "glmnet", "lasso_iterative", "ridge_iterative")
#: alpha of each penalised model; None is searched.
ALPHA = {"lasso": 1.0, "ridge": 0.0, "glmnet": None, "lasso_iterative": 1.0, "ridge_iterative": 0.0}


def k_split(n: int, k: int, seed: int | Sequence[int]) -> tuple[np.ndarray, int]:
    """A fold for each of ``n`` pools, and the number of folds: fewer than ``k`` until each has ten, 2 below 20 pools.

    What is left over by equal folds is labelled with that number and is never validated.
    """
    if k >= n or n <= 2:
        raise ValueError("the number of folds must be less than the number of pools, which must be more than 2")
    if n // k < 10:
        k = 2 if n < 20 else next(j for j in range(k, 0, -1) if n // j >= 10)
    folds = np.append(np.repeat(np.arange(k), n // k), np.full(n - k * (n // k), k))
    return folds[np.random.default_rng(seed).permutation(n)], k


def expand_and_contract(beta: np.ndarray, proxy: np.ndarray, alpha: float, lam: float) -> np.ndarray:
    """Shrink the coefficients whose scaled proxy norm is below ``lam``; what they lose goes to the others of the same sign.

    The first entry is the intercept, which stays.
    """
    norm = lambda b: (1 - alpha) * b * b + alpha * np.abs(b)
    b, size, near = beta[1:], norm(beta[1:]), norm(proxy[1:])
    small = near / near.max() < lam
    sums = moved(b, size, small)
    out = beta.astype(float).copy()
    out[1:] = penalised(b, size, small, *settle(*sums))
    return out


def penalise(frame: DataFrame, column: str, alpha: float, lam: float) -> DataFrame:
    """``frame`` with ``penalised``: expand and contract over a column of coefficients, intercept not among them."""
    b = F.col(column)
    size = (1 - alpha) * b * b + alpha * F.abs(b)
    top = frame.agg(F.max(size).alias("top"))
    rows = frame.crossJoin(F.broadcast(top)).withColumns({"size": size, "small": F.try_divide(size, F.col("top")) < lam, "up": b >= 0, "cut": F.least(F.abs(b), size)})
    part = lambda v, when: F.coalesce(F.sum(F.when(when, F.col(v))), F.lit(0.0))
    small, up = F.col("small"), F.col("up")
    sums = rows.agg(part("cut", small & up).alias("less"), part("cut", small & ~up).alias("more"), part("size", ~small & up).alias("ups"), part("size", ~small & ~up).alias("downs"))
    no_up = (F.col("less") > 0) & (F.col("ups") == 0)
    no_down = ~no_up & (F.col("more") > 0) & (F.col("downs") == 0)
    sums = sums.select(
        F.coalesce(F.try_divide(F.when(no_up, 0.0).when(no_down, F.col("less") - F.col("more")).otherwise(F.col("less")), F.col("ups")), F.lit(0.0)).alias("gain_up"),
        F.coalesce(F.try_divide(F.when(no_up, F.col("more") - F.col("less")).when(no_down, 0.0).otherwise(F.col("more")), F.col("downs")), F.lit(0.0)).alias("gain_down"),
    )
    rows = rows.crossJoin(F.broadcast(sums))  # one row
    new = F.when(small, F.when(up, b - F.col("cut")).otherwise(b + F.col("cut"))).otherwise(F.when(up, b + F.col("gain_up") * F.col("size")).otherwise(b - F.col("gain_down") * F.col("size")))
    return rows.withColumn("penalised", new).select(*frame.columns, "penalised")


def moved(b: np.ndarray, size: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums over alleles (the first axis): taken from positive and from negative small ones; norms of positive and negative large ones."""
    cut = np.minimum(np.abs(b), size)
    up = b >= 0
    return tuple((v * w).sum(axis=0) for v, w in ((cut, small & up), (cut, small & ~up), (size, ~small & up), (size, ~small & ~up)))


def settle(less: np.ndarray, more: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much each unit of norm of the large positive and negative ones gains, when one side has none of these."""
    less, more, up, down = (np.asarray(v, float) for v in (less, more, up, down))
    no_up = (less > 0) & (up == 0)
    no_down = ~no_up & (more > 0) & (down == 0)
    more, less = np.where(no_up, more - less, np.where(no_down, 0, more)), np.where(no_up, 0, np.where(no_down, less - more, less))
    with np.errstate(all="ignore"):
        return np.where(up > 0, less / up, 0.0), np.where(down > 0, more / down, 0.0)


def penalised(b: np.ndarray, size: np.ndarray, small: np.ndarray, gain_up: np.ndarray, gain_down: np.ndarray) -> np.ndarray:
    """New coefficients."""
    up = b >= 0
    cut = np.minimum(np.abs(b), size)
    return np.where(small, np.where(up, b - cut, b + cut), np.where(up, b + gain_up * size, b - gain_down * size))


#: Sums, over jobs, limits of penalties and held-out pools, that are made in one pass over the alleles.
GRID_CELLS = 4_000_000


@dataclass
class Job:
    """One fit: training and validation pools, the trait, and the pools' weights of least squares."""

    train: np.ndarray
    valid: np.ndarray
    trait: int
    label: tuple
    weights: np.ndarray | None = None  # beta of an allele is x @ weights
    pc: np.ndarray | None = None  # first component of the training pools


def fit(jobs: list[Job], products: np.ndarray, y: np.ndarray) -> None:
    """Least-squares weights of each job; ``products`` counts the intercept as an allele of 1."""
    n = len(products)
    for job in jobs:
        at = job.train
        job.weights = np.zeros(n)
        job.weights[at] = np.linalg.pinv(products[np.ix_(at, at)]) @ y[at, job.trait]
        centred = products[np.ix_(at, at)]
        h = np.eye(len(at)) - 1 / len(at)
        job.pc = np.linalg.eigh(h @ centred @ h)[1][:, -1]


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x")).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
    return np.where(np.isnan(x), np.nanmean(x, axis=1, keepdims=True), x)


def cleared(jobs: list[Job], y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each job the training pools, what clears these of an intercept and the first component, and the trait so cleared."""
    out = []
    for job in jobs:
        base = np.column_stack([np.ones(len(job.train)), job.pc])
        clear = np.eye(len(job.train)) - base @ np.linalg.pinv(base)
        out.append((job.train, clear, clear @ y[job.train, job.trait]))
    return out


def iterative(x: np.ndarray, jobs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Coefficient of each allele beside an intercept and the first component, alleles by ``cleared`` jobs."""
    out = np.empty((len(x), len(jobs)))
    for j, (train, clear, trait) in enumerate(jobs):
        g = x[:, train] @ clear
        power = (g * g).sum(axis=1)
        out[:, j] = np.where(power > 1e-12, (g @ trait) / np.where(power > 1e-12, power, 1), 0)
    return out


#: Cells of one block of a partial array, and partial arrays that one task merges.
BLOCK_CELLS, FAN_IN = 1 << 16, 32


def _reduce(alleles: DataFrame, kernel, shape: tuple[int, ...], largest: bool = False) -> np.ndarray:
    """Sum, or maximum, of ``kernel(x)`` over batches of alleles.

    Each task makes one array of ``shape``, cut into blocks of bytes. Blocks meet in a tree, in
    which a task merges ``FAN_IN`` of one place at most, so that only the merged array reaches
    the driver: folds, penalties and pools, whatever the number of alleles.
    """
    size = int(np.prod(shape))
    merge = np.maximum if largest else np.add

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.full(shape, -np.inf) if largest else np.zeros(shape)
        for batch in batches:
            pools = len(batch.column(0)[0]) if len(batch) else 0
            for at in range(0, len(batch), 8192):
                merge(total, kernel(_matrix(batch.slice(at, 8192), pools)), out=total)
        flat, task = total.ravel(), TaskContext.get().partitionId()
        for at in range(0, size, BLOCK_CELLS):
            cells = pa.array([flat[at : at + BLOCK_CELLS].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK_CELLS], pa.int32()), pa.array([task // FAN_IN], pa.int32()), cells], names=["block", "part", "cells"])

    def met(group: pd.DataFrame) -> pd.DataFrame:
        cells = np.frombuffer(group["cells"].iloc[0]).copy()
        for other in group["cells"].iloc[1:]:
            merge(cells, np.frombuffer(other), out=cells)
        return pd.DataFrame({"block": group["block"].iloc[:1], "part": group["part"].iloc[:1] // FAN_IN, "cells": [cells.tobytes()]})

    kinds = "block int, part int, cells binary"
    merged, parts = alleles.select("x").mapInArrow(run, kinds), -(-alleles.rdd.getNumPartitions() // FAN_IN)
    while True:
        merged = merged.groupBy("block", "part").applyInPandas(met, kinds)
        if parts == 1:
            break
        parts = -(-parts // FAN_IN)
    out = np.zeros(size)
    got = merged.toArrow()
    for block, cells in zip(got["block"].to_pylist(), got["cells"].to_pylist(), strict=True):
        out[block * BLOCK_CELLS :][: len(cells) // 8] = np.frombuffer(cells)
    return out.reshape(shape)


def limits(top: np.ndarray, alphas: np.ndarray, lambdas: np.ndarray) -> np.ndarray:
    """Least size of a coefficient whose norm over that of ``top`` is not below lambda: (jobs, alphas, lambdas), infinite without one.

    Norms rise with the size, as doubles do too, so halving finds the very double at which the comparison turns.
    """
    a, lam, top = alphas[:, None], lambdas, top[:, None, None]
    norm = lambda v: (1 - a) * v * v + a * v
    scale = np.maximum(norm(top), 1e-300)
    some = norm(top) / scale >= lam
    high = np.broadcast_to(top, some.shape).copy().view(np.int64)  # doubles above 0 are in the order of their bits
    low = np.zeros_like(high)
    while (low < high).any():
        half = low + (high - low) // 2
        stays = norm(half.view(float)) / scale >= lam
        low, high = np.where(stays, low, half + 1), np.where(stays, half, high)
        low = np.minimum(low, high)
    return np.where(some, high.view(float), np.inf)


def penalised_predictions(alleles: DataFrame, jobs: list[Job], y: np.ndarray, alphas: np.ndarray, lambdas: np.ndarray, by_proxy: bool, pools: np.ndarray | None = None) -> np.ndarray:
    """Predictions, (jobs, alphas, lambdas, pools), for all pools or for those in each job's row of ``pools``."""
    weights = np.column_stack([j.weights for j in jobs])
    n, grid = len(weights), (len(jobs), len(alphas), len(lambdas))
    clear = cleared(jobs, y) if by_proxy else []
    proxy = (lambda x, b: iterative(x, clear)) if by_proxy else (lambda x, b: b)
    top = np.maximum(_reduce(alleles, lambda x: np.abs(proxy(x, x @ weights)).max(axis=0), (len(jobs),), largest=True), 0.0)
    ends = limits(top, alphas, lambdas)
    edges = np.sort(ends.reshape(len(jobs), -1), axis=1)
    cells, pools = 2 * (edges.shape[1] + 1), np.tile(np.arange(n), (len(jobs), 1)) if pools is None else pools
    width = pools.shape[1]

    def between(x: np.ndarray) -> np.ndarray:
        """Sums between limits, of negative and of positive coefficients: size, its square and the less of both; times a pool's frequency, size, square and what the size is beyond the less."""
        b, columns = x @ weights, np.ascontiguousarray(x.T)
        q = np.abs(proxy(x, b))
        out = np.empty((len(jobs), 3, 1 + width, cells))
        for j in range(len(jobs)):
            size = np.abs(b[:, j])
            square = b[:, j] * b[:, j]
            less = np.minimum(size, square)
            place = 2 * np.searchsorted(edges[j], q[:, j], "right") + (b[:, j] >= 0)
            for i, (alone, with_pool) in enumerate(((size, size), (square, square), (less, size - less))):
                out[j, i, 0] = np.bincount(place, alone, cells)
                for c, pool in enumerate(pools[j]):
                    out[j, i, 1 + c] = np.bincount(place, with_pool * columns[pool], cells)
        return out

    found = _reduce(alleles, between, (len(jobs), 3, 1 + width, cells)).reshape(len(jobs), 3, 1 + width, cells // 2, 2)
    out = np.empty((*grid, width))
    a, rest = alphas[:, None, None], 1 - alphas[:, None, None]
    for j, sums in enumerate(found):
        at = np.searchsorted(edges[j], ends[j], "left")  # alphas by lambdas: the last place below a limit
        below, beyond = np.cumsum(sums, axis=2), np.zeros_like(sums)
        beyond[:, :, :-1] = np.cumsum(sums[:, :, :0:-1], axis=2)[:, :, ::-1]
        small, large = below[:, :, at], beyond[:, :, at]  # 3, pools, alphas, lambdas, signs
        cut, size = a * small[0, 0] + rest * small[2, 0], a * large[0, 0] + rest * large[1, 0]
        gain_up, gain_down = settle(cut[..., 1], cut[..., 0], size[..., 1], size[..., 0])
        left, kept, norms = rest * small[2, 1:], large[0, 1:], a * large[0, 1:] + rest * large[1, 1:]
        ups, downs = left[..., 1] + kept[..., 1] + gain_up * norms[..., 1], left[..., 0] + kept[..., 0] + gain_down * norms[..., 0]
        out[j] = np.moveaxis(ups - downs, 0, -1)
    return out + weights.sum(axis=0)[:, None, None, None]


def metrics(truth: np.ndarray, predicted: np.ndarray, compat: bool = False) -> dict[str, float]:
    """Correlation, mean bias, absolute and squared errors and the root of the last; sums of errors where ``compat``."""
    error = truth - predicted
    average = np.sum if compat else np.mean
    mse = float(average(error**2))
    return {"cor": float(pearson(truth[None], predicted)[0][0]), "mbe": float(error.mean()), "mae": float(average(np.abs(error))), "mse": mse, "rmse": mse**0.5}


def error_index(truth: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """Mean of 1 - |r| and of errors scaled by the range of the truth, for each vector of the last axis of ``predicted``."""
    spread = max(truth.max() - truth.min(), EPSILON)
    error = truth - predicted
    mse = (error**2).sum(axis=-1) / spread**2
    r = np.nan_to_num(pearson(np.broadcast_to(truth, predicted.shape), predicted)[0])
    return ((1 - np.abs(r)) + np.abs(error).sum(axis=-1) / spread + mse + mse**0.5 / spread) / 4


def choose(alleles: DataFrame, products: np.ndarray, y: np.ndarray, outer: list[Job], models: Sequence[str], step: float, reps: int, folds: int, seed: int) -> dict[str, list[tuple[float, float]]]:
    """alpha and lambda of each outer job, by penalised model: least error per inner repetition, the most frequent of these.

    Models that compare the same coefficients share the passes over the alleles.
    """
    path = np.arange(round(1 / step) + 1) / round(1 / step)
    searched = {m: path if ALPHA[m] is None else np.array([ALPHA[m]]) for m in models if m in ALPHA}
    inner: list[Job] = []
    for o, job in enumerate(outer):
        for rep in range(reps if searched else 0):
            fold, k = k_split(len(job.train), min(folds, len(job.train) - 1), [seed, o, rep])
            inner += [Job(job.train[fold != f], job.train[fold == f], job.trait, (o, rep, f)) for f in range(k)]
    fit(inner, products, y)
    # only what is held out is compared; rows are filled up with their first pool
    held = max((len(j.valid) for j in inner), default=0)
    out = {}
    for by_proxy in (False, True):
        alike = [m for m in searched if m.endswith("_iterative") == by_proxy]
        if not alike:
            continue
        alphas = np.unique(np.concatenate([searched[m] for m in alike]))
        errors: dict[tuple[int, int], list[np.ndarray]] = {}
        block = max(1, GRID_CELLS // (6 * (len(alphas) * len(path) + 1) * (held + 1)))
        for at in range(0, len(inner), block):  # so much that driver and tasks hold a bounded grid
            part = inner[at : at + block]
            pools = np.stack([np.append(j.valid, np.repeat(j.valid[:1], held - len(j.valid))) for j in part])
            predicted = penalised_predictions(alleles, part, y, alphas, path, by_proxy, pools)
            for j, job in enumerate(part):
                truth = y[job.valid, job.trait]
                errors.setdefault(job.label[:2], []).append(error_index(truth, predicted[j, :, :, : len(job.valid)]))
        mean = {key: np.mean(found, axis=0) for key, found in errors.items()}
        for model in alike:
            own = np.searchsorted(alphas, searched[model])
            best = {key: np.unravel_index(int(m[own].argmin()), m[own].shape) for key, m in mean.items()}
            out[model] = []
            for o in range(len(outer)):
                picks = [best[o, rep] for rep in range(reps)]
                most = lambda v: int(np.bincount(v).argmax())  # noqa: E731  the first of equals
                out[model].append((float(alphas[own[most([p[0] for p in picks])]]), float(path[most([p[1] for p in picks])])))
    return out


def _kept(alleles: DataFrame, *columns: str) -> DataFrame:
    """The columns of ``alleles``, written once for all passes and dealt to all cores."""
    return materialize(alleles.select(*columns).repartition(4 * alleles.sparkSession.sparkContext.defaultParallelism), "alleles")


@dataclass(frozen=True)
class CrossValidation:
    """``metrics`` rows (rep, fold, model, trait, alpha, lambda and METRICS) and ``predictions`` rows (rep, model, trait, pool_idx, observed, predicted)."""

    metrics: pd.DataFrame
    predictions: pd.DataFrame


def cross_validate(
    alleles: DataFrame, y: np.ndarray, models: Sequence[str] = MODELS, k: int = 10, reps: int = 3, step: float = 0.1, inner_reps: int = 10, inner_folds: int = 10, seed: int = 0, compat: bool = False
) -> CrossValidation:
    """Cross-validate models over allele rows with the pools' frequencies ``x``; ``y`` is pools by traits."""
    n, traits = y.shape
    alleles = _kept(alleles, "x")
    total, _ = gram(alleles, n)
    products = total + 1
    jobs: list[Job] = []
    for rep in range(reps):
        fold, folds = k_split(n, k, [seed, rep])
        jobs += [Job(np.flatnonzero(fold != f), np.flatnonzero(fold == f), t, (rep, f)) for f in range(folds) for t in range(traits)]
    fit(jobs, products, y)
    weights = np.column_stack([j.weights for j in jobs])
    found, predictions = [], []
    chosen_by = choose(alleles, products, y, jobs, models, step, inner_reps, inner_folds, seed + 1)
    for model in models:
        chosen: list[tuple[float | None, float | None]] = [(None, None)] * len(jobs)
        if model == "ols":
            predicted = (products @ weights).T
        elif model == "ols_iterative":
            means = np.array([y[j.train, j.trait].mean() for j in jobs])
            clear = cleared(jobs, y)
            predicted = _reduce(alleles, lambda x: iterative(x, clear).T @ x, (len(jobs), n)) + means[:, None]
        else:
            by_proxy = model.endswith("_iterative")
            chosen = chosen_by[model]
            a, lam = sorted({c[0] for c in chosen}), sorted({c[1] for c in chosen})
            grid = penalised_predictions(alleles, jobs, y, np.array(a), np.array(lam), by_proxy)
            predicted = np.stack([grid[j, a.index(c[0]), lam.index(c[1])] for j, c in enumerate(chosen)])
        for job, row, (al, la) in zip(jobs, predicted, chosen, strict=True):
            rep, f = job.label
            found.append({"rep": rep, "fold": f, "model": model, "trait": job.trait, "alpha": al, "lambda": la} | metrics(y[job.valid, job.trait], row[job.valid], compat))
            predictions += [(rep, model, job.trait, int(i), float(y[i, job.trait]), float(row[i])) for i in job.valid]
    columns = ["rep", "model", "trait", "pool_idx", "observed", "predicted"]
    return CrossValidation(pd.DataFrame(found), pd.DataFrame(predictions, columns=columns))


def coefficients(alleles: DataFrame, y: np.ndarray, model: str = "ols", alpha: float = 1.0, lam: float = 0.0) -> tuple[DataFrame, np.ndarray]:
    """chr, pos, allele and ``beta`` (one per trait) fitted to all pools, and the intercepts."""
    n, traits = y.shape
    total, _ = gram(alleles, n)
    jobs = [Job(np.arange(n), np.arange(n), t, (t,)) for t in range(traits)]
    fit(jobs, total + 1, y)
    weights = np.column_stack([j.weights for j in jobs])
    clear = cleared(jobs, y) if model.endswith("_iterative") else []
    norm = lambda b: (1 - alpha) * b * b + alpha * np.abs(b)
    proxy = (lambda x, b: iterative(x, clear)) if clear else (lambda x, b: b)
    gains = top = None
    if model not in ("ols", "ols_iterative"):
        top = np.maximum(_reduce(alleles, lambda x: norm(proxy(x, x @ weights)).max(axis=0), (traits,), largest=True), 1e-300)
        gains = settle(*_reduce(alleles, lambda x: np.stack(moved(x @ weights, norm(x @ weights), norm(proxy(x, x @ weights)) / top < lam)), (4, traits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch, n)
                b = x @ weights
                if model == "ols_iterative":
                    b = iterative(x, clear)
                elif gains is not None:
                    b = penalised(b, norm(b), norm(proxy(x, b)) / top < lam, *gains)
                beta = pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, traits), pa.int32()), pa.array(b.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).cast(k) for c, k in (("chr", pa.string()), ("pos", pa.int64()), ("allele", pa.string()))] + [beta], names=["chr", "pos", "allele", "beta"])

    intercepts = y.mean(axis=0) if model == "ols_iterative" else weights.sum(axis=0)
    return alleles.select("chr", "pos", "allele", "x").mapInArrow(run, "chr string, pos long, allele string, beta array<double>"), intercepts


def predictors(alleles: DataFrame, y: np.ndarray, models: Sequence[str] = MODELS, step: float = 0.1, inner_reps: int = 10, inner_folds: int = 10, seed: int = 0) -> DataFrame:
    """Each model fitted to all pools: model, phenotype, alpha, lambda (null where it has none), chr, pos, allele, beta.

    Alpha and lambda are chosen by cross-validation over all pools. The intercept is a row
    whose allele is ``intercept`` and which has no place.
    """
    n, traits = y.shape
    alleles = _kept(alleles, "chr", "pos", "allele", "x")
    products = gram(alleles, n)[0] + 1
    jobs = [Job(np.arange(n), np.arange(n), t, (t,)) for t in range(traits)]
    fit(jobs, products, y)
    out = None
    chosen_by = choose(alleles, products, y, jobs, models, step, inner_reps, inner_folds, seed + 1)
    for model in models:
        chosen: list[tuple[float | None, float | None]] = chosen_by.get(model) or [(None, None)] * traits
        for t, (alpha, lam) in enumerate(chosen):
            rows, intercepts = coefficients(alleles, y[:, [t]], model, 1.0 if alpha is None else alpha, lam or 0.0)
            said = [F.lit(model).alias("model"), F.lit(f"Pheno_{t}").alias("phenotype"), F.lit(alpha).cast("double").alias("alpha"), F.lit(lam).cast("double").alias("lambda")]
            first = alleles.sparkSession.createDataFrame([(None, None, "intercept", [float(intercepts[0])])], "chr string, pos long, allele string, beta array<double>")
            both = first.unionByName(rows).select(*said, "chr", "pos", "allele", F.get("beta", F.lit(0)).alias("beta"))
            out = both if out is None else out.unionByName(both)
    return out
