"""Imputation of missing frequencies: by the mean of the pools, and by linked nearest neighbours in windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.model import EPSILON, WindowParams
from lociframe.operators import missing
from lociframe.operators.windows import in_windows, sliding_windows
from lociframe.sources.shared import materialize

LONG = "chr string, pos long, allele string, allele_ord int, pool_idx int, freq double"


def mean_impute(long: DataFrame) -> DataFrame:
    """Missing frequencies become the allele's mean over the pools that have one, scaled so that a locus' means sum to 1.

    Coverage that is missing where the locus has some becomes infinite, which marks it.
    """
    locus, allele = Window.partitionBy("chr", "pos"), Window.partitionBy("chr", "pos", "allele")
    # rows of a locus meet once, and both windows find them there
    out = long.repartition("chr", "pos").withColumns({"mean": F.avg("freq").over(allele), "rows": F.count("*").over(allele)})
    out = out.withColumn("sum", F.sum(F.col("mean") / F.col("rows")).over(locus))
    out = out.withColumn("mean", F.try_divide("mean", "sum")).drop("rows", "sum")
    mark = F.when(F.col("coverage").isNull() & F.col("mean").isNotNull(), F.lit(float("inf"))).otherwise(F.col("coverage"))
    return out.withColumns({"freq": F.coalesce("freq", "mean"), "coverage": mark}).drop("mean")


def correlations(x: np.ndarray) -> np.ndarray:
    """Pearson correlation of columns over complete pairs; NaN where one does not vary."""
    ok = ~np.isnan(x)
    z = np.where(ok, x, 0.0)
    w = ok.astype(float)
    n = w.T @ w
    with np.errstate(all="ignore"):
        sx, sxy = z.T @ w, z.T @ z
        sxx = (z * z).T @ w
        cov = sxy - sx * sx.T / n
        var = sxx - sx * sx / n
        r = cov / np.sqrt(var * var.T)
    r[(n < 2) | (var <= EPSILON) | (var.T <= EPSILON)] = np.nan
    return r


def from_neighbours(gaps: np.ndarray, donors: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """A value for each row of ``gaps`` from the ``values`` of the ``k`` nearest of ``donors``, or of all where none is near.

    Distances are over the columns that both have; of equal ones the first donors are taken.
    """
    difference = gaps[:, None, :] - donors[None]
    both = ~np.isnan(difference)
    distance = np.where(both.any(axis=2), np.sqrt((np.where(both, difference, 0) ** 2).sum(axis=2)), np.inf)
    nearest = np.argsort(distance, axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(distance, nearest, axis=1)
    near = np.isfinite(d)
    d = np.where(near, d, 0)
    w = np.where(near, 1 - d / (d.sum(axis=1, keepdims=True) + EPSILON) + EPSILON, 0)
    total = w.sum(axis=1)
    return np.where(near.any(axis=1), (w * values[nearest]).sum(axis=1) / np.where(total > 0, total, 1), values.mean())


def impute_window(x: np.ndarray, loci: np.ndarray, n_loci: int, k: int) -> np.ndarray:
    """Fill one window's frequencies, pools by alleles; ``loci`` numbers the locus of each column.

    For an allele, distances between pools come from the ``n_loci`` alleles most correlated
    with it (those of unknown correlation first). A missing frequency becomes the mean of the
    ``k`` nearest pools that have one, weighted by 1 - distance / sum of distances; without
    any, the mean of all that have one. A pool's frequencies of a locus are scaled to sum 1
    once its last allele is filled.
    """
    x = x.copy()
    r = correlations(x)
    last = np.append(loci[1:] != loci[:-1], True)
    for j in range(x.shape[1]):
        known = ~np.isnan(x[:, j])
        if not known.all() and known.any():
            linked = np.argsort(-np.where(np.isnan(r[:, j]), np.inf, r[:, j]), kind="stable")[: min(n_loci, x.shape[1])]
            x[~known, j] = from_neighbours(x[np.ix_(~known, linked)], x[np.ix_(known, linked)], x[known, j], k)
        if last[j]:
            own = np.flatnonzero(loci == loci[j])
            rows = x[:, own]
            sums = np.nansum(rows, axis=1, keepdims=True) + EPSILON
            touched = np.isnan(x[:, own]).any(axis=1) | (np.abs(sums[:, 0] - 1) > 1e-12)
            x[np.ix_(touched, own)] = rows[touched] / sums[touched]
    return x


def ld_knn_impute(long: DataFrame, p: WindowParams = WindowParams(), n_loci: int = 10, k: int = 5) -> DataFrame:
    """chr, pos, allele, allele_ord, pool_idx, freq with missing frequencies filled window by window.

    A window is one task's group; its size is bounded by the window's length. Where windows
    overlap, the later one's value stands. Loci in no window keep what they have.
    """
    windows = sliding_windows(long, p)
    placed = in_windows(long.select("chr", "pos", "allele", "allele_ord", "pool_idx", "freq"), windows, p)

    def fill(group: pa.Table) -> pa.Table:
        pos, order, labels = group.column("pos").to_numpy(), group.column("allele_ord").to_numpy(), group.column("allele").to_pylist()
        rank = {label: i for i, label in enumerate(sorted(set(labels)))}
        alleles = np.column_stack([pos, order, [rank[label] for label in labels]])
        sort = np.lexsort(alleles.T[::-1])
        column = np.empty(len(pos), np.int64)
        column[sort] = np.cumsum(np.append(False, (np.diff(alleles[sort], axis=0) != 0).any(axis=1)))
        pools, row = np.unique(group.column("pool_idx").to_numpy(), return_inverse=True)
        x, loci = np.full((len(pools), column.max() + 1), np.nan), np.empty(column.max() + 1, np.int64)
        x[row, column], loci[column] = group.column("freq").to_numpy(), pos
        filled = pa.array(impute_window(x, loci, n_loci, k)[row, column], from_pandas=True)  # without a value: null
        return group.set_column(group.schema.get_field_index("freq"), "freq", filled).select(["chr", "pos", "allele", "allele_ord", "pool_idx", "freq", "pos_ini"])

    filled = placed.groupBy("chr", "pos_ini", "pos_fin").applyInArrow(fill, LONG + ", pos_ini long")
    keys = ["chr", "pos", "allele", "allele_ord", "pool_idx"]
    value = filled.groupBy(*keys).agg(F.max_by("freq", "pos_ini").alias("filled"))
    return long.join(value, keys, "left").select(*keys, F.coalesce("freq", "filled").alias("own"), "filled", "freq").select(*keys, F.coalesce("filled", "own").alias("freq"))


def impute_pipeline(long: DataFrame, depth: float = 5, top_pools: float = 0.1, top_loci: float = 0.1, method: str = "aLD-kNNi", p: WindowParams = WindowParams(), n_loci: int = 10, k: int = 5) -> DataFrame:
    """Set missing by depth, drop the pools and loci that miss most, impute, and drop loci that still miss any."""
    # each is used several times, so rows are written once where they are made
    rows = materialize(missing.set_missing_by_depth(long, depth), "depth")
    rows = materialize(missing.drop_loci(missing.drop_pools(rows, top_pools), top_loci), "kept")
    if method == "mean":
        filled = mean_impute(rows)
    elif method == "aLD-kNNi":
        filled = ld_knn_impute(rows, p, n_loci, k)
    else:
        raise ValueError("method is mean or aLD-kNNi")
    filled = materialize(filled, "imputed")
    gone = filled.where("freq is null or isnan(freq)").select("chr", "pos").distinct()
    return filled.join(gone, ["chr", "pos"], "left_anti")
