"""Heterozygosity, Fst, Watterson's estimator and Tajima's D, per locus and per sliding window.

Per-locus values are narrow. Windows come from one operator and are joined once; what is
averaged in a window shuffles as partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import arrays as ar
from lociframe.model import EPSILON, WindowParams
from lociframe.operators.windows import in_windows

WINDOW = ["chr", "pos_ini", "pos_fin"]


def _squares(row: Column) -> Column:
    return F.aggregate(row, F.lit(0.0), lambda s, x: s + x * x)


def _corrected(c: Column) -> Column:
    """Coverage over coverage less one."""
    return c / (c - 1 + F.lit(EPSILON))


def pi_per_locus(loci: DataFrame) -> DataFrame:
    """chr, pos, pool_idx, pi. Needs ``freqs``."""
    cov = ar.coverage(F.col("counts"))
    each = F.zip_with("freqs", cov, lambda row, c: F.abs((_squares(row) - 1) * _corrected(c.cast("double"))))
    return loci.select("chr", "pos", F.posexplode(each).alias("pool_idx", "pi"))


def fst_per_locus(loci: DataFrame) -> DataFrame:
    """chr, pos, pool_a, pool_b (a <= b), fst between 0 and 1. Needs ``freqs``."""
    def facts(f: Column) -> Column:
        own = lambda row, c: ar.let(_corrected(c.cast("double")), lambda k: F.struct(row.alias("p"), (1 - (1 - _squares(row)) * k).alias("q")))
        return F.zip_with(f, ar.coverage(F.col("counts")), own)

    def value(a: Column, b: Column) -> Column:
        cross = F.aggregate(F.zip_with(a["p"], b["p"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return ar.let(cross, lambda q: F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((a["q"] + b["q"]) / 2 - q) / (1 - q + F.lit(EPSILON)))))

    def pairs(m: Column) -> Column:
        row = lambda a, i: F.transform(F.slice(m, i + 1, F.size(m)), lambda b, k: F.struct(i.alias("pool_a"), (i + k).alias("pool_b"), value(a, b).alias("fst")))
        return F.flatten(F.transform(m, row))

    every = ar.let(facts(F.col("freqs")), pairs)
    return loci.select("chr", "pos", F.explode(every).alias("x")).select("chr", "pos", "x.pool_a", "x.pool_b", "x.fst")


def mean_or_missing(value: str) -> Column:
    """Mean that is missing where any value is."""
    return F.when(F.count(F.when(F.col(value).isNull(), 1)) == 0, F.avg(value))


def both_ways(pairs: DataFrame, *keys: str) -> DataFrame:
    """Each pair also with its pools swapped."""
    swapped = pairs.where("pool_a <> pool_b").select(*keys, F.col("pool_b").alias("pool_a"), F.col("pool_a").alias("pool_b"), "fst")
    return pairs.select(*keys, "pool_a", "pool_b", "fst").unionByName(swapped)


def fst_genome(loci: DataFrame) -> DataFrame:
    """pool_a, pool_b, fst: the mean over loci, both ways."""
    return both_ways(fst_per_locus(loci).groupBy("pool_a", "pool_b").agg(mean_or_missing("fst").alias("fst")))


def fst_windows(loci: DataFrame, windows: DataFrame, p: WindowParams) -> DataFrame:
    """chr, pos_ini, pos_fin, pool_a, pool_b (a <= b), fst: the mean over the window's loci."""
    joined = in_windows(fst_per_locus(loci), windows, p)
    return joined.groupBy(*WINDOW, "pool_a", "pool_b").agg(mean_or_missing("fst").alias("fst"))


def pi_windows(loci: DataFrame, windows: DataFrame, p: WindowParams) -> DataFrame:
    """chr, pos_ini, pos_fin, pool_idx, pi: the mean over the window's loci."""
    return in_windows(pi_per_locus(loci), windows, p).groupBy(*WINDOW, "pool_idx").agg(mean_or_missing("pi").alias("pi"))


def polymorphic(loci: DataFrame) -> DataFrame:
    """chr, pos, pool_idx, poly: 1 where no allele of the pool is fixed. Needs ``freqs``."""
    return loci.select("chr", "pos", F.posexplode(F.transform("freqs", lambda row: F.when(F.array_max(row) < 1, 1).otherwise(0))).alias("pool_idx", "poly"))


def _of_pool(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])[F.col("pool_idx")]


def watterson_windows(loci: DataFrame, windows: DataFrame, sizes: Sequence[float], p: WindowParams) -> DataFrame:
    """chr, pos_ini, pos_fin, pool_idx, theta_w: share of segregating loci over the harmonic number of the pool's size."""
    a1 = [sum(1 / i for i in range(1, int(n))) for n in sizes]
    joined = in_windows(polymorphic(loci), windows, p)
    share = F.sum("poly") / F.count("*")
    return joined.groupBy(*WINDOW, "pool_idx").agg(share.alias("share")).select(*WINDOW, "pool_idx", F.try_divide("share", _of_pool(a1)).alias("theta_w"))


def tajima_windows(loci: DataFrame, windows: DataFrame, sizes: Sequence[float], p: WindowParams, textbook: bool = False) -> DataFrame:
    """chr, pos_ini, pos_fin, pool_idx, pi, theta_w, tajima_d.

    The number of segregating sites is taken as theta_w over the harmonic number; with
    ``textbook`` as theta_w times it.
    """
    joined = in_windows(_pi_and_poly(loci), windows, p)
    made = joined.groupBy(*WINDOW, "pool_idx").agg(mean_or_missing("pi").alias("pi"), (F.sum("poly") / F.count("*")).alias("share"))
    a1, e1, e2 = [], [], []
    for size in sizes:
        n = int(size)
        h1, h2 = (sum(1 / i**k for i in range(1, n)) for k in (1, 2))
        a1.append(h1)
        if n < 2:
            e1.append(0.0)
            e2.append(0.0)
            continue
        b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
        c1, c2 = b1 - 1 / h1, b2 - (n + 2) / (h1 * n) + h2 / h1**2
        e1.append(c1 / h1)
        e2.append(c2 / (h1**2 + h2))
    made = made.withColumn("theta_w", F.try_divide("share", _of_pool(a1)))
    s = F.col("theta_w") * _of_pool(a1) if textbook else F.try_divide("theta_w", _of_pool(a1))
    variance = _of_pool(e1) * s + _of_pool(e2) * s * (s - 1)
    gap = F.col("pi") - F.col("theta_w")
    d = F.when((F.abs(gap) <= EPSILON) | (variance <= EPSILON), 0.0).otherwise(F.try_divide(gap, F.sqrt(variance)))
    return made.select(*WINDOW, "pool_idx", "pi", "theta_w", d.alias("tajima_d"))


def _pi_and_poly(loci: DataFrame) -> DataFrame:
    """Both per-locus values in one pass."""
    cov = ar.coverage(F.col("counts"))
    each = F.zip_with(
        "freqs", cov, lambda row, c: F.struct(F.abs((_squares(row) - 1) * _corrected(c.cast("double"))).alias("pi"), F.when(F.array_max(row) < 1, 1).otherwise(0).alias("poly"))
    )
    return loci.select("chr", "pos", F.posexplode(each).alias("pool_idx", "x")).select("chr", "pos", "pool_idx", "x.pi", "x.poly")


def window_id(chrom: Column, first: Column, last: Column) -> Column:
    """``Window-<chr>_<first position>_<last position>``."""
    return F.concat_ws("_", F.concat(F.lit("Window-"), chrom), first, last)


def window_of(name: Column) -> Column:
    """The struct of chr, pos_ini and pos_fin that a window's id stands for, whatever a chromosome's name holds; null for what is none."""
    pattern = r"(?s)^Window-(.*)_(\d+)_(\d+)$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    found = F.struct(part(1).alias("chr"), part(2).try_cast("long").alias("pos_ini"), part(3).try_cast("long").alias("pos_fin"))
    return F.when(F.regexp_like(name, F.lit(pattern)), found)


def wide(values: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """A row for each window with a column for each pool, and one of the pools' means over windows, which has no chr."""
    of = lambda f: [f(F.when(F.col("pool_idx") == i, F.col(column))).alias(n) for i, n in enumerate(names)]
    label = window_id(*[F.col(c) for c in WINDOW])
    windows = values.groupBy(*WINDOW).agg(*of(F.max)).select(label.alias("window"), *WINDOW, *[F.col(f"`{n}`") for n in names])
    means = values.groupBy().agg(*of(F.avg)).select(F.lit("Mean_across_windows").alias("window"), *[F.lit(None).cast(t).alias(c) for c, t in zip(WINDOW, ("string", "long", "long"), strict=True)], *[F.col(f"`{n}`") for n in names])
    return means.unionByName(windows)


def fst_matrix(genome: DataFrame, names: Sequence[str]) -> DataFrame:
    """``fst_genome`` as a row and a column for each pool, to 8 digits."""
    pool = F.array(*[F.lit(n) for n in names])[F.col("pool_a")]
    cells = [F.max(F.when(F.col("pool_b") == i, F.round("fst", 8))).alias(n) for i, n in enumerate(names)]
    return genome.groupBy("pool_a").agg(*cells).orderBy("pool_a").select(pool.alias("pool"), *[F.col(f"`{n}`") for n in names])


def fst_wide(windows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``fst_windows`` as a row for each window and a column ``<a>_vs_<b>`` for each ordered pair, to 8 digits."""
    columns = {f"{a}_vs_{b}": (i, j) for i, a in enumerate(names) for j, b in enumerate(names)}
    cell = lambda i, j: F.max(F.when((F.col("pool_a") == min(i, j)) & (F.col("pool_b") == max(i, j)), F.round("fst", 8)))
    return windows.groupBy(*WINDOW).agg(*[cell(*at).alias(n) for n, at in columns.items()])


def report(values: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """pool, mean_across_windows and n_windows of each pool."""
    out = values.groupBy("pool_idx").agg(F.avg(column).alias("mean_across_windows"), F.count("*").alias("n_windows"))
    return out.select(F.array(*[F.lit(n) for n in names])[F.col("pool_idx")].alias("pool"), "mean_across_windows", "n_windows")
