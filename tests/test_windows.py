import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions.arrays import frequencies
from lociframe.model import LOCI_SCHEMA, WindowParams
from lociframe.operators import diversity as dv
from lociframe.operators.windows import in_windows, sliding_windows


def brute(points, p):
    """The chain of windows over all loci in order, and the rules for which stay."""
    points = sorted(points)
    n, h, chain = len(points), 0, []
    while True:
        c, x = points[h]
        t = max(i for i in range(n) if points[i][0] == c and points[i][1] <= x + p.size)
        chain.append((h, t))
        if t == n - 1:
            break
        later = [i for i in range(h + 1, t + 1) if points[i][1] >= x + p.slide]
        h = later[0] if later else t + 1
    kept = []
    for k, (h, t) in enumerate(chain):
        size = t - h + 1
        final = k == len(chain) - 1
        if size >= p.min_loci or (final and (size > 1 or k == 0 or chain[k - 1][1] - chain[k - 1][0] + 1 >= p.min_loci)):
            if not kept or kept[-1][1] != t:
                kept.append((h, t))
    return {(points[h][0], points[h][1], points[t][1], t - h + 1) for h, t in kept}


def run(spark, points, p):
    return {tuple(r) for r in sliding_windows(spark.createDataFrame(points, "chr string, pos long"), p).collect()}


def test_golden(spark):
    points = [("chr1", x) for x in (123, 174, 220, 254)] + [("chr2", x) for x in (55, 56, 100, 500)] + [("chr3", 765)]
    got = run(spark, points, WindowParams(100, 50, 1))
    assert got == {("chr1", 123, 220, 3), ("chr1", 174, 254, 3), ("chr2", 55, 100, 3), ("chr2", 500, 500, 1), ("chr3", 765, 765, 1)}


@pytest.mark.parametrize("seed", range(4))
def test_blocks_give_the_same_chain_as_the_whole(spark, seed):
    rng = np.random.default_rng(seed)
    points = [(f"c{c}", int(x)) for c in range(3) for x in np.unique(rng.integers(0, 3000, 150 if c < 2 else rng.integers(1, 100)))]
    p = WindowParams(100, int(rng.choice([1, 20, 50, 100])), int(rng.choice([1, 3, 6])), block=int(rng.choice([200, 350, 1_000_000])))
    assert run(spark, points, p) == brute(points, p)


def test_a_locus_falls_into_each_window_that_holds_it(spark):
    p = WindowParams(100, 50, 1)
    windows = spark.createDataFrame([("a", 0, 100, 3), ("a", 50, 150, 3)], "chr string, pos_ini long, pos_fin long, n_loci long")
    got = in_windows(spark.createDataFrame([("a", 50), ("a", 120), ("a", 151), ("b", 60)], "chr string, pos long"), windows, p)
    assert sorted((r.pos, r.pos_ini) for r in got.collect()) == [(50, 0), (50, 50), (120, 50)]


def diverse(spark):
    rows = [
        ("X", 123, "A", ["A", "G", "D"], [[10, 0, 0], [0, 100, 0], [100, 0, 0], [40, 30, 30], [20, 40, 40]]),
        ("Y", 456, "C", ["C", "T"], [[10, 0], [0, 100], [100, 0], [50, 50], [50, 50]]),
    ]
    return spark.createDataFrame(rows, LOCI_SCHEMA).withColumn("freqs", frequencies(F.col("counts")))


def test_fst_of_fixed_and_equal_pools(spark):
    got = {(r.pool_a, r.pool_b): r.fst for r in dv.fst_genome(diverse(spark)).collect()}
    assert got[0, 1] > 1 - 1e-9 and got[1, 0] > 1 - 1e-9 and got[0, 2] < 1e-6
    assert all(got[i, i] < 1e-6 for i in range(5))
    assert all(abs(got[i, j] - got[j, i]) < 1e-15 for i in range(5) for j in range(5))


def test_heterozygosity(spark):
    got = {(r.pos, r.pool_idx): r.pi for r in dv.pi_per_locus(diverse(spark)).collect()}
    assert got[456, 0] == 0 and abs(got[456, 4] - 0.505050505) < 1e-6


def test_watterson_of_a_pool_of_42(spark):
    loci = diverse(spark)
    p = WindowParams(100, 50, 1)
    got = {(r.chr, r.pool_idx): r.theta_w for r in dv.watterson_windows(loci, sliding_windows(loci, p), [42.0] * 5, p).collect()}
    assert got["Y", 0] == 0 and abs(got["Y", 4] - 0.2324) < 1e-4


def test_tajima(spark):
    rows = [
        ("X", 123, "A", ["A", "G", "D"], [[1, 1, 98], [1, 1, 98]]),
        ("Y", 456, "C", ["C", "T"], [[60, 40], [60, 40]]),
    ]
    loci = spark.createDataFrame(rows, LOCI_SCHEMA).withColumn("freqs", frequencies(F.col("counts")))
    p = WindowParams(100, 50, 1)
    got = {r.chr: r.tajima_d for r in dv.tajima_windows(loci, sliding_windows(loci, p), [42.0, 42.0], p).where("pool_idx = 0").collect()}
    assert abs(got["X"] + 5.3954) < 1e-3 and abs(got["Y"] - 7.072) < 1e-2
